import pytest
from conftest import messy

from panelwright.llm import jaccard_join
from panelwright.llm.components import components
from panelwright.llm.store import Workspace


def brute(rows, k=5, percent=75):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted(str((i, len(s), None if i is None else find(i))) for i, s in sets)


@pytest.mark.parametrize("k, percent", [(5, 75), (2, 30), (1, 90)])
def test_equals_comparing_all_pairs(spark, texts, k, percent):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    got = jaccard_join.linked_components(df, k=k, percent=percent).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(texts, k, percent)


def test_chain_of_near_copies_and_threshold(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(0, 20, 3)]
    rows += [(90, "A b C d"), (91, "a B c D"), (92, "a b c e"), (93, " ".join(words[:32])), (94, " ".join(words[:31] + ["z"]))]
    rows += [(100 + i, " ".join([f"h{j}" for j in range(30)] + [f"t{i}"])) for i in range(30)]
    got = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_frequencies_of_tokens_over_batches():
    import pyarrow as pa

    tokens = [1, 2, 2, 3] + [4] * 2500 + [5, 6, 6]
    batches = [pa.RecordBatch.from_pydict({"token": tokens[i : i + 700], "id": list(range(i, min(i + 700, len(tokens))))}) for i in range(0, len(tokens), 700)]
    rows = [tuple(r.values()) for b in jaccard_join._repeated(batches) for r in b.to_pylist()]
    assert [r[1] for r in rows] == [i for i, t in enumerate(tokens) if t in (2, 4, 6)]
    assert {r[0]: r[2] for r in rows} == {2: 2, 4: jaccard_join.FREQUENT, 6: 2}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(40)] + [(7, 7), (31, 30), (120, 300)]
    got = components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    want = {**{i: 0 for i in range(32)}, **{100 + i: 100 for i in range(41)}, 300: 100}
    assert {r.node: r.component for r in got.collect()} == want


def test_empty_table(spark):
    assert jaccard_join.linked_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_of_blocks_keeps_what_their_members_may_share(spark):
    from pyspark.sql import functions as F

    outside = [n - jaccard_join.sample_size(n, jaccard_join.PERCENT) for n in (83, 84)]
    shared = -(-jaccard_join.PERCENT * 2 * 83 // (100 + jaccard_join.PERCENT)) - max(outside)
    assert outside == [54, 53] and shared == 18  # two sets of 83 may share no more of their samples
    rows = [(1, block, n, 0, shared, block) for block in (1, 2) for n in (83, 84)]
    at = jaccard_join._block_rows(spark.createDataFrame(rows, "token long, block long, n long, pos int, repeated int, component long"), jaccard_join.PERCENT)
    met = at.alias("x").join(at.alias("y"), (F.col("x.block") < F.col("y.block")) & jaccard_join._possible("x", "y", jaccard_join.PERCENT))
    assert met.count() == 1
