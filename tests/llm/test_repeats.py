import hashlib
from collections import Counter

import pytest
from conftest import messy

from panelwright.llm.repeats import SuffixAutomaton, remove_repeats


def brute(rows, k):
    texts = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1))
    out = []
    for doc, w in texts:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("k, anchor, shard", [(35, 8, 200_000), (7, 3, 200_000), (7, 3, 40)])
def test_equals_counting_all_windows(spark, texts, k, anchor, shard):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    got = remove_repeats(df, k=k, anchor_words=anchor, shard_words=shard).drop("kept_text")
    assert sorted(map(str, map(tuple, got.collect()))) == brute(texts, k)


def test_overlapping_and_periodic_passages(spark):
    rows = [(1, "a b c " * 9), (2, "x " * 30), (3, "a b " * 4 + "c d e f g"), (4, "b a b a b a b c d e f"), (5, "q r s t u v w x y z")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), k=5, anchor_words=2).drop("kept_text")
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows, 5)


def test_automaton_counts_every_occurrence():
    machine = SuffixAutomaton()
    machine.add(b"a b a b a".split(), 1)
    machine.add(b"b a c".split(), 3)
    machine.finish()
    assert machine.repeated(b"a b a b a".split(), 2) == [0, 1, 2, 3]
    assert machine.repeated(b"b a c".split(), 3) == [0]
    assert machine.repeated(b"a b a b a".split(), 4) == []


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
