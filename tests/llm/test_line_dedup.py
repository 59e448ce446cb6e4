import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import messy

from panelwright.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def corpus():
    draw = random.Random(4)
    base = ["".join(draw.choice("abcd efg") for _ in range(draw.randint(3, 40))) for _ in range(20)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(draw.randint(0, 6)):
            x = list(draw.choice(base))
            for _ in range(draw.randint(0, 3)):
                i = draw.randrange(len(x) + 1)
                x[i : i + draw.randint(0, 1)] = draw.choice(["", "z", "é"])
            lines.append("".join(x))
        rows.append((doc, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n \n"), (103, rows[3][1]), (104, "w" * 5000 + "\n" + "w" * 5001), (None, rows[4][1])]


def allowed(x, y, tau):
    return min(tau, min(len(x), len(y)) // 8)


def brute(rows, tau):
    docs = [(d, [(i, x) for i, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]) for d, t in rows]
    lines = sorted({x for _, found in docs for _, x in found})
    parent, degree = {}, Counter()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if abs(len(x) - len(y)) <= tau and (len(x) > 1000 or edits(x, y) <= allowed(x, y, tau)):
                degree.update((x, y))
                parent[find(x)] = find(y)
    first = {}
    for d, found in docs:
        for i, x in found:
            key = (-1 if d is None else d, i)
            first[find(x)] = min(first.get(find(x), key), key)
    out = []
    for d, found in docs:
        gone = [(i, x) for i, x in found if first[find(x)] != (-1 if d is None else d, i)]
        ids = sorted({first[find(x)][0] for _, x in gone} - {-1})
        out.append((d, len(found), sum(degree[x] for _, x in found), len(gone), [i for i, _ in gone], ids))
    return sorted(map(str, out))


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_equals_comparing_all_lines(spark, tau):
    df = messy(spark, corpus(), "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in line_dedup.line_classes(df, tau=tau).collect()) == brute(corpus(), tau)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_links_of_short_lines(spark, tau):
    from panelwright.llm.store import Workspace

    draw = random.Random(7)
    lines = {"".join(draw.choice("abé 😀") for _ in range(draw.randint(1, 9))).replace(" ", "_") for _ in range(150)}
    lines |= {"".join(draw.choice("abcdefgh") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5, 15, 17)}
    lines |= {"Euxvi, et et.", "Euxvi, | et.", "fourteen chars", "fourteen charsxy", "}", "},", "*" * 15, "*" * 16, "*" * 17}
    lines |= {"".join(draw.choice("ab") for _ in range(draw.randint(6, 27))) for _ in range(250)}
    lines = sorted(lines)
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {(bytes(r.a), bytes(r.b)) for r in line_dedup.line_links(Workspace(spark, "t"), table, tau).collect()}
    md5 = {x: hashlib.md5(x.encode()).digest() for x in lines}
    want = {tuple(sorted((md5[x], md5[y]))) for i, x in enumerate(lines) for y in lines[i + 1 :] if edits(x, y) <= allowed(x, y, tau)}
    assert got == want


def test_short_lines_stay_and_make_no_pairs(spark):
    from panelwright.llm.store import Workspace

    table = spark.createDataFrame([(i, chr(0x4E00 + i)) for i in range(1200)], "doc_id long, text string")
    assert {r.n_removed for r in line_dedup.line_classes(table).collect()} == {0}
    lines = table.selectExpr("text AS line", "hash(text) AS h", "1 AS n").where("n >= 8")
    assert line_dedup.candidate_pairs(Workspace(spark, "t"), lines, 2).count() == 0


@pytest.mark.parametrize("tau", [1, 2])
def test_lines_of_one_pattern(spark, tau, monkeypatch):
    """Many lines share most pieces; few are near each other. All links are found, from few pairs."""
    from pyspark.sql import functions as F

    from panelwright.llm.store import Workspace

    monkeypatch.setattr(line_dedup, "GROUP", 3)
    draw = random.Random(12)
    names = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(13, 15))) for _ in range(120)]
    names += [n[:3] + "z" + n[3 + k % 2 :] for k, n in enumerate(names[:25])]
    lines = sorted({f"heirs of {name}, 2001" for name in names})
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    md5 = {x: hashlib.md5(x.encode()).digest() for x in lines}
    want = {tuple(sorted((md5[x], md5[y]))) for i, x in enumerate(lines) for y in lines[i + 1 :] if edits(x, y) <= tau}
    assert len(want) >= 20
    assert {(bytes(r.a), bytes(r.b)) for r in line_dedup.line_links(Workspace(spark, "t"), table, tau).collect()} == want
    texts = table.select("line", F.xxhash64("line").alias("h"), F.length("line").alias("n"))
    assert line_dedup.candidate_pairs(Workspace(spark, "t"), texts, tau).count() < len(lines) * (len(lines) - 1) / 2 / 4


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_a_substring_is_probed_once(spark, tau):
    """Near lines share a key of the shorter one's segments, and no line probes a key twice or one of its own again."""
    from pyspark.sql import functions as F

    draw = random.Random(5)
    names = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(9 * tau, 9 * tau + 12))) for _ in range(60)]
    names += [n[:i] + draw.choice(["", "z", "é"]) + n[i + draw.randint(0, 1) :] for n in names for i in (0, draw.randrange(len(n)), len(n) - 1)]
    lines = sorted(set(names))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "h long, line string").withColumn("n", F.length("line"))
    own, moved = ([(r.h, r.key) for r in line_dedup._keys(table, tau, kind).collect()] for kind in (False, True))
    assert len(own) == len(lines) * (tau + 1)
    assert len({*own, *moved}) == len(own) + len(moved)
    shifted = [p for p in line_dedup._probe_places(tau) if p[0] or p[2]]
    assert len(moved) < 0.7 * len(lines) * len(shifted)
    segments, every = ([{k for h, k in pairs if h == i} for i in range(len(lines))] for pairs in (own, own + moved))
    near = [(i, j) for i, x in enumerate(lines) for j, y in enumerate(lines) if len(x) <= len(y) <= len(x) + tau and i != j and edits(x, y) <= tau]
    assert len(near) > 60
    assert all(segments[i] & every[j] for i, j in near)


def test_distance_is_taken_without_common_ends(spark, monkeypatch):
    from pyspark.sql import functions as F

    draw = random.Random(3)
    for tau in (1, 2, 3):
        rows = []
        for _ in range(400):
            x = "".join(draw.choice(draw.choice(["ab", "abcé😀", "aaaaab"])) for _ in range(draw.randint(tau, 40)))
            y = list(x)
            for _ in range(draw.randint(0, tau + 3)):
                i = draw.randrange(len(y) + 1)
                y[i : i + draw.randint(0, 1)] = draw.choice(["", "a", "b", "é"])
            x, y = sorted((x, "".join(y)), key=len, reverse=True)
            if len(x) >= tau and len(x) - len(y) <= tau:
                rows.append((x, y))
        found = spark.createDataFrame(rows, "x string, y string").select("x", "y", line_dedup.edit_distance(F.col("x"), F.col("y"), tau).alias("d"))
        assert all(min(r.d, tau + 1) == min(edits(r.x, r.y), tau + 1) for r in found.collect())
    monkeypatch.setattr(line_dedup, "_array_distance", lambda longer, shorter, tau: F.size(longer))
    long = spark.createDataFrame([("a" * 500 + "bc" + "d" * 300, "a" * 500 + "x" + "d" * 300), ("é" * 256, "é" * 256)], "x string, y string")
    assert [r.d for r in long.select(line_dedup.edit_distance(F.col("x"), F.col("y"), 2).alias("d")).collect()] == [2, 2]


def test_empty_table(spark):
    assert line_dedup.line_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
