import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import messy

from panelwright.llm import vector_codes as vc


def brute(rows, entries=256, parts=4, rounds=4):
    """(codes, errors by row in order, label errors, digest) by full scans with Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    points = [[math.floor(1024 * np.float32(x).item()) for x in r[1]] for r in kept]
    width = len(points[0]) // parts if points else 0
    cut = [[p[k * width : (k + 1) * width] for p in points] for k in range(parts)]
    books = [[list(p) for p in cut[k][:entries]] for k in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(books[k])) for p in cut[k]] for k in range(parts)]

    for _ in range(rounds):
        for k, found in enumerate(assign()):
            members = defaultdict(list)
            for p, (_, i) in zip(cut[k], found, strict=True):
                members[i].append(p)
            for i, ps in members.items():
                books[k][i] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
    found = assign()
    errors = [sum(found[k][j][0] for k in range(parts)) for j in range(len(points))]
    labels = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        (str(r[0]), "".join(f"{found[k][j][1]:02x}" for k in range(parts)), errors[j], labels[r[2]], digest) for j, r in enumerate(kept)
    )


def rows_of(n, width=8, seed=3):
    draw = random.Random(seed)
    return [(i * 3, [draw.choice([0.0, 0.25, -0.251, draw.gauss(0, 1)]) for _ in range(width)], draw.choice([1, 2, None])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_are_those_of_full_scans(spark, entries):
    rows = rows_of(300)
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1], 9), (None, rows[8][1], 1), (None, None, None), (7, None, 2), (8, [], 2)]
    rows += [(1, [float("nan")] * 8, 1), (2, [float("-inf"), *[0.0] * 7], 1), (4, [None, *[0.0] * 7], 1), (5, [1.0] * 4, 1)]
    got = vc.compress(messy(spark, rows, SCHEMA), entries=entries).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, entries)


def test_rescan_keeps_ties_and_exact_distances():
    draw = np.random.default_rng(4)
    for _ in range(200):
        points, book = draw.integers(-2, 3, (40, 2)), draw.integers(-2, 3, (6, 2))
        code, apart = vc.nearest(points, book)
        fresh = np.where(draw.random(6)[:, None] < 0.5, draw.integers(-2, 3, (6, 2)), book)
        got = vc.rescan(points, code, apart, fresh, (fresh != book).any(1))
        want = vc.nearest(points, fresh)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_large_components_stay_exact(spark):
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-60_000, 60_000) for _ in range(4)], 1) for i in range(30)]
    got = vc.compress(spark.createDataFrame(rows, SCHEMA), entries=4).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, 4)
    with pytest.raises(ValueError, match="beyond"):
        vc.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vc.compress(none).collect() == []
    assert vc.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vc.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))
