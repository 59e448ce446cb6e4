import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import messy
from test_bpe import LIBRARY, PATH

from panelwright.llm.packing import Plan, pack


def bins_of(plan):
    bins, seen = defaultdict(list), set()
    for size, rank, per_bin, first_bin, offset, n in plan.runs:
        for k in range(per_bin * n):
            assert (size, rank + k) not in seen
            seen.add((size, rank + k))
            bins[first_bin + k // per_bin].append((offset + k % per_bin * size, size))
    return bins, seen


def optimum(items, room):
    best = [len(items)]

    def place(i, left):
        if len(left) >= best[0]:
            return
        if i == len(items):
            best[0] = len(left)
            return
        for r in {r for r in left if r >= items[i]}:
            rest = list(left)
            rest[rest.index(r)] -= items[i]
            place(i + 1, rest)
        place(i + 1, [*left, room - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    draw = random.Random(5)
    for _ in range(150):
        room = draw.choice([10, 20, 31])
        items = sorted((draw.randint(1, room) for _ in range(draw.randint(1, 8))), reverse=True)
        plan = Plan(Counter(items), room)
        bins, seen = bins_of(plan)
        assert len(seen) == len(items) and sorted(bins) == list(range(plan.bins))
        for content in bins.values():
            at = 0
            for offset, size in sorted(content):
                assert offset == at
                at += size
            assert at <= room
        fixed = {b for b in bins if b < plan.fixed}
        rest = sorted((s for b in bins if b not in fixed for _, s in bins[b]), reverse=True)
        assert len(fixed) + optimum(rest, room) == optimum(items, room)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, texts, capacity):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    got = pack(df, PATH, capacity=capacity).collect()
    want = []
    for i, t, *_ in texts:
        ids = np.asarray([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1 + math.ceil(1.05 * sum(r.length for r in got) / capacity)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
