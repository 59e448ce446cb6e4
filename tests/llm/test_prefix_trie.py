import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import messy

from panelwright.llm.prefix_trie import decompose, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = turns.get(base, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, cs in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in nodes.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(k))))
        out.append((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(seed=2):
    draw = random.Random(seed)
    texts = [None, "", "hi", "hello é😀", "x" * 50, "ok\n"]
    rows = []
    for c in [*range(-3, 40), 100, 105, 130, 199, 250, 777, 1200, 1201]:
        for t in range(draw.randint(1, 9)):
            rows.append((c, draw.choice([t, t, 3, None]), draw.choice(["user", "user", None]), draw.choice(texts)))
    rows += [(c, t, "user", texts[2 + t % 2]) for c in range(300, 340) for t in range(12)]  # copies
    rows += [(500, t, "user", str(t)) for t in range(400)] + [(777, 1, "user", "again")] * 3  # a long one
    rows += [(None, 1, "user", "no conversation"), (900, None, None, None)]
    return rows


@pytest.mark.parametrize("local_nodes", [3, 60, 4096])
def test_nodes_and_totals(spark, local_nodes):
    rows = conversations()
    got = prefix_trie(messy(spark, rows, SCHEMA), local_nodes=local_nodes).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == brute(rows)


def test_empty_tables(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_decomposition_of_forests():
    draw = np.random.default_rng(6)
    for _ in range(100):
        n = int(draw.integers(1, 60))
        up = np.array([-1 if i == 0 or draw.random() < 0.1 else int(draw.integers(max(0, i - 4), i)) for i in range(n)])
        own, values = draw.integers(1, 5, n), draw.integers(0, 9, (n, 2))
        depth, comp, weight, total = np.zeros(n, int), np.arange(n), own.copy(), values.copy()
        for i in range(n):
            if up[i] >= 0:
                depth[i], comp[i] = depth[up[i]] + 1, comp[up[i]]
        for i in range(n)[::-1]:
            if up[i] >= 0:
                weight[up[i]] += weight[i]
                total[up[i]] += total[i]
        names = draw.permutation(n) * 7 + 1
        order = np.argsort(names[comp], kind="stable")
        got = decompose(*(a[order] for a in (names[comp], names, np.where(up >= 0, names[up], -1), depth, weight, values)))
        assert (got == total[order]).all()
