import hashlib

import pytest
from conftest import messy

from panelwright.llm.exact_dedup import exact_groups


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def result(df):
    return sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())))


@pytest.mark.parametrize("size", [4096, 7])
def test_equals_grouping_by_text(spark, texts, size):
    df = messy(spark, [(r[0], r[1]) for r in texts], "doc_id long, text string")
    assert result(exact_groups(df, block_bytes=size)) == sorted(map(str, brute(texts)))


def test_texts_that_share_all_blocks_but_one(spark):
    rows = [(i, "abcdefgh" * 5 + tail) for i, tail in enumerate(["", "a", "b", "b", "ab", "abcdefgh"])]
    rows += [(9, "b" + "abcdefgh" * 5), (10, "é" * 20), (11, "é" * 20)]
    assert result(exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=8)) == sorted(map(str, brute(rows)))


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
