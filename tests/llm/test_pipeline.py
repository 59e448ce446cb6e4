import os
from collections import Counter

import pytest
from conftest import messy

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@needs_data
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [n for n, _ in corpus_pipeline.STAGES], [docs.count()]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]


@needs_data
def test_stages_on_odd_rows(spark, texts):
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in texts]
    whole = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, whole, SF).count() > 0
        assert stage(spark, whole.limit(0), SF).count() == 0
    ids = {i for i, *_ in texts}
    exact = Counter((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, whole, SF).collect())
    # Of copies the largest id stays, once; the only row with the text "no id here ..." stays though it has no id.
    largest = {}
    for i, text, *_ in rows:
        largest[text or ""] = max(largest.get(text or "", (False, 0)), (i is not None, i or 0))
    assert sum(exact.values()) == len(largest)
    assert {(t or "", (i is not None, i or 0)) for i, t in exact} == set(largest.items())
    near = {r.doc_id for r in corpus_pipeline.near_copies(spark, whole, SF).collect()}
    assert near == ids - {40, 41, 42, 43}


def odd_ids():
    """(id, text): NULL and repeated ids, with copies and without."""
    import random

    draw = random.Random(5)
    prose = [" ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(90)) for _ in range(6)]
    same = [(None, prose[0]), (None, prose[0]), (7, prose[0]), (7, prose[0]), (None, prose[1]), (7, prose[2]), (None, prose[3]), (None, prose[3])]
    near = [(None, prose[4] + " x"), (None, prose[4] + " y"), (9, prose[5]), (9, prose[5] + " z")]
    return prose, [*same, *near, (None, "short"), (7, "short too"), (None, None), (None, None)]


@needs_data
def test_decisions_go_by_row(spark):
    from collections import Counter

    prose, rows = odd_ids()
    whole = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)

    def left(stage):
        return Counter((r.doc_id, r.text) for r in stage(spark, whole, SF).collect())

    assert left(corpus_pipeline.exact_copies) == Counter(
        [(7, prose[0]), (None, prose[1]), (7, prose[2]), (None, prose[3]), *rows[8:14], (None, None)]
    )
    near = left(corpus_pipeline.near_copies)
    assert sum(near.values()) == 10 and {(7, prose[0]), (None, prose[1]), (7, prose[2]), (None, prose[3])} < set(near)
    assert sum((near[x] for x in rows[8:10])) == 1 and sum((near[x] for x in rows[10:12])) == 1 and near[(None, None)] == 2
    no_marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    corpus_pipeline_table, corpus_pipeline.table = corpus_pipeline.table, lambda *_: no_marks
    try:
        assert left(corpus_pipeline.quality) == Counter(rows[:12])
    finally:
        corpus_pipeline.table = corpus_pipeline_table


@needs_data
def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "piece"]


def test_messy_tables_are_wide(spark):
    assert "row" in messy(spark, [(1,)], "doc_id long").columns
