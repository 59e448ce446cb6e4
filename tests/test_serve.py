"""J. Publishing as one unit and the reads behind the page."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.functions import labels as lb
from panelwright.functions.reference_data import ENTITIES, GENERAL_LABEL, PRODUCT_PREFIX, entity_dimension
from panelwright.operators import publish, serve
from panelwright.session import create_file


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "published")
    first = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "k string, v double")
    other = spark.createDataFrame([(1,)], "n int")
    assert publish.publish({"t": first, "u": other}, root, "L1", "2026-01-01 00:00:00")
    rows = {r["k"]: r["v"] for r in publish.read_published(spark, root, "t").collect()}
    assert rows == {"a": 1.0, "b": None}
    assert publish.publications(spark, root).first()["rows"] == '{"t":2,"u":1}'

    failing = other.select(F.raise_error(F.lit("boom")).cast("int").alias("n"))
    with pytest.raises(Exception, match="boom"):
        publish.publish({"t": first.limit(1), "u": failing}, root, "L2", "2026-01-02 00:00:00")
    assert publish.read_published(spark, root, "t").count() == 2

    with pytest.raises(publish.PublicationRefused, match="has been published"):
        publish.publish({"t": first.limit(0), "u": other}, root, "L1", "2026-01-02 00:00:00")
    assert publish.read_published(spark, root, "t").count() == 2

    assert publish.publish({"t": first.limit(1), "u": other}, root, "L3", "2026-01-03 00:00:00")
    assert publish.read_published(spark, root, "t").count() == 1
    assert serve.last_publication(publish.publications(spark, root)).first()["published"] == "02/01/2026 21:00"


def test_of_two_publications_at_once_one_counts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "published")
    table = spark.range(3)
    assert publish.publish({"t": table}, root, "L1", "2026-01-01 00:00:00")
    create = publish.create_file

    def slower(*args):
        monkeypatch.setattr(publish, "create_file", create)
        assert publish.publish({"t": table.limit(1)}, root, "L2", "2026-01-02 00:00:00")
        return create(*args)

    monkeypatch.setattr(publish, "create_file", slower)
    with pytest.raises(publish.PublicationRefused, match="came before"):
        publish.publish({"t": table.limit(2)}, root, "L3", "2026-01-03 00:00:00")
    assert publish.read_published(spark, root, "t").count() == 1
    assert [r["load_id"] for r in publish.publications(spark, root).orderBy("number").collect()] == ["L1", "L2"]
    assert len(publish.drop_unpublished(spark, root, keep=1)) == 2
    assert publish.read_published(spark, root, "t").count() == 1
    assert not create_file(spark, f"{root}/_publications/000000000002.json", "{}")


def test_publish_is_skipped_without_target_or_table(spark, tmp_path):
    t = spark.createDataFrame([(1,)], "n int")
    assert not publish.publish({"t": t}, None, "L", "2026-01-01 00:00:00")
    assert not publish.publish({"t": t, "u": None}, str(tmp_path / "x"), "L", "2026-01-01 00:00:00")
    assert not publish.publish({"t": t}, str(tmp_path / "x"), "L", "2026-01-01 00:00:00", required=("t", "u"))
    assert not (tmp_path / "x").exists()


def test_column_types(spark):
    df = spark.createDataFrame([], "a boolean, b bigint, c double, d date, e string, f array<string>, g timestamp")
    assert list(publish.table_types(df).values()) == ["boolean", "bigint", "double precision", "date", "text", "jsonb", "date"]


def texts(spark, values, column, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(column, "i").orderBy("i").collect()]


def test_formats(spark):
    v = F.col("v")
    assert texts(spark, [0.419, 1234.5, None], lb.number_text(v)) == ["0,42", "1.234,50", "—"]
    assert texts(spark, [0.825, None], lb.percent_text(v)) == ["82,5%", "—"]
    assert texts(spark, [0.42, -0.15, -0.001, None], lb.signed_text(v)) == ["+0,42", "−0,15", "0,00", "—"]
    money = [1.27e12, 557.5e9, 3.25e6, 236e3, 0.0, None]
    assert texts(spark, money, lb.currency_text(v)) == ["R$ 1,27 tri", "R$ 557,5 bi", "R$ 3,2 mi", "R$ 236 mil", "R$ 0", "—"]
    assert texts(spark, [dt.date(2026, 6, 1)], lb.month_label(v), "date") == ["jun/2026"]
    assert texts(spark, [dt.date(2026, 11, 1)], lb.quarter_label(v), "date") == ["fev–abr/2027"]


def test_labels_and_dimensions(spark):
    names = ["Financiamentos imobiliários", "Financiamentos ", "Financiamentos rurais  (ex-rurais)"]
    got = texts(spark, names, lb.product_label(F.col("v"), PRODUCT_PREFIX, GENERAL_LABEL), "string")
    assert got == ["Imobiliários", "Financiamentos (geral)", "Rurais"]
    df = spark.createDataFrame([(n,) for n in names + ["Financiamentos à exportação", "Empréstimos (x)"]], "product string")
    dim = [(r["product_key"], r["name"], r["position"]) for r in serve.ordered_products(df).collect()]
    assert dim == [
        ("imobiliario", "Imobiliário", 1),
        ("rural", "Rural", 2),
        ("geral", "Financiamentos (geral)", 3),
        ("exportacao", "Exportação", 4),
        ("emprestimos (x)", "Empréstimos", 9),
    ]
    assert entity_dimension(spark).count() == 27
    assert len({(c, r) for _, _, c, r in ENTITIES}) == 27
    named = serve.with_entity_names(spark.createDataFrame([("SP",), ("ZZ",)], "entity string")).collect()
    assert {r["entity"]: r["entity_name"] for r in named} == {"SP": "São Paulo", "ZZ": "ZZ"}


M = [dt.date(2026, m, 1) for m in range(1, 6)]


def test_series_reads(spark):
    gold = spark.createDataFrame(
        [(M[i], "SP", PRODUCT_PREFIX, float(i), None if i == 0 else float(10 * i), 5 * i, [14.0, 15.0, 15.0, 13.0, 13.0][i]) for i in range(5)],
        "month date, entity string, product string, value double, value_change_pct double, qty_disclosed bigint, rate double",
    )
    rows = serve.key_series(spark, gold, "SP", PRODUCT_PREFIX).collect()
    assert [r["month"] for r in rows] == ["2026-01", "2026-02", "2026-03", "2026-04", "2026-05"]
    for bad in (("XX", PRODUCT_PREFIX), ("SP", "'; DROP TABLE x")):
        with pytest.raises(ValueError):
            serve.key_series(spark, gold, *bad)
    changes = gold.withColumn("rate_change", F.when(F.col("month") == str(M[1]), 1.0).when(F.col("month") == str(M[3]), -2.0).otherwise(0.0))
    points = serve.change_points(changes).first()
    assert (points["months_with_change"], points["month_of_max"], points["month_of_min"]) == (2, M[1], M[3])
    limit = serve.axis_limit(gold, ["entity"]).first()["limit"]
    assert limit == 40.0  # index floor(0.98 * 4) = 3 of 10, 20, 30, 40
    aligned = serve.align(gold.filter("value < 2").select("month", "value"), gold)
    assert aligned.filter("value IS NULL").count() == 3


def test_key_status(spark):
    scores = spark.createDataFrame([("SP", "A", 0.9), ("RJ", "A", 0.1)], "entity string, product string, score double")
    level2 = spark.createDataFrame([("SP", "A", False, 0.5), ("RJ", "A", True, None), ("AP", "A", False, 0.1)], "entity string, product string, insufficient boolean, spearman double")
    lists = spark.createDataFrame([("expand", 1, "SP", "A"), ("alert", 2, "SP", "A"), ("alert", 1, "RJ", "A")], "group string, position int, entity string, product string")
    got = {r["entity"]: (r["score"], r["status"], r["without_correlation"]) for r in serve.key_status(scores, level2, lists).collect()}
    assert got == {
        "SP": (0.9, "list expand #1", False),
        "RJ": (0.1, "list alert #1", True),
        "AP": (None, "outside the lists", False),
    }
