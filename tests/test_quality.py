"""C. Checks, reasons and quarantine."""

import json

from pyspark.sql import functions as F

from panelwright.functions.parsing import day_key, to_day, to_integer, to_number
from panelwright.operators import quality as q

UFS = ["SP", "RJ", "AP"]


def values(spark, rows, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.select(column, "i").orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "0": 0.0, "+7": 7.0, "-0.25": -0.25, ".5": 0.5, "5.": 5.0, "\t42 ": 42.0, "2E-2": 0.02, "-6e+1": -60.0, "0" * 400 + "8": 8.0,
        " " * 500 + "3": 3.0, "0." + "0" * 310 + "1": 1e-311,
    }
    refused = ["-", "1 2", "0x1F", "3f", "Infinity", "-NaN", "7e", "e5", "9e400", "9" * 310, "1_000", "   ", None]
    texts = [*cases, *refused]
    assert values(spark, texts, to_number(F.col("t"))) == [*cases.values(), *[None] * len(refused)]


def test_comma_numbers(spark):
    cases = {"0,5": 0.5, ",75": 0.75, "-12,": -12.0, "8": 8.0, "1,5e2": 150.0, "0,1,2": None, "7.000,5": None, ",": None}
    assert values(spark, list(cases), to_number(F.col("t"), ",")) == list(cases.values())


def test_integers_and_types(spark):
    texts = ["10", "10.0", " 7 ", "-1", "abc", "", None]
    assert values(spark, texts, to_integer(F.col("t"))) == [10, None, 7, -1, None, None, None]
    assert values(spark, texts, q.bad_type(F.col("t"), "int")) == [False, True, False, False, True, True, True]
    assert values(spark, ["1,5", "x"], q.bad_type(F.col("t"), "float", ",")) == [False, True]


def test_dates(spark):
    cases = {
        "2020-02-29": "2020-02-29", "2021-02-29": None, "2019-11-31": None, "1999-12": "1999-12-01", "2022-7-4": "2022-07-04", "2022-00-10": None,
        "2022-10-00": None, "22-10-01": None, "2022/10/01": None, "20221001": None, "2022-10-01 ": None, "2022-10-01T05:00": None,
    }
    got = [str(v) if v else None for v in values(spark, list(cases), to_day(F.col("t")))]
    assert got == list(cases.values())
    assert values(spark, list(cases), q.bad_type(F.col("t"), "date")) == [v is None for v in got]
    assert values(spark, ["2021-05-06T10:20:30+02:00", None], day_key(F.col("t"))) == ["2021-05-06", ""]


def test_domain_sign_and_interval(spark):
    assert values(spark, ["SP", "sp", "XX", None], q.outside_domain(F.col("t"), UFS)) == [False, True, True, True]
    number = to_number(F.col("t"))
    assert values(spark, ["-1", "-5", "3", "abc"], q.negative(number, -1)) == [False, True, False, False]
    assert values(spark, ["-1"], q.negative(number)) == [True]
    day = to_day(F.col("t"))
    days = ["2016-06-30", "2016-07-01", "2026-01-02", "x"]
    assert values(spark, days, q.in_future(day, "2026-01-01")) == [False, False, True, False]
    assert values(spark, days, q.outside_interval(day, "2016-07-01", "2026-01-01")) == [True, False, True, True]


def test_first_reason_wins_and_quarantine(spark):
    rows = [
        ("2024-01-31", "XX", "abc", "10"),
        ("2024-01-31", "SP", "abc", "10"),
        ("2024-01-31", "SP", "-3,00", "10"),
        ("2024-01-31", "SP", "1,00", "-5"),
        ("2024-01-31", "SP", "1,00", "-1"),
        ("2030-01-31", "SP", "-1,00", "1"),
    ]
    df = spark.createDataFrame(rows, "d string, uf string, v string, n string")
    typed = df.withColumns(q.typed_columns("d", "n", "v"))
    valid, rejected = q.split_valid(q.classify(typed, q.panel_rules("uf", UFS, "2026-01-01")))
    rejected = rejected.select(*df.columns, "reason")
    assert valid.count() == 1
    counts = {r["reason"]: r["rows"] for r in q.reason_counts(q.classify(typed, q.panel_rules("uf", UFS, "2026-01-01"))).collect()}
    assert counts == {"bad_entity": 1, "bad_type": 1, "negative_value": 2, "date_out_of_range": 1}
    table = q.quarantine_table(rejected, "L1", "sys", None, "2026-01-01 00:00:00").collect()
    assert {json.loads(r["payload"])["uf"] for r in table} == {"XX", "SP"}
    assert all(r["_source_object"] == "" for r in table)


def test_null_stays_in_payload(spark):
    df = spark.createDataFrame([("a", None, "x")], "a string, b string, reason string")
    payload = q.quarantine_table(df, "L", "s", "a", "2026-01-01 00:00:00").first()["payload"]
    assert json.loads(payload) == {"a": "a", "b": None}


def test_quarantine_is_replaced_appended_and_never_fails(spark, tmp_path):
    table = spark.createDataFrame([("a",)], "reason string")
    path = str(tmp_path / "q")
    assert q.store_quarantine(table, path) and q.store_quarantine(table, path)
    assert spark.read.parquet(path).count() == 1
    assert q.store_quarantine(table, path, append=True)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "file").write_text("x")
    assert not q.store_quarantine(table, str(tmp_path / "file" / "q"))
