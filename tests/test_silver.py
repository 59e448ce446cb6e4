"""D. Versions, scope, panel and month-end series on the literal scenarios."""

from pyspark.sql import functions as F

from panelwright.operators import silver

OLD, NEW = "2026-02-11T08:15:30", "2026-08-04T21:05:10"
PRODUCT = "Financiamentos imobiliários"
COLUMNS = "date string, uf string, product string, n string, v string, _source_object string"
CONTRACT = silver.PanelContract(
    "uf", "product", "date", "n", "v", ("SP", "RJ", "AP"), "Financiamentos", "2016-07-01", "2026-06-01", "2026-09-30"
)


def build(spark, rows):
    return silver.build_silver_panel(spark.createDataFrame(rows, COLUMNS), CONTRACT, "L", "sys", "2026-09-30 00:00:00")


def row(v, n, date="2024-01-31", uf="SP", product=PRODUCT, version=NEW, name="202401.csv"):
    return (date, uf, product, n, v, f"{name}@{version}")


def test_masked_counts_and_values(spark):
    out = build(spark, [row("100,00", "10"), row("50,00", "-1"), row("25,00", "5")]).table.first()
    assert (out["qty_disclosed"], out["masked_rows"], out["value"]) == (15, 1, 175.0)
    masked = build(spark, [row("1,00", "-1"), row("2,00", "-1")]).table.first()
    assert (masked["qty_disclosed"], masked["masked_rows"]) == (0, 2)


def test_only_the_newest_version_counts(spark):
    rows = [row("1,00", "1", version=OLD), row("2,00", "2", version=OLD), row("7,00", "3")]
    built = build(spark, rows)
    assert built.table.first()["value"] == 7.0
    assert built.report.first()["superseded_version"] == 2


def test_crc_version_is_newer_than_the_plain_one(spark):
    names = [f"a.csv@{NEW}", f"a.csv@{NEW}#crc0000abcd", f"a.csv@{OLD}"]
    df = spark.createDataFrame([(n,) for n in names], "_source_object string")
    assert silver.current_versions(df).first()["_source_object"] == names[1]


def test_funnel_and_reasons(spark):
    rows = [
        row("1,00", "1"),
        row("1,00", "1", product="Empréstimos"),
        row("1,00", "1", date="2016-06-30"),
        row("1,00", "1", date="2026-07-31"),
        row("1,00", "1", uf="XX"),
        row("abc", "1"),
        row("-3,00", "1"),
        row("abc", "1", date="2016-06-30"),
        row("1,00", "1", date="nonsense"),
    ]
    built = build(spark, rows)
    report = built.report.first().asDict()
    assert report == {
        "read": 9,
        "superseded_version": 0,
        "product_out_of_scope": 1,
        "month_out_of_scope": 3,
        "quarantined": 4,
        "aggregated": 1,
    }
    reasons = {r["reason"]: r["count"] for r in built.quarantine.groupBy("reason").count().collect()}
    assert reasons == {"bad_entity": 1, "bad_type": 2, "negative_value": 1}


def test_money_is_summed_exactly(spark):
    rows = [row("0,001", "1")] * 10 + [row("1e-3", "1"), row("123456789012345678,25", "1"), row("-0", "0")]
    out = build(spark, rows).table.first()
    assert out["value"] == float("123456789012345678.261") and out["qty_disclosed"] == 12
    rows = [row("999999999999999999,99", "1")] * 40
    assert build(spark, rows).table.first()["value"] == float("39999999999999999999.6")


def test_numbers_too_large_are_quarantined(spark):
    rows = [row("1e30", "1"), row("1,00", "1" + "0" * 24), row("1e400", "1"), row("x", "1" + "0" * 24), row("2,00", "7")]
    built = build(spark, rows)
    assert built.table.first()["value"] == 2.0
    reasons = {r["reason"]: r["count"] for r in built.quarantine.groupBy("reason").count().collect()}
    assert reasons == {"number_too_large": 2, "bad_type": 2}


def test_bronze_is_read_once(spark, tmp_path):
    spark.createDataFrame([row("1,00", "1"), row("x", "1")], COLUMNS).write.parquet(str(tmp_path / "bronze"))
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    whole = silver.staged_rows(bronze, CONTRACT)._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in whole.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("ReadSchema: struct<_source_object:string>" in s for s in scans) == 1  # the other is of one column
    built = silver.build_silver_panel(bronze, CONTRACT, "L", "sys", "2026-09-30 00:00:00", str(tmp_path / "staged"))
    for part in (built.table, built.quarantine, built.report):
        plan = part._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("FileScan") == 1 and str(tmp_path / "bronze") not in plan
    assert (built.report.first()["read"], built.table.count(), built.quarantine.count()) == (2, 1, 1)


def test_incomplete_keys_and_months(spark):
    assert silver.months_in_scope("2016-07-01", "2026-06-01") == 120
    df = spark.createDataFrame([("SP", 1), ("SP", 2), ("RJ", 1)], "entity string, m int")
    assert [tuple(r) for r in silver.incomplete_keys(df, ["entity"], 2).collect()] == [("RJ", 1)]


SERIES = "date_text string, value_text string, _source_object string, _ingestion_timestamp timestamp"


def series(spark, readings, as_of="2026-09-30", start="2016-07-01", end="2026-06-01"):
    rows = [(f"{d}T00:00:00-03:00" if d else d, v, s, at) for d, v, s, at in readings]
    raw = spark.createDataFrame(rows, "d string, v string, s string, at string")
    df = raw.select(
        F.col("d").alias("date_text"),
        F.col("v").alias("value_text"),
        F.col("s").alias("_source_object"),
        F.col("at").cast("timestamp").alias("_ingestion_timestamp"),
    )
    return silver.build_silver_series(df, "S", start, end, as_of, "L", "sys", "2026-09-30 00:00:00")


T1, T2 = "2026-05-01 00:00:00", "2026-05-02 00:00:00"


def rates(built):
    return {str(r["month"]): r["rate"] for r in built.table.collect()}


def test_last_valid_day_of_the_month(spark):
    built = series(spark, [("2026-03-18", "15.0", "S", T1), ("2026-03-19", "14.75", "S", T1), ("2026-03-31", "14.75", "S", T1)])
    assert rates(built) == {"2026-03-01": 14.75}


def test_reread_day_uses_the_newest(spark):
    built = series(spark, [("2026-03-31", "15.0", "S", T1), ("2026-03-31", "14.5", "S", T2)])
    assert rates(built) == {"2026-03-01": 14.5}
    report = {r["metric"]: r["n"] for r in built.report.collect()}
    assert report["older_readings"] == 1


def test_open_month_is_left_out(spark):
    built = series(spark, [("2026-04-30", "14.0", "S", T1), ("2026-05-10", "13.0", "S", T1)], as_of="2026-05-20")
    assert rates(built) == {"2026-04-01": 14.0}
    assert {r["metric"]: r["n"] for r in built.report.collect()}["month_not_closed"] == 1


def test_null_last_day_falls_back(spark):
    built = series(spark, [("2026-03-30", "14.5", "S", T1), ("2026-03-31", None, "S", T1)])
    assert rates(built) == {"2026-03-01": 14.5}
    assert [r["reason"] for r in built.quarantine.collect()] == ["bad_type"]


def test_ambiguous_day_is_quarantined_twice(spark):
    built = series(
        spark, [("2026-03-30", "14.5", "S", T1), ("2026-03-31", "14.0", "S", T1), ("2026-03-31", "13.0", "S", T1)]
    )
    assert rates(built) == {"2026-03-01": 14.5}
    assert [r["reason"] for r in built.quarantine.collect()] == ["duplicate_key"] * 2


def test_missing_next_to_present_is_not_ambiguous(spark):
    built = series(spark, [("2026-03-31", None, "S", T1), ("2026-03-31", "13.0", "S", T1)])
    assert rates(built) == {"2026-03-01": 13.0}


def test_other_series_and_bad_days(spark):
    built = series(
        spark,
        [("2026-03-31", "14.0", "S", T1), ("2026-03-31", "99", "X", T2), ("2026-02-31", "1", "S", T1), ("2026-02-27", "-1", "S", T1)],
    )
    assert rates(built) == {"2026-03-01": 14.0}
    assert sorted(r["reason"] for r in built.quarantine.collect()) == ["bad_type", "negative_value"]
    assert {r["metric"]: r["n"] for r in built.report.collect()}["other_series"] == 1
