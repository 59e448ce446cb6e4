"""E. Calendar algebra and the gold join."""

import datetime as dt

from pyspark.sql import functions as F

from panelwright.operators import calendar, panel


def month(text):
    return dt.date.fromisoformat(f"{text}-01")


def panel_frame(spark, rows):
    return spark.createDataFrame(
        [(month(m), e, "P", q, 0, float(v)) for m, e, v, q in rows],
        "month date, entity string, product string, qty_disclosed bigint, masked_rows bigint, value double",
    )


def series_frame(spark, rows):
    return spark.createDataFrame([(month(m), float(v)) for m, v in rows], "month date, rate double")


def test_densify_and_lags(spark):
    series = series_frame(spark, [("2016-07", 14), ("2016-08", 13), ("2016-10", 12)])
    dense = {str(r["month"]): r["rate"] for r in calendar.densify(series).collect()}
    assert dense == {"2016-07-01": 14.0, "2016-08-01": 13.0, "2016-09-01": None, "2016-10-01": 12.0}
    lags = {str(r["month"]): r for r in calendar.series_lags(series, max_lag=3).collect()}
    assert sorted(lags) == ["2016-07-01", "2016-08-01", "2016-10-01"]
    assert lags["2016-08-01"]["rate_change"] == -1.0
    assert lags["2016-10-01"]["rate_change"] is None
    assert (lags["2016-10-01"]["rate_lag_1"], lags["2016-10-01"]["rate_lag_2"], lags["2016-10-01"]["rate_lag_3"]) == (None, 13.0, 14.0)


def test_gap_is_not_compared(spark):
    rows = [("2016-09", "SP", 100, 10), ("2016-10", "SP", 110, 5), ("2017-02", "SP", 200, 5), ("2016-10", "RJ", 1, 1)]
    out = {(r["entity"], str(r["month"])): r for r in panel.consecutive_changes(panel_frame(spark, rows), ["entity", "product"]).collect()}
    assert round(out["SP", "2016-10-01"]["value_change_pct"], 9) == 10.0
    assert round(out["SP", "2016-10-01"]["qty_change_pct"], 9) == -50.0
    assert out["SP", "2017-02-01"]["has_prev"] is False
    assert out["SP", "2017-02-01"]["value_change_pct"] is None
    assert out["RJ", "2016-10-01"]["has_prev"] is False


def test_zero_base_gives_null(spark):
    rows = [("2016-09", "SP", 0, 0), ("2016-10", "SP", 5, 5)]
    out = panel.consecutive_changes(panel_frame(spark, rows), ["entity"]).filter("month = '2016-10-01'").first()
    assert out["has_prev"] and out["qty_change_pct"] is None and out["value_change_pct"] is None


def test_orphans_join_and_report(spark):
    left = panel_frame(spark, [("2016-07", "SP", 1, 1), ("2016-08", "SP", 2, 1), ("2016-09", "SP", 3, 1)])
    right = series_frame(spark, [("2016-08", 14), ("2016-09", 13), ("2016-12", 10)])
    orphans = {(str(r["month"]), r["side"]) for r in panel.orphan_months(left, right).collect()}
    assert orphans == {("2016-07-01", "panel_only"), ("2016-12-01", "series_only")}
    gold = panel.build_gold(left, right)
    assert gold.count() == 2
    # the change of August looks at July, although July has no rate
    assert gold.filter("month = '2016-08-01'").first()["value_change_pct"] == 100.0
    report = {r["metric"]: r["n"] for r in panel.gold_report(gold, left, right).collect()}
    assert report == {
        "gold_rows": 2, "gold_months": 2, "rows_without_prev": 0, "rows_without_qty_change": 0,
        "panel_rows": 3, "panel_only_months": 1, "series_only_months": 1,
    }
    assert panel.duplicate_keys(gold, ["month", "entity", "product"]).count() == 0
    assert gold.exceptAll(panel.build_gold(left, right)).count() == 0


def test_calendar_lag_on_a_sparse_key(spark):
    rows = [("2016-07", "SP", 1, 1), ("2016-09", "SP", 3, 1), ("2016-10", "SP", 4, 1)]
    lag = calendar.calendar_lag(F.col("value"), 1, ["entity"])
    got = [r[0] for r in panel_frame(spark, rows).select(lag, "month").orderBy("month").collect()]
    assert got == [None, None, 3.0]


def test_gold_plan_shuffles_the_panel_once(spark):
    rows = panel_frame(spark, [("2016-07", "SP", 1, 1)])
    plan = panel.build_gold(rows, series_frame(spark, [("2016-07", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.count("hashpartitioning(entity") == 1
