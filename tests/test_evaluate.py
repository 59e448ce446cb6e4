"""H5–H11 and I on brute force and literal scenarios."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import decide, evaluate


def brute_auc(rows):
    top = bottom = 0.0
    for y1, s1, w1 in rows:
        for y0, s0, w0 in rows:
            if y1 == 1 and y0 == 0:
                bottom += w1 * w0
                top += w1 * w0 * (1.0 if s1 > s0 else 0.5 if s1 == s0 else 0.0)
    return top / bottom if bottom else None


def test_auc_with_ties_weights_and_groups(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 1), rng.choice([0.1, 0.5, 0.5, rng.random()]), rng.randint(1, 9)) for _ in range(300)]
    rows += [("flat", y, 0.5, 1) for y in (0, 1, 1)] + [("single", 1, 0.3, 1), ("single", 1, 0.4, 1)]
    df = spark.createDataFrame(rows, "g string, y int, s double, w int")
    plain = {r["g"]: r["auc"] for r in evaluate.auc(df, "y", "s", ["g"]).collect()}
    heavy = {r["g"]: r["auc"] for r in evaluate.auc(df, "y", "s", ["g"], "w").collect()}
    a = [(y, s, w) for g, y, s, w in rows if g == "a"]
    assert plain["a"] == pytest.approx(brute_auc([(y, s, 1.0) for y, s, _ in a]))
    assert heavy["a"] == pytest.approx(brute_auc(a))
    assert plain["flat"] == 0.5 and plain["single"] is None
    assert evaluate.auc(df.filter("g = 'a'"), "y", "s").first()["auc"] == pytest.approx(plain["a"])


def test_confusion_and_alerts(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    r = evaluate.confusion(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["accuracy"], r["rows"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.6, 5)
    none = evaluate.confusion(df.filter("p = 0"), "y", "p").first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    table = spark.createDataFrame([("auc", 0.97), ("recall", 0.5), ("rows", 100.0)], "metric string, value double")
    assert [r["metric"] for r in evaluate.alerts(table).collect()] == ["auc"]


def test_precision_at_n_ties_follow_the_key(spark):
    rows = [("m1", "A", 0.9, 1), ("m1", "B", 0.5, 0), ("m1", "C", 0.5, 1), ("m2", "A", 0.1, 0), ("m2", "B", 0.2, 1)]
    df = spark.createDataFrame(rows, "origin string, entity string, score double, gains int")
    out = {r["list_size"]: r["precision"] for r in evaluate.precision_at_n(df, "gains", "score", [1, 2], "origin", ["entity"]).collect()}
    assert out == {1: 1.0, 2: 0.5}


def test_baselines(spark):
    train = spark.createDataFrame([(1,), (1,), (0,)], "gains int")
    rows = spark.createDataFrame([(1, -2.0), (0, 3.0)], "gains int, acceleration_3m double")
    out = sorted((r["candidate"], r["gains"], r["score"], r["predicted"]) for r in evaluate.baseline_scores(train, rows).collect())
    assert out == [("majority_class", 0, 0.5, 1), ("majority_class", 1, 0.5, 1), ("mean_reversion", 0, -3.0, 0), ("mean_reversion", 1, 2.0, 1)]


T0 = dt.date(2026, 6, 1)


def scores(spark, n=40):
    rows = [(f"U{i:02d}", "P", T0, round(0.99 - i / 100, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "entity string, product string, origin date, score double")


def test_recommendation_lists(spark):
    panel = spark.createDataFrame(
        [("U00", "P", T0, 5.0), ("U00", "P", dt.date(2026, 5, 1), 9.0), ("U39", "P", T0, 7.0)],
        "entity string, product string, month date, value double",
    )
    out = decide.recommendation(scores(spark), panel).collect()
    expand = sorted((r["position"], r["entity"]) for r in out if r["group"] == "expand")
    alert = sorted((r["position"], r["entity"]) for r in out if r["group"] == "alert")
    assert expand[0] == (1, "U00") and expand[-1] == (20, "U19")
    assert alert[0] == (1, "U39") and alert[-1] == (20, "U20")
    values = {r["entity"]: r["value"] for r in out}
    assert values["U00"] == 5.0 and values["U39"] == 7.0 and values["U05"] is None


def test_tied_scores_are_ordered_by_key(spark):
    tied = scores(spark, 6).withColumn("score", F.lit(0.5))
    empty = spark.createDataFrame([], "entity string, product string, month date, value double")
    out = decide.recommendation(tied, empty, top=3)
    assert [r["entity"] for r in out.filter("group = 'alert'").orderBy("position").collect()] == ["U00", "U01", "U02"]


def test_sensitivity_and_closing_numbers(spark):
    # 30 rows of one month; 13 of the 20 best scores gain, 5 of the 20 best simple scores gain
    rows = [("U%02d" % i, "P", "2025-02", 0.95 - i * 0.02, 1 if i < 13 else 0, -float(i) if i >= 10 else -100.0 - i) for i in range(30)]
    df = spark.createDataFrame(rows, "entity string, product string, origin string, score double, gains int, simple_score double")
    table = decide.sensitivity(df)
    twenty = table.filter("rule = 'top of the month' AND parameter = 20").first()
    assert twenty["precision_model"] == pytest.approx(0.65)
    assert twenty["precision_simple"] == pytest.approx(3 / 20)
    assert twenty["recall_model"] is None
    half = table.filter("parameter = 0.5").first()
    taken = [r for r in rows if r[3] >= 0.5]
    assert half["per_month"] == len(taken)
    assert half["precision_model"] == pytest.approx(sum(r[4] for r in taken) / len(taken))
    assert half["recall_model"] == pytest.approx(1.0) and half["precision_simple"] is None
    level1 = spark.createDataFrame(
        [("A", 0, 0.9, 0.2, False), ("A", 4, -0.4, 0.01, True)],
        "product string, lag int, spearman double, p_adjusted double, significant boolean",
    )
    empty = spark.createDataFrame([], "entity string, product string, month date, value double")
    listed = decide.recommendation(scores(spark), empty)
    closing = decide.closing_numbers(listed, table, df, level1).first()
    assert closing["expected_hits"] == pytest.approx(13) and closing["expected_misses"] == pytest.approx(7)
    assert (closing["strongest_product"], closing["strongest_lag"]) == ("A", 4)
    assert closing["top3"] == "U00|P;U01|P;U02|P"
    without = decide.strongest_significant(level1.withColumn("significant", F.lit(False))).first()
    assert without["lag"] == 0


def test_no_score_above_the_threshold(spark):
    df = spark.createDataFrame([("A", "P", "m", 0.1, 1)], "entity string, product string, origin string, score double, gains int")
    row = decide.threshold_sensitivity(df).filter("parameter = 0.9").first()
    assert row["precision_model"] is None and row["recall_model"] == 0.0


def test_quarter_and_missing_inputs(spark):
    assert decide.quarter(scores(spark)).first()["quarter"] == "set–nov/2026"
    with pytest.raises(decide.MissingInput, match="gold"):
        decide.require_inputs({"gold": None, "scores": scores(spark)})
