"""G. Labels, leakage, cohort and splits."""

import datetime as dt
import random

from pyspark.sql import functions as F

from panelwright.operators import features as ft

KEYS = ["entity", "product"]
MONTHS = [dt.date(2016 + (6 + i) // 12, (6 + i) % 12 + 1, 1) for i in range(48)]
RULES = ft.SplitRules(train_end="2018-08-01", test_start="2019-02-01", n_months=48)


def gold(spark, bump_after=None):
    rng = random.Random(1)
    rows = []
    for entity, product, gap in (("SP", "A", 0), ("RJ", "A", 0), ("SP", "B", 0), ("AP", "B", 5)):
        value = 100.0
        for i, m in enumerate(MONTHS):
            value *= 1 + rng.uniform(-0.05, 0.08)
            if gap and i % gap == 0:
                continue
            shown = value * 3 if bump_after and m > bump_after else value
            rows.append((m, entity, product, shown, 10.0 + (i % 7) + (50 if bump_after and m > bump_after else 0)))
    return spark.createDataFrame(rows, "month date, entity string, product string, value double, rate double")


def test_label_cases(spark):
    # growth t-3..t, then growth t+2..t+5
    def frame(before, after):
        values = [100, 100, 100, before, before, 100, 100, 100, after]
        rows = [(MONTHS[i], "SP", "A", float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "month date, entity string, product string, value double")

    def label_at_3(df):
        return df.select("month", ft.label(F.col("value"), KEYS, "month").alias("y")).filter(F.col("month") == MONTHS[3]).first()["y"]

    assert label_at_3(frame(102, 104)) == 1
    assert label_at_3(frame(106, 102)) == 0
    last = frame(102, 104).select("month", ft.label(F.col("value"), KEYS, "month").alias("y"))
    assert last.filter(F.col("month") == MONTHS[4]).first()["y"] is None


def test_cohort_features_and_splits(spark):
    base = gold(spark)
    assert ft.cohort(base, KEYS, 48).count() == 3
    assert [tuple(r)[:2] for r in ft.excluded_keys(base, KEYS, 48).collect()] == [("AP", "B")]
    data = ft.build_dataset(base, RULES)
    assert data.groupBy("entity", "product", "origin").count().filter("count > 1").count() == 0
    spans = {
        r["split"]: (str(r["a"]), str(r["b"]), r["n"])
        for r in data.groupBy("split").agg(F.min("origin").alias("a"), F.max("origin").alias("b"), F.count("*").alias("n")).collect()
    }
    assert spans["development"] == ("2017-07-01", "2018-08-01", 42)
    assert spans["embargo"] == ("2018-09-01", "2019-01-01", 15)
    assert spans["test"] == ("2019-02-01", "2020-01-01", 36)
    assert spans["production"] == ("2020-06-01", "2020-06-01", 3)


def test_future_never_reaches_the_features(spark):
    cut = dt.date(2018, 6, 1)
    columns = [*KEYS, "origin", *ft.NUMERIC_FEATURES]
    before = ft.features(gold(spark), RULES).filter(F.col("origin") <= cut).select(*columns)
    after = ft.features(gold(spark, bump_after=cut), RULES).filter(F.col("origin") <= cut).select(*columns)
    assert before.count() > 0
    assert before.exceptAll(after).count() == 0


def test_market_uses_all_keys(spark):
    base = gold(spark)
    row = ft.features(base, RULES).filter("entity = 'SP' AND product = 'B'").orderBy("origin").first()
    total = base.filter(F.col("product") == "B").filter(F.col("month") == row["origin"]).agg(
        F.sum(F.col("value").cast("decimal(30,2)")).cast("double")
    ).first()[0]
    assert abs(row["share"] - row["value_origin"] / total) < 1e-12


def test_one_exchange_on_the_keys(spark):
    plan = ft.features(gold(spark), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(entity") == 1


def test_pivot_round_trip(spark):
    base = gold(spark).filter("product = 'A'")
    wide = ft.to_wide(base, "month", "entity", ["SP", "RJ"], "value")
    assert wide.columns == ["month", "SP", "RJ"]
    assert ft.to_long(wide, "month", "entity", "value").count() == base.count()
