"""H. Pipelines, selection and importance on a dataset with a planted signal."""

import datetime as dt
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelwright.operators import model
from panelwright.operators.features import NUMERIC_FEATURES

ROUNDS = 3


@pytest.fixture(scope="module")
def dataset(spark):
    rng = random.Random(4)
    rows = []
    origins = [dt.date(2017 + (6 + i) // 12, (6 + i) % 12 + 1, 1) for i in range(84)]
    for k in range(8):
        for i, origin in enumerate(origins):
            x = [rng.gauss(0, 1) for _ in NUMERIC_FEATURES]
            y = int(x[4] + rng.gauss(0, 0.4) < 0)
            last = i == len(origins) - 1
            if last:
                split = "production"
            elif i >= 84 - 5:
                continue
            elif origin <= dt.date(2022, 2, 1):
                split = "development"
            elif origin < dt.date(2022, 8, 1):
                split = "embargo"
            else:
                split = "test"
            rows.append((f"E{k % 4}", f"P{k // 4}", origin, *x, 10.0 * (k + 1), None if last else y, split))
    schema = "entity string, product string, origin date, " + ", ".join(f"{c} double" for c in NUMERIC_FEATURES)
    df = spark.createDataFrame(rows, schema + ", value_origin double, gains int, split string").cache()
    df.count()
    return df


FOLDS = model.yearly_folds([2020, 2021])


def test_rolling_selection_and_guard(spark, dataset):
    aucs = model.rolling_evaluation(dataset, FOLDS, ROUNDS)
    table = {(r["fold"], r["candidate"]): r["auc"] for r in aucs.collect()}
    assert len(table) == 2 * 6
    assert table["2020", "logistic"] > 0.9
    assert table["2020", "majority_class"] == 0.5
    assert model.chosen_name(model.model_choice(aucs)) == "logistic"
    assert model.has_enough(dataset)
    assert not model.has_enough(dataset.filter("split <> 'test'"))
    effect = {r["fold"]: r["rate_effect"] for r in model.rate_effect(aucs, "logistic").collect()}
    assert effect["2021"] == pytest.approx(table["2021", "logistic"] - table["2021", "logistic_without_rate"])
    sizes = {r["metric"]: r["n"] for r in model.fold_sizes(dataset, FOLDS).collect()}
    assert sizes["2020_evaluation"] == 96


def test_simple_model_wins_within_the_margin(spark):
    def choice(logistic, boosting):
        df = spark.createDataFrame([("f", "logistic", logistic), ("f", "boosting", boosting)], "fold string, candidate string, auc double")
        return model.chosen_name(model.model_choice(df))

    assert choice(0.750, 0.759) == "logistic"
    assert choice(0.750, 0.761) == "boosting"
    assert choice(0.9, 0.1) == "logistic"


def test_final_test_importance_and_coefficients(spark, dataset):
    run = model.final_test(dataset, model.LOGISTIC)
    figures = {(r["candidate"], r["metric"]): r["value"] for r in run.metrics.collect()}
    assert figures["model", "auc"] > 0.9
    assert figures["mean_reversion", "auc"] > 0.9
    assert figures["majority_class", "auc"] == 0.5
    assert figures["model", "rows"] == dataset.filter("split = 'test'").count()
    assert run.predictions.count() == dataset.filter("split = 'test'").count()
    top = model.permutation_importance(run.model, dataset.filter("split = 'test'"), repeats=2).collect()
    assert top[0]["feature"] == "acceleration_3m" and top[0]["importance"] > 0.2
    assert len(top) == 14
    assert abs(top[-1]["importance"]) < 0.05
    weights = model.coefficients(run.model).collect()
    assert weights[0]["feature"] == "acceleration_3m" and weights[0]["coefficient"] < 0
    assert len(weights) == 12 + 4 + 2
    summary = {r["metric"]: r["value"] for r in model.result_summary(dataset, run.metrics).collect()}
    assert summary["rows_production"] == 8 and summary["auc_model"] == figures["model", "auc"]


def test_test_labels_do_not_change_the_choice(spark, dataset):
    flipped = dataset.withColumn("gains", F.when(F.col("split") == "test", 1 - F.col("gains")).otherwise(F.col("gains")))
    fold = FOLDS[:1]
    a = {tuple(r) for r in model.rolling_evaluation(dataset, fold, 1).collect()}
    b = {tuple(r) for r in model.rolling_evaluation(flipped, fold, 1).collect()}
    assert a == b


def test_unseen_category_is_all_zeros(spark, dataset):
    fitted = model.fit(model.LOGISTIC, True, dataset.filter("split = 'development'"))
    odd = dataset.filter("split = 'test'").limit(1).withColumn("entity", F.lit("new"))
    assert 0 <= model.score(fitted, odd).first()["score"] <= 1


def test_production_scores_and_unknown_model(spark, dataset):
    rows = model.production_scores(dataset, model.LOGISTIC).collect()
    assert len(rows) == 8
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert rows == model.production_scores(dataset, model.LOGISTIC).collect()
    with pytest.raises(ValueError):
        model.build_pipeline("forest", True, 10)


def test_shuffled_numbers_are_permutations(spark):
    for n in (1, 2, 3, 5, 10, 97, 100, 1000):
        rows = spark.range(n).select("id", *(model.shuffled_number(F.col("id"), n, F.lit(k)).alias(f"k{k}") for k in (1, 2))).collect()
        for k in ("k1", "k2"):
            assert sorted(r[k] for r in rows) == list(range(n))
        if n >= 97:
            assert sum(r["k1"] == r["k2"] for r in rows) < n / 5 and sum(r["k1"] == r["id"] for r in rows) < n / 5


def test_donors_lend_once_in_each_repeat(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    lent = model.donors(rows, ["a", "b"], repeats=4).collect()
    for repeat in range(1, 5):
        mine = [r for r in lent if r["repeat"] == repeat]
        assert sorted(r["_row"] for r in mine) == sorted(r["_donor"] for r in mine) == list(range(50))


def test_models_score_in_a_session_that_has_observed(spark, dataset):
    plain = model.build_pipeline(model.LOGISTIC, True, dataset.filter("split = 'development'").count()).fit(dataset.filter("split = 'development'"))
    seen = Observation("seen")
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).count() == 3 and seen.get["rows"] == 3
    fitted = model.fit(model.LOGISTIC, True, dataset.filter("split = 'development'"))
    assert list(fitted.stages[-1].coefficients) == pytest.approx(list(plain.stages[-1].coefficients))
    rows = model.score(fitted, dataset.filter("split = 'test'")).collect()
    assert len(rows) > 0 and all(0 <= r["score"] <= 1 for r in rows)
    aucs = model.rolling_evaluation(dataset, FOLDS[:1], 1).collect()
    assert {r["candidate"] for r in aucs} >= {"logistic", "logistic_without_rate", "boosting", "boosting_without_rate"}
    run = model.final_test(dataset, model.LOGISTIC)
    assert len(model.permutation_importance(run.model, dataset.filter("split = 'test'"), repeats=1).collect()) == 14
    assert len(model.coefficients(run.model).collect()) == 12 + 4 + 2
    assert len(model.production_scores(dataset, model.LOGISTIC).collect()) == 8
