"""H. Training, rolling-origin selection, final test and production scores on Spark ML.

Driver loops run over folds and candidates (a handful, set by the caller),
never over keys or rows. Scores stay distributed; only model parameters and
the mean AUC per candidate reach the driver.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators.evaluate import auc, baseline_scores, metrics_table
from panelwright.operators.features import NUMERIC_FEATURES, RATE_FEATURES
from panelwright.operators.reporting import long_counts
from panelwright.session import cut_lineage, delete_path, shared_dir

LOGISTIC, BOOSTING = "logistic", "boosting"
CANDIDATES = (LOGISTIC, BOOSTING)
CATEGORICAL_FEATURES = ["entity", "product"]
LABEL = "gains"

# Model settings and the margin within which the simpler model wins.
SEED = 42
INVERSE_PENALTY = 1.0
MAX_ITERATIONS = 1000
BOOSTING_ROUNDS = 200
BOOSTING_RATE = 0.05
TIE_MARGIN = 0.01
REPEATS = 10

# Fits of one selection that may run at the same time; they share the executors.
PARALLEL_FITS = 8


@dataclass(frozen=True)
class Fold:
    """Train on origins up to ``train_end``, evaluate on [first, last]."""

    name: str
    train_end: str
    first: str
    last: str


def yearly_folds(years: Sequence[int]) -> list[Fold]:
    """H13. The label looks five months ahead, so training stops in July of the year before."""
    return [Fold(str(y), f"{y - 1}-07-01", f"{y}-01-01", f"{y}-12-01") for y in years]


def numeric_features(with_rate: bool) -> list[str]:
    """H1."""
    return [f for f in NUMERIC_FEATURES if with_rate or f not in RATE_FEATURES]


def build_pipeline(kind: str, with_rate: bool, n_train: int, rounds: int = BOOSTING_ROUNDS) -> Pipeline:
    """H2–H4. Preprocessing and model in one pipeline, fitted on training rows only.

    An unseen category becomes all zeros: ``keep`` adds one index for it and
    ``dropLast`` drops exactly that index again.
    """
    numeric = numeric_features(with_rate)
    indexed = [f"_{c}_index" for c in CATEGORICAL_FEATURES]
    encoded = [f"_{c}_hot" for c in CATEGORICAL_FEATURES]
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True),
        StringIndexer(
            inputCols=CATEGORICAL_FEATURES, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=["_scaled", *encoded], outputCol="_features"),
    ]
    if kind == LOGISTIC:
        model = LogisticRegression(
            featuresCol="_features",
            labelCol=LABEL,
            maxIter=MAX_ITERATIONS,
            regParam=1.0 / (INVERSE_PENALTY * max(n_train, 1)),
            elasticNetParam=0.0,
            standardization=False,
        )
    elif kind == BOOSTING:
        model = GBTClassifier(
            featuresCol="_features",
            labelCol=LABEL,
            maxIter=rounds,
            stepSize=BOOSTING_RATE,
            maxDepth=5,
            minInstancesPerNode=20,
            seed=SEED,
        )
    else:
        raise ValueError(f"unknown model: {kind}")
    return Pipeline(stages=[*stages, model])


def fit(kind: str, with_rate: bool, train: DataFrame, rounds: int = BOOSTING_ROUNDS) -> PipelineModel:
    return without_summary(build_pipeline(kind, with_rate, train.count(), rounds).fit(train), train.sparkSession)


def without_summary(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The same model without the summary of its training.

    The summary holds the session, which can't be sent to tasks once anything in it has been observed, so such a model
    could not score. A model that has been saved and read again has none.
    """
    fitted = model.stages[-1]
    if not isinstance(fitted, LogisticRegressionModel):
        return model
    path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    try:
        fitted.write().session(spark).save(path)
        return PipelineModel([*model.stages[:-1], LogisticRegressionModel.read().session(spark).load(path)])
    finally:
        delete_path(spark, path)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """H12. Input columns plus ``score``, the probability of the positive class."""
    return model.transform(rows).select(
        *rows.columns, vector_to_array("probability")[1].alias("score")
    )


def candidate_name(kind: str, with_rate: bool) -> str:
    return kind if with_rate else f"{kind}_without_rate"


def fit_all(spark: SparkSession, work: Callable, tasks: Sequence, parallelism: int = PARALLEL_FITS) -> list:
    """Independent fits submitted side by side, as Spark's own cross-validation does."""
    threads = ThreadPool(min(parallelism, len(tasks)))
    try:
        return threads.map(inheritable_thread_target(spark)(work), tasks, chunksize=1)
    finally:
        threads.close()


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rolling_scores(dataset: DataFrame, folds: Sequence[Fold], rounds: int = BOOSTING_ROUNDS) -> DataFrame:
    """H13. Scored rows of every fold and candidate, with and without the rate, plus baselines."""
    development = dataset.filter("split = 'development'")

    def rows_of(fold: Fold) -> tuple[DataFrame, DataFrame]:
        train = development.filter(F.col("origin") <= F.lit(fold.train_end).cast("date"))
        inside = F.col("origin").between(F.lit(fold.first).cast("date"), F.lit(fold.last).cast("date"))
        return train, development.filter(inside)

    def evaluated(task: tuple[Fold, str, bool]) -> DataFrame:
        fold, kind, with_rate = task
        train, rows = rows_of(fold)
        return score(fit(kind, with_rate, train, rounds), rows).select(
            F.lit(fold.name).alias("fold"),
            F.lit(candidate_name(kind, with_rate)).alias("candidate"),
            LABEL,
            "score",
        )

    tasks = [(fold, kind, with_rate) for kind in reversed(CANDIDATES) for fold in folds for with_rate in (True, False)]
    parts = fit_all(dataset.sparkSession, evaluated, tasks)
    for fold in folds:
        parts.append(
            baseline_scores(*rows_of(fold), LABEL).select(
                F.lit(fold.name).alias("fold"), "candidate", LABEL, F.col("score").cast("double").alias("score")
            )
        )
    return _union(parts)


def rolling_evaluation(dataset: DataFrame, folds: Sequence[Fold], rounds: int = BOOSTING_ROUNDS) -> DataFrame:
    """H13. AUC per fold and candidate, all from one grouped plan."""
    return auc(rolling_scores(dataset, folds, rounds), LABEL, "score", ["fold", "candidate"])


def fold_sizes(dataset: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """H13. Training and evaluation rows per fold, in one pass."""
    development = dataset.filter("split = 'development'")
    origin = F.col("origin")
    counters = {}
    for f in folds:
        counters[f"{f.name}_train"] = F.count_if(origin <= F.lit(f.train_end).cast("date"))
        counters[f"{f.name}_evaluation"] = F.count_if(
            origin.between(F.lit(f.first).cast("date"), F.lit(f.last).cast("date"))
        )
    return long_counts(development, **counters)


def model_choice(aucs: DataFrame) -> DataFrame:
    """H14. Highest mean AUC; the logistic model wins when it is within the margin."""
    means = aucs.filter(F.col("candidate").isin(*CANDIDATES)).groupBy("candidate").agg(F.avg("auc").alias("mean_auc"))
    logistic = F.max(F.when(F.col("candidate") == LOGISTIC, F.col("mean_auc")))
    summary = means.agg(
        logistic.alias("logistic_auc"),
        F.max("mean_auc").alias("best_auc"),
        F.max_by("candidate", "mean_auc").alias("best"),
    )
    chosen = F.when(F.col("best_auc") - F.col("logistic_auc") < TIE_MARGIN, F.lit(LOGISTIC)).otherwise(F.col("best"))
    return summary.select(chosen.alias("chosen"), "logistic_auc", "best_auc")


def chosen_name(choice: DataFrame) -> str:
    """The one value of the selection the next fit needs on the driver."""
    return choice.first()["chosen"]


def has_enough(dataset: DataFrame) -> bool:
    """H19. Both a development and a test part exist; two existence tests, no count."""
    return not (
        dataset.filter("split = 'development'").isEmpty() or dataset.filter("split = 'test'").isEmpty()
    )


@dataclass(frozen=True)
class FinalTest:
    scored: DataFrame
    metrics: DataFrame
    predictions: DataFrame
    model: PipelineModel


def final_test(dataset: DataFrame, chosen: str, rounds: int = BOOSTING_ROUNDS) -> FinalTest:
    """H17. One evaluation on the test part: chosen model with and without the rate, and the baselines."""
    train = dataset.filter("split = 'development'")
    test = dataset.filter("split = 'test'")
    model, bare = fit_all(
        dataset.sparkSession, lambda with_rate: fit(chosen, with_rate, train, rounds), (True, False)
    )
    keep = ["candidate", *CATEGORICAL_FEATURES, "origin", "value_origin", LABEL, "score", "predicted"]

    def rows(name: str, m: PipelineModel) -> DataFrame:
        return (
            score(m, test)
            .withColumn("candidate", F.lit(name))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .select(*keep)
        )

    base = baseline_scores(train, test, LABEL).withColumn("score", F.col("score").cast("double")).select(*keep)
    # Scored once and stored: every metric below reads these rows.
    scored = cut_lineage(_union([rows("model", model), rows("model_without_rate", bare), base]))
    predictions = score(model, test).select(
        *CATEGORICAL_FEATURES, "origin", LABEL, "acceleration_3m", "score"
    )
    return FinalTest(scored, metrics_table(scored), predictions, model)


def auc_by_product(scored: DataFrame, product: str = "product") -> DataFrame:
    """H10."""
    return auc(scored, LABEL, "score", ["candidate", product])


def production_scores(dataset: DataFrame, chosen: str, rounds: int = BOOSTING_ROUNDS) -> DataFrame:
    """H18. Retrain on every labelled row, score the last origin."""
    train = dataset.filter("split IN ('development', 'embargo', 'test')")
    model = fit(chosen, True, train, rounds)
    return (
        score(model, dataset.filter("split = 'production'"))
        .select(*CATEGORICAL_FEATURES, "origin", "score")
        .orderBy(F.col("score").desc(), *CATEGORICAL_FEATURES)
    )


def coefficients(model: PipelineModel) -> DataFrame | None:
    """H16. Standardised coefficients by magnitude; one row per model column."""
    fitted = model.stages[-1]
    if not hasattr(fitted, "coefficients"):
        return None
    indexer = model.stages[2]
    names = list(model.stages[0].getInputCols())
    for column, labels in zip(indexer.getInputCols(), indexer.labelsArray):
        names += [f"{column}={value}" for value in labels]
    rows = list(zip(names, map(float, fitted.coefficients.toArray())))
    return SparkSession.active().createDataFrame(rows, "feature string, coefficient double").orderBy(
        F.abs("coefficient").desc(), "feature"
    )


def numbered(rows: DataFrame, keys: Sequence[str], number: str = "_row") -> DataFrame:
    """Rows numbered from 0 in the order of a hash of their keys.

    The hash's top bits cut it into even ranges: each range is numbered in its own task and shifted by the rows before it.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*keys)).withColumn("_range", F.shiftright("_h", 52))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 ranges at most
    offsets = hashed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_h", *keys)
    counted = hashed.withColumn("_i", F.row_number().over(inside)).join(offsets, "_range")
    return counted.withColumn(number, F.col("_before") + F.col("_i") - 1).drop("_h", "_range", "_i", "_before")


FEISTEL_STEPS, WALKS = 6, 64


def shuffled_number(number: Column, n: int, *key: Column) -> Column:
    """A permutation of 0 to ``n`` - 1 chosen by ``key``, computed for each number alone.

    A Feistel network over the pairs of a rectangle that holds ``n`` numbers or a few more: each step adds a hash
    of one side to the other, modulo the other's length, which can be undone. A number that falls outside of ``n`` is
    sent on until it falls inside. As few lie outside, ``WALKS`` tries don't fail; if they did, the query would end.
    """
    width = max(1, math.isqrt(max(n - 1, 0)) + 1)
    height = max(1, -(-n // width))

    def step(pair: Column, k: int) -> Column:
        left, right = pair["l"], pair["r"]
        noise = F.xxhash64(right if k % 2 else left, F.lit(k), *key)
        if k % 2:
            return F.struct(F.pmod(left + F.pmod(noise, F.lit(width)), F.lit(width)).alias("l"), right.alias("r"))
        return F.struct(left.alias("l"), F.pmod(right + F.pmod(noise, F.lit(height)), F.lit(height)).alias("r"))

    def stepped(k: int) -> Callable[[Column], Column]:
        return lambda pair: step(pair, k)

    def network(x: Column) -> Column:
        pairs = F.array(F.struct(F.pmod(x, F.lit(width)).alias("l"), F.floor(x / width).cast("long").alias("r")))
        for k in range(FEISTEL_STEPS):
            pairs = F.transform(pairs, stepped(k))
        return F.get(F.transform(pairs, lambda pair: pair["l"] + pair["r"] * width), F.lit(0))

    once = network(number.cast("long"))
    inside = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(inside < n, inside).otherwise(F.raise_error(F.lit("no number inside")).cast("long"))


def donors(rows: DataFrame, keys: Sequence[str], repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """H15. (``repeat``, ``_row``, ``_donor``) and the columns of ``rows``: who lends each row its values in each repeat."""
    own = cut_lineage(numbered(rows, keys))  # read twice below, and its length is part of the permutation
    n = own.count()
    repeated = own.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return repeated.withColumn("_donor", shuffled_number(F.col("_row"), n, F.lit(seed), F.col("repeat")))


def permutation_importance(
    model: PipelineModel,
    rows: DataFrame,
    keys: Sequence[str] = ("entity", "product", "origin"),
    repeats: int = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """H15. Mean AUC drop when one input column is shuffled.

    Every row gets a donor row by a permutation of the row numbers that is computed, not sorted; one
    permutation per repeat serves all columns. Copies for each column exist only on their way to the model,
    and all are measured by one grouped AUC.
    """
    columns = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    base_auc = auc(score(model, rows), LABEL, "score").select("auc").scalar()
    slim = rows.select(*[k for k in keys if k not in columns], *columns, LABEL)
    lent = donors(slim, keys, repeats, seed)
    own = lent.select("repeat", "_donor", LABEL, F.struct(*columns).alias("_own"))
    lender = lent.filter("repeat = 1").select(F.col("_row").alias("_donor"), F.struct(*columns).alias("_lent"))
    paired = own.join(lender, "_donor")
    shuffled = paired.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns]))).select(
        "repeat",
        "feature",
        LABEL,
        *[
            F.when(F.col("feature") == c, F.col(f"_lent.{c}")).otherwise(F.col(f"_own.{c}")).alias(c)
            for c in columns
        ],
    )
    per_copy = auc(score(model, shuffled), LABEL, "score", ["feature", "repeat"])
    drops = per_copy.groupBy("feature").agg(F.avg("auc").alias("_auc"))
    return drops.select("feature", (base_auc - F.col("_auc")).alias("importance")).orderBy(
        F.col("importance").desc(), "feature"
    )


def rate_effect(aucs: DataFrame, kind: str) -> DataFrame:
    """H20. Effect of the rate features per fold."""
    with_rate = F.max(F.when(F.col("candidate") == kind, F.col("auc")))
    without = F.max(F.when(F.col("candidate") == candidate_name(kind, False), F.col("auc")))
    return aucs.groupBy("fold").agg((with_rate - without).alias("rate_effect"))


def result_summary(dataset: DataFrame, metrics: DataFrame) -> DataFrame:
    """H20. Rows per split and the comparison figures, long."""
    def figure(candidate: str, metric: str):
        return F.max(F.when((F.col("candidate") == candidate) & (F.col("metric") == metric), F.col("value")))

    wide = metrics.agg(
        figure("model", "auc").alias("auc_model"),
        figure("model_without_rate", "auc").alias("auc_without_rate"),
        figure("mean_reversion", "auc").alias("auc_mean_reversion"),
        figure("model", "precision_at_n").alias("top_model"),
        figure("mean_reversion", "precision_at_n").alias("top_mean_reversion"),
    ).select(
        "*",
        (F.col("auc_model") - F.col("auc_without_rate")).alias("rate_effect_auc"),
        (F.col("auc_model") > F.col("auc_mean_reversion")).cast("double").alias("beats_mean_reversion"),
    )
    figures = wide.unpivot([], wide.columns, "metric", "value")
    rows = dataset.groupBy(F.concat(F.lit("rows_"), "split").alias("metric")).agg(
        F.count("*").cast("double").alias("value")
    )
    return rows.unionByName(figures)
