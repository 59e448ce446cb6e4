"""H5–H11. Ranking and classification metrics as aggregates.

Inputs are long scored tables: one row per (candidate, evaluated row). All
metrics of all candidates come from one grouped plan, not from a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.ordered import running_sums

ALERT_LIMIT = 0.95


def auc(
    scored: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """H6, H7, H10. Exact area under the ROC curve, ties counted half.

    Sums over distinct scores, so heavily tied scores shrink before the
    shuffle and a large group is split into score ranges. A single class gives
    NULL, a constant score 0.5.
    """
    table = _areas(scored, label, score, by, {"auc": weight})
    return table.select(*by, "auc")


def auc_both(scored: DataFrame, label: str, score: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """H6 and H7 from one ordering: ``auc`` and ``auc_weighted``."""
    return _areas(scored, label, score, by, {"auc": None, "auc_weighted": weight})


def _areas(
    scored: DataFrame, label: str, score: str, by: Sequence[str], wanted: dict[str, str | None]
) -> DataFrame:
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    sums: dict[str, Column] = {}
    for name, weight in wanted.items():
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        sums[f"_p_{name}"] = F.when(F.col(label) == 1, w).otherwise(0.0)
        sums[f"_n_{name}"] = F.when(F.col(label) == 0, w).otherwise(0.0)
    steps = running_sums(known, by, score, sums)
    areas = []
    for name in wanted:
        pos, neg = f"_p_{name}", f"_n_{name}"
        area = F.sum(F.col(pos) * (F.col(f"{neg}_below") + F.col(neg) / 2))
        areas.append(F.try_divide(area, F.max(f"{pos}_total") * F.max(f"{neg}_total")).alias(name))
    return steps.groupBy(*by).agg(*areas)


def precision_at_n(
    scored: DataFrame,
    label: str,
    score: str,
    sizes: Sequence[int],
    period: str,
    ties: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """H8, I4. Hit rate among the top N of each period, averaged over periods.

    ``row_number() <= max(N)`` lets Spark keep only N rows per period in each
    task before the shuffle, so a large period is never collected.
    """
    ranking = Window.partitionBy(*by, period).orderBy(F.col(score).desc_nulls_last(), *ties)
    top = scored.withColumn("_pos", F.row_number().over(ranking)).filter(F.col("_pos") <= max(sizes))
    listed = top.withColumn("list_size", F.explode(F.array(*[F.lit(n) for n in sizes]))).filter("_pos <= list_size")
    per_period = listed.groupBy(*by, "list_size", period).agg(F.avg(F.col(label).cast("double")).alias("_hit"))
    return per_period.groupBy(*by, "list_size").agg(F.avg("_hit").alias("precision"))


def confusion(scored: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """H9. Precision, recall, F1, accuracy and support from four counts."""
    y, p = F.col(label), F.col(predicted)
    cells = scored.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return cells.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        (tp + fp + fn + tn).alias("rows"),
    )


def baseline_scores(train: DataFrame, evaluation: DataFrame, label: str = "gains", signal: str = "acceleration_3m") -> DataFrame:
    """H5. Majority class and mean reversion, as long scored rows."""
    majority = train.agg((F.coalesce(F.avg(label), F.lit(0.0)) >= 0.5).cast("int")).scalar()
    reversion = F.struct(
        F.lit("mean_reversion").alias("candidate"),
        (-F.col(signal)).alias("score"),
        (F.col(signal) < 0).cast("int").alias("predicted"),
    )
    constant = F.struct(
        F.lit("majority_class").alias("candidate"), F.lit(0.5).alias("score"), F.col("_majority").alias("predicted")
    )
    return (
        evaluation.withColumn("_majority", majority)
        .withColumn("_b", F.explode(F.array(constant, reversion)))
        .select(*evaluation.columns, "_b.*")
    )


def metrics_table(
    scored: DataFrame,
    label: str = "gains",
    by: Sequence[str] = ("candidate",),
    period: str = "origin",
    weight: str = "value_origin",
    ties: Sequence[str] = ("entity", "product"),
    top: int = 20,
) -> DataFrame:
    """H9, H17. All metrics of every candidate as ``(…, metric, value)`` rows."""
    by = list(by)
    areas = auc_both(scored, label, "score", weight, by).unpivot(by, ["auc", "auc_weighted"], "metric", "value")
    best = precision_at_n(scored, label, "score", [top], period, ties, by).select(
        *by, F.lit("precision_at_n").alias("metric"), F.col("precision").alias("value")
    )
    cells = confusion(scored, label, "predicted", by)
    named = ["precision", "recall", "f1", "accuracy", "rows"]
    flat = cells.select(*by, *[F.col(c).cast("double").alias(c) for c in named]).unpivot(by, named, "metric", "value")
    return areas.unionByName(best).unionByName(flat)


def alerts(metrics: DataFrame, limit: float = ALERT_LIMIT) -> DataFrame:
    """H11. A metric this good asks for an investigation; row counts are not metrics."""
    return metrics.filter((F.col("value") > limit) & (F.col("metric") != "rows"))
