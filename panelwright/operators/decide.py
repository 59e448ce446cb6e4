"""I. Ranked lists, rule sensitivity and the closing figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.labels import quarter_label
from panelwright.operators.evaluate import precision_at_n

# List length of the decision and the alternatives it is compared with.
TOP = 20
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
LIST_SIZES = (10, 20, 40)

EXPAND, ALERT = "expand", "alert"
RULE_THRESHOLD, RULE_LIST = "minimum score", "top of the month"


class MissingInput(Exception):
    """I8. An input table the decision needs does not exist."""


def require_inputs(tables: dict[str, DataFrame | None]) -> None:
    missing = sorted(name for name, table in tables.items() if table is None)
    if missing:
        raise MissingInput(", ".join(missing))


def recommendation(
    scores: DataFrame,
    panel: DataFrame,
    top: int = TOP,
    keys: Sequence[str] = ("entity", "product"),
    score: str = "score",
    value: str = "value",
    origin: str = "origin",
    month: str = "month",
) -> DataFrame:
    """I1–I2. ``top`` highest scores (expand) and ``top`` lowest (alert), with the value at the origin.

    Each list is a top-k: every task sends at most ``top`` rows. Positions are
    numbered over those rows only, and the value is looked up for them only.
    """
    def ranked(group: str, order) -> DataFrame:
        listed = scores.orderBy(order, *keys).limit(top)
        position = Window.orderBy(order, *keys)  # at most ``top`` rows
        return listed.select(
            F.lit(group).alias("group"), F.row_number().over(position).alias("position"), *keys, score, origin
        )

    lists = ranked(EXPAND, F.col(score).desc()).unionByName(ranked(ALERT, F.col(score).asc()))
    values = panel.select(*keys, F.col(month).alias(origin), value)
    # The lists hold 2 × top rows, a bound set by the caller, so they are the
    # broadcast side and the panel is scanned in place.
    found = values.join(F.broadcast(lists.select(*keys, origin)), [*keys, origin], "left_semi").distinct()
    return lists.join(found, [*keys, origin], "left").select("group", "position", *keys, score, value)


def threshold_sensitivity(
    predictions: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    label: str = "gains",
    score: str = "score",
    period: str = "origin",
) -> DataFrame:
    """I3. Rows per month, precision and recall when everything above a score is taken.

    All thresholds are counted in one pass; the rows are not multiplied.
    """
    y, s = F.col(label).cast("double"), F.col(score)
    counts = predictions.groupBy(period).agg(
        F.sum(y).alias("_positives"),
        *[F.count_if(s >= t).alias(f"_n{i}") for i, t in enumerate(thresholds)],
        *[F.sum(F.when(s >= t, y)).alias(f"_h{i}") for i, t in enumerate(thresholds)],
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("parameter"), F.sum(f"_n{i}").alias("n"), F.coalesce(F.sum(f"_h{i}"), F.lit(0.0)).alias("hits")
        )
        for i, t in enumerate(thresholds)
    ]
    totals = counts.agg(
        F.count("*").alias("months"), F.sum("_positives").alias("positives"), F.array(*rows).alias("_rows")
    )
    return totals.select("months", "positives", F.explode("_rows").alias("r")).select(
        F.lit(RULE_THRESHOLD).alias("rule"),
        F.col("r.parameter").alias("parameter"),
        F.try_divide(F.col("r.n"), F.col("months")).alias("per_month"),
        F.try_divide(F.col("r.hits"), F.col("r.n")).alias("precision_model"),
        F.try_divide(F.col("r.hits"), F.col("positives")).alias("recall_model"),
        F.lit(None).cast("double").alias("precision_simple"),
    )


def list_sensitivity(
    predictions: DataFrame,
    sizes: Sequence[int] = LIST_SIZES,
    label: str = "gains",
    score: str = "score",
    simple_score: str = "simple_score",
    period: str = "origin",
    ties: Sequence[str] = ("entity", "product"),
) -> DataFrame:
    """I4. Precision of fixed-length lists, for the model and for the simple rule."""
    model = precision_at_n(predictions, label, score, sizes, period, ties)
    simple = precision_at_n(predictions, label, simple_score, sizes, period, ties)
    return model.withColumnRenamed("precision", "precision_model").join(
        simple.withColumnRenamed("precision", "precision_simple"), "list_size"
    ).select(
        F.lit(RULE_LIST).alias("rule"),
        F.col("list_size").cast("double").alias("parameter"),
        F.col("list_size").cast("double").alias("per_month"),
        "precision_model",
        F.lit(None).cast("double").alias("recall_model"),
        "precision_simple",
    )


def sensitivity(predictions: DataFrame, **names: str) -> DataFrame:
    """I3 + I4 in one table."""
    shared = {k: v for k, v in names.items() if k in ("label", "score", "period")}
    return threshold_sensitivity(predictions, **shared).unionByName(list_sensitivity(predictions, **names))


def strongest_significant(level1: DataFrame, ties: Sequence[str] = ("product", "lag")) -> DataFrame:
    """I6. Strongest significant association; the strongest of all when none is."""
    strength = F.round(F.abs("spearman"), 12)
    return (
        level1.filter("spearman IS NOT NULL")
        .orderBy(F.col("significant").desc(), strength.desc(), *ties)
        .limit(1)
    )


def closing_numbers(
    recommended: DataFrame,
    sensitivities: DataFrame,
    predictions: DataFrame,
    level1: DataFrame,
    size: int = TOP,
    label: str = "gains",
    origin: str = "origin",
) -> DataFrame:
    """I5–I7. The figures of the closing statement, as one row.

    Every part is a one-row aggregate read as a scalar subquery.
    """
    chosen = sensitivities.filter((F.col("rule") == RULE_LIST) & (F.col("parameter") == float(size)))
    precision_model = chosen.agg(F.max("precision_model")).scalar()
    precision_simple = chosen.agg(F.max("precision_simple")).scalar()
    chance = predictions.agg(F.avg(F.col(label).cast("double"))).scalar()
    strongest = strongest_significant(level1)
    expand = recommended.filter(F.col("group") == EXPAND)
    total = expand.agg(F.sum(F.col("value").cast("decimal(30,2)")).cast("double").alias("list_value"))
    first = expand.filter("position <= 3").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "entity", "product"))),
                lambda r: F.concat_ws("|", r["entity"], r["product"]),
            ),
            ";",
        )
    )
    return total.select(
        F.lit(size).alias("list_size"),
        "list_value",
        precision_model.alias("precision_model"),
        precision_simple.alias("precision_simple"),
        chance.alias("precision_chance"),
        (precision_model * size).alias("expected_hits"),
        ((1 - precision_model) * size).alias("expected_misses"),
        (precision_simple * size).alias("expected_hits_simple"),
        (chance * size).alias("expected_hits_chance"),
        strongest.select("product").scalar().alias("strongest_product"),
        strongest.select("lag").scalar().alias("strongest_lag"),
        strongest.select("spearman").scalar().alias("strongest_rho"),
        strongest.select("p_adjusted").scalar().alias("strongest_p_adjusted"),
        first.scalar().alias("top3"),
    )


def quarter(scores: DataFrame, origin: str = "origin", delay: int = 2, horizon: int = 3) -> DataFrame:
    """I7. Label of the quarter the newest scores are about."""
    return scores.agg(F.max(origin).alias(origin)).select(origin, quarter_label(F.col(origin), delay, horizon).alias("quarter"))
