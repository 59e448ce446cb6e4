"""F. Lagged correlation of a panel with a monthly series, with multiple-test control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.student_t import correlation_p_value
from panelwright.operators.calendar import shift_series
from panelwright.operators.ordered import running_sums
from panelwright.operators.panel import consecutive_changes

MAX_LAG = 6
MIN_MONTHS = 24
ALPHA = 0.05


def national_change(gold: DataFrame, product: str = "product", value: str = "value", month: str = "month") -> DataFrame:
    """F1–F2. Sum over entities per product and month, and its consecutive change.

    An entity without a row adds nothing; a month no entity has is a gap.
    """
    total = gold.groupBy(product, month).agg(F.sum(F.col(value).cast("decimal(30,2)")).cast("double").alias(value))
    return consecutive_changes(total, [product], value=value, quantity=None, month=month)


def series_change(gold: DataFrame, change: str = "rate_change", month: str = "month") -> DataFrame:
    """F3. The series carried by the panel: one row per month."""
    return gold.groupBy(month).agg(F.max(change).alias(change))


def lag_pairs(
    changes: DataFrame,
    series: DataFrame,
    max_lag: int = MAX_LAG,
    y: str = "value_change_pct",
    x: str = "rate_change",
    month: str = "month",
) -> DataFrame:
    """F4. Pair y(t) with x(t - k) for k = 0…K.

    Only the series is multiplied by K + 1; it has one row per calendar month
    and lag, so it is broadcast. The panel side gets its lags from a literal
    array, in place.
    """
    shifted = shift_series(series.select(month, x), range(max_lag + 1), month).withColumnRenamed(x, "x")
    lags = F.explode(F.array(*[F.lit(k) for k in range(max_lag + 1)])).alias("lag")
    return (
        changes.select("*", lags)
        .join(F.broadcast(shifted), [month, "lag"], "left")
        .withColumnRenamed(y, "y")
    )


def correlations(pairs: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """F5–F7. Pair count, Spearman (average ranks) and Pearson per group.

    Groups without any complete pair stay, with n = 0. A group has at most one
    row per calendar month, so a rank window per group is bounded. A constant
    side or fewer than three pairs gives NULL.
    """
    complete = F.col(x).isNotNull() & F.col(y).isNotNull()
    base = pairs.select(*by, F.when(complete, F.col(x)).alias("_x"), F.when(complete, F.col(y)).alias("_y"))
    ranked = base.select(
        *by, "_x", "_y", _average_rank("_x", by).alias("_rx"), _average_rank("_y", by).alias("_ry")
    )
    varies = (
        (F.count("_x") >= 3) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    )
    return ranked.groupBy(*by).agg(
        F.count("_x").alias("n_months"),
        F.when(varies, _pearson("_rx", "_ry")).alias("spearman"),
        F.when(varies, _pearson("_x", "_y")).alias("pearson"),
    )


def _average_rank(value: str, by: Sequence[str]) -> Column:
    """Mean of the first and last position of a value; NULL for a NULL value.

    NULL sorts last, so complete pairs keep the ranks 1…n.
    """
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    first, last = F.rank().over(order), F.count(F.lit(1)).over(order)
    return F.when(F.col(value).isNotNull(), (first + last) / F.lit(2.0))


def _pearson(x: str, y: str) -> Column:
    """Moment form: the built-in raises on a constant group."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def with_p_values(table: DataFrame, rho: str = "spearman", n: str = "n_months") -> DataFrame:
    """F8."""
    return table.withColumn("p_value", correlation_p_value(F.col(rho), F.col(n)))


def adjust_p_values(table: DataFrame, keys: Sequence[str], p: str = "p_value", alpha: float = ALPHA) -> DataFrame:
    """F9–F10. Benjamini–Hochberg over all non-null p-values, and the 0.05 flag.

    Tests can be as many as series keys, so ranks come from ``running_sums``.
    For tied p-values the last rank decides, which is what merging them gives.
    The running minimum from the top is taken over ranges the same way: inside
    a range by a window, between ranges from one minimum per range.
    """
    tested = table.filter(F.col(p).isNotNull())
    ranked = running_sums(tested, [], p, {"n": F.lit(1)})
    raw = F.col(p) * F.col("n_total") / (F.col("n_below") + F.col("n"))
    candidates = ranked.select(p, raw.alias("_raw"), _rank_range(F.col("n_below"), F.col("n_total")).alias("_range"))
    after = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)  # at most P_RANGES rows
    later = candidates.groupBy("_range").agg(F.min("_raw").alias("_m")).select(
        "_range", F.min("_m").over(after).alias("_later")
    )
    inside = Window.partitionBy("_range").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = (
        candidates.withColumn("_inside", F.min("_raw").over(inside))
        .join(later, "_range")
        .select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.least("_inside", "_later")).alias("p_adjusted"))
    )
    return (
        table.join(adjusted, F.col(p) == F.col("_p"), "left")
        .drop("_p")
        .withColumn("significant", F.coalesce(F.col("p_adjusted") < alpha, F.lit(False)))
    )


P_RANGES = 1024


def _rank_range(below: Column, total: Column) -> Column:
    """Equal-rank ranges in p order."""
    return F.floor(below * P_RANGES / total).cast("int")


def level_one(gold: DataFrame, max_lag: int = MAX_LAG, product: str = "product") -> DataFrame:
    """F11. Product × lag table at national level."""
    pairs = lag_pairs(national_change(gold, product), series_change(gold), max_lag)
    table = with_p_values(correlations(pairs, [product, "lag"]))
    return adjust_p_values(table, [product, "lag"])


def best_lag(level1: DataFrame, product: str = "product") -> DataFrame:
    """F12. Lag of the strongest association per product; ties go to the smallest lag."""
    strength = F.round(F.abs("spearman"), 12)
    return (
        level1.filter("spearman IS NOT NULL")
        .groupBy(product)
        .agg(F.max_by("lag", F.struct(strength, -F.col("lag"))).alias("best_lag"))
    )


def level_two(
    gold: DataFrame,
    lags: DataFrame,
    keys: Sequence[str] = ("entity", "product"),
    product: str = "product",
    min_months: int = MIN_MONTHS,
    max_lag: int = MAX_LAG,
    month: str = "month",
) -> DataFrame:
    """F13. One correlation per series key, at its product's lag.

    Fewer valid months than ``min_months``: the count stays, the statistics go.
    """
    shifted = (
        shift_series(series_change(gold, month=month), range(max_lag + 1), month)
        .withColumnsRenamed({"rate_change": "x", "lag": "best_lag"})
    )
    valid = F.when(F.col("has_prev"), F.col("value_change_pct"))
    pairs = (
        gold.select(*keys, month, valid.alias("y"))
        .join(lags, product, "left")
        .join(F.broadcast(shifted), [month, "best_lag"], "left")
    )
    short = F.col("n_months") < min_months
    table = (
        correlations(pairs, [*keys, "best_lag"])
        .withColumn("insufficient", short)
        .withColumn("spearman", F.when(~short, F.col("spearman")))
        .withColumn("pearson", F.when(~short, F.col("pearson")))
    )
    return adjust_p_values(with_p_values(table), list(keys)).withColumnRenamed("best_lag", "lag")


def rho_matrix(level2: DataFrame, products: Sequence[str], entity: str = "entity", product: str = "product") -> DataFrame:
    """F15. Entity × product matrix of ρ and of the significance flag.

    The product list is given, so no extra job finds the pivot values.
    """
    cells = [F.max(F.when(F.col(product) == p, F.col("spearman"))).alias(f"rho_{i}") for i, p in enumerate(products)]
    flags = [
        F.max(F.when(F.col(product) == p, F.col("significant"))).alias(f"sig_{i}") for i, p in enumerate(products)
    ]
    return level2.groupBy(entity).agg(*cells, *flags)


def figure_bars(level1: DataFrame, product: str = "product") -> DataFrame:
    """F16. Per bar: sign class, strength class and whether it carries the label."""
    peak = best_lag(level1, product).select(product, F.col("best_lag"))
    height = F.coalesce("spearman", F.lit(0.0))
    return level1.join(peak, product, "left").select(
        product,
        "lag",
        height.alias("height"),
        F.when(height < 0, F.lit("negative")).otherwise(F.lit("positive")).alias("sign_class"),
        F.when(F.col("significant"), F.lit("solid")).otherwise(F.lit("light")).alias("strength_class"),
        F.coalesce(F.col("lag") == F.col("best_lag"), F.lit(False)).alias("is_peak"),
    )


def heat_cells(level2: DataFrame) -> DataFrame:
    """F16. Per cell: hatched when missing, labelled when significant."""
    return level2.select(
        "entity",
        "product",
        "spearman",
        F.when(F.col("spearman").isNull(), F.lit("hatched"))
        .when(F.col("significant"), F.lit("labelled"))
        .otherwise(F.lit("plain"))
        .alias("cell"),
        F.coalesce(F.abs("spearman") > 0.5, F.lit(False)).alias("light_text"),
    )


def series_summary(series: DataFrame, change: str = "rate_change", value: str = "rate") -> DataFrame:
    """F17. Months with a change, extremes of the series."""
    return series.agg(
        F.count_if(F.col(change) != 0).alias("months_with_change"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.count("*").alias("months"),
    )


def last_rows(series: DataFrame, n: int = 6, month: str = "month") -> DataFrame:
    """F17. The last ``n`` months."""
    return series.orderBy(F.col(month).desc()).limit(n)


def significant_summary(level2: DataFrame, product: str = "product") -> DataFrame:
    """F18. Significant keys per product: count, sign split, median ρ, lag."""
    return (
        level2.filter("significant")
        .groupBy(product)
        .agg(
            F.count("*").alias("pairs"),
            F.count_if(F.col("spearman") > 0).alias("positive"),
            F.count_if(F.col("spearman") < 0).alias("negative"),
            F.percentile("spearman", 0.5).alias("median_rho"),
            F.min("lag").alias("lag"),
        )
    )


def strongest(table: DataFrame, n: int, ties: Sequence[str]) -> DataFrame:
    """F19. Top ``n`` by |ρ|; a top-k, so each task sends ``n`` rows."""
    strength = F.round(F.abs("spearman"), 12)
    return table.filter("spearman IS NOT NULL").orderBy(strength.desc(), *ties).limit(n)
