"""G. Leak-free features, the forward label and embargoed splits, in long form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.calendar import calendar_lag, shift_series
from panelwright.operators.panel import percent_change

# Growth spans of the features, in months.
GROWTH_SPANS = (1, 3, 6, 12)
RELATIVE_SPANS = (3, 12)
RATE_SPANS = (3, 6)

RATE_FEATURES = ["rate", "rate_change_3m", "rate_change_6m"]
VALUE_FEATURES = [
    "growth_1m",
    "growth_3m",
    "growth_6m",
    "growth_12m",
    "acceleration_3m",
    "relative_3m",
    "relative_12m",
    "share",
    "share_change_12m",
]
NUMERIC_FEATURES = VALUE_FEATURES + RATE_FEATURES


@dataclass(frozen=True)
class SplitRules:
    """Dates of the split; the gap between them is the embargo."""

    train_end: str
    test_start: str
    n_months: int
    delay: int = 2
    horizon: int = 3


def cohort(gold: DataFrame, keys: Sequence[str], n_months: int) -> DataFrame:
    """G1. Keys present in every scope month."""
    return gold.groupBy(*keys).agg(F.count("*").alias("months_present")).filter(F.col("months_present") == n_months)


def excluded_keys(gold: DataFrame, keys: Sequence[str], n_months: int) -> DataFrame:
    """G1. The complement, with its month counts."""
    return gold.groupBy(*keys).agg(F.count("*").alias("months_present")).filter(F.col("months_present") < n_months)


def growth(value: Column, span: int, by: Sequence[str], month: str) -> Column:
    """G2. Percent growth over the last ``span`` calendar months."""
    return percent_change(value, calendar_lag(value, span, by, month))


def label(value: Column, by: Sequence[str], month: str, delay: int = 2, horizon: int = 3) -> Column:
    """G7. 1 when growth from t+delay to t+delay+horizon beats the last three months.

    The only expression that looks forward.
    """
    ahead = percent_change(
        calendar_lag(value, -(delay + horizon), by, month), calendar_lag(value, -delay, by, month)
    )
    behind = growth(value, 3, by, month)
    return F.when(ahead.isNotNull() & behind.isNotNull(), (ahead > behind).cast("int"))


def rate_features(gold: DataFrame, rate: str = "rate", month: str = "month") -> DataFrame:
    """G6. Rate level and its 3- and 6-month changes, one row per month."""
    series = gold.groupBy(month).agg(F.max(rate).alias(rate))
    shifted = shift_series(series, (0, *RATE_SPANS), month).groupBy(month)
    level = {k: F.max(F.when(F.col("lag") == k, F.col(rate))) for k in (0, *RATE_SPANS)}
    return shifted.agg(
        level[0].alias(rate), *[(level[0] - level[k]).alias(f"rate_change_{k}m") for k in RATE_SPANS]
    ).filter(F.col(rate).isNotNull())


def market(gold: DataFrame, product: str = "product", value: str = "value", month: str = "month") -> DataFrame:
    """G4. National total per product and month, over all keys, with its growth."""
    total = gold.groupBy(product, month).agg(
        F.sum(F.col(value).cast("decimal(30,2)")).cast("double").alias("market_value")
    )
    return total.select(
        product,
        month,
        "market_value",
        *[growth(F.col("market_value"), k, [product], month).alias(f"market_growth_{k}m") for k in RELATIVE_SPANS],
    )


def features(
    gold: DataFrame,
    rules: SplitRules,
    keys: Sequence[str] = ("entity", "product"),
    product: str = "product",
    value: str = "value",
    month: str = "month",
) -> DataFrame:
    """G2–G9. Feature rows of the cohort, history complete, label attached.

    The market totals are joined first (their size follows the catalogue, so
    adaptive execution decides how); every lag, growth, label and the cohort
    count then share one exchange on the keys. Adaptive execution keeps a key
    whole, and a key has one row per calendar month.
    """
    by = list(keys)
    v = F.col(value)
    base = gold.select(*by, month, value).join(market(gold, product, value, month), [product, month])
    base = base.withColumn("share", F.try_divide(v, F.col("market_value")))
    whole_key = Window.partitionBy(*by)
    lagged = base.select(
        *by,
        month,
        v.alias("value_origin"),
        "share",
        *[growth(v, k, by, month).alias(f"growth_{k}m") for k in GROWTH_SPANS],
        (growth(v, 3, by, month) - percent_change(
            calendar_lag(v, 3, by, month), calendar_lag(v, 6, by, month)
        )).alias("acceleration_3m"),
        *[
            (growth(v, k, by, month) - F.col(f"market_growth_{k}m")).alias(f"relative_{k}m")
            for k in RELATIVE_SPANS
        ],
        (F.col("share") - calendar_lag(F.col("share"), 12, by, month)).alias("share_change_12m"),
        label(v, by, month, rules.delay, rules.horizon).alias("gains"),
        F.count(F.lit(1)).over(whole_key).alias("_months"),
    )
    return (
        lagged.filter(F.col("_months") == rules.n_months)
        .drop("_months")
        .join(F.broadcast(rate_features(gold, month=month)), month)  # one row per calendar month
        .na.drop(subset=NUMERIC_FEATURES)
        .withColumnRenamed(month, "origin")
    )


def leakage(
    gold: DataFrame,
    rules: SplitRules,
    cut: str,
    keys: Sequence[str] = ("entity", "product"),
    month: str = "month",
) -> DataFrame:
    """G12. (feature, compared, differing): features up to ``cut``, with all later months as they are and perturbed.

    A feature that looks ahead differs somewhere. Rows that exist on one side only count as differing. Both
    versions and the comparison are one plan, whose only result is one row per feature.
    """
    later = F.col(month) > F.lit(cut).cast("date")
    numbers = [f.name for f in gold.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int")]
    bent = gold.withColumns({c: F.when(later, F.col(c) * 7 + 3).otherwise(F.col(c)) for c in numbers})

    def known(rows: DataFrame, name: str) -> DataFrame:
        found = features(rows, rules, keys, month=month).filter(F.col("origin") <= F.lit(cut).cast("date"))
        return found.select(*keys, "origin", F.struct(*NUMERIC_FEATURES, "value_origin").alias(name))

    both = known(gold, "before").join(known(bent, "after"), [*keys, "origin"], "full")
    names = [*NUMERIC_FEATURES, "value_origin"]
    differing = [F.count_if(~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}"))).alias(n) for n in names]
    row = both.agg(F.count(F.lit(1)).alias("compared"), *differing)
    return row.unpivot(["compared"], names, "feature", "differing")


def split_tag(origin: Column, labelled: Column, last_origin: Column, rules: SplitRules) -> Column:
    """G10. Production wins on the last month; everything else needs a label."""
    train_end, test_start = F.lit(rules.train_end).cast("date"), F.lit(rules.test_start).cast("date")
    return (
        F.when(origin == last_origin, F.lit("production"))
        .when(labelled & (origin <= train_end), F.lit("development"))
        .when(labelled & (origin < test_start), F.lit("embargo"))
        .when(labelled, F.lit("test"))
    )


def build_dataset(
    gold: DataFrame,
    rules: SplitRules,
    keys: Sequence[str] = ("entity", "product"),
    month: str = "month",
) -> DataFrame:
    """G11. Feature rows with their split; untagged rows are dropped."""
    last = gold.agg(F.max(month)).scalar()
    tagged = features(gold, rules, keys, month=month).withColumn(
        "split", split_tag(F.col("origin"), F.col("gains").isNotNull(), last, rules)
    )
    return tagged.filter("split IS NOT NULL").select(
        *keys, "origin", *NUMERIC_FEATURES, "value_origin", "gains", "split"
    )


def to_wide(panel: DataFrame, row: str, column: str, values: Sequence[str], cell: str) -> DataFrame:
    """G8. Pivot with a given column list."""
    return panel.groupBy(row).pivot(column, list(values)).agg(F.max(cell))


def to_long(wide: DataFrame, row: str, column: str, cell: str) -> DataFrame:
    """G8. Unpivot, leaving out empty cells."""
    names = [c for c in wide.columns if c != row]
    return wide.unpivot([row], names, column, cell).filter(F.col(cell).isNotNull())
