"""E1–E4. Calendar algebra on monthly series and on long panels.

Shifts are by calendar month, never by row, so a gap gives NULL and not the
wrong month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.parsing import month_index


def densify(series: DataFrame, month: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """E1. One row per calendar month between the first and the last, missing values NULL."""
    by = list(by)
    span = series.groupBy(*by).agg(F.min(month).alias("_from"), F.max(month).alias("_to"))
    axis = span.select(*by, F.explode(F.expr("sequence(_from, _to, interval 1 month)")).alias(month))
    return axis.join(series, [*by, month], "left")


def calendar_lag(value: Column, months: int, by: Sequence[str], month: str = "month") -> Column:
    """E3. Value exactly ``months`` earlier in the same key (negative: later).

    All lags over the same keys share one window specification, so a whole
    feature set costs one exchange and one sort.
    """
    window = (
        Window.partitionBy(*by).orderBy(month_index(F.col(month))).rangeBetween(-months, -months)
    )
    return F.max(value).over(window)


def shift_series(series: DataFrame, lags: Sequence[int], month: str = "month") -> DataFrame:
    """Emit every row once per lag, dated at the month it is seen from.

    A series has at most one row per calendar month, so this stays a few
    thousand rows whatever the size of the panel it is joined to.
    """
    lag = F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")
    others = [c for c in series.columns if c != month]
    exploded = series.select(month, *others, lag)
    return exploded.select(F.add_months(F.col(month), F.col("lag")).alias(month), "lag", *others)


def series_lags(
    series: DataFrame,
    value: str = "rate",
    change: str = "rate_change",
    lag_prefix: str = "rate_lag_",
    max_lag: int = 6,
    month: str = "month",
) -> DataFrame:
    """E2–E4. Series with its first difference and its lags 1…``max_lag``.

    Written as shift-and-regroup instead of an unpartitioned window; months
    that exist only because of a shift are dropped again.
    """
    shifted = shift_series(series.select(month, value), range(max_lag + 1), month)
    lagged = shifted.groupBy(month).agg(
        *[F.max(F.when(F.col("lag") == k, F.col(value))).alias(f"_l{k}") for k in range(max_lag + 1)]
    )
    return lagged.filter("_l0 IS NOT NULL").select(
        month,
        F.col("_l0").alias(value),
        (F.col("_l0") - F.col("_l1")).alias(change),
        *[F.col(f"_l{k}").alias(f"{lag_prefix}{k}") for k in range(1, max_lag + 1)],
    )
