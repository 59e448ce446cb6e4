"""E5–E10. Consecutive changes, the gold join and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.calendar import series_lags
from panelwright.operators.reporting import long_counts


def percent_change(now: Column, before: Column) -> Column:
    """Growth in percent; a zero base gives NULL instead of an infinite value."""
    return (F.try_divide(now, before) - 1) * 100


def consecutive_changes(
    panel: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    quantity: str | None = "qty_disclosed",
    month: str = "month",
) -> DataFrame:
    """E5–E7. Changes against the previous month of the same key.

    The previous row counts only when it is exactly one calendar month earlier.
    One window: one exchange on the keys, one sort. A partition holds one row
    per month of a key, so its size is bounded by the calendar.
    """
    carried = [month, value] + ([quantity] if quantity else [])
    by_key = Window.partitionBy(*keys).orderBy(month)
    out = panel.withColumn("_prev", F.lag(F.struct(*carried)).over(by_key)).withColumn(
        "has_prev", F.coalesce(F.col(f"_prev.{month}") == F.add_months(F.col(month), -1), F.lit(False))
    )
    out = out.withColumn(
        "value_change_pct", F.when(F.col("has_prev"), percent_change(F.col(value), F.col(f"_prev.{value}")))
    )
    if quantity:
        out = out.withColumn(
            "qty_change_pct",
            F.when(
                F.col("has_prev") & (F.col(f"_prev.{quantity}") > 0),
                percent_change(F.col(quantity), F.col(f"_prev.{quantity}")),
            ),
        )
    return out.drop("_prev")


def orphan_months(panel: DataFrame, series: DataFrame, month: str = "month") -> DataFrame:
    """E8. Months only one side has."""
    left = panel.select(month).distinct().withColumn("_in_panel", F.lit(True))
    right = series.select(month).distinct().withColumn("_in_series", F.lit(True))
    return (
        left.join(right, month, "full_outer")
        .filter(F.col("_in_panel").isNull() | F.col("_in_series").isNull())
        .select(
            month,
            F.when(F.col("_in_series").isNull(), F.lit("panel_only")).otherwise(F.lit("series_only")).alias("side"),
        )
    )


GOLD_MEASURES = ["qty_disclosed", "masked_rows", "value", "has_prev", "qty_change_pct", "value_change_pct"]


def build_gold(
    panel: DataFrame,
    series: DataFrame,
    keys: Sequence[str] = ("entity", "product"),
    month: str = "month",
    max_lag: int = 6,
) -> DataFrame:
    """E9. Panel with its changes, joined with the series and its lags on month.

    The series has one row per calendar month, a bound that does not grow with
    the data, so it is broadcast; the panel is shuffled once, for its window.
    """
    lags = series_lags(series, max_lag=max_lag, month=month)
    changed = consecutive_changes(panel, keys, month=month)
    return changed.join(F.broadcast(lags), month, "inner").select(
        month, *keys, *GOLD_MEASURES, "rate", "rate_change", *[f"rate_lag_{k}" for k in range(1, max_lag + 1)]
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """E9. Keys that appear more than once; empty for a sound table."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def gold_report(gold: DataFrame, panel: DataFrame, series: DataFrame, month: str = "month") -> DataFrame:
    """E10. Rows in and out, orphans on both sides, rows without a base."""
    orphans = orphan_months(panel, series, month)
    return (
        long_counts(
            gold,
            gold_rows=F.count("*"),
            gold_months=F.countDistinct(month),
            rows_without_prev=F.count_if(~F.col("has_prev")),
            rows_without_qty_change=F.count_if(F.col("qty_change_pct").isNull()),
        )
        .unionByName(long_counts(panel, panel_rows=F.count("*")))
        .unionByName(
            long_counts(
                orphans,
                panel_only_months=F.count_if(F.col("side") == "panel_only"),
                series_only_months=F.count_if(F.col("side") == "series_only"),
            )
        )
    )
