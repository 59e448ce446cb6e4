"""Counters as tables: one aggregate pass, one row per counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_counts(df: DataFrame, **counters: Column) -> DataFrame:
    """A9. ``(metric, n)`` rows from one global aggregate."""
    row = df.agg(*[c.cast("bigint").alias(name) for name, c in counters.items()])
    return row.unpivot([], list(counters), "metric", "n")


def long_doubles(df: DataFrame, **figures: Column) -> DataFrame:
    """``(metric, value)`` rows from one global aggregate."""
    row = df.agg(*[c.cast("double").alias(name) for name, c in figures.items()])
    return row.unpivot([], list(figures), "metric", "value")


def run_report(load_id: str, run_at: str, counters: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """A9. The run report as rows ``(_load_id, run_at, section, item)``, ready for ``write.json``.

    Counters and every entry of the nested lists (reason counts, incomplete
    keys, …) are one JSON item each, so a long list is never gathered in one row.
    """
    parts = counters.select(F.lit("counters").alias("section"), F.to_json(F.struct("metric", "n")).alias("item"))
    for name, rows in lists.items():
        parts = parts.unionByName(
            rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("item"))
        )
    return parts.select(F.lit(load_id).alias("_load_id"), F.lit(run_at).alias("run_at"), "section", "item")
