"""B12–B15. Audits and profiles of stored text rows, as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.money import exact_total, to_money
from panelwright.functions.parsing import day_key, to_number


def version_counts(bronze: DataFrame, columns: Sequence[str], source_object: str = "_source_object") -> DataFrame:
    """B12. Rows and duplicate rows per stored version.

    Counted per distinct row first (partial aggregation), then per version, so
    neither a large version nor a large group of copies lands in one task.
    """
    distinct = bronze.groupBy(source_object, *columns).agg(F.count("*").alias("_n"))
    return distinct.groupBy(source_object).agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates")
    )


def bronze_audit(bronze: DataFrame, columns: Sequence[str], year: Column, source_object: str = "_source_object") -> DataFrame:
    """B12. ``(section, item, n)``: rows and duplicates per version, rows per year, members with several versions.

    ``year`` is computed from the column ``member``.
    """
    versions = version_counts(bronze, columns, source_object).withColumn(
        "member", F.split_part(F.col(source_object), F.lit("@"), F.lit(1))
    )
    per_version = versions.select(
        F.col(source_object).alias("item"),
        F.expr("stack(2, 'rows', rows, 'duplicates', duplicates) as (section, n)"),
    )
    per_year = versions.groupBy(year.alias("item")).agg(F.sum("rows").alias("n")).withColumn("section", F.lit("year"))
    several = (
        versions.groupBy(F.col("member").alias("item"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .withColumn("section", F.lit("several_versions"))
    )
    order = ["section", "item", "n"]
    return per_version.select(*order).unionByName(per_year.select(*order)).unionByName(several.select(*order))


def series_audit(bronze: DataFrame, columns: Sequence[str], date: str, mode: str = "_ingestion_mode") -> DataFrame:
    """B13. ``(section, item, n)``: size, first and last day, rows per mode, days read more than once."""
    day = day_key(F.col(date))
    by_day = bronze.groupBy(day.alias("item")).agg(F.count("*").alias("n"))
    span = by_day.agg(F.sum("n").alias("n"), F.min("item").alias("_first"), F.max("item").alias("_last")).select(
        F.lit("span").alias("section"), F.concat_ws("/", "_first", "_last").alias("item"), "n"
    )
    modes = bronze.groupBy(F.col(mode).alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("mode"))
    repeated = by_day.filter("n > 1").withColumn("section", F.lit("repeated_day"))
    copies = (
        bronze.groupBy(*columns)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
        .select(F.lit("duplicates").alias("section"), F.lit("all").alias("item"), "n")
    )
    order = ["section", "item", "n"]
    return span.unionByName(modes.select(*order)).unionByName(repeated.select(*order)).unionByName(copies)


def source_profile(
    rows: DataFrame, required: Sequence[str], date: str, source_object: str = "_source_object"
) -> DataFrame:
    """B14. Per file: rows, column counts, required columns present, first and last period."""
    columns = [c for c in rows.columns if c != source_object]
    present = [c for c in required if c in columns]
    period = F.when(F.col(date) != "", F.col(date))
    return rows.groupBy(source_object).agg(
        F.count("*").alias("rows"),
        F.lit(len(columns)).alias("columns"),
        F.lit(len(present)).alias("required_present"),
        F.min(period).alias("first_period"),
        F.max(period).alias("last_period"),
    )


def exploration(
    rows: DataFrame,
    product: str,
    quantity: str,
    value: str,
    prefix: str,
    source_object: str = "_source_object",
    decimal: str = ",",
) -> DataFrame:
    """B15. ``(section, item, n)`` overview: rows per file, rows per product and scope, negative counts."""
    order = ["section", "item", "n"]
    files = rows.groupBy(F.col(source_object).alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("file"))
    products = rows.groupBy(F.col(product).alias("item")).agg(F.count("*").alias("n"))
    scope = products.select(
        F.when(F.col("item").startswith(prefix), F.lit("product_in_scope")).otherwise(F.lit("product_out_of_scope")).alias("section"),
        "item",
        "n",
    )
    negatives = (
        rows.filter(to_number(F.col(quantity)) < 0)
        .groupBy(F.col(quantity).alias("item"))
        .agg(F.count("*").alias("n"))
        .withColumn("section", F.lit("negative_quantity"))
    )
    return files.select(*order).unionByName(scope).unionByName(negatives.select(*order))


def value_by_product(
    rows: DataFrame, entity: str, product: str, date: str, value: str, chosen_entity: str, month: str, decimal: str = ","
) -> DataFrame:
    """B15. Value by product for one entity and month, largest first."""
    return (
        rows.filter((F.col(entity) == chosen_entity) & F.col(date).startswith(month))
        .groupBy(product)
        .agg(exact_total(to_money(F.col(value), decimal)).alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), product)
    )
