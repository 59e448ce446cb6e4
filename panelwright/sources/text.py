"""A2, A6–A8. Delimited text and Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelwright.session import folder_names


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "UTF-8", schema: str | None = None
) -> DataFrame:
    """A2. Every column as text; ``NA`` and empty fields stay as written.

    Files of one directory may differ in column order or number: read them per
    header and union by name. An unquoted empty field comes back as NULL, so
    NULLs are filled again. With a schema the scan skips the header pass.
    """
    reader = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", encoding)
        .option("inferSchema", False)
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
    )
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path).na.fill("")


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """A4. Union by name; columns only some files have become NULL elsewhere."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def append_by_date(df: DataFrame, path: str, partition: str = "_ingestion_date") -> None:
    """A6. Append sink. One shuffle-free write; each task writes the dates it holds."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def read_table(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """A7. Spark reads ``_name=value`` directories below a table root as partitions.

    Loads may differ in their columns; the table has all of them.
    """
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A8. Full replace through the commit protocol; never over a path the plan still reads."""
    df.write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been committed; what a dead one left half-made is no table."""
    return any("=" in name or name.endswith(".parquet") for name in folder_names(spark, path))
