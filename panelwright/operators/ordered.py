"""Running sums in value order, without sending a whole family to one task.

A plain ``over (partition by family order by value)`` puts a family in one
task; a family may be the whole table. Here equal values are first merged by a
partial aggregation, and the rest is dealt out by range of (family, value), so a
part holds neighbours only. A part's total goes to a small table of one row per
family and part, whose running sums are what lies before a part; inside it a
window does the rest. Nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import tasks_for


def running_sums(
    df: DataFrame,
    families: Sequence[str],
    order: str,
    sums: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """One row per (family, distinct ``order`` value).

    For every entry ``name -> expression`` in ``sums`` the result has ``name``
    (its sum at this value), ``name_below`` (its sum over all smaller values)
    and ``name_total`` (its sum over the family). Rows whose order value is
    NULL must be filtered by the caller.

    The dealt rows are read by two branches of one plan, from one exchange. Should a session not share it, the
    bounds of its ranges might differ: then the numbers of rows disagree, and the query ends with an error.
    """
    families = list(families)
    distinct = df.groupBy(*families, order).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    dealt = distinct.repartitionByRange(parts or tasks_for(df.sparkSession), *families, order).withColumn("_part", F.spark_partition_id())
    totals = dealt.groupBy(*families, "_part").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(*families).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*families)  # one row per part
    offsets = totals.select(
        *families,
        "_part",
        "_rows",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_before") for n in sums],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums],
    )
    part = Window.partitionBy(*families, "_part")
    inside = part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        *families,
        order,
        "_part",
        F.count(F.lit(1)).over(part).alias("_here"),
        *sums,
        *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_{n}_inside") for n in sums],
    )
    same = F.when(F.col("_rows") != F.col("_here"), F.raise_error(F.lit("ranges of running sums differ"))).otherwise(F.lit(True))
    return _join(local, offsets, [*families, "_part"]).where(same.cast("boolean")).select(
        *families,
        order,
        *sums,
        *[(F.col(f"_{n}_before") + F.col(f"_{n}_inside")).alias(f"{n}_below") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on null-safe family keys."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    return left.join(renamed, condition, "inner").drop(*[f"_k_{k}" for k in keys])


def bag_difference(new: DataFrame, stored: DataFrame, columns: Sequence[str], chunk: int = 10_000) -> DataFrame:
    """B7/B9. Rows of ``new`` that ``stored`` lacks, counting repeated rows.

    Both sides are counted per distinct row first, so a row that makes up a
    third of the input shrinks to one row per task before any shuffle. Missing
    copies are rebuilt in chunks that are spread over the cluster, never all
    in one task.
    """
    columns = list(columns)
    counted = (
        new.select(*columns, F.lit(1).alias("_n"))
        .unionByName(stored.select(*columns, F.lit(-1).alias("_n")))
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_missing"))
        .filter("_missing > 0")
    )
    return replicate(counted, "_missing", chunk)


def replicate(df: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``times`` times; large counts are split over tasks first."""
    keep = [c for c in df.columns if c != times]
    small = df.filter(F.col(times) <= chunk).select(*keep, F.col(times).cast("int").alias("_part"))
    pieces = F.sequence(F.lit(0), ((F.col(times) - 1) / chunk).cast("bigint"))
    large = (
        df.filter(F.col(times) > chunk)
        .withColumn("_i", F.explode(pieces))
        .withColumn("_part", F.least(F.lit(chunk), F.col(times) - F.col("_i") * chunk).cast("int"))
        .repartition(tasks_for(df.sparkSession), *keep, "_i")
        .select(*keep, "_part")
    )
    return small.unionByName(large).select(*keep, F.explode(F.array_repeat(F.lit(1), F.col("_part"))).alias("_copy")).drop("_copy")
