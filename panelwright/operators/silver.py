"""D. Current versions, scope, panel aggregation and the month-end cut."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.functions.money import MONEY, exact_total
from panelwright.functions.parsing import day_key, month_start, to_day, to_number
from panelwright.operators import quality
from panelwright.operators.reporting import long_counts
from panelwright.session import path_exists, shared_dir

STAGES = ["superseded_version", "product_out_of_scope", "month_out_of_scope", "quarantined", "aggregated"]


def current_versions(df: DataFrame, source_object: str = "_source_object") -> DataFrame:
    """D1. Greatest version text of every file, the part before ``@``.

    Reads one column. Rows are merged per version by a hash aggregation first,
    so a file that holds a third of all rows sends one row per task. The count
    is kept in a filter: without it the optimizer folds both steps into one
    text maximum, which would sort every raw row.
    """
    versions = df.groupBy(source_object).agg(F.count("*").alias("_n")).filter("_n > 0")
    file = F.split_part(F.col(source_object), F.lit("@"), F.lit(1))
    return versions.groupBy(file.alias("file")).agg(F.max(source_object).alias(source_object))


def keep_current(df: DataFrame, source_object: str = "_source_object") -> DataFrame:
    """D2. Semi-join with the current versions; adaptive execution broadcasts them by their measured bytes."""
    current = current_versions(df, source_object).select(source_object)
    return df.join(current, source_object, "left_semi")


def in_scope_product(product: Column, prefix: str) -> Column:
    """D3. Plain prefix test, which Parquet can push down."""
    return product.startswith(prefix)


def out_of_window(month: Column, start: str, end: str) -> Column:
    """D4. An unreadable date is not out of scope; it goes on to validation."""
    inside = month.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return F.coalesce(~inside, F.lit(False))


def months_in_scope(start: str, end: str) -> int:
    """D5. Both arguments ``YYYY-MM…``; both ends count."""
    (y0, m0), (y1, m1) = [map(int, d.split("-")[:2]) for d in (start, end)]
    return (y1 - y0) * 12 + (m1 - m0) + 1


def build_panel(
    df: DataFrame,
    keys: Sequence[str],
    date: Column,
    quantity: Column,
    value: Column,
    sentinel: int = -1,
    month: str = "month",
) -> DataFrame:
    """D7–D9. Sum per month and key.

    A masked quantity counts in the value but not in the quantity. Values are
    summed exactly, so totals do not depend on row order.
    Partial aggregation runs before the only shuffle.
    """
    return (
        df.groupBy(month_start(date).alias(month), *keys)
        .agg(
            F.sum(F.when(quantity >= 0, quantity).otherwise(0)).cast("bigint").alias("qty_disclosed"),
            F.count_if(quantity == sentinel).alias("masked_rows"),
            exact_total(value).alias("value"),
        )
    )


def incomplete_keys(panel: DataFrame, keys: Sequence[str], n_months: int) -> DataFrame:
    """D10. Series keys with fewer months than the scope."""
    return panel.groupBy(*keys).agg(F.count("*").alias("months_present")).filter(F.col("months_present") < n_months)


def panel_facts(panel: DataFrame, product: str = "product", month: str = "month") -> DataFrame:
    """D11. Row count, distinct months and the sorted product list, as one row.

    Rows are first merged per (month, product), so the final single row is made
    from calendar × catalogue rows only.
    """
    merged = panel.groupBy(month, product).agg(F.count("*").alias("n"))
    return merged.agg(
        F.sum("n").alias("rows"),
        F.countDistinct(month).alias("months"),
        F.array_join(F.sort_array(F.collect_set(product)), "|").alias("products"),
    )


@dataclass(frozen=True)
class PanelContract:
    """Names and limits of one text source that becomes a panel."""

    entity: str
    product: str
    date: str
    quantity: str
    value: str
    domain: tuple[str, ...]
    product_prefix: str
    start: str
    end: str
    as_of: str
    decimal: str = ","
    sentinel: int = -1
    source_object: str = "_source_object"


def staged_rows(bronze: DataFrame, c: PanelContract) -> DataFrame:
    """D2–D6. Every bronze row with the ``stage`` at which it leaves, and its ``reason``.

    Text is parsed below the version join (a left join that adaptive
    execution broadcasts by measured bytes) and tested above it, so a filter on the stage never repeats the
    parsing. Nothing is dropped here, so the funnel can count every row. The versions are read from one column.
    """
    current = current_versions(bronze, c.source_object).select(F.col(c.source_object), F.lit(True).alias("_current"))
    typed = bronze.withColumns(quality.typed_columns(c.date, c.quantity, c.value, c.decimal))
    rules = quality.panel_rules(c.entity, c.domain, c.as_of, c.sentinel)
    stage = (
        F.when(F.col("_current").isNull(), STAGES[0])
        .when(F.coalesce(~in_scope_product(F.col(c.product), c.product_prefix), F.lit(True)), STAGES[1])
        .when(out_of_window(month_start(F.col("_day")), c.start, c.end), STAGES[2])
        .when(F.col("reason").isNotNull(), STAGES[3])
        .otherwise(STAGES[4])
    )
    return (
        typed.join(current, c.source_object, "left")
        .withColumn("reason", quality.first_reason(rules))
        .withColumn("stage", stage)
        .drop("_current")
    )


@dataclass(frozen=True)
class SilverTables:
    table: DataFrame
    quarantine: DataFrame
    report: DataFrame


def stage_panel(bronze: DataFrame, c: PanelContract, folder: str) -> None:
    """D6, D20. One pass over bronze: what goes on is written to ``folder`` by stage, the funnel is counted on the way.

    Rows that leave earlier are counted only. Rows to be summed keep their parsed fields, quarantined ones
    their text, so later plans read no more than they need. The funnel is written last and marks the folder as whole.
    """
    counts = Observation("funnel")
    rows = staged_rows(bronze, c).observe(counts, F.count(F.lit(1)).alias("read"), *[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    rows = rows.filter(F.col("stage").isin(*STAGES[3:]))
    summed = F.col("stage") == STAGES[4]
    text = {n: F.when(~summed, F.col(n)) for n in bronze.columns if n not in (c.entity, c.product)}
    parsed = {n: F.when(summed, F.col(n)) for n in ("_day", "_quantity", "_value")}
    rows.withColumns(text | parsed).drop("_fault").write.mode("overwrite").partitionBy("stage").parquet(f"{folder}/rows")
    funnel = bronze.sparkSession.createDataFrame([tuple(counts.get[n] for n in ("read", *STAGES))], ", ".join(f"{n} long" for n in ("read", *STAGES)))
    funnel.write.mode("overwrite").parquet(f"{folder}/funnel")


def staged_panel(bronze: DataFrame, c: PanelContract, folder: str, load_id: str, source_system: str, run_at: str) -> SilverTables:
    """D20. Panel, quarantine and funnel of what :func:`stage_panel` has written; ``bronze`` gives the columns only."""
    spark = bronze.sparkSession
    parsed = StructType.fromDDL(f"_day date, _quantity long, _value {MONEY}, reason string, stage string")
    staged = spark.read.schema(StructType([*bronze.schema.fields, *parsed.fields])).parquet(f"{folder}/rows")
    panel = build_panel(
        staged.filter(F.col("stage") == STAGES[4]).withColumnsRenamed({c.entity: "entity", c.product: "product"}),
        ["entity", "product"],
        F.col("_day"),
        F.col("_quantity"),
        F.col("_value"),
        c.sentinel,
    ).withColumn("_load_id", F.lit(load_id))
    rejected = staged.filter(F.col("stage") == STAGES[3]).select(*bronze.columns, "reason")
    table = quality.quarantine_table(rejected, load_id, source_system, c.source_object, run_at)
    funnel = StructType.fromDDL(", ".join(f"{n} long" for n in ("read", *STAGES)))
    return SilverTables(panel, table, spark.read.schema(funnel).parquet(f"{folder}/funnel"))


def build_silver_panel(bronze: DataFrame, c: PanelContract, load_id: str, source_system: str, run_at: str, folder: str | None = None) -> SilverTables:
    """D20. Panel, quarantine and funnel of one text source, from one pass over it.

    The pass runs now, unless ``folder`` holds its result already. Without a folder it gets one of its own.
    """
    spark = bronze.sparkSession
    folder = folder or f"{shared_dir(spark)}/silver/{uuid.uuid4().hex}"
    if not path_exists(spark, f"{folder}/funnel/_SUCCESS"):
        stage_panel(bronze, c, folder)
    return staged_panel(bronze, c, folder, load_id, source_system, run_at)


# ---- daily readings to a month-end series ---------------------------------


def _day_readings(readings: DataFrame, date: str, value: str, read_at: str) -> DataFrame:
    """Readings merged per (day, instant): value range instead of the rows.

    A day with a third of all readings is reduced by the partial aggregation
    before it is shuffled, so no task ever sees the raw day.
    """
    return (
        readings.groupBy(day_key(F.col(date)).alias("day"), F.col(read_at).alias("read_at"))
        .agg(
            F.min(value).alias("low"),
            F.max(value).alias("high"),
            F.count("*").alias("n"),
        )
        .groupBy("day")
        .agg(
            F.max_by(F.struct("read_at", "low", "high", "n"), "read_at").alias("last"),
            F.sum("n").alias("readings"),
        )
        .select("day", "readings", "last.*")
    )


def current_readings(readings: DataFrame, date: str, value: str, read_at: str) -> DataFrame:
    """D13–D16. One row per day: the latest reading, or ``ambiguous`` when tied readings differ.

    A missing value next to a present one is not a second value; the present
    one wins.
    """
    days = _day_readings(readings, date, value, read_at)
    return days.select(
        "day",
        "read_at",
        F.when(F.col("low") == F.col("high"), F.col("low")).alias("value_text"),
        F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("ambiguous"),
        F.col("n").alias("tied_readings"),
        (F.col("readings") - F.col("n")).alias("older_readings"),
    )


def classify_days(days: DataFrame) -> DataFrame:
    """D17. Reason per day from date, value and sign."""
    day, number = to_day(F.col("day")), to_number(F.col("value_text"))
    rules = [
        (quality.DUPLICATE_KEY, F.col("ambiguous")),
        (quality.BAD_TYPE, day.isNull() | number.isNull()),
        (quality.NEGATIVE_VALUE, quality.negative(number)),
    ]
    return days.select("*", day.alias("date"), number.alias("number"), quality.first_reason(rules).alias("reason"))


def month_end(days: DataFrame, day: str = "date", value: str = "number", out: str = "rate") -> DataFrame:
    """D18. Value on the last valid day of each month."""
    return days.groupBy(month_start(F.col(day)).alias("month")).agg(F.max_by(value, day).alias(out))


def month_stage(month: Column, start: str, end: str, as_of: str) -> Column:
    """D19. Outside the scope, not closed yet, or kept."""
    return (
        F.when(out_of_window(month, start, end), F.lit("month_out_of_scope"))
        .when(month >= month_start(F.lit(as_of).cast("date")), F.lit("month_not_closed"))
        .otherwise(F.lit("kept"))
    )


def build_silver_series(
    bronze: DataFrame,
    series: str,
    start: str,
    end: str,
    as_of: str,
    load_id: str,
    source_system: str,
    run_at: str,
    date: str = "date_text",
    value: str = "value_text",
    read_at: str = "_ingestion_timestamp",
    source_object: str = "_source_object",
) -> SilverTables:
    """D20. Month-end series, quarantine and counters of one daily source.

    Quarantined days go back to their raw rows by a semi-join on (day, instant);
    adaptive execution picks the side to broadcast from measured sizes.
    """
    mine = bronze.filter(F.col(source_object) == series)
    days = classify_days(current_readings(mine, date, value, read_at))
    monthly = month_end(days.filter("reason IS NULL")).withColumn(
        "stage", month_stage(F.col("month"), start, end, as_of)
    )
    table = monthly.filter("stage = 'kept'").select("month", "rate", F.lit(load_id).alias("_load_id"))

    bad = days.filter("reason IS NOT NULL").select(
        F.col("day").alias("_day"), F.col("read_at").alias("_at"), "reason", "ambiguous", "value_text"
    )
    raw = mine.withColumn("_day", day_key(F.col(date)))
    joined = raw.join(bad.withColumnRenamed("value_text", "_v"), "_day").filter(F.col(read_at).eqNullSafe(F.col("_at")))
    ambiguous = joined.filter("ambiguous").select(*bronze.columns, "reason")
    single = (
        joined.filter(~F.col("ambiguous") & F.col(value).eqNullSafe(F.col("_v")))
        .select(*bronze.columns, "reason", "_day")
        .groupBy("_day", "reason")
        .agg(F.min(F.struct(*bronze.columns)).alias("row"))
        .select("row.*", "reason")
    )
    quarantine = quality.quarantine_table(
        ambiguous.unionByName(single), load_id, source_system, source_object, run_at
    )
    report = (
        long_counts(
            bronze, read=F.count("*"), other_series=F.count_if(~F.col(source_object).eqNullSafe(series))
        )
        .unionByName(
            long_counts(
                days,
                older_readings=F.coalesce(F.sum("older_readings"), F.lit(0)),
                valid_days=F.count_if(F.col("reason").isNull()),
            )
        )
        .unionByName(
            long_counts(
                monthly,
                **{s: F.count_if(F.col("stage") == s) for s in ("month_out_of_scope", "month_not_closed", "kept")},
            )
        )
    )
    return SilverTables(table, quarantine, report)
