"""C. Row checks, first-match reasons and the quarantine table.

Every check is one boolean Column (True: the row fails), so a whole contract
is a single narrow projection inside codegen: no shuffle, no Python.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.money import to_money
from panelwright.functions.parsing import INTEGER_PATTERN, to_day, to_integer, to_number

log = logging.getLogger(__name__)

BAD_ENTITY = "bad_entity"
BAD_TYPE = "bad_type"
TOO_LARGE = "number_too_large"
DATE_OUT_OF_RANGE = "date_out_of_range"
NEGATIVE_VALUE = "negative_value"
DUPLICATE_KEY = "duplicate_key"

Rule = tuple[str, Column]


def outside_domain(value: Column, domain: Sequence[str]) -> Column:
    """C1. Case-sensitive membership; NULL is outside."""
    return F.coalesce(~value.isin(*domain), F.lit(True))


def bad_type(text: Column, kind: str, decimal: str = ".") -> Column:
    """C4. ``float``, ``int`` or ``date``. The form alone counts; whether a number fits is a rule of its own."""
    if kind == "float":
        return to_number(text, decimal).isNull()
    if kind == "int":
        return F.coalesce(~text.rlike(INTEGER_PATTERN), F.lit(True))
    if kind == "date":
        return to_day(text).isNull()
    raise ValueError(f"unknown type: {kind}")


def negative(number: Column, sentinel: float | None = None) -> Column:
    """C5. Below zero, except the value that means "not disclosed"."""
    below = number < 0
    if sentinel is not None:
        below = below & (number != sentinel)
    return F.coalesce(below, F.lit(False))


def in_future(day: Column, as_of: str) -> Column:
    """C6."""
    return F.coalesce(day > F.lit(as_of).cast("date"), F.lit(False))


def outside_interval(day: Column, start: str, as_of: str) -> Column:
    """C7. NULL fails."""
    inside = day.between(F.lit(start).cast("date"), F.lit(as_of).cast("date"))
    return F.coalesce(~inside, F.lit(True))


def first_reason(rules: Sequence[Rule]) -> Column:
    """C8. Reason of the first failing rule, NULL for a valid row."""
    return F.coalesce(*[F.when(mask, F.lit(name)) for name, mask in rules])


def typed_columns(date: str, quantity: str, value: str, decimal: str = ",") -> dict[str, Column]:
    """Parsed forms of the text columns, named ``_day``, ``_quantity`` and ``_value``, and ``_fault``.

    Parsed once and then only compared: every rule below is a cheap test. ``_fault`` tells text of the wrong
    form from numbers that are right but too large to be kept exactly; only rows without a parsed form are
    looked at again for it.
    """
    day, count, amount = to_day(F.col(date)), to_integer(F.col(quantity)), to_money(F.col(value), decimal)
    no_number = F.when(amount.isNull(), bad_type(F.col(value), "float", decimal)).otherwise(F.lit(False))
    no_count = F.when(count.isNull(), bad_type(F.col(quantity), "int")).otherwise(F.lit(False))
    fault = F.when(day.isNull() | no_number | no_count, BAD_TYPE).when(amount.isNull() | count.isNull(), TOO_LARGE)
    return {"_day": day, "_quantity": count, "_value": amount, "_fault": fault}


def panel_rules(entity: str, domain: Sequence[str], as_of: str, sentinel: float = -1) -> list[Rule]:
    """The contract of a panel source, in its fixed order, over ``typed_columns``."""
    day, quantity, value = F.col("_day"), F.col("_quantity"), F.col("_value")
    return [
        (BAD_ENTITY, outside_domain(F.col(entity), domain)),
        (BAD_TYPE, F.col("_fault").eqNullSafe(BAD_TYPE)),
        (TOO_LARGE, F.col("_fault").eqNullSafe(TOO_LARGE)),
        (DATE_OUT_OF_RANGE, in_future(day, as_of)),
        (NEGATIVE_VALUE, negative(value) | negative(quantity, sentinel)),
    ]


def classify(df: DataFrame, rules: Sequence[Rule], reason: str = "reason") -> DataFrame:
    return df.withColumn(reason, first_reason(rules))


def split_valid(classified: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """C12. (valid, rejected) as two filters over the same narrow plan."""
    return (
        classified.filter(F.col(reason).isNull()).drop(reason),
        classified.filter(F.col(reason).isNotNull()),
    )


def quarantine_table(
    rejected: DataFrame,
    load_id: str,
    source_system: str,
    source_object: str | None,
    quarantined_at: str,
    reason: str = "reason",
) -> DataFrame:
    """C9/C10. One row per rejected row, with the original row as JSON text."""
    payload = [c for c in rejected.columns if c != reason]
    origin = F.col(source_object) if source_object else F.lit("")
    return rejected.select(
        F.lit(load_id).alias("_load_id"),
        F.lit(source_system).alias("_source_system"),
        origin.alias("_source_object"),
        F.col(reason).alias("reason"),
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"),
        F.lit(quarantined_at).cast("timestamp").alias("quarantined_at"),
    )


def store_quarantine(table: DataFrame, path: str, append: bool = False) -> bool:
    """C9/C10. Replace the quarantine of a rebuilt table, or append to it.

    A failed write is logged and reported, it never stops the job.
    """
    try:
        table.write.mode("append" if append else "overwrite").parquet(path)
        return True
    except Exception:
        log.exception("quarantine not written: %s", path)
        return False


def reason_counts(classified: DataFrame, reason: str = "reason") -> DataFrame:
    """C11. Rejected rows per reason.

    Valid rows are one more group that is dropped after counting; a filter
    before it would evaluate the whole contract a second time.
    """
    return classified.groupBy(reason).agg(F.count(reason).alias("rows")).filter("rows > 0")
