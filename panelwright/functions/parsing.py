"""Text to number, date and day key; failures become NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
EXPONENT_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+\s*$"
DATE_PATTERN = r"^\d{4}-\d{1,2}(-\d{1,2})?$"


def to_number(text: Column, decimal: str = ".") -> Column:
    """C2. Every decimal separator is replaced, so ``1.234,56`` is not a number.

    A letter marks what a Spark cast would accept but a number is not
    (``1.0d``, ``NaN``, ``Infinity``); only the exponent form passes with one.
    What overflows a double ends as NULL, whatever the length of the text.
    """
    plain = text if decimal == "." else F.replace(text, F.lit(decimal), F.lit("."))
    number = plain.try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    without_letter = F.lower(plain) == F.upper(plain)  # cheaper than a pattern, which only the exponent form needs
    return F.when(number.isNotNull() & (without_letter | plain.rlike(EXPONENT_PATTERN)), finite)


def to_integer(text: Column) -> Column:
    """Whole number from a pure integer literal; ``10.0`` is not one, and one beyond 64 bits ends as NULL."""
    return text.try_cast("bigint")


def to_day(text: Column) -> Column:
    """C3. ``YYYY-MM-DD``, else ``YYYY-MM`` as the first day; impossible dates are NULL.

    The cast reads both forms and never throws, unlike a formatter on bad
    text; the pattern keeps out the other forms it would accept.
    """
    return F.when(text.rlike(DATE_PATTERN), text.try_cast("date"))


def day_key(text: Column) -> Column:
    """D13. First ten characters; the zone suffix of the source alternates."""
    return F.substring(F.coalesce(text, F.lit("")), 1, 10)


def month_start(day: Column) -> Column:
    """D7. First day of the month, as a date."""
    return F.trunc(day, "MM")


def month_index(month: Column) -> Column:
    """Months since year 0: consecutive months differ by exactly one."""
    return F.year(month) * 12 + F.month(month)
