"""Amounts of money from text, and sums of them, exact to ten decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,10)"
HIGH, LOW, WHOLE = "decimal(28,0)", "decimal(11,10)", "decimal(36,10)"


def to_money(text: Column, decimal: str = ".") -> Column:
    """C2. The amount as a decimal; NULL for what is no number and for 10^18 or more."""
    return (text if decimal == "." else F.replace(text, F.lit(decimal), F.lit("."))).try_cast(MONEY)


def exact_total(amount: Column) -> Column:
    """D8. The sum of amounts as the double nearest to it, whatever the order of the rows.

    Whole units and what is left of each amount are summed apart, so neither sum overflows within 10^10 rows
    and no digit is lost on the way. Only a total of 10^26 or more is put together in floating point.
    """
    units = F.floor(amount.cast(MONEY))
    high, low = F.sum(units.cast(HIGH)), F.sum((amount - units).cast(LOW))
    exact = high.try_cast(WHOLE) + low.cast("decimal(22,10)")
    return F.coalesce(exact.cast("double"), high.cast("double") + low.cast("double"))
