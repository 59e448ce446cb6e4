"""Display text: short labels, month names, Brazilian number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations of the published page.
MONTH_NAMES = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
EMPTY = "—"
MINUS = "−"

# Accented letters of Portuguese and their plain forms.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def plain_lower(text: Column) -> Column:
    """Accent-free lower case, for matching on fragments."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def _literal_prefix(prefix: str) -> str:
    return "^\\Q" + prefix + "\\E\\s*"


def product_label(name: Column, prefix: str, general: str) -> Column:
    """F14. Drop the common prefix, cut at a parenthesis, capitalise the rest."""
    rest = F.trim(F.split_part(F.regexp_replace(name, _literal_prefix(prefix), ""), F.lit("("), F.lit(1)))
    capital = F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
    return F.when(F.trim(name) == prefix, F.lit(general)).otherwise(capital)


def month_name(month: Column) -> Column:
    """Abbreviated name of the month a date falls in."""
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(month))


def month_label(month: Column) -> Column:
    """J19. ``2026-06-01`` to ``jun/2026``."""
    return F.concat(month_name(month), F.lit("/"), F.year(month).cast("string"))


def quarter_label(origin: Column, delay: int = 2, horizon: int = 3) -> Column:
    """I7. Months a forecast made at ``origin`` covers, such as ``set–nov/2026``."""
    first = F.add_months(origin, delay + 1)
    last = F.add_months(origin, delay + horizon)
    return F.concat(month_name(first), F.lit("–"), month_label(last))


def number_text(value: Column, places: int = 2) -> Column:
    """J19. Thousands dot, decimal comma; missing becomes a dash."""
    fixed = F.translate(F.format_number(value, places), ",.", ".,")
    return F.coalesce(fixed, F.lit(EMPTY))


def percent_text(fraction: Column, places: int = 1) -> Column:
    return F.when(fraction.isNull(), F.lit(EMPTY)).otherwise(
        F.concat(number_text(fraction * 100, places), F.lit("%"))
    )


def signed_text(value: Column, places: int = 2) -> Column:
    """J19. Typographic minus; no sign when the rounded value is zero."""
    rounded = F.round(value, places)
    sign = F.when(rounded > 0, F.lit("+")).when(rounded < 0, F.lit(MINUS)).otherwise(F.lit(""))
    return F.when(value.isNull(), F.lit(EMPTY)).otherwise(F.concat(sign, number_text(F.abs(rounded), places)))


def currency_text(value: Column) -> Column:
    """J19. Reais at the most readable scale."""
    def scaled(divisor: float, places: int, unit: str) -> Column:
        return F.concat(F.lit("R$ "), number_text(value / F.lit(divisor), places), F.lit(" " + unit))

    return (
        F.when(value.isNull(), F.lit(EMPTY))
        .when(value == 0, F.lit("R$ 0"))
        .when(value >= 1e12, scaled(1e12, 2, "tri"))
        .when(value >= 1e9, scaled(1e9, 1, "bi"))
        .when(value >= 1e6, scaled(1e6, 1, "mi"))
        .otherwise(scaled(1e3, 0, "mil"))
    )
