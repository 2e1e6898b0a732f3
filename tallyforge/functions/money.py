"""Money and rounding.

Money is summed as DECIMAL(18,2), so totals don't depend on the order of rows. Rounding is half towards plus infinity, floor(x * 10^d + 0.5) / 10^d, as the rules of this
domain have it; Spark's own round() goes half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money(amount: Column | str) -> Column:
    """An amount as money; a missing one is 0."""
    c = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))


def total(amount: Column | str, when: Column | None = None) -> Column:
    """Sum of money, of the rows where `when` holds; 0 for none. The sum keeps the scale of money."""
    value = money(amount)
    if when is not None:
        value = F.when(when, value).otherwise(F.lit(0).cast(MONEY))
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def js_round(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / scale


def share(part: Column, whole: Column, digits: int) -> Column:
    """part as a percentage of whole, rounded; 0 where there is no positive whole."""
    return F.when(whole > 0, js_round(part.cast("double") / whole.cast("double") * 100.0, digits)).otherwise(F.lit(0.0))


def italian_text(amount: Column) -> Column:
    """1250.5 as `1250,50 €`: decimal comma, a point between thousands from five digits on."""
    plain = F.format_number(F.abs(amount.cast("double")), 2)
    swapped = F.translate(plain, ",.", ".,")
    short = F.when(F.abs(amount) < 10000, F.replace(swapped, F.lit("."), F.lit(""))).otherwise(swapped)
    return F.concat(F.when(amount < 0, "-").otherwise(""), short, F.lit(" €"))
