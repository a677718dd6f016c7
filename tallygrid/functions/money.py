"""Column helpers for money, quantities and guarded ratios.

Money is decimal(18,2) and quantities decimal(18,4), so sums are exact in any order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
QTY = "decimal(18,4)"
PERCENT = "decimal(9,2)"
CENT = Decimal("0.01")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Round half up to the currency step."""
    return F.round(col(c), 2).cast(MONEY)


def whole(c: Column | str) -> Column:
    """``round(c)`` of a double as bigint, half up on its exact value; without the decimal text that ``round`` makes of each double."""
    y = col(c)
    down = F.floor(y)
    # y - floor(y) is exact
    up = down + F.when(y - down >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when((y >= 0) & (y < 1e15), up).otherwise(F.round(y).cast("bigint"))


def whole_or(c: Column | str, kind: str) -> Column:
    """A double cast to the decimal ``kind``; by way of a bigint where it is a whole number."""
    y = col(c)
    units = F.floor(y)
    return F.when((y >= 0) & (y < 1e12) & (units == y), units.cast(kind)).otherwise(y.cast(kind))


def quantity(c: Column | str, digits: int = 4) -> Column:
    return F.round(col(c), digits).cast(QTY)


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def total(c: Column | str) -> Column:
    """Sum that is 0, not NULL, over no rows."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def sum_when(condition: Column, value: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, col(value))), F.lit(0))


def percent_of(amount: Column | str, percent: Column | str) -> Column:
    """``percent`` % of ``amount``, one rounding."""
    return money(col(amount) * col(percent) * F.lit(CENT))


def less_percent(amount: Column | str, percent: Column | str) -> Column:
    """``amount`` after a discount of ``percent`` %, one rounding."""
    return money(col(amount) * (F.lit(100).cast(PERCENT) - col(percent)) * F.lit(CENT))


def ratio(numerator: Column | str, denominator: Column | str, digits: int = 4, empty: float = 0.0) -> Column:
    """Quotient of decimals, rounded half up and given as a double; ``empty`` when the denominator is 0 or NULL.

    Both sides are taken to four decimals, as many as quantities have: a denominator that is 0 there counts as 0.
    """
    quotient = F.try_divide(col(numerator).cast("decimal(24,4)"), col(denominator).cast("decimal(20,4)"))
    return F.coalesce(F.round(quotient, digits).cast("double"), F.lit(empty))


def percentage(part: Column | str, whole: Column | str, digits: int = 4) -> Column:
    return ratio(col(part).cast("decimal(22,4)") * 100, whole, digits)


def convert_uom(qty: Column | str, factor_from: Column | str, factor_to: Column | str, digits: int = 4) -> Column:
    """Quantity in another unit; a factor is how many of the unit make one reference unit."""
    return quantity(col(qty) / col(factor_from) * col(factor_to), digits)


def floored(c: Column | str) -> Column:
    return F.greatest(col(c), F.lit(0))
