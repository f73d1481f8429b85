"""Exact money sums in primitive arithmetic.

A sum of doubles depends on the order in which partitions are merged. A sum of
decimals wider than 18 digits does not, but allocates an object per row. Here
amounts become whole units in a bigint, and each amount is summed as a high
and a low part. The low parts stay in range for 2**43 rows. Should the high
parts ever leave it, ANSI mode, the default, raises an error.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20
_LOW_MASK = (1 << _LOW_BITS) - 1

#: Fraction of one currency unit that `discounted_units` counts in.
UNIT = Decimal("0.0001")


# Amounts and percents beyond these could leave a bigint when multiplied.
_MOST_CENTS = 1e14
_MOST_PERCENT = 1e4


def _hundredths(value: Column, most: float) -> tuple[Column, Column]:
    """Whole hundredths as a double, and whether `value` is that many and no more than `most`.

    NaN is larger than any number in comparisons, so it is out of range.
    """
    whole = F.rint(value * 100)
    return whole, (whole / 100 == value) & (F.abs(whole) <= most)


def discounted_units(price: Column, discount: Column) -> Column:
    """`price * (1 - discount)` in ten-thousandths, as a bigint; null if either is.

    Prices must be whole cents and discounts whole percents. Any other value,
    NaN and amounts beyond 10**14 cents raise an error, in ANSI mode or not,
    since rounding them would lose digits unseen.
    """
    cents, cents_exact = _hundredths(price, _MOST_CENTS)
    percent, percent_exact = _hundredths(discount, _MOST_PERCENT)
    units = cents.cast("bigint") * (F.lit(100).cast("bigint") - percent.cast("bigint"))
    wrong = F.concat(
        F.lit("not whole cents and percents in range: price "), price.cast("string"), F.lit(", discount "), discount.cast("string")
    )
    return F.when(cents_exact & percent_exact, units).when(
        price.isNotNull() & discount.isNotNull(), F.raise_error(wrong).cast("bigint")
    )


def high_part(units: Column) -> Column:
    return F.shiftright(units, _LOW_BITS)


def low_part(units: Column) -> Column:
    return units.bitwiseAND(F.lit(_LOW_MASK).cast("bigint"))


def amount(high_sum: Column, low_sum: Column) -> Column:
    """The decimal(38,4) amount whose high and low parts have these sums."""
    high = high_sum.cast("decimal(20,0)") * F.lit(1 << _LOW_BITS).cast("decimal(7,0)")
    return ((high + low_sum.cast("decimal(20,0)")) * F.lit(UNIT)).cast("decimal(38,4)")
