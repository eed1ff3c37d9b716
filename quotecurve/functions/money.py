"""Money as whole cents: exact sums and one rounding rule (half up)."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def to_cents(amount: Column) -> Column:
    """Whole cents of an amount, rounded half up; exact for amounts below 10^13."""
    return F.round(amount.cast("double") * F.lit(100)).cast("bigint")


def from_cents(cents: Column) -> Column:
    """Exact two-place decimal of a whole number of cents."""
    return (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def divide_half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number division of non-negative values rounded half up; NULL when dividing by 0."""
    doubled = F.nullif(denominator * F.lit(2), F.lit(0).cast("bigint"))
    return F.call_function("div", numerator * F.lit(2) + denominator, doubled)


def discounted_cents(list_cents: Column, percent: Column) -> Column:
    """Price in cents after a whole-percent discount, rounded half up."""
    return divide_half_up(list_cents * (F.lit(100) - percent), F.lit(100).cast("bigint"))
