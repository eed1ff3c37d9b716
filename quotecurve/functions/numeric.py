"""Numeric guards and transforms. NaN never enters a column: bad values become NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacements for unusable observation weights.
WEIGHT_MISSING = 1.0
WEIGHT_INFINITE = 3.0
WEIGHT_FLOOR = 1e-6
# Fixed value: softplus is the identity beyond this point.
SOFTPLUS_LINEAR_FROM = 20.0


def finite(x: Column) -> Column:
    """The value as a double, with NaN and infinities turned into NULL."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def nonneg(x: Column) -> Column:
    """Number from anything: unreadable or missing becomes 0, negatives are clipped at 0."""
    d = x.try_cast("double")
    return F.greatest(F.coalesce(F.when(~F.isnan(d), d), F.lit(0.0)), F.lit(0.0))


def log1p_floor(x: Column) -> Column:
    """ln(1+x) with negatives taken as 0; a missing value stays missing."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def expm1_floor(x: Column) -> Column:
    """exp(x)-1, not below 0; a missing value stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.expm1(x), F.lit(0.0)))


def softplus(x: Column) -> Column:
    return F.when(x > SOFTPLUS_LINEAR_FROM, x).otherwise(F.log1p(F.exp(x)))


def usable_weight(w: Column) -> Column:
    """NaN or missing -> 1, +inf -> 3, zero, negative or -inf -> 1e-6."""
    d = w.try_cast("double")
    return (
        F.when(d.isNull() | F.isnan(d), WEIGHT_MISSING)
        .when(d == F.lit(float("inf")), WEIGHT_INFINITE)
        .when(d <= 0, WEIGHT_FLOOR)
        .otherwise(d)
    )
