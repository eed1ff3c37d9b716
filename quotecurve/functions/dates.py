"""Date parts, lenient parsing and deterministic fill-in dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range used when sales carry no dates at all.
FILL_START = "2023-09-17"
FILL_END = "2025-09-17"


def lenient_date(x: Column) -> Column:
    """Date from a date, timestamp or text; unreadable becomes NULL."""
    return F.coalesce(x.try_cast("date"), F.to_date(x.try_cast("timestamp_ntz")))


def period_columns(day: Column, granularity: str) -> dict[str, Column]:
    """Key columns of a period, plus its first day.

    The weekly key is calendar year + ISO week + month, so a week that crosses a month
    counts as two periods.
    """
    year, month = F.year(day), F.month(day)
    week = F.weekofyear(day)
    if granularity == "weekly":
        keys = {"year": year, "week": week, "month": month}
        start = F.greatest(F.trunc(day, "week"), F.trunc(day, "month"))
    elif granularity == "monthly":
        keys = {"year": year, "month": month}
        start = F.trunc(day, "month")
    elif granularity == "daily":
        keys = {"year": year, "week": week, "month": month, "day": F.dayofmonth(day)}
        start = day
    else:
        raise ValueError(f"granularity must be daily, weekly or monthly, not {granularity!r}")
    return {**keys, "period_start": start}


def fill_date(row_key: Column, start: str = FILL_START, end: str = FILL_END) -> Column:
    """A day in [start, end) drawn by the hash of the row key: the same on every run."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    draw = F.conv(F.substring(F.md5(row_key), 1, 8), 16, 10).cast("bigint")
    return F.date_add(first, F.pmod(draw, F.datediff(last, first)).cast("int"))
