"""Promotion titles to event classes, and the rank of each class."""

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each event class with its title patterns, and the (month, first day of that month) in one of
# which it must start, if it is bound to a season. Order matters: the first class that fits wins.
EVENT_PATTERNS = [
    ("BSS", ["%BSS%", "%BIG SPRING SALE%"], None),
    ("PRIME DAY", ["%PRIME%DAY%", "%PD%", "%PEBD%"], [(6, 25), (7, 1)]),
    ("PBDD", ["%PBDD%"], None),
    ("BLACK FRIDAY", ["%BF%", "%BLACK%FRIDAY%"], None),
    ("CYBER MONDAY", ["%CYBER%MONDAY%", "%CM%"], None),
    ("BOXING WEEK", ["%BOXING WEEK%", "%BOXING DAY%"], None),
    ("T5/11/12", ["%T5%", "%T11%", "%T12%"], None),
    ("PET MONTH", ["%PET MONTH%"], None),
    ("BACK TO SCHOOL", ["%BACK%TO%SCHOOL%"], None),
    ("BACK TO UNIVERSITY", ["%BACK%TO%UNIVERSITY%"], None),
]
OTHER_PROMOTION = "OTHER_PROMOTION"
NO_PROMOTION = "NO_PROMOTION"
BASELINE = "BAU"

# Rank of a class when one item has several promotions.
EVENT_PRIORITY = {
    "PRIME DAY": 1,
    "BSS": 1,
    "PBDD": 1,
    "T5/11/12": 1,
    "BLACK FRIDAY": 2,
    "CYBER MONDAY": 3,
    "BOXING WEEK": 4,
    "NYNY": 5,
}
DEFAULT_PRIORITY = 99

# Fixed value: titles with this mark are clearance and never count as promotions.
CLEARANCE_PATTERN = "%OIH%"


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found


def event_class(title: Column, start: Column) -> Column:
    """Event class of a promotion from its title and start; a title without a match is OTHER_PROMOTION."""
    text = F.upper(title)
    result = None
    for name, patterns, season in EVENT_PATTERNS:
        hit = _any([text.like(p) for p in patterns])
        if season:
            hit = hit & _any([(F.month(start) == m) & (F.dayofmonth(start) >= d) for m, d in season])
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise(OTHER_PROMOTION)


def event_priority(event: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in EVENT_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, event), F.lit(DEFAULT_PRIORITY))


def not_clearance(title: Column) -> Column:
    """True for usable titles; a missing title gives NULL and so drops the row in a filter."""
    return ~F.upper(title).like(CLEARANCE_PATTERN)


def is_baseline(event: Column) -> Column:
    return event.isNull() | (F.upper(event) == BASELINE)


def as_date(value: str | date) -> Column:
    return F.to_date(F.lit(str(value)))
