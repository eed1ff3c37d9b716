"""Report texts: money, units, signed amounts, labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"

# Bounds of the three demand classes, on the size of the slope.
ELASTIC_FROM = 1.05
INELASTIC_TO = 0.95


def product_label(tag: Column, variation: Column, item_id: Column) -> Column:
    """Upper-case 'tag variation', whichever part is there, else the item id."""
    joined = F.nullif(F.trim(F.concat_ws(" ", tag, variation)), F.lit(""))
    return F.coalesce(F.upper(joined), item_id)


def money_text(x: Column, places: int = 0) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(x, places)), F.lit(DASH))


def units_text(x: Column) -> Column:
    return F.coalesce(F.format_number(x, 0), F.lit(DASH))


def _sign(x: Column) -> Column:
    return F.when(x >= 0, "+").otherwise("-")


def signed_units_text(x: Column) -> Column:
    return F.coalesce(F.concat(_sign(x), F.format_number(F.abs(x), 0)), F.lit(DASH))


def signed_money_text(x: Column) -> Column:
    return F.coalesce(F.concat(_sign(x), F.lit("$"), F.format_number(F.abs(x), 0)), F.lit(DASH))


def date_text(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(DASH))


def elasticity_label(magnitude: Column) -> Column:
    return F.when(magnitude > 1.0, "ELASTIC").otherwise("INELASTIC")


def demand_class(magnitude: Column) -> Column:
    return (
        F.when(magnitude >= ELASTIC_FROM, "ELASTIC")
        .when(magnitude <= INELASTIC_TO, "INELASTIC")
        .otherwise("BALANCED DEMAND")
    )


def sensitivity_rank_text(score: Column) -> Column:
    """'Top 20% most Sensitive' above the middle, 'Bottom 30% Sensitivity' below it."""
    return F.when(
        score > 50,
        F.concat(F.lit("Top "), F.format_number(F.lit(100) - score, 0), F.lit("% most Sensitive")),
    ).otherwise(F.concat(F.lit("Bottom "), F.format_number(score, 0), F.lit("% Sensitivity")))
