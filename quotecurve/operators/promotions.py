"""Promotions: base filter, event class, one promotion for each item, standard event dates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import NO_PROMOTION, event_class, event_priority, not_clearance
from .shipments import Scope

# States and deal types that count as promotions.
APPROVAL_STATES = ("Approved", "Scheduled")
PROMOTION_TYPES = ("Best Deal", "Deal of the Day", "Lightning Deal", "Event Deal")
# Fixed value: dates used by fewer promotions are not a standard.
MIN_STANDARD_FREQUENCY = 3

PROMO_KEYS = ["promotion_key", "region_id", "market_id"]
SCOPE_KEYS = ["region_id", "market_id", "product_group"]


def counts_as_promotion() -> Column:
    """Whether state and deal type are those of a promotion that was run."""
    return F.col("approval_status").isin(*APPROVAL_STATES) & F.col("promotion_type").isin(*PROMOTION_TYPES)


def filter_promotions(promotions: DataFrame, scope: Scope) -> DataFrame:
    """Promotions that start in the window (both days included) with a usable state, type and title.

    Day bounds are compared to the bare timestamp, so they prune files and row groups.
    """
    return promotions.where(
        (F.col("region_id") == scope.region_id)
        & (F.col("market_id") == scope.market_id)
        & (F.col("start_ts") >= scope.window_start)
        & (F.col("start_ts") < F.date_add(scope.window_end, 1))
        & counts_as_promotion()
        & not_clearance(F.col("title"))
    )


def base_promotions(promotions: DataFrame, promotion_items: DataFrame, scope: Scope) -> DataFrame:
    """Promotions with their items, without duplicates."""
    items = promotion_items.withColumn("product_group", F.col("product_group").cast("int"))
    if scope.product_groups is not None:
        items = items.where(F.col("product_group").isin(*scope.product_groups))
    return (
        filter_promotions(promotions, scope)
        .join(items, PROMO_KEYS, "inner")
        .select(
            *SCOPE_KEYS,
            "item_id",
            "promotion_key",
            "title",
            "start_ts",
            "end_ts",
            "promo_price",
            "discount_percent",
        )
        .distinct()
    )


def raw_events(base: DataFrame) -> DataFrame:
    """Event class and days of each promoted item."""
    return base.select(
        *SCOPE_KEYS,
        "item_id",
        "promotion_key",
        F.to_date("start_ts").alias("promo_start"),
        F.to_date("end_ts").alias("promo_end"),
        F.year("start_ts").alias("event_year"),
        F.month("start_ts").alias("event_month"),
        event_class(F.col("title"), F.col("start_ts")).alias("event_name"),
    ).distinct()


def promotion_details(events: DataFrame, by_year: bool = False) -> DataFrame:
    """The leading promotion of each item (of each item and year with `by_year`).

    Lowest priority number, then earliest start, then lowest key. A minimum is combined
    before the shuffle, so an item with very many promotions costs no more than others.
    """
    keys = ["item_id", "event_year"] if by_year else ["item_id"]
    kept = [*SCOPE_KEYS, "promotion_key", "event_name", "promo_start", "promo_end"]
    if not by_year:
        kept.append("event_year")
    order = F.struct(
        event_priority(F.col("event_name")), "promo_start", "promotion_key", *SCOPE_KEYS, "promo_end"
    )
    lead = events.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("lead"))
    return lead.select(
        *[F.col(f"lead.{c}").alias(c) for c in SCOPE_KEYS],
        "item_id",
        F.col("lead.promotion_key").alias("promotion_key"),
        F.col("lead.event_name").alias("event_name"),
        F.col("event_year") if by_year else F.col("lead.event_year").alias("event_year"),
        F.col("lead.promo_start").alias("promo_start"),
        F.col("lead.promo_end").alias("promo_end"),
    )


def event_date_frequency(details: DataFrame, min_frequency: int = MIN_STANDARD_FREQUENCY) -> DataFrame:
    """How many promoted items share the dates of an event and year, if that is often enough."""
    counts = details.groupBy(*SCOPE_KEYS, "event_name", "event_year", "promo_start", "promo_end").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.where(F.col("frequency") >= min_frequency)


def event_standards(details: DataFrame, min_frequency: int = MIN_STANDARD_FREQUENCY) -> DataFrame:
    """The most used dates of each event and year, if used often enough.

    Ties go to the earlier start, then the earlier end, then the lower scope keys.
    """
    dates = ["promo_start", "promo_end"]
    counts = event_date_frequency(details.where(F.col("event_name") != NO_PROMOTION), min_frequency)
    best = counts.groupBy("event_name", "event_year").agg(
        F.min_by(
            F.struct(*SCOPE_KEYS, *dates, "frequency"), F.struct(-F.col("frequency"), *dates, *SCOPE_KEYS)
        ).alias("best")
    )
    return best.select("event_name", "event_year", "best.*")


def consolidated_promotions(details: DataFrame, standards: DataFrame) -> DataFrame:
    """Promotions moved to the standard dates of their event and year, where there are any.

    `standards` has at most one row for each event class and year (a dozen classes), so it
    is safe to broadcast at any data size, and one common class cannot skew the join.
    """
    lookup = standards.select(
        "event_name",
        "event_year",
        F.col("promo_start").alias("standard_start"),
        F.col("promo_end").alias("standard_end"),
    )
    dated = details.withColumn("event_year", F.year("promo_start"))
    return dated.join(F.broadcast(lookup), ["event_name", "event_year"], "left").select(
        *SCOPE_KEYS,
        "item_id",
        "event_name",
        "event_year",
        F.coalesce("standard_start", "promo_start").alias("promo_start"),
        F.coalesce("standard_end", "promo_end").alias("promo_end"),
    )
