"""Label every sale with the promotion it was really paid under."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import BASELINE, NO_PROMOTION
from ..functions.money import MONEY
from .joins import SALT

SALE_KEYS = ["item_id", "item_name", "order_date", "price"]
# Promotions and sales meet on (item, slot of days) so that a popular item is spread
# over its weeks instead of comparing all its sales with all its promotions.
SLOT_DAYS = 7


def daily_sales(orders: DataFrame) -> DataFrame:
    """Units and revenue by item, day and price.

    Attribution looks only at these keys, so summing first changes no result, and a hot
    item shrinks to its days and price points before any join. Orders that are dealt out by item
    and a salt of day and price are summed where they are.
    """
    dealt = [SALT] if SALT in orders.columns else []
    summed = orders.groupBy(*SALE_KEYS, *dealt).agg(
        F.sum("shipped_units").alias("shipped_units"),
        F.sum("revenue_share_amt").cast(MONEY).alias("revenue_share_amt"),
    )
    return summed.drop(SALT)


def _slot(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(SLOT_DAYS)).cast("int")


def _in_slots(spans: DataFrame, first: Column, last: Column, sales: DataFrame, name: str) -> DataFrame:
    """`spans` once for each slot between two days.

    Only days with sales matter, so one without a real end gets no more slots than they span.
    """
    held = sales.agg(F.struct(F.min("order_date").alias("first"), F.max("order_date").alias("last")).alias("held"))
    return (
        spans.withColumn("held", held.scalar())
        .withColumn("from", F.greatest(first, F.col("held.first")))
        .withColumn("to", F.least(last, F.col("held.last")))
        .where(F.col("held.first").isNotNull() & (first <= last) & (F.col("from") <= F.col("to")))
        .withColumn(name, F.explode(F.sequence(_slot(F.col("from")), _slot(F.col("to")))))
        .drop("held", "from", "to")
    )


def in_event_window(sales: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Event of the item's leading promotion when the order day lies in its (standard) dates.

    Windows are as many as promoted items but a few MB as a file, which is what Spark's size
    estimate goes by; merged, they never pass the driver. They meet sales by item and slot, as
    promotions do: both joins and the sums after them are then made where the rows are.
    """
    windows = consolidated.select(
        F.col("item_id").alias("window_item"),
        F.col("event_name").alias("window_event"),
        "promo_start",
        "promo_end",
    )
    windows = _in_slots(windows, F.col("promo_start"), F.col("promo_end"), sales, "window_slot")
    hit = (
        (F.col("item_id") == F.col("window_item"))
        & (_slot(F.col("order_date")) == F.col("window_slot"))
        & F.col("order_date").between(F.col("promo_start"), F.col("promo_end"))
    )
    return sales.join(windows.hint("merge"), hit, "left").drop("window_item", "window_slot")


def with_promo_price(windowed: DataFrame, base: DataFrame, dedupe: bool = False) -> DataFrame:
    """Price and discount of the promotions in force on the order day.

    Only sales inside an event window look for a promotion. The start is a timestamp and
    the order date is midnight, so the first day counts only when the start is midnight.
    Several promotions in force repeat the sale (`copies` keeps the count); `dedupe` keeps
    the earliest one. Terms are merged like windows: the estimate also leaves out their slots.
    """
    terms = (
        base.where(F.col("start_ts") <= F.col("end_ts"))
        .groupBy(F.col("item_id").alias("promo_item"), "start_ts", "end_ts", "promo_price", "discount_percent")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    terms = _in_slots(terms, F.to_date("start_ts"), F.to_date("end_ts"), windowed, "promo_slot")
    hit = (
        (F.col("item_id") == F.col("promo_item"))
        & (_slot(F.col("order_date")) == F.col("promo_slot"))
        & F.col("window_event").isNotNull()
        & F.col("order_date").cast("timestamp_ntz").between(F.col("start_ts"), F.col("end_ts"))
    )
    joined = windowed.join(terms.hint("merge"), hit, "left").drop("promo_item", "promo_slot")
    if dedupe:
        keys = [*SALE_KEYS, "window_event"]
        lead = F.min_by(
            F.struct("promo_price", "discount_percent"),
            F.struct("start_ts", "end_ts", "promo_price", "discount_percent"),
        )
        return (
            joined.groupBy(*keys)
            .agg(
                F.first("shipped_units").alias("shipped_units"),
                F.first("revenue_share_amt").alias("revenue_share_amt"),
                lead.alias("lead"),
            )
            .select(*keys, "shipped_units", "revenue_share_amt", "lead.*", F.lit(1).alias("copies"))
        )
    return joined.drop("start_ts", "end_ts").withColumn("copies", F.coalesce("copies", F.lit(1)))


def paid_event() -> Column:
    """BAU when the paid price differs from the promotion price, or there is no event.

    A missing promotion price compares as unknown, so the event then stays.
    """
    event = F.col("window_event")
    return (
        F.when(F.col("promo_price") != F.col("price"), BASELINE)
        .when(event.isNull() | (event == NO_PROMOTION), BASELINE)
        .otherwise(event)
    )


def paid_discount() -> Column:
    return F.when(F.col("promo_price") != F.col("price"), F.lit(0.0)).otherwise(
        F.coalesce(F.round("discount_percent", 2), F.lit(0.0))
    )


def attributed_rows(windowed_priced: DataFrame) -> DataFrame:
    """Event and discount for each sale row before the final roll-up."""
    return windowed_priced.withColumn("event_name", paid_event()).withColumn(
        "deal_discount_percent", paid_discount()
    )


def attribute_sales(
    orders: DataFrame, consolidated: DataFrame, base: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Sales by item, day, price and paid event.

    Promotion price and discount are grouping keys but not output columns, so rows that
    look equal can appear more than once.
    """
    return attribute_daily(daily_sales(orders), consolidated, base, dedupe)


def attribute_daily(
    daily: DataFrame, consolidated: DataFrame, base: DataFrame, dedupe: bool = False
) -> DataFrame:
    """`attribute_sales` of sums by item, day and price."""
    priced = with_promo_price(in_event_window(daily, consolidated), base, dedupe)
    # the slot follows from the day; as a key it tells that the rows of a group are together already
    rolled = priced.groupBy(*SALE_KEYS, _slot(F.col("order_date")), "window_event", "promo_price", "discount_percent").agg(
        F.sum(F.col("shipped_units") * F.col("copies")).alias("shipped_units"),
        F.sum(F.col("revenue_share_amt") * F.col("copies")).cast(MONEY).alias("revenue"),
    )
    return rolled.select(
        "item_id",
        "item_name",
        "order_date",
        "price",
        paid_event().alias("event_name"),
        paid_discount().alias("deal_discount_percent"),
        F.col("shipped_units").cast("int").alias("shipped_units"),
        "revenue",
    )
