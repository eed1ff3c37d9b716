"""Sales to period rows: product labels, roll-up, top products, label codes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_columns
from ..functions.events import BASELINE, is_baseline
from ..functions.money import divide_half_up, from_cents, to_cents
from ..functions.text import product_label
from ..session import materialise
from .joins import SALT, SALTS, lookup_join, salted_copies
from .ranks import label_codes

# Products kept by default, and the units below which a period is thin.
TOP_N = 10
MIN_PERIOD_UNITS = 5


def with_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Product label and current price of each sale; an unlabelled item is its own product."""
    labels = products.select(
        "item_id",
        product_label(F.col("tag"), F.col("variation"), F.col("item_id")).alias("product"),
        "current_price",
    )
    # salted by month: sums by item and period are then made where the rows are
    mine = (F.col("item_id") == F.col("_item")) & (_month_salt(F.col("order_date")) == F.col(SALT))
    joined = sales.join(salted_copies(labels.withColumnRenamed("item_id", "_item")), mine, "left")
    named = joined.withColumn("product", F.coalesce("product", "item_id"))
    return named.select("item_id", *[c for c in sales.columns if c != "item_id"], "product", "current_price")


def _month_salt(day: Column) -> Column:
    return F.pmod(F.xxhash64(F.year(day) * 12 + F.month(day)), F.lit(SALTS)).cast("int")


def day_masks(sales: DataFrame) -> DataFrame:
    """(item_id, price, month, days): the days of a month on which an item sold at a price, as bits of a number.

    A state that later periods are added to without reading earlier sales again; see `merge_day_masks`.
    """
    month = F.year("order_date") * 12 + F.month("order_date") - 1
    day = F.expr("shiftleft(1L, dayofmonth(order_date) - 1)")
    return sales.groupBy("item_id", "price", month.alias("month")).agg(F.bit_or(day).alias("days"))


def merge_day_masks(*masks: DataFrame) -> DataFrame:
    """One state of several: days that occur in more than one count once."""
    both = masks[0]
    for other in masks[1:]:
        both = both.unionByName(other)
    return both.groupBy("item_id", "price", "month").agg(F.bit_or("days").alias("days"))


def days_of_masks(masks: DataFrame) -> DataFrame:
    """(item_id, price, days_sold) of a merged state."""
    days = F.coalesce(F.sum(F.bit_count("days")), F.lit(0)).cast("bigint")
    return masks.groupBy("item_id", "price").agg(days.alias("days_sold"))


def days_at_price(sales: DataFrame) -> DataFrame:
    """Number of different days on which an item sold at a price."""
    return days_of_masks(day_masks(sales))


def with_days_at_price(sales: DataFrame) -> DataFrame:
    return sales.join(days_at_price(sales), ["item_id", "price"], "inner")


def first_discount() -> Column:
    """The first known discount of a group by date, the lowest on equal dates.

    Date and discount are packed in one number, so the grouping stays a hash aggregate.
    """
    discount = F.col("deal_discount_percent")
    packed = F.unix_date("order_date").cast("bigint") * F.lit(10**10) + F.round(discount * 10**6).cast("bigint")
    return F.min_by(discount, packed)


def roll_up(sales: DataFrame, granularity: str = "weekly") -> DataFrame:
    """Units, revenue and average selling price by item, product, event and period.

    Rows without a key are left out. `price` is revenue over units, to the cent, and 0 for
    a period without units. The discount is the first known one. The current price is one
    for each item.
    """
    periods = period_columns(F.col("order_date"), granularity)
    period_keys = [k for k in periods if k != "period_start"]
    keys = ["item_id", "product", "event_name", *period_keys]
    rows = sales.where(
        F.col("item_id").isNotNull()
        & F.col("product").isNotNull()
        & F.col("event_name").isNotNull()
        & F.col("order_date").isNotNull()
    ).withColumns(periods)

    # the salt of the product lookup follows from year and month; as a key it tells that groups are together already
    rolled = rows.groupBy(*keys, _month_salt(F.col("order_date"))).agg(
        F.min("period_start").alias("period_start"),
        F.sum("shipped_units").alias("shipped_units"),
        F.sum(F.col("shipped_units") * to_cents(F.col("price"))).alias("revenue_cents"),
        first_discount().alias("deal_discount_percent"),
        F.min("current_price").alias("current_price"),
    )
    average = F.coalesce(divide_half_up(F.col("revenue_cents"), F.col("shipped_units")), F.lit(0))
    return rolled.select(
        *keys,
        "period_start",
        "shipped_units",
        from_cents(F.col("revenue_cents")).alias("revenue"),
        "deal_discount_percent",
        "current_price",
        from_cents(average.cast("bigint")).alias("price"),
    )


def top_products(periods: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n products that earn most; equal revenue goes by name."""
    totals = periods.groupBy("product").agg(F.sum("revenue").alias("revenue"))
    return totals.orderBy(F.col("revenue").desc(), "product").limit(n)


def keep_top_products(periods: DataFrame, n: int = TOP_N) -> DataFrame:
    top = top_products(periods, n).select("product")
    return periods.join(top, "product", "left_semi")


def drop_thin_periods(periods: DataFrame, min_units: int = MIN_PERIOD_UNITS) -> DataFrame:
    return periods.where(F.col("shipped_units") >= min_units)


def baseline_only(periods: DataFrame) -> DataFrame:
    return periods.where(is_baseline(F.col("event_name")))


def event_codes(periods: DataFrame) -> DataFrame:
    """0 for the baseline, then 1.. in alphabetical order for the other events."""
    others = periods.select("event_name").where(F.col("event_name") != BASELINE)
    codes = label_codes(others, "event_name").select("event_name", (F.col("code") + 1).alias("event_code"))
    baseline = periods.sparkSession.createDataFrame([(BASELINE, 0)], "event_name string, event_code int")
    return codes.unionByName(baseline)


def product_codes(periods: DataFrame) -> DataFrame:
    return label_codes(periods, "product").withColumnRenamed("code", "product_code")


def with_codes(periods: DataFrame) -> DataFrame:
    spread = ["item_id", "period_start"]
    coded = lookup_join(periods, event_codes(periods), on=["event_name"], spread_by=spread)
    return lookup_join(coded, product_codes(periods), on=["product"], spread_by=spread)


def prepare(
    sales: DataFrame,
    products: DataFrame,
    top_n: int | None = TOP_N,
    granularity: str = "weekly",
    min_units: int = MIN_PERIOD_UNITS,
) -> DataFrame:
    """Period rows of the top products (all products for None), thin periods dropped last."""
    periods = roll_up(with_products(sales, products), granularity)
    if top_n is not None:
        periods = keep_top_products(materialise(periods, "rolled"), top_n)  # read for the ranking and for its rows
    return drop_thin_periods(periods, min_units)


def price_quantity(periods: DataFrame) -> DataFrame:
    """Units sold at each price of each product."""
    return periods.groupBy("price", "product").agg(F.sum("shipped_units").alias("shipped_units"))


def with_default_columns(rows: DataFrame) -> DataFrame:
    """Fill in `asp` (the price), `intercept` (1) and `days_asp_valid` (days sold, or 1)."""
    out = rows
    if "asp" not in out.columns and "price" in out.columns:
        out = out.withColumn("asp", F.col("price").try_cast("double"))
    if "intercept" not in out.columns:
        out = out.withColumn("intercept", F.lit(1.0))
    if "days_asp_valid" not in out.columns:
        days = F.col("days_sold") if "days_sold" in out.columns else F.lit(1).cast("bigint")
        out = out.withColumn("days_asp_valid", days)
    return out


def complete_model_rows(rows: DataFrame, needed: list[str], weight: str = "weight") -> DataFrame:
    """Rows with every model input present, with usable weights."""
    from ..functions.numeric import finite, usable_weight

    typed = rows.withColumns({c: finite(F.col(c)) for c in needed})
    return typed.dropna(subset=needed).withColumn(weight, usable_weight(F.col(weight)))


def standard_scores(rows: DataFrame, column: str) -> DataFrame:
    """Adds `<column>_z`; a column without spread is only centred."""
    stats = rows.agg(
        F.struct(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sd")).alias("s")
    ).scalar()
    sd = F.when(stats["sd"] < 1e-12, 1.0).otherwise(stats["sd"])
    return rows.withColumn(f"{column}_z", (F.col(column) - stats["mu"]) / sd)
