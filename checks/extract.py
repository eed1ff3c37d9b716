"""Checks of the sales extract: shipments, promotions, attribution."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotecurve.operators import attribution as att
from quotecurve.operators import promotions as promo
from quotecurve.operators import shipments as ship
from quotecurve.plans import extract
from quotecurve.sources import retail
from quotecurve.sources.files import stage

from .base import EXTRACT_SCOPE, compose

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


def plain(df: DataFrame, money: tuple[str, ...] = ("price", "revenue", "revenue_share_amt", "promo_price")) -> DataFrame:
    """Money as double for the comparison."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in df.columns])


def _calendar(spark, folder):
    inputs = extract.retail_inputs(spark, folder)
    base = promo.base_promotions(inputs.promotions, inputs.promotion_items, EXTRACT_SCOPE)
    events = promo.raw_events(base)
    details = promo.promotion_details(events)
    return base, events, details, promo.event_standards(details)


@check(
    "f01_shipment_filter",
    "SELECT item_id, shipment_item_id, market_id, region_id, cents / 100.0::DOUBLE AS price, order_date, shipped_units FROM x_shipments",
)
def shipment_filter(spark, folder):
    return plain(ship.filter_shipments(retail.shipment_items(spark, folder), EXTRACT_SCOPE))


@check(
    "f02_price_to_cents_and_day",
    """SELECT shipment_item_id, cents / 100.0::DOUBLE AS price, CAST(order_ts AS DATE) AS order_date FROM shipment_items""",
)
def price_to_cents(spark, folder):
    rows = retail.shipment_items(spark, folder)
    return rows.select(
        "shipment_item_id",
        F.col("unit_price").cast("double").alias("price"),
        F.to_date("order_ts").alias("order_date"),
    )


@check(
    "f03_promotion_filter",
    """SELECT promotion_key, title, start_ts, end_ts FROM promotions
WHERE CAST(start_ts AS DATE) >= DATE '1998-12-31' - INTERVAL 730 DAY AND CAST(start_ts AS DATE) <= DATE '1998-12-31'
  AND approval_status IN ('Approved', 'Scheduled')
  AND promotion_type IN ('Best Deal', 'Deal of the Day', 'Lightning Deal', 'Event Deal')
  AND upper(title) NOT LIKE '%OIH%'""",
)
def promotion_filter(spark, folder):
    rows = promo.filter_promotions(retail.promotions(spark, folder), EXTRACT_SCOPE)
    return rows.select("promotion_key", "title", "start_ts", "end_ts")


@check(
    "f04_membership_counts",
    """SELECT approval_status, promotion_type, count(*) AS n FROM promotions
WHERE approval_status IN ('Approved', 'Scheduled')
  AND promotion_type IN ('Best Deal', 'Deal of the Day', 'Lightning Deal', 'Event Deal') GROUP BY ALL""",
)
def membership(spark, folder):
    rows = retail.promotions(spark, folder)
    return rows.where(promo.counts_as_promotion()).groupBy("approval_status", "promotion_type").agg(F.count(F.lit(1)).alias("n"))


@check(
    "f05_title_pattern",
    "SELECT title, count(*) AS n FROM promotions WHERE upper(title) NOT LIKE '%OIH%' GROUP BY title",
)
def title_pattern(spark, folder):
    from quotecurve.functions.events import not_clearance

    rows = retail.promotions(spark, folder).where(not_clearance(F.col("title")))
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@check(
    "s05_run_date_parameter",
    """SELECT count(*) AS n, sum(shipped_units)::BIGINT AS units FROM shipment_items
WHERE order_ts >= DATE '2000-06-30' - INTERVAL 730 DAY AND order_ts <= DATE '2000-06-30'
  AND order_condition <> 6 AND is_retail = 'Y' AND product_group = 199""",
)
def run_date_parameter(spark, folder):
    scope = ship.Scope(run_date="2000-06-30")
    rows = ship.filter_shipments(retail.shipment_items(spark, folder), scope)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units"))


@check(
    "j01_item_attributes",
    """SELECT s.shipment_item_id, a.item_name, a.product_group, a.brand_name, a.brand_code
FROM x_shipments s LEFT JOIN item_attributes a USING (market_id, region_id, item_id)""",
)
def join_attributes(spark, folder):
    rows = ship.filter_shipments(retail.shipment_items(spark, folder), EXTRACT_SCOPE)
    return ship.with_item_attributes(rows, retail.item_attributes(spark, folder)).select(
        "shipment_item_id", "item_name", "product_group", "brand_name", "brand_code"
    )


@check(
    "j02_manufacturer",
    """SELECT s.shipment_item_id, m.vendor_code
FROM x_shipments s LEFT JOIN item_vendor m USING (market_id, region_id, item_id)""",
)
def join_manufacturer(spark, folder):
    rows = ship.filter_shipments(retail.shipment_items(spark, folder), EXTRACT_SCOPE)
    return ship.with_manufacturer(rows, retail.item_vendor(spark, folder)).select("shipment_item_id", "vendor_code")


@check(
    "j03_vendor_company",
    """SELECT s.shipment_item_id, v.company_code, v.company_name
FROM x_shipments s LEFT JOIN item_vendor m USING (market_id, region_id, item_id)
LEFT JOIN vendor_company v ON v.vendor_code = m.vendor_code
WHERE v.company_code IN ('AMERICA', 'ASIA')""",
)
def join_vendor(spark, folder):
    rows = ship.filter_shipments(retail.shipment_items(spark, folder), EXTRACT_SCOPE)
    rows = ship.with_manufacturer(rows, retail.item_vendor(spark, folder))
    return ship.with_vendor_company(
        rows, retail.vendor_company(spark, folder), EXTRACT_SCOPE.company_codes
    ).select("shipment_item_id", "company_code", "company_name")


@check(
    "j04_base_orders",
    """SELECT item_id, item_name, shipment_item_id, order_date, product_group, brand_name, brand_code, vendor_code,
company_code, company_name, shipped_units, cents / 100.0::DOUBLE AS price, share_cents / 100.0::DOUBLE AS revenue_share_amt
FROM x_orders""",
)
def base_orders(spark, folder):
    return plain(extract.orders_in_scope(extract.retail_inputs(spark, folder), EXTRACT_SCOPE))


@check(
    "j05_base_promotions",
    """SELECT region_id, market_id, product_group, item_id, promotion_key, title, start_ts, end_ts,
promo_cents / 100.0::DOUBLE AS promo_price, discount_percent FROM x_offers""",
)
def base_promotions(spark, folder):
    return plain(_calendar(spark, folder)[0])


@check("c01_event_class", "SELECT * FROM x_events")
def event_classes(spark, folder):
    return _calendar(spark, folder)[1]


@check(
    "c02_event_priority",
    "SELECT event_name, ifnull(priority, 99) AS priority, count(*) AS n FROM x_events LEFT JOIN event_ranks USING (event_name) GROUP BY ALL",
)
def event_priorities(spark, folder):
    from quotecurve.functions.events import event_priority

    events = _calendar(spark, folder)[1]
    ranked = events.select("event_name", event_priority(F.col("event_name")).alias("priority"))
    return ranked.groupBy("event_name", "priority").agg(F.count(F.lit(1)).alias("n"))


@check(
    "c05_date_parts",
    """SELECT order_date, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
CAST(day(order_date) AS INTEGER) AS day, CAST(weekofyear(order_date) AS INTEGER) AS week, count(*) AS n
FROM h_shipments GROUP BY order_date""",
)
def date_parts(spark, folder):
    from quotecurve.functions.dates import period_columns

    rows = ship.filter_shipments(retail.shipment_items(spark, folder), extract.whole_history())
    days = rows.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    keys = period_columns(F.col("order_date"), "daily")
    return days.select("order_date", *[keys[k].alias(k) for k in ("year", "month", "day", "week")], "n")


@check("w01_leading_promotion", "SELECT * FROM x_lead")
def leading_promotion(spark, folder):
    return _calendar(spark, folder)[2]


@check(
    "w01_leading_promotion_by_year",
    """SELECT region_id, market_id, product_group, item_id, promotion_key, event_name, event_year, promo_start, promo_end
FROM x_events LEFT JOIN event_ranks USING (event_name)
QUALIFY row_number() OVER (PARTITION BY item_id, event_year ORDER BY ifnull(priority, 99), promo_start, promotion_key) = 1""",
)
def leading_promotion_by_year(spark, folder):
    return promo.promotion_details(_calendar(spark, folder)[1], by_year=True)


@check(
    "a02_event_date_frequency",
    """SELECT event_name, event_year, promo_start, promo_end, count(*) AS frequency FROM x_lead
GROUP BY ALL HAVING count(*) >= 3""",
)
def event_date_frequency(spark, folder):
    return promo.event_date_frequency(_calendar(spark, folder)[2]).drop(*promo.SCOPE_KEYS)


@check("w02_event_standards", "SELECT * FROM x_usual")
def standards(spark, folder):
    return _calendar(spark, folder)[3]


@check(
    "a03_distinct_promoted_items",
    "SELECT DISTINCT item_id, promo_cents / 100.0::DOUBLE AS promo_price, discount_percent FROM promotion_items",
)
def distinct_items(spark, folder):
    return plain(retail.promotion_items(spark, folder).select("item_id", "promo_price", "discount_percent").distinct())


@check("j06_consolidated_promotions", "SELECT * FROM x_calendar")
def consolidated(spark, folder):
    return extract.promotion_calendar(extract.retail_inputs(spark, folder), EXTRACT_SCOPE)[1]


@check(
    "j07_orders_in_promo_window",
    """SELECT item_id, item_name, order_date, cents / 100.0::DOUBLE AS price, window_event,
sum(shipped_units)::BIGINT AS shipped_units FROM x_in_window GROUP BY ALL""",
)
def orders_in_window(spark, folder):
    inputs = extract.retail_inputs(spark, folder)
    orders = extract.orders_in_scope(inputs, EXTRACT_SCOPE)
    _, calendar = extract.promotion_calendar(inputs, EXTRACT_SCOPE)
    rows = att.in_event_window(att.daily_sales(orders), calendar)
    return plain(rows.select("item_id", "item_name", "order_date", "price", "window_event", "shipped_units"))


@check(
    "j08_orders_with_promo_price",
    """SELECT item_id, order_date, cents / 100.0::DOUBLE AS price, window_event, promo_cents / 100.0::DOUBLE AS promo_price,
discount_percent, sum(shipped_units)::BIGINT AS shipped_units FROM h_paid GROUP BY ALL""",
)
def orders_with_promo_price(spark, folder):
    inputs = extract.retail_inputs(spark, folder)
    scope = extract.whole_history()
    orders = extract.orders_in_scope(inputs, scope)
    base, calendar = extract.promotion_calendar(inputs, scope)
    rows = att.with_promo_price(att.in_event_window(att.daily_sales(orders), calendar), base)
    keys = ["item_id", "order_date", "price", "window_event", "promo_price", "discount_percent"]
    return plain(rows.groupBy(*keys).agg(F.sum(F.col("shipped_units") * F.col("copies")).alias("shipped_units")))


@check(
    "c03_paid_event",
    """SELECT event_name, deal_discount_percent, sum(shipped_units)::BIGINT AS shipped_units FROM h_paid GROUP BY ALL""",
)
def paid_event(spark, folder):
    inputs = extract.retail_inputs(spark, folder)
    scope = extract.whole_history()
    base, calendar = extract.promotion_calendar(inputs, scope)
    daily = att.daily_sales(extract.orders_in_scope(inputs, scope))
    rows = att.attributed_rows(att.with_promo_price(att.in_event_window(daily, calendar), base))
    return rows.groupBy("event_name", "deal_discount_percent").agg(
        F.sum(F.col("shipped_units") * F.col("copies")).alias("shipped_units")
    )


_ORDERS_EVENT = """SELECT item_id, item_name, order_date, cents / 100.0::DOUBLE AS price, event_name,
deal_discount_percent, shipped_units, revenue_cents / 100.0::DOUBLE AS revenue FROM {}sales"""


@check("a01_sales_extract", _ORDERS_EVENT.format("x_"))
def sales_extract(spark, folder):
    return plain(extract.sales_extract(extract.retail_inputs(spark, folder), EXTRACT_SCOPE))


@check("a01_sales_extract_whole_history", _ORDERS_EVENT.format("h_"))
def sales_extract_history(spark, folder):
    return plain(extract.sales_extract(extract.retail_inputs(spark, folder), extract.whole_history()))


@check(
    "a01_sales_extract_one_promo_each",
    """SELECT item_id, item_name, order_date, cents / 100.0::DOUBLE AS price,
       CASE WHEN promo_cents <> cents THEN 'BAU' WHEN window_event IS NULL THEN 'BAU' ELSE window_event END AS event_name,
       CASE WHEN promo_cents <> cents THEN 0.0::DOUBLE ELSE coalesce(discount_percent, 0.0::DOUBLE) END AS deal_discount_percent,
       CAST(sum(shipped_units) AS INTEGER) AS shipped_units, sum(share_cents) / 100.0::DOUBLE AS revenue
FROM (SELECT w.*, bp.promo_cents, bp.discount_percent
      FROM h_in_window w ASOF_SAFE) GROUP BY item_id, item_name, order_date, cents, window_event, promo_cents, discount_percent""".replace(
        "ASOF_SAFE",
        """LEFT JOIN LATERAL (SELECT b.promo_cents, b.discount_percent FROM h_offers b
        WHERE b.item_id = w.window_item AND CAST(w.order_date AS TIMESTAMP) BETWEEN b.start_ts AND b.end_ts
        ORDER BY b.start_ts, b.end_ts, b.promo_cents, b.discount_percent LIMIT 1) bp ON true""",
    ),
)
def sales_extract_dedupe(spark, folder):
    inputs = extract.retail_inputs(spark, folder)
    return plain(extract.sales_extract(inputs, extract.whole_history(), dedupe_promos=True))


@check(
    "s04_staged_views",
    """SELECT c.event_name, count(*) AS items, count(DISTINCT c.promo_start) AS starts FROM x_calendar c
JOIN x_lead d ON d.item_id = c.item_id GROUP BY c.event_name""",
)
def staged_views(spark, folder):
    _, _, details, standards_ = _calendar(spark, folder)
    stage(details, "promotion_details")
    stage(promo.consolidated_promotions(details, standards_), "consolidated_promos")
    return spark.sql(
        """SELECT c.event_name, count(*) AS items, count(DISTINCT c.promo_start) AS starts
        FROM consolidated_promos c JOIN promotion_details d ON d.item_id = c.item_id GROUP BY c.event_name"""
    )
