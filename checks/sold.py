"""Checks of the preparation and elasticity operators."""

from functools import lru_cache

from pyspark.sql import functions as F

from quotecurve.functions import numeric, text
from quotecurve.operators import elasticity as ela
from quotecurve.operators import prepare as prep
from quotecurve.operators.ranks import percentile_ranks, quantiles
from quotecurve.operators.report import slice_rows
from quotecurve.plans.extract import sales_input
from quotecurve.session import materialise
from quotecurve.sources import retail

from .base import compose, cte
from .extract import plain

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


def _roll(name: str, keys: str, start: str) -> None:
    cte(
        name,
        f"""
SELECT item_id, product, event_name, {keys}, min({start}) AS period_start,
       CAST(sum(shipped_units) AS BIGINT) AS shipped_units, CAST(sum(shipped_units * cents) AS BIGINT) AS revenue_cents,
       arg_min(deal_discount_percent, (order_date, deal_discount_percent)) AS deal_discount_percent,
       min(current_cents) AS current_cents,
       CASE WHEN sum(shipped_units) = 0 THEN 0
            ELSE CAST((2 * sum(shipped_units * cents) + sum(shipped_units)) // (2 * sum(shipped_units)) AS BIGINT) END AS cents
FROM (SELECT *, CAST(year(order_date) AS INTEGER) AS year, CAST(weekofyear(order_date) AS INTEGER) AS week,
             CAST(month(order_date) AS INTEGER) AS month, CAST(day(order_date) AS INTEGER) AS day FROM labelled)
GROUP BY item_id, product, event_name, {keys}
""",
    )


cte(
    "labelled",
    """
SELECT s.*, coalesce(upper(p.tag || ' ' || p.variation), s.item_id) AS product, p.current_cents
FROM sales s LEFT JOIN products p USING (item_id)
""",
)
_roll("weekly", "year, week, month", "greatest(CAST(date_trunc('week', order_date) AS DATE), CAST(date_trunc('month', order_date) AS DATE))")
_roll("monthly", "year, month", "CAST(date_trunc('month', order_date) AS DATE)")
_roll("daily", "year, week, month, day", "order_date")
cte("thick", "SELECT * FROM weekly WHERE shipped_units >= 5")
cte(
    "top10",
    "SELECT product, sum(revenue_cents) AS revenue_cents FROM weekly GROUP BY product ORDER BY 2 DESC, 1 LIMIT 10",
)
cte("prepared", "SELECT * FROM thick WHERE product IN (SELECT product FROM top10)")
cte(
    "points",
    """
SELECT product, md5(item_id || '|' || event_name || '|' || period_start || '|' || month) AS draw,
       ln(cents / 100.0::DOUBLE + 0.01::DOUBLE) AS x, ln(shipped_units::DOUBLE + 1) AS y
FROM thick
""",
)


@lru_cache
def sales(spark, folder):
    """Event-labelled sales of the whole history, written once (by the extract) for all checks of a session."""
    return sales_input(spark, folder)


@lru_cache
def labelled(spark, folder):
    return prep.with_products(sales(spark, folder), retail.products(spark, folder))


@lru_cache
def weekly_rows(spark, folder):
    return materialise(prep.roll_up(labelled(spark, folder)), "weekly")


@lru_cache
def thick_rows(spark, folder):
    """Weekly rows of all products, thin weeks dropped."""
    return prep.drop_thin_periods(weekly_rows(spark, folder))


@lru_cache
def prepared_rows(spark, folder):
    """Weekly rows of the top products, thin weeks dropped."""
    return prep.drop_thin_periods(prep.keep_top_products(weekly_rows(spark, folder)))


PERIOD = """item_id, product, event_name, {keys}, period_start, shipped_units, revenue_cents / 100.0::DOUBLE AS revenue,
deal_discount_percent, current_cents / 100.0::DOUBLE AS current_price, cents / 100.0::DOUBLE AS price"""
MONEY_COLUMNS = ("price", "revenue", "current_price")


@check(
    "a09_price_quantity",
    "SELECT cents / 100.0::DOUBLE AS price, product, sum(shipped_units)::BIGINT AS shipped_units FROM prepared GROUP BY cents, product",
)
def price_quantity(spark, folder):
    return plain(prep.price_quantity(prepared_rows(spark, folder)))


@check(
    "s01_s02_sales_and_products",
    """SELECT (SELECT count(*) FROM sales) AS sales_rows, (SELECT sum(shipped_units)::BIGINT FROM sales) AS units,
(SELECT count(*) FROM products) AS product_rows, (SELECT sum(current_cents)::BIGINT FROM products) / 100.0::DOUBLE AS list_total""",
)
def sources(spark, folder):
    from quotecurve.sources.files import coerce_products, coerce_sales

    s = coerce_sales(sales(spark, folder)).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units")).alias("s")
    )
    p = coerce_products(retail.products(spark, folder)).agg(
        F.count(F.lit(1)).alias("product_rows"), F.sum("current_price").cast("double").alias("list_total")
    )
    return p.select(
        s.scalar()["n"].alias("sales_rows"), s.scalar()["units"].alias("units"), "product_rows", "list_total"
    )


@check("s03_clean_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def clean_columns(spark, folder):
    from quotecurve.sources.files import clean_columns as clean

    rows = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias(" O_OrderKey "), F.col("o_orderstatus").alias("O_ORDERSTATUS ")
    )
    return clean(rows)


@check(
    "f06_nonneg_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, greatest(coalesce(try_cast(l_comment_number AS DOUBLE), 0), 0) AS value FROM (
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_returnflag = 'R' THEN 'none' WHEN l_linestatus = 'O' THEN '-' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) END
       AS l_comment_number FROM lineitem)""",
)
def nonneg_numbers(spark, folder):
    text_number = (
        F.when(F.col("l_returnflag") == "R", "none")
        .when(F.col("l_linestatus") == "O", F.concat(F.lit("-"), F.col("l_linenumber").cast("string")))
        .otherwise(F.col("l_linenumber").cast("string"))
    )
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numeric.nonneg(text_number).alias("value"))


@check(
    "f07_lenient_dates",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""",
)
def lenient_dates(spark, folder):
    from quotecurve.functions.dates import lenient_date

    raw = F.when(F.col("o_orderstatus") == "P", "not a day").otherwise(
        F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
        )
    )
    rows = spark.read.parquet(f"{folder}/orders.parquet")
    return rows.select("o_orderkey", lenient_date(raw).alias("order_date"))


@check(
    "j09_sales_with_products",
    """SELECT product, sum(shipped_units)::BIGINT AS units, count(*) AS n, sum(current_cents)::BIGINT / 100.0::DOUBLE AS list_total
FROM labelled GROUP BY product""",
)
def sales_with_products(spark, folder):
    return labelled(spark, folder).groupBy("product").agg(
        F.sum("shipped_units").alias("units"),
        F.count(F.lit(1)).alias("n"),
        F.sum("current_price").cast("double").alias("list_total"),
    )


@check(
    "c04_product_label",
    "SELECT item_id, coalesce(upper(tag || ' ' || variation), item_id) AS product FROM products",
)
def product_labels(spark, folder):
    return retail.products(spark, folder).select(
        "item_id", text.product_label(F.col("tag"), F.col("variation"), F.col("item_id")).alias("product")
    )


@check(
    "a04_days_at_price",
    "SELECT item_id, cents / 100.0::DOUBLE AS price, count(DISTINCT order_date) AS days_sold FROM sales GROUP BY item_id, cents",
)
def days_at_price(spark, folder):
    return plain(prep.days_at_price(sales(spark, folder)))


@check(
    "a04_days_of_merged_masks",
    "SELECT item_id, cents / 100.0::DOUBLE AS price, count(DISTINCT order_date) AS days_sold FROM sales GROUP BY item_id, cents",
)
def days_of_merged_masks(spark, folder):
    """Two overlapping parts of the sales summed up apart, written, and merged."""
    rows = sales(spark, folder)
    parts = [materialise(prep.day_masks(rows.where(c)), "masks") for c in ("shipped_units % 3 < 2", "shipped_units % 3 > 0")]
    return plain(prep.days_of_masks(prep.merge_day_masks(*parts)))


@check(
    "j10_rows_with_days_at_price",
    """SELECT s.item_id, s.order_date, s.cents / 100.0::DOUBLE AS price, s.shipped_units, d.days_sold
FROM sales s JOIN (SELECT item_id, cents, count(DISTINCT order_date) AS days_sold FROM sales GROUP BY ALL) d USING (item_id, cents)""",
)
def rows_with_days(spark, folder):
    rows = prep.with_days_at_price(sales(spark, folder))
    return plain(rows.select("item_id", "order_date", "price", "shipped_units", "days_sold"))


@check("a05_weekly_sales", f"SELECT {PERIOD.format(keys='year, week, month')} FROM weekly")
def weekly_sales(spark, folder):
    return plain(prep.roll_up(labelled(spark, folder)), MONEY_COLUMNS)


@check("a05_monthly_sales", f"SELECT {PERIOD.format(keys='year, month')} FROM monthly")
def monthly_sales(spark, folder):
    return plain(prep.roll_up(labelled(spark, folder), "monthly"), MONEY_COLUMNS)


@check("a05_daily_sales", f"SELECT {PERIOD.format(keys='year, week, month, day')} FROM daily")
def daily_sales(spark, folder):
    return plain(prep.roll_up(labelled(spark, folder), "daily"), MONEY_COLUMNS)


@check(
    "a06_first_discount",
    "SELECT product, arg_min(deal_discount_percent, (order_date, deal_discount_percent)) AS first_discount FROM labelled GROUP BY product",
)
def first_discount(spark, folder):
    return labelled(spark, folder).groupBy("product").agg(prep.first_discount().alias("first_discount"))


@check(
    "a07_average_price",
    """SELECT product, ((2 * sum(revenue_cents) + sum(shipped_units)) // (2 * sum(shipped_units)))::BIGINT / 100.0::DOUBLE AS price
FROM weekly GROUP BY product""",
)
def average_price(spark, folder):
    from quotecurve.functions.money import divide_half_up, from_cents, to_cents

    rows = prep.roll_up(labelled(spark, folder)).groupBy("product")
    total = rows.agg(F.sum(to_cents(F.col("revenue"))).alias("r"), F.sum("shipped_units").alias("u"))
    return total.select("product", from_cents(divide_half_up(F.col("r"), F.col("u"))).cast("double").alias("price"))


@check(
    "a08_product_revenue",
    "SELECT product, sum(revenue_cents)::BIGINT / 100.0::DOUBLE AS revenue FROM weekly GROUP BY product",
)
def product_revenue(spark, folder):
    rows = prep.roll_up(labelled(spark, folder))
    return rows.groupBy("product").agg(F.sum("revenue").cast("double").alias("revenue"))


@check("t01_top_products", "SELECT product, revenue_cents::BIGINT / 100.0::DOUBLE AS revenue FROM top10")
def top_products(spark, folder):
    return plain(prep.top_products(prep.roll_up(labelled(spark, folder))))


@check(
    "j11_rows_of_top_products",
    f"SELECT {PERIOD.format(keys='year, week, month')} FROM weekly WHERE product IN (SELECT product FROM top10)",
)
def rows_of_top_products(spark, folder):
    return plain(prep.keep_top_products(prep.roll_up(labelled(spark, folder))), MONEY_COLUMNS)


@check("f09_thick_periods", f"SELECT {PERIOD.format(keys='year, week, month')} FROM prepared")
def thick_periods(spark, folder):
    return plain(prepared_rows(spark, folder), MONEY_COLUMNS)


@check(
    "f10_baseline_rows",
    f"SELECT {PERIOD.format(keys='year, week, month')} FROM thick WHERE event_name IS NULL OR upper(event_name) = 'BAU'",
)
def baseline_rows(spark, folder):
    return plain(prep.baseline_only(thick_rows(spark, folder)), MONEY_COLUMNS)


@check(
    "f12_item_and_product_slices",
    """SELECT product, count(*) AS n, sum(shipped_units)::BIGINT AS units FROM thick
WHERE product = (SELECT min(product) FROM thick) GROUP BY product""",
)
def product_slice(spark, folder):
    rows = thick_rows(spark, folder)
    first = rows.agg(F.min("product").alias("p")).first()["p"]
    return slice_rows(rows, products=[first]).groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units")
    )


@check(
    "f12_item_slice",
    """SELECT item_id, product, count(*) AS n, sum(shipped_units)::BIGINT AS units FROM thick
WHERE item_id IN (SELECT DISTINCT item_id FROM thick ORDER BY item_id LIMIT 3) GROUP BY ALL""",
)
def item_slice(spark, folder):
    rows = thick_rows(spark, folder)
    items = [r["item_id"] for r in rows.select("item_id").distinct().orderBy("item_id").limit(3).collect()]
    return slice_rows(rows, items=items).groupBy("item_id", "product").agg(F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units"))


@check(
    "f15_default_columns",
    """SELECT item_id, period_start, event_name, month, cents / 100.0::DOUBLE AS asp, 1.0::DOUBLE AS intercept, 1::BIGINT AS days_asp_valid FROM thick""",
)
def default_columns(spark, folder):
    rows = prep.with_default_columns(thick_rows(spark, folder))
    return rows.select("item_id", "period_start", "event_name", "month", "asp", "intercept", "days_asp_valid")


@check(
    "w04_label_codes",
    """SELECT t.item_id, t.period_start, t.month, t.event_name, t.product, e.event_code, p.product_code FROM thick t
JOIN (SELECT event_name, CASE WHEN event_name = 'BAU' THEN 0 ELSE CAST(dense_rank() OVER (PARTITION BY event_name = 'BAU' ORDER BY event_name) AS INTEGER) END AS event_code
      FROM (SELECT DISTINCT event_name FROM thick)) e USING (event_name)
JOIN (SELECT product, CAST(dense_rank() OVER (ORDER BY product) - 1 AS INTEGER) AS product_code FROM (SELECT DISTINCT product FROM thick)) p USING (product)""",
)
def label_codes(spark, folder):
    rows = prep.with_codes(thick_rows(spark, folder))
    return rows.select("item_id", "period_start", "month", "event_name", "product", "event_code", "product_code")


@check(
    "a23_standard_scores",
    """SELECT item_id, period_start, event_name, month, round((p - avg(p) OVER ()) / stddev_pop(p) OVER (), 6) AS price_z
FROM (SELECT *, cents / 100.0::DOUBLE AS p FROM thick)""",
)
def standard_scores(spark, folder):
    rows = thick_rows(spark, folder).withColumn("price", F.col("price").cast("double"))
    return prep.standard_scores(rows, "price").select(
        "item_id", "period_start", "event_name", "month", F.round("price_z", 6).alias("price_z")
    )


@check(
    "a21_distinct_prices",
    "SELECT product, count(DISTINCT cents) AS prices FROM thick GROUP BY product",
)
def distinct_prices(spark, folder):
    return thick_rows(spark, folder).groupBy("product").agg(F.countDistinct("price").alias("prices"))


@check(
    "a22_median_and_quantiles",
    """SELECT product, round(quantile_cont(cents::DOUBLE, 0.5), 6) AS median, round(quantile_cont(cents::DOUBLE, 0.05), 6) AS q05,
round(quantile_cont(cents::DOUBLE, 0.95), 6) AS q95 FROM thick GROUP BY product""",
)
def medians(spark, folder):
    from quotecurve.functions.money import to_cents

    spots = thick_rows(spark, folder).groupBy("product", to_cents(F.col("price")).alias("cents")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cuts = quantiles(spots, "cents", "n", [0.5, 0.05, 0.95], ("product",)).withColumnRenamed("cuts", "q")
    return cuts.select(
        "product",
        F.round(F.col("q")[0], 6).alias("median"),
        F.round(F.col("q")[1], 6).alias("q05"),
        F.round(F.col("q")[2], 6).alias("q95"),
    )


@check(
    "a10_date_coverage",
    """SELECT min(order_date) AS data_start, max(order_date) AS data_end,
CAST(max(order_date) - min(order_date) + 1 AS INTEGER) AS days_covered FROM sales""",
)
def date_coverage(spark, folder):
    from quotecurve.operators.report import date_coverage as coverage

    return coverage(sales(spark, folder)).select("data_start", "data_end", "days_covered")


# ---- elasticity ---------------------------------------------------------------------------


@check(
    "a11_plain_slope",
    """SELECT product, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(regr_slope(y, x), 6) END AS slope FROM points GROUP BY product""",
)
def plain_slope(spark, folder):
    rows = ela.plain_slopes(thick_rows(spark, folder))
    return rows.select("product", "n", F.round("slope", 6).alias("slope"))


cte(
    "sliced",
    """
SELECT product, x, y, n, place * 100 // n AS slice FROM (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY draw, x, y) - 1 AS place, count(*) OVER (PARTITION BY product) AS n
  FROM points) WHERE n >= 5
""",
)
cte(
    "trials",
    """
SELECT s.product, t.slice AS trial, CASE WHEN min(s.x) < max(s.x) THEN regr_slope(s.y, s.x) END AS slope,
       CASE WHEN min(s.x) < max(s.x) THEN regr_intercept(s.y, s.x) END AS level
FROM (SELECT DISTINCT product, slice FROM sliced) t
JOIN sliced s ON s.product = t.product AND (s.slice - t.slice + 100) % 100 < 60
GROUP BY ALL
""",
)
cte(
    "limits",
    """
SELECT product, quantile_cont(abs(y - m), 0.5) + 1e-9 AS lim
FROM (SELECT product, y, (SELECT quantile_cont(q.y, 0.5) FROM points q WHERE q.product = p.product) AS m FROM points p)
GROUP BY product
""",
)
cte(
    "best_trial",
    """
SELECT product, arg_max((slope, level, lim), (inliers, -trial)) AS b FROM (
  SELECT p.product, t.trial, t.slope, t.level, l.lim, count(*) AS inliers
  FROM points p JOIN trials t USING (product) JOIN limits l USING (product)
  WHERE t.slope IS NOT NULL AND abs(p.y - t.level - t.slope * p.x) <= l.lim GROUP BY ALL)
GROUP BY product
""",
)
cte(
    "robust",
    """
SELECT p.product, count(*) AS inliers, CASE WHEN min(x) < max(x) THEN regr_slope(y, x) END AS robust_slope
FROM points p JOIN best_trial t USING (product)
WHERE abs(p.y - t.b[2] - t.b[1] * p.x) <= t.b[3] GROUP BY p.product
""",
)
cte(
    "slopes",
    """
SELECT p.product, coalesce(any_value(r.robust_slope), CASE WHEN count(*) >= 5 THEN regr_slope(p.y, p.x) END) AS ratio
FROM points p LEFT JOIN robust r USING (product) GROUP BY p.product
""",
)
cte(
    "elasticity",
    """
SELECT product, ratio, abs(ratio) AS magnitude, CASE WHEN abs(ratio) > 1 THEN 'ELASTIC' ELSE 'INELASTIC' END AS elasticity_label,
       CASE WHEN ratio IS NOT NULL THEN (rank() OVER (ORDER BY abs(ratio))
            + (count(*) OVER (PARTITION BY abs(ratio)) - 1) / 2.0::DOUBLE) / count(ratio) OVER () * 100 END AS elasticity_score
FROM slopes
""",
)


@check("a12_robust_slope", "SELECT product, inliers, round(robust_slope, 5) AS robust_slope FROM robust")
def robust_slope(spark, folder):
    rows = ela.robust_slopes(thick_rows(spark, folder))
    return rows.select("product", "inliers", F.round("robust_slope", 5).alias("robust_slope"))


@check(
    "w03_percentile_rank",
    """SELECT product, (rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0::DOUBLE) / count(*) OVER () AS share
FROM (SELECT product, count(*) AS u FROM thick GROUP BY product)""",
)
def percentile_rank(spark, folder):
    counts = thick_rows(spark, folder).groupBy("product").agg(F.count(F.lit(1)).alias("u"))
    return counts.join(percentile_ranks(counts, "u", "share"), "u").select("product", "share")


@check(
    "r01_elasticity_table",
    """SELECT product, round(ratio, 5) AS ratio, round(magnitude, 5) AS magnitude, elasticity_label,
round(elasticity_score, 6) AS elasticity_score FROM elasticity""",
)
def elasticity_table(spark, folder):
    rows = ela.elasticity_table(thick_rows(spark, folder))
    return rows.select(
        "product",
        F.round("ratio", 5).alias("ratio"),
        F.round("magnitude", 5).alias("magnitude"),
        "elasticity_label",
        F.round("elasticity_score", 6).alias("elasticity_score"),
    )


@check(
    "t02_most_elastic_first",
    """SELECT product, CAST(row_number() OVER (ORDER BY abs(slope) DESC NULLS LAST, product) AS INTEGER) AS place
FROM (SELECT product, CASE WHEN count(*) >= 5 THEN regr_slope(y, x) END AS slope FROM points GROUP BY product)
ORDER BY place""",
)
def most_elastic(spark, folder):
    from pyspark.sql import Window

    top = ela.elasticity_table(thick_rows(spark, folder), robust=False)
    order = Window.orderBy(F.col("magnitude").desc_nulls_last(), "product")
    return top.select("product", F.row_number().over(order).alias("place"))


@check(
    "a25_elasticity_histogram",
    """SELECT CAST(floor((ratio - (SELECT min(ratio) FROM slopes)) / 0.5::DOUBLE) AS INTEGER) AS band, count(*) AS products
FROM slopes WHERE ratio IS NOT NULL GROUP BY band""",
)
def elasticity_histogram(spark, folder):
    return ela.elasticity_histogram(ela.elasticity_slopes(thick_rows(spark, folder)), 0.5)


@check(
    "c11_elasticity_texts",
    """SELECT product, CASE WHEN magnitude >= 1.05 THEN 'ELASTIC' WHEN magnitude <= 0.95 THEN 'INELASTIC' ELSE 'BALANCED DEMAND' END AS demand,
CASE WHEN elasticity_score > 50 THEN 'Top ' || format('{:,.0f}', 100 - elasticity_score) || '% most Sensitive'
     ELSE 'Bottom ' || format('{:,.0f}', elasticity_score) || '% Sensitivity' END AS rank_text FROM elasticity""",
)
def elasticity_texts(spark, folder):
    rows = ela.label_slopes(ela.elasticity_slopes(thick_rows(spark, folder)))
    return rows.select(
        "product",
        text.demand_class(F.col("magnitude")).alias("demand"),
        text.sensitivity_rank_text(F.col("elasticity_score")).alias("rank_text"),
    )
