"""Retail star-schema tables seen as the logical inputs: shipments, items, vendors, promotions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY, discounted_cents, divide_half_up, from_cents, to_cents
from ..operators.joins import salted_join

MARKET_ID = 1
REGION_ID = 1
PRODUCT_GROUP = 199
OTHER_GROUP = 210
DEAL_PERCENT = 8

# Titles of the mapped promotions, by promotion_key % 13.
TITLES = [
    "Prime Day Deal",
    "BF Weekly",
    "Boxing Week Sale",
    "Weekly Deal",
    "OIH Clearance",
    "Big Spring Sale",
    "PBDD Promo",
    "Cyber Monday",
    "T11 Launch",
    "Pet Month",
    "Back To School",
    "Back to University",
    "Spring UPDATE",
]
# Deal types of the mapped promotions, by (promotion_key / 13) % 5.
DEAL_TYPES = ["Best Deal", "Deal of the Day", "Lightning Deal", "Event Deal", "Coupon"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _percent(discount: Column) -> Column:
    return F.round(discount * 100).cast("bigint")


def _shipment_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def shipment_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each (order, line, part), priced at the part's list price less the discount."""
    # clustered once by order: serves both the grouping and the join to orders
    lines = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_linestatus")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("shipped_units"),
            F.min("l_discount").alias("discount"),
            F.min("l_linestatus").alias("line_status"),
        )
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"
    )
    joined = salted_join(
        lines.join(orders, lines.l_orderkey == orders.o_orderkey),
        parts,
        on=["l_partkey"],
        spread_by=["l_orderkey", "l_linenumber"],
        how="inner",
    )
    return joined.select(
        F.col("l_partkey").cast("string").alias("item_id"),
        _shipment_key().alias("shipment_item_id"),
        F.lit(MARKET_ID).alias("market_id"),
        F.lit(REGION_ID).alias("region_id"),
        from_cents(discounted_cents(to_cents(F.col("p_retailprice")), _percent(F.col("discount")))).alias(
            "unit_price"
        ),
        F.col("o_orderdate").alias("order_ts"),
        "shipped_units",
        F.when(F.col("p_size") <= 45, PRODUCT_GROUP).otherwise(OTHER_GROUP).alias("product_group"),
        F.when(F.col("o_orderstatus") == "P", 6)
        .when(F.col("o_orderstatus") == "O", 2)
        .otherwise(1)
        .alias("order_condition"),
        F.when(F.col("line_status") == "F", "Y").otherwise("N").alias("is_retail"),
    )


def item_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.lit(MARKET_ID).alias("market_id"),
        F.lit(REGION_ID).alias("region_id"),
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.when(F.col("p_size") <= 45, PRODUCT_GROUP).otherwise(OTHER_GROUP).alias("product_group"),
        F.col("p_brand").alias("brand_name"),
        F.regexp_replace("p_brand", "Brand#", "").alias("brand_code"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_brand").alias("tag"),
        F.col("p_type").alias("variation"),
        from_cents(to_cents(F.col("p_retailprice"))).cast(MONEY).alias("current_price"),
    )


def item_vendor(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(F.min("l_suppkey").alias("vendor"))
        .select(
            F.lit(MARKET_ID).alias("market_id"),
            F.lit(REGION_ID).alias("region_id"),
            F.col("l_partkey").cast("string").alias("item_id"),
            F.col("vendor").cast("string").alias("vendor_code"),
        )
    )


def vendor_company(spark: SparkSession, folder: str) -> DataFrame:
    """Vendors with their company; the company code is the world region of the vendor."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("vendor_code"),
            F.col("r_name").alias("company_code"),
            F.col("s_name").alias("company_name"),
        )
    )


def revenue_share(spark: SparkSession, folder: str) -> DataFrame:
    """Net amount of the lines that were not returned; the other shipments have no row."""
    line_share = to_cents(F.col("l_extendedprice")) * (F.lit(100) - _percent(F.col("l_discount")))
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") != "R")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(F.sum(line_share).alias("share"))
        .select(
            F.lit(MARKET_ID).alias("market_id"),
            _shipment_key().alias("shipment_item_id"),
            from_cents(divide_half_up(F.col("share"), F.lit(100).cast("bigint"))).alias("revenue_share_amt"),
        )
    )


def _deal_lines(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey", _percent(F.col("l_discount")).alias("percent"))
        .where(F.col("percent") >= DEAL_PERCENT)
    )


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a deal line act as promotions that run in the first half of the order month."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    deals = orders.join(_deal_lines(spark, folder), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    month_start = F.trunc("o_orderdate", "month").cast("timestamp_ntz")
    return deals.select(
        F.lit(REGION_ID).alias("region_id"),
        F.lit(MARKET_ID).alias("market_id"),
        F.col("o_orderkey").alias("promotion_key"),
        _pick(TITLES, F.col("o_orderkey") % 13).alias("title"),
        (month_start + F.expr("INTERVAL '9' HOUR")).alias("start_ts"),
        (month_start + F.expr("INTERVAL '13 18' DAY TO HOUR")).alias("end_ts"),
        F.when(F.col("o_orderstatus") == "F", "Approved")
        .when(F.col("o_orderstatus") == "O", "Scheduled")
        .otherwise("Rejected")
        .alias("approval_status"),
        _pick(DEAL_TYPES, F.floor(F.col("o_orderkey") / 13) % 5).alias("promotion_type"),
    )


def promotion_items(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size"
    )
    lines = salted_join(
        _deal_lines(spark, folder), parts, on=["l_partkey"], spread_by=["l_orderkey"], how="inner"
    )
    return lines.select(
        F.col("l_orderkey").alias("promotion_key"),
        F.lit(REGION_ID).alias("region_id"),
        F.lit(MARKET_ID).alias("market_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.when(F.col("p_size") <= 45, PRODUCT_GROUP).otherwise(OTHER_GROUP).cast("string").alias("product_group"),
        from_cents(discounted_cents(to_cents(F.col("p_retailprice")), F.col("percent"))).alias("promo_price"),
        F.col("percent").cast("double").alias("discount_percent"),
    )
