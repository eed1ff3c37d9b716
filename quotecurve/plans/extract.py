"""Sales extract: shipments and promotions to event-labelled sales."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import promotions as promo
from ..operators.attribution import attribute_daily, daily_sales
from ..operators.shipments import Scope, base_orders
from ..session import materialise, steps
from ..sources import retail


@dataclass(frozen=True)
class Inputs:
    shipments: DataFrame
    attributes: DataFrame
    item_vendor: DataFrame
    vendor_company: DataFrame
    revenue_share: DataFrame
    promotions: DataFrame
    promotion_items: DataFrame


def retail_inputs(spark: SparkSession, folder: str) -> Inputs:
    return Inputs(
        shipments=retail.shipment_items(spark, folder),
        attributes=retail.item_attributes(spark, folder),
        item_vendor=retail.item_vendor(spark, folder),
        vendor_company=retail.vendor_company(spark, folder),
        revenue_share=retail.revenue_share(spark, folder),
        promotions=retail.promotions(spark, folder),
        promotion_items=retail.promotion_items(spark, folder),
    )


def promotion_calendar(inputs: Inputs, scope: Scope, by_year: bool = False) -> tuple[DataFrame, DataFrame]:
    """(base promotions, consolidated promotions), one leading promotion of an item in all or in every year.

    Promotions in scope and leading promotions are written once, as several steps read them.
    """
    base = materialise(promo.base_promotions(inputs.promotions, inputs.promotion_items, scope), "offers")
    details = materialise(promo.promotion_details(promo.raw_events(base), by_year=by_year), "leading")
    return base, promo.consolidated_promotions(details, promo.event_standards(details))


def orders_in_scope(inputs: Inputs, scope: Scope, dealt: bool = False) -> DataFrame:
    return base_orders(
        inputs.shipments,
        inputs.attributes,
        inputs.item_vendor,
        inputs.vendor_company,
        inputs.revenue_share,
        scope,
        dealt,
    )


def sales_extract(inputs: Inputs, scope: Scope, dedupe_promos: bool = False, by_year: bool = False) -> DataFrame:
    """The whole extract, a written table.

    The orders, their sums by day and the promotion calendar are written on the way and deleted at the end,
    so no more than one step's shuffles are on disk.
    """
    spark = inputs.shipments.sparkSession
    with steps(spark) as result:
        with steps(spark) as summed:
            daily = summed(daily_sales(orders_in_scope(inputs, scope, dealt=True)), "daily")
        base, consolidated = promotion_calendar(inputs, scope, by_year)
        return result(attribute_daily(daily, consolidated, base, dedupe_promos), "extract")


def whole_history(run_date: str = "9999-12-31") -> Scope:
    """A scope that keeps every shipment of the retail tables."""
    return Scope(
        run_date=run_date,
        window_days=None,
        product_groups=None,
        company_codes=None,
        excluded_condition=None,
        retail_only=False,
    )


def sales_input(spark: SparkSession, folder: str) -> DataFrame:
    """Sales frame of the price review, over all shipments of the retail tables."""
    sales = sales_extract(retail_inputs(spark, folder), whole_history())
    return sales.select(
        "item_id",
        "order_date",
        "price",
        F.col("shipped_units").cast("bigint").alias("shipped_units"),
        "event_name",
        "deal_discount_percent",
    )
