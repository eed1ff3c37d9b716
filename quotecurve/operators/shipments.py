"""Shipments: base filter, item, vendor and revenue-share enrichment."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import as_date
from ..functions.money import MONEY
from ..session import materialise, steps
from .joins import SALT, salted, salted_copies, salted_join

ITEM_KEYS = ["market_id", "region_id", "item_id"]


@dataclass(frozen=True)
class Scope:
    """What to extract. `items`, `product_groups` and `company_codes` of None mean no such filter."""

    run_date: str | date
    window_days: int | None = 730
    region_id: int = 1
    market_id: int = 1
    product_groups: tuple[int, ...] | None = (199,)
    items: tuple[str, ...] | None = None
    company_codes: tuple[str, ...] | None = None
    excluded_condition: int | None = 6
    retail_only: bool = True

    @property
    def window_start(self) -> Column:
        """First day of the window; without a length, the first day there is."""
        if self.window_days is None:
            return as_date("0001-01-01")
        return F.date_sub(as_date(self.run_date), self.window_days)

    @property
    def window_end(self) -> Column:
        return as_date(self.run_date)


def filter_shipments(shipments: DataFrame, scope: Scope) -> DataFrame:
    """Shipments in scope. All conditions are plain comparisons, so they reach the scan.

    The window ends at run-date midnight: later orders of that day are left out.
    """
    keep = (
        (F.col("region_id") == scope.region_id)
        & (F.col("market_id") == scope.market_id)
        & (F.col("order_ts") >= scope.window_start)
        & (F.col("order_ts") <= scope.window_end)
        & (F.col("shipped_units") > 0)
        & (F.col("unit_price") > 0)
    )
    if scope.product_groups is not None:
        keep = keep & F.col("product_group").isin(*scope.product_groups)
    if scope.excluded_condition is not None:
        keep = keep & (F.col("order_condition") != scope.excluded_condition)
    if scope.retail_only:
        keep = keep & (F.col("is_retail") == "Y")
    if scope.items is not None:
        keep = keep & F.col("item_id").isin(*scope.items)
    return shipments.where(keep).select(
        "item_id",
        "shipment_item_id",
        "market_id",
        "region_id",
        F.col("unit_price").cast(MONEY).alias("price"),
        F.to_date("order_ts").alias("order_date"),
        "shipped_units",
    )


def with_item_attributes(shipments: DataFrame, attributes: DataFrame) -> DataFrame:
    return salted_join(shipments, attributes, on=ITEM_KEYS, spread_by=["shipment_item_id"])


def with_manufacturer(shipments: DataFrame, item_vendor: DataFrame) -> DataFrame:
    return salted_join(shipments, item_vendor, on=ITEM_KEYS, spread_by=["shipment_item_id"])


def with_vendor_company(
    shipments: DataFrame,
    vendor_company: DataFrame,
    company_codes: tuple[str, ...] | None = None,
    spread_by: tuple[str, ...] = ("shipment_item_id",),
) -> DataFrame:
    """Company of the vendor. A company filter keeps only matched rows, so the join is then inner."""
    if company_codes is None:
        return salted_join(shipments, vendor_company, on=["vendor_code"], spread_by=list(spread_by))
    chosen = vendor_company.where(F.col("company_code").isin(*company_codes))
    return salted_join(shipments, chosen, on=["vendor_code"], spread_by=list(spread_by), how="inner")


def with_revenue_share(shipments: DataFrame, share: DataFrame) -> DataFrame:
    """Revenue share by shipment; a shipment without one counts 0."""
    joined = shipments.join(share, ["market_id", "shipment_item_id"], "left")
    return joined.withColumn(
        "revenue_share_amt", F.coalesce(F.col("revenue_share_amt"), F.lit(0).cast(MONEY))
    )


def with_item_lookups(
    shipments: DataFrame, attributes: DataFrame, item_vendor: DataFrame, vendor_company: DataFrame, scope: Scope
) -> DataFrame:
    """Vendor, company and attributes of each shipment's item, and the salt by which the rows are dealt out.

    The same as the three joins one after the other, but the company is found for each item's vendor,
    and the rows, which are of one market and region, are dealt out once by item and by day and price: the
    latter so that sums by these need no other shuffle.
    """
    here = (F.col("market_id") == scope.market_id) & (F.col("region_id") == scope.region_id)
    vendors = with_vendor_company(
        item_vendor.where(here).select("item_id", "vendor_code"), vendor_company, scope.company_codes, ("item_id",)
    )
    items = attributes.where(here).drop("market_id", "region_id")
    keys = ["item_id", SALT]
    rows = salted(shipments, ["order_date", "price"])
    rows = rows.join(salted_copies(vendors), keys, "left" if scope.company_codes is None else "inner")
    return rows.join(salted_copies(items), keys, "left")


def base_orders(
    shipments: DataFrame,
    attributes: DataFrame,
    item_vendor: DataFrame,
    vendor_company: DataFrame,
    share: DataFrame,
    scope: Scope,
    dealt: bool = False,
) -> DataFrame:
    """Row-level enriched orders; with `dealt` also the salt of `with_item_lookups`.

    Written step by step, so that the shuffles of one step are gone before the next. A company filter is
    selective and comes before the large join to revenue shares, which then moves only the rows that stay;
    without one the shares come first, where rows are narrow.
    """
    lookups = (attributes, item_vendor, vendor_company, scope)
    with steps(shipments.sparkSession) as result:
        orders = materialise(filter_shipments(shipments, scope), "shipments")
        if scope.company_codes is None:
            orders = result(with_revenue_share(orders, share), "shared")
        else:
            orders = result(with_item_lookups(orders, *lookups), "enriched")
    orders = with_item_lookups(orders, *lookups) if scope.company_codes is None else with_revenue_share(orders, share)
    return orders.select(
        "item_id",
        "item_name",
        "shipment_item_id",
        "order_date",
        "product_group",
        "brand_name",
        "brand_code",
        "vendor_code",
        "company_code",
        "company_name",
        "shipped_units",
        "price",
        "revenue_share_amt",
        *([SALT] if dealt else []),
    )
