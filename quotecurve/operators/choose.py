"""Support of each price, revenue frontier and the choice of a price."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import to_cents
from .weights import price_counts

# Fixed values of the price choice.
WINDOW_FACTOR = 1.25
SMALLEST_STEP = 0.25
STEP_PARTS = 25.0
EXPECTED_SHARE, WORST_SHARE = 0.7, 0.3
FRONTIER_MIN_SUPPORT = 4
BEST_MIN_SUPPORT = 6
MAX_SLOPE = 5000.0
MAX_REVENUE_DROP = 0.10

# Tells rows of one product and price apart in a fixed order.
ROW_ORDER = ["item_id", "period_start", "event_name"]


def price_steps(counts: DataFrame, by: str = "product") -> DataFrame:
    """(group, step, window) in cents: median gap between neighbouring distinct prices.

    A group with one price has no gap; its step is 0.25, as all its rows share the price.
    """
    gap = F.col("cents") - F.lag("cents").over(Window.partitionBy(by).orderBy("cents"))
    gaps = counts.select(by, "cents", gap.cast("double").alias("gap"))
    steps = gaps.groupBy(by).agg(F.coalesce(F.percentile("gap", 0.5), F.lit(SMALLEST_STEP * 100)).alias("step"))
    return steps.withColumn("window", F.lit(WINDOW_FACTOR) * F.col("step"))


def support_table(rows: DataFrame, by: str = "product", price: str = "price") -> DataFrame:
    """(group, cents, support_count): observations within the window around each price.

    Counted on the price points of the group, as a range frame in units of the window.
    """
    counts = price_counts(rows, by, price)
    scaled = counts.join(price_steps(counts, by), by).withColumn("place", F.col("cents") / F.col("window"))
    # cents are whole, so the margin only absorbs rounding at the window's edge
    near = F.expr(
        f"sum(n) OVER (PARTITION BY {by} ORDER BY place RANGE BETWEEN 1.000000001D PRECEDING AND 1.000000001D FOLLOWING)"
    )
    return scaled.select(by, "cents", near.alias("support_count"))


def with_support(rows: DataFrame, by: str = "product", price: str = "price") -> DataFrame:
    table = support_table(rows, by, price)
    keyed = rows.withColumn("cents", to_cents(F.col(price)))
    return keyed.join(table, [by, "cents"], "left").drop("cents")


def with_score(curve: DataFrame) -> DataFrame:
    """Adds `score`: expected revenue with a share of the worst case, 0 where unknown."""
    score = F.lit(EXPECTED_SHARE) * F.col("revenue_p50") + F.lit(WORST_SHARE) * F.col("revenue_p025")
    return curve.withColumn("score", F.coalesce(score, F.lit(0.0)))


def positive_scores(curve: DataFrame) -> DataFrame:
    """The scored curve without rows that earn nothing."""
    return with_score(curve).where(F.col("score") > 0)


def not_covered(rows: DataFrame, covered: DataFrame, by: str = "product") -> DataFrame:
    """Rows of the groups that `covered` has no row of."""
    return rows.join(covered.select(by).distinct(), by, "left_anti")


def best_row(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in the given order, then in row order.

    A minimum, so each task keeps one row for a group before the shuffle.
    """
    ties = [F.col(c) for c in ["price", *ROW_ORDER] if c in rows.columns and c not in by]
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order, *ties)).alias("best"))
    return best.select(*by, "best.*").select(*rows.columns)


def pick_best(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Row with the highest value in each group, the lowest price on ties."""
    return best_row(rows.where(F.col(value).isNotNull()), [by], [-F.col(value)])


def price_means(curve: DataFrame, value: str = "score", by: str = "product") -> DataFrame:
    """Mean value at each price of a group."""
    return curve.groupBy(by, "price").agg(F.avg(value).alias("value"))


def marginal_revenue(points: DataFrame, by: str = "product") -> DataFrame:
    """Adds `slope` and `points`: central difference of value over price, one-sided at the ends."""
    line = Window.partitionBy(by).orderBy("price")
    before_v, after_v = F.lag("value").over(line), F.lead("value").over(line)
    before_p, after_p = F.lag("price").over(line), F.lead("price").over(line)
    dv = F.coalesce(after_v, F.col("value")) - F.coalesce(before_v, F.col("value"))
    dp = F.coalesce(after_p, F.col("price")) - F.coalesce(before_p, F.col("price"))
    slope = dv / F.when(dp == 0, 1e-6).otherwise(dp)
    return points.withColumns({"slope": slope, "points": F.count(F.lit(1)).over(Window.partitionBy(by))})


def stable_points(points: DataFrame, by: str = "product", max_slope: float = MAX_SLOPE) -> DataFrame:
    """Points with a believable slope; a single price is kept untested."""
    steep = marginal_revenue(points, by)
    return steep.where((F.col("points") < 2) | (F.abs("slope") < max_slope)).drop("slope", "points")


def frontier(points: DataFrame, by: str = "product") -> DataFrame:
    """Points for which no higher price earns as much."""
    higher = Window.partitionBy(by).orderBy("price").rowsBetween(1, Window.unboundedFollowing)
    best_above = F.max("value").over(higher)
    return (
        points.withColumn("_above", best_above)
        .where(F.col("_above").isNull() | (F.col("_above") < F.col("value")))
        .drop("_above")
    )


def frontier_price(points: DataFrame, by: str = "product", max_drop: float = MAX_REVENUE_DROP) -> DataFrame:
    """(group, price): highest frontier price within `max_drop` of the frontier's best value."""
    top = F.max("value").over(Window.partitionBy(by))
    near = points.withColumn("_top", top).where(F.col("value") >= F.lit(1.0 - max_drop) * F.col("_top"))
    return near.groupBy(by).agg(F.max("price").alias("price"))


def rows_at_price(curve: DataFrame, by: str = "product") -> DataFrame:
    """One row for each group and price: the one with the best expected revenue."""
    return best_row(curve, [by, "price"], [-F.col("revenue_p50")])


def choose_prices(
    curve: DataFrame, min_support: int = FRONTIER_MIN_SUPPORT, max_drop: float = MAX_REVENUE_DROP
) -> DataFrame:
    """The frontier choice of each product as a full curve row.

    A product without a sufficiently supported price falls back to its most supported row.
    Windows run over the price points of a product, never over its rows.
    """
    scored = positive_scores(curve)
    supported = price_means(scored.where(F.col("support_count") >= min_support))
    price = frontier_price(frontier(stable_points(supported)), max_drop=max_drop)
    # first down to the few rows that can win, then one row for each product
    at_price = scored.join(price, ["product", "price"], "left_semi")
    picked = best_row(at_price, ["product"], [-F.col("revenue_p50")])
    return picked.unionByName(best_row(not_covered(scored, price), ["product"], [-F.col("support_count")]))


def highest_score(curve: DataFrame) -> DataFrame:
    """Row with the highest positive score of each product."""
    return pick_best(positive_scores(curve), "product", "score")


BEST_COLUMNS = ["product", "item_id", "price", "asp", "units_p50", "revenue_p50", "support_count"]


def best_expected(curve: DataFrame, min_support: int = BEST_MIN_SUPPORT) -> DataFrame:
    """Best expected revenue row of each product, well supported rows first."""
    known = curve.where(F.col("revenue_p50").isNotNull())
    tier = F.when(F.col("support_count") >= min_support, 0).otherwise(1)
    return best_row(known, ["product"], [tier, -F.col("revenue_p50")]).select(*BEST_COLUMNS)


def best_expected_by_tiers(curve: DataFrame, min_support: int = BEST_MIN_SUPPORT) -> DataFrame:
    """The same choice as two tiers: supported products, then the products not yet covered."""
    known = curve.where(F.col("revenue_p50").isNotNull())
    high = best_row(known.where(F.col("support_count") >= min_support), ["product"], [-F.col("revenue_p50")])
    low = best_row(not_covered(known, high), ["product"], [-F.col("revenue_p50")])
    return high.unionByName(low).select(*BEST_COLUMNS)


def nearest_rows(curve: DataFrame, wanted: DataFrame, by: str = "product", price: str = "asp") -> DataFrame:
    """Curve row whose price is nearest to the wanted one, the lower price on ties.

    `wanted` has one row (group, wanted_price) for a group. The curve is first reduced to
    one row for each price, so a group with very many rows does not weigh on the join.
    """
    points = best_row(curve.where(F.col(price).isNotNull()), [by, price], [-F.col("revenue_p50")])
    met = points.join(wanted.where(F.col("wanted_price").isNotNull()), by)
    distance = F.abs(F.col(price) - F.col("wanted_price"))
    return best_row(met.withColumn("distance", distance), [by], [F.col("distance"), F.col(price)]).drop("distance")
