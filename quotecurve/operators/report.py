"""Report frames: fit quality, scenarios, opportunities and the overview cards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.events import BASELINE
from .choose import best_row, nearest_rows, rows_at_price
from .joins import salted_join
from .ranks import quantiles, ranked_values

ANNUAL_FACTOR = 365
TOP_UPSIDES = 12
PAGE_SIZE = 25

# Older column names of a curve frame and their current names.
COLUMN_VARIANTS = {
    "rev_p025": "revenue_p025",
    "rev_p50": "revenue_p50",
    "rev_p975": "revenue_p975",
    "revenue_pred_p025": "revenue_p025",
    "revenue_pred_p50": "revenue_p50",
    "revenue_pred_p975": "revenue_p975",
    "revenue_pred_0.025": "revenue_p025",
    "revenue_pred_0.5": "revenue_p50",
    "revenue_pred_0.975": "revenue_p975",
}
CURVE_COLUMNS = ["product", "asp", "revenue_actual", "revenue_p025", "revenue_p50", "revenue_p975"]

# The three scenarios and their columns.
SCENARIOS = [
    ("Conservative", "revenue_p025", "units_p025"),
    ("Expected", "revenue_p50", "units_p50"),
    ("Optimistic", "revenue_p975", "units_p975"),
]

# Column order of the opportunity table.
OPPORTUNITY_ORDER = [
    "item_id",
    "product",
    "asp",
    "days_asp_valid",
    "days_sold",
    "shipped_units",
    "daily_units",
    "revenue_actual",
    "daily_rev",
    "revenue_p025",
    "revenue_p50",
    "revenue_p975",
    "units_p025",
    "units_p50",
    "units_p975",
]

# Confidence score.
SPREAD_SHARE, ELASTICITY_SHARE = 0.4, 0.6
SPREAD_SCALE = 0.1
PRICES_SCALE = 6.0
STRONG_FROM, MEDIUM_FROM = 0.70, 0.45


def date_coverage(sales: DataFrame) -> DataFrame:
    """One row: first day, last day and the number of days between them, both included."""
    span = sales.agg(F.min("order_date").alias("data_start"), F.max("order_date").alias("data_end"))
    days = F.coalesce(F.datediff("data_end", "data_start") + 1, F.lit(0))
    return span.withColumn("days_covered", days)


def prediction_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("units_p", "revenue_p", "units_bau_p", "revenue_bau_p"))]


def sanitise_predictions(curve: DataFrame) -> DataFrame:
    """Missing predictions become 0, negative ones are clipped at 0."""
    clean = {c: F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for c in prediction_columns(curve)}
    return curve.withColumns(clean)


def normalise_curve(curve: DataFrame) -> DataFrame:
    """One schema from the column name variants; fails when a required column is missing."""
    names = {old: new for old, new in COLUMN_VARIANTS.items() if old in curve.columns and new not in curve.columns}
    if "asp" not in curve.columns and "price" in curve.columns:
        names["price"] = "asp"
    if "revenue_actual" not in curve.columns:
        for old in ("actual_revenue", "revenue"):
            if old in curve.columns:
                names[old] = "revenue_actual"
                break
    out = curve.withColumnsRenamed(names)
    missing = [c for c in CURVE_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"curve frame: missing columns {missing}")
    if "event_name" not in out.columns:
        out = out.withColumn("event_name", F.lit(None).cast("string"))
    return out


def ordered_columns(df: DataFrame, order: list[str] = OPPORTUNITY_ORDER) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def slice_rows(rows: DataFrame, items: list[str] | None = None, products: list[str] | None = None) -> DataFrame:
    """Rows of some items, some products, or both; all rows where neither is named."""
    out = rows
    if items is not None:
        out = out.where(F.col("item_id").isin(*items))
    if products is not None:
        out = out.where(F.col("product").isin(*products))
    return out


def curve_in_price_order(curve: DataFrame, price: str = "asp", by: str = "product") -> DataFrame:
    """Curve rows of each product by rising price, with their `place` (1 first; equal prices share it).

    Price points of a product are ranked by its own cut values, so no task holds a whole product.
    """
    spots = curve.where(F.col(price).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(price).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    places = ranked_values(spots, "_p", "_n", by=("_g",)).select("_g", "_p", (F.col("code") + 1).cast("int").alias("place"))
    met = curve.join(places, F.col(by).eqNullSafe(F.col("_g")) & (F.col(price) == F.col("_p")), "left")
    return met.drop("_g", "_p").orderBy(by, F.col(price).asc_nulls_last())


def discounted_revenue(price: Column, units: Column, percent: Column) -> Column:
    """Revenue of units sold at a price less a discount in percent."""
    return price * (F.lit(1.0) - percent / 100.0) * units


def with_actuals(curve: DataFrame, periods: DataFrame, fan_out: bool = False) -> DataFrame:
    """Actual revenue on the curve rows.

    A curve that carries it only gets missing values filled; otherwise it is looked up by
    product and price, with the discount-scaled revenue beside it. Periods of one product and
    price are summed first (their discount is the mean weighted by revenue), so each curve row
    stays one row; `fan_out` repeats it for every such period instead.
    """
    if "revenue_actual" in curve.columns:
        return curve.withColumn("revenue_actual", F.coalesce("revenue_actual", F.lit(0.0)))
    price, units = F.col("price").cast("double"), F.col("shipped_units").cast("double")
    actual = periods.select(
        "product", price.alias("price"), (price * units).alias("revenue_actual"), units.alias("units_actual"),
        F.greatest(F.coalesce("deal_discount_percent", F.lit(0.0)), F.lit(0.0)).alias("deal_discount_percent"),
    )
    if not fan_out:
        cut = F.sum(F.col("revenue_actual") * F.col("deal_discount_percent")) / F.nullif(F.sum("revenue_actual"), F.lit(0.0))
        actual = actual.groupBy("product", "price").agg(
            F.sum("revenue_actual").alias("revenue_actual"),
            F.sum("units_actual").alias("units_actual"),
            F.coalesce(cut, F.lit(0.0)).alias("deal_discount_percent"),
        )
    joined = curve.join(actual, ["product", "price"], "left")
    discount = F.coalesce("deal_discount_percent", F.lit(0.0))
    revenue = F.coalesce("revenue_actual", F.lit(0.0))
    return joined.withColumns(
        {
            "revenue_actual": revenue,
            "deal_discount_percent": discount,
            "daily_rev": revenue,
            "actual_revenue_scaled": discounted_revenue(F.col("price"), F.col("units_actual"), discount),
        }
    )


def fit_quality(curve: DataFrame) -> DataFrame:
    """One row: revenue-weighted relative error of the expected curve, and of `weighted_pred` if there."""
    days = F.nullif(F.col("days_sold").cast("double"), F.lit(0.0)) if "days_sold" in curve.columns else F.lit(None).cast("double")

    def error(predicted: Column) -> Column:
        actual = F.col("revenue_actual")
        daily_actual = F.coalesce(actual / days, actual)
        daily_predicted = F.coalesce(predicted / days, predicted)
        usable = (daily_actual > 0) & daily_predicted.isNotNull()
        weight = F.when(usable, actual)
        relative = F.when(usable, (daily_predicted - daily_actual) / F.nullif(daily_actual, F.lit(0.0)))
        return F.when(F.sum(weight) > 0, F.sum(relative * weight) / F.sum(weight))

    weighted = error(F.col("weighted_pred") * F.col("price")) if "weighted_pred" in curve.columns else F.lit(None).cast("double")
    return curve.agg(error(F.col("revenue_p50")).alias("pct_diff_p50"), weighted.alias("pct_diff_weighted"))


def fit_card(curve: DataFrame, by: str = "item_id") -> DataFrame:
    """(group, rmse, relative_error) of mean expected against mean actual revenue by price."""
    means = (
        curve.where(F.col("asp").isNotNull() & F.col("revenue_actual").isNotNull() & F.col("revenue_p50").isNotNull())
        .groupBy(by, "asp")
        .agg(F.avg("revenue_actual").alias("actual"), F.avg("revenue_p50").alias("predicted"))
    )
    gap = F.col("predicted") - F.col("actual")
    earning = F.when(F.col("actual") > 0, F.col("actual"))
    return means.groupBy(by).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.when(F.sum(earning) > 0, F.sum(F.when(F.col("actual") > 0, gap)) / F.sum(earning)).alias("relative_error"),
    )


def band_coverage(curve: DataFrame, by: str = "item_id") -> DataFrame:
    """(group, points, coverage): share of actual revenues inside the band."""
    inside = F.col("revenue_actual").between(F.col("revenue_p025"), F.col("revenue_p975"))
    return curve.groupBy(by).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.coalesce(inside, F.lit(False)).cast("int")).alias("coverage")
    )


def weighted_squared_error(rows: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return rows.agg((F.sum(F.col(weight) * e * e) / F.sum(weight)).alias("loss"))


def current_prices(products: DataFrame) -> DataFrame:
    """(item, current_price): one known price for an item."""
    return products.groupBy("item_id").agg(F.min("current_price").cast("double").alias("current_price"))


def products_lookup(*frames: DataFrame) -> DataFrame:
    """Distinct (product, item) pairs of all frames that have both."""
    parts = [f.select("product", F.col("item_id").cast("string")) for f in frames if {"product", "item_id"} <= set(f.columns)]
    if not parts:
        raise KeyError("no frame has both product and item_id")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropna().distinct()


def common_products(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("product")
    for f in frames[1:]:
        out = out.intersect(f.select("product"))
    return out


def annual(c: str, factor: float = ANNUAL_FACTOR) -> Column:
    """A column of one period for a whole year, as `<name>_annual`."""
    return (F.col(c) * F.lit(float(factor))).alias(f"{c}_annual")


def opportunity_summary(
    best: DataFrame, curve: DataFrame, current: DataFrame, annual_factor: float = ANNUAL_FACTOR
) -> DataFrame:
    """Gain of the recommended over the current price of each product, by period and by year."""
    known = best.join(current, "item_id", "left")
    wanted = known.select("product", F.col("current_price").alias("wanted_price"))
    now = nearest_rows(curve, wanted).select(
        "product", F.col("units_p50").alias("units_curr"), F.col("revenue_p50").alias("revenue_curr")
    )
    rows = known.join(now, "product", "left").select(
        "product",
        "item_id",
        "current_price",
        F.col("price").alias("best_price"),
        F.col("units_p50").alias("units_best"),
        "units_curr",
        F.col("revenue_p50").alias("revenue_best"),
        "revenue_curr",
        (F.col("units_p50") - F.col("units_curr")).alias("delta_units"),
        (F.col("revenue_p50") - F.col("revenue_curr")).alias("delta_revenue"),
    )
    return rows.select(
        "*", *[annual(c, annual_factor) for c in ("delta_units", "delta_revenue", "revenue_best")]
    )


def upside_chart(
    elasticity: DataFrame, best: DataFrame, current_by_product: DataFrame, curve: DataFrame, n: int = TOP_UPSIDES
) -> DataFrame:
    """The n products with the largest upside over their current price, with elasticity."""
    wanted = current_by_product.select("product", F.col("current_price").alias("wanted_price"))
    priced = curve.where(F.col("asp").isNotNull() & F.col("revenue_p50").isNotNull())
    now = nearest_rows(priced, wanted).select("product", F.col("revenue_p50").alias("revenue_curr"))
    rows = (
        best.where(F.col("revenue_p50").isNotNull())
        .join(now, "product")
        .join(elasticity.select("product", F.col("ratio").alias("elasticity")), "product", "left")
        .select("product", (F.col("revenue_p50") - F.col("revenue_curr")).alias("upside"), "elasticity")
    )
    return rows.orderBy(F.col("upside").desc(), "product").limit(n)


def scenario_table(curve: DataFrame, by: str = "item_id") -> DataFrame:
    """Peak price and revenue of each band as texts: conservative, expected, optimistic.

    With `weighted_pred` there is a recommended case; with `current_price` a current one
    (the first row of the group in time).
    """
    cases = [(label, revenue, [-F.col(revenue)], "price") for label, revenue, _ in SCENARIOS]
    if "weighted_pred" in curve.columns:
        cases.insert(1, ("Recommended (Weighted)", "revenue_p50", [-F.col("weighted_pred")], "price"))
    if "current_price" in curve.columns:
        cases.insert(0, ("Current Price", "revenue_p50", [F.col("period_start")], "current_price"))
    ties = [F.col(c) for c in ("price", "period_start", "event_name")]
    picks = [
        F.min_by(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(label).alias("case"),
                F.col(price).cast("double").alias("price"),
                F.col(revenue).alias("revenue"),
            ),
            F.struct(*order, *ties),
        ).alias(f"c{place}")
        for place, (label, revenue, order, price) in enumerate(cases)
    ]
    rows = curve.groupBy(by).agg(*picks)
    each = rows.select(by, F.explode(F.array(*[f"c{i}" for i in range(len(cases))])).alias("c"))
    return each.select(
        by,
        F.col("c.place").alias("place"),
        F.col("c.case").alias("case"),
        text.money_text(F.col("c.price"), 2).alias("price"),
        text.money_text(F.col("c.revenue")).alias("revenue"),
    )


def annual_deltas(
    best: DataFrame, current: DataFrame, curve: DataFrame, annual_factor: float = ANNUAL_FACTOR
) -> DataFrame:
    """Yearly change in units and revenue for each recommended item, both ends read from its curve."""
    recommended = best.groupBy("item_id").agg(F.min("asp").alias("wanted_price"))
    now = current.select("item_id", F.col("current_price").alias("wanted_price"))
    ends = {}
    for name, wanted in (("best", recommended), ("curr", now.join(recommended.select("item_id"), "item_id", "left_semi"))):
        ends[name] = nearest_rows(curve, wanted, by="item_id").select(
            "item_id", F.col("units_p50").alias(f"units_{name}"), F.col("revenue_p50").alias(f"revenue_{name}")
        )
    rows = ends["best"].join(ends["curr"], "item_id")
    factor = F.lit(float(annual_factor))
    units = (F.col("units_best") - F.col("units_curr")) * factor
    revenue = (F.col("revenue_best") - F.col("revenue_curr")) * factor
    return rows.select(
        "item_id",
        units.alias("units_delta_annual"),
        revenue.alias("revenue_delta_annual"),
        text.signed_units_text(units).alias("units_text"),
        text.signed_money_text(revenue).alias("revenue_text"),
    )


def curve_frame(curve: DataFrame) -> DataFrame:
    """Plot data: bands, expected curve (baseline curve if there), actuals by kind and the peaks."""
    df = normalise_curve(curve).where(F.col("asp").isNotNull())
    shown = {
        n: (f"revenue_bau_{n}" if f"revenue_bau_{n}" in df.columns else f"revenue_{n}") for n in ("p025", "p50", "p975")
    }
    promo = F.col("event_name").isNotNull() & (F.col("event_name") != BASELINE)
    peaks = df.groupBy("product").agg(
        *[
            F.max_by("asp", F.struct(revenue, -F.col("asp"))).alias(f"peak_{revenue.removeprefix('revenue_')}")
            for _, revenue, _ in SCENARIOS
        ]
    )
    ordered = ["item_id", "period_start"] if "period_start" in df.columns else ["item_id"]
    joined = salted_join(df, peaks, on=["product"], spread_by=[*ordered, "event_name"])
    return joined.select(
        "product",
        *ordered,
        "event_name",
        "asp",
        F.col(shown["p025"]).alias("low"),
        F.col(shown["p50"]).alias("expected"),
        F.col(shown["p975"]).alias("high"),
        "revenue_actual",
        F.when(promo, "promotion").otherwise("baseline").alias("kind"),
        "peak_p025",
        "peak_p50",
        "peak_p975",
    )


def confidence(curve: DataFrame, by: str = "product") -> DataFrame:
    """Confidence label of a recommendation: band peaks close together, low elasticity, many prices.

    `curve` may carry `elasticity`; without it that part scores 0.
    """
    low, mid, high = [F.max_by("asp", F.struct(r, -F.col("asp"))) for _, r, _ in SCENARIOS]
    has_elasticity = "elasticity" in curve.columns
    e = F.col("elasticity") if has_elasticity else F.lit(None).cast("double")
    points = rows_at_price(curve, by)
    peak = points.groupBy(by).agg(
        low.alias("low"),
        mid.alias("mid"),
        high.alias("high"),
        F.countDistinct("asp").alias("prices"),
        F.min(e).alias("e_min"),
        F.max(e).alias("e_max"),
        F.max_by(e, F.struct("revenue_p50", -F.col("asp"))).alias("e_mid"),
    )
    apart = F.greatest("low", "mid", "high") - F.least("low", "mid", "high")
    known = F.col("low").isNotNull() & F.col("mid").isNotNull() & F.col("high").isNotNull() & (F.col("mid") != 0)
    spread = F.when(known, F.exp(-apart / (F.lit(SPREAD_SCALE) * F.col("mid")))).otherwise(0.0)
    elastic = (
        F.when(F.col("e_mid").isNull(), 0.0)
        .when(F.col("e_max") > F.col("e_min"), 1.0 - (F.col("e_mid") - F.col("e_min")) / (F.col("e_max") - F.col("e_min")))
        .otherwise(1.0)
    )
    trust = 0.6 + 0.4 * (1.0 - F.exp(-F.col("prices") / F.lit(PRICES_SCALE)))
    scored = peak.withColumn("score", (SPREAD_SHARE * spread + ELASTICITY_SHARE * elastic) * trust)
    label = F.when(F.col("score") >= STRONG_FROM, "Strong").when(F.col("score") >= MEDIUM_FROM, "Medium").otherwise("Weak")
    return scored.select(by, "score", label.alias("confidence"))


def selector_list(best: DataFrame) -> DataFrame:
    """Products to choose from, best revenue first."""
    rows = best.select("product", "item_id", "revenue_p50").dropna(subset=["item_id"])
    return rows.orderBy(F.col("revenue_p50").desc(), "product")


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` (0-based) of a sorted report."""
    return df.orderBy(*order).offset(number * size).limit(size)


def unseen_error(rows: DataFrame, actual: str, predicted: str, by: str = "product") -> DataFrame:
    """RMSE of each group, and as a share of the median actual (at least 1)."""
    counts = rows.groupBy(by, actual).agg(F.count(F.lit(1)).alias("n"))
    middle = quantiles(counts.where(F.col(actual).isNotNull()), actual, "n", [0.5], (by,)).select(by, F.col("cuts")[0].alias("median"))
    e = F.col(actual) - F.col(predicted)
    errors = rows.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.col("price").cast("double")).alias("mean_price"))
    return errors.join(middle, by).select(
        by,
        "rmse",
        (F.col("rmse") / F.greatest(F.col("median"), F.lit(1.0))).alias("rmse_share"),
        (F.col("rmse") * F.col("mean_price")).alias("rmse_money"),
    )


def portfolio_error(errors: DataFrame) -> DataFrame:
    """Median RMSE over all groups."""
    values = errors.where(F.col("rmse").isNotNull()).groupBy("rmse").agg(F.count(F.lit(1)).alias("n"))
    median = quantiles(values, "rmse", "n", [0.5]).select(F.col("cuts")[0]).scalar()
    return errors.agg(F.count(F.lit(1)).alias("groups")).select(median.alias("median_rmse"), "groups")


def overview_cards(
    sales: DataFrame,
    products: DataFrame,
    curve: DataFrame,
    best: DataFrame,
    elasticity: DataFrame,
    annual_factor: float = ANNUAL_FACTOR,
) -> DataFrame:
    """The overview of every item on the curve, one row each."""
    span = date_coverage(sales).agg(
        F.struct(
            F.first("days_covered").alias("days"), F.first("data_start").alias("start"), F.first("data_end").alias("end")
        )
    ).scalar()
    current = current_prices(products)
    names = best_row(
        curve.select("item_id", "product", "price").where(F.col("product").isNotNull()), ["item_id"], [F.col("product")]
    ).select("item_id", "product")
    recommended = best.groupBy("item_id").agg(F.min("asp").alias("recommended_price"))
    slopes = elasticity.select(
        "product",
        F.format_number("ratio", 2).alias("elasticity"),
        F.concat_ws(
            " • ", text.demand_class(F.col("magnitude")), text.sensitivity_rank_text(F.col("elasticity_score"))
        ).alias("elasticity_note"),
    )
    deltas = annual_deltas(best, current, curve, annual_factor).select("item_id", "units_text", "revenue_text")
    rows = (
        names.join(current, "item_id", "left")
        .join(recommended, "item_id", "left")
        .join(deltas, "item_id", "left")
        .join(fit_card(curve), "item_id", "left")
        .join(band_coverage(curve), "item_id", "left")
    )
    rows = salted_join(rows, slopes, on=["product"], spread_by=["item_id"])
    return rows.select(
        "item_id",
        "product",
        F.format_number(span["days"], 0).alias("days"),
        F.concat_ws(" to ", text.date_text(span["start"]), text.date_text(span["end"])).alias("period"),
        text.money_text(F.col("current_price"), 2).alias("current_price"),
        text.money_text(F.col("recommended_price"), 2).alias("recommended_price"),
        F.coalesce("elasticity", F.lit("N/A")).alias("elasticity"),
        F.coalesce("elasticity_note", F.lit("No data")).alias("elasticity_note"),
        F.coalesce("units_text", F.lit(text.DASH)).alias("units_delta"),
        F.coalesce("revenue_text", F.lit(text.DASH)).alias("revenue_delta"),
        text.money_text(F.col("rmse")).alias("fit"),
        "relative_error",
        "points",
        "coverage",
    )


