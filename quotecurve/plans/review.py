"""Price review: sales and products to all report frames."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import to_cents
from ..operators import choose, curve, elasticity, prepare, report, resample, shape, tuning, weights
from ..session import materialise, steps

CURVE_KEYS = ["product", "item_id", "period_start", "event_name"]
ROW_KEY = ["product", "item_id", "period_start", "event_name"]  # tells the rows of a group apart
UNITS = ["units_p025", "units_p50", "units_p975", "units_bau_p025", "units_bau_p50", "units_bau_p975"]


@dataclass(frozen=True)
class Options:
    """What a review does beyond the plain fit; every default keeps the plain one.

    half_life: of the recency weights, None for equal ones. support: weight rows by how near their price's
    neighbours are ('neighbours') or by the price density ('density'). rarity: boost thinly sold tails.
    robust_rows: weigh rows down by their out-of-fold residual. anchors: two light rows outside each price
    range. tuned: take the spline count from the search; held_out: judge candidates by the last fifth of the
    dates. max_rounds: of the fit. monotone: curves that never rise with price. taper: shrink predictions
    beyond the outer price quantiles. ordered: bands that never cross. grid_points: prices of the frame
    'price_grid'. bootstrap: add the frame 'bands' with replicates up to this target error.
    """

    half_life: float | None = weights.HALF_LIFE_DAYS
    support: str | None = None
    rarity: bool = False
    robust_rows: bool = False
    anchors: bool = False
    tuned: bool = False
    held_out: bool = False
    max_rounds: int = curve.MAX_ROUNDS
    monotone: bool = False
    taper: bool = False
    ordered: bool = False
    grid_points: int | None = None
    bootstrap: float | None = None


PLAIN = Options()


def model_rows(periods: DataFrame, half_life: float | None = weights.HALF_LIFE_DAYS, options: Options = PLAIN) -> DataFrame:
    """Period rows with codes and weights, ready for the fit."""
    table = None
    if options.support == "neighbours":
        table = weights.neighbour_support(periods)
    elif options.support == "density":
        table = weights.density_support(periods)
    elif options.support is not None:
        raise ValueError(f"support is neighbours or density, not {options.support}")
    rows = weights.with_weights(prepare.with_codes(periods), half_life=half_life, support=table)
    if options.rarity:
        rare = weights.smoothed_rarity(periods)
        rows = rows.withColumn("cents", to_cents(F.col("price"))).join(rare, ["product", "cents"], "left")
        rows = rows.withColumn("weight", F.col("weight") * F.coalesce("rarity", F.lit(1.0))).drop("cents", "rarity")
    if options.robust_rows:
        rows = resample.robust_weights(materialise(rows, "weighted"), ROW_KEY)
    return rows


def response_curve(rows: DataFrame, models: DataFrame, options: Options = PLAIN) -> DataFrame:
    """Observed periods with support counts, predictions and actual revenue."""
    base = rows.select(
        *CURVE_KEYS,
        "event_code",
        F.col("price").cast("double").alias("price"),
        F.col("price").cast("double").alias("asp"),
        F.col("revenue").cast("double").alias("revenue_actual"),
    )
    scored = curve.score_curves(choose.with_support(base), models)
    return report.sanitise_predictions(shaped(scored, options)).drop("event_code")


def shaped(scored: DataFrame, options: Options) -> DataFrame:
    """Predictions with the wanted shape: falling with price, tapered at the ends, bands in order."""
    out = scored
    if options.monotone:
        for c in UNITS:
            points = materialise(out.groupBy("product", "price").agg(F.avg(c).alias("value")), "points")
            held = shape.monotone_curve(points, "value").withColumnRenamed("value", "_held")
            mean = points.withColumnRenamed("value", "_mean")
            # an event lifts or lowers the curve at its price, so rows keep their relation to the mean there
            out = out.join(held, ["product", "price"], "left").join(mean, ["product", "price"], "left")
            out = out.withColumn(c, F.when(F.col("_mean") > 0, F.col(c) * F.col("_held") / F.col("_mean")).otherwise(F.col("_held"))).drop("_held", "_mean")
    if options.taper:
        out = shape.taper_edges(out, UNITS)
    if options.ordered:
        out = shape.ordered_bands(out, "units_p025", "units_p50", "units_p975")
        out = shape.ordered_bands(out, "units_bau_p025", "units_bau_p50", "units_bau_p975")
    if options.monotone or options.taper or options.ordered:
        out = out.withColumns({c.replace("units", "revenue"): F.col("price") * F.col(c) for c in UNITS})
    return out


def fitted_models(rows: DataFrame, tuned: bool = False, n_splines: int | None = None, options: Options = PLAIN) -> DataFrame:
    """Model table; with `tuned` the spline count comes from the search (one small row)."""
    if tuned or options.tuned:
        judged = weights.split_by_time(rows) if options.held_out else rows
        n_splines = tuning.tune(judged, split="split" if options.held_out else None).first()["n_splines"]
    if options.anchors:
        light = shape.anchor_rows(rows).withColumn("event_code", F.lit(0))
        rows = rows.unionByName(light.select(*[(F.col(c) if c in light.columns else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes]))
    return curve.fit_curves(rows, n_splines=n_splines, max_rounds=options.max_rounds)


def price_review(
    sales: DataFrame,
    products: DataFrame,
    top_n: int | None = prepare.TOP_N,
    granularity: str = "weekly",
    tuned: bool = False,
    robust: bool = True,
    options: Options = PLAIN,
) -> dict[str, DataFrame]:
    """All report frames by name; see `Options` for what they can be made with.

    Period rows and the curve are written once; every report reads those tables.
    """
    with steps(sales.sparkSession) as result:
        periods = result(prepare.prepare(sales, products, top_n, granularity), "periods")
    rows = materialise(model_rows(periods, options.half_life, options), "model_rows")
    models = fitted_models(rows, tuned, options=options)
    response = materialise(response_curve(rows, models, options), "curve")
    more = {}
    if options.grid_points:
        more["price_grid"] = report.sanitise_predictions(curve.score_grid(models, options.grid_points))
    if options.bootstrap:
        more["bands"] = resample.bootstrap_until(rows, ROW_KEY, options.bootstrap, max_rounds=options.max_rounds)
    best = choose.best_expected(response)
    chosen = choose.choose_prices(response)
    current = report.current_prices(products)
    slopes = materialise(
        elasticity.label_slopes(elasticity.elasticity_slopes(periods, robust)), "elasticity"
    )
    return {
        "price_quantity": prepare.price_quantity(periods),
        "best_average": choose.highest_score(response),
        "best_frontier": chosen,
        "curve": response,
        "best_expected": best,
        "elasticity": slopes.orderBy(F.col("magnitude").desc_nulls_last(), "product"),
        "current_prices": current,
        "opportunities": report.opportunity_summary(best, response, current),
        "coverage": report.date_coverage(sales),
        "fit_quality": report.fit_quality(response),
        "models": models,
        "overview": report.overview_cards(sales, products, response, best, slopes),
        **more,
    }
