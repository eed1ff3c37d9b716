"""Checks of the fits, the search and the whole review."""

import uuid
from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from quotecurve.functions.money import to_cents
from quotecurve.functions.text import money_text
from quotecurve.operators import curve as crv
from quotecurve.operators import resample as rsm
from quotecurve.operators import tuning as tun
from quotecurve.operators import weights as wt
from quotecurve.plans import review
from quotecurve.session import ensure_checkpoint_dir, materialise
from quotecurve.sources import retail
from quotecurve.sources.files import SALES_COLUMNS, read_product_files, read_sales_files, write_records, write_sales

from .base import compose, cte
from .decisions import best, rounded
from .sold import prepared_rows, sales, thick_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["product", "item_id", "period_start", "event_name"]
LAW_COLUMNS = ["units_p025", "units_p50", "units_p975", "units_bau_p50"]


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


@lru_cache
def all_rows(spark, folder):
    """Coded and weighted weekly rows of all products."""
    return materialise(review.model_rows(thick_rows(spark, folder)), "all_rows")


@lru_cache
def models(spark, folder):
    """Curves of all products."""
    return materialise(crv.fit_curves(all_rows(spark, folder)), "models")


@lru_cache
def frames(spark, folder):
    return review.price_review(sales(spark, folder), retail.products(spark, folder))


# ---- bins ---------------------------------------------------------------------------------

cte("unit_rows", "SELECT product, cents / 100.0::DOUBLE AS price, shipped_units::DOUBLE AS y, 1.0::DOUBLE + shipped_units % 3 AS w FROM thick")
cte(
    "bin_edges",
    "SELECT product, list_distinct(quantile_cont(price, [i / 20.0::DOUBLE for i in range(21)])) AS q FROM unit_rows GROUP BY product",
)
_MEANS = """round(sqrt(sum(w * price) / sum(w)), 7) AS price, round(sqrt(sum(w * y) / sum(w)), 7) AS target, sum(w) AS weight"""


def _bin_roots(df):
    return df.withColumns({c: F.round(F.sqrt(c), 7) for c in ("price", "target")})


@check(
    "a13_price_bins",
    f"""SELECT CAST(bin AS INTEGER) AS bin, {_MEANS} FROM (
SELECT u.*, len(list_filter(e.q[2:-2], lambda x: x <= u.price)) AS bin
FROM unit_rows u, (SELECT list_sort(list_distinct(quantile_cont(price, [i / 20.0::DOUBLE for i in range(21)]))) AS q FROM unit_rows) e) GROUP BY bin""",
)
def price_bins(spark, folder):
    rows = thick_rows(spark, folder).withColumn("weight", F.lit(1.0) + F.col("shipped_units") % 3)
    return _bin_roots(tun.price_bins(rows))


@check(
    "a13_price_bins_by_product",
    f"""SELECT product, CAST(bin AS INTEGER) AS bin, {_MEANS} FROM (
SELECT u.*, len(list_filter(list_sort(e.q)[2:-2], lambda x: x <= u.price)) AS bin FROM unit_rows u JOIN bin_edges e USING (product)) GROUP BY product, bin""",
)
def price_bins_by_product(spark, folder):
    rows = thick_rows(spark, folder).withColumn("weight", F.lit(1.0) + F.col("shipped_units") % 3)
    return _bin_roots(tun.price_bins(rows, by="product"))


@check(
    "a15_gamma_deviance",
    """SELECT round(sum(w * 2 * ((y - m) / m - ln(y / m))) / sum(w), 8) AS loss FROM (SELECT *, 60 - price / 50 AS m FROM unit_rows)""",
)
def gamma_deviance(spark, folder):
    rows = thick_rows(spark, folder).withColumn("weight", F.lit(1.0) + F.col("shipped_units") % 3)
    sums = tun.price_sums(rows)
    loss = tun.gamma_deviance(sums, F.lit(60) - F.col("price") / 50)
    return rounded(sums.agg(loss.alias("loss")), loss=8)


# ---- search -------------------------------------------------------------------------------


@check(
    "c10_coarse_grid",
    """SELECT CAST(ns AS INTEGER) AS n_splines, round(pow(10.0::DOUBLE, -3 + 0.75 * i), 9) AS lam_prime,
round(pow(10.0::DOUBLE, -3 + 0.75 * i) / (ns * ns), 9) AS lam, count(DISTINCT l_orderkey) AS n
FROM lineitem, (SELECT unnest([8, 12, 16, 20, 24, 28, 32, 40]) AS ns), range(9) r(i) WHERE l_linenumber = CAST(i % 7 + 1 AS INTEGER) GROUP BY ns, i""",
)
def coarse_grid(spark, folder):
    lines = retail.table(spark, folder, "lineitem").groupBy("l_linenumber").agg(F.countDistinct("l_orderkey").alias("n"))
    grid = tun.coarse_grid(spark)
    place = F.round((F.log10("lam_prime") + 3) / 0.75).cast("int")
    joined = grid.withColumn("l_linenumber", place % 7 + 1).join(lines, "l_linenumber")
    return rounded(joined.select("n_splines", "lam_prime", "lam", "n"), lam_prime=9, lam=9)


# All candidates of the coarse grid: what a loss differs by from the rows' own mean deviance, computed row by
# row from the emitted coefficients, must be nothing.
GRID = """SELECT CAST(ns AS INTEGER) AS n_splines, round(pow(10.0::DOUBLE, -3 + 0.75 * i), 9) AS lam_prime,
round(pow(10.0::DOUBLE, -3 + 0.75 * i) / (ns * ns), 9) AS lam, (SELECT count(*) FROM {rows}) AS judged, 0.0::DOUBLE AS gap
FROM (SELECT unnest([8, 12, 16, 20, 24, 28, 32, 40]) AS ns), range(9) r(i)"""


def loss_gaps(rows, bins, sums):
    """Candidates with the gap between their loss over sums by price and over the rows themselves."""
    fits = tun.fit_candidates(tun.coarse_grid(rows.sparkSession), bins)
    told = tun.candidate_mean(sums, fits)
    told = told.groupBy(*tun.CANDIDATE).agg(tun.gamma_deviance(told, F.col("mean")).alias("loss"))
    each = tun.candidate_mean(tun.finite_triples(rows, "price", "shipped_units", "weight", []), fits)
    y, m = F.greatest("target", F.lit(tun.SMALLEST_TARGET)), F.greatest("mean", F.lit(tun.SMALLEST_TARGET))
    deviance = F.sum(F.col("weight") * 2 * ((y - m) / m - F.ln(y / m))) / F.sum("weight")
    seen = each.groupBy("n_splines", "lam").agg(F.count(F.lit(1)).alias("judged"), deviance.alias("own"))
    gap = F.abs(F.round((F.col("loss") - F.col("own")) / (F.abs("own") + 1), 6)).alias("gap")
    return rounded(told.join(seen, ["n_splines", "lam"]).select("n_splines", "lam_prime", "lam", "judged", gap), lam_prime=9, lam=9)


@lru_cache
def coarse_scores(spark, folder):
    bins, sums = tun.training_and_validation(all_rows(spark, folder))
    return materialise(tun.score_candidates(tun.coarse_grid(spark), bins, sums), "coarse")


@check("m03_m05_coarse_search", GRID.format(rows="thick"))
def coarse_search(spark, folder):
    rows = all_rows(spark, folder)
    return loss_gaps(rows, *tun.training_and_validation(rows))


cte(
    "split_rows",
    """SELECT *, CASE WHEN CASE WHEN late >= 5 THEN day > cut ELSE draw >= 0.8 END THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, sum((day > cut)::INT) OVER (PARTITION BY product) AS late
      FROM (SELECT *, quantile_cont(day, 0.8) OVER (PARTITION BY product) AS cut
            FROM (SELECT *, (period_start - DATE '1970-01-01')::DOUBLE AS day,
                  ('0x' || substr(md5(item_id || '|' || event_name || '|' || period_start || '|' || month), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
                  FROM thick)))""",
)


@check("m05_held_out_objective", GRID.format(rows="split_rows WHERE split = 'test'"))
def held_out_objective(spark, folder):
    """Candidates fitted on bins of the training rows and judged by the held-out rows."""
    rows = materialise(wt.split_by_time(all_rows(spark, folder)), "split")
    bins, sums = tun.training_and_validation(rows, split="split")
    return loss_gaps(rows.where("split = 'test'"), bins, sums)


@check("t06_search_seeds", "SELECT 72::BIGINT AS candidates, 0::BIGINT AS strays")
def seeds(spark, folder):
    """The seeds against a ranking of all scored candidates."""
    scores = coarse_scores(spark, folder)
    order = Window.orderBy("loss", "n_splines", "lam_prime")  # over the grid only
    ranked = scores.withColumns({"place": F.row_number().over(order), "best": F.min("loss").over(Window.partitionBy())})
    wanted = ranked.where("place <= 3 and loss <= 1.25 * best").select("n_splines", "lam_prime")
    found = tun.pick_seeds(scores).select("n_splines", "lam_prime")
    strays = wanted.exceptAll(found).unionByName(found.exceptAll(wanted)).agg(F.count(F.lit(1)).alias("strays"))
    return scores.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(strays)  # one row each


@check(
    "t06_seeds_of_price_scores",
    """SELECT n_splines, lam_prime, loss FROM (SELECT CAST(count(DISTINCT cents) AS INTEGER) AS n_splines, min(cents)::DOUBLE AS lam_prime,
  max(cents)::DOUBLE / min(cents) AS loss FROM thick GROUP BY product)
QUALIFY loss <= 1.25 * min(loss) OVER () AND row_number() OVER (ORDER BY loss, n_splines, lam_prime) <= 3""",
)
def price_score_seeds(spark, folder):
    """Seeds from scores that follow from each product's prices."""
    cents = to_cents(F.col("price"))
    scores = thick_rows(spark, folder).groupBy("product").agg(
        F.countDistinct(cents).cast("int").alias("n_splines"),
        F.min(cents).cast("double").alias("lam_prime"),
        (F.max(cents).cast("double") / F.min(cents)).alias("loss"),
    )
    return tun.pick_seeds(scores.drop("product"))


@check(
    "c10_zoom_grid_of_prices",
    """SELECT product, CAST(i AS INTEGER) AS place, round(log10(lo) + (log10(hi) - log10(lo)) * i / 8.0::DOUBLE, 8) AS log_value
FROM (SELECT product, greatest(c / 5.0::DOUBLE, {floor}) AS lo, least(c * 5.0::DOUBLE, {ceiling}) AS hi
  FROM (SELECT product, greatest(pow(10.0::DOUBLE, min(cents) / 100000.0::DOUBLE - 3), {floor}) AS c FROM thick GROUP BY product)), range(9) r(i)""".format(
        floor=f"{tun.LAMBDA_FLOOR!r}::DOUBLE", ceiling=f"{tun.LAMBDA_CEILING!r}::DOUBLE"
    ),
)
def zoom_grid(spark, folder):
    """Zoom bounds and grid around a smoothing that follows from each product's lowest price."""
    low = thick_rows(spark, folder).groupBy("product").agg(F.min(to_cents(F.col("price"))).alias("cents"))
    grid = tun.log_grid(*tun.zoom_bounds(F.pow(F.lit(10.0), F.col("cents") / 100000.0 - 3)), tun.ZOOM_POINTS)
    each = low.select("product", F.posexplode(grid).alias("place", "value"))
    return each.select("product", "place", F.round(F.log10("value"), 8).alias("log_value"))


@check("m04_zoom_search", "SELECT true AS no_worse_than_the_grid, true AS inside_the_bounds, 0.0::DOUBLE AS gap")
def zoom_search(spark, folder):
    """The winner of the whole search: its loss computed anew, and against the coarse grid."""
    rows = all_rows(spark, folder)
    bins, sums = tun.training_and_validation(rows)
    found = materialise(tun.search(spark, lambda c: tun.score_candidates(c, bins, sums)), "winner")
    again = tun.score_candidates(found.select(F.lit(0).alias("seed"), "n_splines", "lam_prime", "lam"), bins, sums)
    best = coarse_scores(spark, folder).agg(F.min("loss")).scalar()
    met = found.join(again.select("n_splines", F.col("loss").alias("own")), "n_splines")
    inside = F.col("lam_prime").between(1e-3 / 125 * 0.999, 1e3 * 125 * 1.001)
    gap = F.abs(F.round(F.col("loss") - F.col("own"), 6)).alias("gap")
    return met.select((F.col("loss") <= best + 1e-9).alias("no_worse_than_the_grid"), inside.alias("inside_the_bounds"), gap)


# ---- curves -------------------------------------------------------------------------------

cte("priced_products", "SELECT product, count(DISTINCT cents) AS prices, count(*) AS n FROM thick GROUP BY product")
_BANDS = f"(SELECT unnest({[float(q) for q in crv.EXPECTILES]}::DOUBLE[]) AS q)"


@check(
    "m01_demand_curves",
    f"""SELECT product, q, CAST(unnest(range(greatest(least(prices // 2, 6), {crv.MIN_SPLINES}))) AS INTEGER) AS term, 0.0::DOUBLE AS gap
FROM priced_products, {_BANDS} WHERE prices >= {crv.MIN_PRICES}""",
)
def demand_curves(spark, folder):
    """What the fitted curves leave over in their own equations: nothing."""
    gaps = crv.normal_equations(all_rows(spark, folder), models(spark, folder))
    return gaps.select("product", "q", "term", F.abs(F.round("gap", 4)).alias("gap"))


@check(
    "m02_scored_curve",
    f"""SELECT product, n, CASE WHEN prices >= {crv.MIN_PRICES} THEN n ELSE 0 END AS predicted,
CASE WHEN prices >= {crv.MIN_PRICES} THEN 0.0::DOUBLE END AS revenue_gap FROM priced_products""",
)
def scored_curve(spark, folder):
    scored = crv.score_curves(all_rows(spark, folder), models(spark, folder))
    parts = [F.abs(F.col(f"revenue_{b}") - F.col("price").cast("double") * F.col(f"units_{b}")) / (F.col(f"revenue_{b}") + 1) for b in crv.BAND.values()]
    return scored.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.count("units_p50").alias("predicted"), F.abs(F.round(F.max(F.greatest(*parts)), 6)).alias("revenue_gap")
    )


# Units that follow expm1(2 + log1p(price) / 2) exactly: a line that the penalty leaves alone, so that
# every expectile of every product is the law itself.
cte(
    "law",
    f"""SELECT t.*, CASE WHEN p.n >= {crv.MIN_PRICES} THEN exp(2.0::DOUBLE + 0.5::DOUBLE * ln(1 + cents / 100.0::DOUBLE)) - 1 END AS law_units
FROM thick t JOIN (SELECT product, count(DISTINCT cents) AS n FROM thick GROUP BY product) p USING (product)""",
)


@lru_cache
def law_rows(spark, folder):
    law = F.expm1(F.lit(2.0) + F.lit(0.5) * F.log1p(F.col("price").cast("double")))
    return all_rows(spark, folder).withColumn("shipped_units", law)


@lru_cache
def law_models(spark, folder):
    return materialise(crv.fit_curves(law_rows(spark, folder)), "law_models")


@check(
    "m01_curves_of_exact_law",
    f"""SELECT {', '.join(KEY)}, round(exp(ln(1 + cents / 100.0::DOUBLE) / 2), 6) AS root, {', '.join(
        f'CASE WHEN law_units IS NOT NULL THEN 0.0::DOUBLE END AS {c}' for c in LAW_COLUMNS)} FROM law""",
)
def curves_of_law(spark, folder):
    """How far each prediction is from the law, relative to it; rounds stop at steps of 1e-6, so 4 decimals are told."""
    out = crv.score_curves(law_rows(spark, folder), law_models(spark, folder))
    law = F.expm1(F.lit(2.0) + F.lit(0.5) * F.log1p(F.col("price").cast("double")))
    root = F.round(F.sqrt(F.lit(1.0) + F.col("price").cast("double")), 6).alias("root")
    return out.select(*KEY, root, *[F.round(F.col(c) / law - 1, 4).alias(c) for c in LAW_COLUMNS])


@check(
    "m10_states_of_exact_law",
    f"""SELECT CASE WHEN n >= {crv.MIN_PRICES} THEN 'fitted' ELSE 'too_few_prices' END AS status, q, count(*) AS n
FROM (SELECT product, count(DISTINCT cents) AS n FROM thick GROUP BY product), (SELECT unnest({[float(q) for q in crv.EXPECTILES]}::DOUBLE[]) AS q)
GROUP BY 1, 2""",
)
def states_of_law(spark, folder):
    return law_models(spark, folder).groupBy("status", "q").agg(F.count(F.lit(1)).alias("n"))


@check("j23_rows_with_law_models", "SELECT product, count(*) AS n, count(law_units) AS predicted FROM law GROUP BY product")
def rows_with_law_models(spark, folder):
    scored = crv.score_curves(law_rows(spark, folder), law_models(spark, folder))
    return scored.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count("units_p50").alias("predicted"))


cte(
    "literal_models",
    """SELECT product, ln(1 + min(cents) / 100.0::DOUBLE) AS lo, ln(1 + max(cents) / 100.0::DOUBLE) AS hi, 7 AS ns FROM thick GROUP BY product HAVING min(cents) < max(cents)""",
)


@check(
    "m02_scored_known_model",
    """SELECT product, item_id, period_start, event_name, round(greatest(exp(base + code * 0.1) - 1, 0), 4) AS units_p50,
round(greatest(exp(base) - 1, 0), 4) AS units_bau_p50, round(cents / 100.0::DOUBLE * greatest(exp(base + code * 0.1) - 1, 0), 2) AS revenue_p50
FROM (SELECT t.*, 3.0 + 0.5 * ((ln(1 + cents / 100.0::DOUBLE) - lo) / ((hi - lo) / 4)) AS base,
             CASE WHEN event_name = 'BAU' THEN 0 ELSE 1 END AS code
      FROM thick t JOIN literal_models USING (product))""",
)
def scored_known_model(spark, folder):
    """A model with evenly spaced coefficients is a straight line in ln(1+price)."""
    rows = thick_rows(spark, folder).withColumn("event_code", F.when(F.col("event_name") == "BAU", 0).otherwise(1))
    x = F.ln(F.lit(1.0) + F.col("price").cast("double"))
    lines = rows.groupBy("product").agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo < hi")
    # coefficient i sits at place i - 1, so 2.5 + 0.5 i is the line 3 + 0.5 place
    beta = F.array(*[F.lit(2.5 + 0.5 * i) for i in range(7)])
    known = lines.select(
        "product",
        F.explode(F.array(*[F.lit(q) for q in crv.EXPECTILES])).alias("q"),
        "lo",
        "hi",
        F.lit(7).alias("n_splines"),
        beta.alias("beta"),
        F.lit(0.1).alias("event_coef"),
        F.lit("fitted").alias("status"),
    )
    out = crv.score_curves(rows, known).where(F.col("units_p50").isNotNull())
    return rounded(out.select(*KEY, "units_p50", "units_bau_p50", "revenue_p50"), units_p50=4, units_bau_p50=4, revenue_p50=2)


@check("j22_candidates_on_training_bins", GRID.format(rows="thick"))
def candidates_on_bins(spark, folder):
    """Every candidate meets every bin: rows with equal weights, bins and sums each from their own scan."""
    rows = thick_rows(spark, folder).withColumn("weight", F.lit(1.0))
    return loss_gaps(rows, tun.price_bins(rows), tun.price_sums(rows))


@check(
    "j23_rows_with_models",
    f"SELECT product, n, CASE WHEN prices >= {crv.MIN_PRICES} THEN n ELSE 0 END AS predicted FROM priced_products",
)
def rows_with_models(spark, folder):
    scored = crv.score_curves(all_rows(spark, folder), models(spark, folder))
    return scored.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.count("revenue_p975").alias("predicted"))


cte(
    "law_points",
    f"""SELECT product, cents, count(*) AS n FROM law WHERE law_units IS NOT NULL GROUP BY product, cents""",
)


@check(
    "m09_bootstrap_bands",
    """SELECT product, cents / 100.0::DOUBLE AS price, 0.0::DOUBLE AS low_gap, 0.0::DOUBLE AS middle_gap, 0.0::DOUBLE AS high_gap, true AS target_met
FROM law_points""",
)
def bootstrap(spark, folder):
    """Bands of replicates of rows that follow the law: every replicate of every product finds it."""
    bands = rsm.bootstrap_until(law_rows(spark, folder), KEY)
    law = F.expm1(F.lit(2.0) + F.lit(0.5) * F.log1p("price"))
    gaps = [F.abs(F.round(F.col(f"units_{b}") / law - 1, 4)).alias(f"{n}_gap") for b, n in zip(crv.BAND.values(), ("low", "middle", "high"))]
    return bands.select("product", "price", *gaps, "target_met")


@check(
    "c18_out_of_fold_residuals",
    f"SELECT {', '.join(KEY)}, CASE WHEN law_units IS NOT NULL THEN 0.0::DOUBLE END AS residual FROM law",
)
def out_of_fold(spark, folder):
    """Residuals of rows that follow the law, from curves that have not seen the row's fold."""
    found = rsm.cross_fit_residuals(law_rows(spark, folder), KEY)
    return found.select(*KEY, F.abs(F.round("residual", 4)).alias("residual"))


@check(
    "m02_price_grid_of_law",
    f"""SELECT product, cents / 100.0::DOUBLE AS price, 0.0::DOUBLE AS gap FROM (
SELECT DISTINCT product, low + (high - low) * i // {crv.GRID_POINTS - 1} AS cents
FROM (SELECT product, min(cents) AS low, max(cents) AS high FROM law_points GROUP BY product), range({crv.GRID_POINTS}) r(i))""",
)
def price_grid(spark, folder):
    """Curves on an even grid between the outer prices, where few rows were observed."""
    grid = crv.score_grid(law_models(spark, folder))
    law = F.expm1(F.lit(2.0) + F.lit(0.5) * F.log1p("price"))
    return grid.select("product", "price", F.abs(F.round(F.col("units_p975") / law - 1, 4)).alias("gap"))


@check(
    "m10_model_status",
    f"""SELECT CASE WHEN prices >= {crv.MIN_PRICES} THEN 'fitted' ELSE 'too_few_prices' END AS status, q, count(*) AS n
FROM priced_products, {_BANDS} GROUP BY 1, 2""",
)
def model_status(spark, folder):
    return models(spark, folder).groupBy("status", "q").agg(F.count(F.lit(1)).alias("n"))


@check("u03_all_groups_kept", "SELECT product, count(*) AS n FROM thick GROUP BY product")
def all_groups_kept(spark, folder):
    scored = crv.score_curves(all_rows(spark, folder), models(spark, folder))
    return scored.groupBy("product").agg(F.count(F.lit(1)).alias("n"))


# ---- whole review and sinks ---------------------------------------------------------------


@check(
    "s08_review_frame_sizes",
    """SELECT 'price_quantity' AS frame, (SELECT count(*) FROM (SELECT DISTINCT cents, product FROM prepared)) AS n
UNION ALL SELECT 'curve', (SELECT count(*) FROM prepared)
UNION ALL SELECT 'best_expected', (SELECT count(DISTINCT product) FROM prepared)
UNION ALL SELECT 'opportunities', (SELECT count(DISTINCT product) FROM prepared)
UNION ALL SELECT 'elasticity', (SELECT count(DISTINCT product) FROM prepared)
UNION ALL SELECT 'current_prices', (SELECT count(*) FROM products)
UNION ALL SELECT 'overview', (SELECT count(DISTINCT item_id) FROM prepared)""",
)
def review_sizes(spark, folder):
    names = ["price_quantity", "curve", "best_expected", "opportunities", "elasticity", "current_prices", "overview"]
    parts = [
        frames(spark, folder)[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("frame"), "n") for n in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


cte("reviewed", "SELECT item_id, product, min(cents) AS low, max(cents) AS high FROM prepared GROUP BY item_id, product")


@check(
    "s08_review_opportunities",
    """SELECT product, true AS at_a_sold_price, true AS own_item, 0.0::DOUBLE AS gain_gap, 0.0::DOUBLE AS year_gap FROM prepared GROUP BY product""",
)
def review_opportunities(spark, folder):
    """One row for each product: its best price is one that its item sold at, its gains are differences."""
    rows = frames(spark, folder)["opportunities"]
    sold = prepared_rows(spark, folder).select("product", "item_id", F.col("price").cast("double").alias("best_price")).distinct()
    met = rows.join(sold.withColumn("hit", F.lit(True)), ["product", "item_id", "best_price"], "left")
    items = sold.select("product", "item_id").distinct().withColumn("own", F.lit(True))
    size = F.abs("revenue_best") + 1
    return met.join(items, ["product", "item_id"], "left").select(
        "product",
        F.coalesce("hit", F.lit(False)).alias("at_a_sold_price"),
        F.coalesce("own", F.lit(False)).alias("own_item"),
        F.abs(F.round((F.col("revenue_best") - F.col("revenue_curr") - F.col("delta_revenue")) / size, 6)).alias("gain_gap"),
        F.abs(F.round((F.col("delta_revenue_annual") - 365 * F.col("delta_revenue")) / size, 6)).alias("year_gap"),
    )


@check(
    "s08_review_chosen_prices",
    "SELECT product, count(DISTINCT cents) AS prices, true AS sold_at, true AS in_range, 0.0::DOUBLE AS score_gap FROM prepared GROUP BY product",
)
def review_chosen(spark, folder):
    """The chosen row of each product: a sold price, with the score that its predictions make."""
    rows = frames(spark, folder)["best_frontier"]
    cents = to_cents(F.col("price")).alias("cents")
    ends = prepared_rows(spark, folder).groupBy("product").agg(F.countDistinct(cents).alias("prices"), F.collect_set(cents).alias("all"))
    mine = F.round(F.col("price") * 100).cast("bigint")
    score = 0.7 * F.col("revenue_p50") + 0.3 * F.col("revenue_p025")
    return rows.join(ends, "product").select(
        "product",
        "prices",
        F.array_contains("all", mine).alias("sold_at"),
        mine.between(F.array_min("all"), F.array_max("all")).alias("in_range"),
        F.abs(F.round((F.col("score") - score) / (F.abs(score) + 1), 6)).alias("score_gap"),
    )


@check(
    "s08_review_overview",
    """SELECT r.item_id, min(r.product) AS product, format('{:,}', (SELECT max(order_date) - min(order_date) + 1 FROM sales)::BIGINT) AS days,
'$' || format('{:,.2f}', min(current_cents) / 100.0::DOUBLE) AS current_price
FROM reviewed r JOIN products USING (item_id) GROUP BY r.item_id""",
)
def review_overview(spark, folder):
    return frames(spark, folder)["overview"].select("item_id", "product", "days", "current_price")


def _out(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@check(
    "s06_sales_sink",
    "SELECT event_name, count(*) AS n, sum(shipped_units)::BIGINT AS units, sum(cents)::BIGINT / 100.0::DOUBLE AS price_total FROM sales GROUP BY event_name",
)
def sales_sink(spark, folder):
    """Sales written in folders by month and read back."""
    path = _out(spark, "sales-sink")
    write_sales(sales(spark, folder), path)
    back = spark.read.parquet(path)
    return back.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("shipped_units").alias("units"),
        F.sum("price").cast("double").alias("price_total"),
    )


@check(
    "s06_two_runs_one_sink",
    """SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS n, sum(units)::BIGINT AS units FROM (
SELECT order_date, shipped_units * 2 AS units FROM sales WHERE order_date BETWEEN DATE '1997-03-10' AND DATE '1998-06-20'
UNION ALL SELECT order_date, shipped_units FROM sales
WHERE order_date < DATE '1997-03-10' OR order_date BETWEEN DATE '1998-06-21' AND DATE '1998-12-31') GROUP BY 1""",
)
def two_runs(spark, folder):
    """A first run to the end of 1998 and a later one over a window in it, which replaces that window only."""
    path = _out(spark, "two-runs")
    rows = sales(spark, folder)
    write_sales(rows.where("order_date <= '1998-12-31'"), path)
    window = ("1997-03-10", "1998-06-20")
    later = rows.where(F.col("order_date").between(*window)).withColumn("shipped_units", F.col("shipped_units") * 2)
    write_sales(later, path, window=window)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units")
    )


_COLUMN_ORDERS = [
    ["item_id", "order_date", "price", "shipped_units", "event_name", "deal_discount_percent"],
    ["price", "event_name", "item_id", "deal_discount_percent", "order_date", "shipped_units", "note"],
    ["order_date", "item_id", "shipped_units", "price", "deal_discount_percent", "event_name"],
]


@check(
    "s01_sales_files_with_different_headers",
    """SELECT event_name, bad, count(*) AS n, CASE WHEN bad = 'no' THEN sum(shipped_units)::BIGINT END AS units,
CASE WHEN bad = 'no' THEN sum(cents)::BIGINT / 100.0::DOUBLE END AS price_total
FROM (SELECT *, CASE WHEN shipped_units % 11 = 3 THEN 'price' WHEN shipped_units % 13 = 5 THEN 'order_date' ELSE 'no' END AS bad FROM sales)
GROUP BY event_name, bad""",
)
def sales_files(spark, folder):
    """Sales in three sets of CSV files whose columns differ in order, case and number, some values unreadable."""
    path = _out(spark, "sales-files")
    bad_price, bad_date = F.col("shipped_units") % 11 == 3, F.col("shipped_units") % 13 == 5
    rows = sales(spark, folder).withColumn("note", F.lit("x, y")).withColumn("set", F.col("shipped_units") % 3)
    rows = rows.select(
        *[F.col(c).cast("string").alias(c) for c in rows.columns if c not in ("price", "order_date", "set")],
        F.when(bad_price, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(bad_date & ~bad_price, "31.31.1999").otherwise(F.col("order_date").cast("string")).alias("order_date"),
        "set",
    )
    for k, columns in enumerate(_COLUMN_ORDERS):
        named = rows.where(F.col("set") == k).select(*[F.col(c).alias(f" {c.upper()}" if k == 1 else c) for c in columns])
        named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/part{k}")
    good, bad = read_sales_files(spark, f"{path}/*", "*.csv")
    kept = good.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shipped_units").alias("units"), F.sum("price").cast("double").alias("price_total")
    )
    event = F.from_csv("line", ", ".join(f"{c} string" for c in SALES_COLUMNS))["event_name"]
    aside = bad.groupBy(event.alias("event_name"), F.col("reason").alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    return kept.withColumn("bad", F.lit("no")).unionByName(aside, allowMissingColumns=True).select("event_name", "bad", "n", "units", "price_total")


@check(
    "s02_product_files",
    "SELECT tag, count(*) AS n, sum(current_cents)::BIGINT / 100.0::DOUBLE AS total FROM products GROUP BY tag",
)
def product_files(spark, folder):
    """Products in two sets of files with different headers."""
    path = _out(spark, "product-files")
    rows = retail.products(spark, folder).withColumn("set", F.pmod(F.xxhash64("item_id"), F.lit(2)))
    first = rows.where("set = 0").select("item_id", "tag", "variation", F.col("current_price").alias("Current_Price "))
    second = rows.where("set = 1").select("current_price", "variation", F.col("tag").alias("TAG"), "item_id")
    for k, part in enumerate((first, second)):
        part.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/product{k}")
    good, _ = read_product_files(spark, f"{path}/*", "*.csv")
    return good.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("current_price").cast("double").alias("total"))


@check(
    "s07_record_sink",
    """SELECT product, item_id, revenue_p50, '$' || format('{:,.2f}', asp) AS price FROM best50""",
)
def record_sink(spark, folder):
    """Best rows written as JSON records and read back."""
    path = _out(spark, "records")
    rows = best(spark, folder).select("product", "item_id", "revenue_p50", money_text(F.col("asp"), 2).alias("price"))
    write_records(rows, path)
    return spark.read.schema(rows.schema).json(path)

