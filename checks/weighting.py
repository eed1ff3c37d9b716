"""Checks of the weight operators."""

from pyspark.sql import functions as F

from quotecurve.functions.money import to_cents
from quotecurve.operators import weights as wt

from .base import compose, cte
from .sold import prepared_rows, thick_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["item_id", "period_start", "month", "event_name"]
KEYS = "item_id, period_start, month, event_name"


def check(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return add


cte(
    "aged",
    """
SELECT *, pow(0.5::DOUBLE, (max(period_start) OVER () - period_start) / 90.0::DOUBLE) AS tw FROM thick
""",
)
cte(
    "knn",
    """
SELECT product, cents, radius, CASE WHEN size < 16 THEN 1.0::DOUBLE WHEN max(d) OVER w - min(d) OVER w < 1e-12 THEN 1.0::DOUBLE
  ELSE 0.25::DOUBLE + 0.75::DOUBLE * (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) END AS support
FROM (SELECT product, cents, size, dist / 100.0::DOUBLE AS radius, 1 / greatest(dist / 100.0::DOUBLE, 2.220446049250313e-16::DOUBLE) AS d
      FROM (SELECT q.product, q.cents, s.size, abs(q.cents - r.cents) AS dist,
                   row_number() OVER (PARTITION BY q.product, q.cents ORDER BY abs(q.cents - r.cents)) AS k
            FROM (SELECT DISTINCT product, cents FROM thick) q JOIN thick r USING (product)
            JOIN (SELECT product, count(*) AS size FROM thick GROUP BY product) s USING (product))
      WHERE k = least(15, size - 1))
WINDOW w AS (PARTITION BY product)
""",
)
cte(
    "spread",
    "SELECT product, count(*) AS size, stddev_pop(cents) AS sd FROM thick GROUP BY product",
)
cte("spots", "SELECT product, cents, count(*) AS n FROM thick GROUP BY ALL")
cte(
    "kde_one",
    """
SELECT q.product, q.cents, sum(r.n * exp(-0.5 * pow((q.cents - r.cents) / 100.0::DOUBLE, 2))) / any_value(s.size) / sqrt(2 * pi()) AS d,
       any_value(s.size) AS size
FROM spots q JOIN spots r USING (product) JOIN spread s USING (product) GROUP BY ALL
""",
)
cte(
    "kde_support",
    """
SELECT product, cents, CASE WHEN size < 2 OR max(d) OVER w - min(d) OVER w < 1e-12 THEN 1.0::DOUBLE
   ELSE 0.25::DOUBLE + 0.75::DOUBLE * (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) END AS support
FROM kde_one WINDOW w AS (PARTITION BY product)
""",
)


def _norm(table: str, w: str) -> str:
    """Weight divided by its median and clipped, as a DuckDB select."""
    return f"""SELECT {KEYS}, round(CASE WHEN hi > lo THEN least(greatest({w} / med, lo / med), hi / med) ELSE {w} / med END, 6) AS weight
FROM {table}, (SELECT quantile_cont({w}, 0.5) AS med, quantile_cont({w}, 0.05) AS lo, quantile_cont({w}, 0.95) AS hi FROM {table})"""


@check("c08_time_weight", f"SELECT {KEYS}, round(tw, 8) AS time_weight FROM aged")
def time_weight(spark, folder):
    return wt.time_weight(thick_rows(spark, folder)).select(*KEY, F.round("time_weight", 8).alias("time_weight"))


@check("w11_normalised_weight", _norm("aged", "tw"))
def normalised(spark, folder):
    rows = wt.time_weight(thick_rows(spark, folder))
    return wt.normalise_weight(rows, "time_weight").select(*KEY, F.round("time_weight", 6).alias("weight"))


@check("j19_neighbour_radius", "SELECT product, cents, radius, round(support, 8) AS support FROM knn")
def neighbours(spark, folder):
    rows = wt.neighbour_support(thick_rows(spark, folder))
    return rows.select("product", "cents", "radius", F.round("support", 8).alias("support"))


@check(
    "m07_time_and_neighbour_weight",
    _norm("(SELECT a.*, a.tw * k.support AS cw FROM aged a JOIN knn k USING (product, cents))", "cw"),
)
def combined_weight(spark, folder):
    rows = thick_rows(spark, folder)
    return wt.with_weights(rows, support=wt.neighbour_support(rows)).select(*KEY, F.round("weight", 6).alias("weight"))


@check(
    "m07_time_and_density_weight",
    _norm("(SELECT a.*, a.tw * k.support AS cw FROM aged a JOIN kde_support k USING (product, cents))", "cw"),
)
def density_weight(spark, folder):
    rows = thick_rows(spark, folder)
    return wt.with_weights(rows, support=wt.density_support(rows)).select(*KEY, F.round("weight", 6).alias("weight"))


@check("m06_density_support", "SELECT product, cents, round(support, 7) AS support FROM kde_support")
def density_support(spark, folder):
    rows = wt.density_support(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round("support", 7).alias("support"))


cte(
    "prior_raw",
    """
SELECT q.product, q.cents, any_value(s.size) AS size,
       sum(r.n * exp(-0.5 * pow((q.cents - r.cents) / (1.06::DOUBLE * s.sd * pow(s.size, -0.2)), 2))) / any_value(s.size) / sqrt(2 * pi()) AS d
FROM spots q JOIN spots r USING (product)
JOIN (SELECT product, size, CASE WHEN sd > 0 THEN sd ELSE 100.0 END AS sd FROM spread) s USING (product) GROUP BY q.product, q.cents
""",
)


@check(
    "j18_support_prior",
    """SELECT product, cents, round(CASE WHEN size < 5 OR max(d) OVER w - min(d) OVER w < 1e-12 THEN 1.0::DOUBLE
ELSE 0.2::DOUBLE + 0.8::DOUBLE * (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) END, 7) AS prior
FROM prior_raw WINDOW w AS (PARTITION BY product)""",
)
def support_prior(spark, folder):
    rows = wt.support_prior(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round("prior", 7).alias("prior"))


@check(
    "w05_rescaled_prices",
    """SELECT product, cents, round(CASE WHEN max(cents) OVER w = min(cents) OVER w THEN 1.0::DOUBLE
ELSE 0.25::DOUBLE + 0.75::DOUBLE * ((cents - min(cents) OVER w) / (max(cents) OVER w - min(cents) OVER w)) END, 8) AS position
FROM spots WINDOW w AS (PARTITION BY product)""",
)
def rescaled(spark, folder):
    rows = wt.price_counts(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round(wt.rescale(rows, "cents", "product", 0.25), 8).alias("position"))


cte(
    "fold_spots",
    """
SELECT product, cents, ('0x' || substr(md5(item_id || '|' || period_start || '|' || month || '|' || event_name), 1, 8))::BIGINT % 5 AS fold,
       count(*) AS n FROM thick GROUP BY ALL
""",
)
cte(
    "fold_grid",
    """
SELECT product, i, exp(ln(lo) + (ln(hi) - ln(lo)) * (i / 14.0::DOUBLE)) AS h
FROM (SELECT product, lo, greatest(lo * 1.01, 2 * sd) AS hi
      FROM (SELECT product, stddev_pop(cents) AS sd, greatest(0.1, 0.05 * stddev_pop(cents)) AS lo FROM thick GROUP BY product)),
     range(15) g(i)
""",
)


@check(
    "m06_bandwidth_scores",
    """SELECT product, CAST(i AS INTEGER) AS i, round(h, 6) AS h, round(sum(n * (ln(total) - nearest - ln(train_size * h * sqrt(2 * pi())))), 4) AS score
FROM (SELECT product, i, h, cents, fold, n, sum(m) AS train_size, min(gap) AS nearest,
             sum(m * exp(least - gap)) AS total
      FROM (SELECT q.product, g.i, g.h, q.cents, q.fold, q.n, r.n AS m, pow((q.cents - r.cents) / g.h, 2) / 2 AS gap,
                   min(pow((q.cents - r.cents) / g.h, 2) / 2) OVER (PARTITION BY q.product, g.i, q.cents, q.fold) AS least
            FROM fold_spots q JOIN fold_spots r ON r.product = q.product AND r.fold <> q.fold
            JOIN fold_grid g ON g.product = q.product)
      GROUP BY product, i, h, cents, fold, n)
GROUP BY product, i, h""",
)
def bandwidth_scores(spark, folder):
    rows = wt.bandwidth_scores(thick_rows(spark, folder), KEY)
    return rows.select("product", "i", F.round("h", 6).alias("h"), F.round("score", 4).alias("score"))


@check(
    "a24_price_share",
    "SELECT product, cents, round(n / sum(n) OVER (PARTITION BY product), 9) AS share FROM spots",
)
def price_share(spark, folder):
    rows = wt.price_share(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round("share", 9).alias("share"))


@check(
    "c17_rarity_factor",
    """SELECT product, cents, round(CASE WHEN cents < q[1] OR cents > q[2]
THEN least(greatest(pow(mean_n / n, 0.5), 1.0), 1.25) ELSE 1.0 END, 8) AS rarity
FROM spots JOIN (SELECT product, quantile_cont(cents::DOUBLE, [0.1, 0.9]) AS q, count(*) / count(DISTINCT cents) AS mean_n
                 FROM thick GROUP BY product) USING (product)""",
)
def rarity(spark, folder):
    rows = wt.rarity_factor(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round("rarity", 8).alias("rarity"))


cte(
    "price_ends",
    "SELECT product, min(cents) AS low, max(cents) AS high, count(*) AS size, quantile_cont(cents::DOUBLE, [0.1, 0.5, 0.9]) AS q FROM thick GROUP BY product",
)
_BIN = "CASE WHEN high > low THEN least(((cents - low) * 50) // (high - low), 49) ELSE 0 END"


@check(
    "c17_smoothed_rarity",
    f"""SELECT product, cents, round(CASE WHEN cents < q[1] OR cents > q[3] THEN
  1 + (least(greatest(pow(density, -0.5), 1.0), 1.25) - 1) * abs(cents - q[2]) / greatest(q[2] - low, high - q[2]) ELSE 1.0 END, 8) AS rarity
FROM (SELECT product, cents, low, high, q, {_BIN} AS bin FROM spots JOIN price_ends USING (product))
JOIN (SELECT product, bin, sum(n) OVER w / (least(bin + 2, 49) - greatest(bin - 2, 0) + 1) / (size / 50.0::DOUBLE) AS density
      FROM (SELECT product, size, {_BIN} AS bin, sum(n) AS n FROM spots JOIN price_ends USING (product) GROUP BY ALL)
      WINDOW w AS (PARTITION BY product ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) USING (product, bin)""",
)
def smoothed(spark, folder):
    rows = wt.smoothed_rarity(thick_rows(spark, folder))
    return rows.select("product", "cents", F.round("rarity", 8).alias("rarity"))


cte("spot_weights", "SELECT product, cents, count(*) AS n, avg(tw) AS weight FROM aged GROUP BY product, cents")


@check(
    "w15_leverage_cap",
    """SELECT product, cents, round(least(weight, 2.0 * sum(weight * n) OVER w / sum(n) OVER w), 7) AS weight FROM spot_weights
WINDOW w AS (PARTITION BY product ORDER BY cents ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""",
)
def leverage(spark, folder):
    rows = wt.time_weight(thick_rows(spark, folder))
    spots = rows.groupBy("product", to_cents(F.col("price")).alias("cents")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("time_weight").alias("weight")
    )
    return wt.leverage_cap(spots).select("product", "cents", F.round("weight", 7).alias("weight"))


cte(
    "residuals",
    """
SELECT t.*, ln(shipped_units::DOUBLE + 1) - m.mean AS residual FROM thick t
JOIN (SELECT product, avg(ln(shipped_units::DOUBLE + 1)) AS mean FROM thick GROUP BY product) m USING (product)
""",
)


@check(
    "c18_huber_factor",
    f"""SELECT {KEYS}, round(CASE WHEN abs(residual) / s > 1.345 THEN 1.345 / (abs(residual) / s) ELSE 1.0 END, 6) AS huber
FROM residuals JOIN (SELECT product, quantile_cont(abs(residual), 0.5) * 1.4826 AS s FROM residuals GROUP BY product) USING (product)""",
)
def huber(spark, folder):
    rows = thick_rows(spark, folder).withColumn("y", F.ln(F.col("shipped_units").cast("double") + 1))
    means = rows.groupBy("product").agg(F.avg("y").alias("mean"))
    residuals = rows.join(means, "product").withColumn("residual", F.col("y") - F.col("mean"))
    return wt.huber_factor(residuals).select(*KEY, F.round("huber", 6).alias("huber"))


@check(
    "w16_time_split",
    f"""SELECT {KEYS}, CASE WHEN CASE WHEN late >= 5 THEN day > cut ELSE draw >= 0.8 END THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, sum((day > cut)::INT) OVER (PARTITION BY product) AS late
      FROM (SELECT *, quantile_cont(day, 0.8) OVER (PARTITION BY product) AS cut
            FROM (SELECT *, (period_start - DATE '1970-01-01')::DOUBLE AS day,
                  ('0x' || substr(md5(item_id || '|' || event_name || '|' || period_start || '|' || month), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
                  FROM thick)))""",
)
def time_split(spark, folder):
    return wt.split_by_time(thick_rows(spark, folder)).select(*KEY, "split")


@check(
    "c06_log_transforms",
    f"""SELECT {KEYS}, round(ln(1 + greatest(cents / 100.0::DOUBLE, 0)), 9) AS log_price,
round(greatest(exp(ln(1 + greatest(shipped_units::DOUBLE, 0))) - 1, 0), 6) AS units, round(ln(cents / 100.0::DOUBLE + 0.01::DOUBLE), 9) AS log_shifted FROM thick""",
)
def log_transforms(spark, folder):
    from quotecurve.functions.numeric import expm1_floor, log1p_floor

    price = F.col("price").cast("double")
    return thick_rows(spark, folder).select(
        *KEY,
        F.round(log1p_floor(price), 9).alias("log_price"),
        F.round(expm1_floor(log1p_floor(F.col("shipped_units").cast("double"))), 6).alias("units"),
        F.round(F.ln(price + 0.01), 9).alias("log_shifted"),
    )


@check(
    "c07_softplus",
    f"SELECT {KEYS}, round(CASE WHEN x > 20 THEN x ELSE ln(1 + exp(x)) END, 9) AS y FROM (SELECT *, shipped_units - 30.0::DOUBLE AS x FROM thick)",
)
def softplus(spark, folder):
    from quotecurve.functions.numeric import softplus as soft

    rows = thick_rows(spark, folder)
    return rows.select(*KEY, F.round(soft(F.col("shipped_units") - F.lit(30.0)), 9).alias("y"))


@check(
    "f08_complete_model_rows",
    f"""SELECT {KEYS}, CASE WHEN raw IS NULL THEN 1.0 WHEN raw <= 0 THEN 1e-6 ELSE raw END AS weight
FROM (SELECT *, CASE WHEN month = 1 THEN NULL WHEN month = 2 THEN -1.0 ELSE month END::DOUBLE AS raw FROM thick)
WHERE deal_discount_percent IS NOT NULL AND shipped_units % 7 <> 0""",
)
def complete_rows(spark, folder):
    from quotecurve.operators.prepare import complete_model_rows

    weight = F.when(F.col("month") == 1, F.lit(None)).when(F.col("month") == 2, -1.0).otherwise(F.col("month"))
    rows = thick_rows(spark, folder).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("target", F.when(F.col("shipped_units") % 7 != 0, F.col("shipped_units").cast("double")))
    return complete_model_rows(rows, ["target", "deal_discount_percent"]).select(*KEY, "weight")


@check(
    "f17_finite_rows",
    f"SELECT {KEYS}, ln(greatest(shipped_units - 20, 0)::DOUBLE + (shipped_units <= 20)::INT * 0.0) AS x FROM thick WHERE shipped_units > 20".replace(
        "ln(greatest(shipped_units - 20, 0)::DOUBLE + (shipped_units <= 20)::INT * 0.0)", "round(ln(shipped_units::DOUBLE - 20), 9)"
    ),
)
def finite_rows(spark, folder):
    from quotecurve.functions.numeric import finite

    raw = F.when(F.col("shipped_units") > 20, F.ln(F.col("shipped_units").cast("double") - 20)).otherwise(
        F.when(F.col("shipped_units") == 20, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )
    rows = thick_rows(spark, folder).withColumn("x", finite(raw)).where(F.col("x").isNotNull())
    return rows.select(*KEY, F.round("x", 9).alias("x"))


@check(
    "c16_fill_dates",
    """SELECT DISTINCT item_id, DATE '2023-09-17' + (('0x' || substr(md5(item_id), 1, 8))::BIGINT % 731)::INT AS order_date FROM sales""",
)
def fill_dates(spark, folder):
    from quotecurve.functions.dates import fill_date

    from .sold import sales

    return sales(spark, folder).select("item_id", fill_date(F.col("item_id")).alias("order_date")).distinct()
