"""Registered queries of maps as landscapes, small delays, vessel thresholds and windows' variability; see catalog.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import delays, flow, lags, quantiles
from lagmill.plans.catalog import GRID, ORACLE_SQL, SAMPLES, TWO_MAPS, grid_map, query, r6, rounded, rounds, two_maps
from lagmill.plans.catalog_more import first_value
from lagmill.sources.tables import embedding_series, to_samples

TOUCH = "g p JOIN g q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 AND p.series_id <> q.series_id"


def map_cells(spark, sf_dir):
    return grid_map(spark, sf_dir).select(F.col("series_id").alias("id"), "x", "y", "z", first_value().alias("a"))


@query(f"""
WITH RECURSIVE {GRID}, e AS (SELECT p.series_id AS i, q.series_id AS j, q.a FROM {TOUCH}), o AS (SELECT series_id FROM g WHERE series_id NOT IN (SELECT i FROM e GROUP BY i HAVING count(*) = 26)),
r AS (SELECT series_id, a AS level FROM g JOIN o USING (series_id) UNION SELECT e.j, greatest(e.a, r.level) FROM r JOIN e ON e.i = r.series_id WHERE e.j NOT IN (SELECT series_id FROM o))
SELECT series_id, round(min(level), 6) + 0.0 AS filled FROM r GROUP BY series_id""")
def depressions_filled(spark, sf_dir):
    """A map's values raised to the level at which water would leave the map."""
    return rounded(flow.filled(map_cells(spark, sf_dir), "a").withColumnRenamed("id", "series_id"))


@query(f"""
WITH RECURSIVE {GRID}, e AS (SELECT p.series_id AS i, q.series_id AS j, ((q.a - p.a) / sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) ** 1.1::DOUBLE AS w FROM {TOUCH} WHERE q.a > p.a),
s AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS share FROM e),
r AS (SELECT series_id, 1 + abs(a) AS f, 0 AS step FROM g UNION ALL SELECT s.j, sum(r.f * s.share), r.step + 1 FROM r JOIN s ON s.i = r.series_id GROUP BY s.j, r.step)
SELECT series_id, round(sum(f), 6) + 0.0 AS load FROM r GROUP BY series_id""")
def flow_accumulation(spark, sf_dir):
    """Load that arrives in every cell when each passes its own on along rising values."""
    cells = map_cells(spark, sf_dir).withColumn("seed", 1 + F.abs("a"))
    return rounded(flow.accumulated(cells, "a", "seed").withColumnRenamed("id", "series_id"))


PATCHED = f"""{GRID}, d AS (SELECT median(a) AS mid FROM g), o AS (SELECT median(abs(a - mid)) / {delays.NORMAL_MAD}::DOUBLE AS mad FROM g, d),
n AS (SELECT p.series_id, p.a, median(q.a) AS med FROM g p JOIN g q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 GROUP BY p.series_id, p.a)"""


@query(f"""WITH {PATCHED} SELECT series_id, {rounds("med AS median", "CASE WHEN abs(a - med) > 1.5::DOUBLE * mad THEN med ELSE a END AS patched")} FROM n, o""")
def patched_map(spark, sf_dir):
    """Values far from their neighbourhood's median, by the whole map's spread, replaced by it."""
    return rounded(delays.patched(map_cells(spark, sf_dir), "a", 1.5).select(F.col("id").alias("series_id"), "median", "patched"))


#: Slopes of series y (id, t, v) on the mean series and its gradient, and their ratio.
MEAN_SERIES = f"""{SAMPLES}, m AS (SELECT t, avg(v) AS a FROM s GROUP BY t),
h AS (SELECT t, a, CASE WHEN lag(a) OVER w IS NULL THEN lead(a) OVER w - a WHEN lead(a) OVER w IS NULL THEN a - lag(a) OVER w ELSE (lead(a) OVER w - lag(a) OVER w) / 2 END AS b FROM m WINDOW w AS (ORDER BY t)),
c AS (SELECT t, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM h)"""


def ratios(rows: str) -> str:
    return f"""(SELECT id, (fb * aa - fa * ab) / (fa * bb - fb * ab) AS ratio FROM (SELECT id, sum(v * a) AS fa, sum(v * b) AS fb, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM {rows} JOIN c USING (t) GROUP BY id))"""


#: The mean series with 30 reflected samples on either side, moved by phase in the frequency domain.
TRAINED = f"""p AS (SELECT k, (SELECT a FROM m WHERE t = CASE WHEN k < 30 THEN 29 - k WHEN k < 94 THEN k - 30 ELSE 157 - k END) AS a FROM range(124) q(k)),
f AS (SELECT w, sum(a * cos(2 * pi() * w * k / 124)) AS re, -sum(a * sin(2 * pi() * w * k / 124)) AS im FROM p, range(63) q(w) GROUP BY w),
y AS (SELECT i * 0.05::DOUBLE AS id, t::INT AS t, sum(CASE WHEN w IN (0, 62) THEN 1 ELSE 2 END * (re * cos(2 * pi() * w * (t + 30 - i * 0.05::DOUBLE) / 124) - im * sin(2 * pi() * w * (t + 30 - i * 0.05::DOUBLE) / 124))
) / 124 AS v FROM f, range(-15, 16) q(i), range(64) z(t) GROUP BY 1, 2),
l AS (SELECT ratio, id AS delay FROM {ratios("y")})"""


@query(f"WITH {MEAN_SERIES}, {TRAINED} SELECT {rounds('delay', 'ratio')} FROM l")
def delay_training(spark, sf_dir):
    """Ratio of slopes at every trained delay of the mean series."""
    series = embedding_series(spark, sf_dir)
    found = delays.trained(lags.reference_series(series), 0.75, 0.05).select(F.explode("lookup").alias("p")).select("p.delay", "p.ratio")
    return rounded(found)


@query(f"""
WITH {MEAN_SERIES}, {TRAINED}, x AS {ratios("(SELECT series_id AS id, t, v FROM s)")}, k AS (SELECT *, lead(ratio) OVER (ORDER BY ratio) AS r2, lead(delay) OVER (ORDER BY ratio) AS d2 FROM l),
e AS (SELECT min(ratio) AS lo, max(ratio) AS hi, arg_min(delay, ratio) AS d_lo, arg_max(delay, ratio) AS d_hi FROM l)
SELECT x.id AS series_id, {rounds("x.ratio AS ratio", "CASE WHEN x.ratio < lo THEN d_lo WHEN x.ratio >= hi THEN d_hi ELSE k.delay + (x.ratio - k.ratio) / (r2 - k.ratio) * (d2 - k.delay) END AS delay")}
FROM x CROSS JOIN e LEFT JOIN k ON x.ratio >= k.ratio AND x.ratio < k.r2""")
def refined_delays(spark, sf_dir):
    """Every series' small delay against the mean series, looked up by its ratio of slopes."""
    series = embedding_series(spark, sf_dir)
    ref = lags.reference_series(series)
    rows = lags.with_reference(delays.slope_ratios(series, ref), delays.trained(ref, 0.75, 0.05))
    return rounded(rows.select("series_id", "ratio", delays.delay_of(F.col("ratio"), F.col("lookup")).alias("delay")))


@query(f"""
WITH {TWO_MAPS}, c AS (SELECT series_id, 0.5::DOUBLE + 3 * a AS c1, 2 * b AS c2 FROM m), d AS (SELECT *, c1 * c1 - 4 * c2 AS disc FROM c),
x AS (SELECT series_id, unnest([2 / (-c1 - sqrt(greatest(disc, 0))), 2 / (-c1 + sqrt(greatest(disc, 0)))]) AS x FROM d WHERE disc >= 0)
SELECT d.series_id, round(coalesce(any_value(v), 0), 6) + 0.0 AS delay FROM d LEFT JOIN (SELECT series_id, arg_min(x, abs(x)) AS v FROM x WHERE x BETWEEN -3 AND 3 GROUP BY series_id) USING (series_id) GROUP BY d.series_id""")
def polynomial_delays(spark, sf_dir):
    """The root nearest to 0, within three samples, of a polynomial per series."""
    m = two_maps(spark, sf_dir).select("series_id", F.array(0.5 + 3 * F.col("a"), 2 * F.col("b")).alias("c"))
    return rounded(m.select("series_id", K.by_batch(K.nearest_root(-3.0, 3.0), F.col("c"), returns="double").alias("delay")))


@query(f"""
WITH {SAMPLES}, f AS (SELECT series_id, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM s GROUP BY series_id), d AS (SELECT series_id, t, v, a + b * t AS fit, v - a - b * t AS d FROM s JOIN f USING (series_id)),
m AS (SELECT series_id, median(d) AS med FROM d GROUP BY series_id), k AS (SELECT series_id, median(abs(d - med)) / {delays.NORMAL_MAD}::DOUBLE AS mad FROM d JOIN m USING (series_id) GROUP BY series_id)
SELECT series_id, t, round(CASE WHEN abs(d - med) / mad > 2 THEN fit ELSE v END, 6) + 0.0 AS v FROM d JOIN m USING (series_id) JOIN k USING (series_id)""")
def trend_outliers_flattened(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", S.flatten_outliers(F.col("values"), 2.0).alias("values"))
    return rounded(to_samples(rows))


@query(f"""
WITH {SAMPLES}, {TWO_MAPS}, d AS (SELECT series_id, stddev_pop(v) AS sd, var_pop(v) AS var FROM s GROUP BY series_id)
SELECT series_id, t, {rounds("CASE WHEN a > 0 THEN v / sd * b ELSE 0 END AS by_std", "CASE WHEN a > 0 THEN v / var * b * b ELSE 0 END AS by_var", "CASE WHEN a > 0 THEN v / (10 - a) * CASE WHEN b > 0 THEN 1 ELSE -1 END ELSE 0 END AS by_lag")}
FROM s JOIN d USING (series_id) JOIN m USING (series_id)""")
def prenormalized_series(spark, sf_dir):
    """Series as they enter the refinement of a reference, by three of its normalisations and weights."""
    s = embedding_series(spark, sf_dir).withColumn("a", first_value()).withColumn("b", F.get("values", F.lit(1)))
    make = lambda norm, weight: delays.prenormalized(F.col("values"), F.col("a"), F.col("b"), F.col("b") * F.col("b"), F.col("a") > 0, norm, weight)
    rows = s.select("series_id", make("std", "R").alias("by_std"), make("var", "R2").alias("by_var"), make("invlag", "sign").alias("by_lag"))
    rows = rows.select("series_id", F.posexplode(F.arrays_zip("by_std", "by_var", "by_lag")).alias("t", "n")).select("series_id", "t", "n.*")
    return rounded(rows)


@query(f"""
WITH {SAMPLES}, x AS (SELECT label, series_id, max(v) AS top FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY top) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM x),
h AS (SELECT label, top / 2 AS hard FROM o WHERE k = least(round_even(0.98::DOUBLE * n, 0)::BIGINT, n - 1))
SELECT label, {rounds("hard", "0.4::DOUBLE * hard AS soft")}, count(*) FILTER (top > hard) AS n_hard, count(*) FILTER (top > 0.4::DOUBLE * hard) AS n_soft FROM x JOIN h USING (label) GROUP BY label, hard""")
def peak_thresholds(spark, sf_dir):
    """Per label half of the 98th percentile of its series' maxima, a softer limit, and how many series exceed them."""
    tops = embedding_series(spark, sf_dir).select("label", F.array_max("values").alias("top"))
    hard = quantiles.nearest_rank(tops, ["label"], "top", [0.98]).select("label", (F.col("top") / 2).alias("hard"))
    rows = tops.join(hard, "label").groupBy("label", "hard").agg(F.count_if(F.col("top") > F.col("hard")).alias("n_hard"), F.count_if(F.col("top") > 0.4 * F.col("hard")).alias("n_soft"))
    return rounded(rows.select("label", "hard", (0.4 * F.col("hard")).alias("soft"), "n_hard", "n_soft"))


@query(f"""
SELECT series_id, count(*) AS n, {rounds("avg(lag) AS lag_mean", "stddev_pop(lag) AS lag_std", "median(lag) AS lag_median", "avg(strength) AS strength_mean")} FROM ({ORACLE_SQL["windowed_lags"]}) GROUP BY series_id""")
def windowed_lag_variability(spark, sf_dir):
    """How much the lag of a series varies from window to window."""
    series = embedding_series(spark, sf_dir)
    w = lags.windowed_lags(series, lags.reference_series(series), 16, 8, 4)
    rows = w.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("lag").alias("lag_mean"), F.stddev_pop("lag").alias("lag_std"), F.median("lag").alias("lag_median"),
                                      F.avg(r6("strength")).alias("strength_mean"))
    return rounded(rows)
