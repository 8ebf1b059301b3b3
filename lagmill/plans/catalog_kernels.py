"""Registered queries of the kernel operators and of the lag pipeline; see catalog.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import decomposition, frames, grids, lags, maps, passes, quantiles, waves
from lagmill.plans.catalog import CORRELOGRAM, EVENT_HOURS, GRID, MOST_LAG, SAMPLES, TWO_MAPS, correlogram_rows, event_hours, grid_map, query, rounded, rounds, samples, two_maps
from lagmill.sources.tables import embedding_series, to_samples, to_series

#: Samples a second that the registered filters take the series to have.
RATE = 1.0


@query(f"""
WITH {SAMPLES}, f AS (SELECT unnest(range(0, 33))::INT AS k),
d AS (SELECT series_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, sum(v * sin(2 * pi() * k * t / 64)) AS im FROM s, f GROUP BY 1, 2)
SELECT series_id, k, round(sqrt(re * re + im * im), 6) + 0.0 AS magnitude FROM d""")
def magnitude_spectra(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.magnitude_spectrum, F.col("values")).alias("m"))
    return rounded(rows.select("series_id", F.posexplode("m").alias("k", "magnitude")))


@query(f"""
WITH {SAMPLES}, n AS (SELECT series_id, t, least(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 3), 2)::INT AS c FROM s WINDOW w AS (PARTITION BY series_id)),
g AS (SELECT t, avg(v) AS v FROM s GROUP BY t), r AS (SELECT t, least(floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 3), 2)::INT AS c FROM g),
j AS (SELECT series_id, (n.t - r.t)::INT AS lag, n.c AS x, r.c AS y, count(*) AS k FROM n JOIN r ON n.t - r.t BETWEEN -4 AND 4 GROUP BY ALL),
p AS (SELECT *, sum(k) OVER (PARTITION BY series_id, lag) AS a, sum(k) OVER (PARTITION BY series_id, lag, x) AS kx, sum(k) OVER (PARTITION BY series_id, lag, y) AS ky FROM j)
SELECT series_id, lag, round(sum(k / a::DOUBLE * ln(k * a::DOUBLE / (kx * ky))), 6) + 0.0 AS mi FROM p GROUP BY 1, 2""")
def lagged_mutual_information(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series))
    rows = both.select("series_id", K.by_batch(K.lagged_mutual_information(4), F.col("values"), F.col("ref")).alias("m"))
    rows = rows.select("series_id", F.posexplode("m").alias("i", "mi"))
    return rounded(rows.select("series_id", (F.col("i") - 4).alias("lag"), "mi"))


@query(f"""
WITH {SAMPLES}, x AS (SELECT series_id, t, v, t - 31.5 AS c FROM s), f AS (SELECT series_id, regr_slope(v, c) AS b, avg(v) AS m FROM x GROUP BY series_id),
q AS (SELECT t, (t - 31.5) ** 2 - (SELECT avg((u - 31.5) ** 2) FROM range(64) z(u)) AS q FROM range(64) y(t)),
h AS (SELECT series_id, sum(v * q) / sum(q * q) AS a FROM x JOIN q USING (t) GROUP BY series_id)
SELECT series_id, t, round(v - m - b * c - a * q, 6) + 0.0 AS v FROM x JOIN f USING (series_id) JOIN h USING (series_id) JOIN q USING (t)""")
def detrend_quadratic(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.poly_detrend(2), F.col("values")).alias("values"))
    return rounded(to_samples(rows))


@query(f"""
WITH {GRID}, n AS (SELECT p.series_id, q.a, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM g p JOIN g q
  ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.z BETWEEN p.z - 1 AND p.z + 1),
m AS (SELECT series_id, median(a) AS med FROM n WHERE d <= 1.75 GROUP BY series_id)
SELECT series_id, round(med, 6) + 0.0 AS median, abs(a - med) > 0.2 AS speckle FROM g JOIN m USING (series_id)""")
def despeckle_map(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("series_id", "x", "y", "z", F.get("values", F.lit(0)).alias("lag"))
    return rounded(grids.despeckle(cells, 0.2).select("series_id", "median", "speckle"))


@query(f"""
WITH {GRID}, n AS (SELECT p.x, p.y, p.z, q.a, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 AS d FROM g p JOIN g q
  ON q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.z BETWEEN p.z - 2 AND p.z + 2)
SELECT x, y, z, round(sum(exp(-d / 0.98) * a) / sum(exp(-d / 0.98)), 6) + 0.0 AS a FROM n WHERE d <= 2.1 * 2.1 GROUP BY 1, 2, 3""")
def gaussian_smoothed_map(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("x", "y", "z", F.get("values", F.lit(0)).alias("a"))
    return rounded(grids.gaussian_smooth(cells, "a", 0.7))


@query(f"""
WITH {SAMPLES}, g AS (SELECT label, t, avg(v) AS v FROM s GROUP BY 1, 2), c AS (SELECT x.label AS i, y.label AS j, avg(x.v * y.t) AS v FROM g x JOIN g y USING (t) GROUP BY 1, 2)
SELECT p.i, p.j, round((p.v + q.v) / 2, 6) + 0.0 AS v FROM c p JOIN c q ON p.i = q.j AND p.j = q.i""")
def symmetrized_matrix(spark, sf_dir):
    means = samples(spark, sf_dir).groupBy("label", "t").agg(F.avg("v").alias("v"))
    right = means.select(F.col("label").alias("j"), "t").withColumn("w", F.col("t"))
    cells = means.select(F.col("label").alias("i"), "t", "v").join(right, "t").groupBy("i", "j").agg(F.avg(F.col("v") * F.col("w")).alias("v"))
    return rounded(grids.symmetrize(cells))


@query(f"""
WITH {EVENT_HOURS}, m AS (SELECT DISTINCT unnest(range(ceil(h)::BIGINT, floor(h + 2)::BIGINT + 1)) AS t FROM e WHERE event_type = (SELECT min(event_type) FROM e)),
x AS (SELECT floor(h)::BIGINT AS t, count(*) AS n, sum(value) AS v FROM e GROUP BY 1)
SELECT t, n, round(v, 6) + 0.0 AS v FROM x WHERE t IN (SELECT t FROM m)""")
def temporal_mask(spark, sf_dir):
    e = event_hours(spark, sf_dir)
    hourly = e.groupBy(F.floor("h").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    kind = e.agg(F.min("event_type").alias("event_type"))
    spans = e.join(F.broadcast(kind), "event_type", "left_semi").select(F.col("h").alias("start"), F.lit(2).alias("duration"))
    return rounded(frames.temporal_mask(hourly, spans))


@query(f"""
WITH {SAMPLES}, o AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM s WHERE v <> 0),
f AS (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98])::DOUBLE AS fraction), q AS (SELECT label, fraction, v FROM f JOIN o ON k = least(round_even(fraction * n, 0)::BIGINT, n - 1)),
p AS (SELECT label, min(v) FILTER (fraction = 0.02) AS pct02, min(v) FILTER (fraction = 0.25) AS pct25, min(v) FILTER (fraction = 0.5) AS pct50, min(v) FILTER (fraction = 0.75) AS pct75, min(v) FILTER (fraction = 0.98) AS pct98 FROM q GROUP BY label)
SELECT label, {rounds("pct02", "pct25", "pct50", "pct75", "pct98", "pct25 - pct02 AS q1width", "pct50 - pct25 AS q2width", "pct75 - pct50 AS q3width", "pct98 - pct75 AS q4width", "pct75 - pct25 AS mid50width")} FROM p""")
def quality_quartiles(spark, sf_dir):
    q = quantiles.nearest_rank(samples(spark, sf_dir), ["label"], "v", [0.02, 0.25, 0.5, 0.75, 0.98], nonzero=True)
    pick = lambda f, n: F.max(F.when(F.col("fraction") == f, F.col("v"))).alias(n)
    p = q.groupBy("label").agg(pick(0.02, "pct02"), pick(0.25, "pct25"), pick(0.5, "pct50"), pick(0.75, "pct75"), pick(0.98, "pct98"))
    steps = {"q1width": ("pct25", "pct02"), "q2width": ("pct50", "pct25"), "q3width": ("pct75", "pct50"), "q4width": ("pct98", "pct75"), "mid50width": ("pct75", "pct25")}
    return rounded(p.withColumns({k: F.col(a) - F.col(b) for k, (a, b) in steps.items()}))


@query(CORRELOGRAM + """, k AS (SELECT series_id, max(c) AS c, arg_max(lag, round(c, 9) - lag * 1e-12) AS lag FROM c GROUP BY series_id)
SELECT count(*) AS n, count(*) FILTER (c >= 0.2 AND abs(lag) BETWEEN 0 AND 6 AND c < 0.9) AS kept, count(*) FILTER (c < 0.2) AS low_amp,
  count(*) FILTER (abs(lag) > 6) AS outside_lag, count(*) FILTER (c >= 0.9) AS wide FROM k""")
def refine_mask_counts(spark, sf_dir):
    fits = lags.best_lags(correlogram_rows(spark, sf_dir), MOST_LAG).withColumn("sigma", F.col("strength"))
    return grids.refine_mask(fits, 0.2, (0, 6), 0.9)


@query(CORRELOGRAM + """, k AS (SELECT series_id, arg_max(lag, round(c, 9) - lag * 1e-12) AS lag FROM c GROUP BY series_id), rg AS (SELECT t, v FROM g),
x AS (SELECT series_id, t, greatest(0, least(63, t - lag)) AS u FROM k, range(64) z(t))
SELECT series_id, x.t::INT AS t, round(rg.v, 6) + 0.0 AS v FROM x JOIN rg ON rg.t = x.u""")
def lagged_regressors(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    fits = lags.best_lags(correlogram_rows(spark, sf_dir), MOST_LAG).select("series_id", "lag")
    rows = lags.lagged_regressors(fits, lags.reference_series(series))
    return rounded(to_samples(rows.select("series_id", F.col("regressor").alias("values"))))


@query(f"""
WITH {SAMPLES}, p AS (SELECT x.series_id, x.v AS a, y.v AS b FROM s x JOIN s y ON x.series_id = y.series_id AND y.t = x.t + 1 WHERE x.t % 2 = 0)
SELECT series_id, round(corr(a, b), 6) + 0.0 AS r, count(*) AS n FROM p GROUP BY series_id""")
def even_odd_pair_correlation(spark, sf_dir):
    return rounded(maps.paired_correlation(samples(spark, sf_dir))["series_id"])


@query(f"""
WITH {TWO_MAPS} SELECT label, {rounds("avg(a - b) AS mean_diff", "avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t")}, count(*) - 1 AS dof FROM m GROUP BY label""")
def paired_t_test(spark, sf_dir):
    return rounded(maps.paired_t(two_maps(spark, sf_dir), ["label"], "a", "b"))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) FILTER (label < 5) AS m1, avg(v) FILTER (label >= 5) AS m2, var_samp(v) FILTER (label < 5) AS v1, var_samp(v) FILTER (label >= 5) AS v2,
  count(*) FILTER (label < 5) AS n1, count(*) FILTER (label >= 5) AS n2 FROM s GROUP BY t)
SELECT t, {rounds("m1 - m2 AS mean_diff")}, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS "t_value", n1 + n2 - 2 AS dof FROM g""")
def independent_t_test(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumnRenamed("t", "time")
    found = maps.independent_t(rows, ["time"], F.col("label") < 5, "v").withColumnRenamed("t", "t_value")
    return rounded(found.withColumnRenamed("time", "t"))


@query(f"""
WITH {GRID}, k AS (SELECT p.series_id, p.a, xn.a AS xn, xp.a AS xp, yn.a AS yn, yp.a AS yp, zn.a AS zn, zp.a AS zp FROM g p
  LEFT JOIN g xn ON xn.x = p.x + 1 AND xn.y = p.y AND xn.z = p.z LEFT JOIN g xp ON xp.x = p.x - 1 AND xp.y = p.y AND xp.z = p.z
  LEFT JOIN g yn ON yn.y = p.y + 1 AND yn.x = p.x AND yn.z = p.z LEFT JOIN g yp ON yp.y = p.y - 1 AND yp.x = p.x AND yp.z = p.z
  LEFT JOIN g zn ON zn.z = p.z + 1 AND zn.x = p.x AND zn.y = p.y LEFT JOIN g zp ON zp.z = p.z - 1 AND zp.x = p.x AND zp.y = p.y),
d AS (SELECT series_id, coalesce((xn - xp) / 2, xn - a, a - xp) AS g_x, coalesce((yn - yp) / 2, yn - a, a - yp) AS g_y, coalesce((zn - zp) / 2, zn - a, a - zp) AS g_z FROM k)
SELECT series_id, {rounds("g_x", "g_y", "g_z", "sqrt(coalesce(g_x, 0) ** 2 + coalesce(g_y, 0) ** 2 + coalesce(g_z, 0) ** 2) AS slope")} FROM d""")
def map_gradients(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("series_id", "x", "y", "z", F.get("values", F.lit(0)).alias("a"))
    return rounded(maps.gradients(cells, "a").select("series_id", "g_x", "g_y", "g_z", "slope"))


@query(f"""
WITH {SAMPLES} SELECT series_id, {rounds("sqrt(avg(v * v)) AS rms", "-sum(CASE WHEN v <> 0 THEN v * v * log2(v * v) ELSE 0 END) AS entropy", "sum(t * abs(v)) / sum(abs(v)) AS com")} FROM s GROUP BY series_id""")
def energy_measures(spark, sf_dir):
    v = F.col("values")
    size = F.transform(v, lambda x: F.abs(x))
    place = F.transform(v, lambda x, i: i.cast("double"))
    return rounded(embedding_series(spark, sf_dir).select("series_id", S.rms(v).alias("rms"), S.energy_entropy(v).alias("entropy"), S.center_of_mass(place, size).alias("com")))


@query(f"""
WITH {SAMPLES}, w AS (SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS n, lag(v * v) OVER o AS p2, lead(v * v) OVER o AS n2 FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, {rounds("v * v AS square", "(CASE WHEN p IS NULL THEN n - v WHEN n IS NULL THEN v - p ELSE (n - p) / 2 END) AS deriv",
    "(CASE WHEN p IS NULL THEN n2 - v * v WHEN n IS NULL THEN v * v - p2 ELSE (n2 - p2) / 2 END) AS square_deriv")} FROM w""")
def expanded_regressors(spark, sf_dir):
    made = S.expanded({"v": F.col("values")}, 2)
    rows = embedding_series(spark, sf_dir).select("series_id", made["v^2"].alias("square"), made["v_deriv"].alias("deriv"), made["v^2_deriv"].alias("square_deriv"))
    return rounded(rows.select("series_id", F.posexplode(F.arrays_zip("square", "deriv", "square_deriv")).alias("t", "p")).select("series_id", "t", "p.*"))


@query(f"""
WITH {GRID} SELECT label, count(*) AS n, round(avg(a), 6) + 0.0 AS a FROM (SELECT CASE WHEN l IN (1, 2, 3) THEN 1 WHEN l IN (4, 5) THEN 2 ELSE 0 END + CASE WHEN x >= 4 AND l IN (1, 2, 3, 4, 5) THEN 10 ELSE 0 END AS label, a
  FROM (SELECT g.*, e.label AS l FROM g JOIN embeddings e ON e.vec_id = g.series_id)) GROUP BY label""")
def atlas_relabelled(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("x", "y", "z", "label", F.get("values", F.lit(0)).alias("a"))
    merged = maps.halves(maps.relabel(cells, {1: [1, 2, 3], 2: [4, 5]}), 4, 10)
    return rounded(merged.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("a")))


@query(f"""
WITH {SAMPLES}, y AS (SELECT s.series_id, u, v FROM range(124) r(u), s WHERE t = CASE WHEN u < 30 THEN 29 - u WHEN u < 94 THEN u - 30 ELSE 157 - u END),
f AS (SELECT k, k / 124.0::DOUBLE AS f FROM range(63) q(k)),
a AS (SELECT k, greatest(0, least(1, (0.1575::DOUBLE - f) / 0.0075::DOUBLE)) * (1 - greatest(0, least(1, (0.01::DOUBLE - f) / 0.0005::DOUBLE))) * CASE WHEN k IN (0, 62) THEN 1 ELSE 2 END AS a FROM f),
h AS (SELECT m, sum(a * cos(2 * pi() * k * m / 124)) / 124 AS h FROM a, range(124) z(m) GROUP BY m)
SELECT y.series_id, any_value(e.label) AS label, w.t::INT AS t, round(sum(y.v * h), 6) + 0.0 AS v
FROM y, range(64) w(t), h, embeddings e WHERE h.m = (w.t + 30 - y.u + 124) % 124 AND e.vec_id = y.series_id GROUP BY y.series_id, w.t""")
def band_filtered(spark, sf_dir):
    f = K.band_filter(RATE, "lfo")
    rows = embedding_series(spark, sf_dir).select("series_id", "label", K.by_batch(f, F.col("values")).alias("values"))
    return rounded(to_samples(rows))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS v FROM s GROUP BY t), z AS (SELECT series_id, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM s WINDOW w AS (PARTITION BY series_id)),
r AS (SELECT t, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS v FROM g),
fa AS (SELECT series_id, k, sum(v * cos(2 * pi() * k * t / 128)) AS re, -sum(v * sin(2 * pi() * k * t / 128)) AS im FROM z, range(65) q(k) GROUP BY 1, 2),
fb AS (SELECT k, sum(v * cos(2 * pi() * k * t / 128)) AS re, -sum(v * sin(2 * pi() * k * t / 128)) AS im FROM r, range(65) q(k) GROUP BY 1),
x AS (SELECT series_id, k, fa.re * fb.re + fa.im * fb.im AS re, fa.im * fb.re - fa.re * fb.im AS im FROM fa JOIN fb USING (k)),
w AS (SELECT *, sqrt(re * re + im * im) AS w, max(sqrt(re * re + im * im)) OVER (PARTITION BY series_id) AS top FROM x),
p AS (SELECT *, CASE WHEN w > 0.1::DOUBLE * top THEN re / w ELSE 0 END AS pr, CASE WHEN w > 0.1::DOUBLE * top THEN im / w ELSE 0 END AS pi_ FROM w),
c AS (SELECT series_id, lag, sum(CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * lag / 128) - im * sin(2 * pi() * k * lag / 128))) / 128 AS plain,
        sum(CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END * (pr * cos(2 * pi() * k * lag / 128) - pi_ * sin(2 * pi() * k * lag / 128))) / 128 AS c FROM p, range(-64, 64) l(lag) GROUP BY 1, 2),
n AS (SELECT series_id, lag, c * max(abs(plain)) OVER o / max(abs(c)) OVER o AS c FROM c WINDOW o AS (PARTITION BY series_id)),
i AS (SELECT * FROM n WHERE lag BETWEEN -10 AND 10), b AS (SELECT series_id, arg_max(lag, round(c, 9) - lag * 1e-12) AS lag FROM i GROUP BY series_id),
m AS (SELECT b.series_id, b.lag, i.c AS mid, l.c AS lo, h.c AS hi FROM b JOIN i ON i.series_id = b.series_id AND i.lag = b.lag LEFT JOIN i l ON l.series_id = b.series_id AND l.lag = b.lag - 1
  LEFT JOIN i h ON h.series_id = b.series_id AND h.lag = b.lag + 1),
d AS (SELECT *, coalesce(CASE WHEN abs(lo - 2 * mid + hi) > 1e-12 THEN least(greatest(0.5::DOUBLE * (lo - hi) / (lo - 2 * mid + hi), -0.5), 0.5) ELSE 0 END, 0) AS shift FROM m)
SELECT series_id, lag::INT AS lag, {rounds("mid AS strength", "lag + shift AS fine_lag", "CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN mid - 0.25::DOUBLE * (lo - hi) * shift ELSE mid END AS fine_strength")} FROM d""")
def generalized_correlation_peaks(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series))
    gcc = K.generalized_correlation(MOST_LAG, "phat")
    rows = both.select("series_id", K.by_batch(lambda a, b: gcc(K.standardized(a), K.standardized(b)), F.col("values"), F.col("ref")).alias("corr"))
    return rounded(lags.best_lags(rows, MOST_LAG))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS v FROM s GROUP BY t), x AS (SELECT series_id, t, v FROM s UNION ALL SELECT -1, t, v FROM g),
q AS (SELECT series_id, i, t - 8 * i AS j, v - avg(v) OVER (PARTITION BY series_id, i) AS v FROM x, range(7) z(i) WHERE t BETWEEN 8 * i AND 8 * i + 15),
f AS (SELECT series_id, i, k, sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) * cos(2 * pi() * k * j / 16)) AS re,
  -sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) * sin(2 * pi() * k * j / 16)) AS im FROM q, range(9) z(k) GROUP BY 1, 2, 3),
c AS (SELECT a.series_id, k, (avg(a.re * b.re + a.im * b.im) ** 2 + avg(a.im * b.re - a.re * b.im) ** 2) / greatest(avg(a.re ** 2 + a.im ** 2) * avg(b.re ** 2 + b.im ** 2), 1e-300) AS c
  FROM f a JOIN f b USING (i, k) WHERE a.series_id >= 0 AND b.series_id = -1 GROUP BY 1, 2)
SELECT series_id, round(max(c), 6) + 0.0 AS peak, round(arg_max(k, c) / 16.0::DOUBLE, 6) + 0.0 AS frequency FROM c WHERE k > 0 GROUP BY series_id""")
def coherence_peaks(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series))
    rows = both.select("series_id", K.by_batch(K.coherence(16), F.col("values"), F.col("ref")).alias("c"))
    rows = rows.select("series_id", "c", F.array_max(F.slice("c", 2, F.size("c"))).alias("peak"))
    return rounded(rows.select("series_id", "peak", ((F.array_position("c", F.col("peak")) - 1) * RATE / 16).alias("frequency")))


@query(f"""
WITH {SAMPLES}, h AS (SELECT m, sum(sin(2 * pi() * k * m / 64)) / 32 AS h FROM range(64) z(m), range(1, 32) q(k) GROUP BY m),
i AS (SELECT s.series_id, w.t, sum(s.v * h) AS im FROM s, range(64) w(t), h WHERE h.m = (w.t - s.t + 64) % 64 GROUP BY 1, 2),
p AS (SELECT s.series_id, s.t, atan2(im, v) AS p, sqrt(v * v + im * im) AS e FROM s JOIN i ON i.series_id = s.series_id AND i.t = s.t),
d AS (SELECT *, p - lag(p) OVER (PARTITION BY series_id ORDER BY t) AS d FROM p),
u AS (SELECT *, coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), p) AS step FROM d)
SELECT series_id, t::INT AS t, round(sum(step) OVER (PARTITION BY series_id ORDER BY t), 6) + 0.0 AS phase, round(e, 6) + 0.0 AS envelope FROM u""")
def phase_and_envelope(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.phase, F.col("values")).alias("phase"), K.by_batch(K.envelope, F.col("values")).alias("envelope"))
    return rounded(rows.select("series_id", F.posexplode(F.arrays_zip("phase", "envelope")).alias("t", "p")).select("series_id", "t", "p.*"))


@query(f"""
WITH {SAMPLES}, x AS (SELECT t, avg(v) FILTER (label = 0) AS x1, avg(v) FILTER (label = 1) AS x2, cos(pi() * (t + 0.5::DOUBLE) / 64) AS x3 FROM s GROUP BY t),
c AS (SELECT t, x1 - avg(x1) OVER () AS c1, x2 - avg(x2) OVER () AS c2, x3 - avg(x3) OVER () AS c3, avg(x1) OVER () AS m1, avg(x2) OVER () AS m2, avg(x3) OVER () AS m3 FROM x),
a AS (SELECT sum(c1 * c2) / sum(c1 * c1) AS a21, sum(c1 * c3) / sum(c1 * c1) AS a31 FROM c), q2 AS (SELECT c.*, c2 - a21 * c1 AS q2, a21, a31 FROM c, a),
b AS (SELECT sum(q2 * c3) / sum(q2 * q2) AS a32 FROM q2), q AS (SELECT q2.*, a32, c3 - a31 * c1 - a32 * q2 AS q3 FROM q2, b),
y AS (SELECT series_id, avg(v) AS my, sum((v - 0) * c1) / sum(c1 * c1) AS g1, sum(v * q2) / sum(q2 * q2) AS g2, sum(v * q3) / sum(q3 * q3) AS g3, sum(c1 * c1) AS s1, sum(q2 * q2) AS s2, sum(q3 * q3) AS s3,
  var_pop(v) * 64 AS syy, any_value(a21) AS a21, any_value(a31) AS a31, any_value(a32) AS a32, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3 FROM s JOIN q USING (t) GROUP BY series_id),
z AS (SELECT *, g3 AS b3, g2 - a32 * g3 AS b2, g1 - a21 * (g2 - a32 * g3) - a31 * g3 AS b1, g1 * g1 * s1 + g2 * g2 * s2 + g3 * g3 * s3 AS fit FROM y)
SELECT series_id, {rounds("my - b1 * m1 - b2 * m2 - b3 * m3 AS beta0", "b1 AS beta1", "b2 AS beta2", "b3 AS beta3", "fit / syy AS r2", "sqrt((syy - fit) / 64) AS residual_std")} FROM z""")
def confounds_removed(spark, sf_dir):
    """Every series less its part along the mean series of the first two regions and a slow drift; coefficients and R squared. The
    regressors are a few series long and fixed in number, so the driver prepares them."""
    means = to_series(samples(spark, sf_dir).where("label < 2").groupBy("label", "t").agg(F.avg("v").alias("v")), ["label"]).orderBy("label").limit(2).collect()
    n = len(means[0]["values"]) if means else 64
    evs = np.column_stack([*(np.asarray(r["values"]) for r in means), np.cos(np.pi * (np.arange(n) + 0.5) / n)])
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.regression(evs), F.col("values")).alias("o"))
    k = evs.shape[1] + 1
    return rounded(rows.select("series_id", *(F.get("o", F.lit(i)).alias(f"beta{i}") for i in range(k)), F.get("o", F.lit(k)).alias("r2"), S.std_pop(F.slice("o", k + 2, n)).alias("residual_std")))


@query()
def lag_pipeline_fits(spark, sf_dir):
    """Lag, strength and width of every series after three passes of reference refinement."""
    fits, _, _ = passes.lag_passes(embedding_series(spark, sf_dir), MOST_LAG)
    return rounded(fits.select("series_id", "lag", "strength", "sigma", "fail"))


@query()
def lag_pipeline_filtered(spark, sf_dir):
    """What is left of every series without the moving reference at its own lag."""
    series = embedding_series(spark, sf_dir)
    fits, ref, _ = passes.lag_passes(series, MOST_LAG)
    rows = passes.filtered(series, fits, ref)
    return rounded(rows.select("series_id", "slope", "r", "r2", S.std_pop(F.col("filtered")).alias("filtered_std")))


@query()
def null_distribution(spark, sf_dir):
    """Nearest-rank thresholds of the strengths that surrogates of the reference reach, one surrogate per series of the table."""
    series = embedding_series(spark, sf_dir)
    ref = lags.reference_series(series).first()["ref"]
    null = passes.null_distribution(spark, ref or [0.0, 1.0], series.count(), MOST_LAG)
    return rounded(quantiles.nearest_rank(null, [], "strength", [0.5, 0.95, 0.99]))


@query(f"""
WITH {SAMPLES}, n AS (SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS q FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)),
k AS (SELECT series_id, t, v FROM n WHERE v > p AND v >= q), j AS (SELECT s.series_id, s.t, max(k.t) FILTER (k.t <= s.t) AS a, min(k.t) FILTER (k.t >= s.t) AS b FROM s JOIN k USING (series_id) GROUP BY 1, 2),
x AS (SELECT series_id, t, coalesce(a, b) AS a, coalesce(b, a) AS b FROM j)
SELECT x.series_id, x.t, round(ka.v + CASE WHEN b > a THEN (x.t - a) / (b - a)::DOUBLE ELSE 0 END * (kb.v - ka.v), 6) + 0.0 AS envelope
FROM x JOIN k ka ON ka.series_id = x.series_id AND ka.t = a JOIN k kb ON kb.series_id = x.series_id AND kb.t = b""")
def peak_envelopes(spark, sf_dir):
    rows = waves.peak_envelope(samples(spark, sf_dir).drop("label"))
    return rounded(rows.where("envelope is not null").select("series_id", "t", "envelope"))


@query(f"""
WITH {EVENT_HOURS}, c AS (SELECT event_type, value, (h / 24 - floor(h / 24)) * 24 AS a FROM e), p AS (SELECT *, floor(a)::INT + k AS p FROM c, (SELECT unnest([-1, 0, 1]) AS k)),
w AS (SELECT event_type, ((p + 24) % 24)::INT AS bin, value, exp(-(a - p) * (a - p) / 1.125) AS w FROM p WHERE abs(a - p) <= 1.5)
SELECT event_type, bin, {rounds("sum(w * value) / sum(w) AS v", "sum(w) AS weight")} FROM w GROUP BY 1, 2""")
def phase_gridded_average(spark, sf_dir):
    return rounded(waves.grid_average(event_hours(spark, sf_dir), ["event_type"], F.col("h") / 24, F.col("value"), 24))


@query(f"""
WITH {SAMPLES}, w AS (SELECT series_id, t, (v - avg(v) OVER (PARTITION BY series_id)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * t / 63)) AS v FROM s),
f AS (SELECT series_id, k, sqrt(sum(v * cos(2 * pi() * k * t / 64)) ** 2 + sum(v * sin(2 * pi() * k * t / 64)) ** 2) AS m FROM w, range(33) z(k) GROUP BY 1, 2),
b AS (SELECT series_id, arg_max(k, m) AS k, max(m) AS m, sum(m * m) AS power FROM f WHERE k / 64.0::DOUBLE BETWEEN 0.05::DOUBLE AND 0.45::DOUBLE GROUP BY series_id),
n AS (SELECT b.*, l.m AS lo, h.m AS hi FROM b JOIN f l ON l.series_id = b.series_id AND l.k = b.k - 1 JOIN f h ON h.series_id = b.series_id AND h.k = b.k + 1)
SELECT series_id, {rounds("(k + CASE WHEN abs(lo - 2 * m + hi) > 1e-12 THEN least(greatest(0.5::DOUBLE * (lo - hi) / (lo - 2 * m + hi), -0.5), 0.5) ELSE 0 END) / 64 AS frequency", "m * m / power AS share")} FROM n""")
def dominant_frequencies(spark, sf_dir):
    return rounded(waves.dominant_frequency(embedding_series(spark, sf_dir), RATE, 0.05, 0.45))


@query(f"""
WITH {SAMPLES}, q AS (SELECT series_id, 8 * i AS start, t - 8 * i AS j, v FROM s, range(7) z(i) WHERE t BETWEEN 8 * i AND 8 * i + 15),
f AS (SELECT series_id, start, k, sqrt(sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) * cos(2 * pi() * k * j / 16)) ** 2
  + sum(v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) * sin(2 * pi() * k * j / 16)) ** 2) AS m FROM q, range(9) z(k) GROUP BY 1, 2, 3)
SELECT series_id, start::INT AS start, round(max(m), 6) + 0.0 AS peak, arg_max(k, m) AS k FROM f GROUP BY series_id, start""")
def spectrogram_peaks(spark, sf_dir):
    rows = waves.spectrogram(embedding_series(spark, sf_dir), 16, 8)
    return rounded(rows.select("series_id", "start", F.array_max("magnitudes").alias("peak"), (F.array_position("magnitudes", F.array_max("magnitudes")) - 1).alias("k")))


@query(f"""
WITH {SAMPLES}, q AS (SELECT series_id, i, t - 16 * i AS j, v, avg(v) OVER (PARTITION BY series_id, i) AS m FROM s, range(3) z(i) WHERE t BETWEEN 16 * i AND 16 * i + 31),
a AS (SELECT series_id, i, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4 FROM q GROUP BY 1, 2),
x AS (SELECT series_id, i, count(*) FILTER ((v - m) * (p - m) < 0) / 32.0::DOUBLE AS crossings FROM (SELECT *, lag(v) OVER (PARTITION BY series_id, i ORDER BY j) AS p FROM q) GROUP BY 1, 2),
f AS (SELECT series_id, i, k, sqrt(sum(v * cos(2 * pi() * k * j / 32)) ** 2 + sum(v * sin(2 * pi() * k * j / 32)) ** 2) AS s FROM q, range(1, 17) z(k) GROUP BY 1, 2, 3),
l AS (SELECT series_id, i, exp(avg(ln(greatest(s, 1e-300)))) / avg(s) AS flatness FROM f GROUP BY 1, 2),
w AS (SELECT series_id, i, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 AS kurt, crossings, flatness FROM a JOIN x USING (series_id, i) JOIN l USING (series_id, i))
SELECT series_id, {rounds(*(f"{f}({c}) AS {c}_{n}" for c in ("skew", "kurt", "crossings", "flatness") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"))))}, count(*) AS n FROM w GROUP BY series_id""")
def waveform_quality(spark, sf_dir):
    return rounded(waves.quality(embedding_series(spark, sf_dir), RATE, 32))


@query(f"""
WITH RECURSIVE {SAMPLES},
n(t, ahead, var) AS (SELECT 0, 0.55::DOUBLE, 0.5::DOUBLE UNION ALL SELECT t + 1, var + 0.05::DOUBLE, 0.5::DOUBLE * (var + 0.05::DOUBLE) / (var + 0.55::DOUBLE) FROM n WHERE t < 63),
f(series_id, t, level) AS (SELECT series_id, 0, v FROM s WHERE t = 0
  UNION ALL SELECT f.series_id, f.t + 1, level + ahead / (ahead + 0.5::DOUBLE) * (s.v - level) FROM f JOIN n ON n.t = f.t + 1 JOIN s ON s.series_id = f.series_id AND s.t = f.t + 1),
b(series_id, t, level) AS (SELECT series_id, t, level FROM f WHERE t = 63
  UNION ALL SELECT f.series_id, f.t, f.level + m.var / n.ahead * (b.level - f.level) FROM b JOIN f ON f.series_id = b.series_id AND f.t = b.t - 1 JOIN n ON n.t = b.t JOIN n m ON m.t = b.t - 1)
SELECT series_id, t::INT AS t, round(level, 6) + 0.0 AS v FROM b""")
def kalman_smoothed(spark, sf_dir):
    return rounded(to_samples(waves.kalman_smooth(embedding_series(spark, sf_dir), 0.05, 0.5)))


@query(f"""
WITH {SAMPLES}, y AS (SELECT series_id, t, v - avg(v) OVER (PARTITION BY series_id) AS y FROM s),
l AS (SELECT *, coalesce(lag(y, 1) OVER w, 0) AS y1, coalesce(lag(y, 2) OVER w, 0) AS y2, coalesce(lag(y, 3) OVER w, 0) AS y3 FROM y WINDOW w AS (PARTITION BY series_id ORDER BY t)),
r AS (SELECT series_id, sum(y * y) / 64 + 1e-12 AS r0, sum(y * y1) / 64 AS r1, sum(y * y2) / 64 AS r2, sum(y * y3) / 64 AS r3 FROM l GROUP BY series_id),
o1 AS (SELECT *, r1 / r0 AS k1, r0 * (1 - (r1 / r0) ** 2) AS e1 FROM r), o2 AS (SELECT *, (r2 - k1 * r1) / e1 AS k2 FROM o1),
o3 AS (SELECT *, k1 - k2 * k1 AS b1, k2 AS b2, e1 * (1 - k2 * k2) AS e2 FROM o2), o4 AS (SELECT *, (r3 - b1 * r2 - b2 * r1) / e2 AS k3 FROM o3)
SELECT series_id, t, round(y - (b1 - k3 * b2) * y1 - (b2 - k3 * b1) * y2 - k3 * y3, 6) + 0.0 AS v FROM l JOIN o4 USING (series_id)""")
def prewhitened(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(waves.prewhiten(3), F.col("values")).alias("values"))
    return rounded(to_samples(rows))


@query()
def resampled_series(spark, sf_dir):
    """Every series at half steps, by cubic spline."""
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.upsampled(2), F.col("values")).alias("values"))
    return rounded(to_samples(rows))


@query()
def principal_loadings(spark, sf_dir):
    """Loadings of every series on the leading principal time courses."""
    series = embedding_series(spark, sf_dir)
    components, _, _ = decomposition.principal_timecourses(series, decomposition.common_length(series), 3)
    rows = decomposition.loadings(series, components)
    return rounded(rows.select("series_id", *(F.get("loadings", F.lit(i)).alias(f"pc{i + 1}") for i in range(3))))
