"""Registered queries of masks, peak fits, statistics of correlations, curves, spectra and grids; see catalog.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import fits, grids, lags, masks, quantiles, summaries, waves
from lagmill.operators.graphs import roots
from lagmill.plans.catalog import CORRELOGRAM, GRID, MOST_LAG, SAMPLES, TWO_MAPS, correlogram_rows, grid_map, query, rounded, rounds, two_maps
from lagmill.sources.tables import embedding_series, to_samples


def first_value():
    """A series' first value, which serves as its map's value."""
    return F.get("values", F.lit(0))


PEAK = CORRELOGRAM + f""", i AS (SELECT series_id, arg_max(lag, c) AS k, max(c) AS top FROM c WHERE abs(lag) < {MOST_LAG} GROUP BY series_id),
n AS (SELECT *, (lead(c) OVER w - lag(c) OVER w) / 2 AS g FROM c WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
e AS (SELECT n.*, k, top FROM n JOIN i USING (series_id))"""
CLAMPED = """SELECT series_id, kind, round(least(greatest(lag, -10), 10), 6) + 0.0 AS lag, round(least(greatest(high, 0), 1), 6) + 0.0 AS strength, round(least(greatest(wide, 0.1::DOUBLE), 100), 6) + 0.0 AS width,
  init + CASE WHEN high < 0 THEN 256 ELSE 0 END + CASE WHEN abs(high) > 1.0001::DOUBLE THEN 512 ELSE 0 END + CASE WHEN wide < 0.1::DOUBLE THEN 1024 ELSE 0 END + CASE WHEN wide > 100 THEN 2048 ELSE 0 END
  + CASE WHEN lag < -10 THEN 4096 ELSE 0 END + CASE WHEN lag > 10 THEN 8192 ELSE 0 END AS flags FROM """


def extent(over: str) -> str:
    """Samples of the peak: from the top on while the curve falls and the condition holds."""
    return f"""l AS (SELECT series_id, coalesce(max(lag) FILTER (lag < greatest(k - 1, -{MOST_LAG - 1}) AND NOT (abs(lag) < {MOST_LAG} AND {over} AND g >= 0)), -{MOST_LAG + 1}) + 1 AS lo,
  coalesce(min(lag) FILTER (lag > least(k + 1, {MOST_LAG - 1}) AND NOT (abs(lag) < {MOST_LAG} AND {over} AND g <= 0)), {MOST_LAG + 1}) - 1 AS hi FROM e GROUP BY series_id),
b AS (SELECT series_id, greatest(lo, -{MOST_LAG - 1}) AS lo, least(hi, {MOST_LAG - 1}) AS hi FROM l),
p AS (SELECT e.*, lo, hi FROM e JOIN b USING (series_id) WHERE lag BETWEEN lo AND hi)"""


INIT = "any_value(CASE WHEN top < 0 THEN 1 ELSE 0 END + CASE WHEN hi - lo < 2 THEN 4 ELSE 0 END)"


@query(PEAK + ", " + extent("c > 0.5::DOUBLE * top") + f""", f AS (SELECT series_id, sum(lag * c) / sum(c) AS lag, any_value(top) AS high, sum(c) AS m, {INIT} AS init FROM p GROUP BY series_id),
w AS (SELECT series_id, 'fastgauss' AS kind, any_value(f.lag) AS lag, any_value(high) AS high, sqrt(abs(sum(c * (p.lag - f.lag) ** 2) / any_value(m))) AS wide, any_value(init) AS init FROM p JOIN f USING (series_id) GROUP BY series_id),
o AS (SELECT series_id, 'None' AS kind, round(any_value(k), 6) + 0.0 AS lag, round(greatest(any_value(top), 0), 6) + 0.0 AS strength,
  round(least(100, CASE WHEN any_value(hi - lo) < 2 THEN 3 ELSE any_value(hi - lo) + 1 END / (2 * sqrt(ln(2)) * sqrt(2))), 6) + 0.0 AS width, {INIT} AS flags FROM p GROUP BY series_id)
{CLAMPED} w UNION ALL SELECT * FROM o""")
def peak_fits_by_moments(spark, sf_dir):
    found = fits.fit_all(correlogram_rows(spark, sf_dir), ("None", "fastgauss"), 1.0, (-MOST_LAG, MOST_LAG))
    return rounded(found)


@query(PEAK + f""", q AS (SELECT series_id, any_value(k) AS k, any_value(top) AS top, (sum(c) FILTER (abs(lag - k) = 1)) / 2 - any_value(top) AS a, ((sum(c) FILTER (lag = k + 1)) - (sum(c) FILTER (lag = k - 1))) / 2 AS b FROM e GROUP BY series_id),
x AS (SELECT *, CASE WHEN abs(a) < 1e-12 THEN 0 ELSE -b / (2 * a) END AS s FROM q),
m AS (SELECT series_id, sum(lag * c) / sum(c) AS lag, any_value(top) AS top FROM e WHERE lag BETWEEN greatest(k - 2, -{MOST_LAG - 1}) AND least(k + 2, {MOST_LAG - 1}) GROUP BY series_id),
w AS (SELECT series_id, 'fastquad' AS kind, k + s AS lag, top + b * s + a * s * s AS high, 1 / greatest(abs(a), 1e-12) AS wide, CASE WHEN top < 0 THEN 1 ELSE 0 END AS init FROM x
  UNION ALL SELECT series_id, 'COM', lag, greatest(top, 0), 10, CASE WHEN top < 0 THEN 1 ELSE 0 END FROM m)
{CLAMPED} w""")
def peak_fits_by_neighbours(spark, sf_dir):
    return rounded(fits.fit_all(correlogram_rows(spark, sf_dir), ("fastquad", "COM"), 1.0, (-MOST_LAG, MOST_LAG)))


@query(PEAK + ", " + extent("c > top - 0.05::DOUBLE") + f""", d AS (SELECT *, lag - avg(lag) OVER w AS u FROM p WINDOW w AS (PARTITION BY series_id)),
sq AS (SELECT *, u * u - avg(u * u) OVER w - sum(u * u * u) OVER w / sum(u * u) OVER w * u AS q FROM d WINDOW w AS (PARTITION BY series_id)),
t AS (SELECT series_id, avg(lag) AS mid, sum(c * q) / sum(q * q) AS a, sum(c * u) / sum(u * u) - sum(c * q) / sum(q * q) * sum(u * u * u) / sum(u * u) AS b, avg(c) - sum(c * q) / sum(q * q) * avg(u * u) AS e, {INIT} AS init
  FROM sq GROUP BY series_id),
w AS (SELECT series_id, 'quad' AS kind, CASE WHEN init % 8 >= 4 THEN 0 ELSE mid - b / (2 * a) END AS lag, CASE WHEN init % 8 >= 4 THEN 0 ELSE e - b * b / (4 * a) END AS high,
  CASE WHEN init % 8 >= 4 THEN 0 ELSE 1 / abs(a) END AS wide, init + CASE WHEN init % 8 >= 4 THEN 16384 ELSE 0 END AS init FROM t)
{CLAMPED} w""")
def peak_fits_by_parabola(spark, sf_dir):
    return rounded(fits.fit_all(correlogram_rows(spark, sf_dir), ("quad",), 1.0, (-MOST_LAG, MOST_LAG)))


@query()
def peak_fits_by_gaussian(spark, sf_dir):
    """Least-squares Gaussians; held against a fine grid search in tests."""
    return rounded(fits.fit_all(correlogram_rows(spark, sf_dir), ("gauss",), 1.0, (-MOST_LAG, MOST_LAG)))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS r FROM s GROUP BY t), c AS (SELECT series_id, corr(v, r) AS r FROM s JOIN g USING (t) GROUP BY series_id), m AS (SELECT avg(r) AS m FROM c),
z AS (SELECT series_id, r, (0.5::DOUBLE * ln((1 + r) / (1 - r)) - 0.5::DOUBLE * ln((1 + m) / (1 - m))) / sqrt(2.0::DOUBLE / 61) AS z FROM c, m)
SELECT series_id, round(z, 6) + 0.0 AS z, round(sqrt(2.0::DOUBLE / 61), 6) + 0.0 AS error,
  round(1 - 2 * sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-((abs(z) * i / 400) ** 2) / 2)) * any_value(abs(z)) / 1200 / sqrt(2 * pi()), 6) + 0.0 AS p
FROM z, range(401) q(i) GROUP BY series_id, z""")
def correlation_difference_test(spark, sf_dir):
    """Every series' correlation with the mean series against the average correlation: z, its error and two-sided p."""
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series))
    unit = lambda a: S.let(S.normalize(F.col(a), "z"), lambda z: F.transform(z, lambda x: x / F.sqrt(F.size(z).cast("double"))))
    r = both.select("series_id", F.size("values").alias("n"), S.dot(unit("values"), unit("ref")).alias("r"))
    rows = r.crossJoin(F.broadcast(r.agg(F.avg("r").alias("m"))))  # one row
    rows = rows.select("series_id", S.z_of_difference(F.col("r"), F.col("m"), F.col("n"), F.col("n")).alias("z"), S.difference_error(F.col("n"), F.col("n")).alias("error"))
    rows = rows.withColumn("_z", F.array(F.abs("z")))
    return rounded(rows.select("series_id", "z", "error", (2 * K.by_batch(lambda x: K.normal_tail(x[:, 0]), F.col("_z"), returns="double")).alias("p")))


@query(f"""
WITH {SAMPLES}, d AS (SELECT series_id, 0.2::DOUBLE * stddev_pop(v) AS r FROM s GROUP BY series_id),
w AS (SELECT *, lead(v, 1) OVER o AS v1, lead(v, 2) OVER o AS v2 FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)),
p AS (SELECT a.series_id, a.t, a.v1 IS NOT NULL AND b.v1 IS NOT NULL AND abs(a.v - b.v) <= r AND abs(a.v1 - b.v1) <= r AS c2, a.v2 IS NOT NULL AND b.v2 IS NOT NULL AND abs(a.v - b.v) <= r AND abs(a.v1 - b.v1) <= r AND abs(a.v2 - b.v2) <= r AS c3,
  a.v2 IS NOT NULL AS full3, a.v1 IS NOT NULL AS full2 FROM w a JOIN w b USING (series_id) JOIN d USING (series_id)),
q AS (SELECT series_id, t, CASE WHEN any_value(full2) THEN ln(count(*) FILTER (c2) / 63.0::DOUBLE) END AS l2, CASE WHEN any_value(full3) THEN ln(count(*) FILTER (c3) / 62.0::DOUBLE) END AS l3 FROM p GROUP BY 1, 2)
SELECT series_id, round(avg(l2) - avg(l3), 6) + 0.0 AS apen FROM q GROUP BY series_id""")
def approximate_entropies(spark, sf_dir):
    return rounded(embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.approximate_entropy(2, 0.2), F.col("values"), returns="double").alias("apen")))


@query(f"""
WITH {SAMPLES}, m AS (SELECT t, avg(v) AS x FROM s GROUP BY t), d AS (SELECT label, series_id, v, x - avg(x) OVER (PARTITION BY label) AS u, x FROM s JOIN m USING (t)),
q AS (SELECT *, u * u - avg(u * u) OVER w - sum(u * u * u) OVER w / sum(u * u) OVER w * u AS q FROM d WINDOW w AS (PARTITION BY label)),
f AS (SELECT label, avg(x) AS mx, sum(v * q) / sum(q * q) AS a, sum(v * u) / sum(u * u) AS l, sum(u * u * u) / sum(u * u) AS k, avg(v) AS mv, avg(u * u) AS m2, count(*) AS n,
  (sum(v * q) ** 2 / sum(q * q) + sum(v * u) ** 2 / sum(u * u)) / (var_pop(v) * count(*)) AS r2 FROM q GROUP BY label)
SELECT label, {rounds("mv - a * m2 - (l - a * k) * mx + a * mx * mx AS c0", "l - a * k - 2 * a * mx AS c1", "a AS c2", "r2")}, n FROM f""")
def region_polynomial_fits(spark, sf_dir):
    """Parabola of each region's samples over the mean series."""
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series))
    rows = both.select("label", F.explode(F.arrays_zip(F.col("values").alias("v"), F.col("ref").alias("x"))).alias("p")).select("label", "p.v", "p.x")
    return rounded(summaries.region_parabolas(rows, ["label"], "x", "v"))


@query(f"""
WITH {GRID}, o AS (SELECT abs(a) AS v, row_number() OVER (ORDER BY abs(a)) - 1 AS k, count(*) OVER () AS n FROM g), e AS (SELECT v AS edge FROM o WHERE k = least(round_even(0.8::DOUBLE * n, 0)::BIGINT, n - 1))
SELECT z, count(*) AS n, count(*) FILTER (abs(a) > edge) AS n_mask FROM g, e GROUP BY z""")
def percentile_mask_sizes(spark, sf_dir):
    found = masks.percentile_mask(grid_map(spark, sf_dir).select("z", first_value().alias("a")), "a", 0.8, two_sided=True)
    return found.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_mask").alias("n_mask"))


@query(f"""
WITH {SAMPLES}, k AS (SELECT series_id FROM s GROUP BY series_id HAVING stddev_pop(v) > 0.12::DOUBLE)
SELECT series_id, (t - 5)::INT AS t, round(v, 6) + 0.0 AS v FROM s SEMI JOIN k USING (series_id) WHERE t BETWEEN 5 AND 60""")
def valid_series_trimmed(spark, sf_dir):
    kept = masks.valid_series(embedding_series(spark, sf_dir), 0.12)
    return rounded(to_samples(masks.between_times(kept, 5, 60).select("series_id", "values")))


@query(f"""WITH {GRID} SELECT series_id, x, y, z, round(CASE WHEN a > 0.1::DOUBLE THEN a ELSE 0 END, 6) + 0.0 AS a FROM g""")
def map_scattered(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("series_id", "x", "y", "z", first_value().alias("a"))
    return rounded(masks.scatter(cells.drop("a"), cells.where("a > 0.1"), "series_id", "a"))


@query(f"""
WITH {GRID}, c AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, count(*) AS n, count(*) FILTER (a > 0) AS n_mask FROM g GROUP BY 1, 2, 3)
SELECT x::INT AS x, y::INT AS y, z::INT AS z, n, n_mask FROM c WHERE n_mask >= 0.5::DOUBLE * n""")
def mask_resampled(spark, sf_dir):
    cells = grid_map(spark, sf_dir).select("x", "y", "z", first_value().alias("a"))
    return masks.coarser(cells.where("a > 0"), cells, 2)


@query(f"""
WITH {GRID} SELECT e.label, min(x) - 1 AS x_low, max(x) + 1 AS x_high, min(y) - 1 AS y_low, max(y) + 1 AS y_high, (min(z) - 1)::INT AS z_low, (max(z) + 1)::INT AS z_high, count(*) AS n
FROM g JOIN embeddings e ON e.vec_id = g.series_id WHERE a > 0 GROUP BY e.label""")
def region_bounding_boxes(spark, sf_dir):
    return masks.bounding_box(grid_map(spark, sf_dir).where(first_value() > 0), 1, ("label",))


CLUSTERS = f"""
WITH RECURSIVE {GRID}, k AS (SELECT * FROM g WHERE a > 0.05::DOUBLE), e AS (SELECT p.series_id AS i, q.series_id AS j FROM k p JOIN k q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
c AS (SELECT series_id AS i, series_id AS j FROM k UNION SELECT c.i, e.j FROM c JOIN e ON e.i = c.j), m AS (SELECT i AS series_id, min(j) AS component FROM c GROUP BY i)"""


@query(CLUSTERS + """, n AS (SELECT component, count(*) AS size FROM m GROUP BY component HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS cluster FROM n)
SELECT series_id, size, cluster FROM m JOIN r USING (component)""")
def clusters_by_size(spark, sf_dir):
    cells = grid_map(spark, sf_dir).where(first_value() > 0.05).select("series_id", "x", "y", "z")
    return masks.clusters(cells, "series_id", 3).select("series_id", "size", "cluster")


@query(CLUSTERS + """ SELECT series_id FROM m WHERE component IN (SELECT component FROM m JOIN embeddings ON vec_id = series_id WHERE embedding[1] > 0.3)""")
def region_grown(spark, sf_dir):
    cells = grid_map(spark, sf_dir).where(first_value() > 0.05).select("series_id", "x", "y", "z", first_value().alias("a"))
    return masks.grown(cells, "series_id", F.col("a") > F.lit(0.3).cast("float").cast("double")).select("series_id")


@query(f"""
WITH {GRID}, q AS (SELECT z, unnest(range(0, len(embedding)))::INT AS t, unnest(embedding)::DOUBLE AS v, 1 + abs(a) AS w FROM g) SELECT z, t, round(sum(w * v) / sum(w), 6) + 0.0 AS v FROM q GROUP BY 1, 2""")
def slice_timecourses(spark, sf_dir):
    return rounded(masks.slice_means(grid_map(spark, sf_dir), "z", 1 + F.abs(first_value())))


@query(f"""
WITH RECURSIVE {GRID}, n AS (SELECT p.series_id, arg_max(q.series_id, struct_pack(a := q.a, i := -q.series_id)) AS up FROM g p JOIN g q
  ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) <= 1 GROUP BY p.series_id),
r AS (SELECT series_id, up FROM n UNION SELECT r.series_id, n.up FROM r JOIN n ON n.series_id = r.up)
SELECT series_id, up AS territory FROM r JOIN n t ON t.series_id = r.up AND t.up = r.up""".replace("SELECT series_id, up AS territory FROM r JOIN n t ON t.series_id = r.up AND t.up = r.up", "SELECT r.series_id, r.up AS territory FROM r JOIN n t ON t.series_id = r.up AND t.up = r.up"))
def steepest_territories(spark, sf_dir):
    """The local maximum to which steepest ascent over face neighbours leads from every cell."""
    cells = grid_map(spark, sf_dir).select("series_id", "x", "y", "z", first_value().alias("a"))
    best = F.max(F.struct(F.col("n_a"), (-F.col("n_series_id")).alias("neg")))
    up = grids.neighbors(cells, 1.0, center=True).groupBy("series_id").agg(best.alias("m"))
    return roots(up.select(F.col("series_id").alias("id"), (-F.col("m.neg")).alias("parent"))).toDF("series_id", "territory")


@query(f"""
WITH {SAMPLES}, z AS (SELECT series_id, t, (v - avg(v) OVER w) / (stddev_pop(v) OVER w) AS v FROM s WINDOW w AS (PARTITION BY series_id)),
c AS (SELECT p.series_id, p.t - q.t AS lag, sum(p.v * q.v) / 64 AS c FROM z p JOIN z q ON q.series_id = p.series_id AND p.t - q.t BETWEEN 0 AND 16 GROUP BY 1, 2),
n AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS q FROM c WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
k AS (SELECT series_id, lag, c, row_number() OVER (PARTITION BY series_id ORDER BY round(c, 9) DESC, lag) AS rank FROM n WHERE lag BETWEEN 1 AND 15 AND c > p AND c >= q AND c >= 0.1::DOUBLE)
SELECT series_id, rank::INT AS rank, lag::INT AS lag, round(c, 6) + 0.0 AS amp FROM k WHERE rank <= 3""")
def autocorrelation_sidelobes(spark, sf_dir):
    return rounded(lags.sidelobes(embedding_series(spark, sf_dir), 16, 0.1, 3))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS a FROM s GROUP BY t), h AS (SELECT t, a, CASE WHEN lag(a) OVER w IS NULL THEN lead(a) OVER w - a WHEN lead(a) OVER w IS NULL THEN a - lag(a) OVER w ELSE (lead(a) OVER w - lag(a) OVER w) / 2 END AS b FROM g WINDOW w AS (ORDER BY t)),
c AS (SELECT t, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b, avg(a) OVER () AS ma, avg(b) OVER () AS mb FROM h),
y AS (SELECT series_id, avg(v) AS my, sum(v * a) AS ay, sum(v * b) AS by_, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, var_pop(v) * count(*) AS yy, any_value(ma) AS ma, any_value(mb) AS mb FROM s JOIN c USING (t) GROUP BY series_id),
f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS fa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS fb FROM y)
SELECT series_id, {rounds("my - fa * ma - fb * mb AS intercept", "fa AS slope", "fb AS slope_deriv", "fb / fa AS ratio", "(fa * ay + fb * by_) / yy AS r2")} FROM f""")
def derivative_regression(spark, sf_dir):
    """Every series on the mean series and its gradient: the ratio of the slopes tells of a small delay."""
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series).withColumn("deriv", S.gradient(F.col("ref"))))
    f = S.two_regressors(F.col("values"), F.col("ref"), F.col("deriv"))
    rows = both.select("series_id", f.alias("f"))
    ratio = F.when(F.col("f.slope_a") != 0, F.col("f.slope_b") / F.col("f.slope_a"))
    return rounded(rows.select("series_id", F.col("f.intercept").alias("intercept"), F.col("f.slope_a").alias("slope"), F.col("f.slope_b").alias("slope_deriv"), ratio.alias("ratio"), F.col("f.r2").alias("r2")))


@query(f"""
WITH {SAMPLES}, d AS (SELECT series_id, k, sum(v * cos(2 * pi() * k * t / 64)) AS re, -sum(v * sin(2 * pi() * k * t / 64)) AS im FROM s, range(33) q(k) GROUP BY 1, 2)
SELECT series_id, m::INT AS t, round(sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * ln(greatest(sqrt(re * re + im * im), 1e-300)) * cos(2 * pi() * k * m / 64)) / 64, 6) + 0.0 AS v FROM d, range(64) z(m) GROUP BY 1, 2""")
def real_cepstra(spark, sf_dir):
    return rounded(to_samples(embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.real_cepstrum, F.col("values")).alias("values"))))


@query(f"""WITH {SAMPLES} SELECT series_id, t, round(v, 6) + 0.0 AS v FROM s""")
def polar_round_trip(spark, sf_dir):
    """Series to magnitudes and phases and back."""
    rows = embedding_series(spark, sf_dir).select("series_id", K.by_batch(K.polar_spectrum, F.col("values")).alias("polar"))
    return rounded(to_samples(rows.select("series_id", K.by_batch(K.from_polar, F.col("polar")).alias("values"))))


@query(f"""
WITH {TWO_MAPS}, x AS (SELECT series_id, i::INT AS i, i - 8 AS x, 1 + abs(a) AS h, 2 + abs(b) AS w FROM m, range(32) q(i))
SELECT series_id, i, {rounds("CASE WHEN x > 0 THEN h * (1 - exp(-x / w)) ELSE 0 END AS rise",
    "CASE WHEN x < 0 THEN 0 WHEN x < 6 THEN (CASE WHEN x > 0 THEN h * (1 - exp(-x / w)) ELSE 0 END) ELSE h * (1 - exp(-6 / w)) * exp(-(x - 6) / 3.0::DOUBLE) END AS trapezoid",
    "0.5::DOUBLE + h * CASE WHEN x = 0 THEN 1 ELSE sin(x * 3.790988::DOUBLE / w) / (x * 3.790988::DOUBLE / w) END AS sinc", "h * exp(-((x / w) ** 2) / 2) AS gauss", "h * cos(x + 0.1::DOUBLE) + 0.5::DOUBLE * cos(2 * x + 0.2::DOUBLE) AS harmonic")} FROM x""")
def model_curves(spark, sf_dir):
    m = two_maps(spark, sf_dir).select("series_id", (1 + F.abs("a")).alias("h"), (2 + F.abs("b")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    x, h, w, zero = (F.col("i") - 8).cast("double"), F.col("h"), F.col("w"), F.lit(0.0)
    harmonic = h * F.cos(x + 0.1) + S.harmonics(x, [0.0, 0.5], [0.0, 0.2])
    return rounded(m.select("series_id", "i", S.rise(x, zero, h, w).alias("rise"), S.trapezoid(x, zero, h, w, F.lit(3.0), F.lit(6.0)).alias("trapezoid"),
                            S.sinc_curve(x, h, zero, w, F.lit(0.5)).alias("sinc"), S.gauss_curve(x, h, zero, w).alias("gauss"), harmonic.alias("harmonic")))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS r FROM s GROUP BY t), w AS (SELECT series_id, 8 * i AS start, t - 8 * i AS j, v FROM s, range(7) z(i) WHERE t BETWEEN 8 * i AND 8 * i + 15),
h AS (SELECT 8 * i AS start, t - 8 * i AS j, r FROM g, range(7) z(i) WHERE t BETWEEN 8 * i AND 8 * i + 15),
zw AS (SELECT series_id, start, j, (v - avg(v) OVER o) / stddev_pop(v) OVER o AS v FROM w WINDOW o AS (PARTITION BY series_id, start)), zh AS (SELECT start, j, (r - avg(r) OVER o) / stddev_pop(r) OVER o AS r FROM h WINDOW o AS (PARTITION BY start)),
c AS (SELECT series_id, zw.start, zw.j - zh.j AS lag, sum(v * r) / 16 AS c FROM zw JOIN zh ON zw.start = zh.start AND abs(zw.j - zh.j) <= 4 GROUP BY 1, 2, 3)
SELECT series_id, start::INT AS start, arg_max(lag, round(c, 9) - lag * 1e-12)::INT AS lag, round(max(c), 6) + 0.0 AS strength FROM c GROUP BY 1, 2""")
def windowed_lags(spark, sf_dir):
    """Best lag of every window of 16 samples against the mean series' window."""
    series = embedding_series(spark, sf_dir)
    return rounded(lags.windowed_lags(series, lags.reference_series(series), 16, 8, 4))


@query(f"""
WITH {SAMPLES}, q AS (SELECT series_id, t // 8 AS w, sqrt(avg(v * v)) AS r FROM s GROUP BY 1, 2), f AS (SELECT series_id, regr_slope(r, w * 8 + 3.5::DOUBLE) AS b, regr_intercept(r, w * 8 + 3.5::DOUBLE) AS a FROM q GROUP BY series_id)
SELECT series_id, {rounds("a AS amp_start", "a + b * 63 AS amp_end", "b AS rate", "100 * (a + b * 63 - a) / a AS percent")} FROM f""")
def noise_amplitude_trend(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", F.size("values").alias("n"), F.posexplode("values").alias("t", "v"))
    rms = rows.groupBy("series_id", "n", F.floor(F.col("t") / 8).alias("w")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("r"))
    line = rms.groupBy("series_id", "n").agg(F.regr_slope("r", F.col("w") * 8 + 3.5).alias("rate"), F.regr_intercept("r", F.col("w") * 8 + 3.5).alias("amp_start"))
    end = F.col("amp_start") + F.col("rate") * (F.col("n") - 1)
    return rounded(line.select("series_id", "amp_start", end.alias("amp_end"), "rate", (100 * (end - F.col("amp_start")) / F.col("amp_start")).alias("percent")))


@query(f"""
WITH {SAMPLES}, n AS (SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS q FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)), k AS (SELECT series_id, t FROM n WHERE v > p AND v >= q),
d AS (SELECT series_id, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS d FROM k), m AS (SELECT series_id, median(d) AS med FROM d GROUP BY series_id)
SELECT series_id, count(d) AS n, {rounds("60 / avg(d) AS rate", "stddev_pop(d) AS spread")} FROM d JOIN m USING (series_id) WHERE d BETWEEN 0.7::DOUBLE * med AND 1.3::DOUBLE * med GROUP BY series_id""")
def peak_interval_rates(spark, sf_dir):
    """Rate from the intervals between peaks, those off the median by more than 30 % left out."""
    rows = embedding_series(spark, sf_dir).select("series_id", waves.peak_intervals(F.col("values"), 0.3).alias("r"))
    return rounded(rows.where("r.n > 0").select("series_id", F.col("r.n").alias("n"), (60 / F.col("r.mean")).alias("rate"), F.col("r.spread").alias("spread")))


@query(f"""
WITH {TWO_MAPS} SELECT series_id, round(sum(CASE WHEN 2 + a * 10 + i * 0.1::DOUBLE >= 1.5::DOUBLE THEN abs(b) * exp(-(2 + a * 10 + i * 0.1::DOUBLE) / 1.65::DOUBLE) ELSE 0 END), 6) + 0.0 AS asl FROM m, range(50) q(i) GROUP BY series_id""")
def decayed_signal(spark, sf_dir):
    """Sum over 50 image times of a labelled signal's decay, from lag and strength maps."""
    at = lambda i: F.lit(2.0) + F.col("a") * 10 + i * 0.1
    terms = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.when(at(i) >= 1.5, F.abs("b") * F.exp(-at(i) / 1.65)).otherwise(F.lit(0.0)))
    return rounded(two_maps(spark, sf_dir).select("series_id", S.total(terms).alias("asl")))


@query(f"""
WITH {GRID}, k AS (SELECT p.series_id, p.a, xn.a AS xn, xp.a AS xp, yn.a AS yn, yp.a AS yp, zn.a AS zn, zp.a AS zp FROM g p
  LEFT JOIN g xn ON xn.x = p.x + 1 AND xn.y = p.y AND xn.z = p.z LEFT JOIN g xp ON xp.x = p.x - 1 AND xp.y = p.y AND xp.z = p.z
  LEFT JOIN g yn ON yn.y = p.y + 1 AND yn.x = p.x AND yn.z = p.z LEFT JOIN g yp ON yp.y = p.y - 1 AND yp.x = p.x AND yp.z = p.z
  LEFT JOIN g zn ON zn.z = p.z + 1 AND zn.x = p.x AND zn.y = p.y LEFT JOIN g zp ON zp.z = p.z - 1 AND zp.x = p.x AND zp.y = p.y)
SELECT series_id, {rounds("(xn - a) + (a - xp) AS flow_x", "(yn - a) + (a - yp) AS flow_y", "(zn - a) + (a - zp) AS flow_z", "xn + xp + yn + yp + zn + zp - 6 * a AS laplacian")} FROM k""")
def neighbour_flows(spark, sf_dir):
    """Forward plus backward differences on each axis, and the Laplacian, of cells with both neighbours."""
    cells = grid_map(spark, sf_dir).select("series_id", "x", "y", "z", first_value().alias("a"))
    near = grids.neighbors(cells, 1.0)
    step = lambda ax: F.sum(F.when(F.col(f"n_{ax}") > F.col(ax), F.col("n_a")).when(F.col(f"n_{ax}") < F.col(ax), -F.col("n_a")))
    both = lambda ax: F.count(F.when(F.col(f"n_{ax}") != F.col(ax), 1)) == 2
    rows = near.groupBy("series_id", "a").agg(*(F.when(both(ax), step(ax)).alias(f"flow_{ax}") for ax in ("x", "y", "z")), F.when(F.count(F.lit(1)) == 6, F.sum("n_a") - 6 * F.col("a")).alias("laplacian"))
    lone = cells.join(rows.select("series_id"), "series_id", "left_anti").select("series_id", *(F.lit(None).cast("double").alias(c) for c in ("flow_x", "flow_y", "flow_z", "laplacian")))
    return rounded(rows.drop("a").unionByName(lone))


@query(f"""
WITH {TWO_MAPS} SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (a < 0.05::DOUBLE) / count(*), 6) + 0.0 AS percentile FROM m GROUP BY label""")
def percentile_of_location(spark, sf_dir):
    return rounded(two_maps(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("a") < 0.05) / F.count(F.lit(1))).alias("percentile")))


@query(f"""
WITH {TWO_MAPS}, s AS (SELECT min(a) AS lo, max(a) AS hi FROM m), h AS (SELECT least(floor((a - lo) / ((hi - lo) / 51)), 50)::INT AS bin, count(*) AS n FROM m, s GROUP BY 1),
p AS (SELECT lo + (arg_max(bin, n - bin * 1e-6) + 0.5::DOUBLE) * (hi - lo) / 51 AS loc FROM h, s WHERE bin BETWEEN 1 AND 48 GROUP BY lo, hi)
SELECT series_id, round(a - loc, 6) + 0.0 AS a FROM m, p""")
def offset_adjusted_map(spark, sf_dir):
    """A map less the location of its histogram's peak."""
    m = two_maps(spark, sf_dir).select("series_id", "a")
    peak = quantiles.histogram_peak(quantiles.histogram(m, "a", 51), 51).select("loc")
    return rounded(m.crossJoin(F.broadcast(peak)).select("series_id", (F.col("a") - F.col("loc")).alias("a")))  # one row
