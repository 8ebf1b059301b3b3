"""Registered queries of the series operators over the given tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators import frames, grids, lags, quantiles, summaries
from lagmill.sources.tables import embedding_series, on_grid, table, to_samples, to_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Samples of the embeddings table, the start of most oracle queries.
SAMPLES = """s AS (
  SELECT vec_id AS series_id, label, unnest(range(0, len(embedding)))::INT AS t, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
MOST_LAG = 10


def query(sql: str | None = None):
    """Register a function as a query, with its oracle."""

    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name) if name else F.round(c, 6) + 0.0


def rounded(df: DataFrame) -> DataFrame:
    """df with its doubles rounded to 6 digits."""
    return df.select(*(r6(c, c) if t == "double" else F.col(c) for c, t in df.dtypes))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(embedding_series(spark, sf_dir))


def two_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series its region and two values of it, as two maps over the series: a and b."""
    s = embedding_series(spark, sf_dir)
    return s.select("series_id", "label", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


TWO_MAPS = "m AS (SELECT vec_id AS series_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"


def rounds(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


# Summaries


@query(f"""
WITH {SAMPLES}, a AS (SELECT series_id, avg(v) AS m, median(v) AS med, min(v) AS v_min, max(v) AS v_max FROM s GROUP BY series_id),
b AS (SELECT series_id, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4, median(abs(v - med)) AS md
      FROM s JOIN a USING (series_id) GROUP BY series_id)
SELECT series_id, {rounds("v_min", "v_max", "m AS v_mean", "sqrt(m2) AS v_std", "med AS v_median", "md / 0.6744897501960817 AS v_mad",
                          "m3 / m2 ** 1.5 AS v_skew", "m4 / m2 ** 2 - 3 AS v_kurt")} FROM a JOIN b USING (series_id)""")
def series_stats(spark, sf_dir):
    return rounded(summaries.series_stats(embedding_series(spark, sf_dir)))


@query(f"""
WITH {SAMPLES}, a AS (SELECT series_id, avg(v) AS m, var_pop(v) AS var, median(v) AS med, max(v) - min(v) AS pp FROM s GROUP BY series_id),
b AS (SELECT series_id, median(abs(v - med)) / 0.6744897501960817 AS md FROM s JOIN a USING (series_id) GROUP BY series_id)
SELECT series_id, t, {rounds("v - m AS n_none", "(CASE WHEN m > 0 THEN v / m - 1 ELSE v END) AS n_percent",
    "(CASE WHEN var > 0 THEN (v - m) / var ELSE v - m END) AS n_variance", "(CASE WHEN var > 0 THEN (v - m) / sqrt(var) ELSE v - m END) AS n_z",
    "(CASE WHEN pp > 0 THEN (v - m) / pp ELSE v - m END) AS n_p2p", "(CASE WHEN md > 0 THEN (v - med) / md ELSE v - med END) AS n_mad")}
FROM s JOIN a USING (series_id) JOIN b USING (series_id)""")
def normalized_series(spark, sf_dir):
    v = F.col("values")
    kinds = {"n_none": "None", "n_percent": "percent", "n_variance": "variance", "n_z": "z", "n_p2p": "p2p", "n_mad": "mad"}
    rows = embedding_series(spark, sf_dir).select("series_id", *(S.normalize(v, m).alias(k) for k, m in kinds.items()))
    rows = rows.select("series_id", F.posexplode(F.arrays_zip(*kinds)).alias("t", "n")).select("series_id", "t", "n.*")
    return rounded(rows)


@query(f"""
WITH {SAMPLES}, a AS (SELECT series_id, median(v) AS med FROM s GROUP BY series_id),
b AS (SELECT series_id, median(abs(v - med)) / 0.6744897501960817 AS md FROM s JOIN a USING (series_id) GROUP BY series_id)
SELECT series_id, t, {rounds("(CASE WHEN abs(v - med) > 2.0 * md THEN med ELSE v END) AS v")} FROM s JOIN a USING (series_id) JOIN b USING (series_id)""")
def outliers_removed(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", S.remove_outliers(F.col("values"), 2.0, zero=False).alias("values"))
    return rounded(to_samples(rows))


@query(f"""
WITH {SAMPLES}, o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM s),
f AS (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98])::DOUBLE AS fraction)
SELECT round(fraction, 6) + 0.0 AS fraction, round(v, 6) + 0.0 AS v FROM f JOIN o ON k = least(round_even(fraction * n, 0)::BIGINT, n - 1)""")
def fracvals_nearest_rank(spark, sf_dir):
    return rounded(quantiles.nearest_rank(samples(spark, sf_dir), [], "v", [0.02, 0.25, 0.5, 0.75, 0.98]))


HIST = f"""
WITH {SAMPLES}, span AS (SELECT min(v) AS lo, (max(v) - min(v)) / 101 AS w FROM s),
c AS (SELECT least(floor((v - lo) / w), 100)::INT AS bin, count(*) AS n FROM s, span GROUP BY 1),
h AS (SELECT b.bin, lo + b.bin * w AS low, w AS width, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 101))::INT AS bin) b CROSS JOIN span LEFT JOIN c USING (bin))"""


@query(HIST + ' SELECT bin, round(low, 6) + 0.0 AS low, round(width, 6) + 0.0 AS width, n AS "count" FROM h')
def histogram_bins(spark, sf_dir):
    return rounded(quantiles.histogram(samples(spark, sf_dir), "v", 101))


@query(HIST + f""", top AS (SELECT bin, n, low + width / 2 AS x FROM h WHERE bin BETWEEN 1 AND 98 ORDER BY n DESC, bin LIMIT 1),
fall AS (SELECT min(h.bin) AS b FROM h, top WHERE h.bin > top.bin AND (h.bin >= 100 OR h.n <= top.n / 2.0))
SELECT {rounds("top.n::DOUBLE AS height", "x AS loc", "2 * ((SELECT low + width / 2 FROM h, fall WHERE h.bin = fall.b) - x) AS width",
               "(SELECT sum((low + width / 2) * n) / sum(n) FROM h) AS center_of_mass")} FROM top""")
def histogram_peak(spark, sf_dir):
    return rounded(quantiles.histogram_peak(quantiles.histogram(samples(spark, sf_dir), "v", 101), 101))


@query("""SELECT p_partkey, round(100.0::DOUBLE * (dense_rank() OVER (ORDER BY p_retailprice) - 1) / (count(*) OVER () - 1), 6) + 0.0 AS percentile FROM part""")
def percentile_rank_dense(spark, sf_dir):
    ranked = quantiles.percentile_rank(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "percentile")
    return rounded(ranked.select("p_partkey", "percentile"))


@query(f"""
WITH {TWO_MAPS}, o AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS k, count(*) OVER () AS n FROM m),
p AS (SELECT min(a) FILTER (k = least(round_even(0.02::DOUBLE * n, 0)::BIGINT, n - 1)) AS p2, min(a) FILTER (k = least(round_even(0.98::DOUBLE * n, 0)::BIGINT, n - 1)) AS p98 FROM o)
SELECT label, count(*) AS n, count(*) FILTER (a > p2 + 0.25 * (p98 - p2)) AS n_mask FROM m, p GROUP BY label""")
def threshold_mask(spark, sf_dir):
    maps = two_maps(spark, sf_dir)
    found = quantiles.nearest_rank(maps, [], "a", [0.02, 0.98])
    edge = found.agg((F.min("a") + 0.25 * (F.max("a") - F.min("a"))).alias("edge"))
    return maps.crossJoin(F.broadcast(edge)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("edge")).alias("n_mask"))


@query(f"""
WITH {SAMPLES}, b AS (SELECT label, t, avg(v) AS m, sum(v) AS sm, stddev_pop(v) AS sd, median(v) AS med FROM s GROUP BY label, t),
d AS (SELECT label, t, median(abs(v - med)) / 0.6744897501960817 AS md FROM s JOIN b USING (label, t) GROUP BY label, t)
SELECT label, t, {rounds("m AS v_mean", "sm AS v_sum", "sd AS v_std", "med AS v_median", "md AS v_mad")}, round(CASE WHEN m <> 0 THEN 100.0 * sd / m ELSE 0 END, 4) + 0.0 AS v_cov
FROM b JOIN d USING (label, t)""")
def atlas_timecourses(spark, sf_dir):
    rows = summaries.region_timecourses(samples(spark, sf_dir))
    return rounded(rows.withColumn("v_cov", (F.round("v_cov", 4) + 0.0).cast("double")))


@query(f"""
WITH {TWO_MAPS}, span AS (SELECT min(a) AS lo, max(a) AS hi FROM m), b AS (SELECT label, avg(a) AS mu, stddev_pop(a) AS sd, median(a) AS med, count(*) AS n FROM m GROUP BY label),
c AS (SELECT label, median(abs(a - med)) / 0.6744897501960817 AS md, avg((a - mu) ** 2) AS m2, avg((a - mu) ** 3) AS m3, avg((a - mu) ** 4) AS m4 FROM m JOIN b USING (label) GROUP BY label),
h AS (SELECT label, least(floor((a - lo) / (hi - lo) * 101), 100) AS bin, count(*) AS c FROM m, span GROUP BY 1, 2),
e AS (SELECT label, -sum(c / n::DOUBLE * ln(c / n::DOUBLE)) AS entropy FROM h JOIN b USING (label) GROUP BY label)
SELECT label, {rounds("mu AS v_mean", "sd AS v_std", "med AS v_median", "md AS v_mad", "m2 AS moment2", "m3 AS moment3", "m4 AS moment4", "entropy")}
FROM b JOIN c USING (label) JOIN e USING (label)""")
def territory_moments(spark, sf_dir):
    return rounded(summaries.region_moments(two_maps(spark, sf_dir).select("label", F.col("a").alias("v"))))


@query(f"""WITH {TWO_MAPS} SELECT label, {rounds("regr_slope(b, a) AS slope", "regr_intercept(b, a) AS intercept", "regr_r2(b, a) AS r2")}, count(*) AS n FROM m GROUP BY label""")
def territory_linear_fit(spark, sf_dir):
    return rounded(summaries.line_fits(two_maps(spark, sf_dir), ["label"], "a", "b"))


@query(f"""
WITH {SAMPLES}, p AS (SELECT series_id, avg(v) AS template FROM s GROUP BY series_id)
SELECT t, {rounds("regr_slope(v, template) AS slope", "regr_intercept(v, template) AS intercept", "regr_r2(v, template) AS r2")}, count(*) AS n FROM s JOIN p USING (series_id) GROUP BY t""")
def spatial_fit(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select(S.mean(F.col("values")).alias("template"), "values")
    return rounded(summaries.line_fits(to_samples(rows), ["t"], "template", "v"))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS r FROM s GROUP BY t)
SELECT series_id, {rounds("regr_slope(v, r) AS slope", "regr_intercept(v, r) AS intercept", "regr_r2(v, r) AS r2", "corr(v, r) AS r")} FROM s JOIN g USING (t) GROUP BY series_id""")
def global_signal_regression(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    rows = lags.with_reference(series, lags.reference_series(series))
    return rounded(lags.regress_out(rows, "ref").select("series_id", "slope", "intercept", "r2", "r"))


@query(f"""
WITH {TWO_MAPS}, d AS (SELECT label, b - a AS d, CASE WHEN a <> 0 THEN (b - a) / a ELSE 0 END AS r FROM m)
SELECT label, {rounds("min(d) AS mindiff", "max(d) AS maxdiff", "avg(d) AS meandiff", "avg(d * d) AS msdiff", "min(r) AS minreldiff", "max(r) AS maxreldiff", "avg(r) AS meanreldiff")} FROM d GROUP BY label""")
def map_compare(spark, sf_dir):
    return rounded(summaries.compare_maps(two_maps(spark, sf_dir), ["label"], "a", "b").drop("msreldiff"))


@query(f"""
WITH {TWO_MAPS}, d AS (SELECT label, avg(a - b) AS bias, stddev_pop(a - b) AS sd FROM m GROUP BY label)
SELECT label, {rounds("bias", "sd", "bias - 1.96 * sd AS low", "bias + 1.96 * sd AS high")} FROM d""")
def bland_altman(spark, sf_dir):
    return rounded(summaries.bland_altman(two_maps(spark, sf_dir), ["label"], "a", "b"))


@query(f"""
WITH {SAMPLES}, y AS (SELECT * FROM s), g AS (SELECT label, avg(v) AS m, count(*) AS n, count(DISTINCT series_id) AS ns, count(DISTINCT t) AS k FROM y GROUP BY label),
tt AS (SELECT label, sum((v - m) ** 2) AS sst FROM y JOIN g USING (label) GROUP BY label),
r AS (SELECT label, sum(k * (u - m) ** 2) AS ssr FROM (SELECT label, series_id, avg(v) AS u FROM y GROUP BY 1, 2) JOIN g USING (label) GROUP BY label),
c AS (SELECT label, sum(ns * (u - m) ** 2) AS ssc FROM (SELECT label, t, avg(v) AS u FROM y GROUP BY 1, 2) JOIN g USING (label) GROUP BY label),
z AS (SELECT label, (sst - ssr - ssc) / ((ns - 1) * (k - 1)) AS mse, ssr / (ns - 1) AS msr, ssc / (k - 1) / ns AS msc, k FROM g JOIN tt USING (label) JOIN r USING (label) JOIN c USING (label))
SELECT label, {rounds("coalesce((msr - mse) / (msr + (k - 1) * mse), 0) AS icc", "(msr - mse) / k AS r_var", "mse AS e_var", "msc / mse AS session_f")} FROM z""")
def icc_repeated_measures(spark, sf_dir):
    return rounded(summaries.icc(samples(spark, sf_dir), ["label"], "series_id", "t", "v"))


@query(f"""
WITH {TWO_MAPS}, g AS (SELECT label, min(a) AS alo, max(a) AS ahi, min(b) AS blo, max(b) AS bhi, count(*) AS n FROM m GROUP BY label),
j AS (SELECT label, n, least(floor((a - alo) / (ahi - alo) * 10), 9) AS x, least(floor((b - blo) / (bhi - blo) * 10), 9) AS y, count(*) AS c FROM m JOIN g USING (label) GROUP BY ALL),
p AS (SELECT *, sum(c) OVER (PARTITION BY label, x) AS cx, sum(c) OVER (PARTITION BY label, y) AS cy FROM j)
SELECT label, {rounds("sum(c / n::DOUBLE * ln(c * n::DOUBLE / (cx * cy))) AS mi")} FROM p GROUP BY label""")
def joint_histogram_mi(spark, sf_dir):
    return rounded(summaries.mutual_information(two_maps(spark, sf_dir), ["label"], "a", "b", 10))


@query(f"""
WITH {TWO_MAPS}, x AS (SELECT 'all' AS mask, a FROM m UNION ALL SELECT 'even', a FROM m WHERE label % 2 = 0 UNION ALL SELECT 'positive', a FROM m WHERE b > 0),
g AS (SELECT mask, avg(a) AS mu, stddev_pop(a) AS sd, median(a) AS med, count(*) AS n FROM x GROUP BY mask),
d AS (SELECT mask, median(abs(a - med)) / 0.6744897501960817 AS md FROM x JOIN g USING (mask) GROUP BY mask)
SELECT mask, {rounds("mu AS v_mean", "sd AS v_std", "med AS v_median", "md AS v_mad")}, n FROM g JOIN d USING (mask)""")
def mask_statistics(spark, sf_dir):
    maps = two_maps(spark, sf_dir).select("a", F.lit(True).alias("all"), (F.col("label") % 2 == 0).alias("even"), (F.col("b") > 0).alias("positive"))
    return rounded(summaries.mask_values(maps, ["all", "even", "positive"], "a"))


@query(f"""
WITH {TWO_MAPS} SELECT label, count(*) FILTER (a > 0 OR b > 0) AS n_union, count(*) FILTER (a > 0 AND b > 0) AS n_intersect, count(*) FILTER (a > 0 AND NOT b > 0) AS n_except FROM m GROUP BY label""")
def mask_union_intersect_except(spark, sf_dir):
    maps = two_maps(spark, sf_dir)
    a, b = maps.where("a > 0").select("series_id", "label"), maps.where("b > 0").select("series_id", "label")
    sets = {"n_union": a.union(b).distinct(), "n_intersect": a.join(b, "series_id", "left_semi"), "n_except": a.join(b, "series_id", "left_anti")}
    out = maps.select("label").distinct()
    for name, df in sets.items():
        out = out.join(df.groupBy("label").agg(F.count(F.lit(1)).alias(name)), "label", "left")
    return out.na.fill(0)


@query(f"""
WITH {SAMPLES}, h AS (SELECT series_id, label, corr(v, w) AS r, count(*) AS n FROM (SELECT *, lead(v) OVER (PARTITION BY series_id ORDER BY t) AS w FROM s) WHERE w IS NOT NULL GROUP BY ALL)
SELECT series_id, {rounds("r", "0.5 * ln((1 + r) / (1 - r)) AS fisher_z", "r * sqrt(n / (1 - r * r)) AS t_value", "r * sqrt(n - 3) AS z_value", "(0.5 * ln((1 + r) / (1 - r))) / sqrt(2.0 / (n - 3)) AS z_from_zero")} FROM h""")
def correlation_significance(spark, sf_dir):
    """Correlation of each series with itself one step later, and what that is worth."""
    v = F.col("values")
    n = F.size(v)
    rows = embedding_series(spark, sf_dir).select("series_id", F.slice(v, 2, n - 1).alias("values"), F.slice(v, 1, n - 1).alias("regressor"))
    rows = lags.regress_out(rows).select("series_id", "r", (F.size("values")).cast("double").alias("n"))
    return rounded(rows.select(
        "series_id", "r", S.fisher(F.col("r")).alias("fisher_z"), S.t_of_r(F.col("r"), F.col("n")).alias("t_value"), S.z_of_r(F.col("r"), F.col("n")).alias("z_value"),
        (S.fisher(F.col("r")) / F.sqrt(2.0 / (F.col("n") - 3))).alias("z_from_zero"),
    ))


# Frames


@query(f"""
WITH {SAMPLES} SELECT series_id, t, round(CASE WHEN avg(v) OVER (PARTITION BY series_id) > 0
  THEN stddev_pop(v) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + avg(v) OVER (PARTITION BY series_id) ELSE v END, 6) + 0.0 AS variability FROM s""")
def rolling_variability(spark, sf_dir):
    return rounded(frames.variability(samples(spark, sf_dir).drop("label"), 5).drop("v"))


@query(f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS r FROM s GROUP BY t),
c AS (SELECT series_id, t, corr(v, r) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) AS r FROM s JOIN g USING (t))
SELECT series_id, t, round(r, 6) + 0.0 AS r FROM c WHERE t >= 8 AND t < 56""")
def rolling_pearson(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    both = lags.with_reference(series, lags.reference_series(series)).select("series_id", F.posexplode(F.arrays_zip("values", "ref")).alias("t", "p"))
    pairs = both.select("series_id", "t", F.col("p.values").alias("a"), F.col("p.ref").alias("b"))
    return rounded(frames.rolling_correlation(pairs, 8).select("series_id", "t", "r"))


@query(f"""
WITH {SAMPLES}, w AS (SELECT *, lag(v) OVER o AS p, lead(v) OVER o AS n, sum(v) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5
  FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, t, {rounds("(CASE WHEN p IS NULL THEN (v - n) / 2 WHEN n IS NULL THEN (v - p) / 2 ELSE (n - p) / 2 END) AS central",
    "(CASE WHEN p IS NULL THEN n - v WHEN n IS NULL THEN v - p ELSE (n - p) / 2 END) AS slope", "m5 / 5 AS smooth")} FROM w""")
def derivatives_and_smoothing(spark, sf_dir):
    v = F.col("values")
    rows = embedding_series(spark, sf_dir).select("series_id", S.central_difference(v).alias("central"), S.gradient(v).alias("slope"), S.moving_average(v, 5).alias("smooth"))
    return rounded(rows.select("series_id", F.posexplode(F.arrays_zip("central", "slope", "smooth")).alias("t", "p")).select("series_id", "t", "p.*"))


@query(f"""
WITH {SAMPLES}, d AS (SELECT series_id, t, coalesce(lead(v) OVER o, first(v) OVER o) - v AS d FROM s WINDOW o AS (PARTITION BY series_id ORDER BY t)),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC, t) AS up, row_number() OVER (PARTITION BY series_id ORDER BY d, t) AS down FROM d)
SELECT series_id, round(max(d), 6) + 0.0 AS max_step, min(t) FILTER (up = 1) AS max_at, round(min(d), 6) + 0.0 AS min_step, min(t) FILTER (down = 1) AS min_at FROM k GROUP BY series_id""")
def circular_diff_extrema(spark, sf_dir):
    return rounded(frames.circular_extremes(samples(spark, sf_dir)))


@query(f"""
WITH {SAMPLES}, a AS (SELECT series_id, median(v) AS med FROM s GROUP BY series_id),
b AS (SELECT series_id, med, median(abs(v - med)) / 0.6744897501960817 AS md FROM s JOIN a USING (series_id) GROUP BY ALL),
f AS (SELECT series_id, t, abs(v - med) >= 1.5 * md AS bad FROM s JOIN b USING (series_id)),
g AS (SELECT *, coalesce(max(CASE WHEN bad THEN t END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
  min(CASE WHEN bad THEN t END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb, count(*) OVER (PARTITION BY series_id) AS n FROM f)
SELECT series_id, t, bad, bad OR coalesce(nb - pb, n - pb - 1) < 4 AS filled FROM g""")
def badpoint_islands(spark, sf_dir):
    v = F.col("values")
    flags = S.let(S.median(v), lambda m: S.let(S.mad(v), lambda s: F.transform(v, lambda x: F.abs(x - m) >= 1.5 * s)))
    rows = embedding_series(spark, sf_dir).select("series_id", F.posexplode(flags).alias("t", "bad"))
    return frames.bad_points(rows, 4).select("series_id", "t", "bad", "filled")


EVENT_HOURS = """e AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) / 3600000000.0::DOUBLE - (SELECT floor(epoch_us(min(ts)) / 3600000000.0::DOUBLE) FROM events) AS h FROM events)"""


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def event_hours(spark, sf_dir):
    """events with h: hours since the whole hour of the first one."""
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    base = e.agg(F.floor(F.min("us") / 3600e6).alias("base"))
    return e.crossJoin(F.broadcast(base)).withColumn("h", F.col("us") / 3600e6 - F.col("base"))


@query(f"""
WITH {EVENT_HOURS}, x AS (SELECT event_type, event_id AS seq, h AS start, h + event_id % 5 AS stop, value FROM e WHERE event_id % 5 > 0),
k AS (SELECT event_type, unnest(range(greatest(ceil(start), 0)::BIGINT, floor(stop)::BIGINT + 1)) AS t, seq, value FROM x)
SELECT event_type, t, round(arg_max(value, seq), 6) + 0.0 AS v FROM k GROUP BY event_type, t""")
def interval_events_rasterize(spark, sf_dir):
    e = event_hours(spark, sf_dir).select("event_type", F.col("event_id").alias("seq"), F.col("h").alias("start"), (F.col("event_id") % 5).alias("duration"), "value")
    ticks = e.agg((F.floor(F.max(F.col("start") + F.col("duration"))) + 1).alias("ticks"))  # one row: up to the last event's end
    return rounded(frames.rasterize_events(e.crossJoin(F.broadcast(ticks)), F.col("ticks"), ("event_type",)))


@query(f"""
WITH {EVENT_HOURS}, st AS (SELECT user_id, floor(h)::BIGINT AS t, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2),
u AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM st GROUP BY user_id), k AS (SELECT user_id, unnest(range(lo, hi + 1)) AS t FROM u)
SELECT k.user_id, k.t, round(st.value, 6) + 0.0 AS value FROM k ASOF JOIN st ON k.user_id = st.user_id AND k.t >= st.t""")
def stepwise_asof_fill(spark, sf_dir):
    steps = event_hours(spark, sf_dir).groupBy("user_id", F.floor("h").alias("t")).agg(F.max_by("value", "event_id").alias("value"))
    span = steps.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    ticks = span.select("user_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    return rounded(frames.step_fill(ticks, steps, ("user_id",)))


@query("""
WITH i AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS s FROM events), d AS (SELECT *, (s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id)) * 1000 AS ibi FROM i),
k AS (SELECT *, ibi - lag(ibi) OVER (PARTITION BY user_id ORDER BY s, event_id) AS step FROM d)
SELECT user_id, count(ibi) AS n, round(avg(ibi), 3) + 0.0 AS mean_nn, round(stddev_pop(ibi), 3) + 0.0 AS sdnn, round(sqrt(avg(step * step)), 3) + 0.0 AS rmssd,
  sum(CASE WHEN abs(step) > 50 THEN 1 ELSE 0 END)::BIGINT AS nn50, round(100.0::DOUBLE * sum(CASE WHEN abs(step) > 50 THEN 1 ELSE 0 END) / nullif(count(step), 0), 6) + 0.0 AS pnn50 FROM k GROUP BY user_id""")
def hrv_time_domain(spark, sf_dir):
    rows = frames.interval_statistics(table(spark, sf_dir, "events"), ("user_id",), micros("ts") / 1e6)
    ms = lambda c: (F.round(c, 3) + 0.0).alias(c)
    return rows.select("user_id", "n", ms("mean_nn"), ms("sdnn"), ms("rmssd"), "nn50", r6("pnn50", "pnn50"))


@query(f"""
WITH {EVENT_HOURS} SELECT event_type, floor((h / 24 - floor(h / 24)) * 32)::INT AS bin, {rounds("avg(value) AS v_mean", "stddev_pop(value) AS v_std")}, count(value) AS n FROM e GROUP BY 1, 2""")
def phase_bin_average(spark, sf_dir):
    return rounded(frames.phase_average(event_hours(spark, sf_dir), F.col("h") / 24, "value", 32, ("event_type",)))


@query("""
WITH x AS (SELECT DISTINCT p_brand AS grp, p_size::DOUBLE AS tm FROM part), g AS (SELECT *, tm - lag(tm) OVER (PARTITION BY grp ORDER BY tm) AS gap FROM x),
k AS (SELECT grp, tm, max(gap) OVER (PARTITION BY grp) AS step FROM g)
SELECT grp AS "group", tm AS "time", step, round_even(60.0 / step, 0)::BIGINT AS n_steps, (round_even(tm / step, 0)::BIGINT % round_even(60.0 / step, 0)::BIGINT) AS "offset" FROM k""")
def slice_timing_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), F.col("p_size").cast("double").alias("time")).distinct()
    return frames.slice_offsets(rows, 60.0)


# Grids and pairs


@query(f"""
WITH {SAMPLES} SELECT series_id, (t // 2)::INT AS pair, round(CASE WHEN sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) > 0
  THEN sum(v) / sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) ELSE 0 END, 6) + 0.0 AS v FROM s GROUP BY 1, 2""")
def pairwise_merge(spark, sf_dir):
    return rounded(grids.merge_pairs(samples(spark, sf_dir).withColumn("m", F.when(F.col("v") > 0, 1).otherwise(0))))


@query(f"""
WITH {SAMPLES}, r AS (SELECT t AS subject, label, avg(v) AS v FROM s GROUP BY 1, 2)
SELECT x.label AS i, y.label AS j, {rounds("avg(x.v - y.v) AS d_mean", "stddev_pop(x.v - y.v) AS d_std")}, count(*) AS n FROM r x JOIN r y USING (subject) WHERE x.label <= y.label GROUP BY 1, 2""")
def roi_pair_differences(spark, sf_dir):
    means = samples(spark, sf_dir).groupBy(F.col("t").alias("subject"), F.col("label").alias("region")).agg(F.avg("v").alias("v"))
    return rounded(grids.pair_differences(means))


def grid_map(spark, sf_dir):
    return on_grid(embedding_series(spark, sf_dir))


GRID = "g AS (SELECT vec_id AS series_id, (vec_id % 8)::INT AS x, (vec_id // 8 % 8)::INT AS y, vec_id // 64 AS z, embedding[1]::DOUBLE AS a, embedding FROM embeddings)"


@query(f"""
WITH {GRID}, n AS (SELECT p.series_id, q.a, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM g p JOIN g q
  ON q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.z BETWEEN p.z - 1 AND p.z + 1 WHERE p.series_id <> q.series_id)
SELECT series_id, count(*) AS n, round(avg(a), 6) + 0.0 AS a_mean FROM n WHERE d <= 1.5 GROUP BY series_id""")
def neighbour_range_join(spark, sf_dir):
    near = grids.neighbors(grid_map(spark, sf_dir).select("series_id", "x", "y", "z", F.get("values", F.lit(0)).alias("a")), 1.5)
    return rounded(near.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.avg("n_a").alias("a_mean")))


@query(f"""
WITH {GRID}, u AS (SELECT series_id, x, y, z, t, (v - avg(v) OVER w) / (stddev_pop(v) OVER w * sqrt(count(*) OVER w)) AS v
  FROM (SELECT series_id, x, y, z, unnest(range(0, len(embedding))) AS t, unnest(embedding)::DOUBLE AS v FROM g) WINDOW w AS (PARTITION BY series_id)),
r AS (SELECT p.series_id, q.series_id AS o, sum(p.v * q.v) AS r FROM u p JOIN u q ON p.t = q.t AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.z BETWEEN p.z - 1 AND p.z + 1
  WHERE p.series_id <> q.series_id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 1 GROUP BY 1, 2)
SELECT series_id, count(*) AS n, {rounds("avg(r) AS r_mean", "min(r) AS r_min", "max(r) AS r_max")} FROM r GROUP BY series_id""")
def local_flow_correlation(spark, sf_dir):
    unit = S.let(S.normalize(F.col("values"), "z"), lambda z: F.transform(z, lambda v: v / F.sqrt(F.size(z).cast("double"))))
    return rounded(grids.local_correlation(grid_map(spark, sf_dir).select("series_id", "x", "y", "z", unit.alias("values")), 1.0))


@query(f"""
WITH RECURSIVE {GRID}, k AS (SELECT * FROM g WHERE a > 0), e AS (SELECT p.series_id AS i, q.series_id AS j FROM k p JOIN k q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
c AS (SELECT series_id AS i, series_id AS j FROM k UNION SELECT c.i, e.j FROM c JOIN e ON e.i = c.j)
SELECT i AS series_id, min(j) AS component FROM c GROUP BY i""")
def connected_components(spark, sf_dir):
    cells = grid_map(spark, sf_dir).where(F.get("values", F.lit(0)) > 0).select("series_id", "x", "y", "z")
    return grids.components(cells, "series_id").select("series_id", "component")


@query(f"""
WITH {GRID}, k AS (SELECT * FROM g WHERE a > -0.2), e AS (SELECT p.series_id, count(*) AS n FROM k p JOIN k q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1 GROUP BY 1)
SELECT x, y, z FROM e JOIN g USING (series_id) WHERE n = 6""")
def mask_erosion(spark, sf_dir):
    return grids.erode(grid_map(spark, sf_dir).where(F.get("values", F.lit(0)) > -0.2))


# Lags

CORRELOGRAM = f"""
WITH {SAMPLES}, z AS (SELECT series_id, label, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM s WINDOW w AS (PARTITION BY series_id)),
g AS (SELECT t, avg(v) AS v FROM s GROUP BY t), r AS (SELECT t, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS r FROM g),
c AS (SELECT series_id, (z.t - r.t)::INT AS lag, sum(v * r) / 64 AS c FROM z JOIN r ON z.t - r.t BETWEEN -{MOST_LAG} AND {MOST_LAG} GROUP BY 1, 2)"""


def correlogram_rows(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    return lags.correlograms(series, lags.reference_series(series), MOST_LAG)


@query(CORRELOGRAM + " SELECT series_id, lag, round(c, 6) + 0.0 AS r FROM c")
def lagged_xcorr_full(spark, sf_dir):
    rows = correlogram_rows(spark, sf_dir).select("series_id", F.posexplode("corr").alias("i", "r"))
    return rounded(rows.select("series_id", (F.col("i") - MOST_LAG).alias("lag"), "r"))


@query(CORRELOGRAM + f""", k AS (SELECT *, lag(c) OVER o AS p, lead(c) OVER o AS n, row_number() OVER (PARTITION BY series_id ORDER BY round(c, 9) DESC, lag) AS rk FROM c WINDOW o AS (PARTITION BY series_id ORDER BY lag)),
f AS (SELECT *, CASE WHEN p IS NULL OR n IS NULL OR abs(p - 2 * c + n) <= 1e-12 THEN 0 ELSE least(greatest(0.5 * (p - n) / (p - 2 * c + n), -0.5), 0.5) END AS d FROM k WHERE rk = 1)
SELECT series_id, lag, {rounds("c AS strength", "lag + d AS fine_lag", "c - 0.25 * coalesce(p - n, 0) * d AS fine_strength")} FROM f""")
def best_lag_argmax(spark, sf_dir):
    return rounded(lags.best_lags(correlogram_rows(spark, sf_dir), MOST_LAG))


@query(CORRELOGRAM + f""", k AS (SELECT *, lag(c) OVER o AS p, lead(c) OVER o AS n FROM c WINDOW o AS (PARTITION BY series_id ORDER BY lag)),
f AS (SELECT *, CASE WHEN abs(p - 2 * c + n) <= 1e-12 THEN 0 ELSE least(greatest(0.5 * (p - n) / (p - 2 * c + n), -0.5), 0.5) END AS d,
  row_number() OVER (PARTITION BY series_id ORDER BY c DESC, lag) AS rk FROM k WHERE c > p AND c >= n)
SELECT series_id, rk::INT AS rank, {rounds("lag + d AS lag", "c AS amp")} FROM f WHERE rk <= 3""")
def topk_local_maxima(spark, sf_dir):
    return rounded(lags.candidate_peaks(correlogram_rows(spark, sf_dir), MOST_LAG, 3))


@query(f"""
WITH {SAMPLES}, g AS (SELECT label, t, avg(v) AS v FROM s GROUP BY 1, 2), z AS (SELECT label, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w / 8 AS v FROM g WINDOW w AS (PARTITION BY label)),
c AS (SELECT x.label AS a, y.label AS b, (x.t - y.t)::INT AS lag, round(sum(x.v * y.v), 9) AS r FROM z x JOIN z y ON x.label < y.label AND x.t - y.t BETWEEN -{MOST_LAG} AND {MOST_LAG} GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY r DESC, lag) AS rk FROM c)
SELECT a, b, lag, round(r, 6) + 0.0 AS strength FROM k WHERE rk = 1""")
def all_pairs_corr(spark, sf_dir):
    means = samples(spark, sf_dir).groupBy("label", "t").agg(F.avg("v").alias("v"))
    return rounded(lags.region_pairs(to_series(means, ["label"]), MOST_LAG))


@query(f"""
WITH {SAMPLES}, f AS (SELECT series_id, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM s GROUP BY series_id)
SELECT series_id, t, round(v - a - b * t, 6) + 0.0 AS v FROM s JOIN f USING (series_id)""")
def detrend_linear(spark, sf_dir):
    rows = embedding_series(spark, sf_dir).select("series_id", S.detrend(F.col("values")).alias("values"))
    return rounded(to_samples(rows))


TAPERED = f"""
WITH {SAMPLES}, g AS (SELECT t, avg(v) AS v FROM s GROUP BY t), x AS (SELECT series_id, t, v FROM s UNION ALL SELECT -1, t, v FROM g),
f AS (SELECT series_id, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM x GROUP BY series_id), d AS (SELECT series_id, t, v - a - b * t AS v FROM x JOIN f USING (series_id)),
w AS (SELECT series_id, t, (v - avg(v) OVER o) / stddev_pop(v) OVER o * (0.54 - 0.46 * cos(2 * pi() * t / 64)) AS v FROM d WINDOW o AS (PARTITION BY series_id)),
n AS (SELECT series_id, t, (v - avg(v) OVER o) / stddev_pop(v) OVER o / 8 AS v FROM w WINDOW o AS (PARTITION BY series_id)),
c AS (SELECT p.series_id, (p.t - r.t)::INT AS lag, sum(p.v * r.v) AS c FROM n p JOIN n r ON r.series_id = -1 AND p.series_id >= 0 AND p.t - r.t BETWEEN -{MOST_LAG} AND {MOST_LAG} GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(c, 9) DESC, lag) AS rk FROM c)"""


@query(TAPERED + " SELECT series_id, lag, round(c, 6) + 0.0 AS strength FROM k WHERE rk = 1")
def best_lag_tapered(spark, sf_dir):
    series = embedding_series(spark, sf_dir)
    corr = lags.correlograms(series, lags.reference_series(series), MOST_LAG, "hamming")
    return rounded(lags.best_lags(corr, MOST_LAG).select("series_id", "lag", "strength"))
