"""Registered queries of choices among candidate delays and of structure on maps; see catalog.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators import candidates, cardiac, decomposition, distributions, lags, optical, partition, streamlines
from lagmill.plans.catalog import CORRELOGRAM, GRID, SAMPLES, MOST_LAG, ORACLE_SQL, correlogram_rows, grid_map, query, rounded, rounds
from lagmill.plans.catalog_flow import TOUCH
from lagmill.sources import volume_source
from lagmill.sources.tables import embedding_series, materialize, new_path, remove


def candidate_cells(spark, sf_dir):
    """Cells of the grid with up to three candidate delays, numbers rounded as in the oracle."""
    peaks = lags.candidate_peaks(correlogram_rows(spark, sf_dir), MOST_LAG, 3)
    return materialize(candidates.with_candidates(rounded(peaks), grid_map(spark, sf_dir)), "candidate-cells")


#: Candidates of cells as lists k (lags) and confidence sure, and the edges between cells that have some.
CANDIDATES = f"""{GRID}, p AS ({ORACLE_SQL["topk_local_maxima"]}),
c AS (SELECT series_id AS id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, list(lag ORDER BY rank) AS k, max(amp) FILTER (rank = 1) - coalesce(max(amp) FILTER (rank = 2), 0) AS sure
  FROM g JOIN p USING (series_id) GROUP BY 1),
e AS (SELECT a.id AS u, b.id AS v, least(a.sure, b.sure) AS w FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.id <> b.id)"""


@query(f"""
WITH RECURSIVE {CANDIDATES}, e2 AS (SELECT u, v, w FROM e UNION ALL SELECT -1, id, -1e9 + sure FROM c),
grow AS (
  SELECT [-1]::BIGINT[] AS seen, -1::BIGINT AS v, NULL::DOUBLE AS tau, map([-1]::BIGINT[], [NULL]::DOUBLE[]) AS taus, -1::BIGINT AS tree
  UNION ALL
  SELECT list_append(seen, n), n, t, map_concat(taus, map([n], [t])), CASE WHEN o = -1 THEN n ELSE tree END FROM (
    SELECT s.seen, s.taus, s.tree, b.u AS o, b.v AS n,
           CASE WHEN b.u = -1 THEN c.k[1] ELSE list_transform(list_sort(list_transform(range(1, len(c.k) + 1), lambda i: [abs(c.k[i] - s.taus[b.u]), i])), lambda q: c.k[q[2]::INT])[1] END AS t
    FROM grow s, LATERAL (SELECT * FROM e2 WHERE list_contains(s.seen, e2.u) AND NOT list_contains(s.seen, e2.v) ORDER BY w DESC, least(u, v), greatest(u, v) LIMIT 1) b JOIN c ON c.id = b.v))
SELECT id AS series_id, {rounds("tau", "sure AS confidence")}, abs(tau - k[1]) > 1e-9 AS changed FROM c JOIN grow ON grow.v = c.id""")
def unwrapped_delays(spark, sf_dir):
    """Every cell's candidate delay as chosen along the surest neighbours."""
    found = candidates.unwrapped(candidate_cells(spark, sf_dir)).where("tau is not null")
    return rounded(found.select(F.col("id").alias("series_id"), "tau", "confidence", "changed"))


MODES = 2


@query(f"""
WITH RECURSIVE {CANDIDATES}, f AS (SELECT u, v, x % 2 + 2 * (y % 2) + 4 * (z % 2) AS colour FROM e JOIN c ON c.id = e.u),
m AS (
  SELECT id, k, k[1] AS tau, 0 AS step FROM c
  UNION ALL
  SELECT m.id, m.k, CASE WHEN q.cost < q.now THEN q.cand ELSE m.tau END, m.step + 1 FROM m LEFT JOIN (
    SELECT id, min(cost) AS cost, first(now) AS now, first(cand ORDER BY cost, i) AS cand FROM (
      SELECT a.id, i, a.k[i] AS cand, round(sum(abs(a.k[i] - b.tau)), 9) AS cost, round(sum(abs(a.tau - b.tau)), 9) AS now
      FROM m a JOIN f ON f.u = a.id AND f.colour = a.step % 8 JOIN m b ON b.id = f.v, unnest(range(1, len(a.k) + 1)) r(i) GROUP BY a.id, i, a.k) GROUP BY id) q ON q.id = m.id
  WHERE m.step < {8 * MODES})
SELECT id AS series_id, {rounds("tau")} FROM m WHERE step = {8 * MODES}""")
def candidate_modes(spark, sf_dir):
    """Every cell's candidate delay after two sweeps that lower the differences between neighbours."""
    cells = candidate_cells(spark, sf_dir)
    start = cells.where(F.size("lags") > 0).select("id", F.get("lags", F.lit(0)).alias("tau"))
    found = candidates.conditional_modes(cells, start, MODES).where("tau is not null")
    return rounded(found.select(F.col("id").alias("series_id"), "tau"))


@query(f"""
WITH {GRID}, n AS (SELECT max(z) + 1 AS nz FROM g), i AS (SELECT unnest(range(0, 64 * nz)) AS id FROM n)
SELECT id AS series_id, (id % 8)::INT AS x, (id // 8 % 8)::INT AS y, (id // 64)::INT AS z, t::INT AS t, coalesce(embedding[t + 1], 0)::DOUBLE AS v, coalesce(a, 0)::DOUBLE AS first
FROM i LEFT JOIN g ON g.series_id = id, range(0, 64) r(t)""")
def volumes_written_and_read(spark, sf_dir):
    """The series on their grid as a volume of 64 steps and a map, written by the data source and read back; cells without a series hold 0."""
    rows = grid_map(spark, sf_dir).select("x", "y", "z", F.col("values").alias("series"), F.get("values", F.lit(0)).alias("first"))
    depth = rows.agg(F.max("z")).first()[0] + 1
    root = new_path(spark, "volumes")
    series, first = volume_source.save_maps(rows, f"{root}/all", (8, 8, depth), step=2.0, steps=64)
    one = volume_source.load(spark, first).select("series_id", F.get("values", F.lit(0)).alias("first"))
    both = volume_source.load(spark, series).join(one, "series_id")
    out = materialize(both.select("series_id", "x", "y", "z", F.posexplode("values").alias("t", "v"), "first"), "volumes-read")
    remove(spark, root)
    return out


def unit_field(spark, sf_dir):
    """Three values of each series as the direction at its cell."""
    rows = grid_map(spark, sf_dir).select("x", "y", "z", *(F.get("values", F.lit(i)).alias(f"u{a}") for i, a in enumerate("xyz")))
    length = F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy") + F.col("uz") * F.col("uz"))
    return rows.select("x", "y", "z", *((F.col(f"u{a}") / length).alias(f"u{a}") for a in "xyz"))


STEP, STEPS = 0.5, 12


def stage(rows: str, name: str, point: str) -> str:
    """rows with the unit direction at a point (three expressions) as name_x, name_y, name_z, null where a line ends."""
    px, py, pz = point.split(";")
    weight = " * ".join(f"CASE WHEN c.d{a} = 1 THEN {p} - floor({p}) ELSE 1 - ({p} - floor({p})) END" for a, p in zip("xyz", (px, py, pz), strict=True))
    return f"""(SELECT *, CASE WHEN i_w >= 0.5 AND i_n >= 1e-6 THEN i_x / i_n END AS {name}_x, CASE WHEN i_w >= 0.5 AND i_n >= 1e-6 THEN i_y / i_n END AS {name}_y,
  CASE WHEN i_w >= 0.5 AND i_n >= 1e-6 THEN i_z / i_n END AS {name}_z FROM (SELECT r.*, i.*, sqrt(i_x * i_x + i_y * i_y + i_z * i_z) AS i_n FROM {rows} r, LATERAL (
  SELECT sum(w) AS i_w, sum(w * ux) AS i_x, sum(w * uy) AS i_y, sum(w * uz) AS i_z FROM (
    SELECT {weight} AS w, ux, uy, uz FROM corners c JOIN u ON u.x = floor({px}) + c.dx AND u.y = floor({py}) + c.dy AND u.z = floor({pz}) + c.dz)) i))"""


def _stepped() -> str:
    at = lambda f, k: ";".join(f"(p{a} + {f}::DOUBLE * half * {STEP}::DOUBLE * {k}_{a})" for a in "xyz")
    drop = lambda q: f"(SELECT * EXCLUDE (i_w, i_x, i_y, i_z, i_n) FROM {q})"
    rows = drop(stage("t", "k1", "px;py;pz"))
    for name, before, f in (("k2", "k1", 0.5), ("k3", "k2", 0.5), ("k4", "k3", 1.0)):
        rows = drop(stage(f"(SELECT * FROM {rows} WHERE {before}_x IS NOT NULL)", name, at(f, before)))
    mean = ", ".join(f"(k1_{a} + 2 * k2_{a} + 2 * k3_{a} + k4_{a}) / 6 AS v{a}" for a in "xyz")
    return f"(SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS n FROM (SELECT *, {mean} FROM {rows} WHERE k4_x IS NOT NULL))"


TRACED = f"""{GRID}, u AS (SELECT x, y, z, embedding[1]::DOUBLE / n AS ux, embedding[2]::DOUBLE / n AS uy, embedding[3]::DOUBLE / n AS uz FROM (
  SELECT *, sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE + embedding[3]::DOUBLE * embedding[3]::DOUBLE) AS n FROM g)),
corners AS (SELECT dx, dy, dz FROM range(0, 2) a(dx), range(0, 2) b(dy), range(0, 2) c(dz)),
t AS (
  SELECT series_id, h::INT AS half, 0 AS k, x::DOUBLE AS px, y::DOUBLE AS py, z::DOUBLE AS pz, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS lz
  FROM g, (VALUES (1), (-1)) s(h) WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0
  UNION ALL
  SELECT series_id, half, k + 1, px + half * {STEP}::DOUBLE * vx / n, py + half * {STEP}::DOUBLE * vy / n, pz + half * {STEP}::DOUBLE * vz / n, vx / n, vy / n, vz / n
  FROM {_stepped()} WHERE n >= 1e-6 AND k < {STEPS} AND (lx IS NULL OR lx * vx + ly * vy + lz * vz >= 0))"""


@query(f"""
WITH RECURSIVE {TRACED}, o AS (SELECT series_id, half * k AS place, px AS x, py AS y, pz AS z FROM t WHERE half = 1 OR k > 0),
l AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS gone FROM o WINDOW w AS (PARTITION BY series_id ORDER BY place))
SELECT series_id, place::INT AS place, {rounds("x", "y", "z", "sum(gone) OVER (PARTITION BY series_id) AS length")} FROM l QUALIFY sum(gone) OVER (PARTITION BY series_id) >= 1""")
def streamlines_traced(spark, sf_dir):
    """Lines of fixed steps through a field of directions, from every other cell along each axis, both ways."""
    field = materialize(unit_field(spark, sf_dir), "field")
    seeds = grid_map(spark, sf_dir).where("x % 2 = 0 and y % 2 = 0 and z % 2 = 0").select(F.col("series_id").alias("seed_id"), "x", "y", "z")
    found = streamlines.spliced(streamlines.traced(field, seeds, step=STEP, most_steps=STEPS, block=4), least=1.0)
    return rounded(found.withColumnRenamed("seed_id", "series_id"))


def _flow_sql() -> str:
    """Sums of products of derivatives of the correlograms over lag and the 27 cells around, and the least-squares velocity by Cramer's rule."""
    beside = " ".join(f"LEFT JOIN b {a}{n} ON {a}{n}.lag = b.lag AND " + " AND ".join(f"{a}{n}.{c} = b.{c}" + (f" {s} 1" if c == a else "") for c in "xyz") for a in "xyz" for n, s in (("p", "+"), ("m", "-")))
    d = ", ".join(f"(coalesce({a}p.c, b.c) - coalesce({a}m.c, b.c)) / 2 AS d{a}" for a in "xyz")
    sums = ", ".join(f"sum(greatest(c, 0) * d{p[0]} * d{p[1]}) AS {p}" for p in optical.PRODUCTS)
    near = ", ".join(f"sum(exp(-0.5::DOUBLE * ((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) / 0.765625::DOUBLE) * q.{p}) AS {p}" for p in optical.PRODUCTS)
    det = lambda r: "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*r)
    m, b = ["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"], ["-xt", "-yt", "-zt"]
    swap = lambda k: det([b[i // 3] if i % 3 == k else m[i] for i in range(9)])
    return f"""{CORRELOGRAM}, {GRID.replace("g AS", "places AS", 1)}, b AS (SELECT series_id, x, y, z, lag, c FROM c JOIN places USING (series_id)),
e AS (SELECT b.series_id, b.x, b.y, b.z, b.c, {d}, (lead(b.c, 1, b.c) OVER w - lag(b.c, 1, b.c) OVER w) / 2 AS dt FROM b {beside} WINDOW w AS (PARTITION BY b.series_id ORDER BY b.lag)),
o AS (SELECT series_id, x, y, z, {sums} FROM e GROUP BY ALL),
n AS (SELECT p.series_id, {near} FROM o p JOIN o q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 GROUP BY p.series_id)
SELECT series_id, {rounds(*optical.PRODUCTS)}, {rounds(*(f"{swap(k)} / {det(m)} AS v{a}" for k, a in enumerate("xyz")))} FROM n"""


@query(_flow_sql())
def optical_flow(spark, sf_dir):
    """Velocity of the correlograms' pattern by plain least squares in all directions, and the sums it rests on."""
    cells = correlogram_rows(spark, sf_dir).select("series_id", "corr").join(grid_map(spark, sf_dir).select("series_id", "x", "y", "z"), "series_id")
    found = optical.velocities(optical.flow_sums(cells.withColumnRenamed("series_id", "id"), radius=1.75), 0.0, total=False)
    return rounded(found.select(F.col("id").alias("series_id"), *optical.PRODUCTS, "vx", "vy", "vz"))


CHANCE = "('0x' || substr(md5('7:' || {0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""
WITH RECURSIVE {GRID}, e AS (SELECT p.series_id AS i, q.series_id AS j FROM g p JOIN g q ON abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1),
f AS (SELECT series_id, row_number() OVER (ORDER BY {CHANCE.format("series_id::VARCHAR")}, series_id) - 1 AS k FROM g),
m AS (
  SELECT series_id AS i, CASE WHEN k < 12 THEN k::INT END AS region, 0 AS step FROM f
  UNION ALL
  SELECT m.i, coalesce(m.region, w.region), m.step + 1 FROM m LEFT JOIN (
    SELECT i, first(region ORDER BY race, region) AS region FROM (
      SELECT DISTINCT e.i, t.region, -ln(1 - {CHANCE.format("e.i::VARCHAR || ':' || t.region::VARCHAR")}) * (s.size + 1) ** 2 AS race
      FROM e JOIN m t ON t.i = e.j AND t.region IS NOT NULL JOIN (SELECT region, count(*) AS size FROM m WHERE region IS NOT NULL GROUP BY region) s ON s.region = t.region) GROUP BY i) w ON w.i = m.i
  WHERE EXISTS (SELECT 1 FROM m q WHERE q.region IS NULL))
SELECT i AS series_id, region FROM m QUALIFY step = max(step) OVER ()""")
def regions_grown(spark, sf_dir):
    """The grid parted into twelve connected regions of like size."""
    cells = grid_map(spark, sf_dir).select(F.col("series_id").alias("id"), "x", "y", "z")
    return partition.grown_regions(cells, 12, 7, 2.0).withColumnRenamed("id", "series_id")


SHARES = (0.5, 0.9, 0.95, 0.99)


@query(f"""
WITH v AS (SELECT c.lag, abs(c.r) AS r FROM ({ORACLE_SQL["lagged_xcorr_full"]}) c),
o AS (SELECT lag, r, row_number() OVER (PARTITION BY lag ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY lag) AS n FROM v),
q AS (SELECT lag, {", ".join(f"max(r) FILTER (k = least(round_even({distributions._share(f * distributions.DEVIATE)!r}::DOUBLE * n, 0)::BIGINT, n - 1)) AS {a}" for a, f in (("a", -3), ("b", -1), ("c", 1), ("d", 3)))},
  {", ".join(f"max(r) FILTER (k = least(round_even({s}::DOUBLE * n, 0)::BIGINT, n - 1)) AS s{i}" for i, s in enumerate(SHARES))} FROM o GROUP BY lag),
w AS (SELECT *, (d - c > 0 AND b - a > 0 AND (d - c) * (b - a) < (c - b) ** 2) AS ok, CASE WHEN ok THEN (c - b) / (d - c) END AS u, CASE WHEN ok THEN (c - b) / (b - a) END AS l, (1 + u) * (1 + l) AS bo, u * l - 1 AS ov FROM q),
f AS (SELECT *, {distributions.DEVIATE!r}::DOUBLE / acosh(sqrt(bo) / 2) AS delta, delta * asinh((l - u) * sqrt(bo - 4) / (2 * ov)) AS gamma, (c - b) * sqrt((bo - 2) ** 2 - 4) / ov AS lam,
  (b + c) / 2 - lam / 2 + (c - b) * (l - u) / (2 * ov) AS xi FROM w)
SELECT lag, share, {rounds("from_data", "from_fit")} FROM (
  {" UNION ALL ".join(f"SELECT lag, {s}::DOUBLE AS share, s{i} AS from_data, xi + lam / (1 + exp((gamma - {distributions.NormalDist().inv_cdf(s)!r}::DOUBLE) / delta)) AS from_fit FROM f" for i, s in enumerate(SHARES))})""")
def correlation_thresholds(spark, sf_dir):
    """At every lag, thresholds of the correlations' sizes from a fitted bounded distribution beside those of the data."""
    rows = rounded(correlogram_rows(spark, sf_dir).select("series_id", F.posexplode("corr").alias("i", "r")))
    values = rows.select((F.col("i") - MOST_LAG).alias("lag"), F.abs("r").alias("r"))
    return rounded(distributions.thresholds(values, ["lag"], "r", list(SHARES)))


def _normal(name: str, source: str, keys: str) -> str:
    """Rows (keys, t, v, n) of source as normalised for correlation: line taken off, scaled, Hamming window, scaled, over the root of the length."""
    return f"""{name}1 AS (SELECT *, v - regr_intercept(v, t) OVER w - regr_slope(v, t) OVER w * t AS d FROM {source} WINDOW w AS (PARTITION BY {keys})),
{name}2 AS (SELECT *, (d - avg(d) OVER w) / stddev_pop(d) OVER w * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * t / n)) AS h FROM {name}1 WINDOW w AS (PARTITION BY {keys})),
{name} AS (SELECT {keys}, t, (h - avg(h) OVER w) / stddev_pop(h) OVER w / sqrt(n) AS z FROM {name}2 WINDOW w AS (PARTITION BY {keys}))"""


@query(f"""
WITH {SAMPLES}, m AS (SELECT 0 AS one, t, avg(v) AS v, 64 AS n FROM s GROUP BY t), o AS (SELECT series_id, t, CASE WHEN t % 4 = series_id % 4 THEN v ELSE 0 END AS v, 64 AS n FROM s),
{_normal("x", "o", "series_id")}, {_normal("y", "m", "one")}
SELECT series_id, (x.t - y.t)::INT AS lag, round(sum(x.z * y.z) * 2, 6) + 0.0 AS r FROM x JOIN y ON x.t - y.t BETWEEN -{MOST_LAG} AND {MOST_LAG} GROUP BY 1, 2""")
def aliased_correlograms(spark, sf_dir):
    """Correlograms of series of which every fourth sample is known, from an offset of their own on, with the mean series at the full rate."""
    series = embedding_series(spark, sf_dir)
    rows = lags.with_reference(series, lags.reference_series(series))
    rows = rows.withColumn("offset", (F.col("series_id") % 4).cast("int"))
    rows = rows.withColumn("lo", F.filter("values", lambda v, t: F.pmod(t, F.lit(4)) == F.col("offset")))
    rows = lags.aliased_correlograms(rows, "lo", "ref", 4, "offset", MOST_LAG)
    return rounded(rows.select("series_id", F.posexplode("corr").alias("i", "r")).select("series_id", (F.col("i") - MOST_LAG).alias("lag"), "r"))


@query(f"""
WITH c AS (SELECT vec_id AS series_id, unnest(range(0, 32)) AS t, unnest(embedding[1:32])::DOUBLE AS re, unnest(embedding[33:64])::DOUBLE AS im FROM embeddings),
d AS (SELECT series_id, t, re - avg(re) OVER w AS re, im - avg(im) OVER w AS im FROM c WINDOW w AS (PARTITION BY t)),
k AS (SELECT a.t AS i, b.t AS j, avg(a.re * b.re + a.im * b.im) AS p, avg(a.re * b.im - a.im * b.re) AS q FROM d a JOIN d b USING (series_id) GROUP BY 1, 2)
SELECT d.series_id, {rounds("sum(re * re + im * im) AS energy", "any_value(z.total) AS total", "any_value(z.squares) AS squares")}
FROM d, (SELECT sum(p) FILTER (i = j) AS total, sum(p * p + q * q) AS squares FROM k) z GROUP BY d.series_id""")
def complex_principal_components(spark, sf_dir):
    """Halves of the series as real and imaginary parts: the energy of each one's scores, the sum of the variances and that of their squares."""
    s = embedding_series(spark, sf_dir).select("series_id", F.slice("values", 1, 32).alias("re"), F.slice("values", 33, 32).alias("im"))
    components, variances, mean = decomposition.complex_components(s, 32, 32)
    scores = decomposition.complex_scores(s, components, mean)
    energy = S.total(S.product(F.col("s_re"), F.col("s_re"))) + S.total(S.product(F.col("s_im"), F.col("s_im")))
    return rounded(scores.select("series_id", energy.alias("energy"), F.lit(float(variances.sum())).alias("total"), F.lit(float((variances**2).sum())).alias("squares")))


@query(f"""
WITH {GRID}, s AS (SELECT z, unnest(range(0, 64)) AS k, a * unnest(embedding)::DOUBLE AS v FROM g WHERE a <> 0), m AS (SELECT z, k, avg(v) AS v FROM s GROUP BY 1, 2),
c AS (SELECT z, k, v - median(v) OVER (PARTITION BY z) AS v FROM m), n AS (SELECT z, k, v / (median(abs(v)) OVER (PARTITION BY z) / {S.MAD_SCALE!r}::DOUBLE) AS v FROM c),
p AS (SELECT z * 3 % 4 + 4 * k AS t, -sum(v) AS v FROM n GROUP BY 1), f AS (SELECT t, coalesce(v, 0) AS v FROM range(0, 256) r(t) LEFT JOIN p USING (t))
SELECT t::INT AS t, {rounds("v - avg(v) OVER (PARTITION BY t % 4) AS v", "avg(v) OVER (PARTITION BY t % 4) AS cycle")} FROM f""")
def slice_waveform(spark, sf_dir):
    """The grid's planes as slices taken at four times of a cycle: the waveform they make together."""
    rows = grid_map(spark, sf_dir).select(F.col("z").alias("slice"), F.get("values", F.lit(0)).alias("weight"), "values")
    offsets = rows.select("slice").distinct().withColumn("offset", F.col("slice") * 3 % 4)
    return rounded(cardiac.slice_waveform(rows, offsets, 4))
