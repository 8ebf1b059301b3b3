"""Registered queries of filters and trackers that follow a waveform; see catalog.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.operators import kalman, tracking
from lagmill.plans.catalog import SAMPLES, query, rounded, rounds
from lagmill.sources.tables import embedding_series

STEP, PROCESS, NOISE = 1.0, 1e-3, 0.05
#: Samples of the standardised series, of which every ninth along a diagonal is missing.
GAPPED = f"{SAMPLES}, z AS (SELECT series_id, t, CASE WHEN (series_id + t) % 9 <> 0 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w END AS v FROM s WINDOW w AS (PARTITION BY series_id))"


def gapped_series(spark, sf_dir):
    def gaps(x: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.where((i[:, None] + np.arange(x.shape[1])) % 9 == 0, np.nan, K.standardized(x))

    return embedding_series(spark, sf_dir).select("series_id", K.by_batch(gaps, F.col("values"), F.col("series_id")).alias("values"))


def _velocity_sql(adaptive: bool) -> str:
    """The filter as a recursion over time; h holds the sizes of the innovations so far."""
    q, r = f"{PROCESS}::DOUBLE", f"{NOISE}::DOUBLE"
    recent = f"list_aggregate(h[-{kalman.RECENT}:], 'stddev_pop')"
    motion = f"v IS NOT NULL AND len(h) >= {kalman.RECENT} AND {recent} > 0 AND abs(v - a) > {kalman.MOTION}::DOUBLE * {recent}" if adaptive else "false"
    follow = f"CASE WHEN v IS NOT NULL AND len(h2) >= {kalman.HISTORY} THEN least(greatest({kalman.FOLLOW}::DOUBLE * list_aggregate(h2[-{kalman.HISTORY}:], 'stddev_pop'), {kalman.LEAST_PROCESS}::DOUBLE), {kalman.MOST_PROCESS}::DOUBLE) ELSE q END"
    noisy = f"CASE WHEN v IS NULL THEN r WHEN motion THEN {kalman.MOTION_NOISE}::DOUBLE * {r} ELSE {r} END"
    return f"""
WITH RECURSIVE {GAPPED}, f(series_id, t, a, b, p, c, d, q, r, h, motion) AS (
  SELECT DISTINCT series_id, -1, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, {q}, {r}, []::DOUBLE[], false FROM z
  UNION ALL
  SELECT series_id, t, CASE WHEN v IS NULL THEN a ELSE a + p / (p + r) * (v - a) END, CASE WHEN v IS NULL THEN b ELSE b + c / (p + r) * (v - a) END,
    CASE WHEN v IS NULL THEN p ELSE p - p * p / (p + r) END, CASE WHEN v IS NULL THEN c ELSE c - p * c / (p + r) END, CASE WHEN v IS NULL THEN d ELSE d - c * c / (p + r) END,
    {follow if adaptive else "q"}, {noisy if adaptive else "r"}, h2, motion
  FROM (SELECT *, {motion} AS motion, CASE WHEN v IS NULL THEN h ELSE list_append(h, abs(v - a)) END AS h2 FROM (
    SELECT f.series_id, z.t, z.v, a + b AS a, b, p + 2 * c + d + q / 4 AS p, c + d + q / 2 AS c, d + q AS d, q, r, h FROM f JOIN z ON z.series_id = f.series_id AND z.t = f.t + 1)))
SELECT series_id, t::INT AS t, round(a, 6) + 0.0 AS v, motion FROM f WHERE t >= 0"""


def _velocity_rows(spark, sf_dir, adaptive):
    rows = kalman.velocity_filtered(gapped_series(spark, sf_dir), STEP, PROCESS, NOISE, adaptive)
    flat = rows.select("series_id", F.posexplode(F.arrays_zip("filtered", "motion")).alias("t", "x"))
    return rounded(flat.select("series_id", "t", F.col("x.filtered").alias("v"), F.col("x.motion").alias("motion")))


@query(_velocity_sql(False))
def kalman_velocity(spark, sf_dir):
    """Level and velocity of every series, missing samples predicted."""
    return _velocity_rows(spark, sf_dir, False)


@query(_velocity_sql(True))
def kalman_adaptive(spark, sf_dir):
    """The same with noise that follows the innovations, and samples marked as motion."""
    return _velocity_rows(spark, sf_dir, True)


#: A heart's rate at ten samples a second.
WAVE_STEP, FIRST_RATE, WAVE_NOISE = 0.1, 1.2, 0.5


def _harmonic_sql(harmonics: int) -> str:
    """The extended filter as a recursion over time; its state x0.. is the level, the amplitudes, the phase and the angular rate, its covariance p00.. ."""
    d = harmonics + 3
    phase, speed = d - 2, d - 1
    level, first, further, ph, sp = kalman.ONE_HARMONIC if harmonics == 1 else kalman.SEVERAL_HARMONICS
    drift = [level, first, *[further] * (harmonics - 1), ph, sp]
    p = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def moved(i: int, j: int) -> str:
        terms = [p(i, j)]
        terms += [f"{WAVE_STEP}::DOUBLE * {p(speed, j)}"] if i == phase else []
        terms += [f"{WAVE_STEP}::DOUBLE * {p(i, speed)}"] if j == phase else []
        terms += [f"{WAVE_STEP**2!r}::DOUBLE * {p(speed, speed)}"] if i == j == phase else []
        return " + ".join(terms) + (f" + {drift[i] * PROCESS!r}::DOUBLE" if i == j else "")

    start = [0.0, *kalman.AMPLITUDES[:harmonics], 0.0, 2 * np.pi * FIRST_RATE]
    wave = "x0 + " + " + ".join(f"x{k} * sin({k} * x{phase})" for k in range(1, harmonics + 1))
    slope = ["1", *(f"sin({k} * x{phase})" for k in range(1, harmonics + 1)), " + ".join(f"{k} * x{k} * cos({k} * x{phase})" for k in range(1, harmonics + 1)), "0"]
    names = ", ".join([*(f"x{i}" for i in range(d)), *(p(i, j) for i, j in pairs)])
    first_row = ", ".join([*(f"{v!r}::DOUBLE" for v in start), *(f"{kalman.START_VARIANCE if i == j else 0.0}::DOUBLE" for i, j in pairs)])
    predicted = ", ".join([*(f"x{i} + {WAVE_STEP}::DOUBLE * x{speed} AS x{i}" if i == phase else f"x{i}" for i in range(d)), *(f"{moved(i, j)} AS {p(i, j)}" for i, j in pairs)])
    cross = ", ".join(f"{' + '.join(f'{p(i, j)} * h{j}' for j in range(d))} AS c{i}" for i in range(d))
    total = " + ".join(f"h{i} * c{i}" for i in range(d)) + f" + {WAVE_NOISE}::DOUBLE"
    after = ", ".join([*(f"CASE WHEN v IS NULL THEN x{i} ELSE x{i} + c{i} / u * (v - w) END" for i in range(d)), *(f"CASE WHEN v IS NULL THEN {p(i, j)} ELSE {p(i, j)} - c{i} * c{j} / u END" for i, j in pairs)])
    return f"""
WITH RECURSIVE {GAPPED}, f(series_id, t, {names}) AS (
  SELECT DISTINCT series_id, -1, {first_row} FROM z
  UNION ALL
  SELECT series_id, t, {after} FROM (SELECT *, {total} AS u FROM (SELECT *, {cross} FROM (SELECT *, {wave} AS w, {", ".join(f"{e} AS h{i}" for i, e in enumerate(slope))} FROM (
    SELECT f.series_id, z.t, z.v, {predicted} FROM f JOIN z ON z.series_id = f.series_id AND z.t = f.t + 1)))))
SELECT series_id, t::INT AS t, {rounds(f"{wave} AS v", f"x{speed} / (2 * pi()) AS rate", *(f"x{k} AS a{k}" for k in range(1, harmonics + 1)))} FROM f WHERE t >= 0"""


def _harmonic_rows(spark, sf_dir, harmonics):
    rows = kalman.harmonic_filtered(gapped_series(spark, sf_dir), WAVE_STEP, FIRST_RATE, PROCESS, WAVE_NOISE, harmonics)
    parts = [F.col("filtered").alias("v"), F.col("rate"), *(F.get("amplitudes", F.lit(k - 1)).alias(f"a{k}") for k in range(1, harmonics + 1))]
    names = ["v", "rate", *(f"a{k}" for k in range(1, harmonics + 1))]
    flat = rows.select("series_id", *parts).select("series_id", F.posexplode(F.arrays_zip(*names)).alias("t", "x"))
    return rounded(flat.select("series_id", "t", *(F.col(f"x.{n}").alias(n) for n in names)))


@query(_harmonic_sql(1))
def kalman_sinusoid(spark, sf_dir):
    """Every series as a wave whose level, amplitude and rate move."""
    return _harmonic_rows(spark, sf_dir, 1)


@query(_harmonic_sql(3))
def kalman_harmonics(spark, sf_dir):
    """Every series as a wave of three harmonics whose amplitudes and rate move."""
    return _harmonic_rows(spark, sf_dir, 3)


SEGMENT, STIFFNESS, LEAST_SHARE = 16, 0.5, 0.15
LOW, HIGH = 1, 7  # spectral lines
_LINES = f"range({LOW}, {HIGH + 1})"
TRACKED = f"""{SAMPLES}, w AS (SELECT i::INT AS series_id, c AS t, j, coalesce(v, 0) AS v FROM (SELECT DISTINCT series_id AS i FROM s), range(64) a(c), range({SEGMENT}) b(j) LEFT JOIN s ON s.series_id = i AND s.t = c + j - {SEGMENT // 2}),
d AS (SELECT series_id, t, j, (v - avg(v) OVER (PARTITION BY series_id, t)) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * j / {SEGMENT - 1})) AS v FROM w),
o AS (SELECT series_id, t, k, sum(v * cos(2 * pi() * k * j / {SEGMENT})) ** 2 + sum(v * sin(2 * pi() * k * j / {SEGMENT})) ** 2 AS p FROM d, range({SEGMENT // 2 + 1}) z(k) GROUP BY 1, 2, 3),
h AS (SELECT series_id, t, k, p / sum(CASE WHEN k > 0 THEN p END) OVER (PARTITION BY series_id, t) AS p FROM o),
l AS (SELECT series_id, t, list(ln(greatest(p, 1e-12)) ORDER BY k) AS l FROM h WHERE k BETWEEN {LOW} AND {HIGH} GROUP BY 1, 2),
r AS (
  SELECT series_id, t, l AS best, list_transform({_LINES}, lambda k: [k]) AS ways FROM l WHERE t = 0
  UNION ALL
  SELECT series_id, t, list_transform(range(1, len(l) + 1), lambda k: l[k] + list_max(o[k])), list_transform(range(1, len(l) + 1), lambda k: list_append(ways[list_position(o[k], list_max(o[k]))], k + {LOW - 1}))
  FROM (SELECT l.series_id, l.t, l.l, r.ways, list_transform(range(1, len(l.l) + 1), lambda k: list_transform(range(1, len(l.l) + 1), lambda j: r.best[j] - {STIFFNESS}::DOUBLE * abs(k - j))) AS o
        FROM r JOIN l ON l.series_id = r.series_id AND l.t = r.t + 1)),
y AS (SELECT series_id, unnest(range(64)) AS t, unnest(ways[list_position(best, list_max(best))]) AS k FROM r WHERE t = 63),
q AS (SELECT y.series_id, y.t, y.k, a.p AS a, b.p AS b, c.p AS c FROM y JOIN h a ON a.series_id = y.series_id AND a.t = y.t AND a.k = y.k - 1
  JOIN h b ON b.series_id = y.series_id AND b.t = y.t AND b.k = y.k JOIN h c ON c.series_id = y.series_id AND c.t = y.t AND c.k = y.k + 1),
f AS (SELECT series_id, t, b AS share, CASE WHEN b >= {LEAST_SHARE}::DOUBLE THEN
  (k + CASE WHEN a - 2 * b + c < -1e-12 THEN least(greatest((a - c) / (2 * (a - 2 * b + c)), -0.5), 0.5) ELSE 0 END) / {SEGMENT} ELSE 0 END AS frequency FROM q)"""


def tracked_series(spark, sf_dir):
    return tracking.tracked(embedding_series(spark, sf_dir), 1.0, LOW / SEGMENT, HIGH / SEGMENT, SEGMENT, STIFFNESS, LEAST_SHARE)


@query(f"WITH RECURSIVE {TRACKED} SELECT series_id, t::INT AS t, {rounds('frequency', 'share')} FROM f")
def frequency_tracked(spark, sf_dir):
    """The frequency that every series' spectrogram follows best, sample by sample."""
    rows = tracked_series(spark, sf_dir).select("series_id", F.posexplode(F.arrays_zip("frequency", "share")).alias("t", "x"))
    return rounded(rows.select("series_id", "t", F.col("x.frequency").alias("frequency"), F.col("x.share").alias("share")))


def _notched(source: str, j: int) -> str:
    """Rows (series_id, t, j, frequency, v) of source without the wave of j times the frequency in every frame."""
    angle = f"2 * pi() * {j} * frequency * (j - {SEGMENT // 2})"
    sums = ", ".join(f"sum({e}) OVER w AS {n}" for n, e in (("cc", "c * c"), ("ss", "s * s"), ("cs", "c * s"), ("xc", "v * c"), ("xs", "v * s")))
    on = f"frequency > 0 AND {j} * frequency < 0.5 AND cc * ss - cs * cs > 1e-6"
    return f"""(SELECT series_id, t, j, frequency, CASE WHEN {on} THEN v - ((xc * ss - xs * cs) * c + (xs * cc - xc * cs) * s) / (cc * ss - cs * cs) ELSE v END AS v
  FROM (SELECT *, {sums} FROM (SELECT *, cos({angle}) AS c, sin({angle}) AS s FROM {source}) WINDOW w AS (PARTITION BY series_id, t)))"""


@query(f"""
WITH RECURSIVE {TRACKED}, x AS (SELECT w.*, frequency FROM w JOIN f USING (series_id, t))
SELECT series_id, (t + j - {SEGMENT // 2})::INT AS t, {rounds("avg(v) AS v")} FROM {_notched(_notched("x", 1), 2)} WHERE t + j - {SEGMENT // 2} BETWEEN 0 AND 63 GROUP BY ALL""")
def frequency_cleaned(spark, sf_dir):
    """Every series without the wave that its spectrogram follows, and its first harmonic."""
    rows = tracking.cleaned(tracked_series(spark, sf_dir), 1.0, SEGMENT, 1)
    return rounded(rows.select("series_id", F.posexplode("cleaned").alias("t", "v")))
