"""Registered queries of the composed lag passes and of each stage by itself; see catalog.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators import lags, refinement
from lagmill.plans.catalog import CORRELOGRAM, GRID, MOST_LAG, query, grid_map, rounded, rounds
from lagmill.sources.tables import embedding_series

QUICK = refinement.Peaks(MOST_LAG, "fastquad", tapered=False)
OFF, ROUNDS = 2.0, 2
PLACES = GRID.replace("g AS", "places AS", 1)


def _fitted(name: str, rows: str) -> str:
    """The parabola through the highest inner sample of every correlogram of rows (series_id, lag, c) and its neighbours: lag, strength, width, and whether it holds."""
    low, high = QUICK.width
    return f"""{name}t AS (SELECT series_id, arg_max(lag, c) AS k, max(c) AS top FROM {rows} WHERE abs(lag) < {MOST_LAG} GROUP BY series_id),
{name}n AS (SELECT p.series_id, k, top, (l.c + h.c) / 2 - top AS a, (h.c - l.c) / 2 AS b FROM {name}t p JOIN {rows} l ON l.series_id = p.series_id AND l.lag = k - 1 JOIN {rows} h ON h.series_id = p.series_id AND h.lag = k + 1),
{name}s AS (SELECT *, CASE WHEN abs(a) < 1e-12 THEN 0 ELSE -b / (2 * a) END AS d, 1 / greatest(abs(a), 1e-12) AS w FROM {name}n),
{name}v AS (SELECT series_id, top, k + d AS lag, top + b * d + a * d * d AS high, w FROM {name}s),
{name} AS (SELECT series_id, least(greatest(lag, -{MOST_LAG}), {MOST_LAG}) AS lag, least(greatest(high, 0), 1) AS strength, least(greatest(w, {low}::DOUBLE), {high}::DOUBLE) AS width,
  top BETWEEN 0 AND 1 AND high BETWEEN 0 AND 1.0001 AND abs(lag) <= {MOST_LAG} AND w BETWEEN {low}::DOUBLE AND {high}::DOUBLE AS ok FROM {name}v)"""


def _despeckled() -> str:
    parts = [_fitted("f0", "c"), "m0 AS (SELECT *, false AS refit FROM f0)"]
    for i in range(ROUNDS):
        parts += [
            f"u{i} AS (SELECT p.series_id, median(m.lag) AS mid FROM places p JOIN places q ON abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1 JOIN m{i} m ON m.series_id = q.series_id AND m.ok GROUP BY 1)".replace(
                "<= 1 JOIN", "<= 1 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 1.75 ** 2 JOIN"),
            f"o{i} AS (SELECT series_id, mid FROM u{i} JOIN m{i} USING (series_id) WHERE NOT ok OR abs(lag - mid) > {OFF}::DOUBLE)",
            f"w{i} AS (SELECT series_id, lag, c, mid, max(CASE WHEN abs(lag - mid) <= {OFF}::DOUBLE AND abs(lag) < {MOST_LAG} THEN c END) OVER (PARTITION BY series_id) AS top FROM c JOIN o{i} USING (series_id))",
            f"r{i} AS (SELECT series_id, lag, CASE WHEN abs(lag - mid) <= {OFF}::DOUBLE THEN c ELSE least(c, top - {refinement.UNDER}::DOUBLE) END AS c FROM w{i} WHERE top IS NOT NULL)",
            _fitted(f"f{i + 1}", f"r{i}"),
            f"m{i + 1} AS (SELECT m.series_id, " + ", ".join(f"CASE WHEN f.ok THEN f.{c} ELSE m.{c} END AS {c}" for c in ("lag", "strength", "width")) + f", m.ok OR coalesce(f.ok, false) AS ok, m.refit OR coalesce(f.ok, false) AS refit FROM m{i} m LEFT JOIN f{i + 1} f USING (series_id))",
        ]
    return f"{CORRELOGRAM}, {PLACES}, " + ",\n".join(parts)


@query(f"{_despeckled()} SELECT series_id, {rounds('lag', 'strength', 'width')}, ok, refit FROM m{ROUNDS}")
def despeckled_lags(spark, sf_dir):
    """Lags against the mean series, of which those far from their neighbours' median are fitted again near it."""
    series = embedding_series(spark, sf_dir)
    ref = np.asarray(lags.reference_series(series).first()["ref"])
    fits = refinement.lag_fits(series, ref, QUICK)
    found = refinement.despeckled(series, grid_map(spark, sf_dir), fits, ref, QUICK, OFF, ROUNDS)
    return rounded(found.select("series_id", "lag", "strength", "width", (F.col("flags") == 0).alias("ok"), "refit"))


LEAST = 0.2


@query(f"""
{CORRELOGRAM}, k AS (SELECT series_id, arg_max(lag, c) AS lag, max(c) AS c FROM c WHERE abs(lag) < {MOST_LAG} GROUP BY 1),
p AS (SELECT k.*, (SELECT count(*) FROM c WHERE c.series_id = k.series_id AND c.lag = sign(k.lag) * {MOST_LAG - 3} AND c.c > 0.5 * k.c) AS over,
  (SELECT sum(CASE WHEN abs(c.lag) = {MOST_LAG - 2} THEN c.c ELSE -c.c END) FROM c WHERE c.series_id = k.series_id AND c.lag IN (sign(k.lag) * {MOST_LAG - 2}, sign(k.lag) * {MOST_LAG - 4})) AS fall FROM k),
u AS (SELECT series_id, lag, c AS w FROM p WHERE c BETWEEN {LEAST}::DOUBLE AND 1 AND (abs(lag) < {MOST_LAG - 1} OR over = 1 AND fall >= 0)),
a AS (SELECT series_id, w, t, CASE WHEN t + lag < 0 THEN -1 - t - lag WHEN t + lag > 63 THEN 127 - t - lag ELSE t + lag END AS i FROM u, range(64) r(t))
SELECT a.t::INT AS t, {rounds("sum(w * z.v) / sum(w) AS v")} FROM a JOIN z ON z.series_id = a.series_id AND z.t = a.i GROUP BY a.t""")
def reference_rebuilt(spark, sf_dir):
    """The reference after one pass: the mean, by strength, of the series that follow the mean series well, each moved back by its lag in whole samples.
    A peak beside the last lag that has no samples but its neighbours is too narrow to hold."""
    series = embedding_series(spark, sf_dir)
    peaks = refinement.Peaks(MOST_LAG, "None", tapered=False)
    ref = np.asarray(lags.reference_series(series).first()["ref"])
    new = refinement.rebuilt_reference(series, ref, peaks, None, LEAST)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate([] if new is None else new)], "t int, v double"))


@query()
def lag_passes_composed(spark, sf_dir):
    """Three passes with a threshold from surrogates, despeckling and a reference from two components; then every series without the reference at its lag."""
    series, peaks = embedding_series(spark, sf_dir), refinement.Peaks(MOST_LAG)
    found = refinement.composed_passes(series, peaks, grid_map(spark, sf_dir), components=2)
    rows = refinement.regressed(series, found, peaks)
    good = (F.col("flags") == 0) & (F.col("strength") >= found.least)
    return rounded(rows.select("series_id", *refinement.FIT, good.alias("significant"), "slope", "r", S.std_pop(F.col("filtered")).alias("filtered_std")))
