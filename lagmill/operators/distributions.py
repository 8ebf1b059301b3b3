"""Bounded distributions fitted to null statistics by four exact quantiles, thresholds and p-values from them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.operators import quantiles

#: Normal deviates whose quantiles fix a fit: -3, -1, 1 and 3 times this.
DEVIATE = 0.5244005127080407
#: -log10(p) at which the table of a fit has a threshold, for interpolation.
LEVELS = tuple(k / 4 for k in range(1, 17))


def _share(z: float) -> float:
    return NormalDist().cdf(z)


def johnson_fits(values: DataFrame, keys: list[str], value: str, z: float = DEVIATE) -> DataFrame:
    """Johnson SB distribution of each group's values: keys, gamma, delta, xi and lam, of which (x - xi) / lam lies in (0, 1) and
    gamma + delta * log((x - xi) / (xi + lam - x)) is normal. Null numbers where the quantiles speak against a bounded distribution.

    Four equally spaced normal deviates and the values' exact quantiles at them determine the four numbers in closed form; nothing iterates
    and no group's rows meet in one task. Null values don't count.
    """
    marks = {"a": -3 * z, "b": -z, "c": z, "d": 3 * z}
    shares = {n: _share(v) for n, v in marks.items()}
    found = quantiles.nearest_rank(values, keys, value, list(shares.values()))
    pick = lambda n: F.max(F.when(F.col("fraction") == shares[n], F.col(value))).alias(n)
    q = found.groupBy(*keys).agg(*map(pick, marks))
    m, n, p = F.col("d") - F.col("c"), F.col("b") - F.col("a"), F.col("c") - F.col("b")
    q = q.select(*keys, "b", "c", m.alias("m"), n.alias("n"), p.alias("p")).withColumn("ok", (F.col("m") > 0) & (F.col("n") > 0) & (F.col("m") * F.col("n") < F.col("p") * F.col("p")))
    up, down = F.try_divide("p", "m"), F.try_divide("p", "n")
    both, over = (1 + up) * (1 + down), up * down - 1
    rows = q.select(*keys, "b", "c", "p", "ok", up.alias("up"), down.alias("down"), both.alias("both"), over.alias("over"))
    lam = F.col("p") * F.sqrt(F.pow(F.col("both") - 2, F.lit(2.0)) - 4) / F.col("over")
    delta = z / F.acosh(F.sqrt("both") / 2)
    lean = F.col("down") - F.col("up")
    gamma = delta * F.asinh(lean * F.sqrt(F.col("both") - 4) / (2 * F.col("over")))
    xi = (F.col("b") + F.col("c")) / 2 - lam / 2 + F.col("p") * lean / (2 * F.col("over"))
    return rows.select(*keys, *(F.when(F.col("ok"), c).alias(k) for k, c in (("gamma", gamma), ("delta", delta), ("xi", xi), ("lam", lam))))


def at_share(share: float) -> Column:
    """The value of a fit (gamma, delta, xi, lam) below which a share of the distribution lies."""
    return F.col("xi") + F.col("lam") / (1 + F.exp((F.col("gamma") - NormalDist().inv_cdf(share)) / F.col("delta")))


def thresholds(values: DataFrame, keys: list[str], value: str, shares: list[float], z: float = DEVIATE) -> DataFrame:
    """keys, share, from_data (the exact value at nearest rank) and from_fit (the fitted distribution's), side by side."""
    fits = johnson_fits(values, keys, value, z)
    fitted = fits.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("share"), at_share(s).alias("from_fit")) for s in shares))).alias("t")).select(*keys, "t.*")
    exact = quantiles.nearest_rank(values, keys, value, shares).select(*keys, F.col("fraction").alias("share"), F.col(value).alias("from_data"))
    return exact.join(fitted, [*keys, "share"])


def with_significance(values: DataFrame, fits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """values with neg_log_p: -log10 of the share of their group's fit beyond them, interpolated between thresholds at LEVELS; 0 below the first
    and the last level above the last. fits has one row a group; null without a fit."""
    table = F.array(F.struct(F.lit(float("-inf")).alias("x"), F.lit(0.0).alias("level")), *(F.struct(at_share(1 - 10**-k).alias("x"), F.lit(k).alias("level")) for k in LEVELS))
    rows = values.join(fits.select(*keys, F.when(F.col("lam").isNotNull(), table).alias("_t")), keys, "left")
    below = F.filter("_t", lambda t: t["x"] <= F.col(value))
    rows = rows.withColumn("_at", F.get(below, F.size(below) - 1)).withColumn("_next", F.get("_t", F.size(below)))
    part = (F.col(value) - F.col("_at.x")) / (F.col("_next.x") - F.col("_at.x"))
    level = F.when(F.col("_at.level") == 0, 0.0).when(F.col("_next").isNull(), F.col("_at.level")).otherwise(F.col("_at.level") + part * (F.col("_next.level") - F.col("_at.level")))
    return rows.withColumn("neg_log_p", level).drop("_t", "_at", "_next")
