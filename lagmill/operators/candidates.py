"""Choosing among candidate delays on a grid: unwrapping along the surest neighbours, and conditional modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.operators import forests
from lagmill.operators.flow import TOUCHING
from lagmill.operators.grids import AXES, neighbors
from lagmill.sources.tables import discard, materialize

#: Digits to which sums of differences are compared: between two middle neighbours all values are equally good, but for rounding.
DIGITS = 9


def confidence() -> Column:
    """How far a cell's best amplitude stands above its second best; the best alone if there is one only."""
    return F.get("amps", F.lit(0)) - F.coalesce(F.get("amps", F.lit(1)), F.lit(0.0))


def nearest(lags: Column, value: Column) -> Column:
    """Place of the candidate nearest to a value, the first of equals."""
    far = F.transform(lags, lambda c: F.abs(c - value))
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def with_candidates(peaks: DataFrame, cells: DataFrame) -> DataFrame:
    """cells (series_id, x, y, z) as id, x, y, z, lags and amps: its peaks (series_id, rank, lag, amp) by rank. Without a peak both are empty."""
    per = peaks.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("rank", "lag", "amp"))).alias("p"))  # a few a series
    rows = cells.join(per, "series_id", "left")
    pick = lambda n: F.coalesce(F.transform("p", lambda q: q[n].cast("double")), F.array().cast("array<double>")).alias(n + "s")
    return rows.select(F.col("series_id").alias("id"), *AXES, pick("lag"), pick("amp"))


def unwrapped(cells: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), most_delta: float = 0.0) -> DataFrame:
    """cells (id, x, y, z, lags, amps: candidates of each cell, strongest first; optionally gx, gy, gz, the delay's predicted change per unit of
    length) as id, tau, changed (not the strongest candidate), confidence and tree (a connected region's cells have one; null without a
    candidate).

    A maximum spanning forest over the 26 neighbours, an edge being as sure as the less sure of its cells, is hung from each region's surest cell,
    which takes its strongest candidate. Every other cell takes the candidate nearest to what its parent's predicts (the same value, moved by
    the mean gradient along the step, by most_delta at most): region growing that always goes on over the surest edge, without its order of
    events. The forest, its orientation and the choices each take a logarithmic number of rounds. Cells without candidates have a null tau and
    part regions; equal confidences go by id, lowest first.
    """
    graded = "gx" in cells.columns
    known = cells.where(F.size("lags") > 0).withColumn("confidence", F.coalesce(confidence(), F.lit(float("-inf"))))
    grad = [F.coalesce(f"g{a}", F.lit(0.0)).alias(f"g{a}") for a in AXES] if graded else []
    known = materialize(known.select("id", *AXES, "lags", "confidence", *grad), "unwrap-cells")
    near = neighbors(known.select("id", *AXES, "confidence"), TOUCHING).where("id < n_id")
    forest, members = forests.spanning_forest(near.select(F.col("id").alias("u"), F.col("n_id").alias("v"), F.least("confidence", "n_confidence").alias("weight")))
    placed = known.join(members, "id", "left").withColumn("tree", F.coalesce("tree", "id"))
    top = placed.groupBy("tree").agg(F.min(F.struct(-F.col("confidence"), F.col("id").alias("top"))).alias("t")).select("tree", F.col("t.top").alias("top"))
    top = materialize(top, "unwrap-tops")
    hung = forests.parents(forest, top.select(F.col("top").alias("id")))
    lone = top.join(hung.select(F.col("id").alias("top")), "top", "left_anti").select(F.col("top").alias("id"), F.col("top").alias("parent"))
    pairs = hung.unionByName(lone).join(known, "id").join(known.select(*(F.col(c).alias(f"p_{c}") for c in known.columns)), F.col("parent") == F.col("p_id"))
    delta = F.lit(0.0)
    if graded:
        for a, s in zip(AXES, sizes, strict=True):
            delta = delta + (F.col(a) - F.col(f"p_{a}")) * s * (F.col(f"g{a}") + F.col(f"p_g{a}")) / 2
        delta = F.least(F.greatest(delta, F.lit(-most_delta)), F.lit(most_delta))
    step = F.transform("p_lags", lambda t: nearest(F.col("lags"), t + F.col("delta")))
    state = forests.handed_down(pairs.withColumn("delta", delta).select("id", "parent", step.alias("step")), F.lit(0))
    chosen = placed.join(state, "id").select("id", F.get("lags", F.col("state")).alias("tau"), (F.col("state") > 0).alias("changed"), "tree")
    rest = cells.select("id", F.when(F.size("amps") > 0, confidence()).alias("confidence"))
    return rest.join(chosen, "id", "left").select("id", "tau", F.coalesce("changed", F.lit(False)).alias("changed"), "confidence", "tree")


def conditional_modes(cells: DataFrame, start: DataFrame, sweeps: int = 2) -> DataFrame:
    """cells (id, x, y, z, lags) and start (id, tau, one of its lags) as id, tau after so many sweeps, or as soon as one changes nothing.

    A Markov random field whose energy is the sum of differences of tau over neighbours (26). The cells of one colour, eight by the parities of x, y
    and z, are no neighbours and change together: each takes the candidate that differs least from its neighbours in sum, its own if that
    is as good, else the first; sums that agree to DIGITS digits are as good as each other. So the energy never rises. A colour is one join of its edges with the current map; cells without a candidate
    take no part and have a null tau.
    """
    known = cells.where(F.size("lags") > 0)
    colour = sum(F.pmod(a, F.lit(2)) * 2**i for i, a in enumerate(AXES))
    edges = neighbors(known.select("id", *AXES), TOUCHING).select("id", "n_id", colour.cast("int").alias("colour"))
    edges = materialize(edges.sortWithinPartitions("colour"), "modes-edges")
    cur = materialize(known.join(start.select("id", "tau"), "id").select("id", "lags", "tau", F.lit(0).alias("changes")), "modes")

    def energy_at(c: Column) -> Column:
        return F.round(F.aggregate("around", F.lit(0.0), lambda s, t: s + F.abs(t - c)), DIGITS)

    for _ in range(sweeps):
        begun = cur.agg(F.sum("changes")).first()[0]
        for k in range(8):
            others = edges.where(F.col("colour") == k).join(cur.select(F.col("id").alias("n_id"), F.col("tau").alias("t")), "n_id")
            around = others.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("around"))  # 26 at most
            costs = F.transform("lags", lambda c: F.struct(energy_at(c).alias("cost"), c.alias("lag")))
            rows = cur.join(around, "id", "left").withColumn("costs", F.when(F.col("around").isNotNull(), costs)).withColumn("now", energy_at(F.col("tau")))
            least = F.array_min(F.transform("costs", lambda c: c["cost"]))
            rows = rows.withColumn("best", F.when(least < F.col("now"), F.get(F.filter("costs", lambda c: c["cost"] == least), F.lit(0))["lag"]))
            new = rows.select("id", "lags", F.coalesce("best", "tau").alias("tau"), (F.col("changes") + F.col("best").isNotNull().cast("int")).alias("changes"))
            new = materialize(new, "modes")
            discard(cur)
            cur = new
        if cur.agg(F.sum("changes")).first()[0] == begun:
            break
    discard(edges)
    return cells.select("id").join(cur.select("id", "tau"), "id", "left")


def field_energy(cells: DataFrame, tau: DataFrame) -> DataFrame:
    """One row: energy, the sum over pairs of neighbours of how much tau (id, tau) differs, and pairs, their number. cells: id, x, y, z."""
    near = neighbors(cells.select("id", *AXES).join(tau.where("tau is not null").select("id", "tau"), "id"), TOUCHING).where("id < n_id")
    return near.agg(F.coalesce(F.sum(F.abs(F.col("tau") - F.col("n_tau"))), F.lit(0.0)).alias("energy"), F.count(F.lit(1)).alias("pairs"))


def resolved(cells: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), most_delta: float = 0.0, sweeps: int = 2, least_change: float = 0.5) -> DataFrame:
    """unwrapped() and then conditional_modes(): id, tau, strongest (its first candidate) and moved (they differ by more than least_change)."""
    grown = materialize(unwrapped(cells, sizes, most_delta).select("id", "tau"), "resolved")
    tau = conditional_modes(cells, grown, sweeps) if sweeps else grown
    strongest = F.get("lags", F.lit(0))
    rows = cells.select("id", strongest.alias("strongest")).join(tau, "id", "left")
    return rows.select("id", "tau", "strongest", F.coalesce(F.abs(F.col("tau") - F.col("strongest")) > least_change, F.lit(False)).alias("moved"))

