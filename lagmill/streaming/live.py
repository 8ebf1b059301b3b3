"""Structured Streaming forms of the frame operators: windows with watermarks, sessions, and a stateful filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_statistics(events: DataFrame, key: str, time: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Per key and sliding window: n, mean, spread and extremes of value; rows later than `late` are dropped, and state with them."""
    frames = events.withWatermark(time, late).groupBy(key, F.window(time, length, slide))
    out = frames.agg(F.count(value).alias("n"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"), F.min(value).alias("v_min"), F.max(value).alias("v_max"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "v_mean", "v_std", "v_min", "v_max")


def rolling_correlation(pairs: DataFrame, key: str, time: str, a: str, b: str, length: str, slide: str, late: str) -> DataFrame:
    """Per key and sliding window the Pearson correlation of a and b."""
    frames = pairs.withWatermark(time, late).groupBy(key, F.window(time, length, slide))
    return frames.agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "r", "n")


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Per key the runs of events without a gap: start, end, n."""
    runs = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def kalman_level(events: DataFrame, key: str, time: str, value: str, process: float, noise: float) -> DataFrame:
    """Per key a local-level Kalman filter over the values in order of time within each batch: key, time, value, level, variance. State is
    two numbers a key."""
    kind = dict(events.dtypes)
    schema = f"{key} {kind[key]}, {time} {kind[time]}, {value} double, level double, variance double"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, var = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames)).sort_values(time, kind="stable")
        levels, variances = [], []
        for v in pdf[value]:
            if level is None:
                level, var = float(v), noise
            else:
                var += process
                gain = var / (var + noise)
                level, var = level + gain * (float(v) - level), (1 - gain) * var
            levels.append(level)
            variances.append(var)
        state.update((level, var))
        yield pd.DataFrame({key: keys[0], time: pdf[time].to_numpy(), value: pdf[value].to_numpy(), "level": levels, "variance": variances})

    rows = events.where(F.col(value).isNotNull()).select(key, time, F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "level double, variance double", "append", GroupStateTimeout.NoTimeout)
