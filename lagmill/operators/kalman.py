"""Kalman filters of waveforms: constant velocity, noise that follows the innovations, and a sum of harmonics of a moving rate.

All series of an Arrow batch step through time together, so a step is a few matrix products over the batch; a series is one row and nothing
is shuffled. A null or NaN sample is predicted and not used. Empty and null series give null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K

# Samples of innovations kept, those a sample is held against, deviations that mark motion, the factor on the noise after
# motion, the share of the innovations' deviation that becomes process noise, and its bounds.
HISTORY, RECENT, MOTION, MOTION_NOISE, FOLLOW, LEAST_PROCESS, MOST_PROCESS = 30, 10, 3.0, 10.0, 0.05, 1e-4, 1e-2

# Amplitudes the harmonics start with, the variance every state starts with, and for one harmonic and for several the
# factors on the process noise of the level, the first amplitude, the other amplitudes, the phase and the rate.
AMPLITUDES, START_VARIANCE = (1.0, 0.2, 0.1), 0.1
ONE_HARMONIC, SEVERAL_HARMONICS = (1.0, 1.0, 1.0, 1.0, 1.0), (0.1, 1.0, 0.5, 2.0, 0.1)


def _velocity(dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Transition of level and slope, and the covariance that noise of the slope's change gives them."""
    push = np.array([dt * dt / 2, dt])
    return np.array([[1.0, dt], [0.0, 1.0]]), np.outer(push, push)


def _corrected(state: np.ndarray, cov: np.ndarray, slope: np.ndarray, innovation: np.ndarray, noise: np.ndarray | float, seen: np.ndarray) -> None:
    """Take the innovations of the rows that are seen into their states and covariances, in place."""
    cross = np.einsum("rij,rj->ri", cov, slope)
    gain = cross * (seen / (np.einsum("ri,ri->r", slope, cross) + noise))[:, None]
    state += gain * np.where(seen, innovation, 0.0)[:, None]
    cov -= gain[:, :, None] * cross[:, None, :]


def velocity_kernel(dt: float, process: float, noise: float, adaptive: bool = False):
    """Kernel: the filtered levels and, after them, 1 where a sample is marked as motion.

    Adaptive: a sample whose innovation is more than MOTION deviations of the RECENT ones before it is motion, and the one after it
    counts with MOTION_NOISE times the noise; once HISTORY innovations are there, their deviation sets the process noise.
    """
    transition, push = _velocity(dt)

    def run(x: np.ndarray) -> np.ndarray:
        rows, n = x.shape
        state, cov = np.zeros((rows, 2)), np.tile(np.eye(2), (rows, 1, 1))
        slope = np.tile([1.0, 0.0], (rows, 1))
        scale, spread = np.full(rows, process), np.full(rows, noise)
        past, count = np.zeros((rows, HISTORY)), np.zeros(rows, int)
        out = np.zeros((rows, 2 * n))
        for t in range(n):
            state = state @ transition.T
            cov = transition @ cov @ transition.T + scale[:, None, None] * push
            seen = ~np.isnan(x[:, t])
            innovation = x[:, t] - state[:, 0]
            _corrected(state, cov, slope, innovation, spread, seen)
            out[:, t] = state[:, 0]
            if adaptive:
                size = np.where(seen, np.abs(innovation), 0.0)
                recent = past[:, -RECENT:].std(axis=1)
                motion = seen & (count >= RECENT) & (recent > 0) & (size > MOTION * recent)
                past = np.where(seen[:, None], np.column_stack([past[:, 1:], size]), past)
                count += seen
                spread = np.where(seen, np.where(motion, MOTION_NOISE * noise, noise), spread)
                scale = np.where(seen & (count >= HISTORY), np.clip(FOLLOW * past.std(axis=1), LEAST_PROCESS, MOST_PROCESS), scale)
                out[:, n + t] = motion
        return out

    return run


def harmonic_kernel(dt: float, rate: float, process: float, noise: float, harmonics: int = 1):
    """Kernel: filtered values, then the rate (cycles a unit of time), then each harmonic's amplitude, at every sample.

    The extended filter's state is level, amplitudes of the harmonics, phase and angular rate; the observation is the level plus the sum
    of amplitude * sin(harmonic * phase), whose derivatives at the predicted state stand in for a linear model.
    """
    order = np.arange(1, harmonics + 1)
    level, first, further, phase, speed = ONE_HARMONIC if harmonics == 1 else SEVERAL_HARMONICS
    drift = process * np.diag([level, first, *[further] * (harmonics - 1), phase, speed])
    transition = np.eye(harmonics + 3)
    transition[-2, -1] = dt
    start = np.array([0.0, *(AMPLITUDES[k] if k < len(AMPLITUDES) else AMPLITUDES[-1] for k in range(harmonics)), 0.0, 2 * np.pi * rate])

    def observed(state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        amplitude, angle = state[:, 1:-2], state[:, -2:-1] * order
        waves = np.sin(angle)
        turn = (amplitude * order * np.cos(angle)).sum(axis=1)
        return state[:, 0] + (amplitude * waves).sum(axis=1), waves, turn

    def run(x: np.ndarray) -> np.ndarray:
        rows, n = x.shape
        state, cov = np.tile(start, (rows, 1)), np.tile(START_VARIANCE * np.eye(len(start)), (rows, 1, 1))
        out = np.empty((rows, harmonics + 2, n))
        for t in range(n):
            state = state @ transition.T
            state[:, -2] %= 2 * np.pi
            cov = transition @ cov @ transition.T + drift
            expected, waves, turn = observed(state)
            slope = np.column_stack([np.ones(rows), waves, turn, np.zeros(rows)])
            _corrected(state, cov, slope, x[:, t] - expected, noise, ~np.isnan(x[:, t]))
            out[:, 0, t], out[:, 1, t], out[:, 2:, t] = observed(state)[0], state[:, -1] / (2 * np.pi), state[:, 1:-2]
        return out.reshape(rows, -1)

    return run


def _part(k: int) -> Column:
    """The k-th stretch, as long as the series, of what a kernel returns."""
    return F.slice("_k", k * F.size("values") + 1, F.size("values"))


def velocity_filtered(series: DataFrame, dt: float, process: float = 1e-3, noise: float = 0.05, adaptive: bool = False) -> DataFrame:
    """series_id, filtered, motion (array of booleans, all false unless adaptive) of a level that moves at a velocity of its own."""
    rows = series.select("series_id", "values", K.by_batch(velocity_kernel(dt, process, noise, adaptive), F.col("values")).alias("_k"))
    return rows.select("series_id", _part(0).alias("filtered"), F.transform(_part(1), lambda m: m > 0).alias("motion"))


def harmonic_filtered(series: DataFrame, dt: float, rate: float, process: float = 1e-3, noise: float = 0.05, harmonics: int = 1) -> DataFrame:
    """series_id, filtered, rate (array, cycles a unit of time) and amplitudes (an array of the series' length a harmonic) of a wave with the
    given number of harmonics whose rate starts at `rate` and moves. Series should have a spread near 1."""
    rows = series.select("series_id", "values", K.by_batch(harmonic_kernel(dt, rate, process, noise, harmonics), F.col("values")).alias("_k"))
    return rows.select("series_id", _part(0).alias("filtered"), _part(1).alias("rate"), F.when(F.col("_k").isNotNull(), F.array(*(_part(2 + k) for k in range(harmonics)))).alias("amplitudes"))
