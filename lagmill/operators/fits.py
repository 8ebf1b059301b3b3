"""Peak fits of correlograms in several ways, with stable flags for what went wrong at the start and in the fit."""

from __future__ import annotations

from collections.abc import Callable
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K

#: Flags of a fit, the first six for its start, the others for its result.
FLAGS = {
    "init_amp_low": 0x0001, "init_amp_high": 0x0002, "init_width_low": 0x0004, "init_width_high": 0x0008, "init_lag_low": 0x0010, "init_lag_high": 0x0020,
    "fit_amp_low": 0x0100, "fit_amp_high": 0x0200, "fit_width_low": 0x0400, "fit_width_high": 0x0800, "fit_lag_low": 0x1000, "fit_lag_high": 0x2000,
    "fit_algorithm": 0x4000,
}
KINDS = ("None", "quad", "fastquad", "COM", "fastgauss", "gauss")
#: The width that a centre of mass is given, and how far under the top a parabola's points reach.
COM_WIDTH, QUAD_DROP = 10.0, 0.05


def peak_fits(kind: str, step: float, lag_range: tuple[float, float], amp: tuple[float, float] = (0.0, 1.0), width: tuple[float, float] = (0.1, 100.0), share: float = 0.5, zero_bad: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Kernel: per correlogram (odd length, lag 0 in the middle) lag, strength, width and flags of its highest inner peak.

    None takes the highest sample; fastquad the parabola through it and its neighbours; COM the centre of mass of five samples; fastgauss mean, spread
    and top of the peak's samples; quad a least-squares parabola through them; gauss a least-squares Gaussian. A peak's samples go
    out from the top while the curve falls and stays over `share` of the top (quad: within QUAD_DROP of it). Out-of-range values set a flag and
    are moved to the range's end, or all three become 0 with zero_bad.
    """
    if kind not in KINDS:
        raise ValueError(f"no peak fit {kind!r}")
    scale = 1 / (2 * sqrt(-log(share)) * sqrt(2))

    def run(c: np.ndarray) -> np.ndarray:
        rows, n = np.arange(len(c)), c.shape[1]
        x, index = (np.arange(n) - n // 2) * step, np.arange(n)[None, :]
        k = c[:, 1:-1].argmax(axis=1) + 1
        top, flags = c[rows, k], np.zeros(len(c), np.int64)
        if kind in ("fastquad", "COM"):
            left, right = np.maximum(1, k - 2), np.minimum(n - 2, k + 2)
        else:
            over = c > ((top - QUAD_DROP) if kind == "quad" else share * top)[:, None]
            over[:, [0, -1]] = False
            slope = np.gradient(c, axis=1)
            stop_right = (index > np.minimum(n - 2, k + 1)[:, None]) & ~(over & (slope <= 0))
            stop_left = (index < np.maximum(1, k - 1)[:, None]) & ~(over & (slope >= 0))
            right = np.minimum(n - 2, np.where(stop_right, index, n).min(axis=1) - 1)
            left = np.maximum(1, np.where(stop_left, index, -1).max(axis=1) + 1)
        use = ((index >= left[:, None]) & (index <= right[:, None])).astype(float)
        sigma = (right - left + 1) * step * scale
        narrow = right - left < 2
        sigma = np.where(narrow, 3 * step * scale, sigma)
        reach = 0.75 * (lag_range[1] - lag_range[0]) + step
        for name, bad in (("init_lag_low", x[k] < lag_range[0] - reach), ("init_lag_high", x[k] > lag_range[1] + reach), ("init_width_high", sigma > width[1]),
                          ("init_width_low", narrow), ("init_amp_low", (top < amp[0]) | (top < 0)), ("init_amp_high", top > amp[1])):
            flags |= FLAGS[name] * bad
        lag, high = x[k].astype(float), np.clip(top, 0, amp[1])
        sigma = np.minimum(sigma, width[1])
        mass = (c * use).sum(axis=1)
        safe = np.where(np.abs(mass) > 1e-300, mass, 1)
        if kind == "COM":
            lag, sigma = (c * use * x).sum(axis=1) / safe, np.full(len(c), COM_WIDTH)
        elif kind == "fastgauss":
            lag = (c * use * x).sum(axis=1) / safe
            sigma, high = np.sqrt(np.abs((c * use * (x[None, :] - lag[:, None]) ** 2).sum(axis=1) / safe)), top
        elif kind == "fastquad":
            a, b = (c[rows, k - 1] + c[rows, k + 1]) / 2 - top, (c[rows, k + 1] - c[rows, k - 1]) / 2
            flat = np.abs(a) < 1e-12
            shift = np.where(flat, 0, -b / (2 * np.where(flat, 1, a)))
            lag, high, sigma = x[k] + shift * step, top + b * shift + a * shift**2, 1 / np.maximum(np.abs(a), 1e-12)
        elif kind == "quad":
            d = (x[None, :] - x[k][:, None]) / step
            powers = np.stack([np.ones_like(d), d, d * d], axis=2) * use[:, :, None]
            normal = np.einsum("bti,btj->bij", powers, powers)
            normal[narrow] = np.eye(3)  # two samples bear no parabola
            p = np.linalg.solve(normal, np.einsum("bti,bt->bi", powers, c)[:, :, None])[:, :, 0]
            flat = narrow | (np.abs(p[:, 2]) < 1e-12)
            flags |= FLAGS["fit_algorithm"] * flat
            shift = np.where(flat, 0, -p[:, 1] / (2 * np.where(flat, 1, p[:, 2])))
            lag, high, sigma = x[k] + shift * step, p[:, 0] + p[:, 1] * shift + p[:, 2] * shift**2, step**2 / np.maximum(np.abs(p[:, 2]), 1e-12)
            lag, high, sigma = lag * ~flat, high * ~flat, sigma * ~flat
        elif kind == "gauss":
            fit = K.gaussian_fit(c, x, use, np.column_stack([high, lag, sigma]), step)
            lost = ~np.isfinite(fit).all(axis=1)
            flags |= FLAGS["fit_algorithm"] * lost
            high, lag, sigma = np.where(lost[:, None], 0, fit).T
        bad = np.zeros(len(c), bool)
        if kind != "None":
            for name, value, edge, sign in (("fit_amp_low", high, 0.0, -1), ("fit_amp_high", np.abs(high), 1.0001, 1), ("fit_lag_low", lag, lag_range[0], -1),
                                            ("fit_lag_high", lag, lag_range[1], 1), ("fit_width_high", sigma, width[1], 1), ("fit_width_low", sigma, width[0], -1)):
                out = sign * value > sign * edge
                flags |= FLAGS[name] * out
                bad |= out
            high, lag, sigma = np.clip(high, 0, 1.0), np.clip(lag, *lag_range), np.clip(sigma, *width)
        if zero_bad:
            keep = (flags == 0) & ~bad
            lag, high, sigma = lag * keep, high * keep, sigma * keep
        return np.column_stack([lag, high, sigma, flags])

    return run


def fit_all(corr: DataFrame, kinds: tuple[str, ...], step: float, lag_range: tuple[float, float], **options) -> DataFrame:
    """corr (series_id, corr) -> series_id, kind, lag, strength, width, flags for each kind of fit; a row's fits are made side by side."""
    rows = corr.select("series_id", *(K.by_batch(peak_fits(k, step, lag_range, **options), F.col("corr")).alias(f"_{k}") for k in kinds))
    one = lambda k: F.struct(F.lit(k).alias("kind"), *(F.get(f"_{k}", F.lit(i)).alias(n) for i, n in enumerate(("lag", "strength", "width"))), F.get(f"_{k}", F.lit(3)).cast("int").alias("flags"))
    return rows.select("series_id", F.explode(F.array(*map(one, kinds))).alias("f")).select("series_id", "f.*")
