"""Column builders over ARRAY<DOUBLE> series: row-local, so a whole history is worked on without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal distribution's third quartile, which scales a median absolute deviation to a standard deviation.
MAD_SCALE = 0.6744897501960817


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def moment(a: Column, center: Column, k: int) -> Column:
    """Population moment of order k about center."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(x - center, F.lit(float(k)))) / F.size(a)


def std_pop(a: Column) -> Column:
    return let(mean(a), lambda m: F.sqrt(moment(a, m, 2)))


def median(a: Column) -> Column:
    n = F.size(a)
    return let(F.sort_array(a), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mad(a: Column) -> Column:
    """Median absolute deviation from the median, scaled to a standard deviation."""
    return let(median(a), lambda m: median(F.transform(a, lambda x: F.abs(x - m))) / MAD_SCALE)


def skewness(a: Column) -> Column:
    return let(mean(a), lambda m: moment(a, m, 3) / F.pow(moment(a, m, 2), F.lit(1.5)))


def kurtosis(a: Column) -> Column:
    """Excess kurtosis of the population."""
    return let(mean(a), lambda m: moment(a, m, 4) / F.pow(moment(a, m, 2), F.lit(2.0)) - 3)


def scaled(a: Column, center: Column, spread: Column) -> Column:
    """(a - center) / spread; only centred where spread is zero."""
    return F.transform(a, lambda x: F.when(spread > 0, (x - center) / spread).otherwise(x - center))


def normalize(a: Column, method: str = "stddev") -> Column:
    """One of None (demean), percent, variance, stddev or z, p2p, mad."""
    if method == "None":
        return let(mean(a), lambda m: F.transform(a, lambda x: x - m))
    if method == "percent":
        return let(mean(a), lambda m: F.transform(a, lambda x: F.when(m > 0, x / m - 1).otherwise(x)))
    if method == "variance":
        return let(mean(a), lambda m: let(moment(a, m, 2), lambda v: scaled(a, m, v)))
    if method in ("stddev", "z"):
        return let(mean(a), lambda m: let(F.sqrt(moment(a, m, 2)), lambda s: scaled(a, m, s)))
    if method == "p2p":
        return let(mean(a), lambda m: let(F.array_max(a) - F.array_min(a), lambda s: scaled(a, m, s)))
    if method == "mad":
        return let(median(a), lambda m: let(mad(a), lambda s: scaled(a, m, s)))
    raise ValueError(f"no normalisation {method!r}")


def remove_outliers(a: Column, factor: float = 3.0, zero: bool = True) -> Column:
    """Values farther than factor * mad from the median become zero, or the median."""
    return let(median(a), lambda m: let(mad(a), lambda s: F.transform(a, lambda x: F.when(F.abs(x - m) > factor * s, F.lit(0.0) if zero else m).otherwise(x))))


def taper(n: Column, kind: str = "hamming") -> Column:
    """Window of length n: hamming, hann, blackmanharris or None (ones)."""
    terms = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5), "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168), "None": (1.0,)}[kind]

    def value(k: Column) -> Column:
        out = F.lit(terms[0])
        for i, a in enumerate(terms[1:], 1):
            out = out + F.lit((-1) ** i * a) * F.cos(k.cast("double") * (2 * pi * i) / n)
        return out

    return F.transform(F.sequence(F.lit(0), n - 1), value)


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(product(a, b))


def line(a: Column) -> Column:
    """Least-squares line of a on its index as a struct (slope, at_zero)."""
    n = F.size(a).cast("double")
    k = F.transform(a, lambda x, i: i - (n - 1) / 2)
    slope = let(k, lambda c: dot(c, a) / dot(c, c))
    return let(slope, lambda b: F.struct(b.alias("slope"), (mean(a) - b * (n - 1) / 2).alias("at_zero")))


def detrend(a: Column) -> Column:
    """a less its least-squares line."""
    return let(line(a), lambda f: F.transform(a, lambda x, i: x - f["at_zero"] - f["slope"] * i))


def flatten_outliers(a: Column, most: float) -> Column:
    """a with samples put on its least-squares line where what is left of them beyond it is more than most median deviations from its median."""
    left = lambda f: F.transform(a, lambda x, i: x - f["at_zero"] - f["slope"] * i)
    kept = lambda d: let(normalize(d, "mad"), lambda z: F.zip_with(d, z, lambda x, u: F.when(F.abs(u) > most, 0.0).otherwise(x)))
    return let(line(a), lambda f: let(left(f), lambda d: F.transform(kept(d), lambda x, i: x + f["at_zero"] + f["slope"] * i)))


def corr_normalize(a: Column, detrended: bool = True, window: str = "hamming") -> Column:
    """Detrend, scale, taper, scale and divide by the root of the length: dot products of two such series are Pearson correlations."""
    first = let(detrend(a), lambda d: normalize(d, "z")) if detrended else normalize(a, "z")
    tapered = let(first, lambda z: product(z, taper(F.size(z), window)))
    return let(tapered, lambda w: let(normalize(w, "z"), lambda z: F.transform(z, lambda x: x / F.sqrt(F.size(z).cast("double")))))


def central_difference(a: Column) -> Column:
    """Half the difference of the neighbours; at the first sample half of it less its successor, at the last half of it less its predecessor."""
    n = F.size(a)
    return F.transform(a, lambda x, i: F.when(i == 0, x - F.get(a, i + 1)).when(i == n - 1, x - F.get(a, i - 1)).otherwise(F.get(a, i + 1) - F.get(a, i - 1)) / 2)


def gradient(a: Column) -> Column:
    """Half the difference of the neighbours, one-sided differences at the ends."""
    n = F.size(a)
    return F.transform(
        a, lambda x, i: F.when(i == 0, F.get(a, i + 1) - x).when(i == n - 1, x - F.get(a, i - 1)).otherwise((F.get(a, i + 1) - F.get(a, i - 1)) / 2)
    )


def moving_average(a: Column, box: int) -> Column:
    """Mean over box samples around each, zeros beyond the ends; an even box reaches one farther back."""
    back, ahead = box // 2, (box - 1) // 2
    return F.transform(a, lambda x, i: total(F.slice(a, F.greatest(i - back, F.lit(0)) + 1, F.least(i + ahead, F.size(a) - 1) - F.greatest(i - back, F.lit(0)) + 1)) / box)


def pad(a: Column, n: int, kind: str = "reflect") -> Column:
    """a with n samples more on either side: reflect, zero, cyclic or constant (first and last value)."""
    size = F.size(a)
    if kind == "reflect":
        left, right = F.reverse(F.slice(a, 1, n)), F.reverse(F.slice(a, size - n + 1, F.lit(n)))
    elif kind == "zero":
        left = right = F.array_repeat(F.lit(0.0), n)
    elif kind == "cyclic":
        left, right = F.slice(a, size - n + 1, F.lit(n)), F.slice(a, 1, n)
    elif kind == "constant":
        left, right = F.array_repeat(F.get(a, F.lit(0)), n), F.array_repeat(F.get(a, size - 1), n)
    else:
        raise ValueError(f"no padding {kind!r}")
    return F.concat(left, a, right)


def cross_correlation(a: Column, b: Column, most: int) -> Column:
    """Sums of a(t) * b(t - lag) for lags -most..most: the peak's lag is by how much a comes after b."""
    n = F.size(a)

    def at(lag: Column) -> Column:
        first, count = F.greatest(lag, F.lit(0)), n - F.abs(lag)
        return dot(F.slice(a, first + 1, count), F.slice(b, first - lag + 1, count))

    return F.transform(F.sequence(F.lit(-most), F.lit(most)), at)


def fisher(r: Column) -> Column:
    return 0.5 * F.log((1 + r) / (1 - r))


def t_of_r(r: Column, dof: Column) -> Column:
    return F.when(r >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(dof / (1 - r * r)))


def z_of_r(r: Column, dof: Column) -> Column:
    return F.when(r >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(dof - 3))


def rms(a: Column) -> Column:
    return F.sqrt(dot(a, a) / F.size(a))


def center_of_mass(x: Column, a: Column) -> Column:
    return dot(x, a) / total(a)


def energy_entropy(a: Column) -> Column:
    """Minus the sum of v**2 * log2(v**2), zeros adding nothing."""
    return -F.aggregate(a, F.lit(0.0), lambda s, x: s + F.when(x != 0, x * x * F.log2(x * x)).otherwise(F.lit(0.0)))


def value_index(start: Column, step: Column, n: Column, value: Column) -> Column:
    """Index of the nearest point (half to even) of the axis start + k * step, k < n, ends held."""
    return F.greatest(F.lit(0), F.least(n - 1, F.rint((value - start) / step).cast("int")))


def phase_wrap(phase: Column, centric: bool = True) -> Column:
    """Phase in (-pi, pi], or in [0, 2 pi)."""
    if centric:
        return F.lit(pi) - F.pmod(F.lit(pi) - phase, F.lit(2 * pi))
    return F.pmod(phase, F.lit(2 * pi))


def expanded(values: dict[str, Column], powers: int = 1, derivatives: bool = True) -> dict[str, Column]:
    """Regressors with powers 2 .. powers of each and the gradient of all of them, by name: a, a^2, a_deriv, a^2_deriv."""

    def power(v: Column, k: int) -> Column:
        return F.transform(v, lambda x: F.pow(x, F.lit(float(k))))

    out = values | {f"{name}^{k}": power(v, k) for name, v in values.items() for k in range(2, powers + 1)}
    return out | ({f"{name}_deriv": gradient(v) for name, v in out.items()} if derivatives else {})


def orthogonal(a: Column, b: Column) -> Column:
    """a less its projection on b."""
    return let(dot(a, b) / dot(b, b), lambda f: F.zip_with(a, b, lambda x, y: x - f * y))


def difference_error(n1: Column, n2: Column) -> Column:
    """Standard error of the difference of two Fisher-transformed correlations over n1 and n2 samples."""
    return F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))


def z_of_difference(r1: Column, r2: Column, n1: Column, n2: Column) -> Column:
    return (fisher(r1) - fisher(r2)) / difference_error(n1, n2)


def rise(x: Column, start: Column, amplitude: Column, time: Column) -> Column:
    """Exponential rise from start on towards amplitude."""
    return F.when(x > start, amplitude * (1 - F.exp(-(x - start) / time))).otherwise(F.lit(0.0))


def trapezoid(x: Column, start: Column, amplitude: Column, rise_time: Column, fall_time: Column, top: Column) -> Column:
    """Exponential rise from start on for the top's length, then exponential fall from what was reached."""
    reached = amplitude * (1 - F.exp(-top / rise_time))
    return F.when(x < start, F.lit(0.0)).when(x < start + top, rise(x, start, amplitude, rise_time)).otherwise(reached * F.exp(-(x - start - top) / fall_time))


def sinc_curve(x: Column, height: Column, loc: Column, width: Column, baseline: Column) -> Column:
    """Peak of sin(u) / u with the given full width at half height. 3.790988: twice the u at which it is a half."""
    u = (x - loc) * 3.790988 / width
    return baseline + height * F.when(F.abs(u) > 1e-12, F.sin(u) / u).otherwise(F.lit(1.0))


def gauss_curve(x: Column, height: Column, loc: Column, width: Column) -> Column:
    return height * F.exp(-F.pow((x - loc) / width, F.lit(2.0)) / 2)


def harmonics(phase: Column, amplitudes: list[float], phases: list[float], overall: float = 0.0) -> Column:
    """Sum of amplitudes times cosines of the phase's multiples."""
    return sum((a * F.cos((i + 1) * phase + p + overall) for i, (a, p) in enumerate(zip(amplitudes, phases, strict=True))), F.lit(0.0))


def two_regressors(y: Column, a: Column, b: Column) -> Column:
    """Least squares of y on 1, a and b as a struct (intercept, slope_a, slope_b, r2); collinear regressors give slopes of 0."""
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))

    def solved(u: Column, v: Column, w: Column) -> Column:
        saa, sbb, sab, say, sby, syy = dot(v, v), dot(w, w), dot(v, w), dot(v, u), dot(w, u), dot(u, u)
        sums = F.struct(saa.alias("aa"), sbb.alias("bb"), sab.alias("ab"), say.alias("ay"), sby.alias("by"), syy.alias("yy"))

        def slopes(s: Column) -> Column:
            det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
            ok = det > 1e-12 * s["aa"] * s["bb"]
            fa = F.when(ok, (s["ay"] * s["bb"] - s["by"] * s["ab"]) / det).otherwise(F.lit(0.0))
            fb = F.when(ok, (s["by"] * s["aa"] - s["ay"] * s["ab"]) / det).otherwise(F.lit(0.0))
            return F.struct(fa.alias("a"), fb.alias("b"), s["ay"].alias("ay"), s["by"].alias("by"), s["yy"].alias("yy"))

        return let(let(sums, slopes), lambda f: F.struct(
            (mean(y) - f["a"] * mean(a) - f["b"] * mean(b)).alias("intercept"), f["a"].alias("slope_a"), f["b"].alias("slope_b"),
            F.when(f["yy"] > 0, (f["a"] * f["ay"] + f["b"] * f["by"]) / f["yy"]).otherwise(F.lit(0.0)).alias("r2")))

    return let(centred(y), lambda u: let(centred(a), lambda v: let(centred(b), lambda w: solved(u, v, w))))
