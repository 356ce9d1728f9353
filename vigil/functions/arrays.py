"""Features of a window given as an array column, as JVM-side array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:  # noqa: ANN001
    """f(value), with value computed once: an expression inside a lambda is computed for every element otherwise."""
    return F.transform(F.array(value), f)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def mean_abs(v: Column) -> Column:
    return total(F.transform(v, F.abs)) / F.size(v)


def moment(v: Column, m: Column, k: int) -> Column:
    """Mean k-th power of the distances from ``m``."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + reduce(lambda p, _: p * (x - m), range(k - 1), x - m)) / F.size(v)


def variance(v: Column) -> Column:
    return let(mean(v), lambda m: moment(v, m, 2))


def rms(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.size(v))


def skewness(v: Column) -> Column:
    """Population form; 0 without spread."""
    with_mean = lambda m: let(moment(v, m, 2), lambda s: F.when(s > 0, moment(v, m, 3) / F.pow(s, 1.5)).otherwise(0.0))
    return let(mean(v), with_mean)


def kurtosis(v: Column) -> Column:
    """Excess, population form; 0 without spread."""
    with_mean = lambda m: let(moment(v, m, 2), lambda s: F.when(s > 0, moment(v, m, 4) / (s * s) - 3).otherwise(0.0))
    return let(mean(v), with_mean)


def skewness_corrected(v: Column, floor: float = 1e-12) -> Column:
    n = F.size(v)
    return F.when(variance(v) <= floor, 0.0).otherwise(skewness(v) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def kurtosis_corrected(v: Column, floor: float = 1e-12) -> Column:
    n = F.size(v)
    return F.when(variance(v) <= floor, 0.0).otherwise((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * kurtosis(v) + 6.0))


def neighbours(v: Column, f) -> Column:  # noqa: ANN001
    """f(x[i], x[i + 1]) for all i."""
    return F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), f)


def sign_change_rate(v: Column) -> Column:
    """Share of steps at which the sign differs; through zero counts."""
    return mean(neighbours(v, lambda a, b: F.when(F.signum(a) != F.signum(b), 1.0).otherwise(0.0)))


def crossing_rate(v: Column) -> Column:
    """Share of steps with values on strictly different sides of zero."""
    return mean(neighbours(v, lambda a, b: F.when(a * b < 0, 1.0).otherwise(0.0)))


def mean_squared_step(v: Column) -> Column:
    return mean(neighbours(v, lambda a, b: (b - a) * (b - a)))


def quantile(v: Column, q: float) -> Column:
    """Linear between order statistics."""
    h = (F.size(v) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")

    def between(s: Column) -> Column:
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return a + (b - a) * (h - lo)

    # sort_array compares inside the JVM; array_sort would call a lambda for each comparison
    return let(F.sort_array(v), between)


def median(v: Column) -> Column:
    return quantile(v, 0.5)


def noise_floor(v: Column) -> Column:
    """Median absolute deviation of the steps, scaled to a standard deviation, over root two."""
    around = lambda d: let(median(d), lambda m: median(F.transform(d, lambda x: F.abs(x - m))))
    return let(neighbours(v, lambda a, b: b - a), around) * (1.4826 / 2**0.5)


def segment_means(v: Column, parts: int) -> Column:
    """Means of equal segments; what is left over at the end is dropped."""
    n = F.floor(F.size(v) / parts).cast("int")
    return F.array(*[mean(F.slice(v, n * i + 1, n)) for i in range(parts)])


def baseline_stability(v: Column, parts: int) -> Column:
    return F.sqrt(let(segment_means(v, parts), variance))


def log_snr(v: Column) -> Column:
    return let(noise_floor(v), lambda f: F.log10(variance(v) / F.greatest(f * f, F.lit(1e-12)) + 1e-12))


def change_rate(v: Column) -> Column:
    """Share of samples that differ from the one before."""
    return mean(neighbours(v, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))


def flat_fraction(v: Column) -> Column:
    return mean(neighbours(v, lambda a, b: F.when(a == b, 1.0).otherwise(0.0)))


def largest_step(v: Column) -> Column:
    return F.array_max(neighbours(v, lambda a, b: F.abs(b - a)))


def run_lengths(v: Column) -> Column:
    """Lengths of runs of equal samples, in order."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        runs = acc["runs"]
        n = F.size(runs)
        longer = F.concat(F.slice(runs, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.get(runs, n - 1) + 1))
        return F.struct(x.alias("last"), F.when(acc["last"].eqNullSafe(x) & (n > 0), longer).otherwise(F.concat(runs, F.array(F.lit(1)))).alias("runs"))

    return F.aggregate(v, start, step)["runs"]


def linearity(v: Column) -> Column:
    """Squared correlation of the samples with their index; 1 without spread."""
    n = F.size(v)
    sxx = n * (n * n - 1.0) / 12.0

    def fit(m: Column) -> Column:
        c = (n - 1) / F.lit(2.0)
        sxy = total(F.transform(v, lambda x, i: (x - m) * (i - c)))
        syy = moment(v, m, 2) * n
        return F.when(syy > 0, sxy * sxy / (sxx * syy)).otherwise(1.0)

    return let(mean(v), fit)


def allan_deviation(v: Column, m: int, fs: float = 1.0) -> Column:
    """Overlapping Allan deviation for clusters of ``m`` samples at ``fs`` a second, from second differences of the running sum."""
    n = F.size(v) - 2 * m + 1
    sums = F.aggregate(v, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    squares = lambda s: total(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pow((F.get(s, i + 2 * m) - 2 * F.get(s, i + m) + F.get(s, i)) / m, 2.0)))
    return F.sqrt(let(sums, squares) / (2.0 * n))


def power_spectrum(v: Column, n: int) -> Column:
    """|X_k|^2 for k = 0 .. n/2 of a window of ``n`` samples, by the definition of the transform.

    Twiddle factors are constants, one array of n values; index k * j modulo n picks them.
    """
    import math

    cos = F.lit([math.cos(2 * math.pi * i / n) for i in range(n)])
    sin = F.lit([math.sin(2 * math.pi * i / n) for i in range(n)])
    index = F.sequence(F.lit(0), F.lit(n - 1))

    def one(k: Column) -> Column:
        re = total(F.zip_with(v, index, lambda x, j: x * F.get(cos, (k * j) % n)))
        im = total(F.zip_with(v, index, lambda x, j: x * F.get(sin, (k * j) % n)))
        return re * re + im * im

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), one)
