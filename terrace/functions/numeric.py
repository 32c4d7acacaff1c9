"""Numeric functions as Column expressions: similarity, transforms, the normal distribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def log_shifted(x: Column, least: Column) -> Column:
    """Natural log, of x - least + 1 where the column's least value isn't positive."""
    return F.when(least > 0, F.log(x)).otherwise(F.log1p(x - least))


def sqrt_shifted(x: Column, least: Column) -> Column:
    """Square root, of x - least where the column's least value is negative."""
    return F.sqrt(F.when(least < 0, x - least).otherwise(x))


def z_score(x: Column, mean: Column, deviation: Column, floor: float = 1e-8) -> Column:
    return (x - mean) / (deviation + F.lit(floor))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: a rational approximation, good to 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, by rational approximation (error below 1.2e-9), p clipped to [.001, .999]."""
    p = F.greatest(F.least(p, F.lit(0.999)), F.lit(0.001))

    def ratio(x: Column, top: tuple[float, ...], bottom: tuple[float, ...]) -> Column:
        a, b = F.lit(top[0]), F.lit(bottom[0])
        for c in top[1:]:
            a = a * x + c
        for c in bottom[1:]:
            b = b * x + c
        return a / b

    # Coefficients of the rational approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    q = p - 0.5
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when(p < 0.02425, ratio(low, c, d)).when(p > 1 - 0.02425, -ratio(high, c, d)).otherwise(q * ratio(q * q, a, b))


def place_among(known: Column, most: int, before: Callable[[Column], Column], then: Callable[[Column], Column] | None = None) -> Column:
    """How many of the first values of an ordered array pass ``before``, which none after them does: found by halving.

    ``most`` is the array's greatest length, so a value is compared about log2(``most``) times and not with all of them.
    ``then`` makes the result of that number, which is found once.
    """
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(most, 1).bit_length()))])
    n = F.size(known)
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & F.coalesce(before(F.get(known, at + s - 1)), F.lit(False)), at + s).otherwise(at), then)
