"""Special functions as expressions, to about 1e-12: error function and normal distribution, log gamma, digamma, Lambert W.

Each uses what converges in its range: a series near zero, a continued fraction or an asymptotic series beyond it. Nulls and NaN stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from breakwater.functions.hof import let

_SERIES, _FRACTION, _NEAR = 70, 90, 2.5
#: Arguments from which the asymptotic series of log gamma and digamma hold; smaller ones are raised by steps of 1.
_FAR = 12


def _down(n: int, start: Column, step) -> Column:
    """``step(so far, k)`` for k = n, n - 1, …, 1, from ``start``."""
    return F.aggregate(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), start, step)


def erf(x: Column) -> Column:
    """The error function: its series for small arguments, one less the complement for others."""
    x = x.cast("double")
    return F.when(F.abs(x) < _NEAR, _series(x)).otherwise(F.signum(x) * (1 - _tail(F.abs(x))))


def _series(x: Column) -> Column:
    """2 / sqrt(pi) exp(-x²) Σ 2^k x^(2k+1) / (1·3·…·(2k+1)), by nested multiplication: all terms have one sign, so nothing cancels."""
    nested = _down(_SERIES, F.lit(1.0), lambda s, k: 1 + s * 2 * x * x / (2 * k + 1))
    return 2 / math.sqrt(math.pi) * x * F.exp(-x * x) * nested


def _tail(x: Column) -> Column:
    """exp(-x²) / sqrt(pi) / (x + ½ / (x + 1 / (x + 3/2 / …))), for x of ``_NEAR`` and more."""
    low = F.greatest(x, F.lit(1.0))  # keeps the other range's arguments, whose result is not used, finite
    fraction = _down(_FRACTION, low, lambda s, k: low + k / 2 / s)
    return F.exp(-low * low) / math.sqrt(math.pi) / fraction


def erfc(x: Column) -> Column:
    """1 - erf(x) with full relative accuracy in the upper tail."""
    x = x.cast("double")
    return F.when(x >= _NEAR, _tail(x)).when(x <= -_NEAR, 2 - _tail(-x)).otherwise(1 - _series(x))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, P(X <= x)."""
    return erfc(-x.cast("double") / math.sqrt(2)) / 2


def normal_tail(x: Column) -> Column:
    """P(X > x)."""
    return erfc(x.cast("double") / math.sqrt(2)) / 2


def _raised(x: Column, step) -> Column:
    """(argument raised to ``_FAR`` or more by whole steps, sum of ``step`` of what was passed) as a struct."""
    kind = "struct<x:double,s:double>"
    start = F.struct(x.alias("x"), F.lit(0.0).alias("s")).cast(kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_FAR)), start, lambda a, _: F.when(a["x"] < _FAR, F.struct((a["x"] + 1).alias("x"), (a["s"] + step(a["x"])).alias("s")).cast(kind)).otherwise(a))


#: Even Bernoulli numbers B2 … B16.
_BERNOULLI = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510]


def lgamma(x: Column) -> Column:
    """ln Γ(x) for x > 0 (null for others), by Stirling's series after the argument is raised."""
    x = x.cast("double")

    def of(r: Column) -> Column:
        z = r["x"]
        tail = sum(b / (2 * k * (2 * k - 1)) * F.pow(z, F.lit(1.0 - 2 * k)) for k, b in enumerate(_BERNOULLI, 1))
        return (z - 0.5) * F.ln(z) - z + math.log(2 * math.pi) / 2 + tail - r["s"]

    return F.when(x > 0, let(_raised(x, F.ln), "double", of))


def digamma(x: Column) -> Column:
    """The derivative of ``lgamma`` for x > 0 (null for others)."""
    x = x.cast("double")

    def of(r: Column) -> Column:
        z = r["x"]
        return F.ln(z) - 0.5 / z - sum(b / (2 * k) * F.pow(z, F.lit(-2.0 * k)) for k, b in enumerate(_BERNOULLI, 1)) - r["s"]

    return F.when(x > 0, let(_raised(x, lambda v: 1 / v), "double", of))


def lambert_w(x: Column, steps: int = 24) -> Column:
    """The w >= -1 with w exp(w) = x, for x >= -1/e (null below), by Halley's iteration.

    It starts from the expansion around the branch point for small arguments and from logarithms for large ones.
    """
    x = x.cast("double")
    root = F.sqrt(F.greatest(2 * (math.e * x + 1), F.lit(0.0)))
    log = F.ln(F.greatest(x, F.lit(1.5)))
    start = F.when(x < 1, -1 + root - root * root / 3).otherwise(F.when(x < 3, F.lit(0.9)).otherwise(log - F.ln(F.greatest(log, F.lit(0.5)))))

    def halley(w: Column, _: Column) -> Column:
        def step(e: Column) -> Column:
            off = w * e - x
            slope = e * (w + 1) - (w + 2) * off / (2 * w + 2)
            return F.when((F.abs(w + 1) < 1e-9) | (slope == 0), w).otherwise(w - off / slope)

        return let(F.exp(w), "double", step)

    return F.when(x >= -1 / math.e, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halley))
