"""Closed-form rate-curve and loop-economics expressions (J-15..J-20).

All are column expressions, so a scenario grid of any size is evaluated
inside whole-stage codegen with no Python in the loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import col_

C = str | Column | float


def _c(x: C) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else col_(x)


def curve_rate(u: C, r0: C, uopt: C, slope1: C, slope2: C) -> Column:
    """Kinked borrow-rate curve, forward (J-15):
    below the kink ``r0 + s1*U/Uopt``; above ``r0 + s1 + s2*(U-Uopt)/(1-Uopt)``."""
    u, r0, uopt, s1, s2 = map(_c, (u, r0, uopt, slope1, slope2))
    return F.when(u <= uopt, r0 + s1 * (u / uopt)).otherwise(r0 + s1 + s2 * ((u - uopt) / (F.lit(1.0) - uopt)))


def curve_utilisation(rate: C, r0: C, uopt: C, slope1: C, slope2: C) -> Column:
    """Kinked curve, inverse (J-16): the utilisation that delivers ``rate``."""
    r, r0, uopt, s1, s2 = map(_c, (rate, r0, uopt, slope1, slope2))
    return F.when(r <= r0 + s1, uopt * (r - r0) / s1).otherwise(
        uopt + (F.lit(1.0) - uopt) * (r - r0 - s1) / s2
    )


def curve_branch(rate: C, r0: C, slope1: C) -> Column:
    r, r0, s1 = map(_c, (rate, r0, slope1))
    return F.when(r <= r0 + s1, F.lit("below kink")).otherwise(F.lit("above kink"))


def max_leverage(ltv: C) -> Column:
    """Geometric-series limit of looping at a loan-to-value ``ltv`` (J-17)."""
    return F.lit(1.0) / (F.lit(1.0) - _c(ltv))


def loop_roe(leverage: C, y: C, r: C) -> Column:
    """Return on equity of a loop at leverage L: ``L*y - (L-1)*r`` (J-17)."""
    L, y, r = map(_c, (leverage, y, r))
    return L * y - (L - F.lit(1.0)) * r


def leverage_from_hf(hf: C, lt: C) -> Column:
    """``L = 1 / (1 - LT/HF)`` (J-20)."""
    return F.lit(1.0) / (F.lit(1.0) - _c(lt) / _c(hf))


def hf_from_leverage(leverage: C, lt: C) -> Column:
    """``HF = LT / (1 - 1/L)`` (J-20)."""
    return _c(lt) / (F.lit(1.0) - F.lit(1.0) / _c(leverage))


def indifference_rate(y: C, hurdle: C, leverage: C) -> Column:
    """Borrow rate at which a looper's ROE equals the hurdle (J-19):
    ``r* = y - (h - y) / (L - 1)``."""
    y, h, L = map(_c, (y, hurdle, leverage))
    return y - (h - y) / (L - F.lit(1.0))
