"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Periods per year and the decay per granularity.
PER_YEAR_DAILY, PER_YEAR_WEEKLY, PER_YEAR_MONTHLY = 252, 52, 12
DECAY_DAILY, DECAY_WEEKLY, DECAY_MONTHLY = 0.94, 0.80, 0.60


def finite(x: Column) -> Column:
    """NaN and the infinities become NULL; after this only NULL means missing."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def soft_threshold(u: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.signum(u) * F.greatest(F.abs(u) - t, F.lit(0.0))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(x, lo), hi)


def per_year(median_step: Column) -> Column:
    return (
        F.when(median_step.isNull() | (median_step <= 3.0), F.lit(PER_YEAR_DAILY))
        .when(median_step <= 9.0, F.lit(PER_YEAR_WEEKLY))
        .otherwise(F.lit(PER_YEAR_MONTHLY))
    )


def ewma_default_lambda(periods: Column) -> Column:
    return (
        F.when(periods >= 250, F.lit(DECAY_DAILY))
        .when(periods >= 50, F.lit(DECAY_WEEKLY))
        .otherwise(F.lit(DECAY_MONTHLY))
    )


def annualize(x: Column, periods: Column | float, power: float = 1.0) -> Column:
    """Means and covariances scale with ``periods`` (power 1), volatilities with its root (power 0.5)."""
    periods = periods if isinstance(periods, Column) else F.lit(float(periods))
    return x * F.pow(periods.cast("double"), F.lit(float(power)))


def shrink(x: Column, target: Column, intensity: Column | float) -> Column:
    lam = clip(intensity if isinstance(intensity, Column) else F.lit(float(intensity)), 0.0, 1.0)
    return (F.lit(1.0) - lam) * x + lam * target


def period_return(price: Column, previous: Column, kind: str) -> Column:
    """ln(p/p0) or p/p0 - 1; non-positive ratios and zero divisors give NULL."""
    ratio = F.try_divide(price, previous)
    if kind == "log":
        return F.ln(ratio)
    if kind == "simple":
        return ratio - 1.0
    raise ValueError("kind must be 'log' or 'simple'")
