"""Score math (X1-X8) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trestle.functions.memo import plain_args_cache
from trestle.functions.parse import nan_to_null

from trestle.config import (
    GRADE_BOUNDS,
    IMPACT_FACTORS,
    IMPROVEMENT_EXPONENT,
    LINEAR_FACTOR_DEFAULT,
    LINEAR_FACTORS,
    POWER_COEFFICIENTS,
    RATIO_BAND_BOUNDS,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def impact_estimates(score: Column | str) -> dict[str, Column]:
    """score/100 x factor x 100 for cost, schedule and incidents."""
    s = _c(score)
    return {name: (s / 100.0) * factor * 100 for name, factor in IMPACT_FACTORS.items()}


def _safe_pow(score: Column) -> Column:
    # A negative base to a fractional power is not real: null, not NaN.
    return F.when(score >= 0, F.pow(score, F.lit(IMPROVEMENT_EXPONENT)))


@plain_args_cache
def phase_improvement(score: Column | str, phase: str, model: str = "power") -> Column:
    """Cost improvement of one phase's mean score.

    ``power``: k * s^0.4875 * 100 for every phase.
    ``mixed``: power for construction, linear factor x s elsewhere.
    ``helper``: k * (100 s)^0.4875 for construction, linear elsewhere (0.03 for
    an unknown phase) and null score -> 0.
    """
    s = _c(score)
    if model == "power":
        return F.lit(POWER_COEFFICIENTS[phase]) * _safe_pow(s) * 100
    if model == "mixed":
        if phase == "construction":
            return F.lit(POWER_COEFFICIENTS["construction"]) * _safe_pow(s) * 100
        return s * LINEAR_FACTORS[phase]
    if model == "helper":
        if phase == "construction":
            val = F.lit(POWER_COEFFICIENTS["construction"]) * _safe_pow(s * 100)
        else:
            val = s * LINEAR_FACTORS.get(phase, LINEAR_FACTOR_DEFAULT)
        return F.when(s.isNull(), F.lit(0.0)).otherwise(val)
    raise ValueError(f"unknown improvement model {model!r}")


@plain_args_cache
def grade(score: Column | str) -> Column:
    """A>=80, B>=60, C>=40, D>=20, else F; null or NaN -> F."""
    s = _c(score)
    expr = None
    for letter, bound in GRADE_BOUNDS:
        cond = (s >= bound) & ~F.isnan(s)
        expr = F.when(cond, F.lit(letter)) if expr is None else expr.when(cond, F.lit(letter))
    return expr.otherwise(F.lit("F"))


@plain_args_cache
def ratio_band(actual: Column | str, possible: Column | str) -> Column:
    """Band 1..5 of actual/possible at .2/.4/.6/.8; possible 0 or null -> ratio 0."""
    a, p = _c(actual), _c(possible)
    ratio = F.when(p.isNull() | (p == 0), F.lit(0.0)).otherwise(a / p)
    expr = None
    for i, bound in enumerate(RATIO_BAND_BOUNDS, start=1):
        expr = F.when(ratio < bound, F.lit(i)) if expr is None else expr.when(ratio < bound, F.lit(i))
    return expr.otherwise(F.lit(len(RATIO_BAND_BOUNDS) + 1))


@plain_args_cache
def bar_score(score: Column | str) -> Column:
    """Integer part of the score, null -> 0 (horizontal bar)."""
    s = _c(score)
    # try_cast: an infinite or out-of-range score gives 0, never an error
    return F.coalesce(F.when(~F.isnan(s), s.try_cast("long")), F.lit(0).cast("long"))


@plain_args_cache
def meter_score(score: Column | str) -> Column:
    """Score clamped to [0, 100], null -> 0 (circular meter)."""
    s = F.coalesce(nan_to_null(_c(score).try_cast("double")), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(s, F.lit(100.0)))
