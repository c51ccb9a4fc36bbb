"""Column builders: ids, classification, confidence and the normal distribution."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import QUALITY_STATE_SCORE, QUALITY_WEIGHT, SOURCE_RELIABILITY

# fixed value: commit message categories in matching order
MESSAGE_CATEGORIES = ["feat", "fix", "docs", "refactor", "test", "chore", "ci"]


def value_map(column: Column, mapping: dict, default=None) -> Column:
    """Look up a small constant mapping with a chained ``when``."""
    out = None
    for key, val in mapping.items():
        out = F.when(column == key, val) if out is None else out.when(column == key, val)
    return out.otherwise(F.lit(default))


def observation_id(source_type: Column, source_id: Column, metric_id: Column) -> Column:
    """First 16 hex digits of SHA-256 over ``type:source:metric``."""
    payload = F.concat_ws(":", source_type, source_id, metric_id)
    return F.substring(F.sha2(payload, 256), 1, 16)


def classify_message(message: Column) -> Column:
    """Conventional-commit category of a message, ``other`` if none fits."""
    text = F.lower(F.trim(F.regexp_replace(message, r"^\s+|\s+$", "")))
    out = F
    for name in MESSAGE_CATEGORIES:
        out = out.when(text.rlike(rf"^{name}!?[\s(:]"), name)
    return out.otherwise("other")


def observation_confidence(
    source_type: Column, quality: Column, cross_validated: Column, in_range: Column, documented: Column
) -> Column:
    """Weighted sum of five quality factors of one observation, within [0, 1]."""
    score = (
        0.3 * value_map(source_type, SOURCE_RELIABILITY, 0.5)
        + 0.25 * F.when(cross_validated, 1.0).otherwise(0.0)
        + 0.2 * F.when(in_range, 1.0).otherwise(0.0)
        + 0.15 * F.when(documented, 1.0).otherwise(0.3)
        + 0.1 * value_map(quality, QUALITY_WEIGHT, 0.5)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def quality_score(state: Column) -> Column:
    return value_map(F.upper(state), QUALITY_STATE_SCORE, 0.0)


def hours_between(start: Column, end: Column) -> Column:
    """Signed hours from ``start`` to ``end`` with microsecond precision."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


# ---- normal distribution ------------------------------------------------------
# fixed values: Abramowitz and Stegun formula 7.1.26, absolute error below 1.5e-7
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
CLAMP = 1e-10


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / F.lit(2.0**0.5)))


def z_to_p(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "two-sided":
        return 2.0 * (1.0 - normal_cdf(F.abs(z)))
    return 1.0 - normal_cdf(z) if alternative == "greater" else normal_cdf(z)


def steady(spread: Column, value: str = "value") -> Column:
    """A variance or deviation aggregate that is exactly 0 where all values are equal.

    Merging partial moments leaves rounding noise above 0, from a few hundred thousand equal values on.
    """
    return F.when(F.min(value) == F.max(value), spread * 0.0).otherwise(spread)


def quantile(p: float) -> float:
    """Standard normal quantile of a constant, computed once when the plan is built."""
    return NormalDist().inv_cdf(p)


def clamp_r(r: Column) -> Column:
    return F.greatest(F.lit(-1.0 + CLAMP), F.least(F.lit(1.0 - CLAMP), r))


def fisher_z(r: Column) -> Column:
    c = clamp_r(r)
    return 0.5 * F.log((1.0 + c) / (1.0 - c))


def fisher_z_inverse(z: Column) -> Column:
    return F.tanh(z)


# fixed values: Acklam's rational approximation of the normal quantile (published
# coefficients, relative error below 1.2e-9)
ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00]
ACKLAM_LOW = 0.02425


def _horner(coefs: list[float], x: Column, tail: float | None = None) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:] + ([tail] if tail is not None else []):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF of a column, for p strictly between 0 and 1."""
    lo = F.sqrt(-2.0 * F.log(p))
    hi = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    return (
        F.when(p < ACKLAM_LOW, _horner(ACKLAM_C, lo) / _horner(ACKLAM_D, lo, 1.0))
        .when(p > 1 - ACKLAM_LOW, -_horner(ACKLAM_C, hi) / _horner(ACKLAM_D, hi, 1.0))
        .otherwise(_horner(ACKLAM_A, r) * q / _horner(ACKLAM_B, r, 1.0))
    )
