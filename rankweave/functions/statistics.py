"""Distribution functions as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Abramowitz-Stegun approximation 7.1.26 of the error function.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Coefficients of Acklam's rational approximation of the normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    series = _horner(t, tuple(reversed(ERF_A))) * t
    return F.signum(x) * (F.lit(1.0) - series * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))


def normal_quantile(p: Column) -> Column:
    """The normal quantile; 0 outside (0, 1)."""
    tail = lambda q: _horner(q, ACKLAM_C) / (_horner(q, ACKLAM_D) * q + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    middle = _horner(r, ACKLAM_A) * q / (_horner(r, ACKLAM_B) * r + F.lit(1.0))
    return (
        F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(0.0))
        .when(p < ACKLAM_LOW, tail(F.sqrt(F.lit(-2.0) * F.log(p))))
        .when(p > 1 - ACKLAM_LOW, -tail(F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))))
        .otherwise(middle)
    )


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in cos(theta), theta = atan(t / sqrt(df)).

    Infinite t gives 0, t = 0 gives 1, fewer than one degree of freedom gives 1.
    """
    n = df.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(n.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    odd = n % 2 == 1

    def add(s: Column, k: Column) -> Column:
        up = F.when(odd, k.cast("double") * 2 / (k.cast("double") * 2 + 1)).otherwise((k.cast("double") * 2 - 1) / (k.cast("double") * 2))
        term = s["term"] * cos2 * up
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(odd, (n - 3) / 2).otherwise((n - 2) / 2).cast("int")
    series = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, add)["sum"]
    inside = F.when(odd & (n > 1), F.lit(2 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * series)).when(odd, F.lit(2 / math.pi) * theta).otherwise(F.sin(theta) * series)
    p = F.lit(1.0) - inside
    return F.when((n < 1) | t.isNull(), F.lit(1.0)).when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
