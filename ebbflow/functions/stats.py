"""Scalar distribution functions for p-values (no SciPy available).

The statistics themselves are computed distributed in Spark; these map a
statistic to a p-value, as plain Python functions and as JVM column expressions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_N = NormalDist()
#: Either KS series is exact to double precision with so many terms on its side of λ = 1.
KS_TERMS = 6


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(q: float) -> float:
    return _N.inv_cdf(q)


def _gamma_q(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x): series below a+1, Lentz
    continued fraction above."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(10_000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - gln))
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, dof: float) -> float:
    """P(χ²_dof ≥ x)."""
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)) or dof <= 0:
        return float("nan")
    if dof == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2.0))
    if dof == 2:
        return math.exp(-max(x, 0.0) / 2.0)
    return _gamma_q(dof / 2.0, max(x, 0.0) / 2.0)


def kolmogorov_sf(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample KS p-value with the Stephens small-sample
    correction: λ = (√ne + 0.12 + 0.11/√ne)·D. Q(λ) = 2 Σ (−1)^{j−1} e^{−2j²λ²}
    for λ ≥ 1; below, where that series converges ever more slowly, its dual
    1 − (√(2π)/λ) Σ e^{−(2j−1)²π²/(8λ²)}."""
    if not n1 or not n2:
        return float("nan")
    en = math.sqrt(n1 * n2 / (n1 + n2))
    return kolmogorov_q((en + 0.12 + 0.11 / en) * d)


def kolmogorov_q(lam: float) -> float:
    if lam <= 0.02:  # the dual sum is below 1e-1300
        return 1.0
    if lam < 1:
        total = sum(math.exp(-((2 * j - 1) * math.pi / lam) ** 2 / 8) for j in range(1, KS_TERMS + 1))
        return 1.0 - math.sqrt(2 * math.pi) / lam * total
    return 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * (j * lam) ** 2) for j in range(1, KS_TERMS + 1))


# ------------------------------------------------------- JVM column expressions
def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def erfc_expr(x) -> Column:
    """Complementary error function for x ≥ 0: the positive series
    erf(x) = 2/√π·e^{−x²}·Σ 2ⁿx^{2n+1}/(2n+1)!! below 2, the continued fraction above."""
    x = _col(x)
    half = F.lit(1 / math.sqrt(math.pi)) * F.exp(-x * x)
    series = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0),
                         lambda acc, k: 1 + 2 * x * x / (2 * k + 1) * acc)
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x.cast("double"),
                           lambda acc, k: x + k / 2 / acc)
    return F.when(x < 2, 1 - 2 * x * half * series).otherwise(half / fraction)


def two_sided_norm_p(z) -> Column:
    """P(|N(0,1)| ≥ |z|)."""
    return erfc_expr(F.abs(_col(z)) / math.sqrt(2.0))


def chi2_sf_expr(x, dof) -> Column:
    """P(χ²_dof ≥ x) for whole dof: erfc or exp at dof 1 or 2, then the recurrence
    Q_k = Q_{k−2} + (x/2)^{k/2−1} e^{−x/2}/Γ(k/2)."""
    x, dof = F.greatest(_col(x).cast("double"), F.lit(0.0)), _col(dof).cast("int")
    odd = dof % 2 == 1
    first = F.when(odd, erfc_expr(F.sqrt(x / 2))).otherwise(F.exp(-x / 2))
    term = F.when(odd, F.sqrt(2 * x / math.pi) * F.exp(-x / 2)).otherwise(x / 2 * F.exp(-x / 2))
    start = F.when(odd, 3).otherwise(4)
    steps = F.when(dof >= start, F.sequence(start, dof, F.lit(2))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("q"), term.alias("t")),
                        lambda acc, k: F.struct((acc["q"] + acc["t"]).alias("q"), (acc["t"] * x / k).alias("t")),
                        lambda acc: acc["q"])
    return F.when(dof >= 1, F.least(F.lit(1.0), total))


def ks_p_expr(d, n1, n2) -> Column:
    """``kolmogorov_sf`` as a JVM column expression, so no Python worker is needed."""
    d, n1, n2 = _col(d), _col(n1), _col(n2)
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    dual = sum((F.exp(-F.pow((2 * j - 1) * math.pi / lam, F.lit(2)) / 8) for j in range(1, KS_TERMS + 1)), F.lit(0.0))
    alternating = sum((F.lit((-1.0) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam)
                       for j in range(1, KS_TERMS + 1)), F.lit(0.0))
    return F.when((n1 > 0) & (n2 > 0), F.when(lam <= 0.02, F.lit(1.0)).when(
        lam < 1, 1 - math.sqrt(2 * math.pi) / lam * dual).otherwise(2 * alternating))
