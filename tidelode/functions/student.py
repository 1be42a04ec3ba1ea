"""Student's t distribution from the regularised incomplete beta function, for numbers and for columns.

The columns are expressions of fixed length: a continued fraction of TERMS pairs of terms, and Newton's iterations
from 0, which rise to the quantile since the distribution function is concave there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelode.schema import let

# Lanczos' coefficients of the logarithm of the gamma function, for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Pairs of terms of the continued fraction: enough for a million degrees of freedom.
TERMS = 400
NEWTON = 40


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def quantile(p: float, df: float) -> float:
    """The t of which P(T <= t) = p."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -quantile(1 - p, df)
    low, high = 0.0, 1.0
    while two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def interval(mean: float, sem: float, n: int, confidence: float = 0.95) -> tuple[float, float] | None:
    if n < 2:
        return None
    half = quantile(0.5 + confidence / 2, n - 1) * sem
    return mean - half, mean + half


def _log_gamma(z: Column) -> Column:
    """For z of 1/2 and more."""
    y = z - 1
    series = sum((c / (y + i) for i, c in enumerate(LANCZOS) if i), F.lit(LANCZOS[0]))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def step(acc: Column, k: Column) -> Column:
        # terms 1, 2, ...: m is half of k, odd and even ones differ
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        n = F.when(k % 2 == 0, even).otherwise(odd)
        d, c = 1 / safe(1 + n * acc["d"]), safe(1 + n / acc["c"])
        return F.struct(d.alias("d"), c.alias("c"), (acc["out"] * d * c).alias("out"))

    start = F.struct(F.lit(1.0).alias("d"), F.lit(1e300).alias("c"), F.lit(1.0).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * TERMS)), start, step)["out"]


def beta_inc_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta of columns."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    direct = x <= (a + 1) / (a + b + 2)
    # one fraction for either side
    swapped = lambda p, q: F.when(direct, p).otherwise(q)
    args = F.struct(swapped(a, b).alias("a"), swapped(b, a).alias("b"), swapped(x, 1 - x).alias("x"))
    tail = let(args, lambda v: _fraction(v["a"], v["b"], v["x"]) / v["a"])
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(swapped(front * tail, 1 - front * tail))


def two_sided_column(t: Column, df: Column) -> Column:
    """P(|T| >= |t|); null for null."""
    args = F.struct(t.cast("double").alias("t"), df.cast("double").alias("n"))
    p = lambda v: beta_inc_column(v["n"] / 2, F.lit(0.5), v["n"] / (v["n"] + v["t"] * v["t"]))
    return F.when(t.isNotNull() & df.isNotNull(), let(args, p))


def quantile_column(p: float, df: Column) -> Column:
    """The t of which P(T <= t) = p, for p of 1/2 and more."""
    n = df.cast("double")
    log_c = _log_gamma((n + 1) / 2) - _log_gamma(n / 2) - 0.5 * F.log(n * math.pi)

    def step(t: Column, c: Column) -> Column:
        density = F.exp(c["c"] - (c["n"] + 1) / 2 * F.log1p(t * t / c["n"]))
        return t + (two_sided_column(t, c["n"]) / 2 - (1 - p)) / density

    fixed = F.struct(n.alias("n"), log_c.alias("c"))
    newton = lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(0.0), lambda t, _: step(t, c))
    return F.when(df.isNotNull(), let(fixed, newton))
