"""Column expressions: transforms of probabilities and correlations, angles, bins, p-values."""

from __future__ import annotations

from functools import reduce
from math import exp, factorial, lgamma, log, pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def logit(p) -> Column:
    return F.ln(col(p) / (1 - col(p)))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def kendall_to_pearson(tau) -> Column:
    return F.sin(col(tau) * (pi / 2))


def fisher_z(r) -> Column:
    """atanh; null at and beyond +-1."""
    return F.when(F.abs(col(r)) < 1, 0.5 * F.ln((1 + col(r)) / (1 - col(r))))


def compare_correlations(r1, r2, n1, n2) -> Column:
    """z of the difference of two independent correlations."""
    return (fisher_z(r1) - fisher_z(r2)) / F.sqrt(1 / (col(n1) - 3) + 1 / (col(n2) - 3))


def normal_tail(z) -> Column:
    """Two-sided p of a standard normal, by the rational approximation of erf (absolute error under 1.5e-7)."""
    x = F.abs(col(z)) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def chi2_tail_even(x, half_df: int) -> Column:
    """Upper tail of chi squared with 2 * half_df degrees of freedom."""
    h = col(x) / 2
    total = F.lit(0.0)
    for k in range(half_df):
        total = total + F.pow(h, k) / factorial(k)
    return F.exp(-h) * total


#: Nodes and weights on 0 .. 1 of the quadrature that student_tail uses.
_NODES = [((x + 1) / 2, w / 2) for x, w in zip(*(a.tolist() for a in np.polynomial.legendre.leggauss(64)))]


def gamma_step(n) -> Column:
    """Gamma(n + 1/2) / Gamma(n) for n > 0: Stirling's series at n + 16, stepped down."""
    n, m = col(n), col(n) + 16
    down = reduce(lambda a, i: a * ((n + i) / (n + i + 0.5)), range(16), F.lit(1.0))
    return down * F.sqrt(m) * (1 - 1 / (8 * m) + 1 / (128 * m * m) + 5 / (1024 * F.pow(m, 3)) - 21 / (32768 * F.pow(m, 4)) - 399 / (262144 * F.pow(m, 5)))


def student_tail(t, df) -> Column:
    """Two-sided p of Student's t with any df > 0 degrees of freedom, whole or not; null otherwise.

    With s = sqrt(df) sinh(y) the density is a multiple of cosh(y)^-df, which is integrated over 0 .. asinh(|t| / sqrt(df)) by a
    fixed number of nodes; the range ends where the density is below 1e-18 of its peak. Absolute error below 1e-10 for |t| up to 1e4.
    """
    d = col(df).cast("double")
    a = F.abs(col(t).cast("double")) / F.sqrt(d)
    end = F.least(F.ln(a + F.sqrt(a * a + 1)), 41.5 / d + F.ln(1 + F.sqrt(1 - F.exp(-83 / d))))  # acosh(exp(41.5 / d))
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES])
    # lambdas see nothing but their own variables: a column captured there could be taken for a new one of the same name
    density = lambda v, y: F.exp(-v["d"] * (y + F.log1p(F.exp(-2 * y)) - log(2)))
    area = lambda v: v["end"] * F.aggregate(nodes, F.lit(0.0), lambda sum_, n: sum_ + n["w"] * density(v, v["end"] * n["x"]))
    tail = lambda v: F.greatest(F.lit(0.0), 1 - v["c"] * area(v))
    given = F.struct(d.alias("d"), end.alias("end"), (2 / pi**0.5 * gamma_step(d / 2)).alias("c"))
    return F.when(d > 0, F.transform(F.array(given), tail)[0])


def student_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """student_tail() of arrays of t and whole df above 0, by the same nodes."""
    x, weight = (np.array(a) for a in zip(*_NODES))
    a = np.abs(t) / np.sqrt(df)
    end = np.minimum(np.log(a + np.sqrt(a * a + 1)), 41.5 / df + np.log(1 + np.sqrt(1 - np.exp(-83 / df))))
    each, place = np.unique(df, return_inverse=True)
    c = np.array([2 / pi**0.5 * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) for d in each])[place]
    y = end[:, None] * x
    area = end * (np.exp(-df[:, None] * (y + np.log1p(np.exp(-2 * y)) - log(2))) @ weight)
    return np.maximum(0.0, 1 - c * area)


def rotate(x, y, angle) -> tuple[Column, Column]:
    c, s = F.cos(F.lit(angle) if not isinstance(angle, Column) else angle), F.sin(F.lit(angle) if not isinstance(angle, Column) else angle)
    return col(x) * c + col(y) * s, col(y) * c - col(x) * s


def angle_of(x, y) -> Column:
    """Angle of a vector in 0 .. 2 pi."""
    return F.pmod(F.atan2(col(y), col(x)), F.lit(2 * pi))


def uniform_bin(x, low: float, width: float) -> Column:
    """Left-closed bin number from `low`."""
    return F.floor((col(x) - low) / width).cast("long")


def edge_bin(x, edges: list[float]) -> Column:
    """Number of edges at or below x; 0 below the first."""
    return sum((F.when(col(x) >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")


def hash_pick(key: Column, n) -> Column:
    """Portable pick in 0 .. n - 1 from the first 8 hex digits of md5; the same in other SQL engines."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (n if isinstance(n, Column) else F.lit(n))


def point_in_polygon(x, y, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a fixed ring."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > col(y)) != (F.lit(y2) > col(y))) & (col(x) < (x2 - x1) * (col(y) - y1) / (y2 - y1) + x1)
        inside = inside + F.when(crosses, 1).otherwise(0)
    return inside % 2 == 1
