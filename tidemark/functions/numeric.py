"""Small numeric helpers that Spark lacks: Kolmogorov-Smirnov, F and chi-square tails, hashed draws."""

from __future__ import annotations

import math

import numpy as np


def ks_exact_pvalues(n: int, m: int) -> tuple[float, ...]:
    """P(D >= k / lcm(n, m)) for k = 0.. of the two-sample statistic, by counting lattice paths.

    A path from (0, 0) to (n, m) stays below distance d when |i/n - j/m| < d at every point; the
    counts are kept as probabilities so they cannot overflow.
    """
    lcm = n * m // math.gcd(n, m)
    out = [1.0]
    for k in range(1, lcm + 1):
        inside = np.zeros(m + 1)
        for i in range(n + 1):
            row = np.zeros(m + 1)
            for j in range(m + 1):
                if abs(i * (lcm // n) - j * (lcm // m)) >= k:
                    continue
                if i == 0 and j == 0:
                    row[j] = 1.0
                    continue
                left = row[j - 1] * (m - j + 1) / (n + m - i - j + 1) if j else 0.0
                down = inside[j] * (n - i + 1) / (n + m - i - j + 1) if i else 0.0
                row[j] = left + down
            inside = row
        out.append(max(0.0, 1.0 - float(inside[m])))
    return tuple(out)


def ks_statistic(a: np.ndarray, b: np.ndarray) -> float:
    """Largest gap between two empirical distribution functions."""
    a, b = np.sort(a), np.sort(b)
    at = np.concatenate([a, b])
    return float(np.max(np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for i in range(1, 500):
        for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_cdf(f: float, d1: float, d2: float) -> float:
    """P(F <= f) with d1 and d2 degrees of freedom."""
    return beta_cdf(d1 * f / (d1 * f + d2), d1 / 2.0, d2 / 2.0) if f > 0 else 0.0


def chi2_sf(x: float, k: float) -> float:
    """P(chi-square with k degrees of freedom > x)."""
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for the lower tail
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b = z + 1 - a  # continued fraction for the upper tail
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def fisher_combine(pvalues) -> float:
    """Fisher's combined p-value of independent tests."""
    p = np.clip(np.asarray(pvalues, dtype=float), 1e-300, 1.0)
    return chi2_sf(float(-2.0 * np.log(p).sum()), 2.0 * len(p))


def splitmix_uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform draws in [0, 1) from integer ids (splitmix64 finaliser), the same on every machine."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
