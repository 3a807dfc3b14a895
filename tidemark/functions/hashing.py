"""Seeded per-row randomness: the same row and salt give the same draw under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import let


def hash_uniform(ident: Column, salt) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of md5(ident ':' salt)."""
    salt = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat(ident.cast("string"), F.lit(":"), salt.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_normal(ident: Column, salt: str) -> Column:
    """Standard normal draw by Box-Muller on two independent salts."""
    u1 = F.greatest(hash_uniform(ident, f"{salt}:r"), F.lit(1e-12))
    u2 = hash_uniform(ident, f"{salt}:a")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def poisson_range(lam: float) -> tuple[int, int]:
    """First and last count that a 32-bit uniform draw can meet: 12 deviations and 30 to either side of the rate."""
    reach = 12 * math.sqrt(lam) + 30
    return max(0, math.floor(lam - reach)), math.ceil(lam + reach)


def poisson_cdf(lam: float, tail: float = 1e-12) -> list[float]:
    """Cumulative probabilities P(X <= k) from the first count of ``poisson_range`` until the tail is negligible."""
    cdf, total = [], 0.0
    first, last = poisson_range(lam)
    for k in range(first, last + 1):
        total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        cdf.append(total)
        if 1.0 - total < tail:
            break
    return cdf


def hash_poisson(ident: Column, salt, lam: float) -> Column:
    """Poisson(lam) draw: how many cumulative probabilities the uniform draw reaches."""
    if lam <= 0:
        return F.lit(0)
    table = F.array(*[F.lit(p) for p in poisson_cdf(lam, tail=1e-10)])
    first = poisson_range(lam)[0]
    return let(hash_uniform(ident, salt), lambda u: (F.size(F.filter(table, lambda p: p <= u)) + F.lit(first)).cast("int"))
