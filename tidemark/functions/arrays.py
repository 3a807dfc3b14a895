"""Expressions over ARRAY<DOUBLE> columns: activations, softmax, margins, divergences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm_l1(a: Column) -> Column:
    return array_sum(F.transform(a, F.abs))


def norm_l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def norm_max(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


ACTIVATIONS = {
    "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
    "linear": lambda x: x,
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tansig": lambda x: F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * x)) - F.lit(1.0),
}


def activate(a: Column, name: str) -> Column:
    """Elementwise activation of an array column."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; choose from {sorted(ACTIVATIONS)}")
    return F.transform(a, ACTIVATIONS[name])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row rather than once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def share_of_total(a: Column) -> Column:
    """Elements divided by their sum."""
    return let(a, lambda v: let(array_sum(v), lambda total: F.transform(v, lambda x: x / total)))


def softmax(a: Column) -> Column:
    """Softmax of an array, shifted by its maximum so large scores do not overflow."""
    return let(a, lambda v: let(F.array_max(v), lambda top: share_of_total(F.transform(v, lambda x: F.exp(x - top)))))


def argmax_first(a: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def minmax_sum_normalize(a: Column) -> Column:
    """Scale to [0, 1], then to sum 1."""
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    scaled = let(ends, lambda e: F.transform(a, lambda x: (x - e["lo"]) / (e["hi"] - e["lo"] + F.lit(1e-10))))
    return share_of_total(scaled)


def max_proba(a: Column) -> Column:
    return F.array_max(a)


def range_margin(a: Column) -> Column:
    """Largest minus smallest probability."""
    return F.array_max(a) - F.array_min(a)


def top2_margin(a: Column) -> Column:
    """Largest minus second largest probability."""
    down = F.sort_array(a, asc=False)
    return F.element_at(down, 1) - F.element_at(down, 2)


def kl_divergence(p: Column, q: Column) -> Column:
    """KL(p || q) after normalising both to sum 1; terms with p = 0 are 0."""
    p, q = share_of_total(p), share_of_total(q)
    term = F.zip_with(p, q, lambda x, y: F.when(x == 0, F.lit(0.0)).when(y == 0, F.lit(float("inf"))).otherwise(x * F.log(x / y)))
    return array_sum(term)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence: mean KL of both to their average."""
    p, q = share_of_total(p), share_of_total(q)
    mid = F.zip_with(p, q, lambda x, y: (x + y) / 2.0)
    return (kl_divergence(p, mid) + kl_divergence(q, mid)) / 2.0


def jeffreys_rank_divergence(rank_p: Column, rank_q: Column) -> Column:
    """Symmetric KL of two rankings, each rank r of n turned into weight (r + 1) / n."""
    p = F.transform(rank_p, lambda r: (r + 1.0) / F.size(rank_p))
    q = F.transform(rank_q, lambda r: (r + 1.0) / F.size(rank_q))
    return kl_divergence(p, q) + kl_divergence(q, p)


def one_hot(label: Column, n_classes: int) -> Column:
    """Unit vector of a class id; an id outside 0..n-1 is an error, a null label stays null."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == label).cast("double"))
    bad = F.raise_error(F.concat(F.lit("class id outside range: "), label.cast("string"))).cast("array<double>")
    return F.when(label.isNull(), F.lit(None)).when((label < 0) | (label >= n_classes), bad).otherwise(vec)


def pick(a: Column, index: Column | list[int]) -> Column:
    """Elements of ``a`` at 0-based positions ``index``."""
    idx = F.array(*[F.lit(int(i)) for i in index]) if isinstance(index, list) else index
    return F.transform(idx, lambda i: F.get(a, i))
