"""Expressions over MAP<INT, DOUBLE> rows whose feature set changes from row to row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_sparse_map(features: Column, drop_zeros: bool = False) -> Column:
    """Dense array to {position: value}."""
    m = F.map_from_arrays(F.sequence(F.lit(0), F.size(features) - 1), features)
    return F.map_filter(m, lambda k, v: v != 0) if drop_zeros else m


def shared_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))


def new_keys(a: Column, b: Column) -> Column:
    """Keys of ``a`` that ``b`` lacks."""
    return F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))


def subset(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.array_contains(keys, k))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product over shared keys."""
    products = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0))))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def sorted_values(m: Column) -> Column:
    """Values in key order."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def informativeness(variance: Column) -> Column:
    """Variances as shares of their total; all ones when the total is zero."""
    total = F.aggregate(F.map_values(variance), F.lit(0.0), lambda acc, x: acc + x)
    return F.transform_values(variance, lambda k, v: F.when(total != 0, v / total).otherwise(F.lit(1.0)))


def sparsify(weights: Column, info: Column, keep_share: float, radius: float) -> Column:
    """Shrink weights into an L1 ball and zero all but the top share of features.

    Weights are scaled by min(1, radius / sum(info * |weight|)).  When more than ``keep_share`` of
    them are nonzero, only the max(1, floor(share * n)) largest *signed* weights keep their value;
    among equal weights the higher key stays.
    """
    mass = F.map_values(F.map_zip_with(weights, info, lambda k, w, v: F.abs(w) * F.coalesce(v, F.lit(0.0))))
    total = F.aggregate(mass, F.lit(0.0), lambda acc, x: acc + x)
    scale = F.when(total > 0, F.least(F.lit(1.0), F.lit(float(radius)) / total)).otherwise(F.lit(1.0))
    entries = F.array_sort(
        F.transform(F.map_entries(weights), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))
    )
    n = F.size(entries)
    keep = F.greatest(F.lit(1), F.floor(F.lit(float(keep_share)) * n).cast("int"))
    crowded = F.size(F.filter(entries, lambda e: e["value"] != 0)) > F.lit(float(keep_share)) * n
    dropped = F.transform(F.slice(entries, 1, n - keep), lambda e: e["key"])
    return F.transform_values(
        weights, lambda k, w: F.when(crowded & F.array_contains(dropped, k), F.lit(0.0)).otherwise(w * scale)
    )
