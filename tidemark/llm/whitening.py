"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds and twisted factorisations.

Centred rows are reduced to one triangular R by QR of blocks, first in the partitions, then in a tree, so the covariance
is never formed.  R is bidiagonalised (R = U B V'), the squared singular values of B come from the differential quotient
difference algorithm with shifts (dqds), which finds small ones as accurately as large ones, and each eigenvector of B'B
from the factorisation twisted at the row where its residual is least; V turns it into a direction.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

EPS = float(np.finfo(float).eps)
LARGEST = 1 << 52  # larger scaled components are not told apart from their neighbours by doubles
HELD = 1 << 23  # doubles in the partial results that one task or the driver merges


# --- dense steps, on matrices of dimension x dimension -------------------------------------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of the upper bidiagonal B in r = U B V'."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        w = x / size
        w[0] += math.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2 and (w := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform of B'B - shift; None where the shift exceeds the smallest value."""
    n = len(q)
    nq, ne, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    for i in range(n - 1):
        if d < 0 or not math.isfinite(d):
            return None
        nq[i] = d + e[i]
        if nq[i] == 0:
            ne[i], d = 0.0, q[i + 1] - shift
            continue
        t = q[i + 1] / nq[i]
        ne[i], d = e[i] * t, d * t - shift
    if d < 0 or not math.isfinite(d):
        return None
    nq[-1] = d
    return nq, ne


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of the upper bidiagonal matrix, falling."""
    top = max([abs(float(x)) for x in [*diagonal, *above]], default=0.0)
    if top == 0:
        return np.zeros(len(diagonal))
    tiny = 1e-280
    found: list[float] = []
    work = [([float(x / top) ** 2 for x in diagonal], [float(x / top) ** 2 for x in above], 0.0)]
    while work:
        q, e, moved = work.pop()
        for _ in range(200 * len(q) + 200):
            if not q:
                break
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = next((i for i in reversed(range(len(e))) if e[i] <= (4 * EPS) ** 2 * (moved + min(q[i], q[i + 1])) or e[i] < tiny), None)
            if cut == len(e) - 1:
                found.append(q.pop() + moved)
                e.pop()
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            # the smaller eigenvalue of the last 2 x 2 block of B B' is at least the smallest of all; a little less of it is tried
            a, b, c = q[-2] + e[-1], q[-1], e[-1] * q[-1]
            half = (a - b) / 2
            low = (a * b - c) / ((a + b) / 2 + math.hypot(half, math.sqrt(c)))
            shift = min(max(low * (1 - 1e-3) - 0.5 * math.sqrt(c) * (len(q) > 2) * (e[-1] > 1e-6 * q[-1]), 0.0), q[-1])
            while (step := _dqds_step(q, e, shift)) is None:
                shift = shift / 4 if shift > 1e-3 * EPS * (moved + q[-1]) else 0.0
            q, e = step
            moved += shift
        else:
            raise ArithmeticError("dqds did not converge")
    return top * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _factor(d: np.ndarray, low: np.ndarray, x: float) -> tuple[np.ndarray, ...]:
    """Stationary (from the top) and progressive (from the bottom) factors of L D L' - x, and the twist residuals."""
    n = len(d)
    tiny = EPS * EPS * (abs(x) + float(np.max(np.abs(d))))
    down, lplus, s = np.zeros(n), np.zeros(n - 1), np.zeros(n)
    s[0] = -x
    for i in range(n):
        down[i] = s[i] + d[i]
        if abs(down[i]) < tiny:
            down[i] = -tiny
        if i < n - 1:
            lplus[i] = d[i] * low[i] / down[i]
            s[i + 1] = lplus[i] * low[i] * s[i] - x
    uminus, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - x
    for i in range(n - 2, -1, -1):
        up = d[i] * low[i] ** 2 + p[i + 1]
        if abs(up) < tiny:
            up = -tiny
        t = d[i] / up
        uminus[i] = low[i] * t
        p[i] = p[i + 1] * t - x
    return down, lplus, uminus, s + p + x


def _solve(down: np.ndarray, lplus: np.ndarray, b: np.ndarray) -> np.ndarray:
    y = b.copy()
    for i in range(1, len(y)):
        y[i] -= lplus[i - 1] * y[i - 1]
    y /= down
    for i in range(len(y) - 2, -1, -1):
        y[i] -= lplus[i] * y[i + 1]
    return y


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Unit right singular vectors (columns) of the upper bidiagonal matrix for the singular ``values``, falling.

    Vectors of values that are nearer than ``close`` of their square are made orthogonal to each other; where the
    factorisation gives a vector twice (equal values), inverse iteration from another start finds the rest.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones((1, len(values)))
    floor = EPS * 1e-3 * max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(above))), 1e-300)
    a = np.where(np.abs(diagonal) < floor, floor, diagonal)
    d, low = a * a, above / a[:-1]
    out, rng, begin = np.zeros((n, len(values))), np.random.default_rng(11), 0
    for k, value in enumerate(values):
        x = float(value) ** 2
        if k and float(values[k - 1]) ** 2 - x > close * float(values[k - 1]) ** 2:
            begin = k
        down, lplus, uminus, gamma = _factor(d, low, x)
        r = int(np.argmin(np.abs(gamma)))
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lplus[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -uminus[i] * z[i]
        z /= np.linalg.norm(z)
        mates = out[:, begin:k]
        if k > begin:
            z = _apart(z, mates)
            for _ in range(5):
                if np.linalg.norm(z) > 0.5:
                    break
                z = _apart(_unit(rng.normal(size=n)), mates)
                for _ in range(3):
                    z = _apart(_unit(_solve(down, lplus, _unit(z))), mates)
            z = _unit(_apart(_unit(z), mates))
        out[:, k] = z
    return _settled(diagonal, above, values, out, close)


def _settled(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, z: np.ndarray, close: float) -> np.ndarray:
    """Groups of nearly equal values whose vectors leave a residual: block inverse iteration, then a basis of eigenvectors in it."""
    b = np.diag(diagonal) + np.diag(above, 1)
    t, x = b.T @ b, values**2
    left = np.linalg.norm(t @ z - z * x, axis=0)
    ends = np.flatnonzero(x[:-1] - x[1:] > close * x[:-1]) + 1
    for group in np.split(np.arange(len(x)), ends):
        if not len(group) or left[group].max() <= 64 * EPS * x[0]:
            continue
        mine = z[:, group]
        for _ in range(4):
            mine = np.linalg.qr(np.linalg.solve(t - x[group].mean() * (1 + 4 * EPS) * np.eye(len(t)), mine))[0]
        turn = np.linalg.eigh(mine.T @ t @ mine)[1]
        z[:, group] = mine @ turn[:, ::-1]
    return z


def right_pairs(diagonal: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """All singular values, falling, and the part (first row, row after the last) of the matrix that each belongs to.

    Parts are joined by entries above the diagonal that rounding cannot tell from zero; equal values lie in different
    parts, where their vectors cannot mix.
    """
    size = np.abs(diagonal)
    free = np.flatnonzero(np.abs(above) <= 4 * EPS * (size[:-1] + size[1:])) + 1
    edges = [0, *free.tolist(), len(diagonal)]
    found = [(float(s), a, b) for a, b in zip(edges, edges[1:]) for s in dqds(diagonal[a:b], above[a : b - 1])]
    found.sort(key=lambda x: (-x[0], x[1]))
    return np.array([x[0] for x in found]), [x[1:] for x in found]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros((len(diagonal), len(values)))
    for a, b in set(parts):
        mine = [k for k, p in enumerate(parts) if p == (a, b)]
        out[a:b, mine] = twisted_vectors(diagonal[a:b], above[a : b - 1], values[mine])
    return out


def _unit(z: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(z)
    return z / size if size else z


def _apart(z: np.ndarray, mates: np.ndarray) -> np.ndarray:
    return z - mates @ (mates.T @ z)


# --- rows ---------------------------------------------------------------------------------------------------------


def scaled(column: pa.Array, scale: int, shift: int, size: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, whole numbers floor(scale * c) + shift) of the usable vectors, for each length (or ``size`` alone)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths) if size is None else [size]:
        rows = np.flatnonzero(lengths == n)
        if not n or not len(rows):
            continue
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        c = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(rows), n) * scale)  # a null is NaN here
        fine = (np.isfinite(c) & (np.abs(c) < LARGEST)).all(axis=1)
        if fine.any():
            yield int(n), rows[fine], c[fine].astype(np.int64) + shift


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` in 64-bit whole numbers, or in Python's where sums or products up to ``bound`` would not fit."""
    return x if bound < 1 << 62 else x.astype(object)


@dataclass
class Moments:
    n: int
    sums: list[int]
    bound: int  # largest absolute entry

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return _exact(x, 2 * max(self.n * self.bound, *map(abs, self.sums))) * self.n - np.array(self.sums, dtype=object if max(map(abs, self.sums)) >= 1 << 62 else np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


def squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None where one does not fit a long."""
    safe = dev.dtype != object and bool((np.square(dev.astype(float)).sum(axis=1) < 9e18).all())
    if safe:
        return np.square(dev).sum(axis=1).tolist()
    return [s if (s := sum(v * v for v in row)) < 1 << 63 else None for row in dev.tolist()]


def moments(df: DataFrame, scale: int, shift: int) -> Moments | None:
    """Count and exact sums over the vectors of the most frequent length (the longer of two); None without any."""

    def run(batches):
        held: dict[int, list] = {}

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[2] for h in held.values()], pa.int64()),
                 pa.array([list(map(Decimal, h[1])) for h in held.values()], pa.list_(pa.decimal128(38, 0)))], ["size", "n", "bound", "sums"])
            held.clear()
            return out

        for batch in batches:
            for size, _, x in scaled(batch.column("vector"), scale, shift, None):
                bound = int(np.abs(x).max())
                sums = _exact(x, bound * len(x)).sum(axis=0).tolist()
                n, before, most = held.get(size, (0, [0] * size, 0))
                held[size] = [n + len(x), [a + b for a, b in zip(before, sums)], max(most, bound)]
                if sum(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    part = materialize(df.select("vector").mapInArrow(run, "size bigint, n bigint, bound bigint, sums array<decimal(38,0)>"), "vector-sums")
    best = part.groupBy("size").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    sums = part.filter(F.col("size") == best["size"]).select(F.posexplode("sums").alias("j", "s")).groupBy("j").agg(F.sum("s").alias("s")).orderBy("j").collect()
    return Moments(best["n"], [int(r["s"]) for r in sums], best["bound"])


def reduced(df: DataFrame, start: Callable, width: int, merge: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One row of ``width`` doubles out of those that ``start`` makes of each partition, merged in a tree.

    ``merge`` takes rows (one or more) and gives one; at most about ``HELD`` doubles meet in a task or on the driver.
    """
    fan = max(8, HELD // width)

    def row(values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.ravel()], pa.list_(pa.float64()))], ["part"])

    def first(batches):
        for values in start(batches):
            yield row(values)

    def many(batches):
        held, have = [], 0
        for batch in batches:
            held.append(batch.column("part").flatten().to_numpy().reshape(-1, width))
            have += len(held[-1])
            if have > 64:
                held, have = [merge(np.concatenate(held)).reshape(1, width)], 1
        if held:
            yield row(merge(np.concatenate(held)))

    parts = materialize(df.mapInArrow(first, "part array<double>"), "partial")
    while (n := parts.count()) > fan:
        parts = materialize(parts.repartition(-(-n // fan)).mapInArrow(many, "part array<double>"), "partial")
    rows = [r["part"] for r in parts.collect()]
    return merge(np.array(rows).reshape(-1, width)) if rows else None


@dataclass
class Model:
    moments: Moments
    directions: np.ndarray  # dimension x components, unit columns
    variance: np.ndarray  # eigenvalues of the covariance, falling
    explained: np.ndarray
    scale: int
    shift: int

    @property
    def usable(self) -> np.ndarray:
        return self.variance > 0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Coordinates over the root of the variance; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable, self.moments.centred(x) @ self.directions / np.sqrt(self.variance), np.nan)


def fit(df: DataFrame, *, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> Model | None:
    """Eigenvectors of the covariance (divisor n) of the column ``vector``; None where no vector is usable."""
    m = moments(df, scale, shift)
    if m is None:
        return None
    d = len(m.sums)
    block = max(d, (1 << 18) // d)

    def triangles(batches):
        r = np.zeros((0, d))
        for batch in batches:
            for _, _, x in scaled(batch.column("vector"), scale, shift, d):
                for at in range(0, len(x), block):
                    r = np.linalg.qr(np.concatenate([r, m.centred(x[at : at + block])]), mode="r")
        if len(r):
            yield np.concatenate([r, np.zeros((d - len(r), d))])

    def merge(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows.reshape(-1, d), mode="r")

    r = reduced(df.select("vector"), triangles, d * d, merge)
    diagonal, above, v = bidiagonalise(r)
    values, parts = right_pairs(diagonal, above)
    some = values > 8 * d * EPS * values[0] if values[0] > 0 else np.zeros(d, bool)
    k = min(components, d)
    most = min(k, int(some.sum()))
    z = right_vectors(diagonal, above, values[:most], parts[:most])
    directions = np.zeros((d, k))
    directions[:, : z.shape[1]] = v @ z
    total = float((values**2).sum())
    variance = np.where(some, values, 0.0)[:k] ** 2 / m.n
    return Model(m, directions, variance, values[:k] ** 2 / total if total else np.zeros(k), scale, shift)


def identity_error(df: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance (centred, divisor n) minus the identity.

    Components without variance do not count; 0 where none has any.
    """
    use, d = np.flatnonzero(model.usable), len(model.moments.sums)
    k = len(use)
    if not k:
        return 0.0

    def merge(rows: np.ndarray) -> np.ndarray:
        """Counts, means and centred products of parts, added up."""
        n, means = rows[:, 0], rows[:, 1 : 1 + k]
        mean = n @ means / n.sum()
        off = means - mean
        return np.concatenate([[n.sum()], mean, (rows[:, 1 + k :].sum(axis=0).reshape(k, k) + (off.T * n) @ off).ravel()])

    def products(batches):
        held = []
        for batch in batches:
            for _, _, x in scaled(batch.column("vector"), model.scale, model.shift, d):
                w = model.whiten(x)[:, use]
                mean = w.mean(axis=0)
                held.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]))
                if len(held) > 64:
                    held = [merge(np.array(held))]
        if held:
            yield merge(np.array(held))

    total = reduced(df.select("vector"), products, 1 + k + k * k, merge)
    return float(np.abs(total[1 + k :].reshape(k, k) / total[0] - np.eye(k)).max())


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Columns id_col, component, n, deviation, whitened, explained, identity_error: a row per usable row and component.

    Entries c become whole numbers x = floor(scale * c) + shift.  Rows whose vector is null or empty, holds a null or
    non-finite entry, has another length than most (the longer of two lengths equally frequent), or has an entry whose
    x is beyond 2**52 take no part; null and repeated ids do.  ``deviation`` is the exact sum over dimensions of
    (n * x - sums)**2, null where that does not fit a long.  A component without variance (constant or too few rows)
    has a null ``whitened``.  An empty table has no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    model = fit(rows, components=components, scale=scale, shift=shift)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_col)
    error, m, k = identity_error(rows, model), model.moments, len(model.variance)
    d, block = len(m.sums), max(1, (1 << 18) // max(len(m.sums), k))

    def run(batches):
        for batch in batches:
            for _, at, x in scaled(batch.column("vector"), model.scale, model.shift, d):
                for i in range(0, len(x), block):
                    part = x[i : i + block]
                    each = pa.array(np.repeat(at[i : i + block], k))
                    white = model.whiten(part).ravel()
                    dev = pa.array(squares(m.deviations(part)), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(white), m.n)),
                         dev.take(pa.array(np.repeat(np.arange(len(part)), k))), pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, len(part))),
                         pa.array(np.full(len(white), error))],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_col)
