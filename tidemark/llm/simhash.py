"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints at most ``radius`` bits apart have a half in which they differ in at most ``radius // 2`` bits, and
around such halves the balls of half that radius meet: every fingerprint emits all variants of each half within
``radius // 4`` bits, equal variants are shuffled together, and colliding pairs are verified on the whole fingerprint.
That is 66 variants for radius 4, where balls of radius 2 over all 64 bits need 2081.  A variant shared by more than
``LARGE`` fingerprints is not read as one group: its fingerprints emit the ball of half the radius over all 64 bits,
whose groups cannot hold more fingerprints than the ball has variants.  Copies were merged into one fingerprint before.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts
from tidemark.llm.components import connected
from tidemark.session import materialize

LARGE = 8192
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned fingerprint of one text; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1 :]) if len(words) >= shingle else [(0, len(joined))]
    return majority(np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, as an unsigned number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, *, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ``fp`` (the 64 bits as a signed long).  A null text counts as empty: fingerprint 0."""

    def run(batches):
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], ["id", "fp"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp bigint").withColumnRenamed("id", id_col)


def masks(width: int, radius: int) -> list[int]:
    """All ``width``-bit masks of at most ``radius`` ones, as signed longs."""
    found = {0}
    for _ in range(radius):
        found |= {m | 1 << i for m in found for i in range(width)}
    return sorted(m - (1 << BITS) if m >> (BITS - 1) else m for m in found)


def variants(of: Column, width: int, radius: int) -> Column:
    return F.transform(F.array(*[F.lit(m) for m in masks(width, radius)]), lambda m: of.bitwiseXOR(m))


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _spanning(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect whatever is connected among ``members`` (distinct, uint64) at ``radius`` bits."""
    edges, left = [], members
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(left ^ x) <= radius
            for y in left[near]:
                edges.append((x, y))
                stack.append(y)
            left = left[~near]
    return edges


def links(distinct: DataFrame, *, radius: int = 4, large: int = LARGE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp``: no link between different components is lost."""
    half = radius // 2
    balls = F.concat(
        variants(F.shiftrightunsigned("fp", 32), 32, half // 2),
        F.transform(variants(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)), 32, half // 2), lambda v: v.bitwiseOR(F.lit(1 << 32))))
    emitted = distinct.select("fp", F.explode(balls).alias("variant"))

    def collide(batches):
        """Spanning edges of each variant's fingerprints, one variant held at a time; the fingerprints of a crowded one."""
        key, held, size = None, [], 0

        def close():
            if 1 < size <= large:
                return _spanning(np.sort(np.concatenate(held).view(np.uint64)), radius)
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            variant, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("variant", "fp"))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(variant)) + 1, [len(variant)]])
            edges, crowded = [], []
            # the first run may go on from the batch before, and the last into the next; of the others, pairs or more count
            inner = np.flatnonzero(np.diff(cut[1:-1]) > 1) + 1
            for i in sorted({0, len(cut) - 2, *inner.tolist()}):
                run = fp[cut[i] : cut[i + 1]]
                if key is None or variant[cut[i]] != key:
                    edges += close()
                    key, held, size = variant[cut[i]], [], 0
                size += len(run)
                if size > large:
                    crowded += [*held, run]
                    held = []
                else:
                    held.append(run)
            both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            many = np.concatenate(crowded) if crowded else np.zeros(0, np.int64)
            yield table(both[:, 0], both[:, 1], False)
            yield table(many, many, True)
        rest = np.array(close(), np.uint64).reshape(-1, 2).view(np.int64)
        yield table(rest[:, 0], rest[:, 1], False)

    def table(a, b, crowded):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

    together = emitted.repartition("variant").sortWithinPartitions("variant")
    found = materialize(together.mapInArrow(collide, "a bigint, b bigint, crowded boolean"), "collisions")
    few = found.filter("NOT crowded").select("a", "b").distinct()
    crowded = found.filter("crowded").select(F.col("a").alias("fp")).distinct()
    whole = crowded.select("fp", F.explode(variants(F.col("fp"), BITS, half)).alias("centre"))
    least = whole.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    many = whole.join(least, "centre").filter(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b"))
    many = many.filter(_far(F.col("a"), F.col("b")) <= radius)
    return few.unionByName(many)


def near_duplicates(
    df: DataFrame, *, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE
) -> DataFrame:
    """Columns id_col, ``fp`` and ``component`` (smallest id in the row's connected class), one row per row of ``df``.

    Null and empty texts share fingerprint 0.  Rows without an id are classed but never name a class (a class of such
    rows only has a null component).  Repeated rows stay repeated; an empty table gives an empty table; further
    columns are not read.  ``radius`` is at least 4 and a multiple of 4.
    """
    if radius % 4 or not radius:
        raise ValueError("radius must be a multiple of 4")
    prints = materialize(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp"), radius=radius, large=large))
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(classed.select("fp", "root").join(least, "root").select("fp", "component"), "fp").select(id_col, "fp", "component")


def one_of_each(df: DataFrame, *, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the row of the smallest id of each class; rows without an id stay, repeated ids leave one row."""
    return first_of_each(df, near_duplicates(df, radius=radius, shingle=shingle, id_col=id_col, text_col=text_col), id_col)


def first_of_each(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id names its class in ``found`` (id_col, component), and those without an id."""
    stay = found.filter(F.col(id_col) == F.col("component")).select(F.col(id_col).alias("__stay"))
    stay = materialize(stay.groupBy("__stay").agg(F.count(F.lit(1)).alias("__n")), "representatives")
    kept = df.join(stay, F.col(id_col) == F.col("__stay"), "left").filter(F.col("__stay").isNotNull() | F.col(id_col).isNull())
    if not stay.filter("__n > 1").isEmpty():
        again = kept.filter("__n > 1").dropDuplicates([id_col])
        kept = kept.filter("__n = 1 OR __n IS NULL").unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
