"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose, the shingle sets decide.

A text's signature is the least of its shingle hashes under ``BANDS * ROWS`` permutations; texts that agree on all rows
of a band meet in its bucket.  A pair of similarity s meets with probability ``1 - (1 - s ** ROWS) ** BANDS``: 0.998 at
0.8, above 0.9999 at 0.85.  Buckets with the same members are read once, and within a bucket the sets of 64-bit shingle
hashes are compared until whatever is linked there is connected, so no pair below the similarity is a link.  A bucket of
more than ``TILE`` texts is cut into parts, and every two of its parts are compared in a task of their own.
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
from tidemark.llm.simhash import first_of_each
from tidemark.session import materialize

BANDS, ROWS = 16, 5
TILE = 1024  # texts of a bucket that one side of a comparison holds, about
_RNG = np.random.default_rng(23)
_XOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, one without words has none."""
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, len(joined))] * bool(words)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket of each band, as signed longs; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        least = np.minimum(least, ((hashes[at : at + (1 << 13)] ^ _XOR) * _ODD).min(axis=1))
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def spanning(members: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect whatever is linked among ``members`` (number, shingles) at ``similarity``."""
    edges, stack = [], []
    left = sorted(members, key=lambda m: m[0])
    while left:
        x, own = stack.pop() if stack else left.pop(0)
        if not left:
            break
        sizes = np.array([len(h) for _, h in left])
        flat = np.concatenate([h for _, h in left])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        near = shared >= similarity * (sizes + len(own) - shared) - 1e-9
        edges += [(x, y) for (y, _), n in zip(left, near) if n]
        stack += [m for m, n in zip(left, near) if n]
        left = [m for m, n in zip(left, near) if not n]
    return edges


def buckets(distinct: DataFrame) -> DataFrame:
    """The texts ``g`` of each ``band`` that is read, and its number of ``parts``; ``marks`` are a text's bands."""
    emitted = distinct.select("g", F.explode("marks").alias("band"))
    marks = [F.bit_xor(F.xxhash64("g", F.lit(i))).alias(f"m{i}") for i in range(2)]
    shared = emitted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *marks).filter("n > 1")
    once = shared.groupBy("n", "m0", "m1").agg(F.min("band").alias("band")).select("band", parts_of(F.col("n")).alias("parts"))
    return materialize(emitted.join(once, "band"), "buckets")


def parts_of(n: Column) -> Column:
    return F.ceil(n / TILE).cast("int")


def links(members: DataFrame, wanted, *, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) among the texts of each band of ``members``; ``wanted(gs)`` gives g and text for a table of numbers."""

    def collide(batches):
        band, held = None, []
        for part in slices(batches, "text"):
            edges = []
            for b, tile, g, text in zip(part.column("band").to_pylist(), part.column("tile").to_pylist(), part.column("g").to_pylist(), texts(part.column("text"))):
                if (b, tile) != band:
                    edges += spanning(held, similarity)
                    band, held = (b, tile), []
                held.append((g, shingles(_words(text), shingle)))
            yield table(edges)
        yield table(spanning(held, similarity))

    def table(edges):
        both = np.array(edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    # a bucket of several parts becomes one tile for each pair of parts, so each pair of its texts meets in a tile
    own = F.pmod(F.xxhash64("g", F.lit("part")), F.col("parts"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(q, own) * F.col("parts") + F.greatest(q, own)))
    together = members.join(wanted(members.select("g").distinct()), "g").select("band", "g", "text", tile.alias("tile"))
    return together.repartition("band", "tile").sortWithinPartitions("band", "tile").mapInArrow(collide, "a bigint, b bigint")


def classes(df: DataFrame, mark, propose, *, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Columns id_col and ``component``: classes of the texts that meet in a bucket and whose shingle sets are similar.

    ``mark`` gives some longs for a text's shingle hashes; ``propose`` gives band, g and parts for a table of g and ``marks``.
    """
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()

    def sign(batches):
        for part in slices(batches, "text"):
            words = [_words(t) for t in texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(map(_key, words), pa.binary()), pa.array([mark(shingles(w, shingle)) for w in words], pa.list_(pa.int64()))],
                ["id", "key", "marks"])

    def label(batches):
        for part in slices(batches, "text"):
            found = texts(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_key(_words(t)) for t in found], pa.binary()), pa.array(found, pa.string())], ["id", "key", "text"])

    prints = materialize(plain.mapInArrow(sign, f"id {kind}, key binary, marks array<bigint>"), "signatures")
    distinct = prints.groupBy("key").agg(F.min("id").alias("first"), F.first("marks").alias("marks"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("g"), "key", "first", "marks"), "distinct-signatures")

    def wanted(numbers: DataFrame) -> DataFrame:
        chosen = distinct.select("g", F.col("key").alias("k"), "first").join(numbers, "g")
        rows = plain.mapInArrow(label, f"id {kind}, key binary, text string")
        same = rows.join(chosen, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("first")))
        return same.select("g", "text").dropDuplicates(["g"])

    roots = connected(links(propose(distinct.select("g", "marks")), wanted, shingle=shingle, similarity=similarity))
    classed = distinct.select("g", "key", "first").join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    least = classed.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(classed.select("key", "root").join(least, "root").select("key", "component"), "key").select(F.col("id").alias(id_col), "component")


def near_duplicates(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ``component`` (smallest id in the row's connected class), one row per row of ``df``.

    Texts are linked when the Jaccard similarity of their sets of ``shingle`` lower-case words is ``similarity`` or more.
    Null texts and texts without words are equal.  Rows without an id are classed but never name a class (a class of
    such rows only has a null component).  Repeated rows stay repeated; an empty table gives an empty table.
    """
    return classes(df, bands, buckets, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)


def one_of_each(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the row of the smallest id of each class; rows without an id stay, repeated ids leave one row."""
    return first_of_each(df, near_duplicates(df, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col), id_col)
