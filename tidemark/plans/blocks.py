"""Run a function once per block of rows, or stream rows past a small per-block side table.

Both shapes sort rows inside hash partitions and walk them in Arrow batches, so many small blocks
share one Python worker call and nothing larger than one block (or one batch) is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


EMITTED = 16  # accumulators in one batch that a task emits


def _cuts(frame: pd.DataFrame, by: list[str]) -> list[int]:
    change = np.zeros(len(frame), dtype=bool)
    for c in by:
        v = frame[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return [0, *np.flatnonzero(change).tolist(), len(frame)]


def _pieces(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal ``by`` inside each batch, in order."""
    for frame in frames:
        if len(frame):
            edges = _cuts(frame, by)
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = frame.iloc[lo:hi]
                yield tuple(part[c].iloc[0] for c in by), part


def map_blocks(
    df: DataFrame, by: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, *, max_rows: int
) -> DataFrame:
    """Apply ``fn`` to each block whole.  Blocks are bounded by construction; a larger one is an error."""

    def run(frames):
        key, held, rows = None, [], 0
        done = []
        for k, part in _pieces(frames, by):
            if k != key:
                if held:
                    done.append(fn(pd.concat(held, ignore_index=True)))
                    if sum(len(d) for d in done) >= 10_000:
                        yield pd.concat(done, ignore_index=True)
                        done = []
                key, held, rows = k, [], 0
            held.append(part)
            rows += len(part)
            if rows > max_rows:
                raise ValueError(f"block {k} has more than {max_rows} rows; use smaller blocks")
        if held:
            done.append(fn(pd.concat(held, ignore_index=True)))
        done = [d for d in done if len(d)]
        if done:
            yield pd.concat(done, ignore_index=True)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def stream_past(
    rows: DataFrame, side: DataFrame, on: list[str], payload: list[str], fn: Callable[[pd.DataFrame, dict | None], pd.DataFrame],
    schema: T.StructType, *, salts: int = 1, order: list[str] | None = None,
) -> DataFrame:
    """Feed each block's rows, batch by batch, to ``fn(batch, side_row)``.

    ``side`` has one row per block; it is sorted before the block's rows and held while they pass,
    instead of being copied onto each of them.  With ``salts`` > 1 a block's rows are spread over
    that many tasks, each with its own copy of the side row, so a hot block is not one task.
    ``order`` sorts a block's rows (with one salt).
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]), F.lit(salts)) if salts > 1 else F.lit(0)
    left = rows.withColumn("__salt", spread.cast("int")).withColumn("__kind", F.lit(1))
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    right = side.select(*on, F.struct(*payload).alias("__side")).withColumn("__salt", copies).withColumn("__kind", F.lit(0))
    # side rows carry filler, never null, in number columns, so batches keep their integer types
    filler = {f.name: F.lit(0).cast(f.dataType) for f in rows.schema if f.name not in on and isinstance(f.dataType, T.NumericType)}
    both = left.withColumn("__side", F.lit(None).cast(right.schema["__side"].dataType)).unionByName(
        right.withColumns(filler), allowMissingColumns=True)
    by = [*on, "__salt"]

    def run(frames):
        key, held = None, None
        out = []
        for k, part in _pieces(frames, by):
            if k != key:
                key, held = k, None
            sides = part["__kind"].to_numpy() == 0
            if sides.any():
                first = part.loc[sides, "__side"].iloc[0]
                held = first if isinstance(first, dict) else first.asDict() if hasattr(first, "asDict") else dict(first)
                part = part[~sides]
            if len(part):
                out.append(fn(part.drop(columns=["__side", "__kind", "__salt"]).reset_index(drop=True), held))
                if sum(len(o) for o in out) >= 10_000:
                    yield pd.concat(out, ignore_index=True)
                    out = []
        if out:
            yield pd.concat(out, ignore_index=True)

    return both.repartition(*by).sortWithinPartitions(*by, "__kind", *(order or [])).mapInPandas(run, schema)


def fold_blocks(
    rows: DataFrame, by: list[str], start: Callable, add: Callable, finish: Callable, schema: T.StructType, *, salts: int = 1
) -> DataFrame:
    """Partial aggregate per (block, salt): ``start()``, ``add(acc, batch)``, ``finish(acc) -> dict``."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)) if salts > 1 else F.lit(0)
    keyed = rows.withColumn("__salt", spread.cast("int"))
    keys = [*by, "__salt"]

    def run(frames):
        key, acc = None, None
        out = []
        for k, part in _pieces(frames, keys):
            if k != key:
                if key is not None:
                    out.append({**dict(zip(by, key)), **finish(acc)})
                    if len(out) >= 64:
                        yield pd.DataFrame(out)
                        out = []
                key, acc = k, start()
            acc = add(acc, part)
        if key is not None:
            out.append({**dict(zip(by, key)), **finish(acc)})
        if out:
            yield pd.DataFrame(out)

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def partial_blocks(
    rows: DataFrame, by: list[str], start: Callable, add: Callable, finish: Callable, schema: T.StructType, *, hold: int
) -> DataFrame:
    """Like ``fold_blocks``, over the partitions as they are: no shuffle, and several partial rows per block.

    A task keeps ``hold`` accumulators and emits them all when it meets more blocks; add the rows up by block.  They are
    emitted a few at a time and let go as they are, so that no second copy of all of them is made.
    """

    def run(frames):
        held: dict = {}

        def rows_of():
            while held:
                some = [held.popitem() for _ in range(min(EMITTED, len(held)))]
                yield pd.DataFrame([{**dict(zip(by, key)), **finish(acc)} for key, acc in some])

        for frame in frames:
            for key, part in frame.groupby(by, sort=False, dropna=False):
                if key not in held and len(held) >= hold:
                    yield from rows_of()
                held[key] = add(held[key] if key in held else start(), part)
        yield from rows_of()

    return rows.mapInPandas(run, schema)


def tile_stream(
    query: DataFrame, ref: DataFrame, by: list[str], order: str, begin: Callable, update: Callable, finish: Callable, schema: T.StructType, *,
    tile: int = 2048,
) -> DataFrame:
    """Compare every query row with every reference row of its block, keeping only an accumulator.

    A block's queries are cut into tiles of about ``tile`` rows, one task each, and its references
    stream past each tile in batches: exact, with bounded memory, and a hot block uses many tasks.
    ``begin(queries) -> acc``, ``update(acc, queries, references) -> acc``,
    ``finish(acc, queries) -> frame``.  Both sides have the same columns.
    """
    keys = by or ["__one"]
    if not by:
        query, ref = query.withColumn("__one", F.lit(0)), ref.withColumn("__one", F.lit(0))
    tiles = query.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("__tiles"))
    q = query.join(tiles, keys)
    q = q.withColumn("__tile", F.pmod(F.xxhash64(order), F.col("__tiles")).cast("int")).withColumn("__kind", F.lit(0))
    r = ref.join(tiles, keys)
    r = r.withColumn("__tile", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))).withColumn("__kind", F.lit(1))
    both = q.unionByName(r).drop("__tiles")
    spots = [*keys, "__tile"]

    def run(frames):
        key, parts, queries, acc, done = None, [], None, None, []

        def close():
            if key is not None and parts:
                whole = pd.concat(parts, ignore_index=True) if queries is None else queries
                out = finish(begin(whole) if acc is None else acc, whole)
                if len(out):
                    done.append(out)

        for k, part in _pieces(frames, spots):
            if k != key:
                close()
                if sum(len(d) for d in done) >= 10_000:
                    yield pd.concat(done, ignore_index=True)
                    done.clear()
                key, parts, queries, acc = k, [], None, None
            kind = part["__kind"].to_numpy()
            if (kind == 0).any():
                parts.append(part[kind == 0])
            refs = part[kind == 1]
            if len(refs) and parts:
                if queries is None:
                    queries = pd.concat(parts, ignore_index=True)
                    acc = begin(queries)
                for lo in range(0, len(refs), 1024):
                    acc = update(acc, queries, refs.iloc[lo : lo + 1024])
        close()
        if done:
            yield pd.concat(done, ignore_index=True)

    return both.repartition(*spots).sortWithinPartitions(*spots, "__kind", order).mapInPandas(run, schema)


def sum_arrays(df: DataFrame, by: list[str], arrays: list[str], scalars: list[str], *, salts: int = 1) -> DataFrame:
    """Elementwise sums of fixed-length array columns, combined map-side in the JVM."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vecs = df.select(*by, *scalars, *[array_to_vector(F.col(a)).alias(a) for a in arrays])

    def merge(frame: DataFrame, keys: list[Column | str]) -> DataFrame:
        return frame.groupBy(*keys).agg(
            *[F.sum(s).alias(s) for s in scalars], *[Summarizer.sum(F.col(a)).alias(a) for a in arrays])

    if salts > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt")
        vecs = merge(vecs.select("*", salt), [*by, "__salt"])
    out = merge(vecs, by)
    return out.select(*by, *scalars, *[vector_to_array(F.col(a)).alias(a) for a in arrays])
