"""Helpers shared by the operators: bounded Arrow slices, byte views of text columns, scratch tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20

MASK = (1 << 64) - 1


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``most`` bytes in each slice (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = utf8(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; a null is an empty text.  Offsets start at 0."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return offsets - offsets[0], raw


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that nothing learns from: crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def crc_fold(doc_id: int, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bounded_sample(df: DataFrame, key: Column, most: int, total: int | None = None) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``; every row where there are fewer."""
    total = df.count() if total is None else total
    if total <= most:
        return df
    share = int(0.97 * most / total * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 31)) < share)
