"""Stupid-backoff language-model scores, computed relationally over n-gram count tables partitioned by hash.

A block is a set of documents read together (a part of an input file).  Each block explodes its n-grams into a count
table (gram, n); the tables are partitioned by the hash of the gram, packed as one row per block and bucket of the hash,
and joined by gram, which gives the counts over the corpus.  Counts that differ from the block's own go back to their
blocks, where each n-gram of each document meets its count and the scores are summed per document.  What moves is the
distinct n-grams of blocks, once, those shared between blocks, once more, and the compressed texts, once; a frequent
n-gram has one entry per block, not one per occurrence.

An occurrence is scored by the rest of the corpus: counts are taken without the occurrence itself.  With c counts,
N words and the order-n gram h+w, S(w|h) = c(hw)/c(h) if hw occurs elsewhere, else ``backoff`` * S(w|shorter h); a word
that occurs nowhere else has 1/N.  The empty gram's count is N.  Logarithms are whole millionths of log10, so sums do
not depend on their order.

n-grams are told apart by 64-bit hashes only: two different ones with one hash would share their counts.  With g distinct
n-grams that is expected for about g * g / 2**65 pairs, and it is not verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix, slices, utf8
from tidemark.llm.substrings import _BASE, _hashes, words_of

STEP = np.uint64(0xC2B2AE3D27D4EB4F)
EMPTY = np.uint64(0)  # the gram of order 0
FLUSH = 2_000_000  # grams that a task holds
BUCKET_CHARS = 8_000_000  # text per bucket of the hash


def grams(offsets: np.ndarray, raw: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """First word of each text (and the end), and per order 1.. the gram ending at each word and whether it exists."""
    start, end, first = words_of(offsets, raw)
    word = _hashes(mix(raw.astype(np.uint64) + np.uint64(1)), start, end, _BASE)
    begin = np.repeat(first[:-1], np.diff(first))
    place = np.arange(len(word)) - begin
    codes, exist = [], []
    code = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            back = np.roll(word, n - 1) if len(word) else word
            code = mix(code + back * STEP + np.uint64(n))
            codes.append(np.maximum(code, np.uint64(1)))
            exist.append(place >= n - 1)
    return first, codes, exist


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: what is equal in most of them takes next to no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(z: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack(gram: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """A part of a count table: sorted grams as differences, and their counts."""
    return _planes(np.diff(gram.view(np.uint64), prepend=np.uint64(0))), _planes(n.view(np.uint64))


def unpack(grams: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unplanes(grams), dtype=np.uint64), _unplanes(counts).view(np.int64)


PART = [("block", pa.int64()), ("bucket", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())]
PART_SCHEMA = "block bigint, bucket bigint, grams binary, counts binary"


def _block_counts(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Count tables of the blocks, a row per block and bucket (the first ``bits`` of the gram's hash).

    A block whose rows a task does not meet together, or that is too large for memory, gives several rows.
    """

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def rows():
            for block, (keys, counts) in held.items():
                key, n = _merged(keys, counts)
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)]])
                for at in range(0, len(cut) - 1, 1024):
                    parts = [(block, int(bucket[i]), *pack(key[i:j], n[i:j])) for i, j in zip(cut[at : at + 1024], cut[at + 1 : at + 1025])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*parts), PART)], [c for c, _ in PART])

        for part in slices(batches, "text"):
            by = np.argsort(part.column("block").to_numpy(zero_copy_only=False), kind="stable")
            part = part.take(pa.array(by))
            blocks = part.column("block").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                first, codes, exist = grams(*utf8(part.column("text").slice(a, b - a)), order)
                key, n = np.unique(np.concatenate([c[e] for c, e in zip(codes, exist)]), return_counts=True)
                keys, counts = held.setdefault(int(blocks[a]), ([], []))
                keys.append(np.insert(key, 0, EMPTY))
                counts.append(np.insert(n, 0, first[-1]))
                size += len(key)
                if len(keys) > 15:
                    keys[:], counts[:] = ([x] for x in _merged(keys, counts))
            if size > FLUSH:
                yield from rows()
                held, size = {}, 0
        yield from rows()

    return docs.select("block", "text").mapInArrow(run, PART_SCHEMA)


def _corpus_counts(parts: DataFrame) -> DataFrame:
    """The same parts with counts over the corpus, of the grams that occur outside the part too."""

    def solve(table: pa.Table) -> pa.Table:
        pairs = [unpack(g, c) for g, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist())]
        gram, n = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        order = np.argsort(gram, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        total = np.empty(len(gram), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(gram))))
        ends = np.cumsum([len(p[0]) for p in pairs])
        out = []
        for a, b in zip(ends - [len(p[0]) for p in pairs], ends):
            more = np.flatnonzero(total[a:b] != n[a:b]) + a
            out.append(pack(gram[more], total[more]))
        return pa.table([table.column("block"), table.column("bucket"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=[c for c, _ in PART])

    return parts.groupBy("bucket").applyInArrow(solve, PART_SCHEMA)


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text", 8 << 20):
            offsets, raw = utf8(part.column("text"))
            z = [press.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("id"), pa.array(z, pa.binary())], ["block", "id", "z"])

    return docs.mapInArrow(run, f"block bigint, id {docs.schema['id'].dataType.simpleString()}, z binary")


def _millionths(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log10(p) * 1e6).astype(np.int64)


def block_scores(texts: list[bytes], known: tuple[np.ndarray, np.ndarray], order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(words, score in millionths) of each text; ``known``: sorted grams and their corpus counts."""
    gram, count = known
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    first, codes, exist = grams(offsets, np.frombuffer(b"".join(texts), np.uint8), order)
    words = np.diff(first)
    if not len(codes[0]):
        return words, np.zeros(len(texts), np.int64)
    total = int(count[0])  # of the empty gram
    counts = [count[np.searchsorted(gram, c).clip(0, len(gram) - 1)] for c in codes]
    others = counts[0] - 1
    log = np.where(others > 0, _millionths(np.maximum(others, 1) / max(total - 1, 1)), _millionths(np.array([1 / max(total, 1)])))
    less = round(math.log10(backoff) * 1e6)
    for n in range(1, order):
        higher = counts[n] - 1
        context = np.roll(counts[n - 1], 1) - 1
        seen = _millionths(np.maximum(higher, 1) / np.maximum(context, 1))
        log = np.where(exist[n], np.where(higher > 0, seen, log + less), log)
    sums = np.concatenate([[0], np.cumsum(log)])
    return words, sums[first[1:]] - sums[first[:-1]]


def _known(texts: list[bytes], order: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of all grams of a block: those that came back, and the block's own for the others."""
    keys, counts = [np.array([EMPTY])], [np.zeros(1, np.int64)]
    for a in range(0, len(texts), 512):
        some = texts[a : a + 512]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        first, codes, exist = grams(offsets, np.frombuffer(b"".join(some), np.uint8), order)
        key, n = np.unique(np.concatenate([c[e] for c, e in zip(codes, exist)]), return_counts=True)
        keys.append(np.insert(key, 0, EMPTY))
        counts.append(np.insert(n, 0, first[-1]))
        if len(keys) > 15:
            keys, counts = ([x] for x in _merged(keys, counts))
    gram, count = _merged(keys, counts)
    for key, n in parts:
        count[np.searchsorted(gram, key)] = n
    return gram, count


def score(
    df: DataFrame, *, order: int = 2, backoff: float = 0.4, block: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_chars: int = BUCKET_CHARS
) -> DataFrame:
    """Columns id_col, n_words, score (sum of log10 scores) and mean (per word; null without words), per row of ``df``.

    Words are runs of bytes other than ASCII white space, unchanged.  ``block`` (a long) says which rows are read
    together; parts of one input split are best, the default is by a hash of the id.  Null and empty texts have no words
    and score 0; repeated rows count and are scored as often as they occur; an empty table gives an empty table;
    further columns are not read.
    """
    chars = df.agg(F.sum(F.char_length(text_col)).alias("n")).first()["n"] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, chars / bucket_chars))))
    if block is None:
        block = F.pmod(F.xxhash64(id_col), F.lit(max(1, math.ceil(chars / BUCKET_CHARS)))).cast("bigint")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), block.alias("block"))
    whole = _corpus_counts(_block_counts(docs, order, bits))
    kind = docs.schema["id"].dataType.simpleString()

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        reader = zstandard.ZstdDecompressor()
        texts = [reader.decompressobj().decompress(z) + b"\n" for z in left.column("z").to_pylist()]
        parts = [unpack(g, c) for g, c in zip(right.column("grams").to_pylist(), right.column("counts").to_pylist())]
        known = _known(texts, order, parts)
        out = [block_scores(texts[a : a + 512], known, order, backoff) for a in range(0, len(texts), 512)]
        words, log = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table([left.column("id"), pa.array(words), pa.array(log / 1e6)], names=["id", "n_words", "score"])

    found = _packed(docs).groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(solve, f"id {kind}, n_words bigint, score double")
    return found.select(F.col("id").alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean"))
