"""Removal of repeated word sequences, with a compressed FM-index per shard of the corpus.

A window is ``length`` consecutive words.  Its key is the smallest hash among its ``GRAM``-word parts, so equal windows
have equal keys, and consecutive windows mostly share one: a document is cut into segments, the runs of windows with
one key.  Segments whose key occurs once cannot repeat and go no further.  Equal segments are merged to their first
occurrence before any text moves; the others are removed whole.  The words of the remaining distinct segments are
dealt to shards by key.  Each shard indexes its segments (suffix order, Burrows-Wheeler transform, wavelet tree) and
streams them past the index: backward search gives the matching statistics of every window, and the interval of a
window that matches in full gives its earliest place in the corpus.

A key shared by more than ``crowd`` distinct segments (a passage pasted between many different contexts) is not one
shard's work: the windows of its segments are merged one by one by a 128-bit hash instead, before they are shuffled.

Places are compared as (id, text hash, word number).  The text hash only counts where an id occurs more than once;
repeated rows (same id, same text) are one document and get one result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mix, slices, utf8
from tidemark.llm.fmindex import FMIndex
from tidemark.session import materialize

GRAM = 6
CROWD = 2_000
SHARD_WORDS = 400_000
_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        x = np.full(n, b, np.uint64)
        if n:
            x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _hashes(value: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of value[start:end] for each pair, from one prefix sum."""
    up, down = _powers(base, len(value) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:-1], dtype=np.uint64)])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words_of(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges (start, end) of all words, and the number of the first word of each text (and of the end)."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[offsets < len(raw)]] = True  # a word does not go on into the next text
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    if len(raw):
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def segments(offsets: np.ndarray, raw: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All segments of the texts: text number, first word in it, windows, key, hash, and whether its key repeats inside."""
    start, end, first = words_of(offsets, raw)
    none = {n: np.zeros(0, np.int64) for n in ("text", "pos", "n", "key", "hash", "twice")}
    gram = min(GRAM, length)
    grams = length - gram + 1  # parts of a window
    if len(start) < length:
        return none
    word = _hashes(mix(raw.astype(np.uint64) + np.uint64(1)), start, end, _BASE)
    part = np.zeros(len(word) - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            part = part * _WORD_BASE + word[i : len(part) + i]
    part = mix(part)
    least, width = part, 1
    while width < grams:
        step = min(width, grams - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = text[: len(least)] == text[length - 1 : length - 1 + len(least)]
    window = np.flatnonzero(valid)
    if not len(window):
        return none
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (least[window[1:]] != least[window[:-1]]) | (text[window[1:]] != text[window[:-1]])
    at = np.flatnonzero(new)
    begin, n = window[at], np.diff(np.append(at, len(window)))
    last = begin + n - 1
    near = np.arange(grams)
    twice = np.zeros(len(begin), bool)
    for a in range(0, len(begin), 1 << 16):
        b = slice(a, a + (1 << 16))
        head = part[begin[b, None] + near].argmin(axis=1) + begin[b]
        tail = last[b] + grams - 1 - part[last[b, None] + near[::-1]].argmin(axis=1)
        twice[b] = head != tail
    return {"text": text[begin], "pos": begin - first[text[begin]], "n": n, "key": least[begin].view(np.int64),
            "hash": _hashes(word, begin, last + length, _WORD_BASE).view(np.int64), "twice": twice}


def _occurrences(docs: DataFrame, length: int, only_keys: bool) -> DataFrame:
    """Segments of documents (id, th, text); with ``only_keys`` just key and weight."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20):
            s = segments(*utf8(part.column("text")), length)
            if not len(s["key"]):
                continue
            if only_keys:
                key, at = np.unique(s["key"], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, 1 + s["twice"]).astype(np.int64))], ["key", "weight"])
            else:
                row = pa.array(s["text"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(row) for c in ("id", "th")], pa.array(s["pos"] << 32 | s["n"]), pa.array(s["key"]), pa.array(s["hash"])],
                    ["id", "th", "span", "key", "hash"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, "key bigint, weight bigint" if only_keys else f"id {kind}, th bigint, span bigint, key bigint, hash bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """The documents with their text compressed, for the shuffles that need it."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text", 8 << 20):
            offsets, raw = utf8(part.column("text"))
            z = [press.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(z, pa.binary())], [*others, "z"])

    others = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(run, docs.select(*others, F.lit(b"").alias("z")).schema)


def _with_text(spans: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """Packed documents with the lists of their ``spans`` (id, th, x); an equal id may be null."""
    lists = spans.groupBy("id", "th").agg(F.collect_list("x").alias("xs")).withColumnsRenamed({"id": "id_", "th": "th_"})
    packed = _packed(docs)
    same = packed["id"].eqNullSafe(lists["id_"]) & (packed["th"] == lists["th_"])
    return packed.join(lists, same, how).drop("id_", "th_")


def _document(z: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompressobj().decompress(z).split()


def _fetch(firsts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The words of each first occurrence: rows (id, th, span, key, crowded, words)."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                words = _document(row["z"])
                for x in row["xs"]:
                    pos, n = x["span"] >> 32, x["span"] & 0xFFFFFFFF
                    rows.append((row["id"], row["th"], x["span"], x["key"], x["crowded"], b" ".join(words[pos : pos + n + length - 1])))
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    def table(rows):
        kinds = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "th", "span", "key", "crowded", "words"])

    id_type = docs.select("id").limit(0).toArrow().schema.field("id").type
    asked = firsts.select("id", "th", F.struct("span", "key", "crowded").alias("x"))
    kind = docs.schema["id"].dataType.simpleString()
    return _with_text(asked, docs.select("id", "th", "text"), "inner").mapInArrow(run, f"id {kind}, th bigint, span bigint, key bigint, crowded boolean, words binary")


def repeats_in_shard(ids: np.ndarray, spans: np.ndarray, words: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment of a shard, the windows that also start earlier in a segment of the shard.

    ``ids``: the rank of each segment's document.  Index and stream are the same segments.
    """
    split = [w.split() for w in words]
    sizes = np.array([len(s) for s in split], np.int64)
    number: dict[bytes, int] = {}
    text = np.empty(int(sizes.sum()) + len(split), np.int64)
    at = 0
    starts = np.zeros(len(split), np.int64)
    for i, s in enumerate(split):
        starts[i] = at
        text[at : at + len(s)] = [number.setdefault(w, len(number) + 1) for w in s]
        text[at + len(s)] = 0  # separator
        at += len(s) + 1
    index = FMIndex(text, length)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(split)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    matched, low, high = index.matching_statistics(text, starts[owner] + offset, length)
    # the place in the corpus of every position of the indexed text, as a dense rank
    segment = np.repeat(np.arange(len(split)), sizes + 1)
    word = np.arange(len(text)) - starts[segment] + (spans[segment] >> 32)
    by = np.lexsort((word, ids[segment]))
    rank = np.empty(len(text), np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (ids[segment[by[1:]]] != ids[segment[by[:-1]]]) | (word[by[1:]] != word[by[:-1]])
    rank[by] = np.cumsum(new)
    hit = np.flatnonzero((matched == length) & (high - low > 1))
    earlier = np.zeros(len(owner), bool)
    if len(hit):
        bounds, which = np.unique(low[hit], return_inverse=True)
        top = np.zeros(len(bounds), np.int64)
        top[which] = high[hit]
        places = np.append(rank[index.order], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(places, np.stack([bounds, top], axis=1).ravel())[::2]
        earlier[hit] = least[which] < rank[starts[owner[hit]] + offset[hit]]
    ends = np.cumsum(counts)
    return [np.flatnonzero(earlier[a:b]) for a, b in zip(ends - counts, ends)]


def runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(first, how many) of the runs of consecutive numbers."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) != 1) + 1
    begin = np.concatenate([[0], cut])
    return list(zip(numbers[begin].tolist(), np.diff(np.append(begin, len(numbers))).tolist()))


def _in_shards(fetched: DataFrame, shards: int, length: int) -> DataFrame:
    """Spans of the windows that occur earlier, found with one index per shard."""
    schema = fetched.select("id", "th", "span").schema

    def solve(table: pa.Table) -> pa.Table:
        places = list(zip(*[table.column(c).to_pylist() for c in ("id", "th")]))
        order = {p: i for i, p in enumerate(sorted(set(places), key=lambda p: (p[0] is not None, p)))}
        spans = table.column("span").to_numpy()
        found = repeats_in_shard(np.array([order[p] for p in places]), spans, table.column("words").to_pylist(), length)
        rows = [(*p, ((int(s) >> 32) + a) << 32 | n) for p, s, f in zip(places, spans, found) for a, n in runs(f)]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.table([pa.array(c, table.schema.field(x).type) for c, x in zip(columns, ("id", "th", "span"))], names=["id", "th", "span"])

    return fetched.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(solve, schema)


def _one_by_one(fetched: DataFrame, length: int, place: list[str]) -> DataFrame:
    """Spans of the windows of crowded keys that occur earlier, merged by their hash."""
    kind = StructType([*fetched.select("id", "th", "span").schema.fields])

    def explode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.array(batch.column("words").to_pylist(), pa.large_binary())
            offsets, raw = utf8(joined.cast(pa.large_string(), safe=False))
            start, end, first = words_of(offsets, raw)
            value = mix(raw.astype(np.uint64) + np.uint64(1))
            one, two = (_hashes(value, start, end, b) for b in (_BASE, _WORD_BASE))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first) - length + 1)
            offset = np.arange(len(row)) - np.searchsorted(row, row)
            at = first[row] + offset
            pos = (batch.column("span").to_numpy() >> 32)[row] + offset
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in ("id", "th")], pa.array(pos << 32 | 1),
                 *[pa.array(_hashes(h, at, at + length, b).view(np.int64)) for h, b in ((one, _WORD_BASE), (two, _BASE))]], ["id", "th", "span", "h1", "h2"])

    windows = fetched.mapInArrow(explode, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kind)}, h1 bigint, h2 bigint")
    least = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "span")).alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    least = materialize(least, "first-windows")  # so that the join below can split a frequent window
    return windows.join(least, ["h1", "h2"]).filter(~F.struct(*place).eqNullSafe(F.col("least"))).select(*place)


def repeated_spans(docs: DataFrame, length: int, *, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Columns id, th, span: runs of windows (first word << 32 | windows) whose word sequence starts earlier too.

    ``docs`` has the columns id, th and text.  Segments of one key with equal 64-bit hashes count as equal without a look at
    their words, as do windows of crowded keys with equal 128-bit hashes; all other windows are compared in an index.
    """
    keys = _occurrences(docs, length, True).groupBy("key").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("key")
    place = ["id", "th", "span"]
    seen = materialize(_occurrences(docs, length, False).join(keys, "key"), "segments")
    distinct = seen.groupBy("key", "hash").agg(F.min(F.struct(*place)).alias("least"), F.count(F.lit(1)).alias("c"))
    distinct = materialize(distinct, "distinct-segments")
    # all but the first of equal segments go whole
    copies = seen.join(distinct.filter("c > 1").select("key", "hash", "least"), ["key", "hash"])
    copies = copies.filter(~F.struct(*place).eqNullSafe(F.col("least"))).select(*place)
    crowded = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowd).select("key", F.lit(True).alias("crowded"))
    firsts = distinct.select("least.*", "key").join(crowded, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    fetched = materialize(_fetch(firsts, docs, length), "segment-words")
    total = fetched.agg(F.sum(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)) + length).alias("w")).first()["w"] or 0
    found = _in_shards(fetched.filter(~F.col("crowded")), max(1, math.ceil(total / shard_words)), length)
    return copies.unionByName(found).unionByName(_one_by_one(fetched.filter("crowded"), length, place))


def documents_of(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Columns id, th, text, and c0, c1, ... for ``carry``; th tells texts of one id apart, and is 0 where an id occurs once."""
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    again = materialize(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("id_")), "repeated-ids")
    if again.isEmpty():
        return docs.withColumn("th", F.lit(0).cast("bigint"))
    marked = docs.join(again.withColumn("many", F.lit(True)), F.col("id").eqNullSafe(F.col("id_")), "left")
    return marked.select(*docs.columns, F.when(F.col("many"), F.xxhash64("text")).otherwise(0).cast("bigint").alias("th"))


def remove_repeats(
    df: DataFrame, *, length: int = 20, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, shard_words: int = SHARD_WORDS,
    carry: tuple[str, ...] = (), original: bool = False
) -> DataFrame:
    """Columns id_col, n_words, n_removed, kept (the words that stay, joined by one space): one row per row of ``df``.

    ``carry`` names further columns of ``df`` to take along; ``original`` leaves a text from which nothing goes as it is.

    A word goes if a window over it also starts earlier: at a smaller id, or earlier in the same document.  Null ids
    come before all others, texts of one id in the order of their hash.  Null and empty texts have no words; texts
    of fewer words than a window lose none.  A very long text is held whole in a task, in time and memory linear in it.  Further columns are not read; an empty table gives an empty table.
    """
    docs = documents_of(df, id_col, text_col, list(carry))
    spans = repeated_spans(docs.select("id", "th", "text"), length, crowd=crowd, shard_words=shard_words)

    def run(batches):
        for batch in batches:
            out = []
            for z, xs in zip(batch.column("z").to_pylist(), batch.column("xs").to_pylist()):
                words = _document(z)
                gone = np.zeros(len(words) + 1, np.int64)
                for x in xs or ():
                    pos = x >> 32
                    gone[pos] += 1
                    gone[pos + (x & 0xFFFFFFFF) + length - 1] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k] if xs else words
                text = zstandard.ZstdDecompressor().decompressobj().decompress(z) if original and len(kept) == len(words) else b" ".join(kept)
                out.append((len(words), len(words) - len(kept), text.decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in others], *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]],
                    [*others, "n_words", "n_removed", "kept"])

    whole = _with_text(spans.select("id", "th", F.col("span").alias("x")), docs, "left")
    others = ["id", *[f"c{i}" for i in range(len(carry))]]
    numbers = [F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.lit("").alias("kept")]
    found = whole.mapInArrow(run, docs.select(*others, *numbers).schema)
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
