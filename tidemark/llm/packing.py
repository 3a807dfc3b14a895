"""Best-fit packing after a Martello-Toth dominance reduction, on the histogram of piece lengths.

Lengths are whole numbers up to the capacity, so the instance is one count per length: at most ``capacity``
numbers however many documents there are.  The reduction fixes bins that dominate every other bin of their
largest piece, with multiplicities; the rest is packed best-fit, longest first, also by multiplicities.  Pieces
then find their place from their rank among the pieces of the same length, so no task sees a whole length.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import slices, texts
from tidemark.session import materialize

Bins = list[tuple[tuple[int, ...], int]]


def _dominant(w: int, sizes: list[int], count: Counter, capacity: int) -> int | None:
    """The piece whose bin with ``w`` dominates all bins of ``w``: 0 for none beside it, None if there is no such bin.

    ``sizes``: lengths with a count, ascending.
    """
    rest = capacity - w
    fits = sizes[: bisect.bisect_right(sizes, rest)]
    if fits and fits[-1] == w and count[w] < 2:
        fits = fits[:-1]
    if not fits:
        return 0
    left = Counter({s: min(count[s] - (s == w), 3) for s in fits})
    best = fits[-1]
    if best == rest:
        return best
    least: list[int] = []
    for s in fits:
        least += [s] * left[s]
        if len(least) >= 3:
            break
    if len(least) < 2 or least[0] + least[1] > rest:
        return best
    if len(least) >= 3 and sum(least[:3]) <= rest:
        return None
    lo, hi, most = 0, len(fits) - 1, 0  # no three fit: compare with the largest pair that does
    while lo <= hi:
        pair = fits[lo] + fits[hi]
        if pair > rest or (lo == hi and left[fits[lo]] < 2):
            hi -= 1
        else:
            most, lo = max(most, pair), lo + 1
    return best if best >= most else None


def reduce_dominated(count: Counter, capacity: int) -> Bins:
    """Take out of ``count`` every piece whose bin can be fixed for good; returns the fixed bins."""
    fixed: Bins = []
    changed = True
    while changed:
        changed = False
        for w in sorted(count, reverse=True):
            while count[w]:
                sizes = sorted(s for s in count if count[s])
                mate = _dominant(w, sizes, count, capacity)
                if mate is None:
                    break
                if mate == 0:
                    n, bin_ = count[w], (w,)
                elif mate == w:
                    n, bin_ = count[w] // 2, (w, w)
                else:
                    n, bin_ = min(count[w], count[mate]), (w, mate)
                for s in bin_:
                    count[s] -= n
                fixed.append((bin_, n))
                changed = True
    return fixed


def best_fit(count: Counter, capacity: int) -> Bins:
    """Best-fit of the remaining pieces, longest first, over groups of equal bins."""
    open_: dict[int, list[list]] = {}  # room -> groups [pieces, number of bins]
    rooms: list[int] = []

    def add(room: int, bin_: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([bin_, n])

    for w in sorted((s for s in count if count[s]), reverse=True):
        n = count[w]
        while n:
            at = bisect.bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                if n >= each:
                    add(capacity - each * w, (w,) * each, n // each)
                if n % each:
                    add(capacity - n % each * w, (w,) * (n % each), 1)
                break
            room = rooms[at]
            group = open_[room][-1]
            k = min(n, group[1])
            group[1] -= k
            bin_ = group[0]
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            add(room - w, (*bin_, w), k)
            n -= k
    return [(bin_, n) for groups in open_.values() for bin_, n in groups]


def plan(lengths: dict[int, int], capacity: int) -> Bins:
    """(pieces of a bin, number of such bins) for a histogram of lengths up to ``capacity``."""
    count = Counter({w: n for w, n in lengths.items() if n})
    return reduce_dominated(count, capacity) + best_fit(count, capacity)


def places(bins: Bins) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in the order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for bin_, n in bins:
        offset = 0
        for w in bin_:
            runs.setdefault(w, []).append((used[w], sequence, offset))
            used[w] += n
            offset += w
        sequence += n
    return {w: np.array(x, np.int64) for w, x in runs.items()}


@functools.lru_cache(maxsize=2)
def fast_codec(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary at ``path`` in a compiled encoder that gives the same ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = bpe.byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    for content in special:
        ranks.pop(content.encode(), None)
    return tiktoken.Encoding("from-file", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str) -> Callable[[str], np.ndarray]:
    codec = fast_codec(path)
    special = list(codec.special_tokens_set)

    def ids(text: str) -> np.ndarray:
        try:
            if any(s in text for s in special):
                return np.array(codec.encode(text, allowed_special="all"), "<u4")
            return np.array(codec.encode_ordinary(text), "<u4")
        except BaseException as error:  # the compiled splitter gives up on extreme runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.frombuffer(bpe.load(path).encode([text])[0], "<u4")

    return ids


def pieces(df: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, crc of the ids, the task and the rank in it among equal lengths.

    A text's ids end with ``end_id``, so an empty or null text is one piece of one token.  A text of more than
    ``capacity`` ids is cut so that all pieces but the first are full.
    """

    def run(batches):
        ids_of, seen, task = token_ids(path), Counter(), TaskContext.get().partitionId()
        last = np.array([end_id], "<u4")
        for part in slices(batches, "text"):
            rows = []
            for key, text in zip(part.column("id").to_pylist(), texts(part.column("text"))):
                ids = np.concatenate([ids_of(text), last])
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((key, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                    seen[b - a] += 1
            key, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, part.schema.field("id").type), pa.array(rest[0], pa.int32()), *[pa.array(x, pa.int64()) for x in rest[1:]]],
                ["id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint")


def pack(df: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece, in few sequences.

    Null and empty texts are pieces of one token; repeated rows are packed as often as they occur; an empty
    table gives an empty result; further columns are not read.  What reaches the driver is one count per length.
    """
    cut = materialize(pieces(df, path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    hist = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(hist, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length):
                at, runs = np.flatnonzero(length == w), table[int(w)]
                run = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = run[:, 1] + rank[at] - run[:, 0], run[:, 2]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = ["id", "piece", "start", "length", "ids_crc32"]
    ranked = cut.join(base, ["length", "task"]).select(*kept, (F.col("rank") + F.col("base")).alias("rank"))
    kind = cut.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)
