"""Near-duplicates by the Jaccard similarity of word shingles: SimHash balls propose, the shingle sets decide.

A text has ``SEEDS`` fingerprints of 64 bits, each over the set of its shingle hashes mixed anew.  They are cut into
blocks of 16 bits, and every block emits the ball of radius 1 around its lower ``NARROW`` bits (13 variants).  A ball is
kept apart by a mark of its block, the least of the shingle hashes under a mixing of the block's own, so that two texts
meet where they share a mark and that block of theirs differs in at most two bits.  Those that meet are neighbours if all
bits together differ in at most ``FAR``.  Star contraction makes classes of neighbours, and within a class the sets of
64-bit shingle hashes are compared until whatever is linked there is connected: no pair below the similarity is a link.
At a similarity of 0.8 a bit differs with a probability of 0.15 (0.19 for five shingles against four) and a mark is
shared with one of 0.8, so a pair is found with one of 0.99998 (0.9996).  Texts without a common shingle share no mark,
so that groups grow with the copies of a text and not with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix
from tidemark.llm.components import connected
from tidemark.llm.minhash import classes, parts_of
from tidemark.llm.simhash import BITS, LARGE, first_of_each, majority, variants
from tidemark.session import materialize

SEEDS, WIDTH, FAR = 3, 16, 56
NARROW = 12  # bits of a block that a ball is made of where blocks have marks
FEW = 256  # fingerprints of a variant that are compared pair by pair; among more, only what connects them is sought
_SEED = np.random.default_rng(29).integers(0, 1 << 64, SEEDS, np.uint64)
_PRINTS = [f"f{i}" for i in range(SEEDS)]
_BLOCKS = BITS // WIDTH  # of one fingerprint
_LEAST = [f"m{i}" for i in range(SEEDS * _BLOCKS)]
_MIX = np.random.default_rng(31).integers(0, 1 << 64, (2, len(_LEAST), 1), np.uint64)
_PLACE = 20  # lower bits of a variant: block and value, under its mark


def prints(hashes: np.ndarray) -> list[int]:
    """The fingerprints of a set of shingle hashes, as signed longs; none without shingles."""
    if not len(hashes):
        return []
    return np.array([majority(mix(hashes ^ seed)) for seed in _SEED], np.uint64).view(np.int64).tolist()


def least(hashes: np.ndarray) -> list[int]:
    """The mark of each block of a set of shingle hashes, as signed longs with room for the variant; none without shingles."""
    if not len(hashes):
        return []
    found = np.full(len(_LEAST), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        found = np.minimum(found, ((hashes[at : at + (1 << 13)] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=1))
    return (mix(found) >> np.uint64(_PLACE) << np.uint64(_PLACE)).view(np.int64).tolist()


def signature(hashes: np.ndarray) -> list[int]:
    return prints(hashes) + least(hashes)


def _near(f: list[np.ndarray], i, j) -> np.ndarray:
    return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in f) <= FAR


def _first_meeting(variant: np.ndarray, f: list[np.ndarray], i: np.ndarray, j: np.ndarray, radius: int, marked: bool) -> np.ndarray:
    """Whether ``variant`` is the one, of all in which fingerprints i and j meet, that lists the pair; with marks, of all of its block."""
    low = np.uint64((1 << (NARROW if marked else WIDTH)) - 1)
    if marked:
        block = variant[i] >> WIDTH & (1 << _PLACE - WIDTH) - 1
        shift = (WIDTH * (block % _BLOCKS)).astype(np.uint64)
        a, b = (np.take_along_axis(np.stack([x[k] for x in f]), (block // _BLOCKS)[None], 0)[0] >> shift & low for k in (i, j))
    else:
        a, b = (np.stack([x[k] >> np.uint64(WIDTH * n) & low for x in f for n in range(_BLOCKS)]) for k in (i, j))
        block = np.argmax(np.bitwise_count(a ^ b) <= 2 * radius, axis=0)
        a, b = (np.take_along_axis(x, block[None], 0)[0] for x in (a, b))
    apart = a ^ b
    middle = np.minimum(a, b) ^ (apart & (~apart + np.uint64(1)))
    return variant[i] & (1 << _PLACE) - 1 == (block << WIDTH | middle.astype(np.int64))


def _few(variant: np.ndarray, root: np.ndarray, f: list[np.ndarray], end: np.ndarray, at: np.ndarray, radius: int, marked: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the roots of neighbours among rows ``at``, each of which meets the rows after it before ``end``."""
    lower, upper, step = [], [], 1
    while len(at := at[at + step < end[at]]):
        i = at[root[at] != root[at + step]]
        i = i[_near(f, i, i + step)]
        i = i[_first_meeting(variant, f, i, i + step, radius, marked)]
        lower.append(i)
        upper.append(i + step)
        step += 1
    if not lower:
        return []
    i, j = np.concatenate(lower), np.concatenate(upper)
    # every row hangs on its first neighbour, and of the other pairs those stay that join two such stars
    hub = np.arange(len(end))
    np.minimum.at(hub, j, i)
    between = np.unique(np.stack([hub[i], hub[j]], axis=1), axis=0)
    hung = np.flatnonzero(hub != np.arange(len(hub)))
    i, j = np.concatenate([between[:, 0], hub[hung]]), np.concatenate([between[:, 1], hung])
    return [(root[i[i != j]], root[j[i != j]])]


def _many(root: np.ndarray, f: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the roots of whatever neighbours connect among all rows."""
    found, left, stack = [], np.arange(len(root)), []
    while len(left):
        if not stack:
            stack, left = [left[0]], left[1:]
        x = stack.pop()
        near = _near(f, x, left)
        others = np.unique(root[left[near]])
        others = others[others != root[x]]
        found.append((np.repeat(root[x], len(others)), others))
        stack += left[near].tolist()
        left = left[~near]
    return found


def links(distinct: DataFrame, *, radius: int = 1, large: int = LARGE, few: int = FEW) -> DataFrame:
    """Edges (a, b) between roots of ``distinct`` (root, f0, f1, ...): the roots of whatever neighbours connect are connected.

    Rows of one root need no edge.  With the marks m0, m1, ... only rows that share a block's mark meet there, and by the
    lower ``NARROW`` bits of the block; without, by the whole block.  ``radius`` is that of the balls, 0 for equal blocks.
    A variant of more than ``large`` rows is cut into parts, and every two of them are compared in a task of their own.
    """
    marked = _LEAST[0] in distinct.columns
    width = NARROW if marked else WIDTH
    places, balls = [], []
    for b, (name, k) in enumerate((name, k) for name in _PRINTS for k in range(_BLOCKS)):
        place = F.lit(b << WIDTH).cast("bigint")
        places.append(F.col(_LEAST[b]).bitwiseOR(place) if marked else place)
        value = F.shiftrightunsigned(name, WIDTH * k).bitwiseAND(F.lit((1 << width) - 1))
        balls.append(variants(value.bitwiseOR(places[-1]), width, radius))
    emitted = distinct.select("root", *_PRINTS, F.explode(F.concat(*balls)).alias("variant"))
    # a variant has no more rows than its mark, and marks are few beside variants: only variants of a crowded mark are counted
    whole = F.col("variant").bitwiseAND(F.lit(-1 << WIDTH))
    busy = distinct.select(F.explode(F.array(*places)).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    busy = materialize(busy.filter(F.col("n") > large).select("place"), "crowded-marks")
    crowded = emitted.join(busy, whole == F.col("place"), "left_semi").groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large)
    if not busy.isEmpty():
        crowded = materialize(crowded.select("variant", F.ceil(F.col("n") / large).cast("int").alias("parts")), "crowded-variants")
    if busy.isEmpty() or crowded.isEmpty():
        dealt = emitted.withColumn("tile", F.lit(0))
    else:
        own = F.pmod(F.xxhash64(*_PRINTS), F.col("parts"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: (F.least(q, own) * F.col("parts") + F.greatest(q, own)).cast("int"))
        cut = emitted.join(F.broadcast(crowded), "variant", "left")  # one row for every ``large`` rows at most
        dealt = cut.select("root", *_PRINTS, "variant", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(tiles)).alias("tile"))

    def collide(batches):
        names = ["variant", "tile", "root", *_PRINTS]
        held = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names)]
            if not len(held[0]):
                continue
            # the last run may go on in the next batch
            last = int(np.argmax((held[0] == held[0][-1]) & (held[1] == held[1][-1])))
            yield from pairs([h[:last] for h in held])
            held = [h[last:] for h in held]
        yield from pairs(held)

    def pairs(rows):
        variant, tile, root, *f = rows
        if not len(variant):
            return
        f = [np.ascontiguousarray(x).view(np.uint64) for x in f]
        cut = np.flatnonzero((np.diff(variant) != 0) | (np.diff(tile) != 0)) + 1
        cut = np.concatenate([[0], cut, [len(variant)]])
        sizes = np.diff(cut)
        found = _few(variant, root, f, np.repeat(cut[1:], sizes), np.flatnonzero(np.repeat(sizes <= few, sizes)), radius, marked)
        for k in np.flatnonzero(sizes > few):
            found += _many(root[cut[k] : cut[k + 1]], [x[cut[k] : cut[k + 1]] for x in f])
        a, b = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    together = dealt.repartition("variant", "tile").sortWithinPartitions("variant", "tile")
    return together.mapInArrow(collide, "a bigint, b bigint")


def _rooted(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``prints`` with the root of their root in ``roots``, if there is one."""
    known = roots.withColumnRenamed("root", "top")
    others = [c for c in prints.columns if c != "root"]
    return prints.join(known, F.col("root") == F.col("node"), "left").select(F.coalesce("top", "root").alias("root"), *others)


def neighbours(distinct: DataFrame) -> DataFrame:
    """``distinct`` (f0, f1, ..., and the marks m0, m1, ... where there are) with the ``root`` of each row's class of neighbours.

    Equal blocks make the first classes, so that large groups of copies need few edges where their balls collide.
    """
    alone = distinct.select(F.col("f0").alias("root"), "*")
    first = materialize(_rooted(alone, connected(links(alone, radius=0))), "equal-blocks")
    return _rooted(first, connected(links(first)))


def _proposed(distinct: DataFrame) -> DataFrame:
    """The texts ``g`` of each class of neighbours (``band``) and its number of ``parts``; ``marks`` are a text's fingerprints and marks."""
    own = distinct.filter(F.size("marks") > 0).select("g", *[F.col("marks")[i].alias(name) for i, name in enumerate([*_PRINTS, *_LEAST])])
    roots = neighbours(own.drop("g").distinct()).select(F.col("root").alias("band"), "f0").distinct()
    classed = materialize(own.select("g", "f0").join(roots, "f0").select("g", "band"), "neighbours")
    sizes = classed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", parts_of(F.col("n")).alias("parts"))
    return materialize(classed.join(sizes, "band"), "neighbour-classes")


def near_duplicates(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and ``component`` (smallest id in the row's connected class), one row per row of ``df``.

    Texts are linked when the Jaccard similarity of their sets of ``shingle`` lower-case words is ``similarity`` or more;
    the balls are made for 0.8 and more.  Null texts and texts without words are equal.  Rows without an id are classed
    but never name a class (a class of such rows only has a null component).  Repeated rows stay repeated; an empty
    table gives an empty table.
    """
    return classes(df, signature, _proposed, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col)


def one_of_each(df: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the row of the smallest id of each class; rows without an id stay, repeated ids leave one row."""
    return first_of_each(df, near_duplicates(df, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col), id_col)
