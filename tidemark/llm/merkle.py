"""A Merkle manifest of a table: digests per row, a tree per group, a tree over the groups, a witness per row.

A ``Frontier`` takes leaves one by one and keeps, for each level, the complete subtrees that still wait for siblings.
The witnesses of the leaves below an open subtree are partial; when its run of siblings is complete, they are extended
by the siblings before and after it.  Trees are cut into aligned blocks of ``arity ** levels`` leaves, each appended in
one pass over its sorted rows; the roots of the blocks are the leaves appended in the next round, and so on, so no task
holds more than one block however large a group is.  Only digests are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.plans.scan import with_global_seq
from tidemark.session import materialize

WITNESS = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def depth(n: int, arity: int) -> int:
    """Levels above ``n`` leaves: 0 for one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


class Frontier:
    """Append-only tree of one block: open subtrees by level, and the witnesses of its leaves so far."""

    def __init__(self, arity: int = 3):
        self.arity = arity
        self.open: list[list[tuple[str, int, int]]] = [[]]  # (digest, first leaf, leaf after the last)
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._add(0, (leaf, len(self.witness) - 1, len(self.witness)))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        while len(self.open) <= level:
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        names = [d for d, *_ in run]
        for i, (_, first, last) in enumerate(run):
            step = ("".join(names[:i]), "".join(names[i + 1 :]))
            for leaf in range(first, last):
                self.witness[leaf].append(step)
        self._add(level + 1, (digest("".join(names)), run[0][1], run[-1][2]))

    def finish(self, levels: int) -> str:
        """Complete the short last run of each of ``levels`` levels; the digest that is left."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def fold(leaf: str, witness: list[tuple[str, str]]) -> str:
    for before, after in witness:
        leaf = digest(before + leaf + after)
    return leaf


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    coded = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def _append_blocks(arity: int, levels: int):
    """Batches sorted by (tree, pos), blocks whole, to the same rows with their witness in the block and its root."""
    size = arity**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, frontier = None, [], Frontier(arity)

        def done():
            height = min(levels, depth(block[2], arity))
            root = frontier.finish(height)
            steps, n = [s for w in frontier.witness for s in w], len(frontier.witness)
            pairs = pa.StructArray.from_arrays([pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)], ["before", "after"])
            ends = pa.array([height * i for i in range(n + 1)], pa.int32())
            rows = pa.Table.from_batches(parts).append_column("witness", pa.ListArray.from_arrays(ends, pairs))
            yield from rows.append_column("top", pa.array([root] * n, pa.string())).combine_chunks().to_batches()

        for batch in batches:
            places = list(zip(batch.column("tree").to_pylist(), [p // size for p in batch.column("pos").to_pylist()], batch.column("n").to_pylist()))
            leaves, begin = batch.column("digest").to_pylist(), 0
            while begin < len(places):
                if places[begin] != block:
                    if parts:
                        yield from done()
                    block, parts, frontier = places[begin], [], Frontier(arity)
                end = begin
                while end < len(places) and places[end] == block:
                    frontier.append(leaves[end])
                    end += 1
                parts.append(batch.slice(begin, end - begin))
                begin = end
        if parts:
            yield from done()

    return run


def _grow(nodes: DataFrame, arity: int, levels: int, most: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rounds of block appends over ``nodes`` (tree, pos, n, digest, and more), trees of at most ``most`` nodes.

    Returns the first round (``nodes`` with witness and top), the roots (tree, root), and the later rounds, whose
    row (tree, pos, witness) is block ``pos`` of the round before.
    """
    size, rounds, roots = arity**levels, [], None
    while True:
        placed = nodes.repartition("tree", F.floor(F.col("pos") / size)).sortWithinPartitions("tree", "pos")
        kind = StructType([*nodes.schema.fields, StructField("witness", WITNESS), StructField("top", StringType())])
        out = materialize(placed.mapInArrow(_append_blocks(arity, levels), kind), "merkle-blocks")
        rounds.append(out)
        first = out.filter(F.col("pos") % size == 0)
        ready = first.filter(F.col("n") <= size).select("tree", F.col("top").alias("root"))
        roots = ready if roots is None else roots.unionByName(ready)
        if most <= size:
            return rounds[0], roots, rounds[1:]
        most = -(-most // size)
        nodes = first.filter(F.col("n") > size).select(
            "tree", F.expr(f"pos div {size}").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))


def _above(first: DataFrame, later: list[DataFrame], size: int) -> DataFrame:
    """(tree, block, above): what the later rounds add to the witnesses of each block of the first round."""
    empty = F.array().cast(WITNESS)
    up = None
    for out in reversed(later):
        rows = out.select("tree", "pos", "witness")
        if up is not None:
            rows = rows.withColumn("block", F.expr(f"pos div {size}")).join(up, ["tree", "block"], "left")
            rows = rows.select("tree", "pos", F.concat("witness", F.coalesce("above", empty)).alias("witness"))
        up = rows.select("tree", F.col("pos").alias("block"), F.col("witness").alias("above"))
    blocks = first.filter(F.col("pos") % size == 0).select("tree", F.expr(f"pos div {size}").alias("block"))
    if up is None:
        return blocks.withColumn("above", empty)
    return blocks.join(up, ["tree", "block"], "left").select("tree", "block", F.coalesce("above", empty).alias("above"))


def manifest(
    df: DataFrame, *, key: Column, group: Column, fields: list[Column], others: dict[str, Column] | None = None, arity: int = 3, levels: int = 6
) -> DataFrame:
    """Columns key, group, leaf, witness, subroot, root (and ``others``), one row per row of ``df``.

    ``leaf`` is ``leaf_digest(fields)``.  Each group's leaves ascend by key, a null key first and equal keys by digest, so
    repeated rows have a place each; while more than one node remains, every ``arity`` consecutive ones (the last
    run may be shorter, even one) become the digest of their concatenation.  What remains is ``subroot``, a lone leaf itself.
    Subroots in the order of their group (null first, then by UTF-8 bytes) give ``root`` likewise.  ``witness`` holds for
    each level, from the leaf to ``root``, the siblings before and after, so that ``folded`` rebuilds the root.
    Null and empty values are told apart by the digest; an empty table has no rows.
    """
    if arity < 2 or levels < 1:
        raise ValueError("a tree needs an arity of 2 and a level at least")
    size, extra = arity**levels, others or {}
    leaves = df.select(key.alias("key"), group.alias("group"), leaf_digest(fields).alias("digest"), *[c.alias(f"with_{n}") for n, c in extra.items()])
    leaves = materialize(leaves, "merkle-leaves")  # whole texts are read once; range bounds are sampled from digests
    placed = with_global_seq(leaves, ["group", "key", "digest"], name="row")

    groups = placed.groupBy("group").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = materialize(with_global_seq(groups, ["group"], name="tree"), "merkle-groups")
    known = groups.select(F.col("group").alias("name"), "tree", "start", "n")
    placed = placed.join(known, F.col("group").eqNullSafe(F.col("name"))).withColumn("pos", F.col("row") - F.col("start"))
    placed = placed.select("tree", "pos", "n", "digest", "key", "group", *[f"with_{n}" for n in extra])

    counts = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    first, roots, later = _grow(placed, arity, levels, counts["most"] or 1)
    tree, total = F.lit(0).cast("bigint").alias("tree"), F.lit(counts["groups"]).cast("bigint").alias("n")
    top, root, above = _grow(roots.select(tree, (F.col("tree") - 1).alias("pos"), total, F.col("root").alias("digest")), arity, levels, counts["groups"])
    by_group = top.withColumn("block", F.expr(f"pos div {size}")).join(_above(top, above, size), ["tree", "block"]).join(F.broadcast(root), "tree")  # one root
    by_group = by_group.select((F.col("pos") + 1).alias("tree"), F.col("digest").alias("subroot"), "root", F.concat("witness", "above").alias("over"))

    blocks = _above(first, later, size).join(by_group, "tree")
    blocks = materialize(blocks.select("tree", "block", F.concat("above", "over").alias("above"), "subroot", "root"), "merkle-witnesses")
    out = first.withColumn("block", F.expr(f"pos div {size}")).join(blocks, ["tree", "block"])
    return out.select("key", "group", F.col("digest").alias("leaf"), F.concat("witness", "above").alias("witness"), "subroot", "root",
                      *[F.col(f"with_{n}").alias(n) for n in extra])


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(witness, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def siblings(witness: Column) -> Column:
    """All siblings of a witness, level by level and left to right, as one text."""
    return F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), "")
