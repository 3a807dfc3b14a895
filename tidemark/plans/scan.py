"""Prefix scans that never put one key's whole history, or the whole table, into one task.

``Window.partitionBy(key).orderBy(seq)`` sends a key holding a third of the table to one task.
Here each key is cut into blocks of ``span`` consecutive order values: block totals are combined
map-side, the prefix over block totals runs on one small row per block, and the row-level window
is partitioned by (key, block), so no task ever sees more than ``span`` rows of one key.  Plans are
built from SQL text, which keeps planning quick when there are hundreds of measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

DEFAULT_SPAN = 1_000_000

_AGG = {"sum": "sum({})", "min": "min({})", "max": "max({})", "last": "last({}, true)"}


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, tuple[str, Column | str]],
    *,
    exclusive: bool = False,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add running ``sum`` / ``min`` / ``max`` / ``last`` columns in ``order`` within ``keys``.

    ``measures`` maps output name to (kind, column or SQL text).  ``order`` is a non-null integer
    column unique within a key; ``exclusive`` leaves the current row out (test-then-train).

    The prefix of a block enters its window as one extra row sorted first, so rows are shuffled once
    and never joined.
    """
    columns = df.columns
    block = f"cast(`{order}` as bigint) div {int(span)} AS __run_block"
    if all(isinstance(c, str) for _, c in measures.values()):
        base = df.selectExpr("*", block, *[f"{c} AS `__m_{n}`" for n, (_, c) in measures.items()])
    else:
        cols = {f"__m_{n}": F.expr(c) if isinstance(c, str) else c for n, (_, c) in measures.items()}
        base = df.withColumns({"__run_block": F.expr(block.removesuffix(" AS __run_block")), **cols})
    by = ", ".join(f"`{k}`" for k in keys)
    aggs = []
    for n, (kind, _) in measures.items():
        if kind == "last":
            aggs.append(F.expr(f"max_by(`__m_{n}`, CASE WHEN `__m_{n}` IS NOT NULL THEN `{order}` END) AS `__m_{n}`"))
        else:
            aggs.append(F.expr(f"{_AGG[kind].format(f'`__m_{n}`')} AS `__m_{n}`"))
    totals = base.groupBy(*keys, "__run_block").agg(*aggs)
    earlier = f"OVER (PARTITION BY {by or '0'} ORDER BY __run_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = totals.selectExpr(
        *[f"`{k}`" for k in keys], "__run_block", "false AS __is_row",
        *[f"{_AGG[kind].format(f'`__m_{n}`')} {earlier} AS `__m_{n}`" for n, (kind, _) in measures.items()])
    both = base.selectExpr("*", "true AS __is_row").unionByName(offsets, allowMissingColumns=True)
    within = ", ".join(x for x in (by, "__run_block") if x)
    frame = (
        f"OVER (PARTITION BY {within} ORDER BY __is_row, `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND "
        + ("1 PRECEDING)" if exclusive else "CURRENT ROW)"))
    outs = []
    for n, (kind, _) in measures.items():
        value = f"{_AGG[kind].format(f'`__m_{n}`')} {frame}"
        outs.append(f"{f'coalesce({value}, 0)' if kind == 'sum' else value} AS `{n}`")
    kept = [f"`{c}`" for c in columns if c not in measures]
    return both.selectExpr(*kept, "__is_row", *outs).filter("__is_row").drop("__is_row")


def with_seq(df: DataFrame, keys: list[str], order: str, *, name: str = "seq", span: int = DEFAULT_SPAN) -> DataFrame:
    """Dense 1-based position of each row within its key, by block counts."""
    return running(df, keys, order, {name: ("sum", "1L")}, span=span)


def with_global_seq(
    df: DataFrame, order: list[str], *, name: str = "seq", partitions: int | None = None
) -> DataFrame:
    """Dense 1-based position over the whole table by a total order, with no single-task window.

    Range-partition, sort each partition, write the (partition, index) pair once, then shift each
    partition by the rows before it.  Writing first pins the sampled range bounds.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    stamped = ranged.sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id())
    fixed = materialize(stamped, "global-seq")
    part = F.shiftright("__mid", 33)
    index = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = fixed.groupBy(part.alias("__part")).agg((F.max(index) + 1).alias("__n"))
    # one row per range partition, so its count is the session's partition setting, not the data
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        fixed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__off") + index + 1).cast("bigint"))
        .drop("__part", "__mid", "__off")
    )


def with_chunk(df: DataFrame, size: int, *, seq: str = "seq", name: str = "chunk_id") -> DataFrame:
    """Fixed-count chunk number, 0-based, of a dense 1-based position."""
    return df.withColumn(name, F.expr(f"(cast(`{seq}` as bigint) - 1) div {int(size)}"))


def with_halo(
    df: DataFrame, width: int, *, seq: str = "seq", bucket: str = "__bucket", home: str = "__home", size: int | None = None
) -> DataFrame:
    """Copy the last ``width`` rows of each bucket into the next one.

    After this a frame reaching back ``width`` rows fits inside one bucket of at most
    ``size + width`` rows per key; keep rows with ``home`` true in the result.
    """
    size = max(int(size or 0), int(width), 1)
    own = F.expr(f"(cast(`{seq}` as bigint) - 1) div {size}")
    pos = F.expr(f"(cast(`{seq}` as bigint) - 1) % {size}")
    places = F.when(pos >= size - width, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("__own", own)
        .withColumn(bucket, F.explode(places))
        .withColumn(home, F.col(bucket) == F.col("__own"))
        .drop("__own")
    )


def over_last(
    df: DataFrame,
    keys: list[str],
    width: int,
    outputs: dict[str, tuple],
    *,
    seq: str = "seq",
    size: int | None = None,
) -> DataFrame:
    """Bounded look-back frames without a per-key window.

    ``outputs`` maps name to (aggregate column, rows back from, rows back to), e.g.
    ``(F.sum("x"), 199, 0)`` for the last 200 rows including the current one.
    """
    reach = max(max(o[1], o[2]) for o in outputs.values())
    spread = with_halo(df, max(reach, 1, width), seq=seq, size=size or 10 * max(width, 1000))
    w = Window.partitionBy(*keys, "__bucket").orderBy(seq)
    spread = spread.withColumns({n: agg.over(w.rowsBetween(-frm, -to)) for n, (agg, frm, to) in outputs.items()})
    return spread.filter("__home").drop("__bucket", "__home")
