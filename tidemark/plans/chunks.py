"""Models as prefix sums over chunks, joined back to the rows they score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import running

def lagged_prefix(stats: DataFrame, keys: list[str], chunk: str, names: list[str], *, span: int = 100_000) -> DataFrame:
    """Sums of all strictly earlier chunks for each chunk present in ``stats``."""
    return running(stats, keys, chunk, {n: ("sum", f"`{n}`") for n in names}, exclusive=True, span=span).select(*keys, chunk, *names)


def latest_before(rows: DataFrame, models: DataFrame, keys: list[str], at: str, names: list[str], *, span: int = 100_000) -> DataFrame:
    """As-of join: each row of ``rows`` gets the newest model with a strictly smaller ``at``.

    Unites both sides and carries the last model forward in a two-level scan, so gaps in ``at``
    need no dense calendar and a busy key is not scanned in one task.  ``at`` must be unique in
    ``rows`` per key.
    """
    packed = F.struct(*[F.col(n) for n in names]).alias("__model")
    marks = models.select(*keys, (F.col(at).cast("bigint") * 2 + 1).alias("__at"), packed)
    probes = rows.withColumn("__at", F.col(at).cast("bigint") * 2).withColumn("__probe", F.lit(True))
    both = probes.unionByName(marks, allowMissingColumns=True)
    run = running(both, keys, "__at", {"__last": ("last", F.col("__model"))}, span=span)
    out = run.filter("__probe")
    return out.select(*rows.columns, *[F.col(f"__last.{n}").alias(n) for n in names])


def score_join(rows: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join rows to one model row per chunk.

    No hint is given: the planner broadcasts the model side when its measured size allows, and
    otherwise AQE splits a chunk that holds a large share of the rows.
    """
    return rows.join(models, on, "left")


def salted_join(rows: DataFrame, small: DataFrame, on: list[str], *, salts: int = 16) -> DataFrame:
    """Equi-join that spreads each key of ``rows`` over ``salts`` tasks by copying ``small``."""
    spread = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], "left").drop("__salt")
