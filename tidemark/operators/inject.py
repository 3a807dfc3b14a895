"""Plant concept drift in a table: one projection, no shuffle beyond optional chunk statistics."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_normal, hash_uniform


@dataclasses.dataclass(frozen=True)
class Strength:
    """How hard one drift type hits; all factors are multiplied by the row's severity."""

    min_share: float  # least share of features touched
    noise_share: float  # probability a touched feature gets noise
    offset_share: float  # probability it gets an offset; otherwise it is scaled
    noise: float
    offset: float
    scale: float
    flip: float
    multiclass_flip: float


# fixed values: effect sizes per drift type
STRENGTHS = {
    "sudden": Strength(0.7, 0.25, 0.375, 5.0, 4.0, 4.0, 0.15, 0.7),
    "gradual": Strength(0.6, 0.30, 0.42, 4.0, 3.5, 3.0, 0.12, 0.6),
    "incremental": Strength(0.8, 0.25, 0.4125, 6.0, 5.0, 4.5, 0.10, 0.5),
    "recurring": Strength(0.9, 0.20, 0.36, 7.0, 6.0, 5.0, 0.08, 0.4),
}


@dataclasses.dataclass(frozen=True)
class DriftConfig:
    drift_type: str = "sudden"
    severity: float = 0.5
    position: float = 0.5
    width: float = 0.1
    n_cycles: int = 3
    seed: int = 42
    after: str = "clean"  # gradual only: rows after the ramp are 'clean' or stay 'drifted'

    def __post_init__(self):
        if self.drift_type not in STRENGTHS:
            raise ValueError(f"unknown drift type {self.drift_type!r}; choose from {sorted(STRENGTHS)}")
        if not 0 <= self.severity <= 1 or not 0 <= self.position <= 1 or self.width <= 0 or self.n_cycles < 1:
            raise ValueError("severity and position must lie in [0, 1], width and n_cycles must be positive")
        if self.after not in ("clean", "drifted"):
            raise ValueError("after must be 'clean' or 'drifted'")


# fixed values: the four ready-made settings
PREDEFINED = [
    DriftConfig("sudden", 0.6, 0.5),
    DriftConfig("gradual", 0.6, 0.5, width=0.2),
    DriftConfig("incremental", 0.6, 0.3),
    DriftConfig("recurring", 0.6, 0.5, n_cycles=4),
]


def predefined_configs(spark: SparkSession) -> DataFrame:
    rows = [(c.drift_type, c.severity, c.position, c.width, c.n_cycles) for c in PREDEFINED]
    return spark.createDataFrame(rows, "drift_type string, severity double, position double, width double, n_cycles int")


def severity_at(config: DriftConfig, n_rows: int, index: Column) -> Column:
    """Severity of the row at 0-based ``index``; 0 where the table stays as it is."""
    s, at = config.severity, F.lit(0.0)
    if config.drift_type == "sudden":
        at = F.when(index >= int(n_rows * config.position), F.lit(s)).otherwise(0.0)
    elif config.drift_type == "gradual":
        lo = int(n_rows * (config.position - config.width / 2))
        hi = int(n_rows * (config.position + config.width / 2))
        after = s if config.after == "drifted" else 0.0
        at = F.when(index < lo, 0.0).when(index <= hi, F.lit(s) * (index - lo) / F.lit(max(hi - lo, 1))).otherwise(after)
    elif config.drift_type == "incremental":
        start = int(n_rows * config.position)
        at = F.when(index < start, 0.0).otherwise(F.least(F.lit(s), F.lit(s) * (index - start + 1) / F.lit(max(n_rows - start, 1))))
    else:
        length = n_rows // config.n_cycles
        if length == 0:
            raise ValueError("more cycles than rows")
        at = F.when(F.floor(index / F.lit(length)) % 2 == 1, F.lit(s)).otherwise(0.0)
    return at.cast("double")


def inject_drift(
    df: DataFrame, config: DriftConfig, *, features: list[str], label: str, seq: str, chunk_size: int = 100, stats: str = "table"
) -> DataFrame:
    """Perturb features and flip labels where ``config`` says so; other rows pass unchanged.

    ``seq`` is a dense 1-based position.  Which features are touched, and how, is drawn per chunk of
    ``chunk_size`` rows; noise and flips are drawn per row.  All draws are hashes, so the result does
    not depend on partitioning.  Offsets and scales use deviations of the whole table, or of each
    chunk with ``stats='chunk'``.  Adds ``severity`` (0 for untouched rows).
    """
    if stats not in ("table", "chunk"):
        raise ValueError("stats must be 'table' or 'chunk'")
    k = STRENGTHS[config.drift_type]
    d = len(features)
    moments = []
    for i, f in enumerate(features):
        moments += [F.avg(f).alias(f"__mean{i}"), F.stddev_pop(f).alias(f"__std{i}")]
    # labels are bounded by the class count; the whole-table moments are one row
    head = df.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(label)).alias("classes"), *moments).first()
    n_rows, classes = head["n"], list(head["classes"])
    if n_rows == 0:
        return df.withColumn("severity", F.lit(0.0))

    index = F.col(seq) - 1
    chunk = F.floor(index / F.lit(chunk_size)).cast("bigint")
    base = df.withColumns({"severity": severity_at(config, n_rows, index), "__chunk": chunk})
    if stats == "chunk":
        base = base.join(base.groupBy("__chunk").agg(*moments), "__chunk")
        mean = lambda i: F.col(f"__mean{i}")
        std = lambda i: F.col(f"__std{i}")
    else:
        mean = lambda i: F.lit(head[f"__mean{i}"])
        std = lambda i: F.lit(head[f"__std{i}"])

    salt = config.seed
    least = max(1, int(d * k.min_share))
    most = max(least, int(d * config.severity))
    n_touched = F.lit(least) + F.floor(hash_uniform(F.col("__chunk"), f"{salt}:count") * (most - least + 1)).cast("int")
    base = base.withColumn("__picks", F.array(*[hash_uniform(F.col("__chunk"), f"{salt}:pick{i}") for i in range(d)]))
    base = base.withColumn("__cut", F.element_at(F.sort_array("__picks"), n_touched))
    sev = F.col("severity")
    changed = {}
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        branch = hash_uniform(F.col("__chunk"), f"{salt}:branch{i}")
        noisy = x + hash_normal(F.col(seq), f"{salt}:noise{i}") * sev * k.noise
        moved = F.when(std(i) > 0, x + sev * std(i) * k.offset).otherwise(x)
        scaled = F.when(std(i) > 0, (x - mean(i)) * (1.0 + sev * k.scale) + mean(i)).otherwise(x)
        drifted = F.when(branch < k.noise_share, noisy).when(branch < k.noise_share + k.offset_share, moved).otherwise(scaled)
        touched = (sev > 0) & (F.get("__picks", F.lit(i)) <= F.col("__cut"))
        changed[f] = F.when(touched, drifted).otherwise(x)
    flip = sev * k.flip * (1.0 if len(classes) == 2 else k.multiclass_flip)
    others = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c != F.col(label))
    other = F.get(others, F.floor(hash_uniform(F.col(seq), f"{salt}:other") * F.size(others)).cast("int"))
    if len(classes) > 1:
        changed[label] = F.when((sev > 0) & (hash_uniform(F.col(seq), f"{salt}:flip") < flip), other).otherwise(F.col(label))
    helper = ["__chunk", "__picks", "__cut"] + ([f"__{m}{i}" for i in range(d) for m in ("mean", "std")] if stats == "chunk" else [])
    return base.withColumns(changed).drop(*helper)
