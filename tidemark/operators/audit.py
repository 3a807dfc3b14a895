"""Before/after and windowed audits of a table for signs of drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import running


def row_window(size: int, seq: str = "seq") -> Column:
    return F.expr(f"(cast(`{seq}` as bigint) - 1) div {int(size)}")


def _mean_of(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def window_profile(df: DataFrame, features: list[str], size: int, *, seq: str = "seq", hit: Column | None = None,
                   full_only: bool = True) -> DataFrame:
    """Per tumbling row window: mean of feature means, mean of feature deviations, optional accuracy.

    One aggregation; an incomplete last window is dropped unless ``full_only`` is false.
    """
    aggs = [F.avg(f).alias(f"__m{i}") for i, f in enumerate(features)] + [F.stddev_pop(f).alias(f"__s{i}") for i, f in enumerate(features)]
    if hit is not None:
        aggs.append(F.avg(hit.cast("int")).alias("accuracy"))
    g = df.groupBy(row_window(size, seq).alias("window_id")).agg(F.count("*").alias("n"), *aggs)
    if full_only:
        g = g.filter(F.col("n") == size)
    k = range(len(features))
    out = [F.col("window_id"), F.col("n"), _mean_of([F.col(f"__m{i}") for i in k]).alias("feature_mean"),
           _mean_of([F.col(f"__s{i}") for i in k]).alias("feature_std")]
    return g.select(*out, *([F.col("accuracy")] if hit is not None else []))


def window_labels(df: DataFrame, label: str, size: int, *, seq: str = "seq") -> DataFrame:
    """Count and share of each label per tumbling row window."""
    g = df.groupBy(row_window(size, seq).alias("window_id"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = g.groupBy("window_id").agg(F.sum("n").alias("__all"))
    return g.join(totals, "window_id").select("window_id", "label", "n", (F.col("n") / F.col("__all")).alias("share"))


def _pooled(df: DataFrame, features: list[str], by: list[Column]) -> DataFrame:
    """Mean and deviation over all values of all features, flattened, from per-feature sums."""
    d = len(features)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(f).alias(f"__m{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"__v{i}") for i, f in enumerate(features)])
    mean = _mean_of([F.col(f"__m{i}") for i in range(d)])
    spread = _mean_of([F.col(f"__v{i}") + (F.col(f"__m{i}") - F.col("mean")) * (F.col(f"__m{i}") - F.col("mean")) for i in range(d)])
    return g.withColumn("mean", mean).withColumn("std", F.sqrt(spread))


def before_after(df: DataFrame, features: list[str], split: int, *, seq: str = "seq") -> DataFrame:
    """Flattened mean and deviation before and from position ``split`` (1-based), and their change."""
    pooled = _pooled(df, features, [(F.col(seq) < split).alias("before")])
    pick = lambda c, b: F.max(F.when(F.col("before") == F.lit(b), F.col(c)))
    return pooled.agg(
        pick("mean", True).alias("before_mean"), pick("mean", False).alias("after_mean"),
        pick("std", True).alias("before_std"), pick("std", False).alias("after_std"),
    ).withColumns({
        "mean_change": F.abs(F.col("after_mean") - F.col("before_mean")),
        "std_change": F.abs(F.col("after_std") - F.col("before_std")),
    })


def compare_to_baseline(baseline: DataFrame, variants: DataFrame, features: list[str], by: str) -> DataFrame:
    """Flattened mean and deviation of each variant against an unchanged baseline table."""
    base = _pooled(baseline, features, []).select(F.col("mean").alias("bm"), F.col("std").alias("bs")).first()
    return _pooled(variants, features, [F.col(by)]).select(
        by, "mean", "std", F.abs(F.col("mean") - F.lit(base["bm"])).alias("mean_difference"),
        F.abs(F.col("std") - F.lit(base["bs"])).alias("std_difference"))


def window_jumps(profile: DataFrame, *, drop: float = 0.1, factor: float = 2.0) -> DataFrame:
    """Change of each window against the one before, and whether it is a jump.

    A jump is an accuracy fall of more than ``drop``, or a change of the feature mean larger than
    ``factor`` deviations of all such changes; it needs more than two windows.  The previous window
    comes by an equi-join on the window number, so no window function spans the table.
    """
    has_acc = "accuracy" in profile.columns
    earlier = profile.select(
        (F.col("window_id") + 1).alias("window_id"), F.col("feature_mean").alias("__pm"),
        *([F.col("accuracy").alias("__pa")] if has_acc else []))
    changes = profile.join(earlier, "window_id").withColumn("mean_change", F.col("feature_mean") - F.col("__pm"))
    spread = changes.agg(F.stddev_pop("mean_change").alias("sd"), F.count("*").alias("n")).first()
    enough = F.lit(spread["n"] >= 2)
    sd = F.lit(spread["sd"] if spread["sd"] is not None else 0.0)
    out = changes.withColumn("mean_jump", enough & (F.abs("mean_change") > sd * factor))
    if has_acc:
        out = out.withColumn("accuracy_change", F.col("accuracy") - F.col("__pa"))
        out = out.withColumn("accuracy_drop", enough & (F.col("accuracy_change") < -drop))
    return out.drop("__pm", "__pa")


def drift_verdict(jumps: DataFrame) -> DataFrame:
    """One row: whether any window jumped, and how many did."""
    flags = [F.col(c) for c in ("mean_jump", "accuracy_drop") if c in jumps.columns]
    anyof = flags[0]
    for f in flags[1:]:
        anyof = anyof | f
    return jumps.agg(F.coalesce(F.bool_or(anyof), F.lit(False)).alias("drift_detected"), F.count_if(anyof).alias("n_jumps"))


def ks_windows(df: DataFrame, value: str, size: int, *, seq: str = "seq") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic between each full row window and the one before.

    Equal values inside a pair collapse first; the cumulative counts run inside one pair of windows,
    which holds at most 2 * size rows.
    """
    w = row_window(size, seq)
    sides = F.array(F.struct(w.alias("window_id"), F.lit(1).alias("now")), F.struct((w + 1).alias("window_id"), F.lit(0).alias("now")))
    spread = df.select(F.col(value).alias("v"), F.explode(sides).alias("s")).select("v", "s.window_id", "s.now")
    steps = spread.groupBy("window_id", "v").agg(F.sum("now").alias("a"), F.sum(1 - F.col("now")).alias("b"))
    from pyspark.sql import Window

    run = Window.partitionBy("window_id").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("window_id")
    ecdf = steps.select(
        "window_id", F.sum("a").over(run).alias("ca"), F.sum("b").over(run).alias("cb"),
        F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"))
    full = ecdf.filter((F.col("na") == size) & (F.col("nb") == size))
    return full.groupBy("window_id").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))


def mean_cut(df: DataFrame, keys: list[str], features: list[str], *, delta: float = 0.05, seq: str = "seq") -> DataFrame:
    """Cut test inside each chunk: is any split's largest feature-mean gap beyond the Hoeffding bound?

    Features are scaled to [0, 1] inside the chunk given by ``keys``; with n rows and a split n0 | n1
    the bound is sqrt(1 / (2 m) * ln(4 n / delta)), m = 1 / (1 / n0 + 1 / n1).  Running sums are
    two-level, so a large chunk is spread over tasks.
    """
    aggs = [F.count("*").alias("__n")]
    for i, f in enumerate(features):
        aggs += [F.min(f).alias(f"__lo{i}"), F.max(f).alias(f"__hi{i}"), F.sum(f).alias(f"__t{i}")]
    totals = df.groupBy(*keys).agg(*aggs)
    run = running(df, keys, seq, {"__i": ("sum", F.lit(1)), **{f"__c{i}": ("sum", F.col(f)) for i, f in enumerate(features)}})
    j = run.join(totals, keys).filter(F.col("__i") < F.col("__n"))
    n0, n1 = F.col("__i"), F.col("__n") - F.col("__i")
    gaps = []
    for i in range(len(features)):
        span = F.col(f"__hi{i}") - F.col(f"__lo{i}")
        gap = F.abs(F.col(f"__c{i}") / n0 - (F.col(f"__t{i}") - F.col(f"__c{i}")) / n1)
        gaps.append(F.when(span > 0, gap / span).otherwise(0.0))
    top = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    m = F.lit(1.0) / (F.lit(1.0) / n0 + F.lit(1.0) / n1)
    bound = F.sqrt(F.lit(1.0) / (2.0 * m) * F.log(4.0 * F.col("__n") / F.lit(delta)))
    scored = j.select(*keys, "__i", top.alias("gap"), (top - bound).alias("excess"))
    return scored.groupBy(*keys).agg(
        F.max("gap").alias("largest_gap"), F.max("excess").alias("largest_excess"), F.bool_or(F.col("excess") > 0).alias("changed"))
