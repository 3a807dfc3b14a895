"""Scores over long prediction tables, whole and cumulative.

Cumulative metrics are prefix sums over per-interval totals, so the rows are aggregated once and
only one small row per interval is scanned.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scan import running, with_global_seq
from tidemark.session import materialize


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.groupBy(*by).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"))


def _class_counts(classes: list[int]) -> list[Column]:
    t, p = F.col("y_true"), F.col("y_pred")
    cols = []
    for c in classes:
        cols += [_sum_if((t == c) & (p == c)).alias(f"__tp{c}"), _sum_if(t == c).alias(f"__t{c}"), _sum_if(p == c).alias(f"__p{c}")]
    return cols


def _macro(classes: list[int]) -> Column:
    def f1(c):
        denom = F.col(f"__t{c}") + F.col(f"__p{c}")
        return F.when(denom == 0, F.lit(0.0)).otherwise(2.0 * F.col(f"__tp{c}") / denom)

    return reduce(add, [f1(c) for c in classes]) / F.lit(float(len(classes)))


def macro_f1(df: DataFrame, by: list[str], classes: list[int]) -> DataFrame:
    """Unweighted mean F1 over all ``classes``; a class never true nor predicted counts 0."""
    return df.groupBy(*by).agg(*_class_counts(classes)).select(*by, _macro(classes).alias("macro_f1"))


def round_summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation over rounds of each value column."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*aggs)


def score_rollup(df: DataFrame, levels: list[str]) -> DataFrame:
    """Accuracy at every prefix of ``levels`` in one pass."""
    return df.rollup(*levels).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, by: list[str], classes: list[int], n_rounds: int | None = None) -> DataFrame:
    """Dense (by*, y_true, y_pred, n) counts; with ``n_rounds`` the rounded mean per round."""
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    cell = F.struct(F.concat_ws(":", "y_true", "y_pred").alias("k"), F.col("n").alias("v"))
    packed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"))
    ids = F.array(*[F.lit(c) for c in classes])
    dense = packed.withColumn("y_true", F.explode(ids)).withColumn("y_pred", F.explode(ids))
    n = F.coalesce(F.element_at("cells", F.concat_ws(":", "y_true", "y_pred")), F.lit(0))
    value = n if n_rounds is None else F.rint(n / F.lit(n_rounds)).cast("bigint")
    return dense.select(*by, "y_true", "y_pred", value.alias("n"))


def regression_detail(df: DataFrame) -> DataFrame:
    """Row errors of (y_true, y_pred): absolute, squared, percentage of the true value."""
    err = F.col("y_true") - F.col("y_pred")
    return df.withColumns({
        "absolute_error": F.abs(err),
        "squared_error": err * err,
        "percentage_error": F.abs(err) / (F.col("y_true") + F.lit(1e-10)) * 100,
    })


def regression_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """MSE, MAE, R2 and RMSE; rows without a prediction do not count."""
    err = F.col("y_true") - F.col("y_pred")
    scored = df.filter(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())
    agg = scored.groupBy(*by).agg(
        F.avg(err * err).alias("MSE"), F.avg(F.abs(err)).alias("MAE"), F.var_pop("y_true").alias("__var"))
    return agg.select(*by, "MSE", "MAE", F.when(F.col("__var") > 0, 1 - F.col("MSE") / F.col("__var")).alias("R2"), F.sqrt("MSE").alias("RMSE"))


def imbalance_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """G-mean, F1 of class 1, and recall of the smaller class, for binary labels."""
    t, p = F.col("y_true"), F.col("y_pred")
    agg = df.groupBy(*by).agg(
        _sum_if((t == 1) & (p == 1)).alias("__tp"), _sum_if((t == 0) & (p == 0)).alias("__tn"),
        _sum_if((t == 0) & (p == 1)).alias("__fp"), _sum_if((t == 1) & (p == 0)).alias("__fn"))
    return agg.select(*by, *_imbalance_columns())


def _imbalance_columns() -> list[Column]:
    tp, tn, fp, fn = (F.col(f"__{c}") for c in ("tp", "tn", "fp", "fn"))
    pos, neg = tp + fn, tn + fp
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return [
        F.sqrt(ratio(tp, pos) * ratio(tn, neg)).alias("gm"),
        ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(pos <= neg, ratio(tp, pos)).otherwise(ratio(tn, neg)).alias("minority_recall"),
    ]


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    Equal scores collapse before any shuffle, and the cumulative negatives come from a two-level
    scan over a global order, so one huge group is spread over many tasks.  0 on an empty class.
    """
    steps = df.groupBy(*by, F.col(score).alias("__s")).agg(
        _sum_if(F.col(label) == 1).alias("__pos"), _sum_if(F.col(label) == 0).alias("__neg"))
    ordered = with_global_seq(steps, [*by, "__s"], name="__at")
    scanned = running(ordered, by, "__at", {"__below": ("sum", F.col("__neg"))}, exclusive=True)
    won = F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2.0))
    out = scanned.groupBy(*by).agg(won.alias("__won"), F.sum("__pos").alias("__np"), F.sum("__neg").alias("__nn"))
    return out.select(*by, F.when((F.col("__np") == 0) | (F.col("__nn") == 0), 0.0).otherwise(
        F.col("__won") / F.col("__np") / F.col("__nn")).alias("auc"))


def class_balance(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Row count per class, with the group's minority class and imbalance ratio."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    entry = F.struct(F.col("n"), F.col(label).alias("c"))
    packed = counts.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    smallest, largest = F.element_at("all", 1), F.element_at("all", -1)
    return packed.select(
        *by, F.size("all").alias("n_classes"), smallest["c"].alias("minority_class"), smallest["n"].alias("minority_n"),
        (largest["n"] / smallest["n"]).alias("imbalance_ratio"))


def _interval(seq: str, size: int) -> Column:
    return F.expr(f"(cast(`{seq}` as bigint) - 1) div {int(size)}").alias("interval")


def prequential_accuracy(df: DataFrame, by: list[str], interval: int, seq: str = "seq") -> DataFrame:
    """Cumulative accuracy at each interval end; a last partial interval is kept."""
    hits = _sum_if(F.col("y_true") == F.col("y_pred"))
    per = df.groupBy(*by, _interval(seq, interval)).agg(hits.alias("__h"), F.count("*").alias("__n"), F.max(seq).alias("seq"))
    run = running(per, by, "interval", {"__ch": ("sum", "__h"), "__cn": ("sum", "__n")})
    return run.select(*by, "interval", "seq", (F.col("__ch") / F.col("__cn")).alias("accuracy"))


def prequential_macro_f1(df: DataFrame, by: list[str], interval: int, classes: list[int], seq: str = "seq") -> DataFrame:
    """Cumulative macro-F1 at each interval end."""
    per = df.groupBy(*by, _interval(seq, interval)).agg(*_class_counts(classes), F.max(seq).alias("seq"))
    names = [f"__{k}{c}" for c in classes for k in ("tp", "t", "p")]
    run = running(per.withColumnsRenamed({n: f"x{n}" for n in names}), by, "interval", {n: ("sum", f"x{n}") for n in names})
    return run.select(*by, "interval", "seq", _macro(classes).alias("macro_f1"))


def metric_band(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, and mean minus/plus one population deviation, over rounds at each position."""
    agg = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return agg.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std")})


def won_pairs(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Per group and ``interval``: pairs of a positive and a negative row, the later of them in that interval, that the
    positive wins (ties count half), as ``__won``.

    Each pair of different intervals meets once, at the level where their halves of a binary tree of intervals part,
    and pairs of one interval at level -1.  A level is one scan over the scores: no pair is built, and a row is copied
    once per level, that is with the logarithm of the number of intervals.
    """
    y = F.col(label)
    steps = df.groupBy(*by, "interval", F.col(score).alias("__s")).agg(_sum_if(y == 1).alias("__p"), _sum_if(y == 0).alias("__n"))
    steps = materialize(steps, "score-steps")
    last = steps.agg(F.max("interval")).first()[0] or 0
    levels = F.explode(F.sequence(F.lit(-1), F.lit(int(last).bit_length() - 1)))
    spread = steps.withColumn("__level", levels)
    node = F.when(F.col("__level") < 0, F.col("interval")).otherwise(F.expr("shiftright(interval, __level + 1)"))
    late = (F.col("__level") < 0) | (F.expr("shiftright(interval, greatest(__level, 0)) & 1") == 1)
    early = (F.col("__level") < 0) | ~late
    spread = materialize(spread.withColumns({"__node": node, "__late": late, "__early": early}), "score-levels")
    key = [*by, "__level", "__node"]
    first = spread.groupBy(*key, "__s").agg(*[F.sum(F.when(F.col("__early"), F.col(c)).otherwise(0)).alias(f"{c}0") for c in ("__p", "__n")])
    ordered = with_global_seq(first, [*key, "__s"], name="__at")
    below = running(ordered, key, "__at", {"__pb": ("sum", F.col("__p0")), "__nb": ("sum", F.col("__n0"))}, exclusive=True)
    totals = first.groupBy(*key).agg(F.sum("__p0").alias("__pt"))
    met = spread.filter("__late").join(below, [*key, "__s"]).join(totals, key)
    wins = F.col("__p") * (F.col("__nb") + F.col("__n0") / 2.0)  # of its positives over earlier negatives
    losses = F.col("__n") * (F.col("__pt") - F.col("__pb") - F.col("__p0") / 2.0)  # of earlier positives over its negatives
    return met.groupBy(*by, "interval").agg(F.sum(wins + F.when(F.col("__level") < 0, 0.0).otherwise(losses)).alias("__won"))


def prequential_imbalance(
    df: DataFrame, by: list[str], interval: int, resets: list[int], score: str = "score", seq: str = "seq"
) -> DataFrame:
    """G-mean, F1, minority recall and AUC since the last reset, at each interval end.

    ``resets`` are positions starting a new segment.  The area is exact for any scores.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    segment = reduce(add, [(F.col(seq) >= r).cast("int") for r in resets], F.lit(0))
    base = df.withColumns({"segment": segment, "interval": _interval(seq, interval)})
    parts = {"__tp": (t == 1) & (p == 1), "__tn": (t == 0) & (p == 0), "__fp": (t == 0) & (p == 1), "__fn": (t == 1) & (p == 0)}
    per = base.groupBy(*by, "segment", "interval").agg(*[_sum_if(c).alias(f"x{n}") for n, c in parts.items()], F.max(seq).alias("seq"))
    won = won_pairs(base, [*by, "segment"], score, "y_true").withColumnRenamed("__won", "x__won")
    per = per.join(won, [*by, "segment", "interval"], "left").fillna(0.0, ["x__won"])
    run = running(per, [*by, "segment"], "interval", {n: ("sum", f"x{n}") for n in [*parts, "__won"]})
    n_pos, n_neg = F.col("__tp") + F.col("__fn"), F.col("__tn") + F.col("__fp")
    area = F.when((n_pos == 0) | (n_neg == 0), 0.0).otherwise(F.col("__won") / n_pos / n_neg)
    return run.select(*by, "segment", "interval", "seq", *_imbalance_columns(), area.alias("auc"))
