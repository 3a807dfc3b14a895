"""Rebalancing: under-bagging, adaptive interpolation of the smaller class, online bagging weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.functions.hashing import hash_poisson, hash_uniform
from tidemark.operators.neighbors import knn_join
from tidemark.operators.select import running_class_counts


def underbag(df: DataFrame, by: list[str], label: str, ident: str, *, bags: int = 11, ratio: float = 1.0, auto: bool = False, seed: int = 42) -> DataFrame:
    """``bags`` balanced subsets per group: all rows of the smaller class and ceil(minority / ratio) hashed
    rows of the larger one.  Adds ``bag``.

    With ``auto`` the number of bags grows to cover the larger class, ceil(majority / minority * ratio),
    and is made odd.  A group with one class gives no rows.  The larger class is cut per task slot
    before the ranking window, so a big group never sorts in one task.
    """
    if not by:
        raise ValueError("under-bagging needs a chunk column")
    counts = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) == 0).alias("__neg"))
    small, large = F.least("__pos", "__neg"), F.greatest("__pos", "__neg")
    n_bags = F.lit(bags)
    if auto:
        n_bags = F.greatest(F.ceil(large / small * F.lit(ratio)).cast("int"), F.lit(bags))
        n_bags = n_bags + F.when(n_bags % 2 == 0, 1).otherwise(0)
    plan = counts.filter((F.col("__pos") > 0) & (F.col("__neg") > 0)).select(
        *by, F.when(F.col("__neg") > F.col("__pos"), 0).otherwise(1).alias("__cut"),
        F.ceil(small / F.lit(ratio)).alias("__keep"), n_bags.cast("int").alias("__bags"))
    rows = df.join(plan, by)
    spread = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.col("__bags") - 1)))
    whole = spread.filter(F.col(label) != F.col("__cut"))
    cut = spread.filter(F.col(label) == F.col("__cut")).withColumn(
        "__u", hash_uniform(F.concat_ws("-", F.col(ident).cast("string"), F.col("bag").cast("string")), f"{seed}:bag"))
    slot = F.pmod(F.xxhash64(ident), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for extra in (["__slot"], []):  # a local cut per slot first, then the exact one
        w = Window.partitionBy(*by, "bag", *extra).orderBy("__u", ident)
        cut = cut.withColumn("__slot", slot).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= F.col("__keep"))
    return whole.unionByName(cut.select(*whole.columns)).drop("__cut", "__keep", "__bags")


def adaptive_smote(df: DataFrame, block: str, label: str, ident: str, features: list[str], *, n_reference: int = 5, n_near: int = 7, seed: int = 42) -> DataFrame:
    """New minority points that bring each block's smaller class to parity, as (block, draw, features, label).

    A minority row takes its first k minority neighbours among its ``n_near`` nearest in the block, k
    chosen so their mean distance is closest (within a factor under 2) to the row's mean distance to the
    ``n_reference`` nearest rows of that class in the block before.  Each new point lies on the line
    from a row to one of its neighbours; a row without neighbours is duplicated.
    """
    sized = df.groupBy(block).agg(F.count_if(F.col(label) == 1).alias("__one"), F.count_if(F.col(label) == 0).alias("__zero"))
    need = sized.filter((F.col("__one") != F.col("__zero")) & (F.least("__one", "__zero") > 0)).select(
        block, F.when(F.col("__one") < F.col("__zero"), 1).otherwise(0).alias("__minor"), F.abs(F.col("__one") - F.col("__zero")).alias("__need"))
    packed = df.select(block, F.col(label).alias("__y"), F.col(ident).cast("bigint").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("features"))
    joined = packed.join(need, block)
    minor = joined.filter(F.col("__y") == F.col("__minor"))
    before = packed.withColumn(block, F.col(block) + 1).join(need.select(block, "__minor"), block).filter(F.col("__y") == F.col("__minor"))
    target = knn_join(minor, before, [block], n_reference).groupBy(block, "id").agg(F.avg("distance").alias("__aim"))
    near = knn_join(minor, joined, [block], n_near, exclude_self=True)
    same = near.join(joined.select(block, F.col("id").alias("neighbor"), F.col("__y").alias("__ny"), "__minor"), [block, "neighbor"]).filter(
        F.col("__ny") == F.col("__minor"))
    up_to = Window.partitionBy(block, "id").orderBy("rank")
    ranked = same.withColumn("__k", F.row_number().over(up_to)).withColumn("__mean", F.avg("distance").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    gap = ranked.join(target.filter(F.col("__aim") > 0), [block, "id"]).withColumn("__gap", F.abs(F.col("__mean") / F.col("__aim") - 1.0))
    best = gap.filter(F.col("__gap") < 1).groupBy(block, "id").agg(F.min(F.struct("__gap", "__k"))["__k"].alias("__best"))
    chosen = ranked.join(best, [block, "id"]).filter(F.col("__k") <= F.col("__best")).select(block, "id", "neighbor")
    # rows are only interpolated where the block before holds their class
    usable = minor.join(target.select(block, "id"), [block, "id"])
    alone = usable.join(best.select(block, "id"), [block, "id"], "left_anti").select(block, "id", F.col("id").alias("neighbor"))
    pairs = chosen.unionByName(alone)
    listed = pairs.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("id", "neighbor"))).alias("__pairs"))
    draws = listed.join(need, block).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__need").cast("bigint"))))
    key = F.concat_ws("-", F.col(block).cast("string"), F.col("draw").cast("string"))
    picked = draws.select(
        block, "draw", "__minor", hash_uniform(key, f"{seed}:step").alias("__step"),
        F.get("__pairs", F.floor(hash_uniform(key, f"{seed}:pair") * F.size("__pairs")).cast("int")).alias("__p"))
    point = lambda name: joined.select(block, F.col("id").alias(f"__{name}"), F.col("features").alias(f"__f{name}"))
    both = picked.withColumn("__a", F.col("__p.id")).withColumn("__b", F.col("__p.neighbor")).join(point("a"), [block, "__a"]).join(point("b"), [block, "__b"])
    mixed = F.zip_with("__fa", "__fb", lambda a, b: a + F.col("__step") * (b - a))
    return both.select(block, "draw", mixed.alias("features"), F.col("__minor").alias(label))


def _log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, exact to rounding from k = 10."""
    return k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k**3) + 1 / (1260 * k**5) - 1 / (1680 * k**7)


def poisson_quantile(u: Column, lam: Column) -> Column:
    """Poisson draw for a rate that differs by row: count of cumulative probabilities reached.

    The terms run over the counts within 12 deviations and 30 of the rate, which is all that a 32-bit draw can
    meet; the first is taken in logarithms, so a large rate does not underflow.
    """

    def bounded(p: Column) -> Column:
        reach = 12 * F.sqrt(p["lam"]) + 30
        low = F.floor(p["lam"] - reach)
        return F.struct(p["u"].alias("u"), p["lam"].alias("lam"), F.when(low < 10, 0).otherwise(low).cast("bigint").alias("low"),
                        F.ceil(p["lam"] + reach).cast("bigint").alias("high"))

    def draw(p: Column) -> Column:
        low = p["low"].cast("double")
        first = F.when(p["low"] == 0, F.exp(-p["lam"])).otherwise(F.exp(low * F.log(p["lam"]) - p["lam"] - _log_factorial(low)))
        start = F.struct(first.alias("term"), first.alias("cdf"), p["low"].alias("k"))
        return F.aggregate(F.sequence(p["low"] + 1, p["high"]), start, lambda a, i: F.struct(
            (a["term"] * p["lam"] / i).alias("term"), (a["cdf"] + a["term"] * p["lam"] / i).alias("cdf"),
            (a["k"] + F.when(a["cdf"] <= p["u"], 1).otherwise(0)).alias("k")))["k"].cast("int")

    return let(F.struct(u.alias("u"), lam.alias("lam")), lambda p: let(bounded(p), draw))


# fixed values: Poisson rate of each bagging scheme; None depends on the class balance so far
SCHEMES = {"leveraging": 6.0, "online": 1.0, "online_adwin": 1.0, "oversampling": None}


def online_bagging_weights(df: DataFrame, ident: str, members: int, scheme: str = "online", *, label: str | None = None,
                           keys: list[str] | None = None, order: str | None = None, seed: int = 42) -> DataFrame:
    """Each row once per member with its Poisson ``weight``.

    ``oversampling`` raises the rate of the class seen less often so far to the larger count over its
    own (needs ``label``, ``keys`` and ``order``).
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; choose from {sorted(SCHEMES)}")
    rows = df
    if SCHEMES[scheme] is None:
        rows = running_class_counts(df, keys or [], order, label, F.lit(True), [0, 1])
        own = F.when(F.col(label) == 1, F.col("n_1")).otherwise(F.col("n_0"))
        rows = rows.withColumn("rate", F.when(own == 0, 1.0).otherwise(F.greatest("n_0", "n_1") / own)).drop("n_0", "n_1")
    else:
        rows = rows.withColumn("rate", F.lit(SCHEMES[scheme]))
    spread = rows.withColumn("member", F.explode(F.array(*[F.lit(m) for m in range(members)])))
    salt = F.concat(F.lit(f"{seed}:bag"), F.col("member").cast("string"))
    if SCHEMES[scheme] is None:
        return spread.withColumn("weight", poisson_quantile(hash_uniform(F.col(ident), salt), F.col("rate")))
    return spread.withColumn("weight", hash_poisson(F.col(ident), salt, SCHEMES[scheme]))
