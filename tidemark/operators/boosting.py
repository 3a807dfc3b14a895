"""Weighted ensembles of trained members: dynamic weighted majority and cost-sensitive boosting.

Members are naive Bayes models over runs of chunks, so each is a difference of prefix sums.  Rows meet all models of
their chunk in one equi-join and are scored by column expressions; only counts per chunk and small model tables are
shuffled or written.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import naive_bayes as nb
from tidemark.plans.chunks import lagged_prefix, score_join
from tidemark.plans.keyed import Machine, keyed_scan
from tidemark.plans.scan import running
from tidemark.session import materialize


class Majority(Machine):
    """Weights by age of the members of one key, one chunk at a time.

    A chunk arrives as counts of (label, predictions of the candidates by age).  Members are weighed by ``beta`` to
    the power of their error share, the largest weight becomes 1, those under ``theta`` leave.  A chunk whose weighted
    vote errs by more than ``birth``, or that found no member, bears one; of more than ``members`` the weakest
    (the older of two) leaves, and so does a member that is ``reach`` chunks old.
    """

    inputs = ("patterns",)
    outputs = (("weights", "array<double>"),)

    def __init__(self, classes: list[int], members: int, reach: int, beta: float, theta: float, birth: float):
        self.classes, self.members, self.reach = classes, members, reach
        self.beta, self.theta, self.birth = beta, theta, birth

    def start(self):
        return [0.0] * self.reach

    def feed(self, state, cols):
        out = []
        for patterns in cols["patterns"]:
            out.append(list(state))
            state = self._after(np.array(state), patterns)
        return state, {"row": np.arange(len(out)), "weights": out}

    def _after(self, weights: np.ndarray, patterns) -> list[float]:
        error = np.ones(self.reach)
        wrong = 1.0
        if len(patterns):
            label = np.array([p["label"] for p in patterns])
            votes = np.array([p["votes"] for p in patterns])
            n = np.array([p["n"] for p in patterns], float)
            error = (votes != label[:, None]).T @ n / n.sum()
            score = np.stack([(votes == c) @ weights for c in self.classes], axis=1)
            wrong = float(n[np.array(self.classes)[np.round(score, 12).argmax(axis=1)] != label].sum() / n.sum())
        raw = np.where(weights > 0, weights * self.beta**error, 0.0)
        top = raw.max()
        raw = raw / top if top > 0 else raw
        raw[raw < self.theta] = 0.0
        aged = np.concatenate([[0.0], raw[:-1]])
        if len(patterns) and (wrong > self.birth or not (raw > 0).any()):
            aged[0] = 1.0
        alive = np.flatnonzero(aged)
        if len(alive) > self.members:
            aged[min(alive, key=lambda a: (round(aged[a], 12), -a))] = 0.0
        return aged.tolist()


def dynamic_majority(
    df: DataFrame, keys: list[str], chunk: str, features: list[str], label: str, classes: list[int], *, members: int = 5, reach: int = 10,
    beta: float = 0.5, theta: float = 0.01, birth: float = 0.25,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, lifecycle): a chunk is predicted by the weighted vote of the members before it.

    Every chunk trains a candidate of each age up to ``reach``: naive Bayes over the chunks since its birth, a
    difference of two prefix sums.  Candidates' predictions are counted per chunk (at most classes to the power of
    ``reach`` + 1 counts), the counts are folded in order into the weights in force, and the weights meet the
    rows again.  ``lifecycle`` has the chunk, the place of the member's first chunk and its weight there.
    Rows with a missing feature stay unscored; without members the lowest class is predicted.
    """
    d, names = len(features), nb.stat_names(len(features), classes)
    stats = nb.nb_stats(df, [*keys, chunk], features, label, classes)
    measures = {n: ("sum", f"`{n}`") for n in names} | {"__pos": ("sum", "1L")}
    prefix = materialize(running(stats, keys, chunk, measures, exclusive=True).select(*keys, chunk, "__pos", *names), "prefix-sums")
    ages = range(1, reach + 1)
    now = prefix.withColumn("__age", F.explode(F.array(*[F.lit(a) for a in ages]))).withColumn("__born", F.col("__pos") - F.col("__age")).filter("__born >= 0")
    then = prefix.select(*keys, F.col("__pos").alias("__born"), *[F.col(n).alias(f"__then_{n}") for n in names])
    sums = now.join(then, [*keys, "__born"]).select(*keys, chunk, "__pos", "__age", *[(F.col(n) - F.col(f"__then_{n}")).alias(n) for n in names])
    params = nb.parameters(sums, d, classes)
    wide = params.groupBy(*keys, chunk).agg(*[
        F.expr(f"max(CASE WHEN __age = {a} THEN `{n}` END) AS `m{a}_{n}`") for a in ages for n in nb.parameter_names(d, classes)])
    wide = materialize(prefix.select(*keys, chunk, "__pos").join(wide, [*keys, chunk], "left"), "candidates")

    scored = score_join(df, wide, [*keys, chunk])
    for a in ages:
        scored = nb.apply(scored, features, classes, prefix=f"m{a}_", pred=f"__p{a}")
    votes = F.array(*[F.col(f"__p{a}") for a in ages])
    known = scored.filter(F.col(label).isNotNull() & F.col("__p1").isNotNull())
    counts = known.groupBy(*keys, chunk, F.col(label).cast("int").alias("label"), votes.alias("votes")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(*keys, chunk).agg(F.collect_list(F.struct("label", "votes", "n")).alias("patterns"))
    per = prefix.select(*keys, chunk, "__pos").join(per, [*keys, chunk], "left").withColumn(
        "patterns", F.coalesce("patterns", F.array().cast("array<struct<label:int,votes:array<int>,n:bigint>>"))).withColumn("__one", F.lit(0))
    fold = keyed_scan(per, ["__one", *keys], chunk, Majority(classes, members, reach, beta, theta, birth), keep=("__pos",)).drop("__one")
    fold = materialize(fold, "member-weights")

    joined = score_join(scored.drop("__pos"), fold.drop("__pos"), [*keys, chunk])
    score = F.array(*[F.round(sum((F.when(F.col(f"__p{a}") == c, F.get("weights", F.lit(a - 1))).otherwise(0.0) for a in ages), F.lit(0.0)), 12) for c in classes])
    joined = joined.withColumn("__score", score)
    ids = F.array(*[F.lit(c) for c in classes])
    pick = F.when(F.col("__p1").isNotNull(), F.element_at(ids, F.array_position("__score", F.array_max("__score")).cast("int")))
    rows = joined.withColumn("y_pred", pick.cast("int")).select(*df.columns, "y_pred")
    life = fold.select(*keys, chunk, "__pos", F.posexplode("weights").alias("__a", "weight")).filter("weight > 0")
    return rows, life.select(*keys, chunk, (F.col("__pos") - F.col("__a") - 1).alias("member"), "weight")


def cost_boost(
    df: DataFrame, keys: list[str], chunk: str, features: list[str], label: str, classes: list[int], *, members: int = 10, costs: list[float] | None = None,
) -> DataFrame:
    """Chunk t predicted by boosted members trained on the chunks before it; class costs enter the weights.

    Member m learns from rows weighted by a running product over the members before it: the class cost, times
    (R + W) / 2R where that member was right and (R + W) / 2W where it was wrong, R and W being the weighted sums of its
    right and wrong predictions in earlier chunks.  It votes with ln(R / W) / 2, with 1 as long as it was never
    judged.  Each member takes two passes over the rows, which are neither written nor shuffled by
    themselves: all that is kept is one row of models and factors per chunk.  Ties go to the lowest class.
    """
    d, names = len(features), nb.stat_names(len(features), classes)
    costs = costs or [1.0] * len(classes)
    cost = "CASE " + " ".join(f"WHEN `{label}` = {c} THEN {float(k)!r}D" for c, k in zip(classes, costs)) + " ELSE 0.0D END"
    plain = df.select(*dict.fromkeys([*keys, chunk, *features, label]))
    wide = None

    def walked(rows: DataFrame, models: DataFrame | None, upto: int, judged: bool) -> DataFrame:
        """Rows with the predictions of ``upto`` members and the weight ``__w`` after them (before the last, unless ``judged``)."""
        out = rows if models is None else score_join(rows, models, [*keys, chunk])
        out = out.withColumn("__w", F.expr(cost))
        for m in range(upto):
            out = nb.apply(out, features, classes, prefix=f"m{m}_", pred=f"__p{m}")
            if m < upto - 1 or judged:
                out = out.withColumn("__w", F.expr(
                    f"CASE WHEN __known{m} AND __p{m} IS NOT NULL THEN __w * ({cost}) * CASE WHEN __p{m} = `{label}` THEN __right{m} ELSE __wrong{m} END ELSE __w END"))
        return out

    for m in range(members):
        stats = nb.nb_stats(walked(plain, wide, m, True), [*keys, chunk], features, label, classes, weight="__w")
        sums = lagged_prefix(stats, keys, chunk, names)
        known = " + ".join(f"n{c}" for c in classes)
        params = nb.parameters(sums.withColumn(f"__known{m}", F.expr(f"{known} > 0")), d, classes)
        params = params.select(*keys, chunk, f"__known{m}", *[F.col(n).alias(f"m{m}_{n}") for n in nb.parameter_names(d, classes)])
        models = materialize(params if wide is None else wide.join(params, [*keys, chunk]), f"boosted-{m}")
        told = walked(plain, models, m + 1, False).filter(f"__known{m} AND __p{m} IS NOT NULL AND `{label}` IS NOT NULL")
        hits = told.groupBy(*keys, chunk).agg(
            F.expr(f"sum(CASE WHEN __p{m} = `{label}` THEN __w * ({cost}) ELSE 0 END) AS __r"), F.expr(f"sum(CASE WHEN __p{m} <> `{label}` THEN __w * ({cost}) ELSE 0 END) AS __f"))
        hits = models.select(*keys, chunk).join(hits, [*keys, chunk], "left").na.fill(0.0, ["__r", "__f"])
        past = lagged_prefix(hits, keys, chunk, ["__r", "__f"])
        factors = past.select(
            *keys, chunk, F.expr("CASE WHEN __r > 0 AND __f > 0 THEN (__r + __f) / (2 * __r) ELSE 1.0D END").alias(f"__right{m}"),
            F.expr("CASE WHEN __r > 0 AND __f > 0 THEN (__r + __f) / (2 * __f) ELSE 1.0D END").alias(f"__wrong{m}"),
            F.expr("CASE WHEN __r + __f > 0 THEN 0.5D * ln(greatest(__r, 1e-10D) / greatest(__f, 1e-10D)) ELSE 1.0D END").alias(f"__alpha{m}"))
        wide = materialize(models.join(factors, [*keys, chunk]), f"factors-{m}")
    out = score_join(df, wide, [*keys, chunk])
    for m in range(members):
        out = nb.apply(out, features, classes, prefix=f"m{m}_", pred=f"__p{m}")
    score = ", ".join("round(" + " + ".join(f"CASE WHEN __known{m} AND __p{m} = {c} THEN __alpha{m} ELSE 0.0D END" for m in range(members)) + ", 12)" for c in classes)
    ids = ", ".join(str(c) for c in classes)
    picked = out.selectExpr("*", f"array({score}) AS __v").selectExpr(
        *[f"`{c}`" for c in df.columns], f"cast(CASE WHEN __p0 IS NOT NULL THEN array({ids})[int(array_position(__v, array_max(__v))) - 1] END as int) AS y_pred")
    return picked
