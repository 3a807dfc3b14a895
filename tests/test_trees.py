import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import trees as T

KIND = "g int, rid long, c long, a double, b double, label int, y double"


def rows(seed, n=900, chunks=9, group=0, gaps=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = float(np.round(rng.normal(), 3)), float(np.round(rng.random(), 3))
        label = int(a > 0.2) + int(a > 0.2 and b > 0.5)
        y = 3.0 * (a > 0.2) - 2.0 * (b > 0.4) + float(np.round(rng.normal() * 0.1, 3))
        gap = gaps and i % 11 == 0
        out.append((group, i, i * chunks // n, None if gap else a, b, None if gaps and i % 13 == 0 else label, None if gaps and i % 13 == 0 else y))
    return out


def plain(data, target, goal, ends, bins, depth, delta, tie):
    """Answers by growing one tree row by row in plain Python: chunks in order, leaves hold their own rows."""
    answers, leaves = {}, {1: dict(hist=np.zeros((2, bins, goal.width)), have=np.zeros(goal.width))}
    splits = {}

    def one(y):
        return np.array([float(y == k) for k in goal.classes]) if isinstance(goal, T.Classes) else np.array([1.0, y, y * y])

    def place(r):
        return [int(min(max(np.floor((v - lo) / (hi - lo) * bins), 0), bins - 1)) for v, (lo, hi) in zip(r[3:5], ends)]

    for c in sorted({r[2] for r in data}):
        mine = [r for r in data if r[2] == c]
        routed = []
        for r in mine:
            if r[3] is None or r[4] is None:
                answers[r[1]] = None
                continue
            node, at = 1, place(r)
            while node in splits:
                f, cut = splits[node]
                node = node * 2 + (at[f] >= cut)
            have = leaves[node]["have"]
            answers[r[1]] = goal.classes[int(have.argmax())] if isinstance(goal, T.Classes) else (have[1] / have[0] if have[0] else 0.0)
            routed.append((node, at, r[target]))
        for node, at, y in routed:
            if y is None:
                continue
            leaves[node]["have"] = leaves[node]["have"] + one(y)
            for f in range(2):
                leaves[node]["hist"][f, at[f]] += one(y)
        for node in [k for k in leaves if k not in splits and k < 2**depth]:
            found = T.Split(goal, 2, bins, delta, tie)._sure(leaves[node]["hist"])
            if found:
                splits[node] = (found["feature"], found["bin"])
                for side, k in (("low", 2 * node), ("high", 2 * node + 1)):
                    inherited = np.array(found[side])
                    leaves[k] = dict(hist=np.zeros((2, bins, goal.width)), have=inherited)
    return answers, splits


def edges(data):
    first = min(r[2] for r in data)
    return [(min(r[j] for r in data if r[2] == first and r[j] is not None), max(r[j] for r in data if r[2] == first and r[j] is not None)) for j in (3, 4)]


@pytest.mark.parametrize("kind", ["classes", "numbers"])
@pytest.mark.parametrize("gaps", [False, True])
def test_trees_are_those_grown_row_by_row(spark, kind, gaps):
    data = rows(1, group=0, gaps=gaps) + rows(2, group=1, gaps=gaps)
    goal, column, target = (T.Classes([0, 1, 2]), "label", 5) if kind == "classes" else (T.Numbers(), "y", 6)
    df = spark.createDataFrame(data, KIND).repartition(5)
    out, splits = T.stream_forest(df, ["g"], "c", ["a", "b"], column, goal, bins=12, depth=3, delta=1e-3)
    got = {(r["g"], r["rid"]): r["answers"] for r in out.collect()}
    assert len(got) == len(data)
    ends, deep = edges(data), 0
    for g in (0, 1):
        mine = [r for r in data if r[0] == g]
        want, grown = plain(mine, target, goal, ends, 12, 3, 1e-3, 0.05)
        for rid, answer in want.items():
            assert got[g, rid] is None if answer is None else got[g, rid][0] == pytest.approx(answer, abs=1e-9), (g, rid)
        assert {r["node"] for r in splits.filter(F.col("g") == g).collect()} == set(grown)
        deep = max(deep, max(grown))
    assert deep >= 2


def test_learns(spark):
    df = spark.createDataFrame(rows(3, n=6000, chunks=12), KIND)
    pred = T.hoeffding_tree(df, [], "c", ["a", "b"], "label", [0, 1, 2], bins=20)
    late = pred.filter("c > 6").agg(F.avg((F.col("label") == F.col("y_pred")).cast("int"))).first()[0]
    assert late > 0.9
    error = {}
    for members in (1, 5):
        out = T.tree_regressor(df, [], "c", ["a", "b"], "y", bins=20, members=members, ident="rid")
        error[members] = out.filter("c > 6").agg(F.avg((F.col("y") - F.col("y_pred")) ** 2)).first()[0]
    assert max(error.values()) < 0.6  # the variance of y is above 2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert T.hoeffding_tree(empty, [], "c", ["a", "b"], "label", [0, 1]).count() == 0
    flat = spark.createDataFrame([(0, i, i // 10, 1.0, None if i < 5 else 2.0, 1, 4.0) for i in range(40)], KIND)
    got = T.hoeffding_tree(flat, [], "c", ["a", "b"], "label", [0, 1]).collect()
    assert len(got) == 40 and [r["y_pred"] for r in sorted(got, key=lambda r: r["rid"])] == [None] * 5 + [0] * 5 + [1] * 30
    only = T.tree_regressor(flat, [], "c", ["a", "b"], "y").collect()
    assert {r["y_pred"] for r in only if r["c"] > 0} == {4.0}


def test_registered(spark):
    df = spark.createDataFrame(rows(4, n=500, chunks=5), KIND).withColumn("seq", F.col("rid") + 1).drop("c")
    out = registry.prequential_regression(df, "tree, bagged_tree", order="seq", features=["a", "b"], target="y", chunk_size=100)
    assert {r["method"]: r["count"] for r in out.groupBy("method").count().collect()} == {"tree": 500, "bagged_tree": 500}
    pred = registry.prequential(df, "hoeffding_tree", order="seq", features=["a", "b"], label="label", n_classes=3, keys=["g"], chunk_size=100)
    assert pred.count() == 500


def test_levels_read_sums_and_not_rows(spark, monkeypatch):
    """The rows are read once, into one row per chunk and bins; the levels and the answers read those."""
    kept, plain = {}, T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: kept.setdefault(name, plain(df, name)) if name.startswith("tree-cells") else plain(df, name))
    rows = [(i, i // 300, float(i % 4), float(i % 3), float((i % 4) * 2 + i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, chunk int, a double, b double, y double").repartition(3)
    out = T.tree_regressor(df, [], "chunk", ["a", "b"], "y", members=3, ident="i")
    assert out.count() == 900 and kept["tree-cells"].count() == 36
    weight = kept["tree-cells"].selectExpr("explode(__sums) AS s").selectExpr("sum(s.w)", "sum(s.terms[0])").first()
    assert weight[0] == weight[1] and 3 * 900 * 5 < weight[0] < 3 * 900 * 7
