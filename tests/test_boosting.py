import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import boosting as B
from tidemark.operators import naive_bayes as nb

KIND = "grp int, seq long, chunk long, a double, b double, y int"


def rows(n=1200, groups=2, size=50, seed=1, swap=600):
    """A concept that flips at ``swap`` in each group."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for i in range(1, n + 1):
            a, b = rng.normal(), rng.normal()
            out.append((g, i, (i - 1) // size, float(round(a, 6)), float(round(b, 6)), int((a > 0) == (i <= swap))))
    return out


def accuracy(df, where):
    return df.filter(where).agg(F.avg((F.col("y") == F.col("y_pred")).cast("int"))).first()[0]


def test_majority_follows_a_change(spark):
    df = spark.createDataFrame(rows(), KIND)
    pred, life = B.dynamic_majority(df, ["grp"], "chunk", ["a", "b"], "y", [0, 1])
    pred = pred.cache()
    assert pred.count() == 2400
    assert accuracy(pred, "seq BETWEEN 101 AND 600") > 0.9 and accuracy(pred, "seq > 800") > 0.85
    plain = nb.chunked_nb(df, ["grp"], "chunk", ["a", "b"], "y", [0, 1])
    assert accuracy(pred, "seq > 700") > accuracy(plain, "seq > 700") + 0.2
    life = life.collect()
    assert all(0.01 <= r["weight"] <= 1 and 0 <= r["member"] < r["chunk"] <= r["member"] + 10 for r in life)
    alive = {}
    for r in life:
        alive.setdefault((r["grp"], r["chunk"]), []).append(r["weight"])
    assert max(map(len, alive.values())) <= 5
    assert any(r["member"] >= 12 for r in life)  # born after the change


@pytest.mark.parametrize("run", ["majority", "boost"])
def test_keys_are_separate_streams(spark, run):
    data = rows(400, 3, 40, swap=200)

    def go(df, keys):
        if run == "majority":
            return B.dynamic_majority(df, keys, "chunk", ["a", "b"], "y", [0, 1], members=3, reach=4)[0]
        return B.cost_boost(df, keys, "chunk", ["a", "b"], "y", [0, 1], members=3, costs=[0.5, 1.0])

    together = {(r["grp"], r["seq"]): r["y_pred"] for r in go(spark.createDataFrame(data, KIND), ["grp"]).collect()}
    for g in range(3):
        alone = go(spark.createDataFrame([r for r in data if r[0] == g], KIND).repartition(3), [])
        assert {(g, r["seq"]): r["y_pred"] for r in alone.collect()} == {k: v for k, v in together.items() if k[0] == g}


def gaussian(x, y, w, classes):
    """A predictor of weighted naive Bayes by definition."""
    n = np.array([w[y == c].sum() for c in classes])
    if not n.sum():
        return None
    var_all = [(w @ x[:, j] ** 2) / n.sum() - ((w @ x[:, j]) / n.sum()) ** 2 for j in range(x.shape[1])]
    eps = max(max(var_all) * 1e-9, 1e-9)

    def predict(rows):
        score = np.full((len(rows), len(classes)), -np.inf)
        for i, c in enumerate(classes):
            if n[i]:
                m = (w[y == c] @ x[y == c]) / n[i]
                v = np.maximum((w[y == c] @ x[y == c] ** 2) / n[i] - m**2, 0) + eps
                score[:, i] = np.log(n[i] / n.sum()) - 0.5 * (np.log(2 * np.pi * v) + (rows - m) ** 2 / v).sum(axis=1)
        return np.array(classes)[score.argmax(axis=1)]

    return predict


def test_boost_is_its_definition(spark):
    rng = np.random.default_rng(7)
    n, size, members, costs = 600, 60, 4, np.array([0.6, 1.0, 1.4])
    x = rng.normal(size=(n, 2)).round(5)
    y = ((x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 0] > 1)).astype(int)
    chunk = np.arange(n) // size
    df = spark.createDataFrame([(0, i + 1, int(chunk[i]), *map(float, x[i]), int(y[i])) for i in range(n)], KIND)
    w, votes = costs[y], np.zeros((n, 3))
    for _ in range(members):
        pred, known, before = np.zeros(n, int), np.zeros(n, bool), w.copy()
        for t in range(n // size):
            model = gaussian(x[chunk < t], y[chunk < t], before[chunk < t], [0, 1, 2])
            if model:
                pred[chunk == t], known[chunk == t] = model(x[chunk == t]), True
        for t in range(n // size):
            past, now = known & (chunk < t), known & (chunk == t)
            r = (before * costs[y])[past & (pred == y)].sum()
            f = (before * costs[y])[past & (pred != y)].sum()
            votes[now, pred[now]] += 0.5 * np.log(max(r, 1e-10) / max(f, 1e-10)) if r + f > 0 else 1.0
            step = np.where(pred == y, (r + f) / (2 * r), (r + f) / (2 * f)) if r > 0 and f > 0 else np.ones(n)
            w = np.where(now, before * costs[y] * step, w)
    want = votes.round(12).argmax(axis=1)
    got = {r["seq"]: r["y_pred"] for r in B.cost_boost(df, [], "chunk", ["a", "b"], "y", [0, 1, 2], members=members, costs=costs.tolist()).collect()}
    assert [got[i + 1] for i in range(n)] == want.tolist()


def test_gaps_and_missing_values(spark):
    data = [(0, i, c, None if i % 7 == 0 else float(i % 5), 1.0, None if i % 3 == 0 else i % 2) for i, c in enumerate([0] * 20 + [5] * 20 + [6] * 20 + [11] * 20)]
    df = spark.createDataFrame([*data, (0, 99, 20, 1.0, 1.0, None)], KIND)
    for out in (B.dynamic_majority(df, [], "chunk", ["a", "b"], "y", [0, 1])[0], B.cost_boost(df, [], "chunk", ["a", "b"], "y", [0, 1], members=2)):
        got = out.collect()
        assert len(got) == 81 and all((r["y_pred"] is None) == (r["a"] is None) for r in got)
    empty = df.limit(0)
    assert B.dynamic_majority(empty, [], "chunk", ["a", "b"], "y", [0, 1])[0].count() == 0
    assert B.cost_boost(empty, [], "chunk", ["a", "b"], "y", [0, 1], members=2).count() == 0


def test_by_name(spark):
    df = spark.createDataFrame(rows(300, 1, swap=900), KIND).drop("chunk")
    run = registry.prequential(df, "dynamic_weights, cost_boost", order="seq", features=["a", "b"], label="y", n_classes=2, chunk_size=50)
    got = {r["method"]: r["a"] for r in run.filter("seq > 100").groupBy("method").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a")).collect()}
    assert got["dynamic_weights"] > 0.9 and got["cost_boost"] > 0.6
