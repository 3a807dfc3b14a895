import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import detect as D
from tidemark.operators import naive_bayes as nb
from tidemark.operators.stream_models import reweighted_stream

KIND = "rid long, batch long, x double, z double, label int"


def rows(flip, batches=8, size=150, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(batches):
        for i in range(size):
            label = int(rng.random() < 0.5)
            sign = -1 if b >= flip else 1
            out.append((b * size + i, 2 * b, float(round(sign * (2 * label - 1) + rng.normal(), 4)), float(round(rng.normal(0.1 * b), 4)), label))
    return out


def density(x):
    """Log density under the mean and shrunk covariance of the rows of x."""
    n, p = x.shape
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True)
    trace, square = np.trace(cov), (cov**2).sum()
    low = (n + 1 - 2 / p) * (square - trace**2 / p)
    share = 1.0 if low == 0 else min(1.0, ((1 - 2 / p) * square + trace**2) / low)
    cov = (1 - share) * cov + (share * trace / p + 1e-9) * np.eye(p)
    inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    return lambda v: -0.5 * (p * np.log(2 * np.pi) + logdet + np.einsum("ni,ij,nj->n", v - mean, inverse, v - mean))


def test_versions_and_predictions_by_definition(spark):
    data = rows(flip=4)
    df = spark.createDataFrame([*data, (9998, 4, None, 0.0, 1), (9999, 4, 0.5, 0.0, None)], KIND).repartition(5)
    pred, versions = reweighted_stream(df, "batch", ["x", "z"], "label", [0, 1])
    table = np.array(data)
    batch, x, y = table[:, 1], table[:, 2:4], table[:, 4].astype(int)
    joint = np.column_stack([x, y])
    models = {b: density(joint[batch == b]) for b in np.unique(batch)}
    detector = D.PageHinkley(min_n=2, delta=0.005, threshold=0.02)
    state, current, want, told = detector.start(), None, {}, {}
    for b in np.unique(batch):
        now, drifted = batch == b, False
        if current is not None:
            guess = current[1](x[now])
            want |= dict(zip(table[now, 0].astype(int).tolist(), guess.tolist()))
            state, alarm = detector.feed(state, {"x": np.array([(guess != y[now]).mean()])})
            drifted = len(alarm["row"]) > 0
            told[int(b)] = (int(current[0]), drifted)
        if current is None or drifted:
            past = batch <= b
            own = np.concatenate([models[c](joint[batch == c]) for c in np.unique(batch[past])])
            w = np.minimum(np.exp(models[b](joint[past])) / (np.exp(own) + 1e-16), 100)
            current = (b, bayes(x[past], y[past], w))
    got = {r["rid"]: r["y_pred"] for r in pred.collect()}
    assert len(got) == len(data) + 2 and got[9998] is None and got[9999] in (0, 1)
    assert {k: got[k] for k in want} == want
    assert all(got[int(i)] is None for i in table[batch == 0, 0])
    found = {r["batch"]: (r["version"], r["drifted"]) for r in versions.collect()}
    assert found.pop(0) == (None, False) and found == told
    assert any(d for _, d in told.values()) and len({v for v, _ in told.values()}) > 1


def bayes(x, y, w):
    stats = [(w[y == c].sum(), (w[y == c] @ x[y == c]) / w[y == c].sum(), (w[y == c] @ x[y == c] ** 2) / w[y == c].sum()) for c in (0, 1)]
    n = w.sum()
    spread = (w @ x**2) / n - ((w @ x) / n) ** 2
    eps = max(spread.max() * 1e-9, 1e-9)

    def predict(v):
        score = [np.log(k / n) - 0.5 * (np.log(2 * np.pi * (q - m**2 + eps)) + (v - m) ** 2 / (q - m**2 + eps)).sum(axis=1) for k, m, q in stats]
        return np.argmax(score, axis=0)

    return predict


def test_a_change_is_followed(spark):
    df = spark.createDataFrame(rows(flip=3, batches=12), KIND)
    pred, _ = reweighted_stream(df, "batch", ["x", "z"], "label", [0, 1])
    plain = nb.chunked_nb(df, [], "batch", ["x", "z"], "label", [0, 1])
    rate = lambda d: d.filter("batch >= 8").agg(F.avg((F.col("label") == F.col("y_pred")).cast("int"))).first()[0]
    assert rate(pred) > rate(plain) + 0.1


def test_no_rows(spark):
    pred, versions = reweighted_stream(spark.createDataFrame([], KIND), "batch", ["x", "z"], "label", [0, 1])
    assert pred.count() == 0 and versions.count() == 0
