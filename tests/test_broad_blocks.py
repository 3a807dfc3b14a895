import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import broad as B


def test_small_chunks_have_no_sums_of_their_own(spark, monkeypatch):
    """Blocks of chunks are summed, not chunks, and every row has the prediction of its chunk's model."""
    rng = np.random.default_rng(4)
    rows = [(i, i // 6, [float(v) for v in rng.normal(size=4)], None if i % 17 == 0 else i % 3) for i in range(240)]
    rows += [(900, None, [0.0] * 4, 1), (901, 5, None, 1)]
    df = spark.createDataFrame(rows, "id int, chunk int, x array<double>, y int").repartition(3)
    nodes = B.NodeMap.fitted(df.filter("chunk = 0"), "x", 4, nf=2, n1=3, ne=2, n2=3, extra=((7, 1, 1),))
    learner = B.BroadLearner(nodes, 3, mode="anchor", anchors=np.eye(4))
    hidden = F.when(F.col("id") % 4 != 1, F.col("y"))
    summed = []
    plain = B.BroadLearner.stats
    monkeypatch.setattr(B.BroadLearner, "stats", lambda self, *a, **k: summed.append(plain(self, *a, **k)) or summed[-1])
    got = learner.prequential(df, [], "chunk", "x", "y", train_label=hidden, span=8)
    assert got.columns == [*df.columns, "y_pred", "proba"]
    got = {r["id"]: r for r in got.collect()}
    assert summed[0].count() == 5  # blocks of eight of the forty chunks
    df = df.filter("chunk IS NOT NULL")
    learn = df.withColumn("t", hidden)
    want = learner.score(df, learner.models(learner.stats(learn, [], "chunk", "x", "t"), [], "chunk"), ["chunk"], "chunk", "x").collect()
    assert got.pop(900)["y_pred"] == 0 and len(got) == len(want) == 240
    for r in want:
        assert got[r["id"]]["y_pred"] == r["y_pred"] and np.allclose(got[r["id"]]["proba"], r["proba"], atol=1e-6)
