import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import runner
from tidemark.operators import detect as D
from tidemark.operators import naive_bayes as nb
from tidemark.operators import select as Q
from tidemark.plans.keyed import keyed_resume, keyed_scan

KIND = "user string, seq long, chunk long, a double, b double, y int"


def rows(n=600, users=4, size=100, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(1, n + 1):
        a, b = float(round(rng.normal(), 5)), float(round(rng.normal(), 5))
        out.append((None if i % users == 3 else f"u{i % users}", i, (i - 1) // size, a, b, int(a + 0.5 * b > 0)))
    return out


def test_a_scan_goes_on_where_it_ended(spark):
    df = spark.createDataFrame(rows(), KIND).withColumn("x", F.col("y").cast("double"))
    machine = D.PageHinkley(min_n=5, threshold=1.0)
    whole = sorted((str(r["user"]), r["seq"], r["kind"]) for r in keyed_scan(df, ["user"], "seq", machine).collect())
    states, got = None, []
    for lo, hi in [(1, 150), (151, 152), (153, 400), (401, 600)]:  # the second part has no row of two users
        out, states = keyed_resume(df.filter(F.col("seq").between(lo, hi)).repartition(3), ["user"], "seq", machine, states)
        got += [(str(r["user"]), r["seq"], r["kind"]) for r in out.collect()]
    assert sorted(got) == whole and len(whole) > 4
    assert states.count() == 4


def test_a_remembering_rule_sees_one_stream_per_key(spark):
    data = rows()
    df = spark.createDataFrame(data, KIND).repartition(4)
    run = runner.active_by_name(df, "naive_bayes", "margin_variable", chunk="chunk", order="seq", features=["a", "b"], label="y", n_classes=2, keys=["user"])
    got = {r["seq"]: (r["is_queried"], r["y_pred"]) for r in run.collect()}
    learned, theta, want = data[:100], {}, {}
    for c in range(1, 6):
        frame = spark.createDataFrame(learned, KIND)
        now = [r for r in data if r[2] == c]
        scored = nb.predict_nb(spark.createDataFrame(now, KIND), nb.fit_nb(frame, ["a", "b"], "y", [0, 1]), ["a", "b"], [0, 1], proba="p").orderBy("seq").collect()
        for r, p in zip(now, scored):
            t = theta.get(r[0], 0.5)
            ask = abs(p["p"][0] - p["p"][1]) < t
            theta[r[0]] = t * (0.99 if ask else 1.01)
            want[r[1]] = (ask, p["y_pred"])
            if ask:
                learned = [*learned, r]
    assert got == want


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame(rows(), KIND)
    model = runner.BayesModel(["a", "b"], "y", [0, 1])
    out = runner.prequential_active(df, model, "chunk", "y", Q.query_all, budget=0.1, order="seq").collect()
    asked = sorted(r["seq"] for r in out if r["is_queried"])
    assert asked == [s for c in range(1, 6) for s in range(100 * c + 1, 100 * c + 11)]
    assert len(out) == 500


def test_rows_without_a_chunk_and_no_rows(spark):
    df = spark.createDataFrame([*rows(200), ("u0", 900, None, 0.0, 0.0, 1)], KIND)
    model = runner.BayesModel(["a", "b"], "y", [0, 1])
    assert runner.prequential_active(df, model, "chunk", "y", Q.query_all).count() == 100
    assert runner.prequential_active(df.limit(0), model, "chunk", "y", Q.query_all).count() == 0
    with pytest.raises(ValueError, match="key"):
        keyed_resume(df, [], "seq", D.PageHinkley(), None)


@pytest.mark.parametrize("name, budget", [("margin_fixed", None), ("top_per_chunk", 0.05), ("submodular", 0.3)])
def test_chunks_in_a_task_and_chunk_by_chunk_agree(spark, monkeypatch, name, budget):
    """Rows with gaps, null keys and classes: the same questions and answers in three segments and in one step per chunk."""
    data = [(u, s, c, None if s % 50 == 7 and name != "cognitive" else a, b, None if s % 41 == 3 and name == "margin_fixed" else y) for u, s, c, a, b, y in rows(400)]
    df = spark.createDataFrame([*data, ("u0", 900, None, 0.0, 0.0, 1)], KIND).repartition(3)
    run = lambda: sorted((r["seq"], r["y_pred"], r["is_queried"]) for r in runner.active_by_name(
        df, "naive_bayes", name, chunk="chunk", order="seq", features=["a", "b"], label="y", n_classes=2, keys=["user"], budget=budget).collect())
    monkeypatch.setattr(runner, "SEGMENT_ROWS", 120)
    held = run()
    monkeypatch.setattr(runner, "HELD_ROWS", 0)
    assert held == run() and len(held) == 300


def test_many_chunks_are_few_jobs(spark):
    """The number of jobs follows the rows, not the chunks."""
    df = spark.createDataFrame(rows(600, size=2), KIND)
    out = runner.active_by_name(df, "broad", "all", chunk="chunk", order="seq", features=["a", "b"], label="y", n_classes=2)
    assert out.count() == 598 and len(out.inputFiles()) <= 2
