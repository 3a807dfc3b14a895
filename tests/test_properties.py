"""Properties of injection, selection, weights, chunking and sinks, and small brute-force checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import registry as RG
from tidemark.functions import maps as MP
from tidemark.functions.hashing import hash_uniform
from tidemark.operators import audit as AU
from tidemark.operators import chunking as CK
from tidemark.operators import density as DE
from tidemark.operators import detect as D
from tidemark.operators import ensembles as E
from tidemark.operators import inject as IN
from tidemark.operators import metrics as M
from tidemark.operators import resample as RS
from tidemark.operators import select as Q
from tidemark.operators import trees as TR
from tidemark.operators import weights as W
from tidemark.operators.stream_models import density_drift
from tidemark.operators.validate import validate_drift
from tidemark.sources import tables as S
from tidemark.streaming.sinks import run_to_table
from tidemark.streaming.sources import stream_source


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 2000
    pdf = pd.DataFrame({"seq": np.arange(1, n + 1), "a": rng.normal(size=n), "b": rng.normal(5, 2, n), "label": rng.integers(0, 3, n)})
    return pdf


def inject(spark, pdf, config, partitions=4, **options):
    df = spark.createDataFrame(pdf).repartition(partitions)
    return IN.inject_drift(df, config, features=["a", "b"], label="label", seq="seq", **options).toPandas().sort_values("seq").reset_index(drop=True)


@pytest.mark.parametrize("kind", ["sudden", "gradual", "incremental", "recurring"])
def test_injection_touches_only_drifting_rows(spark, table, kind):
    config = IN.DriftConfig(kind, 0.8, 0.5, width=0.2, n_cycles=4)
    one, many = inject(spark, table, config, 1), inject(spark, table, config, 7)
    pd.testing.assert_frame_equal(one, many)
    calm = one["severity"] == 0
    assert calm.any() and (~calm).any()
    for c in ("a", "b", "label"):
        np.testing.assert_array_equal(one.loc[calm, c], table.loc[calm.to_numpy(), c])
    assert (one.loc[~calm, "a"] != table.loc[~calm.to_numpy(), "a"]).mean() > 0.3
    assert one["severity"].max() <= 0.8 + 1e-12


def test_gradual_drift_may_stay(spark, table):
    clean = inject(spark, table, IN.DriftConfig("gradual", 0.6, 0.5, width=0.2))
    stays = inject(spark, table, IN.DriftConfig("gradual", 0.6, 0.5, width=0.2, after="drifted"))
    assert clean["severity"].iloc[-1] == 0 and stays["severity"].iloc[-1] == 0.6


def test_bad_drift_settings_are_refused(spark, table):
    with pytest.raises(ValueError, match="unknown drift type"):
        IN.DriftConfig("sideways")
    with pytest.raises(ValueError, match="more cycles"):
        inject(spark, table, IN.DriftConfig("recurring", 0.5, 0.5, n_cycles=10**6))


def test_injected_drift_is_found_again(spark, table):
    df = spark.createDataFrame(table).withColumn("label", (F.col("a") > 0).cast("int"))
    drifted = IN.inject_drift(df, IN.DriftConfig("sudden", 1.0, 0.5), features=["a", "b"], label="label", seq="seq")
    for model in ("nb", "logistic"):
        _, calm = validate_drift(df, ["a", "b"], "label", [0, 1], window=100, model=model)
        _, moved = validate_drift(drifted, ["a", "b"], "label", [0, 1], window=100, model=model)
        assert moved.first()["drift_detected"]
        assert moved.first()["n_jumps"] >= calm.first()["n_jumps"]


def test_budget_is_kept(spark):
    pdf = pd.DataFrame({"key": 1, "seq": np.arange(1, 1001), "w": True})
    out = Q.query_keyed(spark.createDataFrame(pdf), ["key"], "seq", Q.Budget(0.1), {"wanted": F.col("w")}).toPandas().sort_values("seq")
    share = out["is_queried"].cumsum().to_numpy() / np.arange(1, 1001)
    assert share[20:].max() <= 0.1 + 1 / 20 and out["is_queried"].sum() >= 99


def test_cognitive_memory_is_bounded_and_spend_follows_labels():
    rng = np.random.default_rng(0)
    rule = Q.Cognitive(budget=0.2, memory=10)
    cols = {"features": np.array(list(rng.random((500, 2))) + [None], dtype=object)[:-1], "top": rng.uniform(0.3, 0.9, 500)}
    state, out = rule.feed(rule.start(), cols)
    assert len(state["points"]) == 11
    assert 0 < out["is_queried"].sum() <= 500 * 0.25
    half, first = rule.start(), []
    for lo, hi in ((0, 123), (123, 500)):
        half, o = rule.feed(half, {k: v[lo:hi] for k, v in cols.items()})
        first += o["is_queried"].tolist()
    assert first == out["is_queried"].tolist()


def test_weights_sum_to_the_row_count_and_favour_the_newest_batch(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"rid": [f"r{i}" for i in range(900)], "batch": np.repeat([0, 1, 2], 300)})
    pdf["x"] = rng.normal(pdf["batch"] * 2.0, 1.0)
    pdf["y"] = rng.normal(0, 1, 900)
    df = spark.createDataFrame(pdf)
    models = DE.BatchDensities.fit(df, "batch", ["x", "y"])
    dens = DE.batch_densities(df, models, "batch", window=1)
    made = {
        "direct": W.weight_direct(dens), "ratio": W.weight_ratio(dens), "balance": W.weight_balance(dens), "window": W.weight_balance_window(dens),
        "recent": W.weight_recent(df, "batch", 1), "forest": W.weight_classifier(df, "batch", ["x", "y"], trees=5),
        "logistic": W.weight_classifier(df, "batch", ["x", "y"], model="logistic"),
        "rulsif": W.weight_rulsif(df, "batch", ["x", "y"], "rid", centres=30, sigmas=(0.5, 1.0), lambdas=(0.01, 0.1)),
    }
    for name, w in made.items():
        pdf = w.toPandas()
        assert (pdf["weight"] >= 0).all(), name
        if name != "rulsif":
            assert pdf["weight"].sum() == pytest.approx(900, rel=1e-6), name
        old = pdf[pdf["batch"] == 0]
        near, far = old[old["x"] > 1.5]["weight"].mean(), old[old["x"] < -1]["weight"].mean()
        assert far <= near or name == "recent", name
    kliep = W.weight_kliep(df, "batch", ["x", "y"], "rid").toPandas()
    assert kliep[kliep["batch"] == 2]["weight"].mean() == pytest.approx(1.0, abs=1e-6)
    old = kliep[kliep["batch"] == 2]
    assert old[old["x"] < 2.5]["weight"].mean() > 2 * old[old["x"] > 5]["weight"].mean()  # the ratio is that of the older batches


def test_kernel_and_mixture_densities_against_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(200), "x": rng.normal(size=200), "y": rng.normal(size=200)})
    df = spark.createDataFrame(pdf)
    p = pdf[["x", "y"]].to_numpy()
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    want = np.log(np.exp(-d / (2 * 0.25)).mean(axis=1) / (2 * np.pi * 0.25))
    for tile in (16, 4096):
        got = DE.kde_logpdf(df, df, [], ["x", "y"], "id", bandwidth=0.5, tile=tile).toPandas().sort_values("id")
        np.testing.assert_allclose(got["logpdf"], want, rtol=1e-9)


def test_mixture_density_of_two_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (400, 2)), rng.normal(12, 1, (400, 2))])
    df = spark.createDataFrame(pd.DataFrame({"x": x[:, 0], "y": x[:, 1]}))
    step = 0.25
    axis = np.arange(-8, 20, step)
    grid = spark.createDataFrame(pd.DataFrame([(a, b) for a in axis for b in axis], columns=["x", "y"]))
    dens = DE.gmm_logpdf(grid, df, ["x", "y"], k=2).toPandas()
    assert np.exp(dens["logpdf"]).sum() * step**2 == pytest.approx(1.0, abs=0.03)  # a density
    fit = DE.gmm_logpdf(df, df, ["x", "y"], k=2).toPandas()["logpdf"].mean()
    mix = DE.fit_mixture(df, ["x", "y"], k=2)
    assert np.allclose(np.sort(mix.means[:, 0]), [0, 12], atol=0.3) and np.allclose(mix.weights, 0.5, atol=0.01) and mix.steps < 30
    gaps = DE.gmm_logpdf(spark.createDataFrame([(1.0, None), (0.0, 0.0)], "x double, y double"), df, ["x", "y"]).toPandas()["logpdf"]
    assert np.isnan(gaps).sum() == 1
    one = -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(np.cov(x.T, bias=True))) + 2)
    assert fit >= one - 0.05  # no worse than one Gaussian


def test_resampling_follows_weights(spark):
    pdf = pd.DataFrame({"seq": np.arange(1, 101), "w": np.where(np.arange(100) < 10, 9.0, 0.0) + 1.0})
    out = W.importance_resample(spark.createDataFrame(pdf), "w", "seq", size=2000, replicas=3).toPandas()
    assert len(out) == 6000 and (out.groupby("replica").size() == 2000).all()
    assert (out["seq"] <= 10).mean() == pytest.approx(100 / 190, abs=0.03)


def test_underbag_is_balanced(spark):
    pdf = pd.DataFrame({"c": 1, "id": np.arange(500), "y": (np.arange(500) < 40).astype(int)})
    out = RS.underbag(spark.createDataFrame(pdf), ["c"], "y", "id", bags=4, auto=True).toPandas()
    assert out["bag"].nunique() == 13
    counts = out.groupby(["bag", "y"]).size().unstack()
    assert (counts[0] == 40).all() and (counts[1] == 40).all()
    assert out[out["y"] == 0].groupby("bag")["id"].apply(lambda s: frozenset(s)).nunique() == 13


def test_smote_brings_parity(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"seq": np.arange(300), "x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf["y"] = (rng.random(300) < 0.2).astype(int)
    pdf["b"] = pdf["seq"] // 100
    out = RS.adaptive_smote(spark.createDataFrame(pdf), "b", "y", "seq", ["x", "z"]).toPandas()
    for b in (1, 2):
        block = pdf[pdf["b"] == b]
        assert len(out[out["b"] == b]) == (block["y"] == 0).sum() - (block["y"] == 1).sum()
        pts = np.stack(out[out["b"] == b]["features"])
        few = block[block["y"] == 1][["x", "z"]].to_numpy()
        assert (pts >= few.min(axis=0) - 1e-9).all() and (pts <= few.max(axis=0) + 1e-9).all()
    assert out[out["b"] == 0].empty  # nothing before the first block to compare with


def test_poisson_quantile_matches_the_table(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") / 3000.0).alias("u"))
    from tidemark.functions.hashing import poisson_cdf

    got = df.select("u", RS.poisson_quantile(F.col("u"), F.lit(2.5)).alias("k")).toPandas()
    want = np.searchsorted(np.array(poisson_cdf(2.5)), got["u"], side="right")
    assert (got["k"] == want).mean() > 0.999


def test_growing_chunks_cover_the_stream(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=1500) > 0.8).astype(int)
    y[800:] = (x[800:, 1] > 0.8).astype(int)
    pdf = pd.DataFrame({"key": 1, "seq": np.arange(1, 1501), "a": x[:, 0], "b": x[:, 1], "label": y})
    df = spark.createDataFrame(pdf)
    for machine in (CK.VarianceChunks(bags=100, team=30, draws=30, block=100), CK.PermutationChunks(perms=30, bags=30, block=100)):
        out = CK.growing_chunks(df, ["key"], "seq", ["a", "b"], "label", machine).toPandas().sort_values("chunk_id")
        assert out["chunk_id"].tolist() == list(range(len(out))) and len(out) >= 2
        assert out["n_rows"].sum() <= 1500 and out["n_rows"].min() >= 100
    changed = out[(out["p_value"] < 0.05)]
    assert ((changed["seq"] > 800) & (changed["seq"] < 1150)).any()


def test_stumps_split_on_the_informative_feature():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 1] > 0.5).astype(int)
    s = CK.Stumps(x, y, 50, 1)
    assert (s.feature == 1).mean() > 0.95
    assert abs(np.median(s.cut) - 0.5) < 0.2
    assert ((s.proba(x).mean(axis=0) > 0.5) == y).mean() > 0.9


def test_density_drift_alarms_after_a_shift(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 2))
    x[600:] += 4
    pdf = pd.DataFrame({"key": 1, "t": np.arange(1, 1201), "a": x[:, 0], "b": x[:, 1]})
    out = density_drift(spark.createDataFrame(pdf), ["key"], "t", ["a", "b"], chunk=100, machine=D.PageHinkley(threshold=60.0)).toPandas()
    assert len(out) and 600 < out["t"].min() <= 720


def test_sparsify_against_numpy(spark):
    w = {0: 0.5, 1: -0.4, 2: 0.3, 3: 0.1}
    v = {0: 1.0, 1: 1.0, 2: 2.0, 3: 0.0}
    df = spark.createDataFrame([(w, v)], "w map<int,double>, v map<int,double>")
    got = df.select(MP.sparsify(F.col("w"), MP.informativeness(F.col("v")), 0.5, 0.2).alias("o")).first()["o"]
    mass = sum(abs(w[k]) * v[k] / 4 for k in w)
    scale = min(1.0, 0.2 / mass)
    assert got[0] == pytest.approx(0.5 * scale) and got[2] == pytest.approx(0.3 * scale)
    assert got[1] == 0 and got[3] == 0


def test_one_hot_refuses_unknown_classes(spark):
    from tidemark.functions.arrays import one_hot

    df = spark.createDataFrame([(0,), (3,)], "y int")
    with pytest.raises(Exception, match="class id outside range"):
        df.select(one_hot(F.col("y"), 3)).collect()


def test_labelled_table_checks_its_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 0), (2, None, "b", 1)], "seq int, x double, s string, y int")
    with pytest.raises(ValueError, match="not in the table"):
        S.labelled_table(df, ["nope"], "y", "seq")
    with pytest.raises(ValueError, match="not numeric"):
        S.labelled_table(df, ["s"], "y", "seq")
    assert [r["features"] for r in S.labelled_table(df, ["x"], "y", "seq").orderBy("seq").collect()] == [[1.0], None]


def test_registry_refuses_unknown_and_unfit_learners(spark, table):
    df = spark.createDataFrame(table)
    run = lambda names, **k: RG.prequential(df, names, order="seq", features=["a", "b"], label="label", n_classes=3, **k)
    with pytest.raises(ValueError, match="unknown names"):
        run("naive_bayes, nothing")
    with pytest.raises(ValueError, match="per-key"):
        run("adaptive_bagging")
    with pytest.raises(ValueError, match="two classes"):
        run("expert_selection", keys=["seq"])
    out = run("naive_bayes, bagging", chunk_size=200)
    assert {r["method"]: r["count"] for r in out.groupBy("method").count().collect()} == {"naive_bayes": 2000, "bagging": 2000}


def test_split_tree_learns_an_axis_rule(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.random(4000), "b": rng.random(4000), "c": np.arange(4000) // 1000})
    pdf["label"] = ((pdf["a"] > 0.5) & (pdf["b"] > 0.3)).astype(int)
    out = TR.hoeffding_tree(spark.createDataFrame(pdf), [], "c", ["a", "b"], "label", [0, 1], delta=1e-3)
    acc = out.groupBy("c").agg(F.avg((F.col("label") == F.col("y_pred")).cast("int")).alias("a")).toPandas().set_index("c")["a"]
    assert acc[3] > 0.95 > acc[0]


def test_saved_labels_give_the_published_scores(spark):
    """Accuracy and macro-F1 of a confusion with known answers, and their summary over rounds."""
    rows = [(r, t, p) for r, table in enumerate(([(0, 0)] * 40 + [(0, 1)] * 10 + [(1, 1)] * 30 + [(1, 0)] * 20, [(0, 0)] * 50 + [(1, 1)] * 50)) for t, p in table]
    df = spark.createDataFrame(rows, "round int, y_true int, y_pred int")
    acc = M.accuracy(df, ["round"])
    assert {r["round"]: r["accuracy"] for r in acc.collect()} == {0: 0.7, 1: 1.0}
    f1 = {r["round"]: r["macro_f1"] for r in M.macro_f1(df, ["round"], [0, 1]).collect()}
    assert f1[0] == pytest.approx((80 / 110 + 60 / 90) / 2) and f1[1] == 1.0
    s = M.round_summary(acc.withColumn("m", F.lit("x")), ["m"], ["accuracy"]).first()
    assert s["accuracy_mean"] == pytest.approx(0.85) and s["accuracy_std"] == pytest.approx(0.15)


def test_ks_windows_against_a_plain_statistic(spark, table):
    from tidemark.functions.numeric import ks_statistic

    got = {r["window_id"]: r["ks"] for r in AU.ks_windows(spark.createDataFrame(table), "b", 250).collect()}
    v = table["b"].to_numpy().reshape(-1, 250)
    assert got == pytest.approx({i: ks_statistic(v[i], v[i - 1]) for i in range(1, 8)})


def test_a_repeated_batch_is_not_counted_twice(spark, tmp_path):
    from tidemark.streaming.sinks import write_batches

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(100).coalesce(1).write.parquet(src)
    schema = spark.range(1).schema
    for attempt in ("a", "b"):  # a lost checkpoint replays the same batch
        write_batches(stream_source(spark, src, schema), out, str(tmp_path / attempt)).awaitTermination(120)
    assert spark.read.parquet(out).count() == 100
    assert run_to_table(stream_source(spark, src, schema), "again").count() == 100


def slow_mixture(phi, steps=40_000):
    """Shares of least negative mean log by the plain multiplicative rule."""
    share = np.full(phi.shape[1], 1 / phi.shape[1])
    for _ in range(steps):
        share = share * (phi / (phi @ share)[:, None]).mean(axis=0)
    return share


def test_kernel_ratio_is_the_largest_mean_log_ratio(spark):
    """Width and number of centres by held-out score, weights of the best fit, both against a slow plain fit."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"rid": [f"r{i}" for i in range(300)], "batch": np.repeat([0, 1, 2], 100)})
    pdf["x"] = rng.uniform(-1, 1, 300) + 0.15 * pdf["batch"]
    df = spark.createDataFrame(pdf)
    sigmas, centres, folds = (0.4, 0.8), (5, 12), 3
    got = W.weight_kliep(df, "batch", ["x"], "rid", sigmas=sigmas, centres=centres, folds=folds, tolerance=1e-7).toPandas().set_index("rid")["weight"]
    draws = df.select("rid", hash_uniform(F.col("rid"), "42:fold").alias("f"), hash_uniform(F.col("rid"), "42:centre").alias("u")).toPandas()
    pdf = pdf.merge(draws, on="rid")
    rest, new = pdf[pdf["batch"] < 2], pdf[pdf["batch"] == 2]
    std = rest["x"].std(ddof=0)
    fold = np.floor(rest["f"] * folds).to_numpy()
    points = rest.sort_values(["u", "rid"])["x"].to_numpy()
    best = None
    for sigma in sigmas:
        for n in centres:
            kernel = lambda x: np.exp(-((x.to_numpy()[:, None] - points[None, :n]) / std) ** 2 / (2 * sigma**2))  # noqa: B023, E731
            mean = kernel(new["x"]).mean(axis=0)
            phi = kernel(rest["x"]) / mean
            held = sum(np.log(np.maximum(phi[fold == f] @ slow_mixture(phi[fold != f], 4000), 1e-300)).sum() for f in range(folds))
            if best is None or held > best[0]:
                best = (held, kernel(pdf["x"]) / mean @ slow_mixture(phi))
    assert np.allclose(got.loc[pdf["rid"]].to_numpy(), best[1], rtol=0.02, atol=0.02)
    assert np.log(got.loc[rest["rid"]]).mean() == pytest.approx(np.log(best[1][: len(rest)]).mean(), abs=1e-5)


@pytest.mark.parametrize("seed", range(5))
def test_nonnegative_minimum(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 8))
    h, c = a.T @ a, rng.normal(size=8) * 3
    x = W.nonnegative_minimum(h, c)
    slope = h @ x + c
    assert (x >= 0).all() and (slope >= -1e-9).all() and abs(slope @ x) < 1e-9


def test_relative_ratio_is_the_ridge_fit(spark):
    """Width and penalty by held-out score over hash folds, and the weights, against plain matrices."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"rid": [f"r{i}" for i in range(300)], "batch": np.repeat([0, 1, 2], 100)})
    pdf["x"], pdf["y"] = rng.normal(0.5 * pdf["batch"], 1.0), rng.normal(size=300)
    df = spark.createDataFrame(pdf)
    sigmas, lambdas, folds, alpha = (0.5, 2.0), (0.01, 1.0), 3, 0.2
    got = W.weight_rulsif(df, "batch", ["x", "y"], "rid", alpha=alpha, centres=40, sigmas=sigmas, lambdas=lambdas, folds=folds).toPandas().set_index("rid")["weight"]
    draws = df.select("rid", hash_uniform(F.col("rid"), "42:fold").alias("f"), hash_uniform(F.col("rid"), "42:centre").alias("u")).toPandas()
    pdf = pdf.merge(draws, on="rid")
    new, old, fold = pdf["batch"] == 2, pdf["batch"] < 2, np.floor(pdf["f"] * folds)
    points = pdf[new].sort_values(["u", "rid"])[["x", "y"]].to_numpy()[:40]
    x, best = pdf[["x", "y"]].to_numpy(), None
    for sigma in sigmas:
        k = np.exp(-((x[:, None] - points[None]) ** 2).sum(axis=2) / (2 * sigma**2))

        def sums(rows):
            a, b = k[rows & new], k[rows & old]
            return alpha * a.T @ a / len(a) + (1 - alpha) * b.T @ b / len(b), a.mean(axis=0)

        for lam in lambdas:
            score = 0.0
            for f in range(folds):
                h2, h1 = sums(fold != f)
                theta = np.linalg.solve(h2 + lam * np.eye(40), h1)
                t2, t1 = sums(fold == f)
                score += 0.5 * theta @ t2 @ theta - t1 @ theta
            if best is None or score < best[0]:
                h2, h1 = sums(fold >= 0)
                best = (score, k @ np.maximum(np.linalg.solve(h2 + lam * np.eye(40), h1), 0.0))
    np.testing.assert_allclose(got.loc[pdf["rid"]].to_numpy(), best[1], rtol=1e-8)
