import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, voronoi
from tidemark.llm.queries import SPARK

LARGER = "/root/testdata/sf0.1"


def brute(rows, score, chosen, k):
    out = {}
    for q, x in rows:
        if chosen(q):
            ranked = sorted((-score(x, y), i) for i, y in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def integers(x):
    return np.floor(64 * np.asarray(x, float)).astype(np.int64)


@pytest.fixture(scope="module")
def embeddings(spark, sf):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def test_exact_query(spark, sf, embeddings):
    rows = [(i, integers(x)) for i, x in embeddings]
    want = brute(rows, lambda a, b: int(a @ b), lambda q: q % 20 == 0, 20)
    assert collected(SPARK["op4_topk"](spark, sf)) == want


def test_approximate_query_recall(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()]
    m, ids = np.stack([x for _, x in rows]), np.array([i for i, _ in rows])
    got = collected(SPARK["op3_ann"](spark, LARGER))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        hits += len({i for i, _ in found} & set(ids[np.argsort(-s)[:20]].tolist()))
        at = dict(zip(ids.tolist(), s))
        assert all(abs(at[i] - v) < 1e-12 for i, v in found) and len(found) == 20
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 0.5, 0.0, 0.25]) for i in range(40)]  # copies
    return rows


ODD = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (905, [])]


@pytest.mark.parametrize("operator", [ann, voronoi])
def test_odd_rows(spark, operator):
    rows = odd_rows()
    frame = spark.createDataFrame([(i, x, "c", 1) for i, x in [*rows, *ODD, rows[0], rows[70]]], "vec_id bigint, embedding array<double>, score string, g int")
    more = {"visit": 10**6} if operator is ann else {"pivots": 5}
    got = collected(operator.search(frame, F.col("vec_id") % 20 == 0, k=5, **more))
    as_ints = operator is voronoi
    plain = [(i, integers(x) if as_ints else np.array(x)) for i, x in rows]
    want = brute(plain, (lambda a, b: int(a @ b)) if as_ints else (lambda a, b: float((a * b).sum())), lambda q: q % 20 == 0, 5)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    empty = frame.limit(0)
    assert operator.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert operator.search(frame.filter("vec_id = 900"), F.col("vec_id") % 20 == 0).count() == 0


def test_zero_vectors_and_large_numbers(spark):
    rows = [(0, [0.0, 0.0]), (20, [1e7, -1e7]), (21, [1e7, -1e7 + 1]), (22, [-1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = brute([(i, [int(v) for v in np.floor(64 * np.array(x))]) for i, x in rows], lambda a, b: sum(p * q for p, q in zip(a, b)), lambda q: q % 20 == 0, 20)
    assert collected(voronoi.search(frame, F.col("vec_id") % 20 == 0)) == want
    assert set(collected(ann.search(frame, F.col("vec_id") % 20 == 0))) == {20}


def test_deeper_levels_share_medians():
    rng = np.random.default_rng(0)
    forest = ann.grow(rng.normal(size=(64, 8)), 1 << 14, trees=2, leaf=32, seed=1)
    assert forest.depth == 9
    leaves = forest.leaves(rng.normal(size=(4000, 8)))
    assert leaves.max() < 512 and len(np.unique(leaves[:, 0])) > 200
    x = rng.normal(size=8)
    assert forest.search(x, 1)[0] in {(t, int(forest.leaves(x[None])[0, t])) for t in (0, 1)}
    assert sorted(forest.search(x, 10**6)) == [(t, n) for t in (0, 1) for n in range(512)]


def test_leaves_follow_the_recall(spark):
    """Vectors without neighbourhood structure: a fixed number of leaves meets few of the nearest."""
    x = np.random.default_rng(8).normal(size=(4000, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    got = collected(ann.search(frame, F.col("vec_id") % 20 == 0, k=10, trees=4, leaf=16, visit=16))
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.9 * 10 * 200


def test_opened_counts_the_leaves_of_the_search():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    forest = ann.grow(x, len(x), trees=3, leaf=16, seed=1)
    for q in x[:5]:
        order = forest.search(q, 10**6)
        for count, leaves in zip(forest.opened(q, x[5:50]), forest.leaves(x[5:50])):
            assert count >= min(order.index((t, n)) for t, n in enumerate(leaves.tolist())) + 1
            assert {(t, n) for t, n in enumerate(leaves.tolist())} & set(order[:count])
