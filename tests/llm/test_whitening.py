import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import whitening
from tidemark.llm.queries import SPARK

KIND = "vec_id bigint, embedding array<float>, component string, n string, id string, vector string"


def matrices(kind, d, rng):
    a = rng.normal(size=(3 * d, d))
    if kind == "graded":
        a = a * np.geomspace(1, 1e-9, d)
    if kind == "equal":
        a = np.linalg.qr(a)[0] * np.repeat([3.0, 1.0], [d - d // 2, d // 2]) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    if kind == "low":
        a[:, d // 3 + 1 :] = a[:, : d // 3 + 1] @ rng.normal(size=(d // 3 + 1, d - d // 3 - 1))
    if kind == "constant":
        a[:, ::2] = 0
    return a


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "low", "constant"])
@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_singular_pairs(kind, d):
    a = matrices(kind, d, np.random.default_rng(d))
    r = np.linalg.qr(a, mode="r")
    diagonal, above, v = whitening.bidiagonalise(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose(v @ b.T @ b @ v.T, r.T @ r, atol=1e-12 * np.abs(r).max() ** 2 * d)
    values, parts = whitening.right_pairs(diagonal, above)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * max(want[0], 1e-300))
    keep = values > 1e-12 * values[0]
    z = v @ whitening.right_vectors(diagonal, above, values[keep], [p for p, k in zip(parts, keep) if k])
    assert np.abs(z.T @ z - np.eye(keep.sum())).max(initial=0) < 1e-11
    assert np.abs(r.T @ r @ z - z * values[keep] ** 2).max(initial=0) <= 1e-13 * want[0] ** 2 * d


def test_small_values_are_as_accurate_as_large_ones():
    """Of a bidiagonal matrix with a known product of values: the least is below 1e-60 of the largest."""
    diagonal, above = np.geomspace(1, 1e-5, 30), np.full(29, 0.5)
    values = whitening.dqds(diagonal, above)
    assert math.isclose(np.log(values).sum(), np.log(diagonal).sum(), rel_tol=1e-13)
    assert whitening.dqds(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=2, max_size=9), st.integers(0, 1000))
def test_values_of_any_bidiagonal(diagonal, seed):
    above = np.random.default_rng(seed).choice([0.0, 1e-9, 0.3, 2.0], len(diagonal) - 1)
    want = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1), compute_uv=False)
    got = whitening.dqds(np.array(diagonal), above)
    assert np.allclose(got, want, atol=1e-7 if min(map(abs, diagonal)) < 1e-6 else 1e-13 * max(1, want[0]))


def plain(vectors, k):
    """(n, deviations, whitened up to sign, explained) by the definition."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, deviation, centred @ q / np.sqrt(e), e / (centred**2).sum() * n


def collected(out):
    rows = {}
    for r in out.collect():
        rows.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    return rows


def test_query_is_its_definition(spark, sf):
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(data)
    n, deviation, white, explained = plain([data[i] for i in ids], 32)
    rows = collected(SPARK["op12_whitening"](spark, sf))
    assert sorted(rows) == ids and all(sorted(r) == list(range(1, 33)) for r in rows.values())
    first = [rows[i][1][0] for i in ids]
    assert {r["n"] for r in first} == {n} and [r["deviation"] for r in first] == deviation
    got = np.array([[rows[i][c][0]["whitened"] for c in range(1, 33)] for i in ids])
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-9
    assert np.allclose([rows[ids[0]][c][0]["explained"] for c in range(1, 33)], explained, rtol=1e-12)
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-10
    assert max(r["identity_error"] for r in first) < 1e-10


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], KIND).repartition(4)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i % 40, rng.normal(size=5).tolist()) for i in range(60)] + [(None, rng.normal(size=5).tolist()), (7, [0.0] * 5)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [1.0, math.inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    out = whitening.whiten(frame(spark, good + odd)).collect()
    assert len(out) == len(good) * 5 and {r["component"] for r in out} == {1, 2, 3, 4, 5}
    n, deviation, white, _ = plain([np.float32(v) for _, v in good], 5)
    assert sorted(r["deviation"] for r in out if r["component"] == 1) == sorted(deviation) and {r["n"] for r in out} == {n}
    assert np.allclose(sorted(abs(r["whitened"]) for r in out if r["component"] == 3), sorted(abs(white[:, 2])))
    assert out[0]["identity_error"] < 1e-10


def test_components_without_variance(spark):
    rows = [(i, [1.0, float(i), 5.0, 2.0 * i]) for i in range(20)]  # one direction
    out = whitening.whiten(frame(spark, rows)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out) and len(out) == 80
    assert out[0]["identity_error"] < 1e-10 and [r["explained"] for r in out if r["component"] == 1][0] == pytest.approx(1)
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 9)).collect()
    assert len(same) == 18 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 for r in same)


def test_no_rows(spark):
    assert whitening.whiten(frame(spark, []).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_whole_numbers_beyond_64_bits(spark):
    rows = [(i, [2.0**35 * (-1) ** i * (i + 1), 1.0]) for i in range(1000)]
    out = whitening.whiten(frame(spark, rows), components=1)
    _, deviation, white, _ = plain([v for _, v in rows], 1)
    got = out.collect()
    assert all(r["deviation"] is None or r["deviation"] == deviation[r["vec_id"]] for r in got)
    assert np.allclose(sorted(abs(r["whitened"]) for r in got), sorted(abs(white[:, 0])))


def test_parts_meet_in_a_tree(spark, monkeypatch):
    """With a small bound on what a task merges, partial results pass several rounds."""
    monkeypatch.setattr(whitening, "HELD", 1)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    out = whitening.whiten(frame(spark, rows).repartition(40))
    white = plain([np.float32(v) for _, v in rows], 6)[2]
    assert np.allclose(sorted(abs(r["whitened"]) for r in out.collect() if r["component"] == 6), sorted(abs(white[:, 5])))
