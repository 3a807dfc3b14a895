"""Scans, sequences, halos and joins: same answer for any blocks, partitions and skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import chunks as CH
from tidemark.plans import scan as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    key = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 30, 3000))
    pdf = pd.DataFrame({"key": key, "seq": np.arange(1, 3001), "v": rng.integers(-50, 50, 3000)})
    return pdf


@pytest.mark.parametrize("span", [1, 7, 100, 10**6])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_a_plain_scan(spark, skewed, span, exclusive):
    df = spark.createDataFrame(skewed).repartition(5)
    out = S.running(df, ["key"], "seq", {"s": ("sum", F.col("v")), "lo": ("min", "v"), "hi": ("max", F.col("v")), "l": ("last", "v")}, exclusive=exclusive, span=span)
    got = out.toPandas().sort_values("seq").reset_index(drop=True)
    g = skewed.groupby("key")["v"]
    want = pd.DataFrame({"s": g.cumsum(), "lo": g.cummin(), "hi": g.cummax(), "l": skewed["v"]})
    if exclusive:
        want = want.groupby(skewed["key"]).shift(1)
        want["s"] = want["s"].fillna(0)
    for c in ("s", "lo", "hi", "l"):
        np.testing.assert_array_equal(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy())


def test_running_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 3, 5.0)], "key string, seq bigint, v double")
    assert {r["seq"]: r["s"] for r in S.running(df, [], "seq", {"s": ("sum", "v")}, span=1).collect()} == {1: 2.0, 2: 5.0, 3: 10.0}
    assert {r["seq"]: r["s"] for r in S.running(df, ["key"], "seq", {"s": ("sum", "v")}, span=1).collect()} == {1: 2.0, 2: 5.0, 3: 5.0}


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_global_sequence(spark, skewed, partitions):
    df = spark.createDataFrame(skewed).repartition(3)
    got = S.with_global_seq(df, ["key", "seq"], name="at", partitions=partitions).toPandas().sort_values(["key", "seq"])
    assert got["at"].tolist() == list(range(1, 3001))


@pytest.mark.parametrize("size", [20, 64, 10**5])
def test_look_back_over_buckets(spark, skewed, size):
    df = S.with_seq(spark.createDataFrame(skewed), ["key"], "seq", name="rn", span=50)
    got = S.over_last(df, ["key"], 15, {"s": (F.sum("v"), 14, 0), "p": (F.max("v"), 10, 1)}, seq="rn", size=size).toPandas().sort_values("seq")
    g = skewed.groupby("key")["v"]
    np.testing.assert_array_equal(got["s"], g.transform(lambda v: v.rolling(15, min_periods=1).sum()))
    np.testing.assert_array_equal(got["p"].fillna(-99), g.transform(lambda v: v.shift(1).rolling(10, min_periods=1).max()).fillna(-99))


def test_as_of_join(spark):
    rows = spark.createDataFrame([(k, t) for k in (1, 2) for t in range(1, 21)], "key int, t bigint")
    models = spark.createDataFrame([(1, 3, 30.0), (1, 10, 100.0), (2, 7, 7.0)], "key int, t bigint, w double")
    got = {(r["key"], r["t"]): r["w"] for r in CH.latest_before(rows, models, ["key"], "t", ["w"], span=4).collect()}
    for k, t in got:
        want = None
        for mk, mt, w in ((1, 3, 30.0), (1, 10, 100.0), (2, 7, 7.0)):
            if mk == k and mt < t:
                want = w
        assert got[(k, t)] == want


def test_salted_join_equals_plain(spark, skewed):
    df = spark.createDataFrame(skewed)
    small = spark.createDataFrame([(k, float(k) * 2) for k in range(0, 20)], "key long, m double")
    pick = lambda d: sorted(map(tuple, d.select("seq", F.coalesce("m", F.lit(-1.0))).collect()))
    assert pick(CH.salted_join(df, small, ["key"], salts=5)) == pick(df.join(small, ["key"], "left"))


def test_no_block_is_wider_than_its_span(spark, skewed):
    """The row window is partitioned by key and block, never by the key alone."""
    out = S.running(spark.createDataFrame(skewed), ["key"], "seq", {"s": ("sum", "v")}, span=100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [w for w in plan.splitlines() if "Window" in w and "__is_row" in w]
    assert row_windows and all("__run_block" in w for w in row_windows)
