"""Golden vectors, plain per-row references, and slicing / streaming parity of the detectors."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import beta_cdf, chi2_sf, f_cdf, ks_exact_pvalues, ks_statistic
from tidemark.operators import detect as D
from tidemark.streaming.keyed_state import keyed_stream
from tidemark.streaming.sinks import run_to_table
from tidemark.streaming.sources import stream_source


def run(machine, values, pieces=1):
    state, out = machine.start(), []
    at = 0
    for part in np.array_split(np.asarray(values, dtype=float), pieces):
        state, o = machine.feed(state, {"x": part})
        out += [(at + int(r), k) for r, k in zip(o["row"], o["kind"])]
        at += len(part)
    return sorted(out)


DDM_INPUT = [1 if i % 10 == 9 else 0 for i in range(200)] + [i % 2 for i in range(100)]
EDDM_INPUT = [1 if i % 10 == 9 else 0 for i in range(400)] + [i % 2 for i in range(400)]
PH_INPUT = [i % 2 for i in range(1000)] + [4 + i % 4 for i in range(1000)]


@pytest.mark.parametrize("pieces", [1, 7, 50])
def test_ddm_golden(pieces):
    out = run(D.Ddm(), DDM_INPUT, pieces)
    assert [i for i, k in out if k == "warning"] == list(range(223, 255))
    assert [i for i, k in out if k == "change"] == [255]


def test_ddm_reset_on_warning_golden():
    assert run(D.Ddm(reset_on="warning"), DDM_INPUT) == [(223, "warning")]


@pytest.mark.parametrize("pieces", [1, 9])
def test_eddm_golden(pieces):
    out = run(D.Eddm(), EDDM_INPUT, pieces)
    warnings = [i for i, k in out if k == "warning"]
    assert [i for i, k in out if k == "change"] == [503]
    assert len(warnings) == 30 and warnings[0] == 473


@pytest.mark.parametrize("pieces", [1, 13])
def test_page_hinkley_golden(pieces):
    assert run(D.PageHinkley(), PH_INPUT, pieces) == [(1010, "change")]


def test_page_hinkley_direction():
    falling = [10.0] * 200 + [0.0] * 200
    assert run(D.PageHinkley(), falling) == []
    assert run(D.PageHinkley(direction="down"), falling)


def plain_ddm(values):
    n = errors = 0
    low = low_p = low_s = math.inf
    out = []
    for i, e in enumerate(values):
        n, errors = n + 1, errors + e
        p = errors / n
        s = math.sqrt(p * (1 - p) / n)
        if n + 1 < 30:
            continue
        if p + s <= low:
            low, low_p, low_s = p + s, p, s
        if p + s > low_p + 3 * low_s:
            out.append((i, "change"))
            n = errors = 0
            low = low_p = low_s = math.inf
        elif p + s > low_p + 2 * low_s:
            out.append((i, "warning"))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_ddm_matches_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.random(3000) < r for r in (0.1, 0.4, 0.05, 0.6)]).astype(int)
    assert run(D.Ddm(), values, 11) == plain_ddm(values.tolist())


def test_kswin_finds_a_shift_and_keeps_quiet_without():
    rng = np.random.default_rng(1)
    calm = rng.random(1500)
    assert len(run(D.Kswin(alpha=0.0001), calm)) == 0
    shifted = np.concatenate([calm[:700], calm[700:] + 1])
    alarms = run(D.Kswin(alpha=0.0001), shifted, 8)
    assert alarms and 700 < alarms[0][0] < 760
    assert alarms == run(D.Kswin(alpha=0.0001), shifted, 1)


def test_ks_exact_against_enumeration():
    from itertools import combinations

    n = 4
    p = ks_exact_pvalues(n, n)
    stats = []
    for first in combinations(range(2 * n), n):
        a = np.array(first)
        b = np.array([i for i in range(2 * n) if i not in first])
        stats.append(ks_statistic(a, b))
    for k in range(n + 1):
        assert p[k] == pytest.approx(np.mean(np.array(stats) >= k / n - 1e-12))


def test_tails_against_textbook_values():
    assert f_cdf(4.965, 1, 10) == pytest.approx(0.95, abs=1e-4)
    assert f_cdf(2.978, 10, 10) == pytest.approx(0.95, abs=1e-3)
    assert chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert beta_cdf(0.5, 2, 2) == pytest.approx(0.5)


@pytest.fixture(scope="module")
def stream(spark):
    """Three keys, one holding most of the rows."""
    rng = np.random.default_rng(3)
    frames = []
    for key, n in ((1, 4000), (2, 300), (3, 700)):
        e = np.concatenate([rng.random(n // 2) < 0.1, rng.random(n - n // 2) < 0.5]).astype(int)
        frames.append(pd.DataFrame({"key": key, "seq": np.arange(1, n + 1) * 3, "e": e}))
    return pd.concat(frames).sample(frac=1.0, random_state=0)


@pytest.mark.parametrize("pieces", [1, 17])
def test_adwin_follows_a_shift(pieces):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.random(2000) < 0.1, rng.random(1000) < 0.6]).astype(float)
    out = run(D.Adwin(), values, pieces)
    changes = [i for i, k in out if k == "change"]
    assert changes and 2000 <= changes[0] < 2080
    assert run(D.Adwin(), values[:2000], pieces) == []


def test_adaptive_window_keeps_its_sums():
    rng = np.random.default_rng(3)
    values = rng.normal(size=777)
    window = D.AdaptiveWindow(1e-9)
    for x in values:
        window.add(x)
    assert sum(window.n) == 777 and window.n == sorted(window.n, reverse=True)
    assert max(window.n.count(n) for n in window.n) <= D.AdaptiveWindow.PER_SIZE + 1
    assert len(window.n) < 60
    at = np.cumsum([0, *window.n])
    np.testing.assert_allclose(window.total, [values[a:b].sum() for a, b in zip(at, at[1:])])
    np.testing.assert_allclose(window.dev, [((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(at, at[1:])], atol=1e-9)


@pytest.mark.parametrize("name", ["ddm", "eddm", "page_hinkley", "kswin", "adwin"])
def test_partitions_do_not_matter(spark, stream, name):
    df = spark.createDataFrame(stream)
    options = {"threshold": 5.0} if name == "page_hinkley" else {}
    key = lambda d: sorted(map(tuple, d.select("key", "seq", "kind").collect()))
    whole = key(D.detect(df, ["key"], "seq", F.col("e"), D.detector(name, **options)))
    spread = key(D.detect(df.repartition(13, "seq"), ["key"], "seq", F.col("e"), D.detector(name, **options)))
    assert whole == spread and whole


def test_stream_equals_batch_and_reports_late_rows(spark, stream, tmp_path):
    rows = stream.sort_values("seq").rename(columns={"e": "x"}).astype({"x": float})
    path = str(tmp_path / "in")
    for lo, hi in ((0, 3000), (3000, 9000), (9000, 10**9)):
        spark.createDataFrame(rows[(rows.seq >= lo) & (rows.seq < hi)]).coalesce(1).write.mode("append").parquet(path)
    late = rows[rows.seq == 30]
    spark.createDataFrame(late).coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame(rows).schema
    got = run_to_table(keyed_stream(stream_source(spark, path, schema), ["key"], "seq", D.Ddm()), "t")
    want = D.detect(spark.createDataFrame(rows), ["key"], "seq", F.col("x"), D.Ddm())
    pick = lambda d: sorted(map(tuple, d.select("key", "seq", "kind").collect()))
    assert pick(got.filter("not late")) == pick(want)
    assert sorted(r["key"] for r in got.filter("late").collect()) == sorted(late["key"])


def test_keyless_stream_is_refused(spark, stream):
    with pytest.raises(ValueError, match="key"):
        D.detect(spark.createDataFrame(stream), [], "seq", F.col("e"), D.Ddm())
