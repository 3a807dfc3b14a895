import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import substrings
from tidemark.llm.fmindex import FMIndex, WaveletTree
from tidemark.llm.queries import SPARK


def brute(docs, length):
    """(words, kept words) of each document, for (id, text) in the order of ids."""
    seen, out = set(), {}
    for key, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out[key] = (words, [w for w, g in zip(words, gone) if not g])
    return out


def test_backward_search_against_scan():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 5, 400), 0)
    text[::37] = 0
    index = FMIndex(text, 6)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        at = int(rng.integers(0, 390))
        if (text[at : at + n] == 0).any():
            continue
        want = sum((text[i : i + n] == text[at : at + n]).all() for i in range(len(text) - n + 1))
        matched, low, high = index.matching_statistics(text, np.array([at]), n)
        assert high[0] - low[0] == want if want > 1 else high[0] - low[0] == 1
        if matched[0] == n:
            assert {int(p) for p in index.order[low[0] : high[0]]} == {i for i in range(len(text) - n + 1) if (text[i : i + n] == text[at : at + n]).all()}


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 37, 1000)
    tree = WaveletTree(s, 37)
    for _ in range(100):
        c, a, b = int(rng.integers(0, 37)), int(rng.integers(0, 1001)), int(rng.integers(0, 1001))
        lo, hi = tree.rank(np.array([c]), np.array([a]), np.array([b]))
        assert (lo[0], hi[0]) == ((s[:a] == c).sum(), (s[:b] == c).sum())


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "d", "é", "\xa0x", "w6", "w7"]
    passage = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 30))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 5))]
        docs.append((i * 3 - 20, rng.choice([" ", "\n", "\t "]).join(parts)))
    return [*docs, (500, None), (501, ""), (502, "a " * 300), (503, "a b " * 200), (504, "a"), (505, " \t\n ")]


@pytest.mark.parametrize("length,crowd,shard", [(5, 20_000, 400_000), (5, 0, 400_000), (8, 3, 200), (20, 20_000, 100)])
def test_against_brute_force(spark, length, crowd, shard):
    docs = corpus(length)
    want = brute(docs, length)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, th string, span int").repartition(5)
    got = substrings.remove_repeats(frame, length=length, crowd=crowd, shard_words=shard).collect()
    assert len(got) == len(docs)
    for r in got:
        words, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(words), len(words) - len(kept), " ".join(kept))


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (None, text), (2, text + " seven"), (1, "zero " + text)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=5).collect()), key=str)
    assert got == sorted([(None, 6, 0), (1, 6, 6), (1, 6, 6), (2, 7, 6), (1, 7, 6)], key=str)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = {k: (len(w), len(w) - len(x), hashlib.sha256(" ".join(x).encode()).hexdigest()) for k, (w, x) in brute(docs, 20).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in SPARK["op9_substrings"](spark, sf).collect()}
    assert got == want


def test_very_long_texts(spark):
    """Half a million equal words keep one; as many different ones stay; a copy of the latter goes."""
    many = " ".join(f"w{i}" for i in range(500_000))
    rows = [(1, "same " * 500_000), (2, many), (3, "begin " + many)]
    out = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=20).collect()}
    assert [out[i]["n_words"] for i in (1, 2, 3)] == [500_000, 500_000, 500_001]
    assert [out[i]["n_removed"] for i in (1, 2, 3)] == [499_999, 0, 500_000]
    assert out[1]["kept"] == "same" and out[2]["kept"] == many and out[3]["kept"] == "begin"
