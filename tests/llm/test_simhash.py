import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected
from tidemark.llm.queries import SPARK


def brute(fps, radius=4):
    """Component label (smallest position) of each fingerprint, by comparing all."""
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, n):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.8:
            x = rng.choice(out)
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
        else:
            x = rng.getrandbits(64)
        out.append(x)
    return out


@pytest.mark.parametrize("large", [2, 8192])
def test_links_against_all_pairs(spark, large):
    rng = random.Random(large)
    fps = sorted(set(near(rng, 400)) | {0, 1, (1 << 64) - 1, 1 << 63})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), large=large)
    pairs = edges.collect()
    assert all(bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 4 for r in pairs)
    root = {r["node"]: r["root"] for r in connected(edges).collect()}
    got = defaultdict(set)
    for x in signed:
        got[root.get(x, x)].add(x)
    want = defaultdict(set)
    for x, label in zip(signed, brute(fps)):
        want[label].add(x)
    assert {frozenset(g) for g in got.values()} == {frozenset(w) for w in want.values()}


def test_fingerprint_of_words(spark):
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n\x0b") == 0
    want = spark.range(1).selectExpr("xxhash64('one two three') AS h").first()["h"] & ((1 << 64) - 1)
    assert simhash.fingerprint("ONE  two\nthree") == want
    assert simhash.fingerprint("a b c d") != simhash.fingerprint("a\xa0b c d")


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_nulls_empty_and_repeats(spark):
    rows = [(5, None, 1), (3, "", 1), (None, "x y", 1), (9, "long " * 50_000, 1), (9, "long " * 50_000, 1), (8, "LONG " * 50_000, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp bigint")).collect()
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == sorted([(5, 3), (3, 3), (None, None), (9, 8), (9, 8), (8, 8)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [simhash.fingerprint(r["text"]) for r in docs]
    want = {docs[i]["doc_id"]: (f"{fps[i]:016x}", docs[label]["doc_id"]) for i, label in enumerate(brute(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in SPARK["op5_simhash"](spark, sf).collect()}
    assert got == want


def plain_fingerprint(text):
    """Shingle by shingle and bit by bit, with words found by the contract's expression."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_bit_by_bit(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["fingerprint"] for r in SPARK["op5_simhash"](spark, sf).collect()}
    assert {r["doc_id"]: f"{plain_fingerprint(r['text']):016x}" for r in rows if len(r["text"] or "") < 20_000} == {
        r["doc_id"]: got[r["doc_id"]] for r in rows if len(r["text"] or "") < 20_000}
