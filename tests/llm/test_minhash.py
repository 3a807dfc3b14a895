import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import minhash

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similarity(x, y):
    return len(x & y) / len(x | y)


def jaccard(a, b, size=5):
    return similarity(shingle_set(a, size), shingle_set(b, size))


def planted(rng, n, words=200):
    """Pairs (original, copy with replaced words) around the threshold."""
    out = []
    for _ in range(n):
        a = [f"w{rng.randrange(5000)}" for _ in range(words)]
        b = a[:]
        for at in rng.sample(range(words), rng.randint(1, 7)):
            b[at] = f"x{rng.randrange(5000)}"
        out.append((" ".join(a), " ".join(b)))
    return out


def test_stage_finds_edited_copies_and_no_others(spark, sf):
    pairs = planted(random.Random(3), 150)
    rows = [(2 * i + j, t, "en", "s", len(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    stay = {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, KIND).repartition(4), sf).collect()}
    near = [i for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    assert len(near) > 60 and len(pairs) - len(near) > 30
    assert {2 * i for i in range(150)} | {2 * i + 1 for i in range(150) if i not in near} <= stay
    assert sum(2 * i + 1 not in stay for i in near) >= 0.98 * len(near)


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_spanning_connects_what_all_pairs_connect(similarity):
    rng = np.random.default_rng(1)
    members = [(i, np.unique(rng.integers(0, 40, 25).astype(np.uint64))) for i in range(60)]
    root = list(range(60))

    def find(root, i):
        while root[i] != i:
            i = root[i]
        return i

    def classes(edges):
        root = list(range(60))
        for a, b in edges:
            a, b = find(root, a), find(root, b)
            root[max(a, b)] = min(a, b)
        return [find(root, i) for i in range(60)]

    sets = [set(h.tolist()) for _, h in members]
    pairs = [(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]
    edges = minhash.spanning(members, similarity)
    assert {(max(e), min(e)) for e in edges} <= set(pairs)
    assert classes(edges) == classes(pairs)


def test_nulls_copies_and_repeats(spark):
    rows = [(5, None), (3, ""), (None, "x y"), (9, "long " * 5000), (9, "long " * 5000), (8, "LONG " * 5001), (4, "x  Y"), (None, "p q")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(5, 3), (3, 3), (None, 4), (9, 8), (9, 8), (8, 8), (4, 4), (None, None)]
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == sorted(want, key=str)


def test_large_buckets_are_compared_in_tiles(spark, monkeypatch):
    """Near misses that share most of a template, some linked: the classes of all pairs, whatever the tile's size."""
    rng = random.Random(9)
    template, rows = [f"t{i}" for i in range(120)], []
    for i in range(90):
        words = template[:]
        for at in rng.sample(range(120), rng.choice([1, 2, 6, 9])):
            words[at] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    want = {i: label[i] for i in range(len(rows))}
    assert 1 < len(set(label)) < 90
    for tile in (1024, 7):
        monkeypatch.setattr(minhash, "TILE", tile)
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
        assert {r["doc_id"]: r["component"] for r in out.collect()} == want, tile
