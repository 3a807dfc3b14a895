import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_minhash import KIND, jaccard, shingle_set, similarity
from tidemark.llm import minhash, similar
from tidemark.llm.components import connected

FULL = (1 << 64) - 1


def classes(nodes, pairs):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    out = defaultdict(set)
    for x in nodes:
        out[top(x)].add(x)
    return {frozenset(c) for c in out.values()}


def blocks(prints):
    return [(f & FULL) >> 16 * k & 0xFFFF for f in prints for k in range(4)]


def meet(x, y):
    """At most 56 of 192 bits apart, and at most two in some 16-bit block."""
    apart = [bin(a ^ b).count("1") for a, b in zip(blocks(x), blocks(y))]
    return sum(apart) <= 56 and min(apart) <= 2


def edited(rng, n):
    out = []
    for _ in range(n):
        bits = rng.getrandbits(192)
        if out and rng.random() < 0.7:
            bits = rng.choice(out)
            for b in rng.sample(range(192), rng.choice([0, 3, 30, 45, 56, 57, 70])):
                bits ^= 1 << b
        out.append(bits)
    return [tuple(np.array([x >> 64 * i & FULL for i in range(3)], np.uint64).view(np.int64).tolist()) for x in set(out)]


@pytest.mark.parametrize("large, few", [(8192, 256), (8192, 1), (3, 256), (3, 1)])
def test_links_against_all_pairs(spark, large, few):
    prints = edited(random.Random(5), 260)
    firsts = {p[0] for p in prints}
    rows = [(p[0], *p) for p in prints]
    found = similar.links(spark.createDataFrame(rows, "root bigint, f0 bigint, f1 bigint, f2 bigint").repartition(3), large=large, few=few)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    want = [(x[0], y[0]) for i, x in enumerate(prints) for y in prints[:i] if meet(x, y)]
    assert classes(firsts, pairs) == classes(firsts, want)
    assert 10 < len(classes(firsts, want)) < len(firsts)
    got = similar.neighbours(spark.createDataFrame(prints, "f0 bigint, f1 bigint, f2 bigint")).collect()
    assert len(got) == len(prints) and classes(firsts, [(r["root"], r["f0"]) for r in got]) == classes(firsts, want)


def test_a_group_of_copies_needs_few_edges(spark):
    """Neighbours that meet in many variants are not listed pair by pair."""
    rng = random.Random(2)
    base, prints = rng.getrandbits(192), []
    for _ in range(300):
        bits = base
        for b in rng.sample(range(192), 6):
            bits ^= 1 << b
        prints.append(tuple(np.array([bits >> 64 * i & FULL for i in range(3)], np.uint64).view(np.int64).tolist()))
    rows = spark.createDataFrame([(p[0], *p) for p in prints], "root bigint, f0 bigint, f1 bigint, f2 bigint")
    equal = similar.links(rows, radius=0)
    assert equal.count() <= 12 * len(prints)
    first = similar._rooted(rows, connected(equal))
    assert first.select("root").distinct().count() == 1 and similar.links(first).count() == 0
    assert similar.neighbours(rows.drop("root")).select("root").distinct().count() == 1


def shared(x, y):
    """At most 56 of 192 bits apart, and a block with the same mark and at most two of its lower 12 bits apart."""
    bits = list(zip(blocks(x[:3]), blocks(y[:3])))
    near = sum(bin(a ^ b).count("1") for a, b in bits) <= 56
    return near and any(m == n and bin((a ^ b) & 0xFFF).count("1") <= 2 for (a, b), m, n in zip(bits, x[3:], y[3:]))


MARKED = ", ".join(["f0 bigint", "f1 bigint", "f2 bigint", *[f"m{i} bigint" for i in range(12)]])


@pytest.mark.parametrize("large, few", [(8192, 256), (8192, 1), (3, 256), (3, 1)])
def test_links_of_marked_blocks_against_all_pairs(spark, large, few):
    rng = random.Random(8)
    prints = [(*p, *[rng.randrange(-4, 4) << 20 for _ in range(12)]) for p in edited(rng, 260)]
    firsts = {p[0] for p in prints}
    found = similar.links(spark.createDataFrame([(p[0], *p) for p in prints], f"root bigint, {MARKED}").repartition(3), large=large, few=few)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    want = [(x[0], y[0]) for i, x in enumerate(prints) for y in prints[:i] if shared(x, y)]
    assert classes(firsts, pairs) == classes(firsts, want)
    assert 10 < len(classes(firsts, want)) < len(firsts)
    got = similar.neighbours(spark.createDataFrame(prints, MARKED)).collect()
    assert len(got) == len(prints) and classes(firsts, [(r["root"], r["f0"]) for r in got]) == classes(firsts, want)


def test_unlike_texts_share_no_variant():
    """The rows that meet in a variant do not grow with the square of the table: texts of other words never meet."""
    words = [[f"a{i}w{j}" for j in range(30)] for i in range(400)]
    words += [[*w[:10], "x", *w[11:]] for w in words[:3]]
    marks = [similar.signature(minhash.shingles([w.encode() for w in t], 5)) for t in words]
    meeting = [(i, j) for i in range(len(marks)) for j in range(i) if any(a == b for a, b in zip(marks[i][3:], marks[j][3:]))]
    assert 0 < len(meeting) and set(meeting) <= {(400 + i, i) for i in range(3)}
    assert all(m % (1 << 20) == 0 for row in marks for m in row[3:]) and len(set(marks[0][3:])) == 12
    assert similar.signature(minhash.shingles([], 5)) == []


def test_fingerprints_of_a_set():
    words = [f"w{i}".encode() for i in range(40)]
    hashes = minhash.shingles(words, 5)
    assert len(set(similar.prints(hashes))) == 3
    assert similar.prints(hashes) == similar.prints(hashes[::-1].copy())
    assert similar.prints(hashes[:0]) == []


def test_the_stage_takes_its_candidates_from_balls(spark, sf, monkeypatch):
    """Without colliding balls, only equal texts are found."""
    a = " ".join(f"w{i}" for i in range(100))
    b = f"{a} more words"
    assert jaccard(a, b) > 0.9
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([a, b, a.upper()])], KIND)
    ids = lambda: sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, sf).collect())
    assert ids() == [0]
    monkeypatch.setattr(similar, "links", lambda distinct, **kw: spark.createDataFrame([], "a bigint, b bigint"))
    assert ids() == [0, 1]


@pytest.mark.parametrize("words", [9, 20, 80, 400])
def test_similar_pairs_meet(words):
    """Of pairs at 0.8 and a little more, nearly all; chance is 0.997 where five shingles meet four and more elsewhere."""
    rng = random.Random(words)
    met = []
    while len(met) < 300:
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        b = a[:]
        if words < 20:
            b = b[:-1]
        else:
            at, n = rng.randrange(words), max(1, words // 50)
            for i in range(at, min(words, at + n * 2)):
                b[i] = f"x{rng.randrange(10**6)}"
        if 0.8 <= jaccard(" ".join(a), " ".join(b)):
            x, y = (similar.prints(minhash.shingles([w.encode() for w in t], 5)) for t in (a, b))
            met.append(meet(x, y))
    assert sum(met) >= 0.98 * len(met)


@pytest.mark.parametrize("words", [9, 20, 80, 400])
def test_similar_pairs_meet_by_their_marks(words):
    rng = random.Random(words)
    met = []
    while len(met) < 300:
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        b = a[:]
        if words < 20:
            b = b[:-1]
        else:
            at, n = rng.randrange(words), max(1, words // 50)
            for i in range(at, min(words, at + n * 2)):
                b[i] = f"x{rng.randrange(10**6)}"
        if 0.8 <= jaccard(" ".join(a), " ".join(b)):
            met.append(shared(*(similar.signature(minhash.shingles([w.encode() for w in t], 5)) for t in (a, b))))
    assert sum(met) >= 0.99 * len(met)


def test_classes_of_near_misses_whatever_the_tile(spark, monkeypatch):
    """Near misses that share most of a template, some linked: the classes of all pairs, whatever the tile's size."""
    rng = random.Random(9)
    template, rows = [f"t{i}" for i in range(120)], []
    for i in range(90):
        text = template[:]
        for at in rng.sample(range(120), rng.choice([1, 2, 6, 9])):
            text[at] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(text)))
    sets = [shingle_set(t) for _, t in rows]
    want = classes(range(90), [(i, j) for i in range(90) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8])
    assert 1 < len(want) < 90
    for tile in (1024, 7):
        monkeypatch.setattr(minhash, "TILE", tile)
        out = similar.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
        assert {r["doc_id"]: r["component"] for r in out.collect()} == {i: min(c) for c in want for i in c}, tile


def test_nulls_copies_and_repeats(spark):
    rows = [(5, None), (3, ""), (None, "x y"), (9, "long " * 5000), (9, "long " * 5000), (8, "LONG " * 5001), (4, "x  Y"), (None, "p q")]
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(5, 3), (3, 3), (None, 4), (9, 8), (9, 8), (8, 8), (4, 4), (None, None)]
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == sorted(want, key=str)
    assert similar.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
