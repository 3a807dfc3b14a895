import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing
from tidemark.llm.queries import SPARK

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    None, "", " ", "   a  b\n\n c\t", "I'll they've it's'", "aaaa" * 50, "x" * 3000, "naïve café – 東京 ١٢٣ ²½ Ⅷ", "a\x1c\x1d\x1e\x1f\x85b c d",
    "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "😀👍🏽 é", "__init__ _a a_b 1_2", " " * 5000, "\n" * 999 + "a", "​﻿\x00\x07",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_ids_of_odd_texts(reference):
    got = bpe.PairIndex(PATH).encode([t or "" for t in ODD])
    for text, ids in zip(ODD, got):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode(text or "", add_special_tokens=False).ids, text


def test_every_class_of_character(reference):
    codec, fast = bpe.PairIndex(PATH), packing.token_ids(PATH)
    rng = random.Random(3)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    for i in range(0, len(points), 97):
        text = "".join(rng.choice(["", " ", "a", "1", "'s", "."]) + chr(c) for c in points[i : i + 97])
        want = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == want
        assert fast(text).tolist() == want


def test_cache_is_emptied_without_effect(reference):
    codec = bpe.PairIndex(PATH, keep=3)
    for text in ("one two three four five", "four five six", "one two"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_encode_operator(spark, reference):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(ODD)] + [(0, None, "a", "b"), (None, "same", "a", "b")]
    out = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id string"), PATH).collect()
    assert len(out) == len(rows)
    want = Counter((r[0], tuple(reference.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out) == want
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_query_against_library(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in SPARK["op2_bpe"](spark, sf).collect():
        ids = reference.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def fewest(sizes, capacity):
    """Fewest bins by trying every way."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + sizes[i] <= capacity}:
            k = bins.index(room)
            go(i + 1, bins[:k] + [room + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        count = Counter(sizes)
        fixed = packing.reduce_dominated(count, 20)
        rest = [s for s, n in count.items() for _ in range(n)]
        assert Counter(s for b, n in fixed for s in b * n) + Counter(rest) == Counter(sizes)
        assert all(sum(b) <= 20 for b, _ in fixed)
        assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)


def test_plan_of_many():
    rng = random.Random(1)
    lengths = {w: rng.randint(0, 10**9) for w in range(1, 2049)}
    bins = packing.plan(lengths, 2048)
    held = Counter()
    for b, n in bins:
        assert sum(b) <= 2048
        for s in b:
            held[s] += n
    assert held == Counter({w: n for w, n in lengths.items() if n})
    total = sum(w * n for w, n in lengths.items())
    assert sum(n for _, n in bins) <= 1.02 * total / 2048 + 1


def check(rows, docs, reference, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for key, parts in by_doc.items():
        ids = np.array([*reference.encode(docs[key] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for i, p in enumerate(sorted(parts, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (i, at)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert i == 0 or p["length"] == capacity
            at += p["length"]
        assert at == len(ids)
        assert len(parts) == -(-len(ids) // capacity)
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_small(spark, reference):
    docs = dict(enumerate(ODD))
    out = packing.pack(spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id bigint, text string, length int"), PATH, capacity=16).collect()
    check(out, docs, reference, 16)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_pack_query(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(SPARK["op10_packing"](spark, sf).collect(), docs, reference, 2048)
