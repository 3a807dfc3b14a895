import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm


def brute(docs, order, backoff=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[i - n + 1 : i + 1]) for w in words for i in range(len(w)) for n in range(1, order + 1) if i >= n - 1)
    total = sum(map(len, words))
    micro = lambda p: round(math.log10(p) * 1e6)

    def one(gram):
        if len(gram) == 1:
            return micro((count[gram] - 1) / (total - 1)) if count[gram] > 1 else micro(1 / total)
        if count[gram] > 1:
            return micro((count[gram] - 1) / (count[gram[:-1]] - 1))
        return micro(backoff) + one(gram[1:])

    return [(key, len(w), sum(one(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) / 1e6) for (key, _), w in zip(docs, words)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "dd", "é", "x" + str(rng.randint(0, 60))]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a a a " * 2000), (None, "a b"), (7, docs[7][1])]
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id bigint, text string, block int, gram string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], round(r["score"], 6)) for r in lm.score(frame, order=order, block=F.coalesce("doc_id", F.lit(0)) % 3).collect()), key=str)
    assert got == sorted(((k, n, round(s, 6)) for k, n, s in brute(docs, order)), key=str)
    by_default = sorted(((r["doc_id"], r["n_words"], round(r["score"], 6)) for r in lm.score(frame, order=order, bucket_chars=500).collect()), key=str)
    assert by_default == got
    assert lm.score(frame.limit(0), order=order).count() == 0


def test_packed_tables():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        gram, count = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2), rng.integers(1, 1 << 40, n)
        got = lm.unpack(*lm.pack(gram, count[: len(gram)]))
        assert (got[0] == gram).all() and (got[1] == count[: len(gram)]).all()


def test_partial_rows_of_a_block_add_up(spark, monkeypatch):
    docs = [(i, f"w{i % 5} w{i % 7} w{i % 3}") for i in range(50)]
    monkeypatch.setattr(lm, "FLUSH", 1)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["doc_id"]: round(r["score"], 6) for r in lm.score(frame).collect()}
    assert got == {k: round(s, 6) for k, _, s in brute(docs, 2)}
