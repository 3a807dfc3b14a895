import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import crc_fold
from tidemark.llm.queries import SPARK

LARGER = "/root/testdata/sf0.1"


def brute(network, text):
    """The network's number for one text: every window of every chunk, one by one."""
    data = [*[quality.PAD] * quality.WIDTH, *text.encode()]
    data += [quality.PAD] * (-len(data) % quality.HALF)
    halves, data = len(data) // quality.HALF, data + [quality.PAD] * quality.WIDTH
    answers = []
    for h in range(halves):
        windows = [np.concatenate([network.embed[b] for b in data[i : i + quality.WIDTH]]) @ network.filters for i in range(h * quality.HALF, (h + 1) * quality.HALF)]
        answers.append(np.max(windows, axis=0))
    chunks = [np.maximum(a, b) for a, b in zip(answers, answers[1:])] or answers
    units = [np.maximum(np.maximum(c + network.offset, 0) @ network.hidden + network.hidden_offset, 0) for c in chunks]
    return float(np.concatenate([np.mean(units, axis=0), np.max(units, axis=0)]) @ network.out + network.out_offset[0])


def bytes_of(texts):
    coded = [t.encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(c) for c in coded])]), np.frombuffer(b"".join(coded), np.uint8)


def network(seed=4):
    made = quality.Network.random(seed)
    made.offset[:], made.hidden_offset[:] = 0.1, 0.05
    return made


TEXTS = ["", "a", "short text", "x" * (quality.HALF - quality.WIDTH), "x" * (quality.HALF - quality.WIDTH + 1), "é ü " * 100, "some words and " * 90, "漢字 \0 " * 33]


def test_network_is_its_definition():
    net = network()
    got = net.logits(*bytes_of(TEXTS))
    assert np.allclose(got, [brute(net, t) for t in TEXTS], atol=1e-4)
    for i, t in enumerate(TEXTS):
        assert net.logits(*bytes_of([t]))[0] == pytest.approx(got[i], abs=1e-5)


def test_pieces_do_not_matter():
    net = network()
    codes, _ = quality.layout(*bytes_of(["many words " * 800]))
    assert np.allclose(net.answers(codes, piece=quality.HALF), net.answers(codes), atol=1e-5)


def test_gradients():
    net, label = network(), np.array([1, 0, 1, 0], np.float32)
    for name in ("embed", "filters", "offset", "hidden", "hidden_offset", "out", "out_offset"):
        setattr(net, name, getattr(net, name).astype(float))
    view = bytes_of(["hello world " * 30, "", "abc", "some other bytes 123 " * 20])
    _, grads = net.gradients(*view, label)
    rng = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads):
        for _ in range(5):
            at = tuple(int(rng.integers(0, s)) for s in w.shape) if w.shape[0] != 257 else (ord("o"), int(rng.integers(0, w.shape[1])))
            kept, ends = w[at], []
            for move in (1e-4, -1e-4):
                w[at] = kept + move
                ends.append(net.gradients(*view, label)[0])
            w[at] = kept
            assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[at], abs=3e-4)


def test_stretches_cover_the_whole_text():
    text = bytes(range(256)) * 400
    some = quality.stretches(text, 16 << 10)
    assert len(some) == 16 << 10 and some.startswith(text[:64]) and some.endswith(text[-64:])
    assert quality.stretches(b"short", 16 << 10) == b"short"


KIND = "doc_id bigint, text string, quality int, score string, id string"


def test_odd_rows(spark):
    rows = [(i, "clear words of a text " * (1 + i % 4), 1, "x", "y") for i in range(40)] + [(i, "%%% ### $$$ " * (1 + i % 4), 0, "x", "y") for i in range(40, 80)]
    odd = [(1, None, None, "x", "y"), (2, "", 7, "x", "y"), (None, "clear words " * 60_000, None, "x", "y"), (3, "%%% ### " * 9, None, None, None), (3, "%%% ### " * 9, None, None, None)]
    df = spark.createDataFrame(rows + odd, KIND).repartition(4)
    model = quality.fit(df, key=F.col("doc_id"), epochs=20)
    out = quality.score(df, model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[None] > 0.5 and by[45] < 0.5 and by[10] > 0.5
    assert quality.score(df.limit(0), model).count() == 0
    again = quality.fit(df.repartition(7), key=F.col("doc_id"), epochs=20)
    assert all((a == b).all() for a, b in zip(model.network.weights(), again.network.weights()))


def test_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "a", 1, "", "")] * 3 + [(2, None, None, "", "")], KIND)
    assert {r["score"] for r in quality.score(df, quality.fit(df)).collect()} == {0.8}
    assert {r["score"] for r in quality.score(df, quality.fit(df.limit(0))).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    out = SPARK["op11_quality"](spark, LARGER).collect()
    texts = spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert len(out) == texts and all(r["held_out"] == crc_fold(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(p for p, y in held if y) >= 0.99 * sum(y for _, y in held)
    assert sum(not p for p, y in held if not y) >= 0.85 * sum(not y for _, y in held)


def test_scores_of_a_column():
    model = quality.Model(network(), 0.5)
    got = model.scores(pa.array(["x", None, "words"]))
    assert got[1] == pytest.approx(model.scores(pa.array([""]))[0])
