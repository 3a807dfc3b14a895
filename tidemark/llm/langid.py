"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is its lower-cased UTF-8 bytes; subwords are the byte n-grams of ``LENGTHS``, hashed into ``BUCKETS`` rows of an
embedding table.  The document vector is their mean, so the class scores are the mean of the rows of one folded table
(embeddings times output weights), which is what the tasks hold: its size does not depend on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, mix, slices, texts

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3, 4)
DIM = 12
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    return any(m.group()[0].isalpha() or any(map(str.isalpha, m.group())) for m in _LETTERS.finditer(text))


def subwords(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of every subword of the texts, one pair of arrays per length."""
    coded = [t.lower().encode("utf-8", "replace").replace(b"\0", b" ") for t in batch]
    data = np.frombuffer(b"\0\0\0".join(coded) + b"\0\0\0", np.uint8)
    doc = np.repeat(np.arange(len(coded)), [len(c) + 3 for c in coded])
    code = np.zeros(len(data), np.uint64)
    ok = np.ones(len(data), bool)
    for n in range(1, max(LENGTHS) + 1):
        shifted = data[n - 1 :]
        code = code[: len(shifted)] << np.uint64(8) | shifted
        ok = ok[: len(shifted)] & (shifted != 0)
        if n in LENGTHS:
            yield (mix(code[ok] + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int32), doc[: len(shifted)][ok]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: embeddings folded with the output weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # predictions below this calibrated probability are marked as not accepted

    def logits(self, batch: list[str]) -> np.ndarray:
        total, count = np.zeros((len(batch), len(self.labels))), np.zeros(len(batch))
        for bucket, doc in subwords(batch):
            if not len(doc):
                continue
            present, begin = np.unique(doc, return_index=True)
            total[present] += np.add.reduceat(self.table[bucket], begin, axis=0)
            count[present] += np.diff(np.append(begin, len(doc)))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, batch: list[str]) -> np.ndarray:
        return softmax(self.logits(batch) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def histograms(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Columns bucket (array), share (array: a subword's part of the text) and label, one row per text with subwords."""

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            rows, total = {}, np.zeros(part.num_rows)
            for bucket, doc in subwords(texts(part.column("text"))):
                both, n = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                for d in np.unique(both // BUCKETS):
                    at = slice(*np.searchsorted(both, [d * BUCKETS, (d + 1) * BUCKETS]))
                    rows.setdefault(int(d), []).append((both[at] % BUCKETS, n[at]))
                    total[d] += n[at].sum()
            keep = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.concatenate([b for b, _ in rows[d]]) for d in keep], pa.list_(pa.int32())),
                 pa.array([np.concatenate([n for _, n in rows[d]]) / total[d] for d in keep], pa.list_(pa.float32())),
                 part.column("label").take(pa.array(keep, pa.int64()))], ["bucket", "share", "label"])

    plain = df.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    return plain.mapInArrow(run, "bucket array<int>, share array<float>, label string")


def fit(
    df: DataFrame, *, text_col: str = "text", label_col: str = "lang", key: Column | None = None, most: int = 4000, epochs: int = 8,
    rate: float = 20.0, accept: float = 0.995, seed: int = 7
) -> Model:
    """Train on a sample of about ``most`` rows with a label, chosen by a hash of ``key`` (default: the text).

    Only the sample's subword shares reach the driver: at most ``most`` rows of at most ``BUCKETS`` numbers.  A fifth
    of it is kept from training; there the temperature is fitted and the probability is found under which a
    prediction counts as rejected, so that ``accept`` of the right ones are accepted.
    """
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    picked = bounded_sample(known, F.col(text_col) if key is None else key, most)
    rows = histograms(picked, text_col, label_col).toArrow()
    labels = sorted(set(rows.column("label").to_pylist()))
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    # views of the collected buffers, in an order that does not depend on the partitions
    data = []
    for batch in rows.combine_chunks().to_batches():
        buckets, shares = batch.column("bucket"), batch.column("share")
        bucket, share = buckets.flatten().to_numpy(), shares.flatten().to_numpy()
        ends = np.cumsum(buckets.value_lengths().to_numpy(zero_copy_only=False))
        for a, b, y in zip(np.concatenate([[0], ends[:-1]]), ends, batch.column("label").to_pylist()):
            data.append((bucket[a:b], share[a:b], labels.index(y)))
    data.sort(key=lambda r: (r[2], len(r[0]), r[0][:64].tolist(), r[1][:64].tolist()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept_back, train = order[: len(data) // 5], order[len(data) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(labels)))
    bias = np.zeros(len(labels))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            bucket, share, y = data[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ embed[bucket]
            error = softmax(mean @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= 0.05 * step * np.outer(mean, error)
            bias -= 0.001 * step * error
            np.subtract.at(embed, bucket, step * share[:, None] * back)
    model = Model(labels, embed @ out, bias)
    if len(kept_back):
        logits = np.array([data[i][1] @ model.table[data[i][0]] + bias for i in kept_back])
        y = np.array([data[i][2] for i in kept_back])
        grid = np.geomspace(0.05, 20, 120)
        loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        model.least = float(right[int((1 - accept) * len(right))]) if len(right) else 0.0
    return model


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, lang (a learned label), score (its calibrated probability) and accepted, per row of ``df``.

    Texts that are null or hold no letter (so also the empty text), and all texts where nothing could be learned, get
    ``und`` with score 0, not accepted.  Whole texts are read; ties go to the label that sorts first.
    """

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            batch = texts(part.column("text"))
            lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if model.labels:
                p = model.probabilities(batch)
                for i, t in enumerate(batch):
                    if has_letter(t):
                        best = int(p[i].argmax())
                        lang[i], score[i] = model.labels[best], p[i, best]
            accepted = [x != UNKNOWN and s >= model.least for x, s in zip(lang, score.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang), pa.array(score), pa.array(accepted)], ["id", "lang", "score", "accepted"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, lang string, score double, accepted boolean").withColumnRenamed("id", id_col)
