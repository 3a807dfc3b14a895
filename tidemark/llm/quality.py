"""Quality of texts: a convolutional network over bytes, trained and applied in numpy.

Every byte has a small learned embedding; ``FILTERS`` learned filters look at ``WIDTH`` bytes in a row.  A text is cut into
chunks of two ``HALF``s, each overlapping the next by one, from its first byte to its last; a filter's answer for a chunk
is its largest over all positions in it.  A hidden layer reads the answers of a chunk, and the mean and the largest of
each hidden unit over all chunks give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices, utf8

WIDTH = 8
DEPTH = 4
FILTERS = 48
HALF = 64
HIDDEN = 24
PAD = 256
STRETCH = 1024


def layout(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte numbers with padding before each text, so no window reads two; first half of each text and the number of halves at the end)."""
    lengths = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-(lengths + WIDTH) // HALF))])
    codes = np.full(int(first[-1]) * HALF + WIDTH, PAD, np.uint16)
    for at, a, b in zip((first[:-1] * HALF + WIDTH).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        codes[at : at + b - a] = raw[a:b]
    return codes, first


def chunk_rows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left half, right half, first chunk of each text); a text of one half is one chunk of it."""
    n = int(first[-1])
    left, many = np.arange(n), np.diff(first) > 1
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    right = np.where(last, left, left + 1)
    keep = ~last
    keep[first[:-1][~many]] = True
    begin = np.concatenate([[0], np.cumsum(np.where(many, np.diff(first) - 1, 1))])[:-1]
    return left[keep], right[keep], begin


@dataclass
class Network:
    embed: np.ndarray = field(repr=False)  # 257 x DEPTH, the padding's row is zero
    filters: np.ndarray = field(repr=False)  # WIDTH * DEPTH x FILTERS
    offset: np.ndarray = field(repr=False)
    hidden: np.ndarray = field(repr=False)  # FILTERS x HIDDEN
    hidden_offset: np.ndarray = field(repr=False)
    out: np.ndarray = field(repr=False)  # mean weights, then largest weights
    out_offset: np.ndarray

    @classmethod
    def random(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        embed = draw(257, DEPTH, by=0.5)
        embed[PAD] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(embed, draw(WIDTH * DEPTH, FILTERS, by=0.3), zeros(FILTERS), draw(FILTERS, HIDDEN, by=0.2), zeros(HIDDEN), draw(2 * HIDDEN, by=0.2), zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.hidden, self.hidden_offset, self.out, self.out_offset]

    def answers(self, codes: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
        """Largest answer of each filter among the positions of each half (halves x FILTERS)."""
        n = (len(codes) - WIDTH) // HALF
        found = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, piece // HALF):
            b = min(n, a + piece // HALF)
            x = self.embed[codes[a * HALF : b * HALF + WIDTH]].ravel()
            rows, best = (b - a) * HALF // WIDTH, None
            for o in range(WIDTH):  # windows that start at o, o + WIDTH, ... are rows of one matrix
                got = x[o * DEPTH : (o + rows * WIDTH) * DEPTH].reshape(rows, WIDTH * DEPTH) @ self.filters
                best = got if best is None else np.maximum(best, got, out=best)
            found[a:b] = best.reshape(b - a, HALF // WIDTH, FILTERS).max(axis=1)
        return found

    def logits(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """One number for each text of a byte view."""
        codes, first = layout(offsets, raw)
        half = self.answers(codes)
        left, right, begin = chunk_rows(first)
        z = self.units(np.maximum(half[left], half[right]))
        n = np.diff(np.append(begin, len(z)))[:, None]
        both = np.concatenate([np.add.reduceat(z, begin) / n, np.maximum.reduceat(z, begin)], axis=1)
        return both.astype(float) @ self.out.astype(float) + float(self.out_offset[0])

    def units(self, most: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(most + self.offset, 0) @ self.hidden + self.hidden_offset, 0)

    def gradients(self, offsets: np.ndarray, raw: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss of texts and its derivative by each array of ``weights``."""
        codes, first = layout(offsets, raw)
        halves = int(first[-1])
        view = np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[: halves * HALF]
        x = self.embed[codes]
        every = np.empty((halves * HALF, FILTERS), np.float32)
        flat = x.ravel()
        for o in range(WIDTH):
            rows = halves * HALF // WIDTH
            every[o::WIDTH] = flat[o * DEPTH : (o + rows * WIDTH) * DEPTH].reshape(rows, WIDTH * DEPTH) @ self.filters
        every = every.reshape(halves, HALF, FILTERS)
        where = every.argmax(axis=1)
        half = np.take_along_axis(every, where[:, None], axis=1)[:, 0]
        where = where + np.arange(halves)[:, None] * HALF
        left, right, begin = chunk_rows(first)
        take = half[right] > half[left]
        most, at = np.where(take, half[right], half[left]), np.where(take, where[right], where[left])
        a = np.maximum(most + self.offset, 0)
        z = np.maximum(a @ self.hidden + self.hidden_offset, 0)
        count = np.diff(np.append(begin, len(z)))
        text = np.repeat(np.arange(len(count)), count)
        mean, top = np.add.reduceat(z, begin) / count[:, None], np.maximum.reduceat(z, begin)
        logit = np.concatenate([mean, top], axis=1) @ self.out + self.out_offset[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-np.mean(np.log(np.where(label == 1, p, 1 - p) + 1e-9)))
        g = ((p - label) / len(label)).astype(np.float32)
        d_out = np.concatenate([g @ mean, g @ top])
        is_top = (z == top[text]) & (z > 0)
        share = is_top / np.maximum(np.add.reduceat(is_top, begin, dtype=np.float32), 1)[text]  # ties share
        dz = g[text][:, None] * (self.out[:HIDDEN] / count[text][:, None] + self.out[HIDDEN:] * share)
        dz = np.where(z > 0, dz, 0).astype(np.float32)
        da = np.where(a > 0, dz @ self.hidden.T, 0)
        row, unit = np.nonzero(da)
        by, place = da[row, unit], at[row, unit]
        seen = view[place]  # codes under each window that won
        windows = x[place[:, None] + np.arange(WIDTH)].reshape(len(place), WIDTH * DEPTH) * by[:, None]
        order = np.argsort(unit, kind="stable")
        d_filters = np.zeros((FILTERS, WIDTH * DEPTH), np.float32)
        if len(order):
            present, start = np.unique(unit[order], return_index=True)
            d_filters[present] = np.add.reduceat(windows[order], start)
        back = (by[:, None] * self.filters.T[unit]).reshape(-1, DEPTH)
        d_embed = np.stack([np.bincount(seen.ravel(), back[:, j], minlength=257) for j in range(DEPTH)], axis=1).astype(np.float32)
        d_embed[PAD] = 0
        return loss, [d_embed, d_filters.T, da.sum(axis=0), a.T @ dz, dz.sum(axis=0), d_out, g.sum(keepdims=True)]


@dataclass
class Model:
    network: Network | None
    prior: float  # where only one label, or none, was seen

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.prior)
        logit = self.network.logits(*utf8(column))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def stretches(text: bytes, most: int) -> bytes:
    """The text, or parts of ``STRETCH`` bytes spread evenly over all of it that hold ``most`` bytes together."""
    if len(text) <= most:
        return text
    n = max(1, most // STRETCH)
    starts = [i * (len(text) - STRETCH) // max(1, n - 1) for i in range(n)]
    return b"".join(text[s : s + STRETCH] for s in starts)


def fit(
    df: DataFrame, *, text_col: str = "text", label_col: str = "quality", key: Column | None = None, most: int = 4000, most_bytes: int = 16 << 10,
    epochs: int = 12, batch: int = 32, rate: float = 0.004, seed: int = 3
) -> Model:
    """Train by Adam on a sample of about ``most`` rows with a label of 0 or 1, chosen by a hash of ``key`` (default: the text).

    A text longer than ``most_bytes`` is trained on ``STRETCH`` bytes at even distances over the whole of it, so the
    driver holds at most ``most * most_bytes`` bytes; scoring reads whole texts.  Null texts train as empty ones.
    """
    known = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), (F.col(text_col) if key is None else key).cast("string").alias("key"))
    known = bounded_sample(known.filter(F.col("label").isin(0, 1)), F.col("key"), most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [stretches(t or b"", most_bytes) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), part.column("label"), part.column("key")], ["text", "label", "key"])

    rows = known.mapInArrow(cut, "text binary, label int, key string").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["key"] or "", r["text"], r["label"]))
    labels = np.array([r["label"] for r in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(None, (float(labels.sum()) + 1) / (len(labels) + 2))
    network, rng = Network.random(seed), np.random.default_rng(seed)
    network.out_offset[0] = np.log(labels.mean() / (1 - labels.mean()))
    weights = network.weights()
    first, second, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            texts = [_part(rows[i]["text"], rng) for i in mine]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            _, grads = network.gradients(offsets, np.frombuffer(b"".join(texts), np.uint8), labels[mine])
            steps += 1
            step = rate * (1 - steps / (total + 1))
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= step * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-7)
    return Model(network, float(labels.mean()))


def _part(text: bytes, rng: np.random.Generator, most: int = 2048) -> bytes:
    """What one step reads of a training text: a stretch of it at random."""
    if len(text) <= most:
        return text
    at = int(rng.integers(0, len(text) - most + 1))
    return text[at : at + most]


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and score (probability of label 1) for each row of ``df``; whole texts are read.

    Null texts count as empty; an empty text is one chunk of padding and has a score like any other.  Without both
    labels to learn from, every row has the same score (the share of label 1, drawn to one half).
    """

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(part.column("text")), pa.float64())], ["id", "score"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
