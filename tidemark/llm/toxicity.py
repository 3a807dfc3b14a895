"""Toxicity by a weighted finite-state pattern grammar over clauses.

A token transducer rewrites words into symbols: INSULT and THREAT (with weights), TARGET, NEGATION, REPORT, BREAK and
OTHER.  Four small weighted machines read the symbols: abuse (emits the weight of an insult or threat), target
(raises it when a person is addressed in the clause), negation (lowers it shortly after a negator) and reported
speech (lowers it for the rest of the clause).  Their composition is built once as one table of states; a clause's
score is the weight that its path emits, and a document is scored from its matched clauses, never from single words.

The words and word beginnings of the token transducer are learned from labelled texts, on top of the small fixed
lists below; the map from clause weight to a probability is a logistic curve fitted on the same texts.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, slices, texts
from tidemark.session import materialize

INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, OTHER = range(7)

# fixed values: function words of the grammar in English, German, French and Spanish
TARGETS = "you your you're u he she they them him her his their du dich dir ihr euch sie ihn er tu toi te vous votre vos il elle ils eux tú ti usted ustedes vosotros él ella ellos"
NEGATIONS = "not never no none nobody isn't aren't wasn't don't doesn't didn't hardly kein keine keinen nicht nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna tampoco"
REPORTS = "said says say claimed claims quoted quote wrote writes reported reports allegedly according sagte sagt schrieb behauptete laut dit disait écrit selon prétend dijo dice escribió según"
THREATS = "kill hurt destroy shoot stab burn attack beat murder töten umbringen vernichten schlagen tuer détruire frapper brûler matar destruir golpear quemar"

EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha() and c != "'") + "…“”„«»¿¡–—"
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Machine:
    """A weighted machine over symbols: (state, symbol) to (state, factor); missing entries stay with factor 1."""

    states: int
    moves: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.moves.get((state, symbol), (state, 1.0))


def _abuse() -> Machine:
    weight = {INSULT: 1.0, THREAT: 1.0}
    return Machine(1, {(0, s): (0, weight.get(s, 0.0)) for s in range(7)})


def _target(bonus: float = 1.5) -> Machine:
    """State 1: someone was addressed in this clause."""
    moves = {(s, TARGET): (1, 1.0) for s in (0, 1)} | {(s, BREAK): (0, 1.0) for s in (0, 1)}
    # a threat without anyone it is aimed at is only a mention
    return Machine(2, moves | {(1, INSULT): (1, bonus), (1, THREAT): (1, bonus), (0, THREAT): (0, 0.4)})


def _negation(reach: int = 3, factor: float = 0.5) -> Machine:
    """State n: a negator holds for n more tokens."""
    moves = {(s, NEGATION): (reach, 1.0) for s in range(reach + 1)} | {(s, BREAK): (0, 1.0) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        moves |= {(s, x): (s - 1, 1.0) for x in (TARGET, REPORT, OTHER)} | {(s, x): (s - 1, factor) for x in (INSULT, THREAT)}
    return Machine(reach + 1, moves)


def _reported(factor: float = 0.6) -> Machine:
    moves = {(s, REPORT): (1, 1.0) for s in (0, 1)} | {(s, BREAK): (0, 1.0) for s in (0, 1)}
    return Machine(2, moves | {(1, INSULT): (1, factor), (1, THREAT): (1, factor)})


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[float]]]:
    """Product of the machines: next state and factor by state and symbol.  State 0 is the start of a clause."""
    names = list(itertools.product(*[range(m.states) for m in machines]))
    number = {n: i for i, n in enumerate(names)}
    follow, factor = [], []
    for name in names:
        moves = [[m.step(s, x) for m, s in zip(machines, name)] for x in range(7)]
        follow.append([number[tuple(s for s, _ in x)] for x in moves])
        factor.append([math.prod(f for _, f in x) for x in moves])
    return follow, factor


FOLLOW, FACTOR = compose(_abuse(), _target(), _negation(), _reported())


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 3.0
    offset: float = -1.5

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.offset))))


class Tokens:
    """The token transducer with a bounded table of words seen."""

    fixed = {w: s for s, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in group.split()}

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep = model, keep
        self.seen: dict[str, tuple[int, float, bool]] = {}

    def read(self, token: str) -> tuple[int, float, bool]:
        """(symbol, weight, whether a clause ends after it) of a lower-cased token with its punctuation."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            word = token.strip(EDGE)
            weight = max([self.model.words.get(word, 0.0), *(self.model.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
            symbol = INSULT if weight else self.fixed.get(word, OTHER)
            tail = token[len(token.rstrip(EDGE)) :]
            got = self.seen[token] = (symbol, weight or 1.0, any(c in ".!?;:|" for c in tail))
        return got

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(first token, end token, weight) of each clause that matched."""
        tokens = text.lower().split()
        read = self.read
        kinds = {t: read(t) for t in set(tokens)}
        if not any(k[0] <= THREAT for k in kinds.values()):
            return []
        found, state, weight, begin = [], 0, 0.0, 0
        for i, t in enumerate(tokens):
            symbol, own, ends = kinds[t]
            factor = FACTOR[state][symbol]
            if factor:
                weight += factor * own
            state = FOLLOW[state][symbol]
            if ends or i == len(tokens) - 1:
                if weight:
                    found.append((begin, i + 1, weight))
                state, weight, begin = FOLLOW[state][BREAK], 0.0, i + 1
        return found


def evidence(clauses: list[tuple[int, int, float]]) -> float:
    """One number for a document: the strongest clauses count most, many weak ones add slowly."""
    return math.log1p(sum(w for *_, w in clauses))


def signature(words: list[str], size: int = 5) -> int:
    """Smallest hash of the word shingles: equal for copies, and for most near copies."""
    spans = (words[i : i + size] for i in range(max(1, len(words) - size + 1)))
    return min(zlib.crc32(" ".join(s).encode("utf-8", "replace")) for s in spans)


def fit(df: DataFrame, *, text_col: str = "text", label_col: str = "toxic", key: Column | None = None, most: int = 16_000, entries: int = 2000) -> Model:
    """Learn words, word beginnings and the curve from about ``most`` rows with a label, chosen by a hash of ``key``.

    Near copies in the sample count once.  ``entries`` bounds the lexicon that reaches the driver and the tasks; the
    curve is fitted on a histogram of the evidence.
    """
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("label"), (F.xxhash64(text_col) if key is None else key).alias("key"))
    sample = materialize(bounded_sample(known, F.col("key"), most), "toxicity-sample")

    def signed(batches):
        for part in slices(batches, "text"):
            marks = [signature(t.lower().split()) for t in texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("label"), pa.array(marks, pa.int64())], ["text", "label", "mark"])

    sample = materialize(sample.select("text", "label").mapInArrow(signed, "text string, label int, mark bigint").dropDuplicates(["mark", "label"]), "toxicity-sample")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = size.get(0, 0), size.get(1, 0)

    def features(batches):
        count: Counter = Counter()
        for part in slices(batches, "text"):
            for text, label in zip(texts(part.column("text")), part.column("label").to_pylist()):
                words = {w.strip(EDGE) for w in text.lower().split()} - {""}
                count.update((w, False, label) for w in words if any(map(str.isalpha, w)))
                count.update((s, True, label) for s in {w[:n] for w in words for n in STEMS if len(w) >= n and w.isalpha()})
            if len(count) > 400_000:
                yield from counted(count)
                count.clear()
        yield from counted(count)

    def counted(count):
        if count:
            rows = [(w, stem, label, n) for (w, stem, label), n in count.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["term", "stem", "label", "n"])

    counts = sample.select("text", "label").mapInArrow(features, "term string, stem boolean, label bigint, n bigint")
    counts = counts.groupBy("term", "stem").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    support = max(3, round(0.01 * toxic))
    gain = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    # share of texts with the term that are toxic, and lift over the base rate
    chosen = counts.filter((F.col("t") >= support) & (F.col("t") >= 4 * F.col("c"))).withColumn("gain", gain).filter("gain > 2.5")
    top = chosen.orderBy(F.desc("t"), "term", "stem").limit(entries).collect()
    strongest = max([r["gain"] for r in top], default=1.0)
    model = Model({r["term"]: r["gain"] / strongest for r in top if not r["stem"]}, {r["term"]: r["gain"] / strongest for r in top if r["stem"]})

    def curve(batches):
        tokens = Tokens(model)
        for part in slices(batches, "text"):
            x = [round(evidence(tokens.clauses(t)) * 20) for t in texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), part.column("label")], ["x", "label"])

    bins = sample.select("text", "label").mapInArrow(curve, "x bigint, label int").groupBy("x", "label").count().collect()
    if clean and toxic:
        x, y, n = (np.array([float(r[c]) for r in bins]) for c in ("x", "label", "count"))
        model.slope, model.offset = _logistic(x / 20, y, n)
    elif bins:
        model.slope, model.offset = 0.0, 4.0 if toxic else -4.0
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and offset of a lightly penalised logistic curve, by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (n * (p - y)) + ridge * 0.01 * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge * 0.01 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, score (probability that the label is 1) and clauses (first token, end token, weight), per row.

    Null and empty texts have no clauses and the score of a text without matches.  Repeated rows stay repeated, an
    empty table gives an empty table, whole texts are read, and further columns of ``df`` are not.
    """

    def run(batches):
        tokens = Tokens(model)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
        for part in slices(batches, "text"):
            found = [tokens.clauses(t) for t in texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([model.probability(evidence(c)) for c in found], pa.float64()),
                 pa.array([[{"first": a, "end": b, "weight": w} for a, b, w in c] for c in found], kind)], ["id", "score", "clauses"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, score double, clauses array<struct<first:int,end:int,weight:double>>").withColumnRenamed("id", id_col)


def reject(df: DataFrame, model: Model, *, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """``df`` without the rows that score ``at`` or more; all columns stay, and rows without a text."""

    def run(batches):
        tokens = Tokens(model)
        for part in slices(batches, text_col):
            keep = [model.probability(evidence(tokens.clauses(t))) < at for t in texts(part.column(text_col))]
            yield part.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
