"""Byte-level BPE by a pair occurrence index.

All pre-tokens of a slice that have not been seen yet are laid out as one symbol row.  The index maps each
mergeable pair to every position where it stands, the active ranks are applied in ascending order, each to all
of its positions at once, and the lists of the pairs that a merge touches are extended.  Finished pre-tokens
stay in a table per worker, which is emptied when it reaches ``keep`` entries (this never alters a result).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm.common import slices, texts

# fixed values: the pre-token pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# other texts are cut by the library's own splitter: its letters are those of one Unicode version
_GENERAL = ByteLevel(add_prefix_space=False, use_regex=True)
# the same pattern on texts of ASCII and Western letters, where the classes of re agree with those above
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
_WESTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary, as letter to byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pretokens(text: str) -> list[str]:
    if _PLAIN.match(text):
        return _WESTERN.findall(text)
    return [text[a:b] for _, (a, b) in _GENERAL.pre_tokenize_str(text)]


class PairIndex:
    """Encoder and decoder of one vocabulary file of the ``tokenizers`` library (byte-level BPE)."""

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            if letter in vocab:
                self.byte_id[byte] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.merge.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.keep = keep
        self.done: dict[str, bytes] = {}

    def _merge_all(self, words: list[str]) -> None:
        """Encode all ``words`` together and remember the result (little-endian 32-bit ids)."""
        sym: list[int] = [-1]
        starts = []
        byte_id, rank, merge = self.byte_id, self.rank, self.merge
        for w in words:
            starts.append(len(sym))
            sym += [byte_id[b] for b in w.encode("utf-8")]
            sym.append(-1)
        follow, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        where: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:])):
            r = rank.get(pair)
            if r is not None:
                where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, new = merge[r]
            for i in sorted(where.pop(r)):
                if sym[i] != left:
                    continue
                j = follow[i]
                if sym[j] != right:
                    continue
                k = follow[j]
                sym[i], sym[j] = new, -2
                follow[i], before[k] = k, i
                p = before[i]
                for at, pair in ((p, (sym[p], new)), (i, (new, sym[k]))):
                    q = rank.get(pair)
                    if q is not None:
                        if q in where:
                            where[q].append(at)
                        else:
                            where[q] = [at]
                            heapq.heappush(active, q)
        flat = np.array(sym, np.int64)
        alive = np.flatnonzero(flat != -2)
        ids = flat[alive].astype("<u4").tobytes()
        begin = np.searchsorted(alive, starts)
        end = np.append(begin[1:] - 1, len(alive) - 1)
        for w, b, e in zip(words, (begin * 4).tolist(), (end * 4).tolist()):
            self.done[w] = ids[b:e]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [self.splitter.split(t) if self.splitter and any(s in t for s in self.special) else [t] for t in batch]
        split = [[p if p in self.special else pretokens(p) for p in x] for x in parts]
        if len(self.done) > self.keep:
            self.done.clear()
        new = {w for x in split for p in x if not isinstance(p, str) for w in p}.difference(self.done)
        if new:
            self._merge_all(sorted(new))
        known = self.done.__getitem__
        return [b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(known, p)) for p in x) for x in split]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``, special tokens included; broken UTF-8 gives replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> PairIndex:
    return PairIndex(path)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[list[int]], list[str]]]:
    """(ids of documents, token ids, decoded texts) for bounded slices of (id, text) batches."""
    codec = load(path)
    for part in slices(batches, "text", 2 << 20):
        ids = [np.frombuffer(b, "<u4").tolist() for b in codec.encode(texts(part.column("text")))]
        yield part.column("id"), ids, [codec.decode(x) for x in ids]


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, ``ids`` (array of token ids) and ``decoded`` (the text decoded from them) per row.

    A null text counts as empty: no ids, empty decoded text.  Repeated rows stay repeated, an empty table gives
    an empty table, and further columns of ``df`` are not read.
    """

    def run(batches):
        for key, ids, decoded in encode_batches(batches, path):
            yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
