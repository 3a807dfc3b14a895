"""Sequential state machines, one per key, without loading a key's history at once.

Rows are shuffled by key, sorted by position, and fed to the machine in Arrow batches, with the
state carried from batch to batch, so memory does not grow with a key's rows.  The order of a
sequential rule cannot be parallelised inside one key: choose keys that grow with the data, or the
chunked (additive) operators where one stream must be spread.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize


class Machine:
    """What a sequential operator provides.

    ``start()`` gives a picklable state.  ``feed(state, cols)`` consumes a run of consecutive rows
    of one key (numpy columns) and returns (state, outputs): ``outputs`` is a dict of arrays with
    ``"row"`` holding the positions in the run each output belongs to.
    """

    inputs: tuple[str, ...] = ()
    outputs: tuple[tuple[str, str], ...] = ()

    def start(self):
        raise NotImplementedError

    def feed(self, state, cols: dict[str, np.ndarray]):
        raise NotImplementedError


def _runner(machine: Machine, keys: list[str], order: str, keep: list[str]):
    names = [n for n, _ in machine.outputs]
    carried_over = [*keys, order, *keep]

    def run(batches):
        current, state = None, None
        for frame in batches:
            if frame.empty:
                continue
            cols = {c: frame[c].to_numpy() for c in dict.fromkeys([*keys, *machine.inputs])}
            picked, outs = [], {n: [] for n in names}
            edges = _edges([cols[k] for k in keys], len(frame))
            for lo, hi in zip(edges[:-1], edges[1:]):
                key = tuple(None if pd.isna(cols[k][lo]) else cols[k][lo] for k in keys)
                if key != current:
                    current, state = key, machine.start()
                state, out = machine.feed(state, {c: cols[c][lo:hi] for c in machine.inputs})
                rows = np.asarray(out["row"], dtype=np.int64)
                if len(rows):
                    picked.append(rows + lo)
                    for n in names:
                        outs[n].append(out[n])
            if picked:
                result = frame[carried_over].iloc[np.concatenate(picked)].reset_index(drop=True)
                for n in names:
                    result[n] = _joined(outs[n])
                yield result

    return run


def _edges(keys: list[np.ndarray], n: int) -> list[int]:
    """Positions where any key column changes, with both ends."""
    change = np.zeros(n, dtype=bool)
    for v in keys:
        both_missing = pd.isna(v[1:]) & pd.isna(v[:-1])
        change[1:] |= (v[1:] != v[:-1]) & ~both_missing
    return [0, *np.flatnonzero(change).tolist(), n]


def _joined(parts: list):
    """One column from the outputs of many keys; array-valued outputs stay lists."""
    if all(isinstance(p, np.ndarray) for p in parts):
        return np.concatenate(parts)
    return [v for p in parts for v in p]


def keyed_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    machine: Machine,
    *,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``machine`` over each key in ``order`` and return the rows it emits."""
    if not keys:
        raise ValueError("a sequential operator needs key columns; aggregate to chunks for a single stream")
    keep = [c for c in keep if c not in keys and c != order]
    wanted = list(dict.fromkeys([*keys, order, *machine.inputs, *keep]))
    narrow = df.select(*wanted)
    out = T.StructType(
        [narrow.schema[c] for c in [*keys, order, *keep]]
        + [T.StructField(n, T._parse_datatype_string(t)) for n, t in machine.outputs]
    )
    ready = narrow.repartition(*keys).sortWithinPartitions(*keys, order)
    return ready.mapInPandas(_conform(_runner(machine, keys, order, keep), out), out)


def keyed_resume(
    df: DataFrame, keys: list[str], order: str, machine: Machine, states: DataFrame | None, *, keep: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows that the machine emits, states after them): a scan that goes on where an earlier one ended.

    ``states`` is what the earlier call returned (None for the start).  A key's state meets its rows as one more
    row sorted first, and leaves as one more row after them; keys without new rows keep theirs.
    """
    if not keys:
        raise ValueError("a sequential operator needs key columns; aggregate to chunks for a single stream")
    keep = [c for c in keep if c not in keys and c != order]
    narrow = df.select(*dict.fromkeys([*keys, order, *machine.inputs, *keep]), F.lit(None).cast("binary").alias("__state"))
    if states is not None:
        narrow = narrow.unionByName(states.select(*keys, "__state"), allowMissingColumns=True)
    out = T.StructType(
        [narrow.schema[c] for c in [*keys, order, *keep]]
        + [T.StructField(n, T._parse_datatype_string(t)) for n, t in machine.outputs] + [T.StructField("__state", T.BinaryType())])
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out])
    names = [n for n, _ in machine.outputs]

    def run(batches):
        current, state = None, None

        def left():
            return pd.DataFrame({**{k: [v] for k, v in zip(keys, current)}, "__state": [pickle.dumps(state)]})

        for frame in batches:
            if frame.empty:
                continue
            cols = {c: frame[c].to_numpy() for c in dict.fromkeys([*keys, *machine.inputs])}
            saved = frame["__state"].to_numpy()
            edges = _edges([cols[k] for k in keys], len(frame))
            for lo, hi in zip(edges[:-1], edges[1:]):
                key = tuple(None if pd.isna(cols[k][lo]) else cols[k][lo] for k in keys)
                if key != current:
                    if current is not None:
                        yield left()
                    current, state = key, machine.start()
                if saved[lo] is not None:  # written by this function in an earlier call
                    state, lo = pickle.loads(saved[lo]), lo + 1
                if lo == hi:
                    continue
                state, found = machine.feed(state, {c: cols[c][lo:hi] for c in machine.inputs})
                rows = np.asarray(found["row"], dtype=np.int64)
                if len(rows):
                    part = frame[[*keys, order, *keep]].iloc[rows + lo].reset_index(drop=True)
                    for n in names:
                        part[n] = found[n]
                    yield part
        if current is not None:
            yield left()

    ready = narrow.repartition(*keys).sortWithinPartitions(*keys, F.col("__state").isNull(), order)
    both = materialize(ready.mapInPandas(_conform(run, out), out), "resumed")
    return both.filter("__state IS NULL").drop("__state"), both.filter("__state IS NOT NULL").select(*keys, "__state")


def _conform(run, schema: T.StructType):
    names = [f.name for f in schema]

    def wrapped(batches):
        for frame in run(batches):
            yield pd.DataFrame({n: frame[n] if n in frame else pd.Series([None] * len(frame), dtype=object) for n in names})

    return wrapped
