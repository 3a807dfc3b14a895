"""The batch state machines on a stream: one state value per key in the state store."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

import tidemark
from tidemark.plans.keyed import Machine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class MachineProcessor(StatefulProcessor):
    """Feeds each micro-batch of a key to a machine in position order.

    Files give no order inside a micro-batch, so rows are sorted by position first.  A row at or before
    the last position already consumed is late: it is returned with ``late`` true and never learned.
    """

    def __init__(self, machine: Machine, keys: list[str], order: str, schema: T.StructType, key_names: list[str]):
        self.machine, self.keys, self.order, self.schema, self.key_names = machine, keys, order, schema, key_names

    def init(self, handle):
        self.value = handle.getValueState("machine", T.StructType([T.StructField("state", T.BinaryType()), T.StructField("last", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable").reset_index(drop=True)
        saved = self.value.get() if self.value.exists() else None
        state, last = (pickle.loads(saved[0]), int(saved[1])) if saved else (self.machine.start(), None)
        at = frame[self.order].to_numpy()
        late = np.zeros(len(frame), bool) if last is None else at <= last
        fresh = frame[~late].reset_index(drop=True)
        parts = []
        if len(fresh):
            state, out = self.machine.feed(state, {c: fresh[c].to_numpy() for c in self.machine.inputs})
            picked = fresh.iloc[np.asarray(out["row"], dtype=np.int64)]
            part = pd.DataFrame({self.order: picked[self.order].to_numpy()})
            for n, _ in self.machine.outputs:
                part[n] = list(out[n])
            part["late"] = False
            parts.append(part)
            self.value.update((cloudpickle.dumps(state), int(fresh[self.order].iloc[-1])))
        if late.any():
            parts.append(pd.DataFrame({self.order: at[late], "late": True}))
        for part in parts:
            if len(part):
                for name, v in zip(self.key_names, key):
                    part[name] = v
                blank = lambda n: pd.Series([None] * len(part), dtype=object)
                yield pd.DataFrame({f.name: part[f.name] if f.name in part else blank(f.name) for f in self.schema})

    def close(self):
        pass


def keyed_stream(df: DataFrame, keys: list[str], order: str, machine: Machine) -> DataFrame:
    """Run a machine over a streaming DataFrame; outputs (keys, order, machine outputs, late)."""
    use_rocksdb(df.sparkSession)
    rows = df.select(*dict.fromkeys([*keys, order, *machine.inputs]))
    schema = T.StructType(
        [rows.schema[c] for c in [*keys, order]]
        + [T.StructField(n, T._parse_datatype_string(t)) for n, t in machine.outputs] + [T.StructField("late", T.BooleanType())])
    processor = MachineProcessor(machine, keys, order, schema, list(keys))
    # Spark starts the query with a helper process that sees no shipped files, so the processor
    # travels by value
    cloudpickle.register_pickle_by_value(tidemark)
    try:
        return rows.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")
    finally:
        cloudpickle.unregister_pickle_by_value(tidemark)
