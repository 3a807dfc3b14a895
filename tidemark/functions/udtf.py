"""SQL surface: a table function that runs a detector over a partitioned, ordered table argument."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tidemark.operators.detect import detector


@arrow_udtf(returnType="key string, seq bigint, detector string, kind string, estimation double")
class DriftEvents:
    """drift_events(TABLE(t) PARTITION BY key ORDER BY (seq), 'ddm'): t has columns key, seq, x.

    A partition's rows pass in Arrow batches; only the machine's state is held between them.
    """

    def __init__(self):
        self.machine = self.state = self.key = self.name = None

    def eval(self, rows: pa.RecordBatch, name: pa.Array):
        if not rows.num_rows:
            return
        if self.machine is None:
            self.name, self.key = name[0].as_py(), rows.column("key")[0].as_py()
            self.machine = detector(self.name)
            self.state = self.machine.start()
        x = rows.column("x").cast(pa.float64()).to_numpy(zero_copy_only=False)
        self.state, out = self.machine.feed(self.state, {"x": x})
        at, kinds = np.asarray(out["row"], np.int64), [str(k) for k in out["kind"]]
        if len(at):
            yield pa.table({
                "key": pa.array([str(self.key)] * len(at)), "seq": rows.column("seq").cast(pa.int64()).take(pa.array(at)), "detector": pa.array([self.name] * len(at)),
                "kind": pa.array(kinds), "estimation": pa.array(np.asarray(out["estimation"], float))})


def register(spark: SparkSession) -> None:
    spark.udtf.register("drift_events", DriftEvents)
