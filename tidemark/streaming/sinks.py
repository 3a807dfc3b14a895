"""Stream sinks that give the same table after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import scratch_path


def write_batches(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Each micro-batch replaces its own ``batch_id`` folder, so a repeated batch is not counted twice."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start())


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest batch's row per key of a table written by ``write_batches`` in update mode."""
    values = F.struct("batch_id", *[c for c in df.columns if c not in keys and c != "batch_id"])
    return df.groupBy(*keys).agg(F.max(values).alias("v")).select(*keys, "v.*").drop("batch_id")


def run_to_table(df: DataFrame, name: str = "stream", *, mode: str = "append", timeout: int | None = None) -> DataFrame:
    """Process everything available and return the written table, however long that takes.

    With ``timeout`` a query that does not end within so many seconds is stopped and reported.
    """
    spark = df.sparkSession
    root = scratch_path(spark, name)
    query = write_batches(df, f"{root}/data", f"{root}/checkpoint", mode=mode)
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream {name} did not finish within {timeout} s")
    return spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
