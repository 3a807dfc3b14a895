import inspect

import pytest

from tidemark.streaming import sinks


class Slow:
    """A query that ends only when it is waited for without a limit."""

    stopped = False

    def awaitTermination(self, timeout=None):
        return None if timeout is None else False

    def stop(self):
        self.stopped = True


def test_a_long_stream_is_waited_for(spark, tmp_path, monkeypatch):
    spark.range(7).write.parquet(f"{tmp_path}/s/data")
    query = Slow()
    monkeypatch.setattr(sinks, "scratch_path", lambda spark, name: f"{tmp_path}/s")
    monkeypatch.setattr(sinks, "write_batches", lambda *a, **k: query)
    assert inspect.signature(sinks.run_to_table).parameters["timeout"].default is None
    assert sinks.run_to_table(spark.range(1)).count() == 7 and not query.stopped
    with pytest.raises(TimeoutError):
        sinks.run_to_table(spark.range(1), timeout=1)
    assert query.stopped
