"""Streaming queries: each runs to completion over the whole event table in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import udtf as UT
from tidemark.functions.arrays import range_margin
from tidemark.operators import detect as D
from tidemark.operators import select as Q
from tidemark.queries import query
from tidemark.queries.base import EV, SCORED, events, fold_sql, recursive, scored, table
from tidemark.queries.detectors import DENSE, ERR, KIND, VALUE, ddm_fold, eddm_fold, ph_fold
from tidemark.session import scratch_path
from tidemark.streaming.keyed_state import keyed_stream
from tidemark.streaming.sinks import latest_per_key, run_to_table
from tidemark.streaming.sources import stream_source
from tidemark.streaming.windows import windowed_stream_metrics


ROWS_PER_FILE = 250_000


def as_stream(df, order: str, parts: int = 3):
    """The whole table as a stream of ``parts`` batches in position order, in files of about ``ROWS_PER_FILE`` rows (four at least)."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream-in")
    hi = df.agg(F.max(order)).first()[0]
    step = -(-hi // parts)
    files = max(4, -(-step // ROWS_PER_FILE))
    for i in range(parts):
        df.filter(F.expr(f"(`{order}` - 1) div {step} = {i}")).repartition(files).write.mode("append").parquet(path)
    return stream_source(spark, path, df.schema, files_per_trigger=files)


def _detect(spark, sf, x, machine, key):
    e = events(spark, sf).select("user_id", "hr", "seq", x.cast("double").alias("x"))
    out = run_to_table(keyed_stream(as_stream(e, "seq"), [key], "seq", machine), "detect")
    return out.filter(~F.col("late")).select(key, "seq", "kind", F.round("estimation", 6).alias("estimation"))


@query("stream_ddm", "D1", "S4", "E2", sql=recursive(EV, ddm_fold(ERR, "user_id")) + f"SELECT user_id, seq, {KIND}, round(p, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    return _detect(spark, sf, F.col("y"), D.Ddm(), "user_id")


@query("stream_eddm", "D2", sql=recursive(EV, eddm_fold(DENSE, "user_id")) + f"SELECT user_id, seq, {KIND}, round(mean, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    return _detect(spark, sf, F.col("k") < 60, D.Eddm(), "user_id")


@query("stream_page_hinkley", "D3", sql=recursive(EV, ph_fold(VALUE, "user_id")) + "SELECT user_id, seq, 'change' AS kind, round(mean, 6) AS estimation FROM f WHERE rn > 0 AND chg")
def _(spark, sf):
    return _detect(spark, sf, F.col("k"), D.PageHinkley(), "user_id")


@query("stream_kswin", "D4")
def _(spark, sf):
    return _detect(spark, sf, F.col("k") + F.when(F.col("dow") > 4, 40).otherwise(0), D.Kswin(window=40, stat=15), "user_id")


@query("stream_margin_variable", "Q3", sql=recursive(EV, SCORED, fold_sql(
  source="SELECT user_id, seq, list_max(proba) - list_min(proba) AS m FROM scored", key="user_id", order="seq", cols=["m"], state={"theta": "CAST(0.47 AS DOUBLE)", "used": "CAST(0 AS DOUBLE)", "ask": "false"},
  steps=[{"ask": "m < theta", "used": "theta"}, {"theta": "CASE WHEN ask THEN theta * (1 - 0.01::DOUBLE) ELSE theta * (1 + 0.01::DOUBLE) END"}])) +
  "SELECT user_id, seq, ask AS is_queried, round(used, 6) AS threshold FROM f WHERE rn > 0")
def _(spark, sf):
    s = scored(spark, sf).select("user_id", "seq", range_margin(F.col("proba")).alias("margin"))
    out = run_to_table(keyed_stream(as_stream(s, "seq"), ["user_id"], "seq", Q.MarginVariable(0.47)), "margin")
    return out.filter(~F.col("late")).select("user_id", "seq", "is_queried", F.round("threshold", 6).alias("threshold"))


HIT = "CAST((value > 40) = (event_type = 'view') AS INT)"


def _hits(df):
    return (F.col("value") > 40) == (F.col("event_type") == "view")


@query("window_tumbling", "E1", sql=f"SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS \"start\", time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, avg({HIT}) AS accuracy FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    out = windowed_stream_metrics(e, "ts", _hits(e), by=["event_type"], size="6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("window_sliding", "E1", sql=f"SELECT time_bucket(INTERVAL 6 HOUR, ts) - o * INTERVAL 6 HOUR AS \"start\", time_bucket(INTERVAL 6 HOUR, ts) - o * INTERVAL 6 HOUR + INTERVAL 12 HOUR AS \"end\", count(*) AS n, avg({HIT}) AS accuracy FROM events, (VALUES (0), (1)) v(o) GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    out = windowed_stream_metrics(e, "ts", _hits(e), size="12 hours", slide="6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("window_session", "E1", sql=f"""SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, avg({HIT}) AS accuracy FROM (
  SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS gap FROM events)) GROUP BY user_id, s""")
def _(spark, sf):
    e = table(spark, sf, "events")
    out = windowed_stream_metrics(e, "ts", _hits(e), by=["user_id"], session_gap="2 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_window_metrics", "E1", "E2", "S4", sql=f"SELECT time_bucket(INTERVAL 6 HOUR, ts) AS \"start\", time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n, avg({HIT}) AS accuracy FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("seq", F.col("event_id") + 1).withColumn("ts", F.col("ts").cast("timestamp"))
    s = as_stream(e, "seq")
    out = run_to_table(windowed_stream_metrics(s, "ts", _hits(s), size="6 hours", watermark="1 hour"), "windows", mode="update")
    latest = latest_per_key(out, ["start", "end"])
    return latest.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("sql_drift_events", "UDTF", "D1", sql=recursive(EV, ddm_fold(ERR, "user_id")) + f"SELECT CAST(user_id AS VARCHAR) AS key, seq, 'ddm' AS detector, {KIND}, round(p, 6) AS estimation FROM f WHERE rn > 0 AND (chg OR wrn)")
def _(spark, sf):
    UT.register(spark)
    events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "seq", F.col("y").alias("x")).createOrReplaceTempView("tidemark_errors")
    return spark.sql(
        "SELECT key, seq, detector, kind, round(estimation, 6) AS estimation "
        "FROM drift_events(TABLE(tidemark_errors) PARTITION BY key ORDER BY (seq), 'ddm')")
