"""Queries that plant drift, audit tables for it, and catalogue drift variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit as AU
from tidemark.operators import inject as IN
from tidemark.queries import query
from tidemark.queries.base import EV, LI, events, lines, table, uniform_sql, with_
from tidemark.queries.metrics import nb_score_sql, nb_stats_sql
from tidemark.session import scratch_path
from tidemark.sources import catalog as C

DF = ["cents", "hr", "k"]


def inject_sql(config: IN.DriftConfig, chunk: int = 100, stats: str = "table") -> str:
    """The injected event table as SQL; draws are the same hashes, effects the fixed sizes."""
    st = IN.STRENGTHS[config.drift_type]
    s = config.severity
    idx = "(seq - 1)"
    if config.drift_type == "sudden":
        sev = f"CASE WHEN {idx} >= floor(n_rows * {config.position}) THEN {s} ELSE 0.0 END"
    elif config.drift_type == "gradual":
        lo, hi = f"floor(n_rows * {config.position - config.width / 2})", f"floor(n_rows * {config.position + config.width / 2})"
        sev = f"CASE WHEN {idx} < {lo} OR {idx} > {hi} THEN 0.0 ELSE {s} * ({idx} - {lo}) / ({hi} - {lo}) END"
    elif config.drift_type == "incremental":
        start = f"floor(n_rows * {config.position})"
        sev = f"CASE WHEN {idx} < {start} THEN 0.0 ELSE least({s}, {s} * ({idx} - {start} + 1) / (n_rows - {start})) END"
    else:
        sev = f"CASE WHEN ({idx} // (n_rows // {config.n_cycles})) % 2 = 1 THEN {s} ELSE 0.0 END"
    d = len(DF)
    least = max(1, int(d * st.min_share))
    most = max(least, int(d * s))
    part = "OVER ()" if stats == "table" else f"OVER (PARTITION BY {idx} // {chunk})"
    mom = ", ".join(f"avg({f}) {part} AS m{i}, stddev_pop({f}) {part} AS d{i}" for i, f in enumerate(DF))
    picks = ", ".join(f"{uniform_sql('chunk', repr(f'42:pick{i}'))} AS p{i}" for i in range(d))
    out = []
    for i, f in enumerate(DF):
        b = uniform_sql("chunk", repr(f"42:branch{i}"))
        z = f"sqrt(-2 * ln(greatest({uniform_sql('seq', repr(f'42:noise{i}:r'))}, 1e-12))) * cos(2 * pi() * {uniform_sql('seq', repr(f'42:noise{i}:a'))})"
        out.append(
            f"round(CASE WHEN sev > 0 AND p{i} <= cut THEN CASE WHEN {b} < {st.noise_share} THEN {f} + {z} * sev * {st.noise} "
            f"WHEN {b} < {st.noise_share + st.offset_share} THEN CASE WHEN d{i} > 0 THEN {f} + sev * d{i} * {st.offset} ELSE {f} END "
            f"ELSE CASE WHEN d{i} > 0 THEN ({f} - m{i}) * (1 + sev * {st.scale}) + m{i} ELSE {f} END END ELSE {f} END, 6) AS {f}")
    flip = f"sev * {st.flip}"
    return with_(EV, f"b AS (SELECT *, count(*) OVER () AS n_rows, {idx} // {chunk} AS chunk, {mom} FROM ev)",
                 f"c AS (SELECT *, {sev} AS sev, {picks}, {least} + CAST(floor({uniform_sql('chunk', repr('42:count'))} * {most - least + 1}) AS INT) AS cnt FROM b)",
                 f"t AS (SELECT *, list_sort([{', '.join(f'p{i}' for i in range(d))}])[cnt] AS cut FROM c)") + (
        f"SELECT event_id, {', '.join(out)}, round(sev, 8) AS severity, CASE WHEN sev > 0 AND {uniform_sql('seq', repr('42:flip'))} < {flip} THEN 1 - y ELSE y END AS y FROM t")


def injected(spark, sf, config, stats="table"):
    e = events(spark, sf)
    out = IN.inject_drift(e, config, features=DF, label="y", seq="seq", stats=stats)
    return out.select("event_id", *[F.round(f, 6).alias(f) for f in DF], F.round("severity", 8).alias("severity"), "y")


CONFIGS = {
    "inject_sudden": ("I1", IN.DriftConfig("sudden", 0.6, 0.5), "table"),
    "inject_sudden_chunk_stats": ("I1", IN.DriftConfig("sudden", 1.0, 0.25), "chunk"),
    "inject_gradual": ("I2", IN.DriftConfig("gradual", 0.6, 0.5, width=0.25), "table"),
    "inject_incremental": ("I3", IN.DriftConfig("incremental", 0.6, 0.25), "table"),
    "inject_recurring": ("I4", IN.DriftConfig("recurring", 0.6, 0.5, n_cycles=4), "table"),
}
for _name, (_id, _config, _stats) in CONFIGS.items():
    query(_name, _id, sql=inject_sql(_config, stats=_stats))(
        lambda spark, sf, _c=_config, _s=_stats: injected(spark, sf, _c, _s))


@query("predefined_configs_over_table", "I5", "G9", sql=with_(EV) + """SELECT drift_type, n, changed FROM (SELECT 'sudden' AS drift_type, n, n - n // 2 AS changed FROM (SELECT count(*) AS n FROM ev)
  UNION ALL SELECT 'gradual', n, CAST(floor(n * 0.6) - floor(n * 0.4) AS BIGINT) FROM (SELECT count(*) AS n FROM ev)
  UNION ALL SELECT 'incremental', n, n - CAST(floor(n * 0.3) AS BIGINT) FROM (SELECT count(*) AS n FROM ev)
  UNION ALL SELECT 'recurring', n, 2 * (n // 4) FROM (SELECT count(*) AS n FROM ev))""")
def _(spark, sf):
    e = events(spark, sf)
    out = None
    for c in IN.PREDEFINED:
        g = IN.inject_drift(e, c, features=DF, label="y", seq="seq").agg(
            F.count("*").alias("n"), F.count_if(F.col("severity") > 0).alias("changed")).withColumn("drift_type", F.lit(c.drift_type))
        out = g if out is None else out.unionByName(g)
    return out


WSQL = ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(DF))
PROFILE = f"""prof AS (SELECT window_id, n, (m0 + m1 + m2) / 3 AS feature_mean, (s0 + s1 + s2) / 3 AS feature_std, accuracy FROM (
  SELECT (seq - 1) // 500 AS window_id, count(*) AS n, {WSQL}, avg(CAST(y_sudden = CAST(cents > 4000 AS INT) AS INT)) AS accuracy FROM ev GROUP BY ALL) WHERE n = 500)"""


def profile(spark, sf):
    e = events(spark, sf)
    return AU.window_profile(e, DF, 500, hit=F.col("y_sudden") == (F.col("cents") > 4000).cast("int"))


@query("window_profile", "G7", sql=with_(EV, PROFILE) + "SELECT window_id, n, round(feature_mean, 6) AS feature_mean, round(feature_std, 6) AS feature_std, accuracy FROM prof")
def _(spark, sf):
    return profile(spark, sf).select("window_id", "n", F.round("feature_mean", 6).alias("feature_mean"), F.round("feature_std", 6).alias("feature_std"), "accuracy")


@query("window_labels", "G7", sql=with_(EV) + "SELECT window_id, label, n, n / sum(n) OVER (PARTITION BY window_id) AS share FROM (SELECT (seq - 1) // 500 AS window_id, event_type AS label, count(*) AS n FROM ev GROUP BY ALL)")
def _(spark, sf):
    return AU.window_labels(events(spark, sf), "event_type", 500)


POOL = """pool AS (SELECT {by} AS b, unnest([CAST(cents AS DOUBLE), hr, k]) AS v FROM {src})"""


@query("before_after", "G8", sql=with_(EV, POOL.format(by="seq < 5001", src="ev")) + """SELECT round(avg(v) FILTER (b), 4) AS before_mean, round(avg(v) FILTER (NOT b), 4) AS after_mean, round(stddev_pop(v) FILTER (b), 4) AS before_std, round(stddev_pop(v) FILTER (NOT b), 4) AS after_std,
  round(abs(avg(v) FILTER (NOT b) - avg(v) FILTER (b)), 4) AS mean_change, round(abs(stddev_pop(v) FILTER (NOT b) - stddev_pop(v) FILTER (b)), 4) AS std_change FROM pool""")
def _(spark, sf):
    out = AU.before_after(events(spark, sf), DF, 5001)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("compare_to_baseline", "G9", sql=with_(EV, POOL.format(by="event_type", src="ev")) + """SELECT b AS event_type, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(abs(avg(v) - (SELECT avg(v) FROM pool)), 4) AS mean_difference,
  round(abs(stddev_pop(v) - (SELECT stddev_pop(v) FROM pool)), 4) AS std_difference FROM pool GROUP BY b""")
def _(spark, sf):
    e = events(spark, sf)
    out = AU.compare_to_baseline(e, e, DF, "event_type")
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "std", "mean_difference", "std_difference")])


JUMPS = """ch AS (SELECT a.window_id, a.feature_mean - b.feature_mean AS mean_change, a.accuracy - b.accuracy AS accuracy_change FROM prof a JOIN prof b ON a.window_id = b.window_id + 1),
 j AS (SELECT *, (SELECT count(*) FROM ch) >= 2 AND abs(mean_change) > 2 * (SELECT stddev_pop(mean_change) FROM ch) AS mean_jump, (SELECT count(*) FROM ch) >= 2 AND accuracy_change < -0.1 AS accuracy_drop FROM ch)"""


@query("window_jumps", "W5", sql=with_(EV, PROFILE, JUMPS) + "SELECT window_id, round(mean_change, 6) AS mean_change, mean_jump, round(accuracy_change, 6) AS accuracy_change, accuracy_drop FROM j")
def _(spark, sf):
    j = AU.window_jumps(profile(spark, sf))
    return j.select("window_id", F.round("mean_change", 6).alias("mean_change"), "mean_jump", F.round("accuracy_change", 6).alias("accuracy_change"), "accuracy_drop")


@query("drift_verdict", "W5", "V1", sql=with_(EV, PROFILE, JUMPS) + "SELECT bool_or(mean_jump OR accuracy_drop) AS drift_detected, count(*) FILTER (mean_jump OR accuracy_drop) AS n_jumps FROM j")
def _(spark, sf):
    return AU.drift_verdict(AU.window_jumps(profile(spark, sf)))


VDF = ["cents", "k"]


@query("validate_drift", "V1", sql=with_(EV, f"tr AS (SELECT * FROM ev WHERE seq <= 1000)", f"st AS (SELECT DISTINCT {nb_stats_sql(VDF, [0, 1], 'y_sudden', '()')} FROM tr)",
       f"sc AS ({nb_score_sql('(SELECT ev.*, st.* FROM ev, st)', VDF, [0, 1])})") + "SELECT (seq - 1) // 500 AS window_id, avg(CAST(y_sudden = y_pred AS INT)) AS accuracy FROM sc GROUP BY ALL HAVING count(*) = 500")
def _(spark, sf):
    from tidemark.operators.validate import validate_drift

    profile_, _ = validate_drift(events(spark, sf), VDF, "y_sudden", [0, 1], window=500)
    return profile_.select("window_id", "accuracy")


@query("ks_windows", "D4b", sql=with_(EV, "w AS (SELECT (seq - 1) // 500 AS w, cents AS v FROM ev)", "full_w AS (SELECT w FROM w GROUP BY w HAVING count(*) = 500)",
       """pairs AS (SELECT f.w AS window_id, x.v, CAST(x.w = f.w AS INT) AS now FROM full_w f JOIN full_w g ON g.w = f.w - 1 JOIN w x ON x.w = f.w OR x.w = g.w)""") +
       """SELECT window_id, max(abs(a / 500.0 - b / 500.0)) AS ks FROM (SELECT window_id, sum(now) OVER q AS a, sum(1 - now) OVER q AS b FROM pairs WINDOW q AS (PARTITION BY window_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY window_id""")
def _(spark, sf):
    return AU.ks_windows(events(spark, sf), "cents", 500)


@query("mean_cut", "D6", sql=with_(EV, """c AS (SELECT user_id, seq, row_number() OVER p AS i, count(*) OVER (PARTITION BY user_id) AS n,
   (cents - min(cents) OVER (PARTITION BY user_id)) / CAST(max(cents) OVER (PARTITION BY user_id) - min(cents) OVER (PARTITION BY user_id) AS DOUBLE) AS a,
   (k - min(k) OVER (PARTITION BY user_id)) / CAST(max(k) OVER (PARTITION BY user_id) - min(k) OVER (PARTITION BY user_id) AS DOUBLE) AS b FROM ev WINDOW p AS (PARTITION BY user_id ORDER BY seq))""",
       """r AS (SELECT user_id, i, n, sum(a) OVER p AS ca, sum(b) OVER p AS cb, sum(a) OVER (PARTITION BY user_id) AS ta, sum(b) OVER (PARTITION BY user_id) AS tb FROM c WINDOW p AS (PARTITION BY user_id ORDER BY seq))""",
       """g AS (SELECT user_id, greatest(abs(ca / i - (ta - ca) / (n - i)), abs(cb / i - (tb - cb) / (n - i))) AS gap, sqrt((1.0 / i + 1.0 / (n - i)) / 2 * ln(4.0 * n / 0.05)) AS eps FROM r WHERE i < n)""") +
       "SELECT user_id, round(max(gap), 6) AS largest_gap, round(max(gap - eps), 6) AS largest_excess, bool_or(gap > eps) AS changed FROM g GROUP BY user_id")
def _(spark, sf):
    out = AU.mean_cut(events(spark, sf), ["user_id"], ["cents", "k"])
    return out.select("user_id", F.round("largest_gap", 6).alias("largest_gap"), F.round("largest_excess", 6).alias("largest_excess"), "changed")


@query("write_drifted", "S10", sql=with_(EV) + "SELECT 'events' AS dataset, 'sudden' AS drift_type, 'events_sudden_severity0.6_pos0.5_width0.1.csv' AS variant, count(*) AS n, sum(event_id) AS ids FROM ev")
def _(spark, sf):
    path = scratch_path(spark, "drifted")
    config = IN.PREDEFINED[0]
    C.write_drifted(IN.inject_drift(events(spark, sf), config, features=DF, label="y", seq="seq"), path, "events", config)
    return spark.read.parquet(path).groupBy("dataset", "drift_type", "variant").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("drift_catalog", "S11", sql="""SELECT 'part' || CAST(p_size % 5 AS VARCHAR) AS dataset, list_sort(list(DISTINCT CASE p_size % 4 WHEN 0 THEN 'sudden' WHEN 1 THEN 'gradual' WHEN 2 THEN 'incremental' ELSE 'recurring' END)) AS drift_types FROM part GROUP BY ALL""")
def _(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in IN.STRENGTHS]), (F.col("p_size") % 4 + 1).cast("int"))
    names = table(spark, sf, "part").select(F.concat(F.lit("/data/part"), F.col("p_size") % 5, F.lit("_"), kind, F.lit("_severity0.6_pos0.5_width0.1.csv")).alias("variant"))
    return C.drift_catalog(names)


@query("batch_inject", "S12", sql="""SELECT dataset, 2 AS n_success, 1 AS n_failed FROM (SELECT 'events' AS dataset UNION ALL SELECT 'lines')""")
def _(spark, sf):
    from tidemark.plans.scan import with_global_seq

    path = scratch_path(spark, "batch")
    e = events(spark, sf).select(F.col("cents").alias("a"), F.col("k").alias("b"), F.col("y").alias("label"), "seq")
    li = with_global_seq(lines(spark, sf).select(F.col("qty").alias("a"), F.col("disc").alias("b"), "label", "month", "rid"), ["month", "rid"])
    configs = [IN.PREDEFINED[0], IN.PREDEFINED[2], IN.DriftConfig("recurring", 0.6, 0.5, n_cycles=10**9)]
    status = C.batch_inject(spark, {"events": e, "lines": li}, configs, ["a", "b"], "label", "seq", path)
    return C.batch_summary(status)
