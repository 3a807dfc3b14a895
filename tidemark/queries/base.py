"""Input frames shared by the registered queries, and the same frames as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import hash_uniform


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed binary stream: y marks error events, y_sudden is a planted concept that flips mid-month."""
    high = F.col("value") > 40
    before = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        "user_id",
        "event_id",
        (F.col("event_id") + 1).alias("seq"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.hour("ts").alias("hr"),
        F.dayofweek("ts").alias("dow"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(before == high, 1).otherwise(0).alias("y_sudden"),
        "event_type",
    )


EV = """ev AS (
  SELECT user_id, event_id, event_id + 1 AS seq, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(event_type = 'error' AS INT) AS y, CAST(hour(ts) AS INT) AS hr,
         CAST(dayofweek(ts) + 1 AS INT) AS dow, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CASE WHEN (ts < TIMESTAMP '2024-01-16') = (value > 40) THEN 1 ELSE 0 END AS y_sudden,
         event_type
  FROM events)"""

CLASSES = ["click", "error", "purchase", "signup", "view"]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long prediction table of two methods over three rounds, right for a hashed share of rows."""
    e = table(spark, sf, "events")
    truth = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("event_type")).cast("int") - 1
    runs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("method"), F.lit(r).alias("round")) for m in ("nb", "ridge") for r in (0, 1, 2)])
    )
    p = e.select("event_id", truth.alias("y_true"), runs.alias("run")).select(
        F.col("run.method").alias("method"), F.col("run.round").alias("round"),
        (F.col("event_id") + 1).alias("seq"), "y_true", "event_id",
    )
    u = hash_uniform(F.col("event_id"), F.concat(F.col("method"), F.col("round").cast("string")))
    right = F.when(F.col("method") == "nb", F.lit(0.6)).otherwise(F.lit(0.7))
    wrong = (F.col("y_true") + 1 + F.floor(u * 16) % 4) % 5
    return p.withColumn("y_pred", F.when(u < right, F.col("y_true")).otherwise(wrong).cast("int")).drop("event_id")


PRED = """pred0 AS (
  SELECT e.event_id, list_position(['click','error','purchase','signup','view'], e.event_type) - 1 AS y_true,
         m.method, r.round,
         (('0x' || substr(md5(CAST(e.event_id AS VARCHAR) || ':' || m.method || CAST(r.round AS VARCHAR)), 1, 8))::BIGINT) / 4294967296.0 AS u
  FROM events e, (VALUES ('nb'), ('ridge')) m(method), (VALUES (0), (1), (2)) r(round)),
pred AS (
  SELECT method, round, event_id + 1 AS seq, CAST(y_true AS INT) AS y_true,
         CAST(CASE WHEN u < CASE method WHEN 'nb' THEN 0.6 ELSE 0.7 END THEN y_true
              ELSE (y_true + 1 + CAST(floor(u * 16) AS BIGINT) % 4) % 5 END AS INT) AS y_pred
  FROM pred0)"""


def uniform_sql(ident: str, salt: str) -> str:
    """SQL text of the hashed uniform draw; ``salt`` is itself SQL text."""
    return f"((('0x' || substr(md5(CAST({ident} AS VARCHAR) || ':' || {salt}), 1, 8))::BIGINT) / 4294967296.0)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a planted three-class concept, a planted regression target and ship month."""
    li = table(spark, sf, "lineitem").drop("l_linestatus")
    ident = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    price = F.col("l_quantity") * (100 - F.round(F.col("l_discount") * 100))
    noisy = hash_uniform(F.col("rid"), "label")
    return (
        li.select(
            ident.alias("rid"),
            F.col("l_quantity").alias("qty"),
            F.round(F.col("l_discount") * 100).alias("disc"),
            F.round(F.col("l_tax") * 100).alias("tax"),
            F.round(F.col("l_extendedprice")).alias("price"),
            ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint").alias("month"),
            price.alias("net"),
            "l_returnflag",
        )
        .withColumn(
            "label",
            F.when(noisy < 0.1, F.floor(noisy * 30)).when(F.col("net") < 1600, 0).when(F.col("net") < 3200, 1).otherwise(2).cast("int"),
        )
        .withColumn("target", 3 * F.col("qty") - 2 * F.col("disc") + 0.5 * F.col("tax") + F.floor(hash_uniform(F.col("rid"), "noise") * 10))
        .withColumn("label", F.col("label").cast("int"))
    )


LI = f"""li0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
         CAST(l_linenumber AS VARCHAR) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS rid,
         l_quantity AS qty, round(l_discount * 100) AS disc, round(l_tax * 100) AS tax, round(l_extendedprice) AS price,
         CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS BIGINT) AS month,
         l_quantity * (100 - round(l_discount * 100)) AS net, l_returnflag
  FROM lineitem),
li1 AS (SELECT *, {uniform_sql('rid', "'label'")} AS ul, {uniform_sql('rid', "'noise'")} AS un FROM li0),
li AS (
  SELECT rid, qty, disc, tax, price, month, net, l_returnflag,
         CAST(CASE WHEN ul < 0.1 THEN floor(ul * 30) WHEN net < 1600 THEN 0 WHEN net < 3200 THEN 1 ELSE 2 END AS INT) AS label,
         3 * qty - 2 * disc + 0.5 * tax + floor(un * 10) AS target
  FROM li1)"""


def vectors(spark: SparkSession, sf: str, dims: int | None = None) -> DataFrame:
    """Embeddings as double features with a planted three-class concept on the first components."""
    feats = F.col("embedding").cast("array<double>")
    d = table(spark, sf, "embeddings").select(
        F.col("vec_id"), (F.col("vec_id") + 1).alias("seq"), feats.alias("features"), F.col("label").alias("digit")
    )
    top = F.slice("features", 1, 3)
    d = d.withColumn("label", (F.array_position(top, F.array_max(top)) - 1).cast("int"))
    return d.withColumn("features", F.slice("features", 1, dims)) if dims else d


VEC = """vec AS (
  SELECT vec_id, vec_id + 1 AS seq, CAST(embedding AS DOUBLE[]) AS features, label AS digit,
         CAST(list_position(CAST(embedding[1:3] AS DOUBLE[]), list_max(CAST(embedding[1:3] AS DOUBLE[]))) - 1 AS INT) AS label
  FROM embeddings)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric document features over whole texts, an imbalanced planted label, and given labels where known."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    t = F.col("text")
    return d.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, " ", ""))).cast("bigint").alias("n_spaces"),
        (F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))).cast("bigint").alias("n_digits"),
        "lang", "source",
    ).join(lab, "doc_id", "left")


DOC = """doc AS (
  SELECT d.doc_id, CAST(d.n_chars AS BIGINT) AS n_chars,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) AS BIGINT) AS n_spaces,
         CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS BIGINT) AS n_digits,
         d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def with_(*parts: str) -> str:
    """``WITH`` clause from fragments."""
    return "WITH " + ",\n".join(parts) + "\n"


def fold_sql(
    *, source: str, key: str, order: str, cols: list[str], state: dict[str, str], steps: list[dict[str, str]], tag: str = ""
) -> str:
    """Recursive SQL that runs a per-key state machine one position at a time.

    ``state`` gives initial values; each element of ``steps`` is a layer of named expressions over
    the state and input columns (a name assigned in a layer replaces it in later layers).  The
    result ``f{tag}`` has key, rn (0 is the start row), order value, inputs and all state columns.
    """
    names = list(state)
    f, src = f"f{tag}", f"src{tag}"
    layer = (
        f"SELECT {f}.{key} AS {key}, {f}.rn + 1 AS rn, s.{order} AS {order}, "
        + ", ".join([f"s.{c} AS {c}" for c in cols] + [f"{f}.{n} AS {n}" for n in names])
        + f" FROM {f} JOIN {src} s ON s.{key} = {f}.{key} AND s.rn = {f}.rn + 1"
    )
    have = [key, "rn", order, *cols, *names]
    for i, exprs in enumerate(steps):
        kept = [h for h in have if h not in exprs]
        layer = "SELECT " + ", ".join(kept + [f"{e} AS {n}" for n, e in exprs.items()]) + f" FROM ({layer}) q{i}"
        have = kept + list(exprs)
    out = [key, "rn", order, *cols, *names]
    return (
        f"{src} AS (SELECT {key}, {order}, {', '.join(cols)}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({source}) z),\n"
        f"{f} AS (SELECT {key}, CAST(0 AS BIGINT) AS rn, min({order}) AS {order}, "
        + ", ".join([f"any_value({c}) AS {c}" for c in cols] + [f"{v} AS {n}" for n, v in state.items()])
        + f" FROM {src} GROUP BY {key}\nUNION ALL SELECT {', '.join(out)} FROM ({layer}) step)"
    )


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events with hashed three-class probabilities and a three-class label."""
    e = events(spark, sf).withColumn("label", (F.col("k") % 3).cast("int"))
    u = F.array(*[hash_uniform(F.col("event_id"), f"class{i}") for i in range(3)])
    total = F.get("u", F.lit(0)) + F.get("u", F.lit(1)) + F.get("u", F.lit(2))
    return e.withColumn("u", u).withColumn("proba", F.array(*[F.get("u", F.lit(i)) / total for i in range(3)])).drop("u")


SCORED = f"""scored AS (SELECT *, [u0 / (u0 + u1 + u2), u1 / (u0 + u1 + u2), u2 / (u0 + u1 + u2)] AS proba FROM (
  SELECT *, CAST(k % 3 AS INT) AS label, {", ".join(f"{uniform_sql('event_id', repr(f'class{i}'))} AS u{i}" for i in range(3))} FROM ev) z)"""
