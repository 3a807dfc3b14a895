"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, langid, lm, merkle, packing, pii, quality, simhash, substrings, toxicity, voronoi, whitening
from tidemark.llm.common import bounded_sample, held_out
from tidemark.session import materialize, ship

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        SPARK[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Encode and decode every text; digests are taken of the operator's ids and texts in the same task."""
    path = vocabulary()

    def run(batches):
        number = [str(i) for i in range(1 << 16)]
        for key, ids, decoded in bpe.encode_batches(batches, path):
            yield pa.RecordBatch.from_arrays(
                [key, pa.array([len(x) for x in ids], pa.int64()), pa.array([_sha(",".join(map(number.__getitem__, x))) for x in ids]),
                 pa.array([_sha(t) for t in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf, "documents"), vocabulary(), capacity=2048, end_id=0)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of 4-word shingles and connected classes at 4 bits."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), radius=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def toxicity_model(documents: DataFrame, labels: DataFrame, most: int = 16_000) -> toxicity.Model:
    """Trained on at most about ``most`` of the labelled rows outside the held-out fold."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("key"), "toxic")
    picked = F.broadcast(bounded_sample(known, F.col("key"), most))  # an id and a label for each of them
    sample = materialize(documents.select(F.col("doc_id").alias("key"), "text").join(picked, "key"), "labelled-texts")
    return toxicity.fit(sample, key=F.col("key"), most=most)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = toxicity.score(docs, toxicity_model(docs, table(spark, sf, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_langid")
def op6_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    train = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(train, key=F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "accepted")


@query("op3_ann")
def op3_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP4_SQL = """WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op4_topk", OP4_SQL)
def op4_topk(spark: SparkSession, sf: str) -> DataFrame:
    return voronoi.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9_SQL = f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
win AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS i FROM d),
seen AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM seen WHERE nth > 1),
word AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS j FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.j) AS n_removed, string_agg(w, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op9_substrings", OP9_SQL)
def op9_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Words outside repeated 20-word windows."""
    found = substrings.remove_repeats(table(spark, sf, "documents"), length=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Base entities and the spans that bootstrapped patterns add."""
    found = pii.extract(table(spark, sf, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


OP8_SQL = f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS w, unnest([NULL] || words[:-2]) AS h FROM d),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, w),
s AS (
  SELECT t.doc_id, CASE WHEN b.c > 1 THEN round(log10((b.c - 1) / (uh.c - 1)) * 1e6)
    ELSE CASE WHEN u.c > 1 THEN round(log10((u.c - 1) / (n.n - 1)) * 1e6) ELSE round(log10(1 / n.n) * 1e6) END
      + CASE WHEN t.h IS NULL THEN 0 ELSE round(log10(0.4) * 1e6) END END AS x
  FROM t CROSS JOIN n JOIN u ON u.w = t.w LEFT JOIN u uh ON uh.w = t.h LEFT JOIN b ON b.h = t.h AND b.w = t.w),
g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(CAST(x AS BIGINT)) AS BIGINT) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_words, 0) AS n_words, coalesce(g.x, 0) / 1e6 AS score, g.x / 1e6 / g.n_words AS mean
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


@query("op8_lm", OP8_SQL)
def op8_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Stupid-backoff bigram scores; the rows of half an input split are one block."""
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    docs = table(spark, sf, "documents").select("doc_id", "text", split.alias("split"))
    return lm.score(docs, order=2, block=F.col("split"))


@query("op11_quality")
def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every text, trained on at most about 4000 labelled rows outside the held-out fold."""
    docs, most = table(spark, sf, "documents"), 4000
    known = table(spark, sf, "labels").filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    picked = F.broadcast(bounded_sample(known, F.col("doc_id"), most))  # an id and a label for each of them
    model = quality.fit(docs.select("doc_id", "text").join(picked, "doc_id"), key=F.col("doc_id"), most=most)
    found = quality.score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """The 32 leading whitened coordinates of every vector."""
    return whitening.whiten(table(spark, sf, "embeddings"), components=32, scale=64, shift=1_000_000)


def _level(tree: str, name: str, source: str) -> str:
    """SQL text: nodes (tree, level, pos, h, n) of every tree over ``source`` (tree, pos, h), level by level."""
    return f"""{name} AS (
  SELECT {tree} AS tree, 0 AS level, pos, h, count(*) OVER (PARTITION BY {tree}) AS n FROM {source}
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""


def _steps(name: str, node: str) -> str:
    """SQL text: siblings (doc, level, before, after) at the levels of ``name`` above the nodes ``node`` (doc, tree, pos)."""
    return f"""SELECT x.r, b.level, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < x.pos // 3 ** b.level), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > x.pos // 3 ** b.level), '') AS after
  FROM {node} x JOIN {name} b ON b.tree = x.tree AND b.n > 1 AND b.pos // 3 = x.pos // CAST(3 ** (b.level + 1) AS BIGINT) GROUP BY x.r, b.level""".replace(
        "3 ** b.level", "CAST(3 ** b.level AS BIGINT)")


def _coded(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


OP13_SQL = f"""WITH RECURSIVE c AS (
  SELECT doc_id, source, text, {" || ".join(map(_coded, ("doc_id", "source", "lang", "n_chars")))} AS head,
    list_reduce(list_prepend(4294967295, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) % 2 = 1 AS even
  FROM documents),
l AS (SELECT doc_id, source, sha256(head || {_coded("text")}) AS h,
    sha256(head || {_coded("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")}) AS seen FROM c),
g AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents) z),
p AS (SELECT doc_id, h, seen, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS r FROM l JOIN g ON g.source IS NOT DISTINCT FROM l.source),
{_level("tree", "low", "p")},
sub AS (SELECT tree AS pos, h FROM low WHERE n = 1),
{_level("0", "high", "sub")},
steps AS (SELECT * FROM ({_steps("low", "p")}) a
  UNION ALL SELECT r, 1000 + level, before, after FROM ({_steps("high", "(SELECT r, 0 AS tree, tree AS pos FROM p)")}) b),
path AS (SELECT r, list([before, after] ORDER BY level) AS w, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY r),
f AS (SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
    CASE WHEN w IS NULL THEN seen ELSE list_reduce(list_prepend([seen, ''], w), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] END AS folded_root
  FROM p JOIN sub s ON s.pos = p.tree CROSS JOIN (SELECT h FROM high WHERE n = 1) t LEFT JOIN path ON path.r = p.r)
SELECT *, folded_root = root AS verified FROM f"""


@query("op13_merkle", OP13_SQL)
def op13_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves, roots and witnesses of all documents, and what the witnesses make of tampered texts."""
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    other = merkle.leaf_digest([*head, F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)])
    found = merkle.manifest(table(spark, sf, "documents"), key=F.col("doc_id"), group=F.col("source"), fields=[*head, text], others={"other": other})
    out = found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("witness")).cast("binary"), 256).alias("proof_sha256"),
        merkle.folded(F.col("other"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
