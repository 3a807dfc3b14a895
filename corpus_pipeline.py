"""A corpus pipeline: toxicity, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns
of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, similar, substrings, toxicity
from tidemark.llm.queries import toxicity_model
from tidemark.session import scratch_path, ship


def _measured(df: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text; it stays null for a null text."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labelled ones outside the held-out fold, does not reject."""
    ship(spark)
    return toxicity.reject(docs, toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of texts linked by a similarity of 0.8 over 5-word shingles.

    Ball hashing of their SimHash fingerprints proposes the classes, the shingle sets decide.
    """
    ship(spark)
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that start earlier too; a text that loses none stays as it is."""
    ship(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = substrings.remove_repeats(docs, length=20, carry=others, original=True)
    return _measured(found.withColumnRenamed("kept", "text").select(*docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return _measured(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL expresses neither the learned grammar nor the tokeniser; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
