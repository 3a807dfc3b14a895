"""Labelled tables: features, label, position and warm-up split."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.scan import with_chunk, with_global_seq, with_seq

__all__ = ["labelled_table", "read_labelled_csv", "read_headerless_scaled", "warmup", "stream_part", "class_dictionary",
           "Standardizer", "with_chunk", "with_seq", "with_global_seq"]


def labelled_table(
    df: DataFrame, features: list[str], label: str, order_by: str, key: list[str] | None = None
) -> DataFrame:
    """Narrow table (key*, order, features ARRAY<DOUBLE>, label INT).

    A row with a missing feature keeps a null ``features`` (scored as null, never trained on); a
    null label means unlabelled.
    """
    missing = [c for c in [*features, label, order_by, *(key or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    for c in features:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"feature {c} is {df.schema[c].dataType.simpleString()}, not numeric")
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    vec = F.array(*[F.col(c).cast("double") for c in features])
    return df.select(*(key or []), order_by, F.when(complete, vec).alias("features"), F.col(label).cast("int").alias("label"))


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header whose last column is the label and whose other columns are features."""
    df = spark.read.csv(path, header=True, schema=schema)
    *features, label = df.columns
    return df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("features"), F.col(label).cast("int").alias("label"))


def read_headerless_scaled(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless CSV; every column but the last is cast to double and standardised."""
    cols = [f"f{i}" for i in range(n_features)]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in [*cols, "label"]])
    df = spark.read.csv(path, header=False, schema=schema)
    return Standardizer.fit(df, cols, epsilon=0.0).transform(df)


def warmup(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` rows, used to fit before the stream starts."""
    return df.filter(F.col(seq) <= n)


def stream_part(df: DataFrame, n: int, max_samples: int | None = None, seq: str = "seq") -> DataFrame:
    """Rows after the warm-up, at most ``max_samples`` of them."""
    rest = df.filter(F.col(seq) > n)
    return rest if max_samples is None else rest.filter(F.col(seq) <= n + max_samples)


def class_dictionary(df: DataFrame, label: str) -> DataFrame:
    """Dense 0-based class ids of the distinct labels (one row per class)."""
    distinct = df.select(F.col(label).alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranked = distinct.agg(F.array_sort(F.collect_set("value")).alias("all"))
    return ranked.select(F.posexplode("all").alias("class_id", "value"))


@dataclasses.dataclass
class Standardizer:
    """Column means and population deviations frozen from a warm-up; one small row on the driver."""

    columns: list[str]
    means: list[float]
    stds: list[float]
    epsilon: float = 1e-6

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], epsilon: float = 1e-6) -> "Standardizer":
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        n = len(columns)
        if row[0] is None:
            raise ValueError("cannot standardise on an empty warm-up")
        return cls(list(columns), [row[i] for i in range(n)], [row[n + i] for i in range(n)], epsilon)

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        scale = self.stds[i] + self.epsilon
        return (F.col(name) - F.lit(self.means[i])) / F.lit(scale if scale else 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.columns})
