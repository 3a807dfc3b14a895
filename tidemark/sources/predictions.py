"""Prediction tables: long form, partitioned files, and the line-per-round text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long predictions as parquet partitioned by method and, if present, strategy."""
    parts = [c for c in ("method", "strategy") if c in df.columns]
    df.write.mode(mode).partitionBy(*parts).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def predictions_to_wide(df: DataFrame, value: str, by: list[str], seq: str = "seq") -> DataFrame:
    """Line-per-round form: the values of each group in the order of ``seq``, joined by commas."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    line = F.array_join(F.transform("pairs", lambda p: p["v"].cast("string")), ",")
    return df.groupBy(*by).agg(pairs.alias("pairs")).select(*by, line.alias("line"))


def wide_to_long(lines: DataFrame, by: list[str], value: str = "y_pred") -> DataFrame:
    """Back from lines to (by*, seq, value); positions count from 1."""
    exploded = lines.select(*by, F.posexplode(F.split("line", ",")).alias("pos", "text"))
    return exploded.select(*by, (F.col("pos") + 1).cast("bigint").alias("seq"), F.trim("text").cast("double").cast("int").alias(value))


def write_wide_predictions(lines: DataFrame, path: str, by: list[str], round_col: str) -> None:
    """One text file per group of ``by``, a line per round in the order of rounds."""
    ordered = lines.repartition(*by).sortWithinPartitions(*by, round_col)
    ordered.select(*by, "line").write.partitionBy(*by).text(path)


def read_wide_predictions(spark: SparkSession, path: str, value: str = "y_pred") -> DataFrame:
    """Text files of one comma-separated line per round, as (file, round, seq, value).

    Rounds count from 0 in the order of the lines of a file; its splits are ordered by where they start.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))
    order = Window.partitionBy("file").orderBy("__start", "__at")
    numbered = lines.withColumn("round", (F.row_number().over(order) - 1).cast("bigint"))
    return wide_to_long(numbered, ["file", "round"], value)


def write_confusion(matrix: DataFrame, path: str, classes: list[int]) -> None:
    """Dense confusion counts (y_true, y_pred, n) as a CSV grid with True_i rows and Pred_j columns."""
    grid = matrix.groupBy("y_true").pivot("y_pred", classes).agg(F.first("n"))
    named = grid.select(
        F.concat(F.lit("True_"), F.col("y_true")).alias("class"), *[F.col(str(c)).alias(f"Pred_{c}") for c in classes]
    )
    named.write.csv(path, header=True)
