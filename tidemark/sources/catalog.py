"""Drift-variant datasets: partitioned files, a catalog of them, and batch injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inject import DriftConfig, inject_drift

# fixed value: how a drift variant's parameters appear in its file name
VARIANT_NAME = r"^(.+)_(sudden|gradual|incremental|recurring)_severity([0-9.]+)_pos([0-9.]+)_width([0-9.]+)\.csv$"


def variant_name(dataset: str, config: DriftConfig) -> str:
    return f"{dataset}_{config.drift_type}_severity{config.severity}_pos{config.position}_width{config.width}.csv"


def parse_variant_name(name: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(name, VARIANT_NAME, i)
    return {
        "dataset": part(1), "drift_type": part(2), "severity": part(3).cast("double"),
        "position": part(4).cast("double"), "width": part(5).cast("double"),
    }


def write_drifted(df: DataFrame, path: str, dataset: str, config: DriftConfig) -> str:
    """Write a drifted table partitioned by dataset and drift type; returns its variant name."""
    name = variant_name(dataset, config)
    tagged = df.withColumns({"dataset": F.lit(dataset), "drift_type": F.lit(config.drift_type), "variant": F.lit(name)})
    tagged.write.mode("append").partitionBy("dataset", "drift_type", "variant").parquet(path)
    return name


def drift_catalog(df: DataFrame, name_col: str = "variant") -> DataFrame:
    """Datasets and the drift types they exist in, read off variant names."""
    fields = parse_variant_name(F.element_at(F.split(F.col(name_col), "/"), -1))
    parsed = df.select(*[c.alias(n) for n, c in fields.items()]).filter(F.col("drift_type") != "")
    return parsed.groupBy("dataset").agg(F.array_sort(F.collect_set("drift_type")).alias("drift_types"))


def batch_inject(
    spark: SparkSession, tables: dict[str, DataFrame], configs: list[DriftConfig], features: list[str], label: str, seq: str, path: str
) -> DataFrame:
    """Inject every config into every table, write each variant, and return one status row per pair.

    The loop is over parameter combinations; each iteration is one distributed job.
    """
    status = []
    for dataset, df in tables.items():
        for config in configs:
            row = {"dataset": dataset, "drift_type": config.drift_type, "variant": variant_name(dataset, config), "rows": 0,
                   "status": "success", "error": ""}
            try:
                drifted = inject_drift(df, config, features=features, label=label, seq=seq)
                write_drifted(drifted, path, dataset, config)
                row["rows"] = spark.read.parquet(
                    f"{path}/dataset={dataset}/drift_type={config.drift_type}/variant={row['variant']}"
                ).count()
            except Exception as e:  # one bad combination must not stop the rest
                row.update(status="failed", error=str(e).splitlines()[0][:200])
            status.append(row)
    return spark.createDataFrame(status, "dataset string, drift_type string, variant string, rows long, status string, error string")


def batch_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("dataset").agg(
        F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed")
    )
