"""Tables of a data directory, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "examples", "steps", "step_clusters", "skills", "region_index", "file_profiles", "result_left", "result_right",
    "test_items",
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the given tables, for SQL text."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
