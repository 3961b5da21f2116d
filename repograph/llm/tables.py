"""Reading the given tables and keeping intermediate ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repograph.session import cut

# Rows of a batch that goes to Python while a table is written.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; its shuffle files go at once."""

    spark = df.sparkSession
    wanted = {CLEANUP: "true", **BATCH_ROWS}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return cut(df, partition_by)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
