"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of an input table that one task works on: tasks grow in number with a table, not in size.
TASK_ROWS = 150_000


def tasks(df: DataFrame) -> int:
    """Number of tasks for work on a table: its rows are counted from the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """The rows over all tasks (or ``n``) by a hash of ``keys``: a table of one row group is read by one task, which would do all work behind it alone."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
