"""Append-only tables with identities, committed batches, sorted exports with a manifest, raw bytes by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versioning import conflicts, hash_conflicts, new_rows, newer_dimension, stale_dimension


class ConflictError(RuntimeError):
    """An identity is stored already with other content."""


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or an empty one of the same columns where nothing was written yet."""
    reader = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = reader.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(reader)
    return spark.read.schema(like.schema).parquet(path) if exists else like.limit(0)


def append_once(incoming: DataFrame, path: str, identity: list[str], content: str, unique_content: bool = False) -> int:
    """Append rows whose identity is new; the same identity with the same content is a no-op, with
    other content, stored or in the same batch, an error; with ``unique_content`` so is the same
    content under another identity. Returns the number of rows written."""
    known = stored(incoming.sparkSession, path, incoming)
    if not conflicts(known, incoming, identity, content).limit(1).isEmpty():
        raise ConflictError(f"{path}: stored {', '.join(identity)} has other content")
    if unique_content and not hash_conflicts(known, incoming, identity, content).limit(1).isEmpty():
        raise ConflictError(f"{path}: {content} is stored under another identity")
    fresh = new_rows(known, incoming, identity).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def upsert_dimension(incoming: DataFrame, path: str, key: str, version: str) -> None:
    """Advance a versioned dimension kept as numbered states under ``path``: newer versions replace, equal ones
    must be identical, older ones are an error. The new state is written beside the old one."""
    spark = incoming.sparkSession
    states = stored(spark, f"{path}/states", spark.createDataFrame([], "state int, at string"))
    last = states.orderBy(F.desc("state")).limit(1).collect()
    now = spark.read.schema(incoming.schema).parquet(last[0].at) if last else incoming.limit(0)
    columns = [c for c in incoming.columns if c not in (key, version)]
    bad = stale_dimension(now, incoming, key, version, columns).limit(1).collect()
    if bad:
        raise ConflictError(f"{path}: {bad[0][key]} {bad[0].problem}")
    number = last[0].state + 1 if last else 1
    newer_dimension(now, incoming.dropDuplicates([key, version]), key, version).write.mode("overwrite").parquet(f"{path}/state-{number}")
    spark.createDataFrame([(number, f"{path}/state-{number}")], "state int, at string").write.mode("append").parquet(f"{path}/states")


def write_bundle(tables: dict[str, DataFrame], root: str, batch_id: int) -> None:
    """Write all tables of a batch, then its commit mark: readers see whole batches only.

    Writing a batch again replaces its own files, so a retry changes nothing.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    spark.range(1).select(F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(f"{root}/_committed/{batch_id}")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of the committed batches of a table."""
    marks = spark.read.parquet(f"{root}/_committed/*").select(F.col("batch_id").cast("int").alias("batch_id")).distinct()
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").join(marks, "batch_id", "left_semi")


def export_public(df: DataFrame, path: str, order: list[str], status: str = "status", wanted: str = "validated") -> DataFrame:
    """Validated rows as JSON in a total order (range-partitioned, so files follow one another),
    and a manifest of counts by status."""
    kept = df.where(F.col(status) == wanted)
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path}/rows")
    manifest = df.groupBy(status).agg(F.count("*").alias("n"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def store_bytes(contents: DataFrame, path: str) -> int:
    """Write-once store of (content) by sha256, partitioned by the digest's first two digits."""
    rows = contents.select(F.sha2("content", 256).alias("sha256"), "content").withColumn("prefix", F.substring("sha256", 1, 2)).dropDuplicates(["sha256"])
    known = stored(contents.sparkSession, path, rows)
    fresh = rows.join(known.select("sha256"), "sha256", "left_anti").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").partitionBy("prefix").parquet(path)
    fresh.unpersist()
    return n
