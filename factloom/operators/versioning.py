"""Versions from observations, idempotent appends, frontier state, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def change_points(observations: DataFrame, key: str, observed: str, ties: list[Column], content: Column) -> DataFrame:
    """Observations whose content differs from the one before: a new version each.

    Adds ``version`` (from 1), ``previous_content`` and ``kind`` (created or updated). A, B, A
    makes three versions.
    """
    order = Window.partitionBy(key).orderBy(F.col(observed).asc(), *ties)
    marked = observations.withColumn("_content", content).withColumn("_before", F.lag("_content").over(order)).withColumn("_nth", F.row_number().over(order))
    changed = marked.where((F.col("_nth") == 1) | ~F.col("_content").eqNullSafe(F.col("_before")))
    return (
        changed.withColumn("version", F.row_number().over(order).cast("bigint")).withColumn("previous_content", F.lag("_content").over(order))
        .withColumn("kind", F.when(F.col("version") == 1, "created").otherwise("updated")).drop("_content", "_before", "_nth")
    )


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: later repeats of an identity are no-ops."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")


def conflicts(stored: DataFrame, incoming: DataFrame, identity: list[str], content: str) -> DataFrame:
    """Incoming rows that have to fail, not overwrite: their identity is stored with other content or, where it
    isn't stored, comes with several contents (all but the smallest are listed)."""
    known = stored.select(*identity, F.col(content).alias("_stored"), F.lit(True).alias("_has"))
    least = incoming.groupBy(*identity).agg(F.min(content).alias("_least"))
    agreed = least.join(known, identity, "left").select(*identity, F.when(F.col("_has"), F.col("_stored")).otherwise(F.col("_least")).alias("_agreed"))
    return incoming.join(agreed, identity).where(~F.col(content).eqNullSafe(F.col("_agreed"))).drop("_agreed")


def hash_conflicts(stored: DataFrame, incoming: DataFrame, identity: list[str], content: str) -> DataFrame:
    """Incoming rows whose content hash stands under another identity, stored or incoming: a copy under a second name."""
    known = stored.select(content, F.struct(*identity).alias("_id")).unionByName(incoming.select(content, F.struct(*identity).alias("_id"))).where(F.col(content).isNotNull())
    several = known.groupBy(content).agg(F.min("_id").alias("_a"), F.max("_id").alias("_z")).where("_a <> _z")
    return incoming.join(several.select(content), content, "left_semi")


def new_rows(stored: DataFrame, incoming: DataFrame, identity: list[str]) -> DataFrame:
    """Incoming rows whose identity isn't stored yet, one of each."""
    return incoming.dropDuplicates(identity).join(stored, identity, "left_anti")


def newer_dimension(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Per key the row of the higher version; equal versions keep the stored row.

    What may not be stored is said by stale_dimension(); callers that have to fail ask it first.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), F.asc("_new"))
    return both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "_new")


def stale_dimension(stored: DataFrame, incoming: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """(key, problem) of incoming rows that may not be stored: version_older, or version_differs where the
    version is stored, or comes twice, with other ``columns``."""
    content = F.to_json(F.struct(*columns))
    known = stored.select(key, F.col(version).alias("_stored"), content.alias("_content"))
    old = incoming.select(key, version, content.alias("_own")).join(known, key)
    found = old.select(key, F.when(F.col(version) < F.col("_stored"), "version_older").when((F.col(version) == F.col("_stored")) & (F.col("_own") != F.col("_content")), "version_differs").alias("problem"))
    twice = incoming.groupBy(key, version).agg(F.count_distinct(content).alias("_n")).where("_n > 1").select(key, F.lit("version_differs").alias("problem"))
    return found.where(F.col("problem").isNotNull()).unionByName(twice).distinct()


def seen_frontier(df: DataFrame, key: str, observed: str, label: str, id_col: str) -> DataFrame:
    """Per target the first and last time seen and the label of the last sighting."""
    return df.groupBy(key).agg(
        F.min(observed).alias("first_seen"), F.max(observed).alias("last_seen"), F.max_by(label, F.struct(observed, id_col)).alias(label)
    )


def index_changed(df: DataFrame, key: str, order: list[Column], hash_col: str, ok: Column) -> DataFrame:
    """Adds ``changed``: a successful scan whose hash differs from the last successful one.

    A first success and scans without success aren't changes; failures keep the old hash.
    """
    own = F.when(ok, F.col(hash_col))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(own, ignorenulls=True).over(w)
    return df.withColumn("changed", F.coalesce(own != before, F.lit(False)))


def trailing_count(df: DataFrame, key: str, micros: Column, width: int) -> DataFrame:
    """Adds ``n``: rows of the key in the half-open window (t - width, t], in microseconds."""
    w = Window.partitionBy(key).orderBy("_micros").rangeBetween(-(width - 1), 0)
    return df.withColumn("_micros", micros).withColumn("n", F.count("*").over(w)).drop("_micros")


def gap_sessions(df: DataFrame, key: str, micros: Column, ties: list[Column], idle: int) -> DataFrame:
    """Adds ``session`` (from 1): a new one begins after more than ``idle`` microseconds without a row."""
    order = Window.partitionBy(key).orderBy("_micros", *ties)
    starts = F.coalesce((F.col("_micros") - F.lag("_micros").over(order) > idle).cast("int"), F.lit(1))
    marked = df.withColumn("_micros", micros).withColumn("_start", starts)
    return marked.withColumn("session", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_micros", "_start")


def feed_sequence(events: DataFrame, order: list[Column], start: int = 0) -> DataFrame:
    """Adds ``feed_sequence`` after ``start`` in commit order without a single-task sort.

    Rows are range-partitioned by the order; each partition's offset is the sum of the sizes
    before it (one row per partition), so only counts meet in one place.
    """
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.checkpoint()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_offset", F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.join(F.broadcast(offsets.select("_part", "_offset")), "_part")
        .withColumn("feed_sequence", (F.lit(start) + F.coalesce("_offset", F.lit(0)) + within).cast("bigint")).drop("_part", "_offset")
    )
