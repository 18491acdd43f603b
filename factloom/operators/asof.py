"""Latest version of each key as of an instant, and joins that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_as_of(df: DataFrame, key: list[str], observed: str, as_of: Column | None = None, ties: list[Column] | None = None, visible: Column | None = None) -> DataFrame:
    """The newest row of each key that was observed at or before ``as_of``.

    The cutoff comes before the ranking. ``visible`` is applied after it, so a hidden newest
    version hides its key and never brings an older version back. Ties are broken by ``ties``.
    """
    rows = df if as_of is None else df.where(F.col(observed) <= as_of)
    order = Window.partitionBy(*key).orderBy(F.col(observed).desc(), *(ties or []))
    latest = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return latest if visible is None else latest.where(visible)


def versions_as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, observed: str, ties: list[Column], strict: bool = False) -> DataFrame:
    """For each request (key, instant) the version of that key visible at the instant; none: no row.

    ``strict`` leaves out versions observed at the very instant. Both tables are one timeline: a request takes
    the last version before it in (key, time) order, so nothing is joined and a key costs what it
    has. Among versions of one instant the first by ``ties`` counts. Columns of both tables come back.
    """
    best = Window.partitionBy(key, observed).orderBy(*ties)
    version = F.struct(*(F.col(c) for c in versions.columns if c != key))
    one = versions.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select(F.col(key).alias("_key"), F.col(observed).alias("_at"), version.alias("_version"))
    request = F.struct(*(F.col(c) for c in requests.columns if c != key))
    asked = requests.select(F.col(key).alias("_key"), F.col(at).alias("_at"), request.alias("_request"))
    line = one.withColumn("_request", F.lit(None)).withColumn("_kind", F.lit(1)).unionByName(asked.withColumn("_version", F.lit(None)).withColumn("_kind", F.lit(0 if strict else 2)))
    before = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("_version", F.last("_version", ignorenulls=True).over(before)).where("_kind <> 1 AND _version IS NOT NULL")
    return found.select(F.col("_key").alias(key), "_request.*", "_version.*")


def in_caller_order(df: DataFrame, wanted: DataFrame, id_col: str, position: str = "position") -> DataFrame:
    """Rows of ``df`` for the first mention of each id in ``wanted`` (position, id), with its position."""
    first = wanted.groupBy(id_col).agg(F.min(position).alias(position))
    return df.join(first, id_col)


def evidence_by_record(page: DataFrame, links: DataFrame, evidence: DataFrame, record: str, evidence_id: str, order: list[str]) -> DataFrame:
    """One row per record of a page with its evidence as an ordered array of structs."""
    found = links.join(page.select(record).distinct(), record, "left_semi").join(evidence, evidence_id)
    return found.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("evidence"))
