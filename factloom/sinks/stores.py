"""Commits that check the state they find: documents with their ordered blocks, record versions, responses by request.

What is stored never changes. Writing the same thing again is a no-op; the same identity with anything else is a conflict, whether it
is stored already or in the same batch. Conflicts come as rows, so a whole batch is checked by joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import ConflictError, stored

BLOCK_COLUMNS = ("block_id", "ordinal", "kind", "text", "locator", "text_sha256")


def _content(columns: list[str]) -> Column:
    """A hash of some columns in order; null is a value of its own."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)


def _block_lists(blocks: DataFrame, document: str) -> DataFrame:
    """(document, blocks): a hash of the blocks in their order."""
    rows = F.struct("ordinal", _content([c for c in BLOCK_COLUMNS if c in blocks.columns]).alias("h"))
    return blocks.groupBy(document).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda b: b["h"]), ","), 256).alias("blocks"))


def document_problems(known: DataFrame, known_blocks: DataFrame, documents: DataFrame, blocks: DataFrame, document: str = "document_id", digest: str = "clean_sha256") -> DataFrame:
    """(document, problem) of documents that can't be committed.

    An id with other columns, or a content ``digest`` under another id, is ``different_content``; a stored document whose ordered blocks
    aren't those that come with it is ``non_canonical_blocks``. Documents of one batch are held against each other too.
    """
    columns = documents.columns
    row = _content([c for c in columns if c != document])
    incoming = documents.select(F.col(document).alias("id"), F.col(digest).alias("digest"), row.alias("row"))
    have = known.select(F.col(document).alias("id"), F.col(digest).alias("digest"), _content([c for c in columns if c != document]).alias("row"))
    every = have.unionByName(incoming)
    # One id has one row, one digest one id; both are counted, never compared pair by pair.
    by_id = every.groupBy("id").agg((F.count_distinct("row") > 1).alias("_rows"))
    by_digest = every.where("digest IS NOT NULL").groupBy("digest").agg((F.count_distinct("id") > 1).alias("_ids"))
    clash = incoming.join(by_id, "id").join(by_digest, "digest", "left").where(F.col("_rows") | F.coalesce("_ids", F.lit(False)))
    again = documents.select(document).distinct().join(known.select(document).distinct(), document, "left_semi")
    ours, theirs = _block_lists(blocks, document).withColumnRenamed("blocks", "_new"), _block_lists(known_blocks, document).withColumnRenamed("blocks", "_old")
    other = again.join(ours, document, "left").join(theirs, document, "left").where(~F.col("_new").eqNullSafe(F.col("_old")))
    first = clash.select(F.col("id").alias(document), F.lit("different_content").alias("problem")).distinct()
    return first.unionByName(other.join(first, document, "left_anti").select(document, F.lit("non_canonical_blocks").alias("problem")))


def record_problems(known: DataFrame, incoming: DataFrame, record: str = "record_id", key: str = "campaign_key", version: str = "version") -> DataFrame:
    """(record, problem): records whose id, or whose (key, version), is taken by anything but the very same record."""
    line = lambda df: df.select(F.col(record).alias("id"), F.col(key).alias("key"), F.col(version).alias("version"), _content(incoming.columns).alias("row"))
    new = line(incoming)
    every = line(known).unionByName(new)
    by_id, by_version = every.groupBy("id").agg(F.count_distinct("row").alias("_same_id")), every.groupBy("key", "version").agg(F.count_distinct("row").alias("_same_version"))
    found = new.join(by_id, "id").join(by_version, ["key", "version"])
    problem = F.when(F.col("_same_id") > 1, "id_taken").when(F.col("_same_version") > 1, "version_taken")
    return found.select(F.col("id").alias(record), problem.alias("problem")).where("problem IS NOT NULL").distinct()


def response_problems(known: DataFrame, incoming: DataFrame, request: str = "request_sha256", response: str = "response_sha256") -> DataFrame:
    """(request, problem): requests that have another response already, or two in the batch."""
    every = known.select(request, response).unionByName(incoming.select(request, response))
    many = every.groupBy(request).agg(F.count_distinct(response).alias("_n")).where("_n > 1")
    return incoming.select(request).distinct().join(many, request, "left_semi").withColumn("problem", F.lit("different_response"))


def _refuse(problems: DataFrame, path: str) -> None:
    bad = problems.limit(1).collect()
    if bad:
        raise ConflictError(f"{path}: {bad[0][0]} {bad[0].problem}")


def _append_new(df: DataFrame, path: str, key: list[str]) -> int:
    known = stored(df.sparkSession, path, df)
    fresh = df.dropDuplicates(key).join(known.select(*key), key, "left_anti").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def commit_documents(documents: DataFrame, blocks: DataFrame, links: DataFrame, path: str, document: str = "document_id") -> int:
    """Append new documents with their blocks, and the ``links`` (fetch, document, ...) of all, old ones too; returns how many are new.

    Blocks are written before their documents and read through them, so a commit that broke off is finished by the next one.
    """
    spark = documents.sparkSession
    known, known_blocks = stored(spark, f"{path}/documents", documents), stored(spark, f"{path}/blocks", blocks)
    _refuse(document_problems(known, known_blocks.join(known.select(document), document, "left_semi"), documents, blocks, document), path)
    fresh = documents.join(known.select(document), document, "left_anti").select(document).distinct()
    _append_new(blocks.join(fresh, document, "left_semi"), f"{path}/blocks", [document, "ordinal"])
    n = _append_new(documents, f"{path}/documents", [document])
    _append_new(links, f"{path}/links", links.columns[:2])
    return n


def commit_records(records: DataFrame, links: DataFrame, path: str, record: str = "record_id") -> int:
    """Append new record versions and the links of records to their evidence; returns how many records are new."""
    known = stored(records.sparkSession, f"{path}/records", records)
    _refuse(record_problems(known, records, record), path)
    n = _append_new(records, f"{path}/records", [record])
    _append_new(links, f"{path}/evidence", links.columns[:2])
    return n


def commit_responses(responses: DataFrame, links: DataFrame, path: str, request: str = "request_sha256") -> int:
    """Append the responses of new requests and their links to records; returns how many are new."""
    _refuse(response_problems(stored(responses.sparkSession, f"{path}/responses", responses), responses, request), path)
    n = _append_new(responses, f"{path}/responses", [request])
    _append_new(links, f"{path}/records", links.columns[:2])
    return n
