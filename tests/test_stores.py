"""Commits against what is stored, and inside one batch."""

import pytest

from factloom.sinks import stores
from factloom.sinks.tables import ConflictError

DOC, BLOCK, LINK = "document_id string, clean_sha256 string, title string", "document_id string, ordinal int, kind string, text string", "fetch string, document_id string"


def put(spark, path, docs, blocks, links=()):
    return stores.commit_documents(spark.createDataFrame(docs, DOC), spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(list(links), LINK), str(path))


def test_documents(spark, tmp_path):
    a, blocks = ("a", "h1", "t"), [("a", 0, "p", "x"), ("a", 1, "p", "y")]
    assert put(spark, tmp_path, [a, a], blocks, [("f1", "a")]) == 1
    assert put(spark, tmp_path, [a, ("b", "h2", None)], [*blocks[::-1], ("b", 0, "p", "z")], [("f2", "a"), ("f1", "a")]) == 1
    for docs, own in (
        ([("a", "h1", "other")], blocks), ([("c", "h1", "t")], []), ([a], blocks[:1]), ([a], [("a", 0, "p", "y"), ("a", 1, "p", "x")]), ([("d", "h4", "t"), ("d", "h4", "u")], []), ([("d", "h4", "t"), ("e", "h4", "t")], []),
    ):
        with pytest.raises(ConflictError):
            put(spark, tmp_path, docs, own)
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert (read("documents").count(), read("blocks").count(), read("links").count()) == (2, 3, 2)


def test_records(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "record_id string, campaign_key string, version int, data string")
    links = spark.createDataFrame([("r1", "e1"), ("r1", "e1")], "record_id string, evidence_id string")
    put_records = lambda *r: stores.commit_records(rows(*r), links, str(tmp_path))
    assert put_records(("r1", "k", 1, "x")) == 1 and put_records(("r1", "k", 1, "x"), ("r2", "k", 2, None)) == 1
    for bad in (("r1", "k", 1, "y"), ("r1", "k", 3, "x"), ("r9", "k", 1, "x")):
        with pytest.raises(ConflictError):
            put_records(bad)
    with pytest.raises(ConflictError):
        put_records(("r7", "m", 1, "x"), ("r8", "m", 1, "x"))
    assert spark.read.parquet(f"{tmp_path}/evidence").count() == 1


def test_responses(spark, tmp_path):
    put_response = lambda *r: stores.commit_responses(spark.createDataFrame(list(r), "request_sha256 string, response_sha256 string"), spark.createDataFrame([("q", "r1")], "request_sha256 string, record_id string"), str(tmp_path))
    assert put_response(("q", "a"), ("q", "a")) == 1 and put_response(("q", "a"), ("p", "a")) == 1
    with pytest.raises(ConflictError):
        put_response(("q", "b"))
