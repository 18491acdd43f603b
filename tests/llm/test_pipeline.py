"""The pipeline's stages against what each operator says about its own input."""

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402
from factloom.llm import bpe_stream, decontam, secret_scan, simhash  # noqa: E402
from factloom.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "secrets", "bpe"]
    kept = written(cp.language_id(spark, docs, SF), "t")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    one = written(cp.near_dedup(spark, kept, SF), "t")
    groups = {r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert {r.doc_id for r in one.collect()} == groups and one.columns == docs.columns
    clean = written(cp.decontamination(spark, one, SF), "t")
    bad = {r.doc_id for r in decontam.overlaps(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == groups - bad
    masked = written(cp.secrets(spark, clean, SF), "t")
    before = {r.doc_id: r.text for r in clean.collect()}
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert r.text == secret_scan.masked(before[r.doc_id], ranks=secret_scan.dictionary(cp.tokenizer_path(cp.WORD_BPE))) and r.n_chars == len(r.text)
    ids = {r.doc_id: r.ids for r in cp.bpe(spark, masked, SF).collect()}
    words = bpe_stream.WordEncoder(cp.tokenizer_path(cp.WORD_BPE))
    for r in masked.collect():
        assert b"".join(b"".join(x) for x in words(r.text)) == b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id])
    assert {r.doc_id for r in cp.run(spark, SF).select("doc_id").collect()} == set(before)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, "x " * 30_000, "en", "s", 60_000), (3, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            df = written(stage(spark, df, SF), "t")
        assert df.count() <= 3
