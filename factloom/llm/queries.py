"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import small_batches

#: Environment-free parameter: where the public tokenizer files are.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_stream import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), limit=1024)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"), words=tokenizer_path(WORD_BPE))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judged

    return judged(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import toxicity as tox

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~tox.held_out("doc_id"))
    scored = tox.scores(docs, tox.fit(docs, labels))
    return scored.select("doc_id", tox.held_out("doc_id").alias("held_out"), "score", F.col("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cdc_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.predict(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_crf as crf

    docs = table(spark, sf_dir, "documents")
    model = crf.fit(docs, table(spark, sf_dir, "labels"))
    return crf.quality(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"
    )


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    made = (
        op1_secret_scans, op2_bpe_encoding_decoding, op3_url_filters, op4_toxicity, op5_benchmark_decontamination,
        op6_simhash_near_dedup, op7_token_counts, op8_substring_dedup, op9_language_id, op10_quality_rules,
        op11_ranked_lexical_search, op12_conversation_prefix_trie, op13_embedding_near_dedup,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    from .conversation_trie import prefix_trie_sql
    from .decontam import overlaps_sql
    from .embedding_dedup import near_duplicates_sql
    from .lexical_search import ranked_sql

    return {
        "op5_benchmark_decontamination": overlaps_sql(),
        "op11_ranked_lexical_search": ranked_sql(),
        "op12_conversation_prefix_trie": prefix_trie_sql(),
        "op13_embedding_near_dedup": near_duplicates_sql(),
    }
