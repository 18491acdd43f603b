"""Requirement matrix of records and validity of their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import span_holds


def apply_matrix(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``missing`` (required fields not stated, sorted) and ``valid``.

    ``records`` have family, kind and an array ``stated``; ``rules`` (family, kind or "*",
    all_of, any_of) is a rule table of fixed size and is broadcast. An exact kind precedes "*";
    without a rule nothing is required. One of any_of has to be stated, if it isn't empty.
    """
    exact = F.broadcast(rules.where("kind <> '*'").select("family", "kind", F.struct("all_of", "any_of").alias("_exact")))
    general = F.broadcast(rules.where("kind = '*'").select("family", F.struct("all_of", "any_of").alias("_general")))
    joined = records.join(exact, ["family", "kind"], "left").join(general, "family", "left").withColumn("_rule", F.coalesce("_exact", "_general"))
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.coalesce(F.col("_rule.all_of"), none), "stated"))
    any_of = F.coalesce(F.col("_rule.any_of"), none)
    return (
        joined.withColumn("missing", missing).withColumn("valid", (F.size("missing") == 0) & ((F.size(any_of) == 0) | F.arrays_overlap(any_of, "stated")))
        .drop("_exact", "_general", "_rule")
    )


def verify_evidence(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``reason``: null for evidence that holds, else the first of six codes.

    ``evidence``: evidence_id, document_id, block_id, start, end, quote, digest; ``blocks``:
    document_id, block_id, text.
    """
    joined = evidence.join(blocks, ["document_id", "block_id"], "left")
    reason = (
        F.when(F.col("text").isNull(), "block_not_found").when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "invalid_span")
        .when(F.col("end") > F.length("text"), "span_outside_block").when(F.length("quote") != F.col("end") - F.col("start"), "span_length_mismatch")
        .when(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote"), "quote_mismatch")
        .when(~span_holds(F.col("text"), F.col("start"), F.col("end"), F.col("quote"), F.col("digest")), "digest_mismatch")
    )
    return joined.withColumn("reason", reason).drop("text")
