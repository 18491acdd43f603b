"""Candidates built from the statements of documents, and replayed after some were tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import candidates
from .drafts import _DAY, _FORM, STATEMENTS, _quoted
from .tables import table

_ROWS = [(k, f, v, text[a:e], a, e) for k, (text, facts) in enumerate(STATEMENTS) for f, v, a, e in facts]
_SINGLE = ("product_family", "campaign_type", "sales_channel", "new_customer_only", "validity")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of two statements of each document and its id as a title; labels are taken from the first one that has them."""
    d, j = F.col("document_id"), F.col("j")
    form = ((d * (j + 3) + j * 5 + F.floor(d / 14)) % 14).cast("int")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.lit([0, 1])).alias("j")).withColumn("form", form)
    said = F.broadcast(spark.createDataFrame(_ROWS, "form int, field string, value string, quote string, start int, end int"))
    order = F.row_number().over(Window.partitionBy("document_id", "field").orderBy("j"))
    found = docs.join(said, "form").withColumn("nth", order).where(~F.col("field").isin(*_SINGLE) | (F.col("nth") == 1)).select("document_id", "field", "nth", "value", "quote", j.alias("block_id"), "start", "end")
    title = F.concat(F.lit("Belge "), d.cast("string"))
    titles = docs.where((j == 0) & (d % 17 > 0)).select("document_id", F.lit("title").alias("field"), F.lit(1).alias("nth"), title.alias("value"), title.alias("quote"), F.lit(9).alias("block_id"), F.lit(0).alias("start"), F.length(title).alias("end"))
    return found.unionByName(titles)


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("source", F.lit("")).alias("bank"))
    states = docs.select("document_id", F.array(F.lit("seen")).alias("issues"), F.lit(["rate", "fee", "rate"]).alias("unresolved"))
    return candidates.build(_facts(spark, sf_dir), states, docs)


def built_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their issues and how many pointers each has."""
    made, facts = _built(spark, sf_dir)
    counted = facts.groupBy("document_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("pointer")), ","), 256).alias("pointers"))
    return made.join(counted, "document_id", "left").select("document_id", F.array_join("issues", ",").alias("issues"), "error", F.col("candidate").isNotNull().alias("has_id"), F.when(F.col("error").isNull(), F.col("n")).alias("n"), F.when(F.col("error").isNull(), F.col("pointers")).alias("pointers"))


def replayed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after tampering: other figures, other labels, other currencies, other places; the id covers all of it."""
    made, facts = _built(spark, sf_dir)
    d, field = F.col("document_id"), F.col("field")
    other = (
        F.when((d % 7 == 1) & (field == "rate"), F.regexp_replace("value", "2.79|10.0", "9.9")).when((d % 7 == 2) & (field == "term"), F.regexp_replace("value", "36", "48")).when((d % 7 == 3) & (field == "campaign_type"), F.lit("cashback"))
        .when((d % 7 == 4) & (field == "product_family"), F.lit("investment")).when((d % 7 == 5) & (field == "product_currency"), F.lit("USD")).when((d % 7 == 6) & (field == "validity"), F.regexp_replace("value", "07-31", "07-30"))
        .when((d % 11 == 3) & (field == "sales_channel"), F.lit("web")).when((d % 11 == 4) & (field == "financing_amount"), F.regexp_replace("value", "250000", "25000")).when((d % 11 == 5) & (field == "customer_segment_key"), F.lit("genc")).otherwise(F.col("value"))
    )
    moved = facts.withColumn("value", other).withColumn("start", F.when(d % 5 == 0, F.col("start") + 1).otherwise(F.col("start")))
    pages = made.select("document_id", F.lit(None).cast("string").alias("currency"))
    own = made.where("candidate IS NOT NULL")
    found = candidates.replay_values(own, moved, pages, F.lit(_DAY))
    return own.select("document_id", "candidate").join(found, "candidate").select("document_id", "reason")


_SAID = ", ".join(f"({k}, {_quoted(f)}, {_quoted(v)})" for k, f, v, *_ in _ROWS)
_SQL = f"""
    b AS (SELECT document_id, j, {_FORM} AS form FROM (SELECT doc_id AS document_id, unnest(range(2)) AS j FROM documents)),
    n AS (SELECT document_id, j, field, value, row_number() OVER (PARTITION BY document_id, field ORDER BY j) AS nth FROM b JOIN (VALUES {_SAID}) v(form, field, value) USING (form)),
    f AS (SELECT * FROM n WHERE field NOT IN ({", ".join(map(_quoted, _SINGLE))}) OR nth = 1)"""
_POINTER_SQL = "CASE field " + " ".join(f"WHEN '{f}' THEN " + (f"'{p}' || (nth - 1)" if p.endswith("/") else f"'{p}'") for f, p in candidates.POINTERS.items()) + f" WHEN 'customer_segment_key' THEN '{candidates.SEGMENT_KEYS}' || (nth - 1) END"

ENTRIES = {
    "built_candidates": (
        built_candidates,
        f"""WITH {_SQL},
        e AS (SELECT document_id, field, nth FROM f UNION ALL SELECT doc_id, 'title', 1 FROM documents WHERE doc_id % 17 > 0 UNION ALL SELECT DISTINCT document_id, 'product_currency', 1 FROM f WHERE field = 'financing_amount'
            UNION ALL SELECT document_id, 'customer_segment_key', nth FROM f WHERE field = 'customer_segment'),
        p AS (SELECT document_id, count(*) AS n, sha256(string_agg({_POINTER_SQL}, ',' ORDER BY {_POINTER_SQL})) AS pointers FROM e GROUP BY 1)
        SELECT doc_id AS document_id, 'seen,unresolved:fee,unresolved:rate' AS issues, CASE WHEN doc_id % 17 = 0 THEN 'title_unresolved' END AS error, doc_id % 17 > 0 AS has_id, CASE WHEN doc_id % 17 > 0 THEN n END AS n,
        CASE WHEN doc_id % 17 > 0 THEN pointers END AS pointers FROM documents LEFT JOIN p ON p.document_id = doc_id""",
    ),
    "replayed_values": (
        replayed_values,
        f"""WITH {_SQL}, g AS (SELECT document_id AS d, bool_or(field = 'rate') AS rate, bool_or(field = 'term') AS term, bool_or(field = 'campaign_type') AS type, bool_or(field = 'product_family') AS family,
            bool_or(field = 'financing_amount') AS amount, bool_or(field = 'validity') AS validity, bool_or(field = 'sales_channel') AS channel, bool_or(field = 'customer_segment') AS segment FROM f GROUP BY 1)
        SELECT doc_id AS document_id, CASE WHEN doc_id % 7 = 4 AND family THEN 'product_family_evidence_laundering' WHEN doc_id % 7 = 3 AND type THEN 'campaign_type_evidence_laundering'
        WHEN doc_id % 11 = 3 AND channel THEN 'sales_channel_evidence_laundering' WHEN doc_id % 7 = 1 AND rate THEN 'rate_normalization_mismatch'
        WHEN doc_id % 11 = 4 AND amount THEN 'money_normalization_mismatch' WHEN doc_id % 7 = 2 AND term THEN 'term_normalization_mismatch' WHEN doc_id % 7 = 6 AND validity THEN 'validity_normalization_mismatch'
        WHEN doc_id % 7 = 5 AND amount THEN 'product_currency_derivation_mismatch' WHEN doc_id % 11 = 5 AND segment THEN 'customer_segment_derivation_mismatch' WHEN doc_id % 5 = 0 THEN 'candidate_id_mismatch' END AS reason
        FROM documents LEFT JOIN g ON d = doc_id WHERE doc_id % 17 > 0""",
    ),
}
