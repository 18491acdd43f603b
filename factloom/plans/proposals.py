"""Proposals grounded in the documents and merged into drafts; request texts under a byte budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merging, prompts
from .candidates import _BLOCKS_SQL, _TERMS, _blocks, _count_sql, _first_sql, _texts
from .tables import table

#: Fields of a document's proposals in order; fields of their own, so that SQL can read them.
_FIELDS = ("title", "campaign_type", "campaign_type", "term", "term", "term", "customer_segment", "title")
_SCALARS, _SETS = ("title", "campaign_type"), ("customer_segment",)
_READERS = {
    "title": lambda q, h, k, d: F.struct(q.alias("value"), F.when(~k.eqNullSafe(F.lit("heading")), "title_must_be_heading").alias("code")),
    "campaign_type": lambda q, h, k, d: F.struct(F.when(F.substring(q, 1, 1) < "m", "early").otherwise("late").alias("value"), F.when(q.contains(" "), "campaign_type_not_supported_by_quote").alias("code")),
    "term": lambda q, h, k, d: F.struct(F.length(q).cast("string").alias("value"), F.when(q.contains("e"), "term_not_deterministically_normalizable").alias("code")),
    "customer_segment": lambda q, h, k, d: F.struct(F.substring(q, 1, 1).alias("value"), F.when(q.contains("."), "customer_segment_not_supported_by_quote").alias("code")),
}


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quotes of each document: pieces of its lines, some asked for in the wrong block or with the wrong offsets."""
    docs = _texts(spark, sf_dir)
    # Lines are counted and taken out of whole texts: no shuffle of lines and no sort.
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = docs.join(docs.groupBy("document_id").agg(F.sum(n).alias("_n")).hint("shuffle_hash"), "document_id").select("document_id", "_n", F.split("text", "\n").alias("_lines"))
    asked = counted.withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(len(_FIELDS) - 1)))).withColumn("ordinal", ((F.col("nth") * 3) % F.col("_n")).cast("int"))
    asked = asked.where(F.col("ordinal") < F.size("_lines")).withColumn("text", F.get("_lines", F.col("ordinal")))
    return asked.select(
        "document_id", "nth", F.element_at(F.lit(list(_FIELDS)), F.col("nth") + 1).alias("field"), F.substr("text", F.lit(1) + 5 * (F.col("nth") % 3), 9 + F.col("nth")).alias("quote"),
        F.when(F.col("nth") % 2 == 1, F.when(F.col("document_id") % 11 == 0, 1_000_000).otherwise(F.col("ordinal"))).alias("block_id"), F.when(F.col("nth") == 4, 5).alias("said_start"), F.lit(None).cast("int").alias("said_end"),
        F.when(F.col("document_id") % 2 == 0, "early").alias("claimed"),
    )


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.read(merging.grounded(_proposals(spark, sf_dir), _blocks(spark, sf_dir)), _READERS)


def proposal_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each proposal: its place and value, or the first reason against it."""
    placed = F.col("code").isNull()
    return _read(spark, sf_dir).select("document_id", "nth", "field", *(F.when(placed, F.col(c)).alias(c) for c in ("at_block", "start", "end")), "code", "value")


def proposal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing in each document's response that breaks its contract; the request showed the first 25 characters of each line."""
    d, none = F.col("document_id"), F.lit(None).cast("string")
    own = _proposals(spark, sf_dir).select(
        "document_id", "nth", "field", "quote", "block_id", F.when((d % 19 == 0) & (F.col("nth") == 2), "other").alias("raw_text"), none.alias("evidence_quote"), F.lit(None).cast("int").alias("evidence_block"),
        F.when((d % 23 == 0) & (F.col("nth") == 1), F.create_map(F.lit("fee_kind"), F.lit("annual"))).when((d % 29 == 0) & (F.col("nth") == 1), F.create_map(F.lit("campaign_type"), F.lit("unknown"))).alias("hint"),
    )
    responses = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 31 == 0, merging.QUOTES_ONLY).otherwise("model-extraction/1.0").alias("schema_version"), F.when(F.col("doc_id") % 17 == 0, "partial").alias("outcome"), F.array().cast("array<string>").alias("abstentions"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(["title", "campaign_type", "term", "customer_segment"])).otherwise(F.lit(["title", "campaign_type", "term"])).alias("requested"),
    )
    # A document without a line that is long enough has fewer proposals, never none.
    sent = _blocks(spark, sf_dir).where("ordinal % 5 < 4").select("document_id", "block_id", F.substring("text", 1, 25).alias("visible"))
    return merging.contract_problems(responses, own, sent)


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("document_id")
    drafts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("page_was_cut"))).otherwise(F.array().cast("array<string>")).alias("issues"), F.lit(["campaign_type", "customer_segment", "term", "title"]).alias("unresolved"),
        F.when(F.col("doc_id") % 3 == 0, "partial").otherwise("extracted").alias("outcome"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("no rate"), F.lit("no rate"))).otherwise(F.array().cast("array<string>")).alias("abstentions"),
    )
    # First lines are cut off the texts where they are read.
    first = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("document_id"), F.substring_index("text", "\n", 1).alias("text"))
    fact = lambda field, nth, value, end, where: F.struct(
        F.lit(field).alias("field"), F.lit(nth).alias("nth"), value.alias("value"), F.lit(0).alias("block_id"), F.lit(0).alias("start"), end.alias("end"), where.alias("stated")
    )
    stated = F.array(
        fact("title", 1, F.col("text"), F.length("text"), d % 3 == 0), fact("term", 1, F.lit("12"), F.lit(12), F.lit(True)), fact("term", 2, F.lit("3"), F.lit(3), F.lit(True)), fact("customer_segment", 1, F.lit("T"), F.lit(1), d % 4 == 0),
    )
    facts = first.select("document_id", F.inline(F.filter(stated, lambda f: f["stated"]))).drop("stated")
    marked = first.where(d % 6 == 0).select("document_id", F.lit("early").alias("value"), F.lit(0).alias("block_id"), F.lit(0).alias("start"), F.lit(5).alias("end"))
    return merging.merge(drafts, facts, _read(spark, sf_dir), marked, scalars=_SCALARS, sets=_SETS, incomplete={"term": lambda values: F.exists(values, lambda v: v == "14")})


def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of each document after its proposals: scalars replaced, spans replaced or appended, sets extended."""
    return _merged(spark, sf_dir)[0].withColumn("value", F.md5("value")).withColumn("nth", F.col("nth").cast("bigint"))


def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted proposals, issues in order, and the fields that stay open."""
    return _merged(spark, sf_dir)[1].select("document_id", "accepted", F.array_join("issues", ";").alias("issues"), F.array_join("unresolved", ",").alias("unresolved"))


_PACKED = ("fee", "rate", "term", "title")
_BUDGET = 900


def prompt_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request text of each document under a budget of 900 bytes, its hash, and how many blocks it shows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("source", F.lit("")).alias("bank_id"))
    made = prompts.packages(docs, _blocks(spark, sf_dir), {k: _TERMS[k] for k in _PACKED}, budget=_BUDGET)
    return made.select("document_id", "bytes", F.size("included").alias("shown"), F.md5("content").alias("content"))


_LINES_SQL = f"(SELECT document_id, CAST(ordinal AS INTEGER) AS o, text, kind, count(*) OVER (PARTITION BY document_id) AS n FROM {_BLOCKS_SQL})"
_READ_SQL = f"""
    l AS MATERIALIZED (SELECT * FROM {_LINES_SQL}),
    p AS (SELECT document_id, nth, [{", ".join(f"'{f}'" for f in _FIELDS)}][nth + 1] AS field, substr(text, 1 + 5 * (nth % 3), 9 + nth) AS q,
        CASE WHEN nth % 2 = 1 THEN CASE WHEN document_id % 11 = 0 THEN 1000000 ELSE o END END AS b, CASE WHEN nth = 4 THEN 5 END AS said, CASE WHEN document_id % 2 = 0 THEN 'early' END AS claimed
        FROM l, (SELECT CAST(unnest(range({len(_FIELDS)})) AS INTEGER) AS nth) WHERE o = (nth * 3) % n),
    m AS (SELECT p.*, l.o, l.kind, CASE WHEN l.o IS NULL OR len(q) = 0 THEN 0 ELSE len(list_filter(range(len(l.text)), lambda i: substr(l.text, i + 1, len(q)) = q)) END AS hits, instr(l.text, q) - 1 AS pl
        FROM p LEFT JOIN l ON l.document_id = p.document_id AND (b IS NULL OR b = l.o)),
    g AS (SELECT document_id, nth, field, q, b, said, claimed, count(o) AS blocks, sum(hits) AS hits, max(CASE WHEN hits > 0 THEN {{'o': o, 'pl': pl, 'kind': kind}} END) AS w FROM m GROUP BY ALL),
    c AS (SELECT *, CASE WHEN b IS NOT NULL AND blocks = 0 THEN 'source_block_missing' WHEN hits > 1 THEN 'evidence_quote_non_unique' WHEN hits = 0 THEN 'evidence_quote_missing'
        WHEN said <> w.pl THEN 'legacy_offsets_contradict_quote' WHEN field = 'title' AND w.kind <> 'heading' THEN 'title_must_be_heading' WHEN field = 'campaign_type' AND contains(q, ' ') THEN 'campaign_type_not_supported_by_quote'
        WHEN field = 'term' AND contains(q, 'e') THEN 'term_not_deterministically_normalizable' WHEN field = 'customer_segment' AND contains(q, '.') THEN 'customer_segment_not_supported_by_quote' END AS code FROM g),
    r AS MATERIALIZED (SELECT document_id, nth, field, claimed, CASE WHEN code IS NULL THEN w.o END AS at_block, CASE WHEN code IS NULL THEN w.pl END AS "start", CASE WHEN code IS NULL THEN w.pl + len(q) END AS "end", code,
        CASE WHEN code IS NULL THEN CASE field WHEN 'title' THEN q WHEN 'campaign_type' THEN CASE WHEN substr(q, 1, 1) < 'm' THEN 'early' ELSE 'late' END WHEN 'term' THEN CAST(len(q) AS VARCHAR) ELSE substr(q, 1, 1) END END AS value FROM c)"""
_MERGE_SQL = f"""{_READ_SQL},
    s AS (SELECT *, count(*) FILTER (code IS NULL) OVER (PARTITION BY document_id, field) AS good FROM r WHERE field IN ('title', 'campaign_type')),
    can AS (SELECT document_id, min(nth) AS nth FROM s WHERE field = 'campaign_type' AND code IS NOT NULL AND good = 0 AND claimed = 'early' AND document_id % 6 = 0 GROUP BY 1),
    sb AS (SELECT s.*, can.nth IS NOT NULL AND s.field = 'campaign_type' AS bound FROM s LEFT JOIN can USING (document_id, nth)),
    news AS (SELECT document_id, field, nth, CASE WHEN bound THEN 'early' ELSE value END AS value, CASE WHEN bound THEN 0 ELSE at_block END AS block_id, CASE WHEN bound THEN 0 ELSE "start" END AS "start", CASE WHEN bound THEN 5 ELSE "end" END AS "end"
        FROM sb WHERE bound OR (code IS NULL AND good = 1)
        UNION ALL SELECT document_id, field, nth, value, at_block, "start", "end" FROM r WHERE code IS NULL AND field IN ('term', 'customer_segment')),
    olds AS (SELECT document_id, 'title' AS field, 1 AS nth, text AS value, o AS block_id, 0 AS "start", len(text) AS "end" FROM l WHERE o = 0 AND document_id % 3 = 0
        UNION ALL SELECT document_id, 'term', 1, '12', o, 0, 12 FROM l WHERE o = 0 UNION ALL SELECT document_id, 'term', 2, '3', o, 0, 3 FROM l WHERE o = 0
        UNION ALL SELECT document_id, 'customer_segment', 1, 'T', o, 0, 1 FROM l WHERE o = 0 AND document_id % 4 = 0),
    f AS (SELECT 'draft' AS origin, * FROM olds o WHERE field = 'customer_segment' OR NOT EXISTS (SELECT 1 FROM news n WHERE n.document_id = o.document_id AND n.field = o.field
            AND (n.field IN ('title', 'campaign_type') OR (n.block_id = o.block_id AND n."start" = o."start" AND n."end" = o."end")))
        UNION ALL SELECT 'model', * FROM news n WHERE CASE WHEN field = 'customer_segment' THEN NOT EXISTS (SELECT 1 FROM olds o WHERE o.document_id = n.document_id AND o.field = n.field AND o.value = n.value)
            AND NOT EXISTS (SELECT 1 FROM news k WHERE k.document_id = n.document_id AND k.field = n.field AND k.value = n.value AND k.nth < n.nth)
            ELSE NOT EXISTS (SELECT 1 FROM news k WHERE k.document_id = n.document_id AND k.field = n.field AND k.block_id = n.block_id AND k."start" = n."start" AND k."end" = n."end" AND k.nth > n.nth) END)"""

ENTRIES = {
    "proposal_grounding": (proposal_grounding, f"""WITH {_READ_SQL} SELECT document_id, nth, field, at_block, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", code, value FROM r"""),
    "proposal_contract": (
        proposal_contract,
        f"""WITH {_READ_SQL},
        v AS (SELECT p.document_id, p.nth, p.field, p.b, count(l.o) AS n, coalesce(bool_or(contains(left(l.text, 25), q)), false) AS there FROM p LEFT JOIN l ON l.document_id = p.document_id AND (b IS NULL OR b = l.o) AND l.o % 5 < 4 GROUP BY ALL),
        x AS (SELECT document_id, 2 AS phase, nth, CASE WHEN field = 'customer_segment' AND document_id % 2 = 1 THEN 'field_not_requested' WHEN b IS NOT NULL AND n = 0 THEN 'block_not_sent' WHEN NOT there THEN 'quote_not_in_window' END AS problem FROM v
            UNION ALL SELECT document_id, 0, nth, CASE WHEN document_id % 19 = 0 AND nth = 2 AND q <> 'other' THEN 'raw_text_is_no_quote' WHEN document_id % 23 = 0 AND nth = 1 THEN 'hint_not_permitted' WHEN document_id % 29 = 0 AND nth = 1 THEN 'hint_says_nothing' END FROM p
            UNION ALL SELECT doc_id, 1, 0, CASE WHEN doc_id % 31 = 0 AND doc_id % 17 = 0 THEN 'outcome_or_abstentions_not_allowed' WHEN doc_id % 31 = 0 AND EXISTS (SELECT 1 FROM p WHERE document_id = doc_id) THEN 'several_facts_of_a_field'
                WHEN doc_id % 17 = 0 AND EXISTS (SELECT 1 FROM p WHERE document_id = doc_id) THEN 'facts_without_extraction' END FROM documents),
        f AS (SELECT document_id, arg_min(problem, (phase, nth)) AS problem, min((phase, nth)) AS pl FROM x WHERE problem IS NOT NULL GROUP BY 1)
        SELECT doc_id AS document_id, problem, CAST(CASE WHEN pl[1] <> 1 THEN pl[2] END AS INTEGER) AS nth FROM documents LEFT JOIN f ON document_id = doc_id""",
    ),
    "merged_facts": (
        merged_facts,
        f"""WITH {_MERGE_SQL} SELECT document_id, field, row_number() OVER (PARTITION BY document_id, field ORDER BY origin, nth) AS nth, md5(value) AS value, block_id,
        CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", origin FROM f""",
    ),
    "merge_summary": (
        merge_summary,
        f"""WITH {_MERGE_SQL},
        done AS (SELECT document_id, count(*) AS accepted, list(DISTINCT field) AS fields FROM news GROUP BY 1),
        opened AS (SELECT DISTINCT n.document_id FROM news n JOIN f USING (document_id) WHERE n.field = 'term' AND f.field = 'term' AND f.value = '14'),
        i AS (SELECT document_id, 1 AS phase, field, nth, CASE WHEN bound THEN 'model_value_grounded:' || field ELSE 'model_fact_rejected:' || field || ':' || code END AS issue FROM sb WHERE code IS NOT NULL
            UNION ALL SELECT DISTINCT document_id, 1, field, 1000, 'model_scalar_conflict:' || field || ':multiple_accepted_proposals' FROM s WHERE good > 1
            UNION ALL SELECT document_id, 2, '', nth, 'model_fact_rejected:' || field || ':' || code FROM r WHERE code IS NOT NULL AND field IN ('term', 'customer_segment')
            UNION ALL SELECT doc_id, 0, '', 0, 'page_was_cut' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3, '', 0, 'model_abstained:no rate' FROM documents WHERE doc_id % 5 = 0
            UNION ALL SELECT doc_id, 4, '', 0, 'model_outcome:partial' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT document_id, 5, 'term', 0, 'model_field_incomplete:term' FROM opened),
        u AS (SELECT document_id, issue, min((phase, field, nth)) AS pl FROM i GROUP BY ALL),
        t AS (SELECT document_id, string_agg(issue, ';' ORDER BY pl) AS issues FROM u GROUP BY 1)
        SELECT doc_id AS document_id, coalesce(accepted, 0) AS accepted, coalesce(issues, '') AS issues,
        array_to_string(list_filter(['campaign_type', 'customer_segment', 'term', 'title'], lambda x: NOT coalesce(list_contains(fields, x), false) OR (x = 'term' AND opened.document_id IS NOT NULL)), ',') AS unresolved
        FROM documents LEFT JOIN done ON done.document_id = doc_id LEFT JOIN t ON t.document_id = doc_id LEFT JOIN opened ON opened.document_id = doc_id""",
    ),
    "prompt_packages": (
        prompt_packages,
        f"""WITH b AS (SELECT *, {" + ".join(_count_sql(f) for f in _PACKED)} AS relevance, {_first_sql(*_PACKED)} AS f FROM {_BLOCKS_SQL}),
        w AS (SELECT document_id, CAST(ordinal AS INTEGER) AS o, kind, row_number() OVER (PARTITION BY document_id ORDER BY relevance DESC, CASE WHEN kind = 'heading' THEN 0 ELSE 1 END, ordinal) AS nth,
            CASE WHEN len(text) <= 400 THEN text ELSE substr(text, CAST(coalesce(greatest(0, f - 1 - 160), 0) + 1 AS BIGINT), 400) END AS win FROM b WHERE relevance > 0),
        d AS (SELECT doc_id AS document_id, '{{"bank_id":' || CAST(to_json(coalesce(source, '')) AS VARCHAR) || ',"blocks":[' AS head,
            '],"document_id":' || doc_id || ',"requested_fields":["fee","rate","term","title"],"schema_version":"{prompts.SCHEMA}"}}' AS tail FROM documents),
        e AS (SELECT w.*, CASE WHEN nth > 1 THEN ',' ELSE '' END || '{{"block_id":' || o || ',"kind":"' || kind || '","text":' AS lead, CAST(to_json(win) AS VARCHAR) AS js, strlen(head) + strlen(tail) AS base FROM w JOIN d USING (document_id) WHERE nth <= 16),
        s AS (SELECT *, base + sum(strlen(lead) + strlen(js) + 1) OVER (PARTITION BY document_id ORDER BY nth) AS after FROM e),
        k AS (SELECT *, min(CASE WHEN after > {_BUDGET} THEN nth END) OVER (PARTITION BY document_id) AS over, {_BUDGET} - (after - strlen(js)) AS room FROM s),
        v AS (SELECT document_id, nth, lead, CASE WHEN after <= {_BUDGET} THEN win ELSE substr(win, 1, CAST(len(list_filter(range(1, len(win) + 1), lambda n: strlen(CAST(to_json(substr(win, 1, n)) AS VARCHAR)) <= room)) AS BIGINT)) END AS shown FROM k WHERE over IS NULL OR nth <= over),
        a AS (SELECT document_id, count(*) AS shown, string_agg(lead || CAST(to_json(shown) AS VARCHAR) || '}}', '' ORDER BY nth) AS body FROM v WHERE shown <> '' GROUP BY 1),
        j AS (SELECT document_id, coalesce(shown, 0) AS shown, head || coalesce(body, '') || tail AS content FROM d LEFT JOIN a USING (document_id))
        SELECT document_id, CAST(strlen(content) AS INTEGER) AS bytes, CAST(shown AS INTEGER) AS shown, md5(content) AS content FROM j""",
    ),
}
