"""Gates and scores over labels, documents, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, evaluation
from .comparison import _GATE_SQL, AS_OF, _contexts
from .quality import _GOLD_SQL, _PRED_SQL, _sides
from .tables import table


def case_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as kinds of cases; a case passes unless its key is a multiple of 997."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 997 > 0).alias("passed"))
    return evaluation.case_gate(cases, ["1-URGENT", "2-HIGH", "5-LOW"], 4).withColumn("accuracy", F.round("accuracy", 9))


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold and a rule as prediction; every fifth statement has no evidence that holds."""
    gold, predicted = _sides(spark, sf_dir)
    d = F.col("doc_id")
    evidence = predicted.select("doc_id", "field", F.when(d % 5 == 0, "quote_mismatch").alias("reason"))
    return evaluation.evidence_gate(gold, predicted.withColumn("schema_valid", d % 101 > 0), evidence, 10, "doc_id")


def extraction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the values; a field that nobody states has no support."""
    gold, predicted = _sides(spark, sf_dir)
    made = evaluation.extraction_gate(gold, predicted, ["quality", "toxic", "other"], 10, 1, 0.8, "doc_id")
    return made.select("status", "examples", *(F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")), F.array_join("low_support", ",").alias("low_support"), "unsupported")


def gold_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gold rows with their lines as evidence: hashes, spans, reviewers go wrong here and there."""
    k, line = F.col("o_orderkey"), table(spark, sf_dir, "lineitem")
    flags = line.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    rows = table(spark, sf_dir, "orders").join(flags, F.col("l_orderkey") == k, "left").select(
        k.alias("example_id"), F.col("o_orderpriority").alias("excerpt"), F.when(k % 11 == 0, "x").otherwise(F.sha2("o_orderpriority", 256)).alias("excerpt_sha256"),
        F.map_from_entries(F.transform(F.array_union(F.coalesce("f", F.array().cast("array<string>")), F.when(k % 13 == 0, F.array(F.lit("Z"))).otherwise(F.array().cast("array<string>"))), lambda x: F.struct(x, F.lit("v")))).alias("fields"),
        F.when(k % 17 == 0, "odd").when(k % 3 == 0, "verified").otherwise("pending").alias("status"), F.when(k % 6 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reviewers"), F.when(k % 15 > 0, F.col("o_orderdate")).alias("reviewed_at"),
    )
    p, quote = F.col("l_partkey"), F.col("l_partkey").cast("string")
    evidence = line.select(
        F.col("l_orderkey").alias("example_id"), F.when(p % 97 == 0, "Q").otherwise(F.col("l_returnflag")).alias("pointer"), quote.alias("quote"), F.lit(3).alias("start"), (F.length(quote) + 3 + (p % 89 == 0).cast("int")).alias("end"), F.when(p % 83 == 0, "x").otherwise(F.sha2(quote, 256)).alias("digest"),
    )
    return evaluation.gold_problems(rows, evidence)


def field_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of each customer, against what should have been."""
    c, customer = F.col("c_custkey"), table(spark, sf_dir, "customer")
    entry = lambda *fields: F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.cast("string").alias("value"), q.alias("quote")) for n, v, q in fields))).alias("e")
    none, name = F.lit(None).cast("string"), F.col("c_name")
    expected = customer.select(c.alias("bank"), entry(("balance", F.col("c_acctbal"), none), ("segment", F.col("c_mktsegment"), none), ("fee_status", F.when(c % 2 == 0, "charged").otherwise("waived"), none))).select("bank", "e.field", "e.value")
    read = customer.select(c.alias("bank"), entry(
        ("balance", F.when(c % 5 > 0, F.col("c_acctbal") + F.when(c % 7 == 0, 1).otherwise(0)), F.substring(name, 3, 4)), ("segment", F.concat(F.lit(" "), "c_mktsegment"), F.when(c % 3 == 0, "absent")), ("fee_status", F.when(c % 11 == 0, none).when(c % 4 < 2, "charged").otherwise("waived"), none),
    )).select("bank", "e.*")
    return evaluation.field_totals(evaluation.field_verdicts(expected, read, customer.select(c.alias("bank"), name.alias("text"))))


def context_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes that no order of a request states, where the request may be compared."""
    records = _contexts(spark, sf_dir)
    made = evaluation.context_notes(records, comparison.gate(records, F.lit(AS_OF).cast("timestamp")))
    return made.select("request", F.md5(F.array_join("notes", "|")).alias("notes"), F.size("notes").alias("n"))


_FIELDS_SQL = f"""g AS (SELECT * FROM {_GOLD_SQL}), p AS (SELECT * FROM {_PRED_SQL})"""

ENTRIES = {
    "case_gate": (
        case_gate,
        """WITH s AS (SELECT count(*) AS cases, count(*) FILTER (o_orderkey % 997 > 0) AS passed, least(count(*) FILTER (o_orderpriority = '1-URGENT'), count(*) FILTER (o_orderpriority = '2-HIGH'), count(*) FILTER (o_orderpriority = '5-LOW')) AS l FROM orders)
        SELECT CASE WHEN l < 4 THEN 'insufficient_data' WHEN cases = passed THEN 'pass' ELSE 'fail' END AS status, cases, passed, round(passed / cases, 9) AS accuracy FROM s""",
    ),
    "evidence_gate": (
        evidence_gate,
        f"""WITH {_FIELDS_SQL}, e AS (SELECT DISTINCT doc_id FROM g), d AS (SELECT DISTINCT doc_id FROM p JOIN e USING (doc_id)),
        f AS (SELECT p.*, EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.field = p.field) AS known FROM p JOIN e USING (doc_id)),
        s AS (SELECT (SELECT count(*) FROM e) AS examples, (SELECT count(*) FROM d) AS completed, count(*) AS asserted, count(*) FILTER (doc_id % 5 = 0) AS unevidenced, count(*) FILTER (NOT known) AS unsupported, (SELECT count(*) FROM d WHERE doc_id % 101 = 0) AS invalid FROM f)
        SELECT CASE WHEN examples < 10 OR completed < examples THEN 'insufficient_data' WHEN unevidenced + unsupported + invalid = 0 THEN 'pass' ELSE 'fail' END AS status, * FROM s""",
    ),
    "extraction_gate": (
        extraction_gate,
        f"""WITH {_FIELDS_SQL}, q AS (SELECT * FROM p WHERE doc_id IN (SELECT doc_id FROM g)), b AS (SELECT coalesce(g.field, q.field) AS field, g, p FROM g FULL JOIN q ON g.doc_id = q.doc_id AND g.field = q.field),
        c AS (SELECT field, count(*) FILTER (g = p) AS tp, count(*) FILTER (p IS NOT NULL AND g IS DISTINCT FROM p) AS fp, count(*) FILTER (g IS NOT NULL AND g IS DISTINCT FROM p) AS fn, count(g) AS n FROM b GROUP BY 1),
        r AS (SELECT w.field, coalesce(n, 0) AS n, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT unnest(['quality', 'toxic', 'other']) AS field) w LEFT JOIN c USING (field)),
        s AS (SELECT (SELECT count(DISTINCT doc_id) FROM g) AS examples, round(avg(pr), 9) AS macro_precision, round(avg(re), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, coalesce(string_agg(field, ',' ORDER BY field) FILTER (n < 1), '') AS low_support,
            (SELECT count(*) FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = q.doc_id AND g.field = q.field)) AS unsupported FROM r)
        SELECT CASE WHEN examples < 10 OR low_support <> '' THEN 'insufficient_data' WHEN least(macro_precision, macro_recall, macro_f1) >= 0.8 AND unsupported = 0 THEN 'pass' ELSE 'fail' END AS status, * FROM s""",
    ),
    "gold_problems": (
        gold_problems,
        """WITH e AS (SELECT l_orderkey AS k, bool_or(l_partkey % 97 = 0) AS q, bool_or(l_partkey % 97 > 0 AND l_partkey % 89 = 0) AS s, bool_or(l_partkey % 97 > 0 AND l_partkey % 89 > 0 AND l_partkey % 83 = 0) AS h,
            count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_returnflag) FILTER (l_partkey % 97 > 0) AS covered FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS example_id, CASE WHEN o_orderkey % 11 = 0 THEN 'excerpt_hash_mismatch' WHEN q THEN 'evidence_outside_fields' WHEN s THEN 'invalid_evidence_span' WHEN h THEN 'evidence_hash_mismatch' WHEN covered < flags OR o_orderkey % 13 = 0 THEN 'field_without_evidence'
        WHEN o_orderkey % 17 = 0 THEN 'invalid_review_state' WHEN o_orderkey % 3 = 0 AND (o_orderkey % 6 = 0 OR o_orderkey % 15 = 0) THEN 'verified_without_two_reviewers' END AS problem FROM orders LEFT JOIN e ON k = o_orderkey""",
    ),
    "field_totals": (
        field_totals,
        """WITH r AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'wrong' ELSE 'correct' END AS b, CASE WHEN c_custkey % 11 = 0 THEN 'missing' WHEN (c_custkey % 2 = 0) = (c_custkey % 4 < 2) THEN 'correct' ELSE 'wrong' END AS f, c_custkey % 3 = 0 AS q FROM customer)
        SELECT c AS bank, 1 + CAST(b = 'correct' AS INTEGER)::BIGINT + CAST(f = 'correct' AS INTEGER) AS correct, CAST(b = 'wrong' AS INTEGER)::BIGINT + CAST(f = 'wrong' AS INTEGER) AS wrong, CAST(b = 'missing' AS INTEGER)::BIGINT + CAST(f = 'missing' AS INTEGER) AS missing,
        CASE WHEN q THEN 2 ELSE 1 END::BIGINT AS quotes, 1::BIGINT AS grounded, CAST(f = 'wrong' AS INTEGER)::BIGINT AS inversions FROM r""",
    ),
    "context_notes": (
        context_notes,
        f"""WITH a AS (SELECT o_custkey * 10000 + year(o_orderdate) AS request, bool_or(o_orderkey % 31 < 2) AS channel, bool_or(o_orderkey % 37 = 0) AS newc, bool_or(o_orderkey % 41 = 0) AS mech, bool_or(o_orderkey % 13 = 0) AS sec, bool_or(o_orderkey % 5 = 0) AS dated,
            min(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'card' WHEN o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0 THEN 'unknown' ELSE 'financing' END) AS family FROM orders GROUP BY 1),
        n AS (SELECT request, list_filter([{", ".join("CASE WHEN NOT " + {"channel": "channel", "new_customer": "newc", "mechanism": "mech", "secured": "(sec OR family <> 'financing')", "validity": "dated"}[axis] + " THEN '" + text.replace("'", "''") + "' END" for axis, text in evaluation.NOTES)}], lambda x: x IS NOT NULL) AS notes FROM a JOIN {_GATE_SQL} USING (request) WHERE gate IS NULL)
        SELECT request, md5(array_to_string(notes, '|')) AS notes, CAST(len(notes) AS INTEGER) AS n FROM n""",
    ),
}
