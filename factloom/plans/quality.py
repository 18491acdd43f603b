"""Reports, gates, coverage, leakage and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .tables import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted field values: labels, and a rule over the same documents; some aren't stated."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    gold = labels.select("doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("field", "value"))
    gold = gold.where("NOT (field = 'toxic' AND doc_id % 11 = 0)")
    rule = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(
        "doc_id",
        F.explode(F.create_map(F.lit("quality"), (F.col("n_chars") > 400).cast("int"), F.lit("toxic"), (F.col("lang") == "en").cast("int"))).alias("field", "value"),
    )
    return gold, rule.where("NOT (field = 'quality' AND doc_id % 7 = 0)")


_GOLD_SQL = """(SELECT doc_id, 'quality' AS field, CAST(quality AS INTEGER) AS g FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE doc_id % 11 <> 0)"""
_PRED_SQL = """(SELECT doc_id, 'quality' AS field, CAST(n_chars > 400 AS INTEGER) AS p FROM documents SEMI JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0
    UNION ALL SELECT doc_id, 'toxic', CAST(lang = 'en' AS INTEGER) FROM documents SEMI JOIN labels USING (doc_id))"""


def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = _sides(spark, sf_dir)
    found = metrics.field_report(gold, predicted, ["doc_id"], "field", "value")
    return found.select("field", "tp", "fp", "fn", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities against a rule over the price: one-vs-rest over both sides' labels."""
    orders = table(spark, sf_dir, "orders")
    predicted = F.when(F.col("o_totalprice") > 300000, "1-URGENT").when(F.col("o_totalprice") > 150000, "2-HIGH").when(F.col("o_totalprice") > 50000, "6-NONE").otherwise("5-LOW")
    found = metrics.class_report(orders.select(F.col("o_orderpriority").alias("gold"), predicted.alias("pred")), "gold", "pred")
    return found.select("label", *(F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "support")), *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate per language (share of good documents, least support), and the worst one over all."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    per = joined.groupBy("lang").agg(F.count("*").alias("support"), F.avg("quality").alias("value"))
    gated = per.select("lang", "support", metrics.gate(F.col("value"), F.col("support"), 0.85, 40).alias("status"))
    total = gated.agg(F.lit("*").alias("lang"), F.sum("support").alias("support"), metrics.worst_gate(F.col("status")).alias("status"))
    return gated.unionByName(total)


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of the latest snapshot per source."""
    from ..operators.asof import latest_as_of

    latest = latest_as_of(table(spark, sf_dir, "events"), ["user_id"], "ts", None, [F.desc("event_id")])
    return latest.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


def referential_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events against all customers: missing and unknown ones."""
    required = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    present = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return metrics.uncovered(required, present, ["id"])


def duplicate_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and exact median by type, best and worst user."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min_by("event_id", F.struct("value", "event_id")).alias("best"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("worst"),
    )


def distinct_urls_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts: parts by supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))


def validation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of a rule table (status by segment) against what a record states."""
    from ..operators.validation import apply_matrix

    rules = spark.createDataFrame(
        [("O", "BUILDING", ["priority", "price"], ["early"]), ("O", "*", ["price"], []), ("P", "*", ["price", "early"], ["priority", "late"]), ("F", "*", [], ["early", "late"])],
        "family string, kind string, all_of array<string>, any_of array<string>",
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    stated = F.array_compact(
        F.array(
            F.when(F.col("o_orderpriority") < "3", "priority"), F.when(F.col("o_totalprice") > 200000, "price"),
            F.when(F.year("o_orderdate") < 1997, "early"), F.when(F.year("o_orderdate") > 1999, "late"),
        )
    )
    found = apply_matrix(orders.select("o_orderkey", F.col("o_orderstatus").alias("family"), F.col("c_mktsegment").alias("kind"), stated.alias("stated")), rules)
    return found.select("o_orderkey", F.array_join("missing", ",").alias("missing"), "valid")


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a Jaccard similarity of their words of 0.85 or more.

    Pairs are between documents of different words, plus each copy with its representative.
    """
    return metrics.jaccard_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 0.85).select("left_id", "right_id", F.round("score", 9).alias("score"))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of near duplicates whose documents are in different splits (the id modulo 3), copies included."""
    return metrics.leakage(table(spark, sf_dir, "documents"), "doc_id", "text", 0.85, lambda i: i % 3, [0, 1, 2])


_F1 = """round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 9) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"""
_PAIRS_SQL = r"""(WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+'))) AS s FROM documents),
    g AS (SELECT s, min(doc_id) AS rep FROM t GROUP BY s), copies AS (SELECT rep AS left_id, doc_id AS right_id, 1.0 AS score FROM t JOIN g USING (s) WHERE doc_id <> rep),
    r AS (SELECT rep, s, len(s) AS n FROM g WHERE len(s) > 0), e AS (SELECT rep, n, unnest(s) AS w FROM r),
    c AS (SELECT a.rep AS l, b.rep AS r, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.rep < b.rep AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL)
    SELECT l AS left_id, r AS right_id, k / (an + bn - k) AS score FROM c WHERE k / (an + bn - k) >= 0.85 UNION ALL SELECT * FROM copies)"""

_LEAKS_SQL = r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+'))) AS s FROM documents),
    g AS (SELECT s, min(doc_id) AS rep FROM t GROUP BY s), m AS (SELECT doc_id, rep FROM t JOIN g USING (s)),
    r AS (SELECT rep, s, len(s) AS n FROM g WHERE len(s) > 0), e AS (SELECT rep, n, unnest(s) AS w FROM r),
    c AS (SELECT a.rep AS l, b.rep AS r, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.w = b.w AND a.rep < b.rep AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL),
    k AS (SELECT l, r FROM c WHERE k / (an + bn - k) >= 0.85 UNION ALL SELECT rep, rep FROM g),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k JOIN m a ON a.rep = k.l JOIN m b ON b.rep = k.r WHERE k.l <> k.r OR a.doc_id < b.doc_id)
    SELECT least(x, y) % 3 AS split_a, greatest(x, y) % 3 AS split_b, count(*) AS n FROM p WHERE x % 3 <> y % 3 GROUP BY ALL"""

ENTRIES = {
    "field_report": (
        field_report,
        f"""WITH j AS (SELECT field, g, p FROM {_GOLD_SQL} FULL JOIN {_PRED_SQL} USING (doc_id, field)),
        c AS (SELECT field, count(*) FILTER (g = p) AS tp, count(*) FILTER (p IS NOT NULL AND NOT coalesce(g = p, false)) AS fp,
        count(*) FILTER (g IS NOT NULL AND NOT coalesce(g = p, false)) AS fn, count(g) AS support FROM j GROUP BY field) SELECT *, {_F1} FROM c""",
    ),
    "class_report": (
        class_report,
        f"""WITH o AS (SELECT o_orderpriority AS gold, CASE WHEN o_totalprice > 300000 THEN '1-URGENT' WHEN o_totalprice > 150000 THEN '2-HIGH' WHEN o_totalprice > 50000 THEN '6-NONE' ELSE '5-LOW' END AS pred FROM orders),
        l AS (SELECT gold AS label FROM o UNION SELECT pred FROM o),
        c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp,
        count(*) FILTER (gold = label AND pred <> label) AS fn FROM l CROSS JOIN o GROUP BY label) SELECT *, tp + fn AS support, {_F1} FROM c""",
    ),
    "gate_status": (
        gate_status,
        """WITH p AS (SELECT lang, count(*) AS support, avg(quality) AS v FROM labels JOIN documents USING (doc_id) GROUP BY lang),
        g AS (SELECT lang, support, CASE WHEN support < 40 THEN 'insufficient_data' WHEN v >= 0.85 THEN 'pass' ELSE 'fail' END AS status FROM p)
        SELECT * FROM g UNION ALL SELECT '*', CAST(sum(support) AS BIGINT), arg_min(status, CASE status WHEN 'fail' THEN 0 WHEN 'insufficient_data' THEN 1 ELSE 2 END) FROM g""",
    ),
    "coverage_gate": (
        coverage_gate,
        """SELECT event_type AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 GROUP BY 1""",
    ),
    "referential_completeness": (
        referential_completeness,
        """WITH r AS (SELECT c_custkey AS id FROM customer), p AS (SELECT DISTINCT user_id AS id FROM events)
        SELECT id, 'missing' AS problem FROM r ANTI JOIN p USING (id) UNION ALL SELECT id, 'unknown' FROM p ANTI JOIN r USING (id)""",
    ),
    "duplicate_preflight": (duplicate_preflight, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "latency_summary": (
        latency_summary,
        """SELECT event_type, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median, arg_min(event_id, (value, event_id)) AS best, arg_max(event_id, (value, event_id)) AS worst
        FROM events GROUP BY event_type""",
    ),
    "distinct_urls_per_source": (distinct_urls_per_source, "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "validation_matrix": (
        validation_matrix,
        """WITH s AS (SELECT o_orderkey, o_orderstatus, c_mktsegment, list_filter([CASE WHEN o_orderpriority < '3' THEN 'priority' END, CASE WHEN o_totalprice > 200000 THEN 'price' END,
        CASE WHEN year(o_orderdate) < 1997 THEN 'early' END, CASE WHEN year(o_orderdate) > 1999 THEN 'late' END], lambda x: x IS NOT NULL) AS st FROM orders JOIN customer ON o_custkey = c_custkey),
        r AS (SELECT *, CASE WHEN o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' THEN ['price', 'priority'] WHEN o_orderstatus = 'O' THEN ['price'] WHEN o_orderstatus = 'P' THEN ['early', 'price'] ELSE [] END AS al,
        CASE WHEN o_orderstatus = 'O' AND c_mktsegment = 'BUILDING' THEN ['early'] WHEN o_orderstatus = 'O' THEN [] WHEN o_orderstatus = 'P' THEN ['priority', 'late'] ELSE ['early', 'late'] END AS an FROM s),
        m AS (SELECT *, list_filter(al, lambda x: NOT list_contains(st, x)) AS miss FROM r)
        SELECT o_orderkey, array_to_string(list_sort(miss), ',') AS missing, len(miss) = 0 AND (len(an) = 0 OR list_has_any(an, st)) AS valid FROM m""",
    ),
    "near_duplicate_pairs": (near_duplicate_pairs, f"SELECT left_id, right_id, round(score, 9) AS score FROM {_PAIRS_SQL}"),
    "split_leakage": (split_leakage, _LEAKS_SQL),
}
