"""Operational queries over events, labels and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import operations as ops
from .tables import table


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: the type stands for the step, the value's parity for a stale fence."""
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'complete' ELSE 'fail' END")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kinds.alias("event"), (F.col("event_id") % 40).alias("fence"))


def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.job_state(_jobs(spark, sf_dir), "user_id", "ts", [F.asc("event_id")])


def session_idle_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after 3 idle hours, or 8 hours after they began; each event counts as seen."""
    seconds = F.expr("unix_seconds(CAST(ts AS TIMESTAMP))")
    marked = ops.capped_sessions(table(spark, sf_dir, "events"), "user_id", seconds, [F.asc("event_id")], 3 * ops.HOUR, 8 * ops.HOUR, 0)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row of each user, and the wait that follows."""
    events = ops.failures_in_a_row(table(spark, sf_dir, "events"), "user_id", [F.asc("ts"), F.asc("event_id")], F.col("event_type").isin("error", "click", "view"))
    return events.select("event_id", F.col("streak").cast("bigint").alias("streak"), ops.lockout_seconds(F.col("streak")).alias("wait"))


def registry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as its monitored sources."""
    sources = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("bank"), F.when(F.col("s_acctbal") < 0, "unavailable").otherwise("verified").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, "static_pages").otherwise("detail_links").alias("mode"),
        (F.col("s_suppkey") % 30).cast("string").alias("index_url"),
    )
    return ops.registry_problems(sources)


def merged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' decisions on documents: the labels, and a rule on the length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = labels.select("doc_id", F.col("quality").alias("decision"), F.lit(1).alias("reviewed_at"))
    second = docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("decision"), F.lit(2).alias("reviewed_at"))
    found = ops.merged_reviews(docs.where("doc_id % 5 <> 0").select("doc_id"), first, second, "doc_id")
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.max("reviewed_at").cast("bigint").alias("latest"))


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set-valued fields: the flags and the statuses of an order's lines, gold from early ones and predicted from cheap ones."""
    line = table(spark, sf_dir, "lineitem")
    long = lambda df: df.select("l_orderkey", F.explode(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))).alias("field", "v"))
    sets = lambda df: long(df).groupBy("l_orderkey", "field").agg(F.collect_set("v").alias("values"))
    found = ops.gold_scores(sets(line.where("l_linenumber <= 3")), sets(line.where("l_extendedprice < 50000")), "l_orderkey")
    return found.select("field", "tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that aren't among the customers of the first segment's list."""
    nodes = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), F.col("user_id").alias("target"))
    return ops.dangling_links(nodes, edges).select("source", "target")


def files_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each source's documents."""
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("number"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("sha256"))
    return ops.files_digest(files, ["source"])


def select_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No document has both words, so those with one of them answer."""
    from ..functions.text import words

    docs = table(spark, sf_dir, "documents").withColumn("tokens", words(F.col("text")))
    found = ops.select_relevant(docs, F.col("tokens"), ["stupid", "nowhereatall"], False, 3 * (F.col("n_chars") > 1000).cast("int") + F.col("_hits"), "n_chars", "doc_id", 15)
    return found.select("doc_id", F.col("_hits").cast("bigint").alias("hits"))


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fetches: types stand for the states, a low value for a retryable failure."""
    states = F.expr("CASE event_type WHEN 'view' THEN 'not_modified' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'blocked' ELSE 'success' END")
    fetches = table(spark, sf_dir, "events").select("event_id", states.alias("status"), (F.col("value") < 30).alias("retryable"), F.when(F.col("value") > 60, "timeout").alias("error_code"))
    return ops.fetch_outcomes(fetches).select("event_id", "outcome", "coverage", "disposition", "reason")


def new_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the pages' addresses, without those that the labelled documents' ids stand for in the queue."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("b"), (F.col("page_id") % 7).cast("string")).alias("bank"), "url", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("c"), F.col("page_id"))).alias("campaign_key"), "page_id")
    queued = ops.source_requests(pages.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi"), "v1")
    return ops.new_requests(pages.drop("page_id"), "v1", queued).select("dedupe_key", "campaign_key")


def observation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations: some without a scan, some without any identity, some with another key."""
    k = F.col("o_orderkey")
    seen = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("s"), F.col("o_custkey"))).alias("scan_run_id"), F.when(k % 7 > 0, F.concat(F.lit("j"), k)).alias("job_id"), F.col("o_orderpriority").alias("campaign_key"),
        F.concat(F.lit("https://a.test/"), k).alias("url"),
    )
    key = F.when(F.col("id") % 4 == 0, F.sha2(F.concat_ws("\u0000", F.coalesce("scan_run_id", "job_id"), F.col("campaign_key"), F.col("url")), 256)).when(F.col("id") % 4 == 1, "other")
    return ops.observation_problems(seen.withColumn("observation_key", key)).select("id", "identity", "expected_key", "problem")


def eligible_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as banks, suppliers in credit as their verified sources."""
    banks = table(spark, sf_dir, "nation").select(F.col("n_name").alias("bank"), "n_nationkey")
    sources = table(spark, sf_dir, "supplier").join(banks, F.col("s_nationkey") == F.col("n_nationkey")).select("bank", (F.col("s_acctbal") > 5000).alias("verified"))
    return ops.eligible_banks(banks, sources, ["NATION_1", "NATION_3"]).select("bank")


_JOBS_SQL = """(SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS event, event_id % 40 AS fence FROM events)"""

ENTRIES = {
    "fetch_outcomes": (
        fetch_outcomes,
        """SELECT event_id, CASE event_type WHEN 'view' THEN 'not_modified' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'fetch_failed' WHEN 'purchase' THEN 'blocked' END AS outcome,
        CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'not_found' WHEN 'error' THEN 'unreachable' WHEN 'purchase' THEN 'blocked' END AS coverage,
        CASE WHEN event_type = 'error' THEN CASE WHEN value < 30 THEN 'retry' ELSE 'failed' END WHEN event_type IN ('view', 'click', 'purchase') THEN 'succeeded' END AS disposition,
        CASE WHEN event_type IN ('view', 'click', 'error', 'purchase') THEN CASE WHEN value > 60 THEN 'timeout'
        ELSE CASE event_type WHEN 'view' THEN 'not_modified' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'blocked' END END END AS reason FROM events""",
    ),
    "new_requests": (
        new_requests,
        """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN 'c' || page_id ELSE 'b' || page_id % 7 || ':' || substr(sha256(url), 1, 24) END AS campaign_key FROM pages),
        k AS (SELECT *, sha256('v1' || chr(0) || campaign_key || chr(0) || url) AS dedupe_key FROM p)
        SELECT DISTINCT dedupe_key, campaign_key FROM k WHERE dedupe_key NOT IN (SELECT dedupe_key FROM k SEMI JOIN labels ON doc_id = page_id)""",
    ),
    "observation_problems": (
        observation_problems,
        """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_custkey WHEN o_orderkey % 7 > 0 THEN 'j' || o_orderkey END AS identity, o_orderpriority AS c FROM orders),
        k AS (SELECT *, sha256(identity || chr(0) || c || chr(0) || 'https://a.test/' || id) AS expected_key FROM o)
        SELECT id, identity, expected_key, CASE WHEN identity IS NULL THEN 'identity_missing' WHEN id % 4 = 1 THEN 'observation_key_differs' END AS problem FROM k""",
    ),
    "eligible_banks": (
        eligible_banks,
        "SELECT n_name AS bank FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_3') AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)",
    ),
    "job_state": (
        job_state,
        f"""WITH c AS (SELECT *, count(*) FILTER (event = 'claim') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS claims FROM {_JOBS_SQL}),
        v AS (SELECT * FROM c WHERE event = 'claim' OR fence = claims),
        g AS (SELECT user_id, max(claims) AS attempts, arg_max(event, (ts, claims, event)) AS last, bool_or(event = 'complete') AS done FROM v GROUP BY user_id)
        SELECT user_id, CASE WHEN done THEN 'completed' WHEN last = 'fail' AND attempts >= 3 THEN 'dead' WHEN last = 'fail' THEN 'retry' ELSE 'running' END AS status, attempts FROM g""",
    ),
    "session_idle_cap": (
        session_idle_cap,
        """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) // 1000000 AS s FROM events),
        a AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 10800 THEN 0 ELSE 1 END AS st FROM e),
        b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS idle FROM a),
        starts AS (SELECT user_id, idle, min(s) AS s FROM b GROUP BY ALL
            UNION ALL SELECT n.user_id, n.idle, min(b.s) FROM starts n JOIN b ON b.user_id = n.user_id AND b.idle = n.idle AND b.s >= n.s + 28800 GROUP BY n.user_id, n.idle),
        m AS (SELECT b.user_id, b.event_id, max(n.s) AS began FROM b JOIN starts n ON n.user_id = b.user_id AND n.idle = b.idle AND n.s <= b.s GROUP BY ALL)
        SELECT user_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY began) AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM m GROUP BY user_id, began""",
    ),
    "lockouts": (
        lockouts,
        """WITH e AS (SELECT *, event_type IN ('error', 'click', 'view') AS bad FROM events),
        r AS (SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM e),
        s AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM r)
        SELECT event_id, streak, CAST(CASE WHEN streak >= 10 THEN 900 WHEN streak >= 5 THEN 30 * pow(2, streak - 5) ELSE 0 END AS BIGINT) AS wait FROM s""",
    ),
    "registry_problems": (
        registry_problems,
        """WITH s AS (SELECT s_nationkey AS bank, s_acctbal < 0 AS off, s_suppkey % 4 = 0 AS st, s_suppkey % 30 AS u FROM supplier),
        g AS (SELECT bank, count(*) FILTER (st) AS n, count(*) AS a, count(DISTINCT u) AS d, bool_or(off) AS off, bool_or(NOT off) AS onn FROM s GROUP BY bank)
        SELECT bank, 'several_static_sources' AS problem FROM g WHERE n > 1 UNION ALL SELECT bank, 'index_url_repeated' FROM g WHERE a > d UNION ALL SELECT bank, 'unavailable_with_verified' FROM g WHERE off AND onn""",
    ),
    "merged_reviews": (
        merged_reviews,
        """WITH k AS (SELECT doc_id, true AS known FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id, quality AS a FROM labels),
        b AS (SELECT doc_id, CAST(n_chars > 500 AS INTEGER) AS b FROM documents WHERE doc_id % 3 <> 0),
        j AS (SELECT CASE WHEN known IS NULL THEN 'unknown' WHEN a IS NULL OR b IS NULL THEN 'incomplete' WHEN a = b THEN 'agreed' ELSE 'disagreed' END AS outcome,
        CASE WHEN b IS NOT NULL THEN 2 WHEN a IS NOT NULL THEN 1 END AS seen FROM k FULL JOIN a USING (doc_id) FULL JOIN b USING (doc_id))
        SELECT outcome, count(*) AS n, CAST(max(seen) AS BIGINT) AS latest FROM j GROUP BY 1""",
    ),
    "gold_scores": (
        gold_scores,
        """WITH g AS (SELECT DISTINCT l_orderkey, 'flag' AS field, l_returnflag AS v FROM lineitem WHERE l_linenumber <= 3 UNION SELECT l_orderkey, 'status', l_linestatus FROM lineitem WHERE l_linenumber <= 3),
        p AS (SELECT DISTINCT l_orderkey, 'flag' AS field, l_returnflag AS v FROM lineitem WHERE l_extendedprice < 50000 UNION SELECT l_orderkey, 'status', l_linestatus FROM lineitem WHERE l_extendedprice < 50000),
        j AS (SELECT field, g.a AS a, p.b AS b FROM (SELECT *, 1 AS a FROM g) g FULL JOIN (SELECT *, 1 AS b FROM p) p USING (l_orderkey, field, v)),
        c AS (SELECT field, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM j GROUP BY field)
        SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM c""",
    ),
    "dangling_links": (dangling_links, "SELECT event_id AS source, user_id AS target FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "files_digest": (
        files_digest,
        """WITH l AS (SELECT source, doc_id // 4096 AS leaf, sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY ALL)
        SELECT source, sha256(string_agg(h, chr(10) ORDER BY leaf)) AS digest FROM l GROUP BY source""",
    ),
    "select_relevant": (
        select_relevant,
        r"""WITH d AS (SELECT doc_id, n_chars, list_contains(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), 'stupid') AS hit FROM documents)
        SELECT doc_id, CAST(1 AS BIGINT) AS hits FROM d WHERE hit ORDER BY 3 * CAST(n_chars > 1000 AS INTEGER) + 1 DESC, n_chars DESC, doc_id LIMIT 15""",
    ),
}
