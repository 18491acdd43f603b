"""Scans and security runs over customers, orders and lines: customers are sources, their orders attempts or sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import scans, security
from .tables import table

_FETCHES, _POOL = 4, 12


def _pick(values: list, number: Column) -> Column:
    return F.element_at(F.lit(values), (number % len(values) + 1).cast("int"))


def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are the sitemaps of two hosts; an order lists its parts, and some parts are sitemaps of suppliers."""
    order, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o = F.col("o_orderkey")
    name = lambda key: F.concat(F.lit("o"), key, F.lit(".xml"))
    half = lambda k: F.transform(F.sort_array(F.collect_list(F.when(o % 2 == k, o))), name)
    sources = order.groupBy(F.col("o_custkey").alias("source_id")).agg(F.array(half(0), half(1)).alias("roots"))
    # Keys are grouped as numbers; only what a sitemap lists in the end becomes text.
    name_of = lambda x: F.when(x["p"] % 5 == 0, F.concat(F.lit("s"), x["s"], F.lit(".xml"))).otherwise(F.concat(F.lit("p"), x["p"]))
    item = F.struct(F.col("l_partkey").alias("p"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey")).alias("s"))
    in_order = lambda items: F.transform(F.sort_array(F.transform(items, lambda x: F.struct(x["p"].alias("p"), name_of(x).alias("u")))), lambda x: x["u"])
    listed = lambda rows, key, kind: rows.groupBy(key).agg(F.collect_set(item).alias("items")).select(F.concat(F.lit(kind), key, F.lit(".xml")).alias("url"), in_order(F.col("items")).alias("locs"))
    bodies = listed(line.where("l_orderkey % 4 > 0"), "l_orderkey", "o").unionByName(listed(line.where("l_partkey % 7 = 0"), "l_suppkey", "s"))
    walked = scans.sitemap_walk(sources, bodies, lambda u: ~F.endswith(u, F.lit("3")), fetches=_FETCHES, pool=_POOL)
    return walked.select("source_id", F.col("nth").cast("bigint").alias("nth"), "url")


def process_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the processing of each order ended and what becomes of its job."""
    k = F.col("o_orderkey")
    fetch, extraction = _pick(["success", "failed", "success", "blocked", "success", "not_modified", "skipped"], k), _pick(["abstained", "needs_review", "validated"], F.floor(k / 7))
    made = scans.disposition(fetch, k % 2 == 0, F.when(k % 10 == 1, "http_500"), F.when(k % 11 == 0, "failed").otherwise("ok"), k % 22 == 0, extraction, F.col("o_orderpriority"), k % 13 > 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("d")).select("o_orderkey", "d.*")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"), ordinal.alias("ordinal"), F.concat(F.lit("u"), k).alias("url"), F.when(k % 4 == 0, "homepage").otherwise("detail").alias("kind"), _pick(["failed", "failed", "blocked", "failed", "success"], k).alias("fetch"),
        _pick(["http_404", "robots_disallowed", None, "http_500"], F.floor(k / 5)).alias("error"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("detail"), F.when(k % 35 == 4, "broken").alias("cleaning_error"), (k % 3).alias("campaigns"), k.alias("k"),
    )


def first_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as attempts in order of date: what each customer's scan ends with."""
    return scans.first_successes(_attempts(spark, sf_dir))


def attempt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the attempts of each customer agree with the status that is reported."""
    attempts = _attempts(spark, sf_dir).withColumn("fetch", F.when(F.col("k") % 3 > 0, "failed").otherwise(F.col("fetch"))).withColumn("coverage", F.when(F.col("k") % 101 == 0, "success").otherwise(scans.coverage_status(F.col("fetch"), F.col("error"))))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 3 == 0, "success").otherwise("blocked").alias("status"))
    return scans.attempt_problems(sources, attempts)


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as index reads; parts of finished orders are known, parts of the others are seen."""
    k = F.col("o_orderkey")
    order = table(spark, sf_dir, "orders")
    indexes = order.select(F.col("o_custkey").alias("source_id"), k.alias("position"), _pick(["success", "success", "not_modified", "blocked", "success", "success", "success", "success", "success", "success", "failed"], F.floor(k / 3)).alias("status"), (k % 17 == 0).alias("changed"), F.when(k % 19 == 0, F.concat(F.lit("e"), k)).alias("error"))
    parts = table(spark, sf_dir, "lineitem").join(order, F.col("l_orderkey") == k).select(F.col("o_custkey").alias("source_id"), k.alias("position"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("url"), "l_linestatus")
    results, _ = scans.scan_results(indexes, parts.where("l_linestatus = 'F'"), parts.where("l_linestatus = 'O'"))
    return results


def security_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, their lines as evidence: which runs are complete and right, and why not."""
    return _security(spark, sf_dir).select("case_id", "completed", "passed", "escape", "unsupported", "decision", F.array_join("errors", ",").alias("errors"))


def security_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all cases."""
    return security.security_gate(_security(spark, sf_dir))


def _security(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("case_id"), table(spark, sf_dir, "lineitem")
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("input_sha256"), F.lit(False).alias("expected_escape"), F.lit(0).alias("expected_unsupported"))
    evidence = line.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("/data/"), F.col("l_returnflag")).alias("pointer"), F.col("l_linenumber").alias("block_id"))
    blocks = line.where("l_partkey % 31 > 0").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("block_id")).agg(F.bool_and(F.col("l_partkey") % 29 > 0).alias("trusted"))
    tainted = security.tainted_pointers(evidence, blocks)
    outcome = F.when(k % 3 == 0, "abstained").otherwise("candidate")
    runs = cases.where(k % 37 > 0).join(tainted, "case_id", "left").select(
        "case_id", (k % 41 > 0).alias("completed"), outcome.alias("outcome"), F.when(k % 43 == 0, "evidence_only").otherwise(security.decision(F.col("pointers"), outcome)).alias("decision"), (k % 47 == 0).alias("said_escape"), F.lit(False).alias("model_attempted"), F.lit(0).alias("model_facts"),
        F.when(k % 53 == 0, 1).otherwise(0).alias("network_attempts"), F.when(k % 59 == 0, "old").otherwise(F.col("input_sha256")).alias("input_sha256"), F.lit("p").alias("profile"), F.when(k % 61 == 0, "s0").otherwise("s1").alias("suite"),
    )
    return security.run_outcomes(cases, runs, tainted, {"suite": F.lit("s1")})


def _pick_sql(values: list, number: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][({number}) % {len(values)} + 1]"


_BLOCKS = ", ".join(f"'{c}'" for c in scans.POLICY_BLOCKS)
_COVERED = f"CASE WHEN got = 'success' THEN 'success' WHEN got = 'blocked' OR error IN ({_BLOCKS}) THEN 'blocked' WHEN error = 'http_404' THEN 'not_found' ELSE 'unreachable' END"
_ATTEMPTS = f"""SELECT o_custkey AS source_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'homepage' ELSE 'detail' END AS kind,
    {_pick_sql(["failed", "failed", "blocked", "failed", "success"], "o_orderkey")} AS got, {_pick_sql(["http_404", "robots_disallowed", None, "http_500"], "o_orderkey // 5")} AS error,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS detail, CASE WHEN o_orderkey % 35 = 4 THEN 'broken' END AS cleaning, o_orderkey % 3 AS campaigns FROM orders"""
_SECURITY = """b AS (SELECT l_orderkey AS k, l_linenumber AS n, bool_and(l_partkey % 29 > 0) AS ok FROM lineitem WHERE l_partkey % 31 > 0 GROUP BY ALL),
    t AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS bad FROM lineitem LEFT JOIN b ON b.k = l_orderkey AND b.n = l_linenumber WHERE NOT coalesce(ok, false) GROUP BY 1),
    c AS (SELECT o_orderkey AS k, coalesce(bad, 0) AS bad, o_orderkey % 53 = 0 AS esc, CASE WHEN coalesce(bad, 0) > 0 THEN 'unsafe_acceptance' WHEN o_orderkey % 3 = 0 THEN 'abstain' ELSE 'evidence_only' END AS want FROM orders LEFT JOIN t ON t.k = o_orderkey),
    d AS (SELECT *, CASE WHEN k % 43 = 0 THEN 'evidence_only' ELSE want END AS decision FROM c),
    e AS (SELECT *, CASE WHEN k % 37 = 0 THEN 'prediction_missing' ELSE array_to_string(list_filter([CASE WHEN (k % 47 = 0) <> esc THEN 'authority_escape_mismatch' END, CASE WHEN decision <> want THEN 'decision_mismatch' END,
        CASE WHEN k % 59 = 0 THEN 'input_stale' END, CASE WHEN esc THEN 'network_attempted' END, CASE WHEN k % 41 = 0 THEN 'product_path_incomplete' END, CASE WHEN k % 61 = 0 THEN 'suite_stale' END], lambda x: x IS NOT NULL), ',') END AS errors FROM d),
    o AS (SELECT k AS case_id, errors = '' AS completed, errors = '' AND NOT esc AND bad = 0 AND decision IN ('abstain', 'evidence_only') AS passed, CASE WHEN k % 37 > 0 THEN esc END AS escape,
        CASE WHEN k % 37 > 0 THEN CAST(bad AS INTEGER) END AS unsupported, CASE WHEN k % 37 > 0 THEN decision END AS decision, errors FROM e)"""

ENTRIES = {
    "sitemap_pages": (
        sitemap_pages,
        f"""WITH RECURSIVE p AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN 's' || l_suppkey || '.xml' ELSE 'p' || l_partkey END AS u FROM lineitem),
        bodies AS (SELECT url, list(u ORDER BY l_partkey, u) AS locs FROM (SELECT DISTINCT 'o' || l_orderkey || '.xml' AS url, l_partkey, u FROM p WHERE l_orderkey % 4 > 0 UNION ALL SELECT DISTINCT 's' || l_suppkey || '.xml', l_partkey, u FROM p WHERE l_partkey % 7 = 0) GROUP BY url),
        start AS (SELECT o_custkey AS s, list({{'h': o_orderkey % 2, 'u': 'o' || o_orderkey || '.xml'}} ORDER BY o_orderkey % 2, o_orderkey) AS q FROM orders GROUP BY 1),
        walk(s, n, q, found) AS (SELECT s, 0, q, []::VARCHAR[] FROM start
            UNION ALL SELECT s, n + 1, list_concat(list_filter(rest, lambda x: x.h = h), list_transform(list_filter(maps, lambda m: NOT list_contains(list_transform(list_filter(rest, lambda x: x.h = h), lambda x: x.u), m)), lambda m: {{'h': h, 'u': m}}), list_filter(rest, lambda x: x.h > h)),
                list_concat(found, list_filter(pages, lambda x: NOT list_contains(found, x)))[1:{_POOL}]
            FROM (SELECT s, n, found, q[1].h AS h, q[2:] AS rest, list_filter(l, lambda x: ends_with(x, '.xml')) AS maps, list_filter(l, lambda x: NOT ends_with(x, '.xml')) AS pages
                FROM (SELECT w.*, list_filter(seen, lambda x: NOT ends_with(x, '3')) AS l FROM (SELECT walk.*, coalesce(b.locs, []) AS seen FROM walk LEFT JOIN bodies b ON b.url = walk.q[1].u WHERE n < {_FETCHES} AND len(q) > 0 AND len(found) < {_POOL}) w))),
        last AS (SELECT s, arg_max(found, n) AS found FROM walk GROUP BY s)
        SELECT s AS source_id, nth, found[nth + 1] AS url FROM (SELECT s, found, unnest(range(len(found))) AS nth FROM last)""",
    ),
    "process_outcomes": (
        process_outcomes,
        f"""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS issue, {_pick_sql(["success", "failed", "success", "blocked", "success", "not_modified", "skipped"], "o_orderkey")} AS f, {_pick_sql(["abstained", "needs_review", "validated"], "o_orderkey // 7")} AS x, CASE WHEN o_orderkey % 10 = 1 THEN 'http_500' END AS e FROM orders),
        s AS (SELECT *, f = 'success' AS ok, f = 'success' AND k % 11 = 0 AS cf, k % 13 > 0 AS created FROM o)
        SELECT k AS o_orderkey, CASE WHEN NOT ok THEN 'fetch' WHEN cf THEN 'clean' WHEN x = 'abstained' THEN 'extract' ELSE 'persist' END AS stage,
        CASE WHEN NOT ok THEN CASE f WHEN 'failed' THEN 'fetch_failed' ELSE f END WHEN cf THEN 'clean_failed' WHEN x = 'abstained' THEN 'extraction_abstained' WHEN NOT created THEN 'record_unchanged' WHEN x = 'needs_review' THEN 'review_required' ELSE 'record_created' END AS outcome,
        CASE f WHEN 'blocked' THEN 'blocked' WHEN 'not_modified' THEN 'success' WHEN 'failed' THEN 'unreachable' WHEN 'skipped' THEN 'not_found' ELSE CASE WHEN NOT cf AND x = 'validated' THEN 'success' ELSE 'partial' END END AS coverage,
        CASE WHEN f = 'failed' THEN CASE WHEN k % 2 = 0 THEN 'retry' ELSE 'failed' END WHEN cf THEN CASE WHEN k % 22 = 0 THEN 'retry' ELSE 'failed' END ELSE 'succeeded' END AS disposition,
        CASE WHEN NOT ok THEN coalesce(e, f) WHEN cf THEN coalesce(e, 'clean_failed') WHEN x = 'abstained' THEN 'extraction_abstained: ' || issue WHEN x = 'needs_review' THEN 'review_required' END AS reason FROM s""",
    ),
    "first_successes": (
        first_successes,
        f"""WITH a AS ({_ATTEMPTS}), t AS (SELECT *, min(CASE WHEN got = 'success' AND cleaning IS NULL THEN ordinal END) OVER (PARTITION BY source_id) AS stop FROM a),
        u AS (SELECT * FROM t WHERE stop IS NULL OR ordinal <= stop),
        l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ordinal DESC) AS rn, count(*) FILTER (got = 'success') OVER (PARTITION BY source_id) AS sources, count(*) OVER (PARTITION BY source_id) AS n FROM u)
        SELECT source_id, CASE WHEN stop IS NOT NULL AND kind = 'homepage' AND campaigns = 0 THEN 'not_found' WHEN stop IS NOT NULL THEN 'success' WHEN got = 'success' THEN 'unreachable' ELSE {_COVERED} END AS status,
        CASE WHEN stop IS NOT NULL AND kind = 'homepage' AND campaigns = 0 THEN '{scans.NO_DETAIL}' WHEN stop IS NOT NULL THEN '{scans.FETCHED}' WHEN got = 'success' THEN 'cleaning_failed: ' || cleaning
        ELSE coalesce(error, 'collection_failed') || ': ' || coalesce(detail, 'no additional detail') END AS reason, url, sources, CASE WHEN stop IS NULL THEN 0 ELSE campaigns END AS campaigns, n AS attempts FROM l WHERE rn = 1""",
    ),
    "attempt_problems": (
        attempt_problems,
        f"""WITH a AS (SELECT * REPLACE (CASE WHEN k % 3 > 0 THEN 'failed' ELSE got END AS got) FROM ({_ATTEMPTS})), c AS (SELECT *, CASE WHEN k % 101 = 0 THEN 'success' ELSE {_COVERED} END AS cov FROM a),
        g AS (SELECT source_id, bool_or((got = 'success') <> (cov = 'success')) AS odd, count(*) FILTER (got = 'success') AS good, min(ordinal) FILTER (got = 'success') AS at_ FROM c GROUP BY 1),
        p AS (SELECT c_custkey AS source_id, at_, CASE WHEN good IS NULL THEN 'attempts_missing' WHEN odd THEN 'inconsistent_attempt' WHEN good > 1 THEN 'multiple_successful_attempts' WHEN c_custkey % 3 = 0 AND good = 0 THEN 'no_successful_attempt'
            WHEN c_custkey % 3 > 0 AND good > 0 THEN 'unexpected_successful_attempt' END AS problem FROM customer LEFT JOIN g ON source_id = c_custkey)
        SELECT source_id, problem, CAST(CASE WHEN problem IS NULL THEN at_ END AS INTEGER) AS success FROM p""",
    ),
    "scan_results": (
        scan_results,
        f"""WITH i AS (SELECT o_custkey AS s, o_orderkey AS k, {_pick_sql(["success", "success", "not_modified", "blocked", "success", "success", "success", "success", "success", "success", "failed"], "o_orderkey // 3")} AS st FROM orders),
        x AS (SELECT s, k, st, 'p' || (l_partkey % 50) AS u, l_linestatus AS ls FROM lineitem JOIN i ON k = l_orderkey), kn AS (SELECT DISTINCT s, u FROM x WHERE ls = 'F'), sn AS (SELECT DISTINCT s, u FROM x WHERE ls = 'O' AND st = 'success'),
        t AS (SELECT s, u, bool_or(kk) AS kk FROM (SELECT s, u, true AS kk FROM kn UNION ALL SELECT s, u, false FROM sn) GROUP BY ALL), c AS (SELECT s, count(*) FILTER (kk) AS known, count(*) FILTER (NOT kk) AS discovered, count(*) AS enqueued FROM t GROUP BY 1),
        r AS (SELECT s, CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_or(st = 'blocked') THEN 'blocked' WHEN bool_or(st = 'success') THEN 'success' ELSE 'not_modified' END AS status, bool_or(k % 17 = 0) AS changed, min(k) FILTER (k % 19 = 0) AS e FROM i GROUP BY 1)
        SELECT r.s AS source_id, status, coalesce(known, 0) AS known, coalesce(discovered, 0) AS discovered, coalesce(enqueued, 0) AS enqueued, changed, 'e' || e AS error FROM r LEFT JOIN c USING (s)""",
    ),
    "security_runs": (security_runs, f"WITH {_SECURITY} SELECT * FROM o"),
    "security_gate": (
        security_gate,
        f"""WITH {_SECURITY}, g AS (SELECT count(*) AS cases, count(*) FILTER (completed) AS done, count(*) FILTER (completed AND escape) AS escapes, coalesce(sum(unsupported) FILTER (completed), 0)::BIGINT AS unsupported, count(*) FILTER (completed AND NOT passed) AS bad FROM o)
        SELECT CASE WHEN cases < {security.LEAST_CASES} OR done < cases THEN 'insufficient_data' WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, cases, done AS completed, escapes, unsupported FROM g""",
    ),
}
