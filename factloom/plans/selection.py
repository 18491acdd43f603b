"""As-of selection, filters, facets, pages and joins, bound to orders, customers, parts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, facets, filters, paging, versioning
from .tables import table

AS_OF = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"
DAY = "DATE '1998-06-15'"


def _ties():
    return [F.asc("o_orderkey")]


def _latest_orders(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return asof.latest_as_of(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", F.expr(AS_OF), _ties(), **kw)


def latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def latest_hidden_if_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_orders(spark, sf_dir, visible=F.col("o_orderstatus") != "F").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def latest_snapshot_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = asof.latest_as_of(table(spark, sf_dir, "events"), ["event_type"], "ts", None, [F.desc("event_id")])
    return latest.select("event_type", "event_id", "user_id", "value")


def version_at_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the order of the same customer that was the newest when an order was placed, itself left out."""
    orders = table(spark, sf_dir, "orders")
    requests = orders.select(F.col("o_orderkey").alias("request_id"), "o_custkey", F.col("o_orderdate").alias("at"))
    versions = orders.select("o_custkey", "o_orderkey", "o_orderdate")
    found = asof.versions_as_of(requests, versions, "o_custkey", "at", "o_orderdate", _ties(), strict=True)
    return found.select("request_id", F.col("o_orderkey").alias("version_id"))


def three_way_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record with its source and its document: orders, customers, nations."""
    return (
        _latest_orders(spark, sf_dir, visible=F.col("o_orderstatus") != "F")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "n_name", "c_mktsegment", "o_totalprice")
    )


def active_source_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose document and record agree on their source: suppliers and customers of one nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .groupBy("s_nationkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_records"))
    )


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five facets over the filtered latest set: nation, status, priority (multi-valued casings) and segment."""
    base = _latest_orders(spark, sf_dir, visible=F.col("o_orderstatus") != "F").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    single = {"nation": F.col("c_nationkey"), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    casing = F.when(F.col("o_orderkey") % 3 == 0, F.initcap("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    multi = {"segment": F.array(casing, F.lower("o_orderpriority")), "channel": F.array(F.lower("o_orderstatus"), F.col("o_orderstatus"))}
    return facets.facet_counts(base, single, multi)


def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent casing of a type's brands, ties to the smallest."""
    part = table(spark, sf_dir, "part").withColumn("label", F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")))
    counts = part.groupBy(F.lower("label").alias("value"), "label").agg(F.count("*").alias("n"))
    return facets.dominant(counts, ["value"], "label", "n").select("value", "label", "n")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity windows from an order's lines; some bounds aren't stated."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    return line.select(
        "l_orderkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("lo")).alias("starts_on"), F.when(F.col("l_orderkey") % 7 != 0, F.col("hi")).alias("ends_on")
    )


_WINDOWS_SQL = """(SELECT l_orderkey, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(min(l_shipdate) AS DATE) END AS starts_on,
    CASE WHEN l_orderkey % 7 <> 0 THEN CAST(max(l_shipdate) AS DATE) END AS ends_on FROM lineitem GROUP BY l_orderkey)"""
_BUCKET_SQL = {
    "active": f"(starts_on IS NULL OR starts_on <= {DAY}) AND (ends_on IS NULL OR ends_on >= {DAY}) AND (starts_on IS NOT NULL OR ends_on IS NOT NULL)",
    "upcoming": f"starts_on > {DAY}", "expired": f"ends_on < {DAY}", "unknown": "starts_on IS NULL AND ends_on IS NULL",
}


def _bucket(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _windows(spark, sf_dir).where(filters.validity(F.col("starts_on"), F.col("ends_on"), F.expr(DAY), name)).select("l_orderkey")

    return run


def array_membership_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have a segment in any casing."""
    customer = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set(F.initcap("c_mktsegment")).alias("segments"), F.count("*").alias("n"))
    return customer.where(filters.contains_ci(F.col("segments"), "MACHINERY")).select("c_nationkey", "n")


def json_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(k == 42).select("event_id", "event_type")


def conjunctive_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}
    return table(spark, sf_dir, "orders").where(filters.equal_filters(wanted)).select("o_orderkey", "o_custkey")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of 50 behind a cursor, and one row more."""
    base = _latest_orders(spark, sf_dir)
    cursor = (F.expr("TIMESTAMP_NTZ '1999-10-01 00:00:00'"), F.lit(100))
    return paging.keyset_page(base, "o_orderdate", "o_orderkey", 50, cursor).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed"))


def feed_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.feed_after(table(spark, sf_dir, "events"), "event_id", 500, 100).select("event_id", "user_id", "event_type")


def evidence_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a page's records only: lines of the latest urgent orders."""
    page = _latest_orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    found = asof.evidence_by_record(page, line, part, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "p_brand"])
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["l_linenumber"].cast("string"), e["l_partkey"].cast("string"), e["p_brand"])), ",")
    return found.select("l_orderkey", F.size("evidence").cast("bigint").alias("n"), shown.alias("evidence"))


def restore_caller_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the first place at which a list of ids (the orders) mentions them."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("c_custkey"))
    return asof.in_caller_order(table(spark, sf_dir, "customer"), wanted, "c_custkey").select("c_custkey", "position", "c_name")


def left_join_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications with their campaign's title where one is known."""
    titles = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), "c_name")
    return table(spark, sf_dir, "events").where("event_type = 'signup'").join(titles, "user_id", "left").select("event_id", F.coalesce("c_name", F.lit("…")).alias("title"))


def _key(url: Column) -> Column:
    from ..functions.urls import trimmed

    return trimmed(F.regexp_replace(url, r"[?#].*$", ""))


def known_url_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address isn't known yet, the last slash apart; known are those that the pages link to."""
    from ..functions.urls import absolute, host, links

    pages = table(spark, sf_dir, "pages")
    linked = pages.select(host(F.col("url")).alias("host"), F.explode(links(F.col("html"))).alias("link")).select(absolute(F.col("link"), F.col("host")).alias("link"))
    known = linked.select(_key(F.col("link")).alias("key")).distinct()
    return pages.withColumn("key", _key(F.col("url"))).join(known, "key", "left_anti").select("page_id", "key")


def union_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several sources; the first source that names one wins."""
    line = table(spark, sf_dir, "lineitem")
    tagged = line.where("l_returnflag = 'R'").select("l_partkey", F.lit(1).alias("source"), "l_orderkey", "l_linenumber").unionByName(
        line.where("l_returnflag = 'A'").select("l_partkey", F.lit(2).alias("source"), "l_orderkey", "l_linenumber")
    )
    first = versioning.first_of_each(tagged, ["l_partkey"], [F.asc("source"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return first.select("l_partkey", F.col("source").cast("bigint").alias("source"), "l_orderkey")


_LATEST_SQL = """(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ASC) AS rn
    FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01 00:00:00')"""

ENTRIES = {
    "latest_as_of": (latest_as_of, f"SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM {_LATEST_SQL} WHERE rn = 1"),
    "latest_hidden_if_rejected": (
        latest_hidden_if_rejected, f"SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM {_LATEST_SQL} WHERE rn = 1 AND o_orderstatus <> 'F'",
    ),
    "latest_snapshot_per_source": (
        latest_snapshot_per_source,
        """SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1""",
    ),
    "version_at_instant": (
        version_at_instant,
        """SELECT request_id, version_id FROM (SELECT a.o_orderkey AS request_id, b.o_orderkey AS version_id,
        row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey ASC) AS rn
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate) WHERE rn = 1""",
    ),
    "three_way_projection": (
        three_way_projection,
        f"""SELECT o_orderkey, o_custkey, n_name, c_mktsegment, o_totalprice FROM {_LATEST_SQL} JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE rn = 1 AND o_orderstatus <> 'F'""",
    ),
    "active_source_guard": (
        active_source_guard,
        """SELECT s_nationkey, count(*) AS n, count(DISTINCT o_orderkey) AS n_records FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY s_nationkey""",
    ),
    "facet_counts": (
        facet_counts,
        f"""WITH base AS (SELECT * FROM {_LATEST_SQL} JOIN customer ON o_custkey = c_custkey WHERE rn = 1 AND o_orderstatus <> 'F'),
        cased AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) ELSE c_mktsegment END AS seg FROM base),
        vals AS (SELECT 'nation' AS dim, CAST(c_nationkey AS VARCHAR) AS value, CAST(c_nationkey AS VARCHAR) AS label FROM cased
        UNION ALL SELECT 'status', o_orderstatus, o_orderstatus FROM cased UNION ALL SELECT 'priority', o_orderpriority, o_orderpriority FROM cased
        UNION ALL SELECT 'segment', lower(seg), seg FROM cased UNION ALL SELECT 'segment', lower(o_orderpriority), lower(o_orderpriority) FROM cased
        UNION ALL SELECT 'channel', lower(o_orderstatus), lower(o_orderstatus) FROM cased),
        labels AS (SELECT dim, value, label, count(*) AS c FROM vals WHERE value IS NOT NULL GROUP BY ALL),
        merged AS (SELECT dim, value, sum(c) AS n, arg_min(label, (-c, label)) AS label FROM labels GROUP BY dim, value),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS rk FROM merged)
        SELECT dim, value, label, CAST(n AS BIGINT) AS n FROM ranked WHERE rk <= 100""",
    ),
    "dominant_label": (
        dominant_label,
        """WITH c AS (SELECT lower(label) AS value, label, count(*) AS c FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS label FROM part) GROUP BY ALL)
        SELECT value, arg_min(label, (-c, label)) AS label, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY value""",
    ),
    **{f"validity_bucket_{b}": (_bucket(b), f"SELECT l_orderkey FROM {_WINDOWS_SQL} WHERE {w}") for b, w in _BUCKET_SQL.items()},
    "array_membership_ci": (
        array_membership_ci,
        "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING bool_or(lower(c_mktsegment) = 'machinery')",
    ),
    "json_path_filter": (json_path_filter, "SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 42"),
    "conjunctive_filters": (conjunctive_filters, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
    "keyset_page": (
        keyset_page,
        f"""SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS observed FROM {_LATEST_SQL} WHERE rn = 1 AND
        (o_orderdate < TIMESTAMP '1999-10-01' OR (o_orderdate = TIMESTAMP '1999-10-01' AND o_orderkey > 100)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 51""",
    ),
    "feed_after_cursor": (feed_after_cursor, "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 101"),
    "evidence_semi_join": (
        evidence_semi_join,
        f"""SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey || ':' || p_brand, ',' ORDER BY l_linenumber, l_partkey, p_brand) AS evidence
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM {_LATEST_SQL} WHERE rn = 1 AND o_orderpriority = '1-URGENT') GROUP BY l_orderkey""",
    ),
    "restore_caller_order": (
        restore_caller_order,
        "SELECT c_custkey, min(o_orderkey) AS position, c_name FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    ),
    "left_join_title": (
        left_join_title,
        """SELECT event_id, coalesce(c_name, '…') AS title FROM events LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON user_id = c_custkey
        WHERE event_type = 'signup'""",
    ),
    "known_url_exclusion": (
        known_url_exclusion,
        r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS key FROM pages),
        l AS (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, unnest(regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"''\\]+)["'']', 1, 'i')) AS l FROM pages),
        k AS (SELECT regexp_replace(regexp_replace(CASE WHEN starts_with(l, '/') AND NOT starts_with(l, '//') THEN 'https://' || host || l ELSE l END, '[?#].*$', ''), '/+$', '') AS key FROM l)
        SELECT page_id, key FROM p WHERE key IS NULL OR key NOT IN (SELECT key FROM k WHERE key IS NOT NULL)""",
    ),
    "union_first_source": (
        union_first_source,
        """SELECT l_partkey, CAST(source AS BIGINT) AS source, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY source, l_orderkey, l_linenumber) AS rn FROM
        (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS source, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R', 'A'))) WHERE rn = 1""",
    ),
}
