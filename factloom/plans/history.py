"""Versions, change feeds, frontier state and sliding windows over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versioning
from .tables import table

MINUTE = 60_000_000


def _micros():
    return F.expr("unix_micros(CAST(ts AS TIMESTAMP))")


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the events at which the type changes: versions with their predecessor."""
    found = versioning.change_points(table(spark, sf_dir, "events"), "user_id", "ts", [F.asc("event_id")], F.col("event_type"))
    return found.select("user_id", "event_id", "event_type", "version", "previous_content", "kind")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Created and updated events by type."""
    return change_points(spark, sf_dir).groupBy("event_type", "kind").agg(F.count("*").alias("n"), F.max("version").alias("last_version"))


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each (user, type): later ones of an identity are no-ops."""
    return versioning.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events whose identity is stored with another content."""
    events = table(spark, sf_dir, "events").withColumn("identity", F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    stored = versioning.first_of_each(events, ["identity"], [F.asc("event_id")]).select("identity", "event_type")
    return versioning.conflicts(stored, events, ["identity"], "event_type").select("event_id", "identity", "event_type")


def newer_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned upsert of orders by customer and status: the higher key is the newer version."""
    orders = table(spark, sf_dir, "orders")
    key = orders.withColumn("k", F.concat_ws("-", "o_custkey", "o_orderstatus")).select("k", F.col("o_orderkey").alias("version"), "o_totalprice")
    old = versioning.first_of_each(key, ["k"], [F.asc("version")])
    new = versioning.first_of_each(key, ["k"], [F.desc("version")])
    return versioning.newer_dimension(old, new, "k", "version").select("k", "version", "o_totalprice")


def stale_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer as a dimension: each status' first order against the customer's last order of status O."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 1000).alias("version"), "o_orderstatus", "o_totalprice", "o_orderkey")
    old = versioning.first_of_each(orders.where("o_orderstatus = 'O'"), ["k"], [F.desc("o_orderkey")])
    return versioning.stale_dimension(old, orders.where("o_orderstatus <> 'O'"), "k", "version", ["o_orderstatus", "o_totalprice"])


def seen_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versioning.seen_frontier(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", day("first_seen"), day("last_seen"), "event_type")


def index_change_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of an index (a user): errors have no hash, and don't reset the last one."""
    events = table(spark, sf_dir, "events").withColumn("hash", F.floor(F.col("value") / 20).cast("bigint"))
    found = versioning.index_changed(events, "user_id", [F.asc("ts"), F.asc("event_id")], "hash", F.col("event_type") != "error")
    return found.where("event_type <> 'error' OR NOT changed").select("event_id", "changed")


def sliding_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the last 15 minutes, open at the left end; an upper bound of a rate limit's count."""
    return versioning.trailing_count(table(spark, sf_dir, "events"), "user_id", _micros(), 15 * MINUTE).select("event_id", "n")


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after 30 idle minutes."""
    marked = versioning.gap_sessions(table(spark, sf_dir, "events"), "user_id", _micros(), [F.asc("event_id")], 30 * MINUTE)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def feed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap-free sequence over all events by (time, id)."""
    from ..sources.strict import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return versioning.feed_sequence(events, [F.asc("ts"), F.asc("event_id")]).select("event_id", "feed_sequence")


def scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan roll-up: sums, any-of flags, and the worst status by precedence."""
    rank = F.expr("CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "click").alias("enqueued"), F.bool_or(F.col("event_type") == "error").alias("failed"),
        F.max_by("event_type", F.struct(rank.alias("r"), F.col("event_type").alias("t"))).alias("status"), F.countDistinct("event_type").alias("kinds"),
    )


ENTRIES = {
    "change_points": (
        change_points,
        """WITH m AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        c AS (SELECT * FROM m WHERE nth = 1 OR event_type IS DISTINCT FROM before)
        SELECT user_id, event_id, event_type, row_number() OVER w AS version, lag(event_type) OVER w AS previous_content,
        CASE WHEN row_number() OVER w = 1 THEN 'created' ELSE 'updated' END AS kind FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    ),
    "change_events": (
        change_events,
        """WITH m AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS nth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        c AS (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM m WHERE nth = 1 OR event_type IS DISTINCT FROM before)
        SELECT event_type, CASE WHEN version = 1 THEN 'created' ELSE 'updated' END AS kind, count(*) AS n, max(version) AS last_version FROM c GROUP BY 1, 2""",
    ),
    "dedupe_first": (
        dedupe_first,
        """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
    ),
    "identity_conflicts": (
        identity_conflicts,
        """WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y-%m-%d') AS identity FROM events),
        s AS (SELECT identity, arg_min(event_type, event_id) AS stored FROM e GROUP BY identity)
        SELECT event_id, identity, event_type FROM e JOIN s USING (identity) WHERE event_type <> stored""",
    ),
    "newer_dimension": (
        newer_dimension,
        """SELECT o_custkey || '-' || o_orderstatus AS k, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1""",
    ),
    "stale_dimension": (
        stale_dimension,
        """WITH o AS (SELECT o_custkey AS k, o_orderkey % 1000 AS version, o_orderstatus AS s, o_totalprice AS p, o_orderkey AS id FROM orders),
        old AS (SELECT k, arg_max(version, id) AS v, arg_max(s, id) AS s, arg_max(p, id) AS p FROM o WHERE s = 'O' GROUP BY k), n AS (SELECT * FROM o WHERE s <> 'O')
        SELECT k, 'version_older' AS problem FROM n JOIN old USING (k) WHERE n.version < old.v UNION SELECT k, 'version_differs' FROM n JOIN old USING (k) WHERE n.version = old.v AND (n.s, n.p) <> (old.s, old.p)
        UNION SELECT k, 'version_differs' FROM n GROUP BY k, version HAVING count(DISTINCT (s, p)) > 1""",
    ),
    "seen_frontier": (
        seen_frontier,
        """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
        arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""",
    ),
    "index_change_flag": (
        index_change_flag,
        """WITH h AS (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 20) AS BIGINT) END AS own FROM events),
        b AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
        SELECT event_id, coalesce(own <> before, false) AS changed FROM b""",
    ),
    "sliding_window_count": (
        sliding_window_count,
        """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS n FROM events""",
    ),
    "session_gaps": (
        session_gaps,
        """WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s)
        SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM n GROUP BY ALL""",
    ),
    "feed_sequence": (feed_sequence, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS feed_sequence FROM events"),
    "scan_rollup": (
        scan_rollup,
        """SELECT user_id, count(*) FILTER (event_type = 'click') AS enqueued, bool_or(event_type = 'error') AS failed,
        arg_max(event_type, (CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END, event_type)) AS status,
        count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""",
    ),
}
