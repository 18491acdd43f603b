"""Summary rows, bounds, labels, top-k per group, client merges and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, urls
from .tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records: an order with its lines as facts."""
    fact = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("months"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(fact)).alias("facts"))


def primary_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of the preferred kind (R, then A), else the first fact."""
    of = lambda k: F.get(F.filter("facts", lambda f: f["kind"] == k), F.lit(0))["amount"]
    return _records(spark, sf_dir).select("l_orderkey", F.coalesce(of("R"), of("A"), F.get("facts", F.lit(0))["amount"]).alias("value"), F.size("facts").cast("bigint").alias("n_facts"))


def numeric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest amount and longest term of a record, next to its nested facts."""
    part = lambda name: F.transform("facts", lambda f: f[name])
    return _records(spark, sf_dir).select("l_orderkey", F.array_min(part("amount")).alias("low"), F.array_max(part("amount")).alias("high"), F.array_max(part("months")).alias("longest"))


def label_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet values with their display labels from a fixed table; unknown values keep their name."""
    labels = {"O": "açık", "F": "kapalı"}
    lookup = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.lit(v))))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n")).withColumn("label", F.coalesce(F.try_element_at(lookup, F.col("value")), F.col("value")))


def decimal_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.decimal_text(F.col("p_retailprice").cast("decimal(20,4)")).alias("shown"))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 dearest parts of each brand, ties by id."""
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), F.asc("p_partkey"))
    ranked = table(spark, sf_dir, "part").withColumn("place", F.row_number().over(order).cast("bigint"))
    return ranked.where("place <= 3").select("p_brand", "p_partkey", "place")


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged client pages: per key the row of the highest page, then the newest 100 keys."""
    merged = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("event_id"))
    return merged.orderBy(F.desc("event_id")).limit(100)


def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a coverage snapshot, and the names of the incomplete sources."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("total"), F.count_if(F.col("errors") * 5 < F.col("n")).alias("successes"), F.sum("n").alias("campaigns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("errors") * 5 >= F.col("n"), F.col("user_id")))), lambda x: x.cast("string")), ",").alias("incomplete"),
    )


def _starts(stem: str):
    return lambda w: w.rlike(f"^{stem}[a-z]*$")


def family_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the family with the most hits; another family with as many is a conflict."""
    families = {"thing": "er", "place": "on", "state": "en"}
    hits = F.array(*(F.struct(F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1), _starts(stem))).alias("n"), F.lit(name).alias("family")) for name, stem in families.items()))
    long = table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
    best = long.groupBy("doc_id").agg(F.max(F.struct("n", "family")).alias("best"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    conflict = F.get("ns", F.lit(0)) == F.get("ns", F.lit(1))
    return best.select("doc_id", F.when(F.col("best.n") == 0, "none").when(conflict, "conflict").otherwise(F.col("best.family")).alias("family"))


def payload_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads with exactly the key k, holding an integer."""
    keys = F.json_object_keys("props")
    ok = (keys == F.array(F.lit("k"))) & F.get_json_object("props", "$.k").rlike(r"^-?\d+$")
    return table(spark, sf_dir, "events").groupBy(F.coalesce(ok, F.lit(False)).alias("valid")).agg(F.count("*").alias("n"))


def allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on the allowlisted hosts of a registry (the hosts of every 25th page), by an equi-join."""
    pages = table(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    registry = pages.where("page_id % 25 = 0 AND host IS NOT NULL").groupBy("host").agg(F.min("page_id").alias("source"))
    return pages.join(registry, "host").select("page_id", "source", "host")


def version_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance chains: each line's order exists and its customer too; broken links are counted."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    joined = line.join(order, "l_orderkey", "left").join(customer, "o_custkey", "left")
    problem = F.when(F.col("o_custkey").isNull(), "record_missing").when(F.col("c_nationkey").isNull(), "source_missing").otherwise("whole")
    return joined.groupBy(problem.alias("chain")).agg(F.count("*").alias("n"))


def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes: NUL-joined material behind a prefix."""
    material = F.concat_ws("\u0000", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("record:"), F.sha2(material, 256)).alias("record_id"))


ENTRIES = {
    "primary_value": (
        primary_value,
        """WITH k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity) AS a,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_extendedprice, l_quantity) AS b FROM lineitem)
        SELECT l_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' AND a = 1 THEN l_extendedprice END), max(CASE WHEN l_returnflag = 'A' AND a = 1 THEN l_extendedprice END), max(CASE WHEN b = 1 THEN l_extendedprice END)) AS value,
        count(*) AS n_facts FROM k GROUP BY l_orderkey""",
    ),
    "numeric_bounds": (numeric_bounds, "SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, max(l_quantity) AS longest FROM lineitem GROUP BY l_orderkey"),
    "label_translation": (
        label_translation, "SELECT o_orderstatus AS value, count(*) AS n, CASE o_orderstatus WHEN 'O' THEN 'açık' WHEN 'F' THEN 'kapalı' ELSE o_orderstatus END AS label FROM orders GROUP BY 1",
    ),
    "decimal_display": (
        decimal_display, r"SELECT p_partkey, replace(regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(20,4)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), '.', ',') AS shown FROM part",
    ),
    "top_candidates": (
        top_candidates,
        "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3",
    ),
    "last_write_wins": (last_write_wins, "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY event_id DESC LIMIT 100"),
    "coverage_metrics": (
        coverage_metrics,
        """WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) AS n FROM events GROUP BY 1)
        SELECT count(*) AS total, count(*) FILTER (e * 5 < n) AS successes, CAST(sum(n) AS BIGINT) AS campaigns, coalesce(string_agg(CASE WHEN e * 5 >= n THEN user_id END, ',' ORDER BY user_id), '') AS incomplete FROM p""",
    ),
    "family_dominance": (
        family_dominance,
        r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
        h AS (SELECT doc_id, len(list_filter(w, lambda x: regexp_full_match(x, 'er[a-z]*'))) AS t, len(list_filter(w, lambda x: regexp_full_match(x, 'on[a-z]*'))) AS p, len(list_filter(w, lambda x: regexp_full_match(x, 'en[a-z]*'))) AS s FROM w)
        SELECT doc_id, CASE WHEN greatest(t, p, s) = 0 THEN 'none' WHEN (CAST(t = greatest(t, p, s) AS INT) + CAST(p = greatest(t, p, s) AS INT) + CAST(s = greatest(t, p, s) AS INT)) > 1 THEN 'conflict'
        WHEN t = greatest(t, p, s) THEN 'thing' WHEN p = greatest(t, p, s) THEN 'place' ELSE 'state' END AS family FROM h""",
    ),
    "payload_contract": (payload_contract, r"SELECT coalesce(json_keys(props) = ['k'] AND regexp_matches(json_extract_string(props, '$.k'), '^-?\d+$'), false) AS valid, count(*) AS n FROM events GROUP BY 1"),
    "allowed_hosts": (
        allowed_hosts,
        r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
        r AS (SELECT host, min(page_id) AS source FROM p WHERE page_id % 25 = 0 AND host IS NOT NULL GROUP BY host) SELECT page_id, source, host FROM p JOIN r USING (host)""",
    ),
    "version_bundle": (
        version_bundle,
        """SELECT CASE WHEN o_custkey IS NULL THEN 'record_missing' WHEN c_nationkey IS NULL THEN 'source_missing' ELSE 'whole' END AS chain, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "record_identity": (record_identity, "SELECT o_orderkey, 'record:' || sha256(o_custkey || chr(0) || o_orderstatus || chr(0) || o_orderpriority) AS record_id FROM orders"),
}
