"""What a commit of orders and their lines would meet in a store that holds them already, somewhat changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sinks import stores
from .tables import table

_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")


def document_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with their lines as blocks: two in three are stored, some with another status, another id for their content, or another line."""
    o, k = table(spark, sf_dir, "orders"), F.col("document_id")
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("h"), "o_orderkey").alias("clean_sha256"), F.col("o_orderstatus").alias("title"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), number.alias("ordinal"), F.col("l_partkey").cast("string").alias("text"))
    old = docs.where(k % 3 > 0).withColumn("title", F.when(k % 7 == 0, "X").otherwise(F.col("title"))).withColumn("document_id", F.when(k % 11 == 0, -k).otherwise(k))
    old_blocks = blocks.where(k % 3 > 0).withColumn("text", F.when((k % 5 == 0) & (F.col("ordinal") == 1), "changed").otherwise(F.col("text")))
    return stores.document_problems(old, old_blocks, docs, blocks)


def record_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, numbered inside their customer: some ids, some versions are taken by others."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("campaign_key"), number.alias("version"), F.col("o_totalprice").alias("data"))
    k = F.col("record_id")
    old = new.where(k % 2 == 0).select(
        F.when(k % 10 == 0, -k).otherwise(k).alias("record_id"), "campaign_key", F.when(k % 14 == 0, F.col("version") + 1000).otherwise(F.col("version")).alias("version"), F.when(k % 22 == 0, F.lit(0.0)).otherwise(F.col("data")).alias("data")
    )
    return stores.record_problems(old, new)


def response_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as responses to requests named by their part: a request with one answer only is no conflict."""
    line = table(spark, sf_dir, "lineitem")
    new = line.select(F.col("l_partkey").alias("request_sha256"), F.col("l_returnflag").alias("response_sha256"))
    old = line.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("request_sha256"), F.col("l_linestatus").alias("response_sha256"))
    return stores.response_problems(old, new)


ENTRIES = {
    "document_conflicts": (
        document_conflicts,
        f"""WITH l AS (SELECT l_orderkey AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) AS n FROM lineitem)
        SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 11 = 0 OR (o_orderkey % 7 = 0 AND o_orderstatus <> 'X') THEN 'different_content' ELSE 'non_canonical_blocks' END AS problem FROM orders
        WHERE o_orderkey % 3 > 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND EXISTS (SELECT 1 FROM l WHERE k = o_orderkey)))""",
    ),
    "record_conflicts": (
        record_conflicts,
        """WITH n AS (SELECT o_orderkey AS r, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v, o_totalprice AS d FROM orders),
        o AS (SELECT CASE WHEN r % 10 = 0 THEN -r ELSE r END AS r, k, CASE WHEN r % 14 = 0 THEN v + 1000 ELSE v END AS v, CASE WHEN r % 22 = 0 THEN 0 ELSE d END AS d FROM n WHERE r % 2 = 0)
        SELECT n.r AS record_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.r = n.r AND (o.k, o.v, o.d) <> (n.k, n.v, n.d)) THEN 'id_taken' ELSE 'version_taken' END AS problem FROM n
        WHERE EXISTS (SELECT 1 FROM o WHERE o.r = n.r AND (o.k, o.v, o.d) <> (n.k, n.v, n.d)) OR EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.v = n.v AND (o.r, o.d) <> (n.r, n.d))""",
    ),
    "response_conflicts": (
        response_conflicts,
        """WITH e AS (SELECT l_partkey AS q, l_returnflag AS r FROM lineitem UNION ALL SELECT l_suppkey, l_linestatus FROM lineitem WHERE l_returnflag = 'R'),
        m AS (SELECT q FROM e GROUP BY q HAVING count(DISTINCT r) > 1) SELECT DISTINCT l_partkey AS request_sha256, 'different_response' AS problem FROM lineitem WHERE l_partkey IN (SELECT q FROM m)""",
    ),
}
