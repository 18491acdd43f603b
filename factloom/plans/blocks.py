"""Queries on block context: table headers, page currency, registry labels, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..operators import blocks as ops
from .tables import spread, table, tasks


def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as blocks: R lines are header rows (quantity decides the hint), A lines rows, N lines other text."""
    rank = F.row_number().over(ops.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    line = table(spark, sf_dir, "lineitem")
    lines = spread(line, "l_orderkey", n=tasks(line)).select("l_orderkey", "l_returnflag", "l_quantity", rank.alias("ordinal"))
    said = F.when(F.col("l_quantity") % 3 == 0, F.lit("Kâr payı oranı")).when(F.col("l_quantity") % 3 == 1, F.lit("Yıllık maliyet oranı")).otherwise(F.lit("Vade"))
    found = ops.table_context(lines, "l_orderkey", "ordinal", F.col("l_returnflag") != "N", F.col("l_returnflag") == "R", ops.header_hint(said))
    return found.where("l_returnflag = 'A'").select("l_orderkey", F.col("ordinal").cast("bigint").alias("ordinal"), "context")


def page_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("l_returnflag") == "R", F.lit("500 TL")).when((F.col("l_returnflag") == "A") & (F.col("l_tax") == 0), F.lit("10 USD")).otherwise(F.lit("vade"))
    return ops.page_currency(table(spark, sf_dir, "lineitem").select("l_orderkey", said.alias("said")), "l_orderkey", "said")


def registry_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages by their address; the registry names every third one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    registry = pages.where("page_id % 3 = 0").select("url", F.concat(F.lit("label-"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("label"))
    return ops.label_hint(pages, registry, "url").select("page_id", "label")


def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated block places of each page."""
    return ops.repeated_prefixes(html.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id", "locator")


ENTRIES = {
    "table_context": (
        table_context,
        """WITH b AS (SELECT l_orderkey, l_returnflag AS f, CASE WHEN l_returnflag = 'R' THEN CASE l_quantity % 3 WHEN 0 THEN 'financing_profit_rate' WHEN 1 THEN 'annual_cost_rate' END END AS hint,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ordinal FROM lineitem),
        r AS (SELECT *, count(*) FILTER (f <> 'A') OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS run FROM b)
        SELECT l_orderkey, ordinal, context FROM (SELECT *, first_value(hint) OVER (PARTITION BY l_orderkey, run ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS context FROM r) WHERE f = 'A'""",
    ),
    "page_currency": (
        page_currency,
        """SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'A' AND l_tax = 0) THEN 'TRY' END AS currency FROM lineitem GROUP BY 1""",
    ),
    "registry_label": (
        registry_label,
        """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS k FROM pages),
        r AS (SELECT k, min('label-' || lpad(CAST(page_id AS VARCHAR), 9, '0')) AS label FROM p WHERE page_id % 3 = 0 GROUP BY k) SELECT page_id, label FROM p LEFT JOIN r USING (k)""",
    ),
    "listing_items": (listing_items, None),
}
