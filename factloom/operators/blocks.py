"""Context across the blocks of a document: table headers, page currency, registry hints, listing segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_text

# Fixed values (folded text): what a header cell says about the rows under it.
HEADERS = (
    (r"\bkar\s+(?:payi\s+)?oran", "financing_profit_rate"), (r"\b(?:yillik\s+)?maliyet\s+oran", "annual_cost_rate"), (r"\bazami\s+finansman\s+oran|\bdeger\w*\s+aralig", "ltv_ratio"),
)
FOREIGN, LOCAL = r"\b(?:usd|eur|euro|avro|dolar\w*|sterlin|gbp)\b|[€$£]", r"\btl\b|\btry\b|₺|\bturk\s+lirasi\b"


def header_hint(text: Column) -> Column:
    """The context that a header-shaped row sets, else null."""
    folded = search_text(text)
    out = None
    for pattern, hint in HEADERS:
        out = F.when(folded.rlike(pattern), hint) if out is None else out.when(folded.rlike(pattern), hint)
    return F.when(~folded.rlike(r"\d"), out)


def table_context(blocks: DataFrame, document: str, ordinal: str, is_row: Column, is_header: Column, hint: Column) -> DataFrame:
    """Adds ``context``: the hint of the last header row above a table row, inside the same run of
    table rows. Other blocks end a run; a header row without a hint takes the old one away."""
    order = Window.partitionBy(document).orderBy(ordinal)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A new run begins at each block that isn't a table row and at each header row.
    marked = blocks.withColumn("_row", is_row).withColumn("_head", is_row & is_header).withColumn("_hint", F.when(is_row & is_header, hint))
    runs = marked.withColumn("_run", F.count_if(~F.col("_row") | F.col("_head")).over(upto))
    context = F.first("_hint").over(Window.partitionBy(document, "_run").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("context", F.when(F.col("_row") & ~F.col("_head"), context)).drop("_row", "_head", "_hint", "_run")


def page_currency(blocks: DataFrame, document: str, text: str) -> DataFrame:
    """(document, currency): TRY where a page speaks of the local currency and of no other; else null."""
    folded = search_text(F.col(text))
    return blocks.groupBy(document).agg(F.when(F.bool_or(folded.rlike(LOCAL)) & ~F.bool_or(folded.rlike(FOREIGN)), "TRY").alias("currency"))


def label_hint(documents: DataFrame, registry: DataFrame, url: str) -> DataFrame:
    """Adds the registry's ``label`` for a document's address (the last slash apart)."""
    key = lambda c: F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", "")
    labels = registry.select(key(F.col("url")).alias("_key"), "label").groupBy("_key").agg(F.min("label").alias("label"))
    return documents.withColumn("_key", key(F.col(url))).join(labels, "_key", "left").drop("_key")


def repeated_prefixes(blocks: DataFrame, document: str, locator: str) -> DataFrame:
    """(document, prefix, n): locator prefixes (without the last index) that more than one block shares: a listing's items."""
    prefix = F.regexp_replace(locator, r":\d+(/[^/]*)?$", "")
    return blocks.groupBy(document, prefix.alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")
