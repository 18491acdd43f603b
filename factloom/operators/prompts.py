"""Prompt packages under a byte budget: what a document's relevant blocks may show in one request.

Blocks come in order and share one budget of UTF-8 bytes of the JSON text that is sent. Sizes add up, so a running sum
finds the blocks that fit whole; the first that doesn't is cut to the longest beginning that still fits, and nothing follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import injection
from .signals import BLOCKS, read_blocks

SCHEMA = "untrusted-document/1.0"
#: Bytes of the whole request text, and characters of one block's window.
BUDGET, WIDTH = 2_500, 400
_SHORT = ('"', "\\", "\n", "\r", "\t", "\b", "\f")


def _block(block_id: Column, kind: Column, text: Column) -> Column:
    return F.struct(block_id.alias("block_id"), kind.alias("kind"), text.alias("text"))


def json_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text inside a JSON string."""
    return F.octet_length(F.to_json(F.struct(text.alias("t")))) - len('{"t":""}')


def fitting(text: Column, room: Column) -> Column:
    """The longest beginning of a text whose JSON form has at most ``room`` bytes."""
    size = lambda c: F.when(c.isin(*_SHORT), 2).when(c < " ", 6).otherwise(F.octet_length(c))
    step = lambda acc, c: F.struct((acc["used"] + size(c)).alias("used"), F.when(acc["used"] + size(c) <= room, acc["n"] + 1).otherwise(acc["n"]).alias("n"))
    n = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return F.substr(text, F.lit(1), n)


def frame(document: Column, bank: Column, fields: list[str], blocks: Column) -> Column:
    """The request text of some blocks, names in order."""
    return F.to_json(F.struct(bank.alias("bank_id"), blocks.alias("blocks"), document.alias("document_id"), F.lit(sorted(fields)).alias("requested_fields"), F.lit(SCHEMA).alias("schema_version")))


def budgeted(ranked: DataFrame, base: Column, budget: int = BUDGET, document: str = "document_id") -> DataFrame:
    """Rows of ``ranked`` (document, nth, block_id, kind, window) that fit into ``budget`` bytes, with the ``visible`` part of the window.

    ``base`` are the bytes of the request without blocks, a column of ``ranked``.
    """
    order = Window.partitionBy(document).orderBy("nth")
    around = F.octet_length(F.to_json(_block(F.col("block_id"), F.col("kind"), F.lit("")))) + F.when(F.col("nth") > F.min("nth").over(order), 1).otherwise(0)
    sized = ranked.withColumn("_around", around).withColumn("_size", F.col("_around") + json_bytes(F.col("window")))
    after = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = sized.withColumns({"_after": base + after, "_room": budget - (base + after - F.col("_size")) - F.col("_around")})
    # The first block beyond the budget is cut; a whole block after it can't be, for sums only grow.
    first_over = F.min(F.when(F.col("_after") > budget, F.col("nth"))).over(Window.partitionBy(document))
    shown = summed.withColumn("_over", first_over).where("_over IS NULL OR nth <= _over")
    visible = F.when(F.col("_after") <= budget, F.col("window")).otherwise(fitting(F.col("window"), F.col("_room")))
    # Exploded, so that a text is cut once: a filter behind it would be moved before it and cut the text anew.
    return shown.withColumn("visible", F.explode(F.filter(F.array(visible), lambda v: v != ""))).drop("_around", "_size", "_after", "_room", "_over")


def packages(
    documents: DataFrame, blocks: DataFrame, terms: dict[str, tuple[str, ...]], document: str = "document_id", most: int = BLOCKS, width: int = WIDTH, budget: int = BUDGET
) -> DataFrame:
    """One row per document (document, bank_id): content (the request text), bytes, included (array of block_id and text), quarantined
    (sorted block ids), error.

    ``blocks``: document, block_id, ordinal, kind, text; ``terms`` are the fields asked for. Only blocks with a signal are sent, in
    order of relevance, each as one window. ``error`` says where even a request without blocks is beyond the budget; then nothing is sent.
    """
    bad = blocks.where(injection(F.col("text"))).groupBy(document).agg(F.array_sort(F.collect_list("block_id")).alias("_bad"))
    ranked = read_blocks(blocks, terms, document, most, width)
    empty = F.array().cast(f"array<struct<block_id:{blocks.schema['block_id'].dataType.simpleString()},kind:string,text:string>>")
    sized = documents.withColumn("_base", F.octet_length(frame(F.col(document), F.col("bank_id"), list(terms), empty)))
    kept = budgeted(ranked.join(sized.select(document, "_base"), document), F.col("_base"), budget, document)
    of_document = kept.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("nth", "block_id", "kind", F.col("visible").alias("text")))).alias("_shown"))
    sent = sized.join(of_document, document, "left").join(bad, document, "left")
    shown = F.coalesce(F.transform("_shown", lambda b: _block(b["block_id"], b["kind"], b["text"])), empty)
    fits = F.col("_base") <= budget
    content = F.when(fits, frame(F.col(document), F.col("bank_id"), list(terms), shown))
    return sent.select(
        document, content.alias("content"), F.octet_length(content).alias("bytes"), F.when(fits, F.transform(shown, lambda b: F.struct(b["block_id"].alias("block_id"), b["text"].alias("text")))).alias("included"),
        F.coalesce("_bad", F.array().cast(blocks.select(F.array("block_id")).schema[0].dataType)).alias("quarantined"), F.when(~fits, "prompt byte limit is too small for the request metadata").alias("error"),
    )
