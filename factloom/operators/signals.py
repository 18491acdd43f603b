"""Which fields a document's blocks can speak of: signal terms, field choice, and the blocks and windows worth reading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalizers import let
from ..functions.text import swapped
from .filters import injection

#: Characters before a window's first signal, and blocks and fields taken at most.
LEAD, BLOCKS, FIELDS = 160, 16, 3
#: What a heading adds to the title, and a paragraph to the summary.
TITLE, SUMMARY = ("title", "heading", 2), ("summary", "paragraph", 1)
DURATION = r"\b\d+(?:[.,]\d+)?\s*(?:aylik|ay|yillik|yil|senelik|sene)\b"

# Terms that signal a field, and the families of fields that are asked together. All as plain() leaves them.
FIELD_TERMS = {
    "title": ("kampanya", "firsat", "finansman", "hesap", "kart"), "summary": ("kampanya", "firsat", "avantaj", "yararlan"), "product_family": ("finansman", "katilma hesabi", "kart", "hesap", "pos"),
    "campaign_type": ("indirim", "nakit iade", "para iadesi", "taksit", "puan", "bonus", "masrafsiz", "ucretsiz", "hos geldin"), "rate": ("oran", "%", "kar payi", "maliyet"),
    "financing_amount": ("tutar", "finansman", "limit", "₺", " tl"), "term": (DURATION + "$",), "fee": ("ucret", "masraf", "tahsis", "aidat", "ucretsiz"), "reward": ("odul", "puan", "nakit iade", "indirim", "hediye"),
    "validity": ("tarih", "kadar", "arasinda", "gecerli", "sure"), "customer_segment": ("bireysel", "ticari", "musteri", "emekli", "genc", "kadin girisimci", "kobi"),
    "eligibility_condition": ("kosul", "sart", "yararlan", "gerekmektedir"), "sales_channel": ("mobil", "internet", "sube", "cagri merkezi", "atm"), "new_customer_only": ("yeni musteri", "ilk kez", "ilk defa"),
}
FAMILIES = (
    ("title", "summary", "product_family", "campaign_type"), ("rate", "financing_amount", "term", "fee", "reward"),
    ("validity", "customer_segment", "eligibility_condition", "sales_channel", "new_customer_only"),
)


def plain(text: Column) -> Column:
    """Lower case with the Turkish letters as plain ones."""
    return let(F.lower(text), lambda low: swapped(low, "ışğüöçâ", "isguoca"))


def _pattern(terms: tuple[str, ...]) -> str:
    """Places where a term begins; terms that end with "$" are patterns without it."""
    return "(?:" + "|".join(t[:-1] if t.endswith("$") else re.escape(t) for t in terms) + ")"


def _apart(terms: tuple[str, ...]) -> tuple[str, ...] | None:
    """The terms without those that begin with another one, for a place counts once; None where patterns or terms that may overlap themselves need a pattern."""
    if any(t.endswith("$") or any(t[:k] == t[-k:] for k in range(1, len(t))) for t in terms):
        return None
    return tuple(t for t in dict.fromkeys(terms) if not any(o != t and t.startswith(o) for o in terms))


def signal_count(key: Column, terms: tuple[str, ...]) -> Column:
    """Number of places where one of the terms begins, each place once, in a text that plain() made."""
    if (apart := _apart(terms)) is None:
        return F.regexp_count(key, F.lit(f"(?={_pattern(terms)})"))
    # What a text loses without a term tells how often it is there: a plain search, no pattern.
    lost = lambda t: F.octet_length(key) - F.octet_length(F.replace(key, F.lit(t), F.lit("")))
    times = lambda t: F.when(key.contains(t), F.floor(lost(t) / len(t.encode())).cast("int")).otherwise(0)
    return sum((times(t) for t in apart), F.lit(0))


def first_signal(key: Column, terms: tuple[str, ...]) -> Column:
    """Place of the first term, from 0; none: null."""
    if _apart(terms) is None:
        return F.nullif(F.regexp_instr(key, F.lit(_pattern(terms))), F.lit(0)) - 1
    return F.least(*(F.nullif(F.instr(key, F.lit(t)), F.lit(0)) for t in terms), *[F.lit(None).cast("int")] * 2) - 1


def _bonus(field: str, kind: Column) -> Column:
    found = [F.when(kind == k, n).otherwise(0) for name, k, n in (TITLE, SUMMARY) if name == field]
    return found[0] if found else F.lit(0)


def field_scores(blocks: DataFrame, terms: dict[str, tuple[str, ...]], document: str = "document_id") -> DataFrame:
    """(document, field, score): signals of each field over a document's blocks (document, kind, text); quarantined blocks have none."""
    safe = blocks.where(~injection(F.col("text"))).withColumn("_key", plain(F.col("text")))
    sums = safe.groupBy(document).agg(*(F.sum(signal_count(F.col("_key"), t) + _bonus(f, F.col("kind"))).alias(f) for f, t in terms.items()))
    return sums.select(document, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("score")) for f in terms))).alias("s")).select(document, "s.*")


def chosen_fields(scores: DataFrame, families: tuple[tuple[str, ...], ...], document: str = "document_id", most: int = FIELDS) -> DataFrame:
    """(document, field, nth): the fields to ask for in one go, from field_scores() with a boolean ``priority``.

    One family is asked: first one with a priority field that has a signal, then the one of the highest
    score, of the highest sum, the first. In it fields with a signal count, priority fields first, then by score and
    name, at most ``most``.
    """
    number = F.coalesce(*(F.when(F.col("field").isin(*f), k) for k, f in enumerate(families)))
    own = scores.withColumn("_family", number).where(F.col(document).isNotNull() & F.col("_family").isNotNull())
    # Windows, not a join with the best families: that would read the texts behind the scores twice.
    family, whole = Window.partitionBy(document, "_family"), Window.partitionBy(document)
    rank = F.struct(F.bool_or(F.col("priority") & (F.col("score") > 0)).over(family).alias("p"), F.max("score").over(family).alias("peak"), F.sum("score").over(family).alias("total"), (-F.col("_family")).alias("no"))
    best = own.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(whole)).where("_rank.no = _best.no")
    order = whole.orderBy(F.desc("priority"), F.desc("score"), F.asc("field"))
    asked = best.where("score > 0").withColumn("nth", F.row_number().over(order))
    return asked.where(F.col("nth") <= most).select(document, "field", "nth")


def read_blocks(blocks: DataFrame, terms: dict[str, tuple[str, ...]], document: str = "document_id", most: int = BLOCKS, width: int = 400) -> DataFrame:
    """relevant_blocks() with the kind of each."""

    def read(key: Column) -> Column:
        relevance = sum((signal_count(key, t) + _bonus(f, F.col("kind")) for f, t in terms.items()), F.lit(0))
        first = F.least(*(first_signal(key, t) for t in terms.values()), *[F.lit(None).cast("int")] * 2)
        start = F.coalesce(F.greatest(F.lit(0), first - LEAD), F.lit(0))
        return F.struct(relevance.alias("relevance"), F.when(F.length("text") <= width, F.col("text")).otherwise(F.substr("text", start + 1, F.lit(width))).alias("window"))

    order = Window.partitionBy(document).orderBy(F.desc("relevance"), F.when(F.col("kind") == "heading", 0).otherwise(1), F.asc("ordinal"))
    # An exploded row is read once; a filter behind it would be moved before it and read the text anew.
    signalled = F.filter(F.array(let(plain(F.col("text")), read)), lambda r: r["relevance"] > 0)
    safe = blocks.where(~injection(F.col("text"))).select(document, "block_id", "ordinal", "kind", F.inline(signalled))
    return safe.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(document, "block_id", "nth", "relevance", "window", "kind")


def relevant_blocks(blocks: DataFrame, terms: dict[str, tuple[str, ...]], document: str = "document_id", most: int = BLOCKS, width: int = 400) -> DataFrame:
    """(document, block_id, nth, relevance, window): the blocks (document, block_id, ordinal, kind, text) worth reading for the fields of ``terms``.

    Blocks come by falling relevance, headings first, then in order; blocks without a signal and
    quarantined ones don't come. The window of a long block begins up to LEAD characters before its first signal.
    """
    return read_blocks(blocks, terms, document, most, width).drop("kind")
