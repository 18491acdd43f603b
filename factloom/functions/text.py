"""Text folding, tokens, keyword matching, number grounding, spans: all as columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Turkish letters and signs, and what they fold to.
FOLD_FROM, FOLD_TO = "ÇĞİIÖŞÜÂÎÛçğıöşüâîû−–—’`", "CGIIOSUAIUcgiosuaiu---''"
# Texts that mean "not stated" (folded).
MISSING = ("", "-", "n a", "na", "none", "null", "unknown", "bilinmiyor", "bilinmeyen", "belirtilmemis", "mevcut degil", "bulunamadi", "not found")
#: One of these ends a text about a field that is not stated.
MISSING_WORDS = ("belirtilmemis", "bulunmuyor", "bulunamadi", "bilinmiyor", "yok")
MISSING_FIELD = r"\b(?:bilgi(?:si)?|oran(?:i)?|tutar(?:i)?|vade(?:si)?|tarih(?:i)?|ucret(?:i)?)\s+(?:belirtilmemis|bulunmuyor|bulunamadi|bilinmiyor|yok)\b"


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility composition: Spark has no such function. Plain ASCII passes untouched."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.lower() if t.isascii() else t.casefold() for t in texts.to_pylist()], pa.string())


def swapped(text: Column, before: str, after: str) -> Column:
    """translate() of a few letters beyond ASCII, none of them replaced by another of ``before``: plain searches, and none at all in a text of ASCII."""
    out = text
    for a, b in zip(before, after, strict=True):
        # An empty search replaces nothing; it spares a text without the letter.
        out = F.replace(out, F.when(text.contains(a), a).otherwise(""), F.lit(b))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(out)


def search_text(text: Column, exact: bool = False) -> Column:
    """Folded lower-case text that keeps punctuation. ``exact`` adds NFKC and full case folding,
    at the price of a Python stage; without it the text should be NFKC already."""
    folded = F.translate(nfkc(text) if exact else text, FOLD_FROM, FOLD_TO)
    return F.translate(casefold(folded) if exact else F.lower(folded), "  ", "  ")


def fold(text: Column, exact: bool = False) -> Column:
    """Canonical key: folded, lower case, runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(search_text(text, exact), "[^a-z0-9]+", " "))


def states_nothing(folded: Column) -> Column:
    """Whether a text given as search_text() says that something is not stated."""
    return F.exists(F.array(F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))), lambda key: key.isin(*MISSING) | key.rlike(MISSING_FIELD))


def is_missing(text: Column) -> Column:
    return text.isNull() | states_nothing(search_text(text))


def words(text: Column) -> Column:
    """Folded words in order."""
    return F.array_remove(F.split(fold(text), " "), "")


def matches_all(tokens: Column, keywords: list[str]) -> Column:
    """Whether every keyword is a token."""
    return F.forall(F.lit(keywords), lambda k: F.array_contains(tokens, k)) if keywords else F.lit(True)


def keyword_prefix_match(tokens: Column, keyword: str, least: int = 3) -> Column:
    """Whether a token and the keyword start with one another, the shorter with ``least`` characters."""
    k = F.lit(keyword)
    return F.exists(tokens, lambda w: (F.startswith(w, k) | F.startswith(k, w)) & (F.least(F.length(w), F.length(k)) >= least))


def cover_rank(tokens: Column, keywords: list[str]) -> Column:
    """Order score of a match: the number of keyword occurrences over the span that holds them."""
    at = F.filter(F.transform(tokens, lambda w, i: F.when(w.isin(*keywords), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.size(at) / (F.array_max(at) - F.array_min(at) + 1)).otherwise(F.lit(0.0))


NUMBER = r"\d+(?:[.,]\d+)*"


def numbers(text: Column) -> Column:
    """Distinct number tokens; a comma and a dot are the same sign."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), 1), lambda x: F.translate(x, ",", ".")))


def unit_numbers(text: Column) -> Column:
    """Distinct "number|unit" pairs; units are percent, currency and months."""
    low = search_text(F.coalesce(text, F.lit("")))

    def tagged(pattern: str, unit: str):
        return F.transform(F.regexp_extract_all(low, F.lit(pattern), 1), lambda x: F.concat(F.translate(x, ",", "."), F.lit(f"|{unit}")))

    return F.array_distinct(
        F.concat(
            tagged(rf"(?:%|yuzde)\s*({NUMBER})", "percent"), tagged(rf"({NUMBER})\s*(?:%|yuzde\b)", "percent"),
            tagged(rf"({NUMBER})\s*(?:tl\b|try\b|usd\b|eur\b|₺|€)", "currency"), tagged(rf"(?:₺|€|\$)\s*({NUMBER})", "currency"),
            tagged(rf"({NUMBER})\s*(?:ay|aylik)\b", "months"),
        )
    )


def grounded(answer: Column, evidence: Column) -> Column:
    """Whether all numbers of the answer, and all numbers with a unit, are in the evidence."""
    return (F.size(F.array_except(numbers(answer), numbers(evidence))) == 0) & (F.size(F.array_except(unit_numbers(answer), unit_numbers(evidence))) == 0)


def span_holds(text: Column, start: Column, end: Column, quote: Column, digest: Column) -> Column:
    """Whether text[start:end] is the quote, as long as the span, and the quote has the digest (code points, end exclusive)."""
    return F.coalesce((F.length(quote) == end - start) & (F.substr(text, start + 1, end - start) == quote) & (F.sha2(quote, 256) == digest), F.lit(False))


def short(text: Column, most: int = 500) -> Column:
    """The text, or its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def decimal_text(value: Column) -> Column:
    """Plain decimal text without trailing zeros and with a comma."""
    plain = F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1")
    return F.translate(F.regexp_replace(plain, r"\.$", ""), ".", ",")


def normalized_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
