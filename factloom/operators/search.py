"""Keyword search with a structured fallback and a relaxation ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cover_rank, matches_all, words


def search(df: DataFrame, text: Column, keywords: list[str], observed: str, id_col: str, limit: int) -> DataFrame:
    """Rows that have all keywords, by falling cover rank, then newest, then id."""
    found = df.withColumn("_tokens", words(text)).where(matches_all(F.col("_tokens"), keywords))
    ranked = found.withColumn("score", cover_rank(F.col("_tokens"), keywords)).drop("_tokens")
    return ranked.orderBy(F.desc("score"), F.desc(observed), F.asc(id_col)).limit(limit)


def with_fallback(df: DataFrame, text: Column, keywords: list[str], structured: Column | None, observed: str, id_col: str, limit: int) -> DataFrame:
    """Search inside the structured filter; where keywords find nothing there, the filter alone
    answers, because keywords rank but don't veto. Adds ``tier`` (0 search, 1 fallback)."""
    base = df if structured is None else df.where(structured)
    scored = base.withColumn("_tokens", words(text)).withColumn("_hit", matches_all(F.col("_tokens"), keywords))
    scored = scored.withColumn("score", F.when(F.col("_hit"), cover_rank(F.col("_tokens"), keywords)).otherwise(0.0)).withColumn("tier", F.when(F.col("_hit"), 0).otherwise(1))
    if structured is None:
        scored = scored.where("tier = 0")
    # One row: the best tier there is.
    best = scored.agg(F.min("tier").alias("best")).scalar()
    return scored.where(F.col("tier") == best).drop("_tokens", "_hit").orderBy(F.desc("score"), F.desc(observed), F.asc(id_col)).limit(limit)


def relaxed(df: DataFrame, attempts: list[Column]) -> DataFrame:
    """Rows of the first attempt (a condition) that finds any, with its number; one scan decides."""
    tagged = df
    for k, condition in enumerate(attempts):
        tagged = tagged.withColumn(f"_try{k}", F.coalesce(condition, F.lit(False)))
    first = F.lit(None).cast("int")
    for k in reversed(range(len(attempts))):
        first = F.when(F.bool_or(f"_try{k}"), k).otherwise(first)
    best = tagged.agg(first.alias("best")).scalar()
    chosen = None
    for k in range(len(attempts)):
        chosen = F.when(best == k, F.col(f"_try{k}")) if chosen is None else chosen.when(best == k, F.col(f"_try{k}"))
    return tagged.where(chosen).withColumn("attempt", best).drop(*(f"_try{k}" for k in range(len(attempts))))


def relevance(tokens: Column, keywords: list[str], dimensions: Column) -> Column:
    """3 points for each dimension a row has, 1 for each keyword."""
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.array_contains(tokens, k).cast("int")
    return 3 * dimensions + hits
