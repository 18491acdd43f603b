"""Facet counts over a filtered set in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def facet_values(single: dict[str, Column], multi: dict[str, Column]) -> Column:
    """(dim, value, label) structs of a row: one per single dimension, and the distinct folded
    values of each multi-valued one (the first casing seen is the label)."""
    parts = [F.array(F.struct(F.lit(d).alias("dim"), c.cast("string").alias("value"), c.cast("string").alias("label"))) for d, c in single.items()]
    parts += [_multi(d, values) for d, values in multi.items()]
    return F.concat(*parts)


def _multi(dim: str, values: Column) -> Column:
    folded = F.array_distinct(F.transform(values, lambda x: F.lower(x)))

    def entry(v):
        return F.struct(F.lit(dim).alias("dim"), v.alias("value"), F.get(F.filter(values, lambda x: F.lower(x) == v), F.lit(0)).alias("label"))

    return F.transform(folded, entry)


def facet_counts(df: DataFrame, single: dict[str, Column], multi: dict[str, Column], top: int = 100) -> DataFrame:
    """(dim, value, label, n): counts of each dimension's values, null values left out.

    The label is the most frequent casing, ties to the smallest. At most ``top`` values of a
    dimension, by falling count, then value: that limit is the feature of a facet list.
    """
    exploded = df.select(F.explode(facet_values(single, multi)).alias("f")).select("f.*").where("value IS NOT NULL")
    by_label = exploded.groupBy("dim", "value", "label").agg(F.count("*").alias("n"))
    merged = dominant(by_label, ["dim", "value"], "label", "n")
    order = Window.partitionBy("dim").orderBy(F.desc("n"), F.asc("value"))
    return merged.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).select("dim", "value", "label", "n")


def dominant(counts: DataFrame, key: list[str], label: str, n: str) -> DataFrame:
    """Per key the sum of ``n`` and the label with the largest ``n``, ties to the smallest label."""
    best = F.min(F.struct((-F.col(n)).alias("_n"), F.col(label).alias("_label")))
    return counts.groupBy(*key).agg(F.sum(n).alias(n), best["_label"].alias(label))
