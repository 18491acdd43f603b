"""Facts that answer a question about one record, with their evidence, and verdicts over compared records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalizers import let

STATED, INFERRED = "stated", "inferred"
#: Facts of a record in an answer: with a requested dimension stated, and without one.
MOST, HEADLINES = 3, 2


def evidence_under(evidence: Column, prefix: Column, status: Column | str) -> Column:
    """Sorted ids of evidence (id, pointer, status) of a status whose pointer is ``prefix`` or below it, with or without a leading /data."""
    bare = F.regexp_replace(prefix, "^/data", "")

    def listed(p: Column) -> Column:
        def below(pointer: Column) -> Column:
            return (pointer == p["whole"]) | F.startswith(pointer, p["under_whole"]) | (pointer == p["bare"]) | F.startswith(pointer, p["under_bare"])

        return F.array_sort(F.transform(F.filter(evidence, lambda e: (e["status"] == status) & below(e["pointer"])), lambda e: e["id"]))

    # The prefix is made once, not for each piece of evidence.
    return let(F.struct(prefix.alias("whole"), F.concat(prefix, F.lit("/")).alias("under_whole"), bare.alias("bare"), F.concat(bare, F.lit("/")).alias("under_bare")), listed)


def _fact(label: str, value: Column, ids: Column, ok: Column) -> Column:
    return let(F.when(ok, ids), lambda own: F.when(F.size(own) > 0, F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), own.alias("evidence_ids"))))


def _rate(wanted: Column) -> Column:
    """The monthly financing rate of the wanted term, else the first monthly one, else the first; stated evidence, else inferred."""
    monthly = lambda r: (r["kind"] == "financing_profit_rate") & (r["period"] == "monthly")
    order = lambda r: F.when(monthly(r) & (r["term_months"] == wanted), 0).when(monthly(r), 1).otherwise(2)
    best = F.array_min(F.transform("rates", lambda r, i: F.struct(order(r).alias("order"), i.alias("index"), r["raw"].alias("raw"))))

    def told(one: Column) -> Column:
        prefix = F.concat(F.lit("/data/rates/"), one["index"].cast("string"))
        ids = let(evidence_under(F.col("evidence"), prefix, STATED), lambda stated: F.when(F.size(stated) > 0, stated).otherwise(evidence_under(F.col("evidence"), prefix, INFERRED)))
        return _fact("rate", one["raw"], ids, F.size("rates") > 0)

    return let(best, told)


def _stated(label: str, column: str, value: Column) -> Column:
    return _fact(label, value, evidence_under(F.col("evidence"), F.lit(f"/data/{column}"), STATED), F.size(column) > 0)


def answer_facts(records: DataFrame) -> DataFrame:
    """Adds ``facts``: an array of (label, value, evidence_ids).

    ``records``: dimensions (array of rate, term, fee, reward), wanted_months, evidence (array of id, pointer,
    status) and the arrays rates (kind, period, term_months, raw), terms (maximum_months), fees, rewards and
    financing_amounts (raw). The requested dimensions come first, in order, then the rate and the term; with no requested
    dimension stated, the rate, the amount and the term. A fact without evidence isn't said.
    """
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["raw"]), "; ")
    made = records.withColumns(
        {
            "_rate": _rate(F.col("wanted_months")), "_term": _stated("term", "terms", F.array_max(F.transform("terms", lambda t: t["maximum_months"]))),
            "_fee": _stated("fee", "fees", joined("fees")), "_reward": _stated("reward", "rewards", joined("rewards")),
            "_amount": _stated("amount", "financing_amounts", F.get("financing_amounts", F.lit(0))["raw"]),
        }
    )
    by_name = lambda d: F.when(d == "rate", F.col("_rate")).when(d == "term", F.col("_term")).when(d == "fee", F.col("_fee")).when(d == "reward", F.col("_reward"))
    made = made.withColumn("_asked", F.array_compact(F.transform("dimensions", by_name)))
    more = F.filter(F.array_compact(F.array("_rate", "_term")), lambda f: ~F.exists("_asked", lambda a: a["label"] == f["label"]))
    headline = F.slice(F.array_compact(F.array("_rate", "_amount", "_term")), 1, HEADLINES)
    facts = F.when(F.size("_asked") > 0, F.slice(F.concat("_asked", more), 1, MOST)).otherwise(headline)
    return made.select(*records.columns, facts.alias("facts"))


def verdicts(outcomes: DataFrame) -> DataFrame:
    """(request, dimension, winner, reason): a dimension has a winner only where every record is ranked, the first
    of the best; where none is comparable, the first record's reason; else neither.

    ``outcomes`` are those of compared(); requests of one record have no verdict.
    """
    ranked = F.col("comparable") & F.col("rank").isNotNull()
    per = outcomes.groupBy("request", "dimension").agg(
        F.count("*").alias("_n"), F.count_if(ranked).alias("_ranked"), F.bool_or("comparable").alias("_some"), F.min_by("record", F.struct(F.coalesce("rank", F.lit(0)), F.col("record"))).alias("_first"),
        F.min_by("reason_code", "record").alias("_reason"),
    )
    winner = F.when(F.col("_ranked") == F.col("_n"), F.col("_first"))
    return per.where("_n > 1").select("request", "dimension", winner.alias("winner"), F.when(~F.col("_some"), F.col("_reason")).alias("reason"))
