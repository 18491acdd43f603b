"""Dense ranks, common signatures and the comparison gate, for many requests at once.

A request compares a few records; all functions work on rows (request, record, ...) so that any
number of requests is one job. Values of different signatures are never ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense_ranked(df: DataFrame, group: list[str], value: Column, higher_is_better: bool, waived: Column | None = None) -> DataFrame:
    """Adds ``rank``: 1 is best, equal values share a rank. A waiver precedes every value where lower is better."""
    lead = F.when(F.coalesce(waived, F.lit(False)), 0).otherwise(1) if waived is not None else F.lit(1)
    shown = F.when(lead == 0, F.lit(0.0)).otherwise(value.cast("double"))
    order = [lead.desc(), shown.desc()] if higher_is_better else [lead.asc(), shown.asc()]
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))


def _numbered(facts: DataFrame, request: str, record: str, tasks: int | None) -> DataFrame:
    """Facts together by request, with ``_place``: the number of the record in it (null for a null record), and ``_records``: how many it has."""
    rows = facts.where(F.col(request).isNotNull())
    rows = rows.repartition(tasks, request) if tasks else rows.repartition(request)
    place = F.when(F.col(record).isNotNull(), F.dense_rank().over(Window.partitionBy(request).orderBy(F.col(record).desc_nulls_last())))
    return rows.withColumn("_place", place).withColumn("_records", F.coalesce(F.max("_place").over(Window.partitionBy(request)), F.lit(0)))


def common_signatures(facts: DataFrame, request: str, record: str, signature: list[str], tasks: int | None = None) -> DataFrame:
    """Signatures that every record of a request has (relational division): (request, *signature). Facts are shuffled once, by request, to ``tasks`` tasks."""
    rows = _numbered(facts.select(request, record, *signature), request, record, tasks)
    own = rows.groupBy(request, *signature).agg(F.countDistinct("_place").alias("_have"), F.max("_records").alias("_records"))
    return own.where("_have = _records").select(request, *signature)


def common_fee_signatures(facts: DataFrame, request: str, record: str, pair: list[str], signature: list[str], waived: str, tasks: int | None = None) -> DataFrame:
    """Signatures common under waivers: each record prices the signature or waives its (kind,
    basis) pair; a pair that nobody prices is common if every record waives it (signature nulls).

    Records of a priced signature are those that waive the pair and the others that price it, so no waiver is joined with
    the signatures it covers; all steps stay inside a request, whose facts are shuffled once, to ``tasks`` tasks.
    """
    rows = _numbered(facts.select(request, record, *pair, *signature, F.col(waived).alias("_waived")), request, record, tasks)
    own, both = Window.partitionBy(request, *pair, "_place"), Window.partitionBy(request, *pair)
    rows = rows.withColumn("_waives", F.coalesce(F.max("_waived").over(own), F.lit(False))).withColumn("_first", F.row_number().over(own.orderBy(record)))
    once = F.col("_waives") & (F.col("_first") == 1) & F.col("_place").isNotNull()
    rows = rows.withColumn("_waivers", F.count_if(once).over(both)).withColumn("_sold", F.coalesce(F.max(~F.col("_waived")).over(both), F.lit(False)))
    # A null in a pair is equal to no other one: its waivers cover no price.
    stated = F.lit(True)
    for c in pair:
        stated = stated & F.col(c).isNotNull()
    covers = F.col("_waives") & stated
    keys = [F.when(F.col("_sold"), F.col(s)).alias(s) for s in signature]
    found = rows.where("_waived IS NOT NULL").groupBy(request, *pair, "_sold", *keys).agg(
        F.bool_or(~F.col("_waived")).alias("_offered"), F.countDistinct(F.when(~F.col("_waived") & ~covers, F.col("_place"))).alias("_price"),
        F.max(F.when(stated | ~F.col("_sold"), F.col("_waivers")).otherwise(0)).alias("_waivers"), F.max("_records").alias("_records"),
    )
    return found.where("(_offered OR NOT _sold) AND _price + _waivers = _records").select(request, *pair, *signature)


def selected_values(facts: DataFrame, common: DataFrame, request: str, record: str, signature: list[str], value: str, none: str, many: str, many_values: str) -> DataFrame:
    """(request, record, value, reason): the one value of each record for the one common signature.

    ``reason`` is null where it is settled, else ``none`` (no common signature), ``many`` (more
    than one) or ``many_values`` (a record has several values for it), the same for the request.
    """
    counts = common.groupBy(request).agg(F.count("*").alias("_common"))
    held = facts.select(request, record).distinct().join(counts, request, "left").withColumn("_common", F.coalesce("_common", F.lit(0)))
    matching = facts.join(common, [request, *signature], "left_semi").groupBy(request, record).agg(
        F.countDistinct(value).alias("_values"), F.first(value).alias("value")
    )
    joined = held.join(matching, [request, record], "left")
    worst = Window.partitionBy(request)
    reason = (
        F.when(F.col("_common") == 0, none).when(F.col("_common") > 1, many)
        .when(F.max(F.coalesce("_values", F.lit(0))).over(worst) > 1, many_values)
    )
    return joined.select(request, record, F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def first_reason(*checks: tuple[Column, Column | str | None]) -> Column:
    """The reason of the first check that holds, else null: order is part of the contract."""
    out = None
    for condition, reason in checks:
        reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def optional_axis(value: Column, unknown: str, mismatch: str) -> list[tuple[Column, str]]:
    """Checks of an optional context axis inside an aggregate: absent everywhere is compatible,
    absent on one side only is unknown, more than one known value is a mismatch."""
    known, missing = F.count_distinct(value), F.count_if(value.isNull())
    return [((known > 0) & (missing > 0), unknown), (known > 1, mismatch)]


def own_or_peer(df: DataFrame, request: str, affected: Column, own: str, peer: str) -> Column:
    """The own reason for affected records and the peers' reason for the others of such a request."""
    any_affected = F.max(affected.cast("int")).over(Window.partitionBy(request)) == 1
    return F.when(affected, own).when(any_affected, peer)
