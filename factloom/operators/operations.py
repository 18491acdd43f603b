"""Operational state as tables: leased jobs, sessions, lock-outs, registry checks, review merges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MINUTE, HOUR = 60, 3600


def job_state(events: DataFrame, job: str, at: str, order: list[Column], max_attempts: int = 3) -> DataFrame:
    """(job, status, attempts, fence): the state that a log of claim, renew, complete and fail
    events leads to.

    A claim starts an attempt with the next fencing number; a complete or fail counts only with
    the number of the latest claim before it; a failure beyond the last attempt is final.
    """
    w = Window.partitionBy(job).orderBy(at, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fenced = events.withColumn("_claims", F.count_if(F.col("event") == "claim").over(w))
    valid = fenced.where((F.col("event") == "claim") | (F.col("fence") == F.col("_claims")))
    last = F.max_by("event", F.struct(at, "_claims", "event"))
    counted = valid.groupBy(job).agg(F.max("_claims").alias("attempts"), last.alias("_last"), F.bool_or(F.col("event") == "complete").alias("_done"))
    status = (
        F.when(F.col("_done"), "completed").when((F.col("_last") == "fail") & (F.col("attempts") >= max_attempts), "dead").when(F.col("_last") == "fail", "retry").otherwise("running")
    )
    return counted.select(job, status.alias("status"), F.col("attempts").cast("bigint").alias("attempts"))


def capped_sessions(events: DataFrame, key: str, seconds: Column, ties: list[Column], idle: int = 30 * MINUTE, cap: int = 8 * HOUR, touch: int = MINUTE) -> DataFrame:
    """Adds ``session`` (from 1). An event goes on with the session while it comes before the idle deadline
    and before ``cap`` seconds after the session's first event; otherwise it begins a new one.

    The deadline is ``idle`` seconds after the last write; an event writes only if the last write is
    ``touch`` seconds or more ago. Where a session begins depends on the one before, so a key's
    events are read in order by one task, holding one session's state; a key's rows are never
    gathered. Null keys are one key; events without a time come first and begin a session each.
    """
    ordered = events.withColumn("_s", seconds.cast("bigint")).repartition(F.col(key)).sortWithinPartitions(key, "_s", *ties)
    schema = T.StructType([*ordered.schema.fields, T.StructField("session", T.LongType())])

    def run(batches):
        now, session, began, wrote = None, 0, None, None
        for batch in batches:
            keys, times, numbers = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index("_s")).to_pylist(), []
            for k, t in zip(keys, times, strict=True):
                if session == 0 or k != now:
                    now, session, began, wrote = k, 1, t, t
                elif t is None or began is None or t >= wrote + idle or t >= began + cap:
                    session, began, wrote = session + 1, t, t
                elif t - wrote >= touch:
                    wrote = t
                numbers.append(session)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "session"])

    return ordered.mapInArrow(run, schema).drop("_s")


def lockout_seconds(failures: Column) -> Column:
    """Seconds to wait after so many failures: none under 5, then 30 doubled each time, 15 minutes from 10 on."""
    return F.when(failures >= 10, 15 * MINUTE).when(failures >= 5, 30 * F.pow(F.lit(2.0), failures - 5)).otherwise(0).cast("bigint")


def failures_in_a_row(events: DataFrame, key: str, order: list[Column], failed: Column) -> DataFrame:
    """Adds ``streak``: failures since the last success, this event included."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = events.withColumn("_ok", F.count_if(~failed).over(w))
    return runs.withColumn("streak", F.count_if(failed).over(Window.partitionBy(key, "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_ok")


def registry_problems(sources: DataFrame) -> DataFrame:
    """(bank, problem) of monitored sources (bank, status, mode, index_url): more than one static
    source, an index url used twice, verified sources of an unavailable bank."""
    per = sources.groupBy("bank").agg(
        F.count_if(F.col("mode") == "static_pages").alias("_static"), F.count("index_url").alias("_urls"), F.count_distinct("index_url").alias("_distinct"),
        F.bool_or(F.col("status") == "unavailable").alias("_off"), F.bool_or(F.col("status") == "verified").alias("_on"),
    )
    problems = F.array_compact(
        F.array(F.when(F.col("_static") > 1, "several_static_sources"), F.when(F.col("_urls") > F.col("_distinct"), "index_url_repeated"), F.when(F.col("_off") & F.col("_on"), "unavailable_with_verified"))
    )
    return per.select("bank", F.explode(problems).alias("problem"))


def merged_reviews(candidates: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, outcome, decision, reviewed_at) of two reviewers' decisions (key, decision, reviewed_at):
    agreed, disagreed, or incomplete where one is missing; decisions on unknown keys are "unknown"."""
    a = first.select(key, F.col("decision").alias("_a"), F.col("reviewed_at").alias("_at"))
    b = second.select(key, F.col("decision").alias("_b"), F.col("reviewed_at").alias("_bt"))
    both = candidates.select(key, F.lit(True).alias("_known")).join(a, key, "full_outer").join(b, key, "full_outer")
    outcome = (
        F.when(F.col("_known").isNull(), "unknown").when(F.col("_a").isNull() | F.col("_b").isNull(), "incomplete").when(F.col("_a") == F.col("_b"), "agreed").otherwise("disagreed")
    )
    return both.select(key, outcome.alias("outcome"), F.when(outcome == "agreed", F.col("_a")).alias("decision"), F.greatest("_at", "_bt").alias("reviewed_at"))


def gold_scores(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(field, tp, fp, fn, abstained_right): set-valued fields (key, field, values); 0/0 stays null in the ratios."""
    none = F.array().cast("array<string>")
    both = gold.select(key, "field", F.col("values").alias("_g")).join(predicted.select(key, "field", F.col("values").alias("_p")), [key, "field"], "full_outer")
    g, p = F.coalesce("_g", none), F.coalesce("_p", none)
    sized = both.select("field", F.size(F.array_intersect(g, p)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"), (F.size(g) == 0).alias("_empty"), ((F.size(g) == 0) & (F.size(p) == 0)).alias("_right"))
    total = sized.groupBy("field").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")), F.count_if("_empty").alias("abstentions"), F.count_if("_right").alias("abstained_right"))
    return total.select(
        "*", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.try_divide("abstained_right", "abstentions").alias("abstention_accuracy")
    )


def dangling_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (source, target) whose target isn't a node (id)."""
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


#: Files of one leaf of a digest.
LEAF = 4096


def files_digest(files: DataFrame, group: list[str] | None = None, number: str = "number") -> DataFrame:
    """One digest for each group of files (path, sha256, ``number``), whatever their order.

    ``number`` places a file (its rank or id): LEAF numbers make a leaf, whose files are hashed in the
    order of their paths, and the leaves' hashes are hashed in order. So one task holds one leaf, and
    in the end one hash for each leaf.
    """
    group = group or []
    line = F.concat_ws(":", "path", "sha256")
    leaves = files.groupBy(*group, F.floor(F.col(number) / LEAF).alias("_leaf")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("_hash"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_leaf", "_hash"))), lambda x: x["_hash"])
    return leaves.groupBy(*group).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


def select_relevant(rows: DataFrame, tokens: Column, keywords: list[str], structured: bool, score: Column, observed: str, id_col: str, limit: int) -> DataFrame:
    """Rows with all keywords, else with any, else (only under a structured filter) all; then by
    falling score, newest, id. The tier is one scalar, not a collected set."""
    hits = F.size(F.array_intersect(tokens, F.lit(keywords))) if keywords else F.lit(0)
    tagged = rows.withColumn("_hits", hits).withColumn("_tier", F.when(F.col("_hits") == len(keywords), 0).when(F.col("_hits") > 0, 1).otherwise(2))
    tagged = tagged if structured else tagged.where("_tier < 2")
    best = tagged.agg(F.min("_tier")).scalar()
    # All rows with a keyword hit at least as good as the best tier stay together.
    return tagged.where(F.col("_tier") <= best).withColumn("_score", score).orderBy(F.desc("_score"), F.desc(observed), F.asc(id_col)).limit(limit).drop("_tier", "_score")


#: What a fetch that brought no page leads to: outcome, coverage and what becomes of the job (a retryable failure is tried again).
FETCH_STATES = {
    "blocked": ("blocked", "blocked", "succeeded"), "not_modified": ("not_modified", "success", "succeeded"), "failed": ("fetch_failed", "unreachable", "failed"), "skipped": ("skipped", "not_found", "succeeded"),
}


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """Adds outcome, coverage, disposition and reason to fetches (status, retryable, error_code); other states give nulls."""
    one = lambda k: F.coalesce(*(F.when(F.col("status") == s, row[k]) for s, row in FETCH_STATES.items()))
    again = (F.col("status") == "failed") & F.coalesce("retryable", F.lit(False))
    return fetches.withColumns(
        {"outcome": one(0), "coverage": one(1), "disposition": F.when(again, "retry").otherwise(one(2)), "reason": F.when(one(0).isNotNull(), F.coalesce("error_code", "status"))}
    )


def source_requests(urls: DataFrame, version: str) -> DataFrame:
    """Adds campaign_key (given, or the bank and 24 digits of the url's hash) and dedupe_key of requests (bank, url, campaign_key)."""
    key = F.coalesce("campaign_key", F.concat(F.col("bank"), F.lit(":"), F.substring(F.sha2("url", 256), 1, 24)))
    keyed = urls.withColumn("campaign_key", key)
    return keyed.withColumn("dedupe_key", F.sha2(F.concat_ws("\u0000", F.lit(version), "campaign_key", "url"), 256))


def new_requests(urls: DataFrame, version: str, queued: DataFrame) -> DataFrame:
    """source_requests() that aren't queued (dedupe_key) yet, one of each."""
    return source_requests(urls, version).dropDuplicates(["dedupe_key"]).join(queued.select("dedupe_key"), "dedupe_key", "left_anti")


def observation_problems(observations: DataFrame) -> DataFrame:
    """Adds identity (scan, else job), expected_key and problem to observations (scan_run_id, job_id, campaign_key, url,
    observation_key): without an identity, or with a key that isn't the expected one."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    identity, rest = blank(F.coalesce("scan_run_id", "job_id")), [blank(F.col("campaign_key")), blank(F.col("url"))]
    expected = F.sha2(F.concat_ws("\u0000", identity, *rest), 256)
    problem = F.when(identity.isNull() | rest[0].isNull() | rest[1].isNull(), "identity_missing").when(F.col("observation_key") != expected, "observation_key_differs")
    return observations.withColumns({"identity": identity, "expected_key": F.when(identity.isNotNull(), expected), "problem": problem})


def eligible_banks(banks: DataFrame, sources: DataFrame, blocked: list[str]) -> DataFrame:
    """Banks (bank) that aren't blocked and have a verified source (bank, verified)."""
    return banks.where(~F.col("bank").isin(*blocked)).join(sources.where("verified").select("bank"), "bank", "left_semi")
