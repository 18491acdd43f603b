"""Scans of sources as folds over landed attempts: sitemap walks, dispositions, index branches, first successes.

Nothing is fetched here: attempts and bodies are tables. What a scan does with them depends on their order, so each source's state is
a row that a bounded number of joins or one aggregate carries on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.strict import ensure_checkpoint_dir

#: Sitemaps read for a source at most, and addresses kept of it.
FETCHES, POOL = 6, 3_000
# What the end of a fetch means for outcome, coverage and the job; and codes that are a policy's block.
FETCH_ENDS = {
    "blocked": ("blocked", "blocked", "succeeded"), "not_modified": ("not_modified", "success", "succeeded"), "failed": ("fetch_failed", "unreachable", "failed"), "skipped": ("skipped", "not_found", "succeeded"),
}
POLICY_BLOCKS = (
    "access_challenge", "authentication_required", "host_not_allowed", "redirect_policy_violation", "robots_disallowed", "robots_redirect_limit", "robots_redirect_without_location",
)
#: Of several pages of one source the first of these that occurs is its status.
WORST_FIRST = ("failed", "blocked", "success", "not_modified")
NO_CANDIDATE, FETCHED, NO_DETAIL = "no_candidate_succeeded", "official_candidate_fetched_and_cleaned", "official_site_reachable_no_public_campaign_detail_discovered"


def sitemap_walk(sources: DataFrame, bodies: DataFrame, allowed, source: str = "source_id", fetches: int = FETCHES, pool: int = POOL) -> DataFrame:
    """(source, nth, url): the addresses that a walk of a source's sitemaps finds, in order.

    ``sources``: source, roots (array of arrays: the first sitemaps of each host in order). ``bodies``: url, locs (array, in order), one row for each
    sitemap that was landed. ``allowed`` tells from (source row's columns, url) whether an address may be used. A host's sitemaps are a queue; sitemaps found
    go to its end unless they wait there already, the next host begins when it is empty, and each one taken from it,
    landed or not, spends one of ``fetches``. The walk ends with them or with ``pool`` addresses. It takes one join a fetch; ``bodies`` are
    made and dealt by address once, before the first, so a fetch only deals the sources by the sitemap they take next.
    """
    ensure_checkpoint_dir(sources.sparkSession)
    item = "array<struct<host:int,url:string>>"
    seeds = F.flatten(F.transform("roots", lambda urls, h: F.transform(urls, lambda u: F.struct(h.alias("host"), u.alias("url")))))
    fit = lambda q: F.filter(q, lambda x: allowed(x["url"]))
    state = sources.withColumns({"_queue": fit(seeds).cast(item), "_found": F.array().cast("array<string>")}).drop("roots").checkpoint()
    landed = bodies.select(F.col("url").alias("_url"), F.col("locs").alias("_locs")).repartition("_url").checkpoint()
    for _ in range(fetches):
        head = F.get("_queue", F.lit(0))
        step = state.withColumns({"_head": head["url"], "_host": head["host"]}).join(landed, F.col("_head") == F.col("_url"), "left")
        rest = F.slice("_queue", 2, F.greatest(F.size("_queue") - 1, F.lit(0)))
        is_map = lambda u: F.endswith(F.lower(u), F.lit(".xml"))
        open_ = (F.size("_queue") > 0) & (F.size("_found") < pool)
        locs = F.when(open_, F.coalesce("_locs", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        step = step.withColumns({"_rest": F.when(open_, rest).otherwise(F.col("_queue")), "_use": F.filter(locs, lambda u: allowed(u))})
        fresh = F.array_except(F.filter("_use", is_map), F.transform(F.filter("_rest", lambda x: x["host"] == F.col("_host")), lambda x: x["url"]))
        queue = F.concat(F.filter("_rest", lambda x: x["host"] == F.col("_host")), F.transform(fresh, lambda u: F.struct(F.col("_host").alias("host"), u.alias("url"))), F.filter("_rest", lambda x: x["host"] > F.col("_host")))
        found = F.slice(F.array_distinct(F.concat("_found", F.filter("_use", lambda u: ~is_map(u)))), 1, pool)
        state = step.withColumns({"_queue": F.coalesce(queue, F.col("_rest")).cast(item), "_found": found}).select(*sources.drop("roots").columns, "_queue", "_found").checkpoint()
    return state.select(source, F.posexplode("_found").alias("nth", "url"))


def disposition(fetch: Column, retryable: Column, error: Column, clean: Column, clean_retryable: Column, extraction: Column, issue: Column, created: Column) -> Column:
    """struct<stage, outcome, coverage, disposition, reason> of one processed source: where it ended and what becomes of its job.

    ``fetch`` success goes on to ``clean`` (failed or not) and to ``extraction`` (abstained, needs_review, validated); an unknown state is null.
    """
    end = lambda stage, outcome, coverage, job, reason: F.struct(
        F.lit(stage).alias("stage"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), F.lit(coverage).alias("coverage"), (F.lit(job) if isinstance(job, str) else job).alias("disposition"), reason.cast("string").alias("reason"),
    )
    again = lambda flag: F.when(flag, "retry").otherwise("failed")
    kept = lambda outcome: F.when(created, outcome).otherwise("record_unchanged")
    out = F.when(fetch == "success", F.when(clean == "failed", end("clean", "clean_failed", "partial", again(clean_retryable), F.coalesce(error, F.lit("clean_failed"))))
        .when(extraction == "abstained", end("extract", "extraction_abstained", "partial", "succeeded", F.concat(F.lit("extraction_abstained: "), issue)))
        .when(extraction == "needs_review", end("persist", kept("review_required"), "partial", "succeeded", F.lit("review_required")))
        .when(extraction == "validated", end("persist", kept("record_created"), "success", "succeeded", F.lit(None))))
    for status, (outcome, coverage, job) in FETCH_ENDS.items():
        out = out.when(fetch == status, end("fetch", outcome, coverage, again(retryable) if status == "failed" else job, F.coalesce(error, fetch)))
    return out


def scan_results(indexes: DataFrame, known: DataFrame, seen: DataFrame, source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(results, targets) of one scan.

    ``indexes``: source, position, status (success, not_modified, blocked, failed), changed, error: one row for each index or static page read.
    ``known``: source, url; ``seen``: source, position, url: what a successful read shows. A source's targets are the known ones and those seen; a read that
    failed still enqueues what is known. Results: source, status, known, discovered, enqueued, changed, error (the first).
    """
    good = seen.join(indexes.where("status = 'success'").select(source, "position"), [source, "position"], "left_semi").select(source, "url").distinct()
    own = known.select(source, "url").distinct().withColumn("_known", F.lit(1))
    targets = own.join(good.withColumn("_seen", F.lit(1)), [source, "url"], "full").join(indexes.select(source).distinct(), source, "left_semi")
    counts = targets.groupBy(source).agg(F.count("_known").alias("known"), F.count_if(F.col("_known").isNull()).alias("discovered"), F.count("*").alias("enqueued"))
    worst = F.min(F.array_position(F.lit(list(WORST_FIRST)), F.col("status")))
    read = indexes.groupBy(source).agg(F.element_at(F.lit(list(WORST_FIRST)), worst.cast("int")).alias("status"), F.bool_or("changed").alias("changed"), F.min(F.when(F.col("error").isNotNull(), F.struct("position", "error")))["error"].alias("error"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    results = read.join(counts, source, "left").select(source, "status", zero("known"), zero("discovered"), zero("enqueued"), "changed", "error")
    return results, targets.select(source, "url", F.col("_known").isNull().alias("discovered"))


def coverage_status(fetch: Column, error: Column) -> Column:
    """success, blocked (also by a policy's code), not_found or unreachable."""
    return F.when(fetch == "success", "success").when((fetch == "blocked") | error.isin(*POLICY_BLOCKS), "blocked").when(error == "http_404", "not_found").otherwise("unreachable")


def first_successes(attempts: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, status, reason, url, sources, campaigns, attempts): a source's candidates are tried in order until one is fetched and cleaned.

    ``attempts``: source, ordinal, url, kind, fetch, error, detail, cleaning_error, campaigns. Status and reason are those of the last one tried; one that
    couldn't be cleaned is unreachable and the next is tried. A home page without any campaign so far counts as not found.
    """
    fetched = F.col("fetch") == "success"
    stops = fetched & F.col("cleaning_error").isNull()
    upto = F.min(F.when(stops, F.col("ordinal"))).over(Window.partitionBy(source))
    tried = attempts.withColumn("_stop", upto).where("_stop IS NULL OR ordinal <= _stop")
    status = F.when(fetched & ~stops, "unreachable").otherwise(coverage_status(F.col("fetch"), F.col("error")))
    told = F.concat(F.coalesce("error", F.lit("collection_failed")), F.lit(": "), F.trim(F.replace(F.coalesce("detail", F.lit("no additional detail")), F.lit("\n"), F.lit(" "))))
    reason = F.substring(F.when(stops, FETCHED).when(fetched, F.concat(F.lit("cleaning_failed: "), "cleaning_error")).otherwise(told), 1, 500)
    last = F.max(F.struct("ordinal", status.alias("status"), reason.alias("reason"), "url", "kind", stops.alias("done")))
    folded = tried.groupBy(source).agg(last.alias("l"), F.count_if(fetched).alias("sources"), F.coalesce(F.sum(F.when(stops, F.col("campaigns"))), F.lit(0)).alias("campaigns"), F.count("*").alias("attempts"))
    bare = F.col("l.done") & (F.col("l.kind") == "homepage") & (F.col("campaigns") == 0)
    return folded.select(source, F.when(bare, "not_found").otherwise(F.col("l.status")).alias("status"), F.when(bare, NO_DETAIL).otherwise(F.col("l.reason")).alias("reason"), "l.url", "sources", "campaigns", "attempts")


def attempt_problems(sources: DataFrame, attempts: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, problem, success): whether the attempts of a source (source, ordinal, fetch, coverage) agree with its status, and the one that succeeded.

    In order: no attempts; an attempt whose two statuses disagree; several successes; success without one, or one without success. Null where all agrees.
    """
    good, covered = F.col("fetch") == "success", F.col("coverage") == "success"
    seen = attempts.groupBy(source).agg(F.min(F.when(good != covered, F.col("ordinal"))).alias("_odd"), F.count_if(good).alias("_good"), F.min(F.when(good, F.col("ordinal"))).alias("_at"))
    both = sources.select(source, "status").join(seen, source, "left")
    is_good = F.col("status") == "success"
    problem = (
        F.when(F.col("_good").isNull(), "attempts_missing").when(F.col("_odd").isNotNull(), "inconsistent_attempt").when(F.col("_good") > 1, "multiple_successful_attempts")
        .when(is_good & (F.col("_good") == 0), "no_successful_attempt").when(~is_good & (F.col("_good") > 0), "unexpected_successful_attempt")
    )
    return both.select(source, problem.alias("problem"), F.when(problem.isNull(), F.col("_at")).alias("success"))
