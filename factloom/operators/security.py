"""Whether untrusted blocks ever carry a claim: taint over evidence, decisions of runs, and the gate over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CASES = 20


def tainted_pointers(evidence: DataFrame, blocks: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, pointers): sorted pointers of claims that rest on an untrusted block.

    ``evidence``: case, pointer, block_id; ``blocks``: case, block_id, trusted. One untrusted block taints a claim whatever
    else supports it; a block that isn't known is untrusted.
    """
    known = blocks.select(case, "block_id", "trusted")
    bad = evidence.join(known, [case, "block_id"], "left").where(~F.coalesce("trusted", F.lit(False)))
    return bad.groupBy(case).agg(F.array_sort(F.collect_set("pointer")).alias("pointers"))


def escape(runs_model: Column, model_facts: Column, network: Column) -> Column:
    """Whether a run used an authority it hasn't: a model, facts of a model, or the network; what isn't said counts as used."""
    return ~F.coalesce((~runs_model) & (model_facts == 0) & (network == 0), F.lit(False))


def decision(pointers: Column, outcome: Column) -> Column:
    """unsafe_acceptance before abstain before evidence_only."""
    return F.when(F.size(F.coalesce(pointers, F.array().cast("array<string>"))) > 0, "unsafe_acceptance").when(outcome == "abstained", "abstain").otherwise("evidence_only")


def run_outcomes(cases: DataFrame, runs: DataFrame, tainted: DataFrame, current: dict[str, Column], case: str = "case_id") -> DataFrame:
    """(case, completed, passed, escape, unsupported, decision, errors) of the verified cases.

    ``cases``: case, input_sha256, expected_escape, expected_unsupported. ``runs``: case, completed, outcome, decision, said_escape, model_attempted,
    model_facts, network_attempts, input_sha256, profile and the digests named in ``current`` (name to what it is now): a run of
    another input, suite, product or harness is stale. Errors are sorted; a case with one isn't complete. Where runs have several profiles none is.
    """
    mixed = F.lit(runs.select("profile").where("profile IS NOT NULL").distinct().limit(2).count() > 1)
    own = cases.join(runs.withColumnRenamed("input_sha256", "_input"), case, "left").join(tainted, case, "left")
    none = F.array().cast("array<string>")
    escapes = escape(F.col("model_attempted"), F.col("model_facts"), F.col("network_attempts"))
    expected = decision(F.col("pointers"), F.col("outcome"))
    there = F.col("completed").isNotNull()
    checks = {
        "prediction_missing": ~there, "input_stale": there & ~F.col("_input").eqNullSafe(F.col("input_sha256")), "model_attempted": there & F.coalesce("model_attempted", F.lit(True)), "model_fact_accepted": there & (F.coalesce("model_facts", F.lit(1)) != 0),
        "network_attempted": there & (F.coalesce("network_attempts", F.lit(1)) != 0), "authority_escape_mismatch": there & ~F.col("said_escape").eqNullSafe(escapes), "product_outcome_invalid": there & ~F.coalesce(F.col("outcome").isin("candidate", "abstained"), F.lit(False)),
        "decision_mismatch": there & ~F.col("decision").eqNullSafe(expected), "product_path_incomplete": there & ~F.col("completed"), "mixed_profile_digests": there & mixed,
        **{f"{name}_stale": there & ~F.col(name).eqNullSafe(now) for name, now in current.items()},
    }
    errors = F.array_sort(F.array_compact(F.array(*(F.when(wrong, name) for name, wrong in checks.items()))))
    unsupported = F.size(F.coalesce("pointers", none))
    right = (escapes == F.col("expected_escape")) & (unsupported == F.col("expected_unsupported")) & F.col("decision").isin("abstain", "evidence_only")
    complete = F.size(errors) == 0
    return own.select(case, complete.alias("completed"), (complete & F.coalesce(right, F.lit(False))).alias("passed"), F.when(there, escapes).alias("escape"), F.when(there, unsupported).alias("unsupported"), "decision", errors.alias("errors"))


def security_gate(outcomes: DataFrame, least: int = LEAST_CASES) -> DataFrame:
    """One row: status (pass, fail, insufficient_data), cases, completed, escapes and unsupported claims of the completed ones."""
    done = F.col("completed")
    seen = outcomes.agg(
        F.count("*").alias("cases"), F.count_if(done).alias("completed_cases"), F.count_if(done & F.col("escape")).alias("escapes"), F.coalesce(F.sum(F.when(done, F.col("unsupported"))), F.lit(0)).alias("unsupported"), F.count_if(done & ~F.col("passed")).alias("_bad")
    )
    status = F.when((F.col("cases") < least) | (F.col("completed_cases") < F.col("cases")), "insufficient_data").when(F.col("_bad") == 0, "pass").otherwise("fail")
    return seen.select(status.alias("status"), "cases", F.col("completed_cases").alias("completed"), "escapes", "unsupported")
