"""The comparison operator: typed values of a request's records, ranked only under one common signature.

Input rows are (request, record, ...); every step is a grouped aggregate or a window over a
request, so any number of requests is one job. A request has few records, so its window is
small whatever the table's size. Reasons come in the contract's order and the first one wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold
from .ranking import first_reason, optional_axis

# Rate kinds by what they need and by which direction is better.
NEEDS_TERM = ("financing_profit_rate", "annual_cost_rate")
NEEDS_BASIS = ("profit_share_distribution_rate", "historical_return_rate")
HIGHER_RATES = ("profit_share_distribution_rate", "historical_return_rate", "discount_rate", "reward_rate", "ltv_ratio")
OPEN = ("unknown", "ambiguous")


def gate(records: DataFrame, as_of: Column) -> DataFrame:
    """(request, gate): the first reason that blocks a whole request, or null.

    ``records``: request, record, status, family, observed_at (timestamp), currency,
    segments (array), channel, new_customer, mechanism, secured, starts_on, ends_on,
    validity_status. Unknown channel is null here; segments compare as sets.
    """
    day = as_of.cast("date")
    segments = F.array_sort(F.coalesce("segments", F.array().cast("array<string>")))
    stated = ~F.coalesce(F.col("validity_status"), F.lit("unknown")).isin(*OPEN) & (F.col("starts_on").isNotNull() | F.col("ends_on").isNotNull())
    financing = F.min("family") == "financing"
    secured = [(financing & c, r) for c, r in optional_axis(F.col("secured"), "security_context_unknown", "security_context_mismatch")]
    reason = first_reason(
        (F.bool_or(F.col("status") != "validated"), "record_not_validated"),
        (F.bool_or(F.col("family").isNull() | F.col("family").isin("unknown", "other")), "product_family_unknown"),
        (F.count_distinct("family") > 1, "product_family_mismatch"),
        (F.bool_or(F.col("currency").isNull()), "currency_context_unknown"),
        (F.count_distinct("currency") > 1, "currency_context_mismatch"),
        (F.bool_or(F.size(segments) == 0), "customer_segment_context_unknown"),
        (F.count_distinct(F.array_join(segments, "\u0000")) > 1, "customer_segment_context_mismatch"),
        *optional_axis(F.col("channel"), "sales_channel_context_unknown", "sales_channel_context_mismatch"),
        *optional_axis(F.col("new_customer"), "new_customer_context_unknown", "new_customer_context_mismatch"),
        *optional_axis(F.col("mechanism"), "product_mechanism_context_unknown", "product_mechanism_context_mismatch"),
        *secured,
        (F.first(as_of).isNull(), "as_of_required"),
        (F.bool_or(F.col("observed_at") > as_of), "not_observed_as_of"),
        ((F.count_if(stated) > 0) & (F.count_if(~stated) > 0), "validity_unknown"),
        (F.bool_or(stated & ((F.col("starts_on") > day) | (F.col("ends_on") < day))), "campaign_not_active_as_of"),
    )
    return records.groupBy("request").agg(reason.alias("gate"))


@dataclass(frozen=True)
class Dimension:
    """What a dimension's facts mean: the reasons of its mismatch levels (coarse first), and of several
    signatures or values. With ``single``, two facts of the signature in one record are too many even if equal."""

    name: str
    levels: tuple[str, ...]
    many: str
    many_values: str
    single: bool = False


RATE = Dimension("rate", ("rate_kind_mismatch", "rate_period_mismatch", "rate_basis_mismatch"), "multiple_rate_signatures", "multiple_rate_values_for_signature")
FEE = Dimension("fee", ("fee_kind_mismatch", "fee_basis_mismatch", "fee_value_type_mismatch", "fee_currency_mismatch"), "multiple_fee_signatures", "multiple_fee_signatures", True)
REWARD = Dimension("reward", ("reward_kind_mismatch", "reward_basis_mismatch", "reward_program_mismatch", "reward_context_mismatch"), "multiple_reward_signatures", "multiple_reward_signatures", True)
TERM = Dimension("term", (), "term_ambiguous", "term_ambiguous")


def _key(*parts: Column) -> Column:
    """One comparable string of some parts as a JSON array, which escapes control characters; nulls count as a value."""
    return F.to_json(F.array(*(p.cast("string") for p in parts)))


#: Values are compared as decimals.
NUMBER = "decimal(38,12)"


def _rate(df: DataFrame, kind: str, status: str = "status") -> tuple[Column, Column]:
    """(issue, basis part of the signature) of a rate; columns that ``df`` lacks count as not stated."""
    own = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    kind, period, gross = F.col(kind), F.coalesce(own("period"), F.lit("unspecified")), F.coalesce(own("gross_net_basis"), F.lit("unspecified"))
    no_window = own("reference_starts_on").isNull() | own("reference_ends_on").isNull()
    issue = first_reason(
        (own(status).isin(*OPEN), "rate_basis_unknown"), (kind == "unknown", "rate_kind_unknown"), (kind == "ltv_ratio", None), (period == "unspecified", "rate_period_unknown"),
        (kind.isin(*NEEDS_TERM) & own("term_months").isNull(), "rate_term_context_unknown"),
        (kind.isin(*NEEDS_BASIS) & (gross == "unspecified"), "rate_gross_net_basis_unknown"), ((kind == "historical_return_rate") & no_window, "rate_reference_window_unknown"),
    )
    return issue, _key(gross, own("reference_starts_on"), own("reference_ends_on"), own("term_months"), fold(F.coalesce(own("basis_label"), F.lit(""))))


def _under(pair: Column, part: str | Column) -> Column:
    """The key of a pair's part; "" gives what all its parts begin with. No key holds U+0001 itself."""
    return F.concat(pair, F.lit("\u0001"), F.lit(part) if isinstance(part, str) else part)


def rate_facts(rates: DataFrame) -> DataFrame:
    """Facts from (request, record, index, status, value_percent, kind, period, gross_net_basis,
    reference_starts_on, reference_ends_on, term_months, basis_label, evidence_ids)."""
    kind = F.col("kind")
    issue, basis = _rate(rates, "kind")
    return rates.select(
        "request", "record", "index", issue.alias("issue"), F.array(_key(kind), _key(kind, F.col("period")), _key(kind, F.col("period"), basis)).alias("levels"),
        F.col("value_percent").cast(NUMBER).alias("value"), F.lit(False).alias("waived"), kind.isin(*HIGHER_RATES).alias("higher"), F.lit("percent").alias("unit"), "evidence_ids",
    )


def term_facts(terms: DataFrame) -> DataFrame:
    """One fact for each record from (request, record, index, status, maximum_months, evidence_ids): its longest term."""
    one = terms.groupBy("request", "record").agg(
        F.max("maximum_months").cast(NUMBER).alias("value"), F.bool_or(F.col("status").isin(*OPEN)).alias("_open"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids")
    )
    return one.select(
        "request", "record", F.lit(0).alias("index"), F.when(F.col("_open"), "term_ambiguous").alias("issue"), F.array(F.lit("term")).alias("levels"), "value", F.lit(False).alias("waived"),
        F.lit(True).alias("higher"), F.lit("months").alias("unit"), "evidence_ids",
    )


def fee_facts(fees: DataFrame) -> DataFrame:
    """Facts from (request, record, index, status, kind, basis, waived, amount, currency, percent,
    period, gross_net_basis, basis_label, evidence_ids)."""
    numeric = F.col("amount").isNotNull() != F.col("percent").isNotNull()
    by_rate = F.col("percent").isNotNull()
    issue = first_reason(
        (F.col("status").isin(*OPEN), "fee_basis_unknown"), (F.col("kind") == "unknown", "fee_kind_unknown"), (F.col("basis").isin("unknown", "unspecified"), "fee_basis_unknown"), (F.col("waived"), None),
        (~numeric, "fee_not_numeric"), (by_rate & (F.col("period").isNull() | (F.col("period") == "unspecified") | F.col("basis_label").isNull()), "fee_rate_context_unknown"),
    )
    kind = F.when(by_rate, "rate").otherwise("money")
    detail = F.when(by_rate, _key(F.col("period"), F.col("gross_net_basis"), fold(F.coalesce("basis_label", F.lit(""))))).otherwise(_key(F.col("currency")))
    pair = (_key(F.col("kind")), _key(F.col("kind"), F.col("basis")))
    return fees.select(
        "request", "record", "index", issue.alias("issue"), F.array(*pair, _under(pair[1], kind), _under(_under(pair[1], kind), detail)).alias("levels"),
        F.coalesce(F.col("amount").cast(NUMBER), F.col("percent").cast(NUMBER)).alias("value"), "waived", F.lit(False).alias("higher"), F.when(by_rate, "percent").otherwise(F.col("currency")).alias("unit"),
        "evidence_ids",
    )


def reward_facts(rewards: DataFrame) -> DataFrame:
    """Facts from (request, record, index, status, kind, basis, program_name, amount, currency,
    points, percent, period, minimum_spend, maximum_money, maximum_points, evidence_ids).

    A percentage may bring the context of its rate: rate_kind (default reward_rate), rate_status,
    gross_net_basis, reference_starts_on, reference_ends_on, term_months, basis_label; limits of spending and
    of money their currencies: minimum_spend_currency, maximum_money_currency.
    """
    own = lambda c: F.col(c) if c in rewards.columns else F.lit(None).cast("string")
    rated = rewards.withColumn("_rate_kind", F.coalesce(own("rate_kind"), F.lit("reward_rate")))
    rate_issue, rate_basis = _rate(rated, "_rate_kind", "rate_status")
    kind, money, points, percent = F.col("kind"), F.col("amount").isNotNull(), F.col("points").isNotNull(), F.col("percent").isNotNull()
    program = fold(F.coalesce("program_name", F.lit("")))
    issue = first_reason(
        (F.col("status").isin(*OPEN) | F.col("basis").isin("unknown", "unspecified"), "reward_basis_unknown"), ((kind == "points") & F.col("program_name").isNull(), "reward_program_unknown"),
        (((kind == "money") & ~money) | ((kind == "points") & ~points) | ((kind == "discount") & ~money & ~percent), "reward_not_numeric"),
        (percent & rate_issue.isNotNull(), "reward_rate_context_unknown"), (kind.isin("free", "free_service", "other"), "reward_not_numeric"),
    )
    mode = (
        F.when(kind == "points", _key(F.lit("points"), program)).when(money, _key(F.lit("money"), F.col("currency")))
        .otherwise(_key(F.lit("rate"), F.col("_rate_kind"), F.col("period"), rate_basis))
    )
    limits = (F.col("minimum_spend"), own("minimum_spend_currency"), F.col("maximum_money"), own("maximum_money_currency"), F.col("maximum_points"))
    return rated.select(
        "request", "record", "index", issue.alias("issue"), F.array(_key(kind), _key(kind, F.col("basis")), _key(kind, program), _key(kind, F.col("basis"), mode, *limits)).alias("levels"),
        F.coalesce(*(F.col(c).cast(NUMBER) for c in ("amount", "points", "percent"))).alias("value"), F.lit(False).alias("waived"), F.lit(True).alias("higher"),
        F.when(money, F.col("currency")).when(points, "points").otherwise("percent").alias("unit"), "evidence_ids",
    )


def compared(records: DataFrame, facts: DataFrame, dimension: Dimension, gates: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(request, record, dimension, comparable, rank, value, unit, reason_code, evidence_ids).

    One row for every (request, record) of ``records``, whose ``position`` (default: the record) orders the
    issues. ``facts``: request, record, index, issue, levels (from the coarsest key to the full signature),
    value, waived, higher, unit, evidence_ids. A waived fact meets every signature of its (kind, basis),
    which are the first two levels, and precedes every price; where nobody prices the pair, it
    is a signature of its own. Of issues at one index the first by name counts. Records and facts are shuffled once,
    by request, to ``tasks`` tasks: all later steps are windows and aggregates inside a request.
    """
    name = dimension.name
    position = F.col("position" if "position" in records.columns else "record").alias("position")
    members = records.where("request IS NOT NULL").select("request", "record", F.lit(True).alias("_member"), position)
    own = ["index", "issue", "levels", "value", "waived", "higher", "unit", "evidence_ids"]
    stated = facts.where("request IS NOT NULL AND record IS NOT NULL").select("request", "record", F.lit(False).alias("_member"), *own)
    rows = members.unionByName(stated, allowMissingColumns=True)
    rows = rows.repartition(tasks, "request") if tasks else rows.repartition("request")
    record = Window.partitionBy("request", "record")
    rows = rows.withColumns({"_first": F.row_number().over(record.orderBy(F.desc("_member"))), "_position": F.min("position").over(record), "_known": F.max("_member").over(record)})
    # One row for each record, and the facts of known records.
    rows = rows.where("_known AND (_first = 1 OR NOT _member)").drop("_first", "position", "_known")
    request = Window.partitionBy("request")
    place = F.when(F.col("issue").isNotNull(), F.struct("_position", "record", "index", "issue"))
    rows = rows.withColumns({"_n": F.count_if("_member").over(request), "_last": F.max(F.size("levels")).over(request) - 1, "_issue": F.min(place).over(request)["issue"]}).drop("_position", "index", "issue")
    # Keys of each fact, level by level. A waiver has its pair, both kinds of value, and the signatures that others price under the pair.
    entry = lambda level, key: F.struct(level.cast("int").alias("level"), key.alias("key"))
    plain = F.transform("levels", lambda key, level: entry(level, key))
    pair, top = F.get("levels", F.lit(1)), F.size("levels") - 1
    if len(dimension.levels) > 1:
        rows = rows.withColumn("_priced", F.collect_set(F.when(~F.col("waived"), F.element_at("levels", -1))).over(Window.partitionBy("request", pair)))
        under = F.when(F.size("_priced") > 0, F.col("_priced")).otherwise(F.array(_under(pair, "waived")))
        met = F.concat(F.slice(plain, 1, 2), F.array(*(entry(F.lit(2), _under(pair, kind)) for kind in ("money", "rate"))), F.transform(under, lambda key: entry(top, key)))
        plain = F.when(F.col("waived"), met).otherwise(plain)
    rows = rows.select("*", F.posexplode_outer(plain).alias("_k", "_e"))
    # A fact's own columns go with its first key only.
    once = F.col("_k").isNull() | (F.col("_k") == 0)
    rows = rows.select("request", "record", "_member", "_n", "_last", "_issue", once.alias("_once"), F.col("_e.level").alias("_level"), F.col("_e.key").alias("_at"), *(F.when(once, F.col(c)).alias(c) for c in own[2:]))
    held = Window.partitionBy("request", "_level", "_at")
    rows = rows.withColumns({"_order": F.dense_rank().over(held.orderBy("record")), "_row": F.row_number().over(held.orderBy("record"))})
    # A key is common if as many records have it as the request has.
    common = F.col("_level").isNotNull() & (F.max("_order").over(held) == F.col("_n"))
    rows = rows.withColumn("_shared", common)
    final = F.col("_shared") & (F.col("_level") == F.col("_last"))
    rows = rows.withColumns({
        "_common": F.count_if(final & (F.col("_row") == 1)).over(request), "_key": F.min(F.when(final, F.col("_at"))).over(request),
        **{f"_held{k}": F.coalesce(F.max(F.col("_shared") & (F.col("_level") == k)).over(request), F.lit(False)) for k in range(len(dimension.levels))},
    })
    mismatch = F.lit(None).cast("string")
    for level in reversed(range(len(dimension.levels))):
        mismatch = F.when((F.lit(level) <= F.col("_last")) & ~F.col(f"_held{level}"), dimension.levels[level]).otherwise(mismatch)
    state = {"_issue": F.col("_issue"), "_common": F.col("_common"), "_mismatch": F.when(F.col("_common") == 0, F.coalesce(mismatch, F.lit(dimension.levels[-1] if dimension.levels else dimension.many)))}
    chosen = F.coalesce((F.get("levels", F.col("_last")) == F.col("_key")) | (F.col("waived") & F.startswith("_key", _under(pair, ""))), F.lit(False))
    mine = lambda c: F.when(F.col("_chosen"), c)
    counted = F.count_if("_chosen") if dimension.single else F.count_distinct(mine(F.struct("waived", F.coalesce("value", F.lit(0).cast(NUMBER)))))
    rows = rows.where("_once").select("request", "record", "_member", *(c.alias(k) for k, c in state.items()), chosen.alias("_chosen"), *own[3:]).groupBy("request", "record").agg(
        F.max(~F.col("_member")).alias("_has"), *(F.max(k).alias(k) for k in state), counted.alias("_values"), F.min(mine(F.col("value"))).alias("value"), F.bool_and(mine(F.col("waived"))).alias("waived"),
        F.max(mine(F.col("higher"))).alias("higher"), F.max(mine(F.col("unit"))).alias("unit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(mine(F.col("evidence_ids")))))).alias("evidence_ids"),
    )
    missing = ~F.col("_has")
    no_evidence = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0
    some = lambda c: F.max(c.cast("int")).over(request) == 1
    rows = rows.withColumns({"_any_missing": some(missing), "_any_bare": some(no_evidence), "_worst": F.max(F.coalesce("_values", F.lit(0))).over(request)})
    reason = first_reason(
        (missing, f"{name}_missing"), (F.col("_any_missing"), f"peer_{name}_missing"), (F.col("_issue").isNotNull(), F.col("_issue")), (F.col("_mismatch").isNotNull(), F.col("_mismatch")),
        (F.col("_common") > 1, dimension.many), (F.col("_worst") > 1, dimension.many_values), (no_evidence, f"{name}_evidence_missing"), (F.col("_any_bare"), f"peer_{name}_evidence_missing"),
    )
    if gates is not None:
        rows = rows.join(gates, "request", "left")
        reason = F.coalesce(F.col("gate"), reason)
    rows = rows.withColumn("_reason", reason)
    lead = F.when(F.col("waived"), 0).otherwise(1)
    price = F.when(F.col("waived"), F.lit(0).cast(NUMBER)).otherwise(F.when(F.col("higher"), -F.col("value")).otherwise(F.col("value")))
    ok = F.col("_reason").isNull()
    rank = F.dense_rank().over(request.orderBy(lead, price))
    return rows.withColumn("_rank", rank).select(
        "request", "record", F.lit(name).alias("dimension"), ok.alias("comparable"), F.when(ok, F.col("_rank").cast("bigint")).alias("rank"), F.when(ok & ~F.col("waived"), F.col("value").cast("double")).alias("value"),
        F.when(ok, F.col("unit")).alias("unit"), F.coalesce("_reason", F.when(F.col("higher"), "ranked_higher_is_better").otherwise("ranked_lower_is_better")).alias("reason_code"),
        F.when(ok, F.col("evidence_ids")).alias("evidence_ids"),
    )


def eligibility(records: DataFrame, gates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unranked: compatible where every record has evidence (request, record, evidence_ids) for its context."""
    rows = records.select("request", "record").distinct().join(evidence, ["request", "record"], "left").join(gates, "request", "left")
    bare = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0
    reason = first_reason(
        (F.col("gate").isNotNull(), F.col("gate")), (bare, "eligibility_evidence_missing"), (F.max(bare.cast("int")).over(Window.partitionBy("request")) == 1, "peer_eligibility_evidence_missing")
    )
    return rows.select("request", "record", F.lit("eligibility").alias("dimension"), reason.isNull().alias("comparable"), F.coalesce(reason, F.lit("eligibility_context_compatible")).alias("reason_code"))


def report_digest(outcomes: DataFrame) -> DataFrame:
    """(request, digest): a hash of a request's outcomes in a fixed order, whatever order the rows came in."""
    line = F.concat_ws("\u0000", "record", "dimension", F.col("comparable").cast("string"), F.coalesce(F.col("rank").cast("string"), F.lit("")), F.coalesce(F.col("value").cast("string"), F.lit("")), "reason_code")
    return outcomes.groupBy("request").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
