"""Model proposals meet a draft: quotes are grounded in the source, read again by rules, and only then merged.

A proposal is a field and a quote; its value is what the rules read out of the quote, never what the model says. Scalar
fields take one accepted proposal and open on a conflict; list fields replace facts of the same span or append.
Every step is a join or a window over (document, field), so any number of documents is one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import marks, normalizers, wording
from ..functions.text import search_text
from ..sources.strict import ensure_checkpoint_dir
from .candidates import rate_question_open
from .filters import injection
from .ranking import first_reason

SCALARS = ("title", "summary", "product_family", "campaign_type", "validity", "sales_channel", "new_customer_only")
#: List fields whose entries are told apart by their value, and the first of each stays.
SETS = ("customer_segment",)
#: The scalar field whose value may be bound to the source's own mark when its quote fails.
GROUNDABLE = "campaign_type"
ABSTENTION = 450


def grounded(proposals: DataFrame, blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """``proposals`` with their place (at_block, start, end, kind) or the ``code`` that rejects them.

    ``proposals``: document, nth, field, quote, block_id (null: any block), said_start and said_end (null: none). ``blocks``:
    document, block_id, kind, text. A quote has to stand exactly once, overlapping places counted, in the blocks asked for; offsets that
    the model added have to agree; and neither the quote nor its block may try to take over instructions.
    """
    text = F.col("text")
    lines = blocks.select(F.col(document).alias("_doc"), F.col("block_id").alias("_block"), "kind", "text")
    known = proposals.where(F.col(document).isNotNull() & F.col("nth").isNotNull())
    # One row for all proposals of a document: a block meets them once, and only what is found goes on, without the text.
    asked = known.groupBy(document).agg(F.collect_list(F.struct("nth", "quote", "block_id")).alias("_asked"))
    holds = lambda p: F.coalesce((F.length(p["quote"]) > 0) & F.contains(text, p["quote"]), F.lit(False))

    def place(p: Column) -> Column:
        # Whether it stands once or more often is all that counts.
        hits = lambda at: F.when(at.isNull(), 0).when(F.position(p["quote"], text, at + 1) > 0, 2).otherwise(1)
        return normalizers.let(F.when(holds(p), F.instr(text, p["quote"])), lambda at: F.struct(p["nth"].alias("nth"), hits(at).alias("_n"), (at - 1).alias("start"), (at - 1 + F.length(p["quote"])).alias("end")))

    met = lines.join(asked.hint("shuffle_hash"), F.col(document) == F.col("_doc"))
    met = met.withColumn("_meant", F.filter("_asked", lambda p: (p["block_id"] == F.col("_block")) | (p["block_id"].isNull() & holds(p))))
    met = met.withColumn("bad", F.when(F.exists("_meant", holds), injection(text))).select(document, "_block", "kind", "bad", F.inline(F.transform("_meant", place)))
    best = F.max(F.when(F.col("_n") > 0, F.struct(F.col("_block").alias("at_block"), "start", "end", "kind", "bad")))
    found = met.groupBy(document, "nth").agg(F.count("_block").alias("_blocks"), F.sum("_n").alias("_hits"), best.alias("_at"))
    own = known.join(found, [document, "nth"], "left").withColumns({"_blocks": F.coalesce("_blocks", F.lit(0)), "_hits": F.coalesce("_hits", F.lit(0))})
    contradicts = F.coalesce((F.col("said_start") != F.col("_at.start")) | (F.col("said_end") != F.col("_at.end")), F.lit(False))
    code = first_reason(
        (F.col("block_id").isNotNull() & (F.col("_blocks") == 0), "source_block_missing"), (F.col("_hits") > 1, "evidence_quote_non_unique"), (F.col("_hits") == 0, "evidence_quote_missing"),
        (contradicts, "legacy_offsets_contradict_quote"), (F.col("_at.bad") | injection(F.col("quote")), "prompt_injection_evidence_rejected"),
    )
    return own.select(*proposals.columns, *(F.col(f"_at.{c}").alias(c) for c in ("at_block", "start", "end", "kind")), code.alias("code"))


def _read(value: Column, code: Column | None = None) -> Column:
    """struct<value, code>: a value as text, or the code that rejects it."""
    return F.struct(value.cast("string").alias("value"), (F.lit(None) if code is None else code).cast("string").alias("code"))


def _only(labels: Column, wrong: str, hint: Column, contradiction: str) -> Column:
    """The one label of an array, if the hint doesn't contradict it."""
    one = F.get(labels, F.lit(0))
    return _read(one, F.when(F.size(labels) != 1, wrong).when(hint != one, contradiction))


def _json(value: Column) -> Column:
    return F.to_json(value)


def _hinted(hint: Column, checks: dict[str, Column], code: str) -> Column:
    """``code`` where a hint (a map) names another value than the rules read."""
    out = F.lit(False)
    for key, value in checks.items():
        out = out | F.coalesce(hint[key] != value.cast("string"), F.lit(False))
    return F.when(out, code)


def _rate(quote, hint, kind, day):
    def judged(r: Column) -> Column:
        v = r["value"]
        code = F.coalesce(
            F.when(v.isNull(), "rate_not_deterministically_normalizable").when((v["kind"] == "unknown") | (v["period"] == "unspecified"), "rate_semantics_incomplete"),
            _hinted(hint, {"rate_kind": v["kind"], "rate_period": v["period"], "gross_net_basis": v["gross_net_basis"]}, "rate_hint_contradicts_quote"),
        )
        return _read(_json(v), code)

    return normalizers.let(normalizers.rate(quote), judged)


def _amount(quote, hint, kind, day):
    context = search_text(quote).rlike(r"\b(?:finansman|kullandirim|tutar)\b")
    return normalizers.let(normalizers.money(quote)["value"], lambda v: _read(_json(v), F.when(~context, "financing_amount_context_missing").when(v.isNull(), "money_not_deterministically_normalizable")))


def _term(quote, hint, kind, day):
    # All options of a quote have its span, so the last one stays.
    return normalizers.let(normalizers.term(quote)["value"], lambda v: _read(_json(F.try_element_at(v, F.lit(-1))), F.when(v.isNull(), "term_not_deterministically_normalizable")))


def _fee(quote, hint, kind, day):
    def judged(v: Column) -> Column:
        code = F.coalesce(
            F.when(~search_text(quote).rlike(normalizers.FEE_MARK), "fee_terminology_missing").when(v.isNull(), "fee_value_not_supported"),
            _hinted(hint, {"fee_kind": v["kind"], "fee_basis": v["basis"]}, "fee_hint_contradicts_quote"),
        )
        return _read(_json(v), code)

    return normalizers.let(normalizers.fee(quote), judged)


def _reward(quote, hint, kind, day):
    """Points before refunded money before a discount before a free service; each has to state its value."""

    def judged(p: Column) -> Column:
        text = p["text"]
        sort = F.when(text.rlike(wording.POINTS), "points").when(text.rlike(r"\b(?:nakit\s+iade|para\s+iadesi)\b"), "money").when(text.contains("indirim"), "discount").when(text.rlike(r"\b(?:ucretsiz|bedelsiz)\b"), "free_service")
        basis = F.when(sort.isin("points", "money"), "campaign_total").otherwise("per_transaction")
        value = F.struct(
            sort.alias("kind"), basis.alias("basis"), F.when(sort == "points", p["points"]).alias("points"), F.when(sort.isin("money", "discount"), p["money"]).alias("money"),
            F.when(sort == "discount", p["rate"]).alias("rate"), F.when(sort == "free_service", quote).alias("description"),
        )
        code = F.coalesce(
            F.when(sort.isNull(), "reward_terminology_missing"), _hinted(hint, {"reward_kind": sort, "reward_basis": basis}, "reward_hint_contradicts_quote"),
            F.when((sort == "points") & (p["n"] != 1), "reward_points_not_exact").when((sort == "money") & p["money"].isNull(), "money_reward_value_invalid")
            .when((sort == "discount") & ~text.rlike(r"\bindirim\b"), "discount_terminology_missing").when((sort == "discount") & p["rate"].isNull() & p["money"].isNull(), "discount_value_invalid"),
        )
        return _read(_json(value), code)

    found = F.regexp_extract_all(search_text(quote), F.lit(wording.POINTS), 1)
    parts = F.struct(
        search_text(quote).alias("text"), F.size(found).alias("n"), F.translate(F.get(found, F.lit(0)), ",", ".").try_cast("decimal(20,4)").alias("points"),
        normalizers.money(quote)["value"].alias("money"), normalizers.rate(quote, kind_hint=F.lit("discount_rate"))["value"].alias("rate"),
    )
    return normalizers.let(parts, judged)


def _new_only(quote, hint, kind, day):
    stated = F.when(marks.restriction(quote).isNotNull(), True).when(marks.universal(quote).isNotNull(), False)
    return normalizers.let(stated, lambda s: _read(s, F.when(s.isNull(), "new_customer_restriction_not_explicit").when(hint["boolean_value"] != s.cast("string"), "new_customer_hint_contradicts_quote")))


def _segment(quote, hint, kind, day):
    labels = marks.named(quote, marks.SEGMENTS)
    bad = (F.size(labels) != 1) | ((F.get(labels, F.lit(0)) == "yeni_musteri") & marks.restriction(quote).isNull())
    return _read(F.get(labels, F.lit(0)), F.when(bad, "customer_segment_not_supported_by_quote"))


def _channels(quote: Column) -> Column:
    sentences = F.split(quote, r"(?<=[.!?;])\s+|\n")
    return F.array_distinct(F.flatten(F.transform(sentences, lambda s: F.coalesce(F.transform(marks.channel_places(s)["places"], lambda m: m["label"]), F.array().cast("array<string>")))))


Reader = Callable[[Column, Column, Column, Column], Column]
#: How each field's quote is read: (quote, hint, block kind, reference day) -> struct<value, code>. ``hint`` is a map of what the model claimed.
READERS: dict[str, Reader] = {
    "title": lambda q, h, k, d: _read(q, F.when(~k.eqNullSafe(F.lit("heading")), "title_must_be_heading")),
    "summary": lambda q, h, k, d: _read(q),
    "product_family": lambda q, h, k, d: _only(marks.named(q, marks.FAMILIES), "product_family_not_supported_by_quote", h["product_family"], "product_family_hint_contradicts_quote"),
    "campaign_type": lambda q, h, k, d: _only(marks.named(q, marks.CAMPAIGNS), "campaign_type_not_supported_by_quote", h["campaign_type"], "campaign_type_hint_contradicts_quote"),
    "rate": _rate, "financing_amount": _amount, "term": _term, "fee": _fee, "reward": _reward,
    "validity": lambda q, h, k, d: normalizers.let(normalizers.validity(q, d)["value"], lambda v: _read(_json(v), F.when(v.isNull(), "validity_not_deterministically_normalizable"))),
    "customer_segment": _segment,
    "eligibility_condition": lambda q, h, k, d: _read(q, F.when(~marks.eligible(q), "eligibility_not_supported_by_quote")),
    "sales_channel": lambda q, h, k, d: _only(_channels(q), "sales_channel_not_supported_by_quote", h["sales_channel"], "sales_channel_hint_contradicts_quote"),
    "new_customer_only": _new_only,
}


def read(placed: DataFrame, readers: dict[str, Reader] = READERS, day: Column | None = None) -> DataFrame:
    """grounded() proposals with their ``value``; a quote that its field's reader refuses gets that code.

    ``placed`` may have ``hint`` (map<string, string>). Fields are read one after another over their own rows, so no row pays for all readers.
    """
    hint = F.col("hint") if "hint" in placed.columns else F.lit(None).cast("map<string,string>")
    day = F.lit(None).cast("date") if day is None else day
    none = _read(F.lit(None), F.lit("field_not_supported"))
    result = none
    for field, reader in readers.items():
        result = F.when(F.col("field") == field, reader(F.col("quote"), hint, F.col("kind"), day)).otherwise(result)
    judged = placed.withColumn("_read", F.when(F.col("code").isNull(), result))
    return judged.select(*placed.columns[:-1], F.coalesce("code", F.col("_read.code")).alias("code"), F.when(F.col("code").isNull() & F.col("_read.code").isNull(), F.col("_read.value")).alias("value"))


def _rates_open(values: Column) -> Column:
    """Whether rates as JSON leave the price open."""
    return rate_question_open(F.transform(values, lambda v: F.struct(F.get_json_object(v, "$.kind").alias("kind"), F.get_json_object(v, "$.period").alias("period"))))


#: Fields that stay unresolved although a proposal was accepted, by what their merged values say.
INCOMPLETE: dict[str, Callable[[Column], Column]] = {"rate": _rates_open}


def merge(
    drafts: DataFrame, facts: DataFrame, proposals: DataFrame, marked: DataFrame | None = None, document: str = "document_id",
    scalars: tuple[str, ...] = SCALARS, sets: tuple[str, ...] = SETS, incomplete: dict[str, Callable[[Column], Column]] = INCOMPLETE,
) -> tuple[DataFrame, DataFrame]:
    """(facts, summary) after a model's response to each document.

    ``drafts``: document, issues, unresolved (arrays), and of the response outcome (null or "extracted": whole) and
    abstentions (array). ``facts``: document, field, nth, value, block_id, start, end. ``proposals``: read() ones and, if values may be bound to the
    source's own marks, ``claimed``: the value of GROUNDABLE that the proposal names. ``marked``: document, value, block_id, start, end of those marks.

    Facts come back with ``origin`` (draft or model) and ``nth`` inside the field; the summary has accepted, issues and unresolved.
    The proposals are written once in the checkpoint folder. Scalars come by field name, each field's rejections in order before its conflict; then lists in order, abstentions, the outcome,
    and fields that stay open. An issue that is known already isn't repeated.
    """
    ensure_checkpoint_dir(proposals.sparkSession)
    # Written once: grounding and reading are dear, and several steps use them.
    own = proposals.withColumn("_scalar", F.col("field").isin(*scalars)).withColumn("_valid", F.col("code").isNull()).checkpoint()
    by_field = Window.partitionBy(document, "field")
    single = own.where("_scalar").withColumn("_good", F.count_if(F.col("_valid")).over(by_field))
    # A value whose quote fails is bound to the source's own mark, once, where nothing else settles the field.
    claimed = F.col("claimed") if "claimed" in proposals.columns else F.lit(None).cast("string")
    settled = facts.where(F.col("field") == GROUNDABLE).select(document).distinct().withColumn("_settled", F.lit(True))
    places = facts.limit(0).select(document, "value", "block_id", "start", "end") if marked is None else marked
    places = places.select(document, F.col("value").alias("_claimed"), F.struct("value", "block_id", "start", "end").alias("_mark"))
    single = single.withColumn("_claimed", F.when((F.col("field") == GROUNDABLE) & ~F.col("_valid") & (F.col("_good") == 0), claimed)).join(settled, document, "left").join(places, [document, "_claimed"], "left")
    bound = F.col("_mark").isNotNull() & F.col("_settled").isNull()
    single = single.withColumn("_bound", bound & (F.min(F.when(bound, F.col("nth"))).over(by_field) == F.col("nth")))
    taken = (F.col("_valid") & (F.col("_good") == 1)) | F.col("_bound")
    new_scalars = single.where(taken).select(
        document, "field", F.col("nth").alias("_order"),
        *(F.when(F.col("_bound"), F.col(f"_mark.{m}")).otherwise(F.col(c)).alias(m) for m, c in (("value", "value"), ("block_id", "at_block"), ("start", "start"), ("end", "end"))),
    )
    lists = own.where("NOT _scalar AND _valid").select(document, "field", F.col("nth").alias("_order"), "value", F.col("at_block").alias("block_id"), "start", "end")
    changes = new_scalars.unionByName(lists).withColumn("_new", F.lit(1))
    every = facts.select(document, "field", F.col("nth").alias("_order"), "value", "block_id", "start", "end", F.lit(0).alias("_new")).unionByName(changes)
    # One key for a scalar, the value for a set, the span for any other list.
    key = F.when(F.col("field").isin(*scalars), F.lit("")).when(F.col("field").isin(*sets), F.to_json(F.array("value"))).otherwise(F.to_json(F.array(F.col("block_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))))
    same = Window.partitionBy(document, "field", "_key")
    is_set = F.col("field").isin(*sets)
    newest = F.max(F.when(F.col("_new") == 1, F.col("_order"))).over(same)
    oldest = F.min(F.when(F.col("_new") == 1, F.col("_order"))).over(same)
    drafted = F.max(1 - F.col("_new")).over(same) == 1
    kept = F.when(F.col("_new") == 0, is_set | newest.isNull()).otherwise(F.when(is_set, ~drafted & (F.col("_order") == oldest)).otherwise(F.col("_order") == newest))
    merged = every.withColumn("_key", key).withColumn("_kept", kept).where("_kept")
    place = F.row_number().over(Window.partitionBy(document, "field").orderBy("_new", "_order"))
    merged = merged.select(document, "field", place.alias("nth"), "value", "block_id", "start", "end", F.when(F.col("_new") == 1, "model").otherwise("draft").alias("origin"))

    order = lambda phase, field, nth: F.struct(F.lit(phase).alias("phase"), field.alias("field"), nth.cast("bigint").alias("nth"))
    refused = F.concat(F.lit("model_fact_rejected:"), F.col("field"), F.lit(":"), F.col("code"))
    told = single.where("NOT _valid").select(document, order(1, F.col("field"), F.col("nth")).alias("_at"), F.when(F.col("_bound"), F.concat(F.lit("model_value_grounded:"), F.col("field"))).otherwise(refused).alias("issue"))
    clash = single.where("_good > 1").select(document, "field").distinct().select(document, order(1, F.col("field"), F.lit(1 << 40)).alias("_at"), F.concat(F.lit("model_scalar_conflict:"), F.col("field"), F.lit(":multiple_accepted_proposals")).alias("issue"))
    missed = own.where("NOT _scalar AND NOT _valid").select(document, order(2, F.lit(""), F.col("nth")).alias("_at"), refused.alias("issue"))
    before = drafts.select(document, F.posexplode("issues").alias("_k", "issue")).select(document, order(0, F.lit(""), F.col("_k")).alias("_at"), "issue")
    silent = drafts.select(document, F.posexplode("abstentions").alias("_k", "_why")).select(document, order(3, F.lit(""), F.col("_k")).alias("_at"), F.concat(F.lit("model_abstained:"), F.substring("_why", 1, ABSTENTION)).alias("issue"))
    partly = drafts.where("outcome <> 'extracted'").select(document, order(4, F.lit(""), F.lit(0)).alias("_at"), F.concat(F.lit("model_outcome:"), F.col("outcome")).alias("issue"))
    resolved = single.where(taken).select(document, "field").unionByName(own.where("NOT _scalar AND _valid").select(document, "field"))
    counted = resolved.groupBy(document).agg(F.count("*").alias("accepted"), F.collect_set("field").alias("_resolved"))
    open_fields = None
    for field, rule in incomplete.items():
        values = merged.where(F.col("field") == field).groupBy(document).agg(F.collect_list("value").alias("_values"))
        still = resolved.where(F.col("field") == field).select(document, "field").distinct().join(values, document).where(rule(F.col("_values"))).select(document, "field")
        open_fields = still if open_fields is None else open_fields.unionByName(still)
    issues = before.unionByName(told).unionByName(clash).unionByName(missed).unionByName(silent).unionByName(partly)
    if open_fields is not None:
        issues = issues.unionByName(open_fields.select(document, order(5, F.col("field"), F.lit(0)).alias("_at"), F.concat(F.lit("model_field_incomplete:"), F.col("field")).alias("issue")))
        again = open_fields.groupBy(document).agg(F.collect_set("field").alias("_open"))
    else:
        again = drafts.limit(0).select(document, F.array().cast("array<string>").alias("_open"))
    listed = issues.groupBy(document, "issue").agg(F.min("_at").alias("_at")).groupBy(document).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "issue"))), lambda x: x["issue"]).alias("_issues"))
    none = F.array().cast("array<string>")
    settled_fields = F.array_except(F.coalesce("_resolved", none), F.coalesce("_open", none))
    summary = drafts.join(counted, document, "left").join(again, document, "left").join(listed, document, "left").select(
        document, F.coalesce("accepted", F.lit(0)).cast("bigint").alias("accepted"), F.coalesce("_issues", none).alias("issues"), F.array_sort(F.array_except("unresolved", settled_fields)).alias("unresolved"),
    )
    return merged, summary


#: The newer form of responses: quotes only, one fact for each field, no outcome and no abstentions; and its longest quote.
QUOTES_ONLY, QUOTE_MOST = "model-extraction/1.1", 500
# The claims that a field's proposal may carry, and claims that say nothing.
CLAIMS = {
    "product_family": ("product_family",), "campaign_type": ("campaign_type",), "rate": ("rate_kind", "rate_period", "gross_net_basis"), "fee": ("fee_kind", "fee_basis"), "reward": ("reward_kind", "reward_basis"),
    "sales_channel": ("sales_channel",), "new_customer_only": ("boolean_value",),
}
EMPTY_CLAIMS = {
    "product_family": "unknown", "campaign_type": "unknown", "sales_channel": "unknown", "rate_kind": "unknown", "rate_period": "unspecified", "gross_net_basis": "unspecified", "fee_kind": "unknown", "fee_basis": "unspecified",
}


def contract_problems(responses: DataFrame, proposals: DataFrame, sent: DataFrame, document: str = "document_id", longest: int = QUOTE_MOST) -> DataFrame:
    """(document, problem, nth): the first thing in a response that breaks its contract, and the proposal it is in; null where all holds.

    ``responses``: document, schema_version, outcome, abstentions, requested (arrays). ``proposals``: document, nth, field, quote, block_id, raw_text,
    evidence_quote, evidence_block, hint (map of claims). ``sent``: document, block_id, visible: the windows that the request showed.

    Each proposal is checked for itself first, then the response as a whole, then each one against the request: the field was asked for, the block
    was sent, and the quote stands in what was shown of it. Of a proposal in both forms, quote and block have to agree; claims have to belong to
    the field and to say something.
    """
    hint = F.coalesce("hint", F.create_map().cast("map<string,string>"))
    claims = F.map_keys(F.map_filter(hint, lambda k, v: v.isNotNull()))
    allowed = F.coalesce(F.element_at(F.create_map(*(x for f, own in CLAIMS.items() for x in (F.lit(f), F.lit(list(own))))), F.col("field")), F.array().cast("array<string>"))
    empty = F.lit(False)
    for name, value in EMPTY_CLAIMS.items():
        empty = empty | F.coalesce(hint[name] == value, F.lit(False))
    quote, block = F.coalesce("quote", "evidence_quote"), F.coalesce("block_id", "evidence_block")
    own_problem = first_reason(
        (F.coalesce(F.col("quote") != F.col("evidence_quote"), F.lit(False)), "quote_contradicts_evidence"), (F.coalesce(F.col("block_id") != F.col("evidence_block"), F.lit(False)), "block_contradicts_evidence"),
        (F.col("raw_text").isNotNull() & quote.isNull(), "quote_missing"), (F.coalesce(F.col("raw_text") != quote, F.lit(False)), "raw_text_is_no_quote"), (F.size(F.array_except(claims, allowed)) > 0, "hint_not_permitted"), (empty, "hint_says_nothing"),
    )
    place = lambda phase, nth: F.struct(F.lit(phase).alias("phase"), nth.cast("bigint").alias("nth"))
    asked = proposals.withColumns({"_quote": quote, "_block": block, "_own": own_problem, "_bare": F.col("quote").isNotNull() & F.col("block_id").isNull() & F.col("raw_text").isNull() & F.col("evidence_quote").isNull() & F.col("evidence_block").isNull() & (F.size(claims) == 0)})
    single = asked.where("_own IS NOT NULL").select(document, place(0, F.col("nth")).alias("at"), F.col("_own").alias("problem"), "nth")

    facts = asked.groupBy(document).agg(F.count("*").alias("_n"), F.count_distinct("field").alias("_fields"), F.min(F.when(~F.col("_bare"), F.col("nth"))).alias("_full"), F.min(F.when(F.length("quote") > longest, F.col("nth"))).alias("_long"))
    whole = responses.join(facts, document, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    newer, extracted = F.col("schema_version") == QUOTES_ONLY, F.coalesce(F.col("outcome") == "extracted", F.lit(False))
    problem = first_reason(
        (newer & (F.col("outcome").isNotNull() | (F.size("abstentions") > 0)), "outcome_or_abstentions_not_allowed"), (newer & (F.col("_n") > F.col("_fields")), "several_facts_of_a_field"), (newer & F.col("_full").isNotNull(), "not_quote_only"),
        (newer & F.col("_long").isNotNull(), "quote_too_long"), (extracted & (F.col("_n") == 0), "extracted_without_facts"), (F.col("outcome").isNotNull() & ~extracted & (F.col("_n") > 0), "facts_without_extraction"),
    )
    of_response = whole.select(document, place(1, F.lit(0)).alias("at"), problem.alias("problem"), F.lit(None).cast(proposals.schema["nth"].dataType).alias("nth")).where("problem IS NOT NULL")

    shown = sent.select(F.col(document).alias("_doc"), F.col("block_id").alias("_sent"), "visible")
    met = asked.join(shown, (F.col(document) == F.col("_doc")) & (F.col("_block").isNull() | (F.col("_block") == F.col("_sent"))), "left")
    seen = met.groupBy(document, "nth", "field", "_block").agg(F.count("_sent").alias("_blocks"), F.coalesce(F.bool_or(F.contains("visible", "_quote")), F.lit(False)).alias("_there"))
    judged = seen.join(responses.select(document, "requested"), document)
    late = first_reason((~F.array_contains("requested", F.col("field")), "field_not_requested"), (F.col("_block").isNotNull() & (F.col("_blocks") == 0), "block_not_sent"), (~F.col("_there"), "quote_not_in_window"))
    against = judged.select(document, place(2, F.col("nth")).alias("at"), late.alias("problem"), "nth").where("problem IS NOT NULL")
    first = single.unionByName(of_response).unionByName(against).groupBy(document).agg(F.min(F.struct("at", "problem", "nth")).alias("_first"))
    return responses.select(document).join(first, document, "left").select(document, F.col("_first.problem").alias("problem"), F.col("_first.nth").alias("nth"))
