"""Candidate records: building and replay, rates out of force, open questions, unique quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import marks, normalizers
from ..functions.text import search_text


def replay(candidates: DataFrame, expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate, reason): null where every fact of a candidate has its evidence, else the first reason against it.

    ``candidates``: candidate, source_document, document, bank, document_bank. ``expected``: candidate, position,
    pointer, raw (null where the fact isn't a quote). ``evidence``: candidate, position, pointer, quote, reason (of
    verify_evidence(), null where it holds). The order is: another document, another bank, then evidence by position
    (its own reason, or a pointer that no fact has), then facts by position (no evidence, or none that is the raw value).
    """
    known = expected.select("candidate", "pointer").distinct().withColumn("_known", F.lit(True))
    found = evidence.join(known, ["candidate", "pointer"], "left")
    wrong = F.coalesce("reason", F.when(F.col("_known").isNull(), "orphan_evidence_pointer"))
    first_wrong = found.withColumn("_wrong", wrong).where("_wrong IS NOT NULL").groupBy("candidate").agg(F.min_by("_wrong", F.struct("position", "pointer")).alias("_wrong"))
    quotes = evidence.select("candidate", "pointer", F.coalesce("quote", F.lit("")).alias("_quote"))
    held = expected.join(quotes, ["candidate", "pointer"], "left").groupBy("candidate", "position", "pointer").agg(
        F.count("_quote").alias("_n"), F.bool_or((F.col("_quote") == F.col("raw")) | F.col("raw").isNull()).alias("_same")
    )
    bare = F.when(F.col("_n") == 0, "unsupported_fact").when(~F.col("_same"), "raw_evidence_mismatch")
    first_bare = held.withColumn("_bare", bare).where("_bare IS NOT NULL").groupBy("candidate").agg(F.min_by("_bare", F.struct("position", "pointer")).alias("_bare"))
    reason = F.coalesce(
        F.when(~F.col("source_document").eqNullSafe(F.col("document")), "source_document_mismatch"), F.when(~F.col("bank").eqNullSafe(F.col("document_bank")), "bank_mismatch"), F.col("_wrong"), F.col("_bare")
    )
    return candidates.join(first_wrong, "candidate", "left").join(first_bare, "candidate", "left").select("candidate", reason.alias("reason"))


def out_of_force(sentence: Column, reference: Column) -> Column:
    """Whether a sentence dates its own validity so that the reference date isn't inside; without a readable window: no."""
    window = normalizers.validity(sentence, reference)
    value = window["value"]
    return F.coalesce((value["ends_on"] < reference) | (value["starts_on"] > reference), F.lit(False))


def rate_question_open(rates: Column) -> Column:
    """Whether an array of rates (kind, period) leaves the price open: none but ratios of value, or one of unknown kind or period."""
    pricing = F.filter(rates, lambda r: r["kind"] != "ltv_ratio")
    return (F.size(pricing) == 0) | F.exists(pricing, lambda r: (r["kind"] == "unknown") | (r["period"] == "unspecified"))


def priority_fields(required: Column, unresolved: Column) -> Column:
    """Required fields that are still unresolved, sorted: what to ask first."""
    return F.array_sort(F.array_intersect(required, unresolved))


def occurrences(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, overlapping places included; an empty or null quote: 0."""
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(quote) > 0, F.regexp_count(text, literal)).otherwise(0)


def unique_quotes(blocks: DataFrame, quotes: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, quote, n, block_id, start): how often each proposed quote stands in its document's blocks
    (document, block_id, text); the place is given only where it is the only one."""
    placed = quotes.select(document, "quote").distinct().join(blocks, document, "left").withColumn("_n", F.coalesce(occurrences(F.col("text"), F.col("quote")), F.lit(0)))
    found = placed.groupBy(document, "quote").agg(
        F.sum("_n").alias("n"), F.max(F.when(F.col("_n") > 0, F.struct("block_id", (F.instr("text", F.col("quote")) - 1).alias("start")))).alias("_at"),
    )
    only = F.col("n") == 1
    return found.select(document, "quote", "n", F.when(only, F.col("_at.block_id")).alias("block_id"), F.when(only, F.col("_at.start")).alias("start"))


def without(value: Column, kind: T.DataType, name: str) -> Column:
    """``value`` without any field called ``name``, at whatever depth; other fields by name. Null structs stay null."""
    if isinstance(kind, T.StructType):
        kept = [without(value[f.name], f.dataType, name).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name) if f.name != name]
        return F.when(value.isNotNull(), F.struct(*kept))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without(x, kind.elementType, name))
    return value


def derived_rows(records: DataFrame, data: str = "data", name: str = "raw") -> DataFrame:
    """Public rows of records: ``data`` without its source forms, and ``derived_id``, a hash of the rest in a fixed order."""
    public = records.withColumn(data, without(F.col(data), records.schema[data].dataType, name))
    line = F.to_json(data, {"ignoreNullFields": "false"})
    return public.withColumn("derived_id", F.concat(F.lit("derived:"), F.sha2(line, 256)))


def fetch_states(pages: DataFrame, processed: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``state`` to pages: not_modified where a row of the same ``key`` (address, content hash, processing
    identity) was processed already, else process. A page without an address or hash is always processed."""
    known = processed.select(*key).distinct().withColumn("_known", F.lit(True))
    return pages.join(known, key, "left").withColumn("state", F.when(F.col("_known"), "not_modified").otherwise("process")).drop("_known")


# Where a candidate keeps each field; list fields carry the place inside the list.
POINTERS = {
    "title": "/data/title", "summary": "/data/summary", "product_family": "/data/product_family", "campaign_type": "/data/campaign_type", "rate": "/data/rates/", "financing_amount": "/data/financing_amounts/",
    "term": "/data/terms/", "fee": "/data/fees/", "reward": "/data/rewards/", "validity": "/data/validity", "customer_segment": "/data/customer_segments/", "eligibility_condition": "/data/eligibility_conditions/",
    "product_currency": "/data/comparison_context/product_currency", "sales_channel": "/data/comparison_context/sales_channel", "new_customer_only": "/data/comparison_context/new_customer_only",
    "product_mechanism": "/data/comparison_context/product_mechanism", "secured": "/data/comparison_context/secured",
}
#: Segments are named twice: as text and, in the context of comparisons, as key.
SEGMENT_KEYS = "/data/comparison_context/customer_segment_keys/"
#: Fields whose value is no quote but a label or a figure derived from one.
DERIVED = ("product_family", "campaign_type", "product_currency", "sales_channel", "new_customer_only", "product_mechanism", "secured")
MOST_ISSUES = 100


def _pointer(field: Column, nth: Column) -> Column:
    base = F.element_at(F.create_map(*(F.lit(x) for pair in POINTERS.items() for x in pair)), field)
    return F.when(F.endswith(base, F.lit("/")), F.concat(base, (nth - 1).cast("string"))).otherwise(base)


def _identity(facts: DataFrame, key: list[str]) -> DataFrame:
    """(key, candidate): the hash of a candidate's facts in the order of their pointers, which no order of rows changes."""
    line = F.to_json(F.struct("pointer", F.coalesce("value", F.lit("")).alias("value"), "quote", F.col("block_id").cast("string").alias("block_id"), "start", "end", "status"))
    return facts.groupBy(*key).agg(F.concat(F.lit("candidate:"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).alias("candidate"))


def build(facts: DataFrame, states: DataFrame, documents: DataFrame, currencies: DataFrame | None = None, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(candidates, facts) of the drafts of ``documents`` (document, bank).

    ``facts``: document, field, nth, value, quote, block_id, start, end. ``states``: document, issues, unresolved. A draft without a title makes no
    candidate, only an error. ``currencies``: document, currency, quote, block_id, start, end of pages that state one
    currency; where the amounts agree on one, that is the product's, else the page's. Candidates: document, bank, candidate, issues (at
    most MOST_ISSUES, the last saying that some are missing), error. Their facts: document, candidate, position, pointer, field, value, quote, block_id, start, end, status.
    """
    stated = facts.withColumn("status", F.when(F.col("field").isin("product_family", "campaign_type", "sales_channel", "new_customer_only", "product_mechanism"), "inferred").otherwise("stated"))
    columns = [document, "field", "nth", "value", "quote", "block_id", "start", "end", "status"]
    amounts = stated.where("field = 'financing_amount'").withColumn("_currency", F.get_json_object("value", "$.currency"))
    agreed = amounts.groupBy(document).agg(F.count_distinct("_currency").alias("_n"), F.min_by(F.struct(F.col("_currency").alias("value"), "quote", "block_id", "start", "end", "status"), "nth").alias("_m"))
    own = agreed.where("_n = 1").select(document, F.lit("product_currency").alias("field"), F.lit(1).alias("nth"), *(F.col(f"_m.{c}").alias(c) for c in columns[3:]))
    bound = stated.select(*columns).unionByName(own)
    if currencies is not None:
        rest = currencies.where("currency IS NOT NULL").join(own, document, "left_anti")
        bound = bound.unionByName(rest.select(document, F.lit("product_currency").alias("field"), F.lit(1).alias("nth"), F.col("currency").alias("value"), "quote", "block_id", "start", "end", F.lit("inferred").alias("status")))
    pointed = bound.select("*", _pointer(F.col("field"), F.col("nth")).alias("pointer"))
    keys = pointed.where("field = 'customer_segment'").withColumn("pointer", F.concat(F.lit(SEGMENT_KEYS), (F.col("nth") - 1).cast("string"))).withColumn("field", F.lit("customer_segment_key"))
    every = pointed.unionByName(keys)
    titled = every.where("field = 'title'").select(document).distinct().withColumn("_titled", F.lit(True))
    named = _identity(every.join(titled, document), [document])
    listed = F.array_distinct(F.concat("issues", F.transform(F.array_sort("unresolved"), lambda f: F.concat(F.lit("unresolved:"), f))))
    issues = F.when(F.size(listed) > MOST_ISSUES, F.concat(F.slice(listed, 1, MOST_ISSUES - 1), F.array(F.lit("issues_truncated")))).otherwise(listed)
    made = documents.join(states, document).join(named, document, "left").select(document, "bank", "candidate", issues.alias("issues"), F.when(F.col("candidate").isNull(), "title_unresolved").alias("error"))
    position = F.row_number().over(Window.partitionBy(document).orderBy("pointer"))
    return made, every.join(named, document).select(document, "candidate", position.alias("position"), "pointer", "field", "value", "quote", "block_id", "start", "end", "status")


def _same(field: str, value: Column, raw: Column, day: Column) -> Column:
    """Whether a field's value is what the rules read out of its own quote; rates are read with what they claim as hints."""
    part = lambda name: F.get_json_object(value, f"$.{name}")
    if field == "rate":
        given = lambda name, unknown: F.when(part(name) != unknown, part(name))
        again = normalizers.rate(raw, kind_hint=given("kind", "unknown"), period_hint=given("period", "unspecified"), gross_net_hint=given("gross_net_basis", "unspecified"))["value"]
        kept = lambda v: (v["value_percent"] == part("value_percent").cast("decimal(20,6)")) & (v["kind"] == part("kind")) & (v["period"] == part("period")) & (v["gross_net_basis"] == part("gross_net_basis"))
    elif field == "financing_amount":
        again, kept = normalizers.money(raw)["value"], lambda v: (v["amount"] == part("amount").cast("decimal(20,4)")) & v["currency"].eqNullSafe(part("currency"))
    elif field == "term":
        again = normalizers.term(raw)["value"]
        kept = lambda v: F.exists(v, lambda t: t["minimum_months"].eqNullSafe(part("minimum_months").cast("int")) & t["maximum_months"].eqNullSafe(part("maximum_months").cast("int")))
    elif field == "validity":
        again, kept = normalizers.validity(raw, day)["value"], lambda v: v["starts_on"].eqNullSafe(part("starts_on").cast("date")) & v["ends_on"].eqNullSafe(part("ends_on").cast("date"))
    elif field == "sales_channel":
        again, kept = marks.channel_places(raw)["places"], lambda v: F.exists(v, lambda m: m["label"] == value)
    else:
        again, kept = marks.named(raw, {"product_family": marks.FAMILIES, "campaign_type": marks.CAMPAIGNS}[field]), lambda v: F.array_contains(v, value)
    return normalizers.let(again, lambda v: F.coalesce(kept(v), F.lit(False)))


# What a replay says where a field isn't what its evidence gives, in the order of the checks.
MISMATCHES = (
    ("product_family", "product_family_evidence_laundering"), ("campaign_type", "campaign_type_evidence_laundering"), ("sales_channel", "sales_channel_evidence_laundering"), ("rate", "rate_normalization_mismatch"),
    ("financing_amount", "money_normalization_mismatch"), ("term", "term_normalization_mismatch"), ("validity", "validity_normalization_mismatch"),
)
LOCAL_AMOUNT, FOREIGN_SIGN = r"₺\s*\d[\d.,]*|\d[\d.,]*\s*(?:(?:bin|milyon|milyar)\s+)?(?:tl|try|turk\s+lirasi)\b", r"[$€£]|\b(?:usd|eur|gbp|chf|jpy|sar|aed|rub|cny)\b|\b(?:dolar|euro|avro|sterlin|frang|frank)\w*"


def replay_values(candidates: DataFrame, facts: DataFrame, page_currencies: DataFrame, day: Column | None = None, document: str = "document_id") -> DataFrame:
    """(candidate, reason): the first thing that a candidate states and its own quotes don't give; null where all follows.

    Comes after replay(), which checks where the quotes stand. Labels have to be named by their quotes, figures to be read out of them
    again, the currency to follow from the amounts, else from a page (document, currency) of one currency with a quote that states it,
    segment keys from segment texts, and the candidate's id from its facts. ``candidates``: document, candidate, issues; ``facts`` as build() gives them.
    A financing sheet whose type came from the registry needs its own financing rate and a quote that names the financing.
    """
    day = F.lit(None).cast("date") if day is None else day
    wrong = F.lit(None).cast("int")
    for k, (field, _) in reversed(list(enumerate(MISMATCHES))):
        wrong = F.when((F.col("field") == field) & ~_same(field, F.col("value"), F.col("quote"), day), k).otherwise(wrong)
    sheet = (F.col("field") == "campaign_type") & (F.col("value") == "financing_rate") & (F.col("status") == "inferred") & F.array_contains(marks.named(F.col("quote"), marks.FAMILIES), "financing")
    read = facts.withColumns({"_wrong": wrong, "_sheet": sheet, "_segment": F.when(F.col("field") == "customer_segment", marks.named(F.col("quote"), marks.SEGMENTS))})
    key = search_text(F.col("quote"))
    local = (F.col("field") == "product_currency") & (F.col("status") == "inferred") & key.rlike(LOCAL_AMOUNT) & ~key.rlike(FOREIGN_SIGN)
    is_type = F.col("field") == "campaign_type"
    known = F.when(F.col("field") == "financing_amount", F.get_json_object("value", "$.currency"))
    seen = read.groupBy("candidate").agg(
        F.min(F.when(~is_type, F.col("_wrong"))).alias("_first"), F.bool_or(is_type & F.col("_wrong").isNotNull()).alias("_type_wrong"), F.bool_or("_sheet").alias("_sheet"),
        F.bool_or((F.col("field") == "rate") & (F.get_json_object("value", "$.kind") == "financing_profit_rate")).alias("_priced"),
        F.count_distinct(known).alias("_currencies"), F.min(known).alias("_currency"), F.max(F.when(F.col("field") == "product_currency", F.col("value"))).alias("_stated"), F.bool_or(local).alias("_local"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "customer_segment", F.struct("pointer", F.when(F.size("_segment") == 1, F.get("_segment", F.lit(0))).alias("key"))))).alias("_derived"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "customer_segment_key", F.struct("pointer", F.col("value").alias("key"))))).alias("_keys"),
    )
    again = _identity(facts.withColumnRenamed("candidate", "_claimed"), ["_claimed"]).withColumnRenamed("candidate", "_again")
    hinted = F.exists("issues", lambda i: F.startswith(i, F.lit("registry_hint:campaign_type:")))
    laundered = F.col("_type_wrong") & ~(hinted & F.col("_priced") & F.col("_sheet"))
    type_at = [f for f, _ in MISMATCHES].index("campaign_type")
    first = F.least(F.col("_first"), F.when(laundered, type_at))
    agreed = F.when(F.col("_currencies") == 1, F.col("_currency"))
    expected = F.coalesce(agreed, F.col("currency"))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    whole = candidates.join(seen, "candidate", "left").join(again, F.col("candidate") == F.col("_claimed"), "left").join(page_currencies, document, "left")
    by_value = F.element_at(F.lit([code for _, code in MISMATCHES]), first + 1)
    reason = F.coalesce(
        F.when(first.isNotNull(), by_value), F.when(~F.col("_stated").eqNullSafe(expected), "product_currency_derivation_mismatch"),
        F.when(agreed.isNull() & F.col("_stated").isNotNull() & ~F.col("_local"), "currency_evidence_laundering"),
        F.when(F.exists(keys(F.col("_derived")), lambda k: k.isNull()) | ~keys(F.col("_derived")).eqNullSafe(keys(F.col("_keys"))), "customer_segment_derivation_mismatch"),
        F.when(~F.col("_again").eqNullSafe(F.col("candidate")), "candidate_id_mismatch"),
    )
    return whole.select("candidate", reason.alias("reason"))
