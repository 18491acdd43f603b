"""Candidates by hand: building, and each reason of a replay of values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates

FACTS = "document_id int, field string, nth int, value string, quote string, block_id string, start int, end int"
TITLE = ("title", 1, "Başlık", "Başlık")
RATE = ("rate", 1, '{"value_percent":2.79,"kind":"financing_profit_rate","period":"monthly","gross_net_basis":"unspecified"}', "finansman kâr payı oranı aylık %2,79")
AMOUNT = ("financing_amount", 1, '{"amount":500.0000,"currency":"TRY"}', "500 TL")
CASES = {
    "whole": ([TITLE, RATE, AMOUNT, ("term", 1, '{"minimum_months":36,"maximum_months":36}', "36 ay"), ("customer_segment", 1, "emekli", "emekliler")], None),
    "family": ([TITLE, ("product_family", 1, "card", "finansman")], "product_family_evidence_laundering"),
    "type": ([TITLE, ("campaign_type", 1, "points", "indirim")], "campaign_type_evidence_laundering"),
    "channel": ([TITLE, ("sales_channel", 1, "web", "Mobil şubeden başvurun")], "sales_channel_evidence_laundering"),
    "rate": ([TITLE, (*RATE[:2], RATE[2].replace("2.79", "2.97"), RATE[3])], "rate_normalization_mismatch"),
    "money": ([TITLE, (*AMOUNT[:3], "5.000 TL")], "money_normalization_mismatch"),
    "term": ([TITLE, ("term", 1, '{"minimum_months":12,"maximum_months":36}', "36 ay")], "term_normalization_mismatch"),
    "validity": ([TITLE, ("validity", 1, '{"ends_on":"2026-08-31"}', "31 Temmuz tarihine kadar geçerlidir")], "validity_normalization_mismatch"),
    "two currencies": ([TITLE, AMOUNT, ("financing_amount", 2, '{"amount":5.0000,"currency":"USD"}', "5 USD")], None),
    "segment": ([TITLE, ("customer_segment", 1, "emekli", "gençler")], "customer_segment_derivation_mismatch"),
    "no title": ([RATE], "title_unresolved"),
    "first of two": ([TITLE, ("product_family", 1, "card", "finansman"), (*RATE[:2], RATE[2].replace("2.79", "2.97"), RATE[3])], "product_family_evidence_laundering"),
}


@pytest.fixture(scope="module")
def built(spark):
    names = list(CASES)
    facts = spark.createDataFrame([(d, f, n, v, q, "b", 3, 3 + len(q)) for d, name in enumerate(names) for f, n, v, q in CASES[name][0]], FACTS)
    docs = spark.createDataFrame([(d, "bank") for d in range(len(names))], "document_id int, bank string")
    states = docs.select("document_id", F.lit(["a", "b"]).alias("issues"), F.lit(["x", "a"]).alias("unresolved"))
    pages = spark.createDataFrame([(names.index("rate"), "TRY", "1 TL", "b", 0, 4)], "document_id int, currency string, quote string, block_id string, start int, end int")
    return names, *candidates.build(facts, states, docs, pages), pages


def test_reasons(built):
    names, made, facts, pages = built
    own = made.where("candidate IS NOT NULL")
    found = candidates.replay_values(own, facts, pages.select("document_id", "currency"), F.lit(date(2026, 7, 19)))
    got = {names[r.document_id]: r.reason for r in own.select("document_id", "candidate").join(found, "candidate").collect()} | {names[r.document_id]: r.error for r in made.where("error IS NOT NULL").collect()}
    assert got == {name: reason for name, (_, reason) in CASES.items()}


def test_pointers_and_ids(built):
    names, made, facts, _ = built
    rows = {}
    for r in facts.collect():
        rows.setdefault(names[r.document_id], {})[r.pointer] = r.value
    assert set(rows["whole"]) == {"/data/title", "/data/rates/0", "/data/financing_amounts/0", "/data/terms/0", "/data/customer_segments/0", "/data/comparison_context/customer_segment_keys/0", "/data/comparison_context/product_currency"}
    assert rows["whole"]["/data/comparison_context/product_currency"] == rows["rate"]["/data/comparison_context/product_currency"] == "TRY" and "/data/comparison_context/product_currency" not in rows["two currencies"]
    ids = {names[r.document_id]: (r.candidate, r.issues) for r in made.collect()}
    assert ids["whole"][1] == ["a", "b", "unresolved:a", "unresolved:x"] and len({i for i, _ in ids.values()}) == len(CASES)


@pytest.mark.parametrize("change, reason", [
    ({"value": "'USD'"}, "product_currency_derivation_mismatch"), ({"quote": "'1 TL, 2 USD'"}, "currency_evidence_laundering"), ({"start": "start + 1"}, "candidate_id_mismatch"), ({}, None),
])
def test_tampered_currency_of_a_page(spark, change, reason):
    docs = spark.createDataFrame([(1, "bank")], "document_id int, bank string")
    facts = spark.createDataFrame([(1, *TITLE, "b", 0, 6)], FACTS)
    pages = spark.createDataFrame([(1, "TRY", "1 TL", "b", 0, 4)], "document_id int, currency string, quote string, block_id string, start int, end int")
    made, own = candidates.build(facts, docs.select("document_id", F.array().cast("array<string>").alias("issues"), F.array().cast("array<string>").alias("unresolved")), docs, pages)
    own = own.select(*(F.when(F.col("field") == "product_currency", F.expr(change[c])).otherwise(F.col(c)).alias(c) if c in change else c for c in own.columns))
    assert candidates.replay_values(made, own, pages.select("document_id", "currency")).first().reason == reason
