"""The comparison operator: gate order, signatures, waivers, own and peer reasons, independence of order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.operators import comparison as c

AS_OF = "TIMESTAMP '2026-07-18 12:00:00'"
RATE = "request int, record string, index int, status string, value_percent double, kind string, period string, gross_net_basis string, reference_starts_on date, reference_ends_on date, term_months int, basis_label string, evidence_ids array<string>"
FEE = "request int, record string, index int, status string, kind string, basis string, waived boolean, amount double, currency string, percent double, period string, gross_net_basis string, basis_label string, evidence_ids array<string>"
REWARD = "request int, record string, index int, status string, kind string, basis string, program_name string, amount double, currency string, points double, percent double, period string, minimum_spend double, maximum_money double, maximum_points double, evidence_ids array<string>"


def rate(request, record, value, kind="financing_profit_rate", period="monthly", term=12, status="stated", label=None, evidence=("e",), index=0):
    return (request, record, index, status, value, kind, period, "unspecified", None, None, term, label, list(evidence))


def fee(request, record, amount=None, waived=False, kind="allocation", basis="one_time", currency="TRY", percent=None, evidence=("e",), label="kalan anapara", index=0):
    return (request, record, index, "stated", kind, basis, waived, amount, currency, percent, "monthly", "unspecified", label, list(evidence))


def outcomes(spark, members, rows, schema, build, dimension):
    records = spark.createDataFrame(members, "request int, record string")
    facts = build(spark.createDataFrame(rows, schema))
    return {(r.request, r.record): (r.rank, r.reason_code, r.value) for r in c.compared(records, facts, dimension).collect()}


def test_rates(spark):
    rows = [
        rate(1, "a", 1.5), rate(1, "b", 1.2), rate(1, "c", 1.5), rate(2, "a", 1.0), rate(3, "a", 1.0), rate(3, "b", 1.0, kind="annual_cost_rate"), rate(4, "a", 1.0), rate(4, "b", 1.0, period="annual"),
        rate(5, "a", 1.0), rate(5, "b", 1.0, term=24), rate(6, "a", 1.0), rate(6, "a", 2.0, index=1), rate(6, "b", 1.0), rate(7, "a", 1.0), rate(7, "a", 2.0, term=24, index=1), rate(7, "b", 1.0), rate(7, "b", 1.0, term=24, index=1),
        rate(8, "a", 1.0, term=None), rate(8, "b", 1.0), rate(9, "a", 1.0, evidence=()), rate(9, "b", 1.0), rate(10, "a", 90.0, kind="ltv_ratio", period="unspecified", term=None), rate(10, "b", 70.0, kind="ltv_ratio", period="unspecified", term=None),
        rate(11, "a", 1.0, label="Bileşik"), rate(11, "b", 2.0, label="bilesik"),
    ]
    members = sorted({(r[0], r[1]) for r in rows} | {(2, "b")})
    got = outcomes(spark, members, rows, RATE, c.rate_facts, c.RATE)
    assert [got[1, k][:2] for k in "abc"] == [(2, "ranked_lower_is_better"), (1, "ranked_lower_is_better"), (2, "ranked_lower_is_better")]
    assert got[2, "a"][1] == "peer_rate_missing" and got[2, "b"][1] == "rate_missing"
    assert {got[3, k][1] for k in "ab"} == {"rate_kind_mismatch"} and {got[4, k][1] for k in "ab"} == {"rate_period_mismatch"} and {got[5, k][1] for k in "ab"} == {"rate_basis_mismatch"}
    assert {got[6, k][1] for k in "ab"} == {"multiple_rate_values_for_signature"} and {got[7, k][1] for k in "ab"} == {"multiple_rate_signatures"}
    assert {got[8, k][1] for k in "ab"} == {"rate_term_context_unknown"}
    assert got[9, "a"][1] == "rate_evidence_missing" and got[9, "b"][1] == "peer_rate_evidence_missing"
    assert got[10, "a"] == (1, "ranked_higher_is_better", 90.0) and got[11, "a"][0] == 1


def test_fees(spark):
    rows = [
        fee(1, "a", 500.0), fee(1, "b", waived=True), fee(1, "c", 0.0), fee(2, "a", waived=True), fee(2, "b", waived=True), fee(3, "a", 5.0), fee(3, "b", 5.0, currency="USD"), fee(4, "a", 5.0), fee(4, "b", percent=2.0),
        fee(5, "a", 5.0), fee(5, "b", 5.0, kind="annual"), fee(6, "a", 5.0), fee(6, "b", waived=True, kind="annual"), fee(7, "a"), fee(7, "b", 1.0),
        # A pair that nobody prices is a second signature; a waiver beside a price, or a fee stated twice, is one too many.
        fee(8, "a", 5.0), fee(8, "a", waived=True, kind="annual", index=1), fee(8, "b", 6.0), fee(8, "b", waived=True, kind="annual", index=1), fee(9, "a", 5.0), fee(9, "a", waived=True, index=1), fee(9, "b", 5.0),
        fee(10, "a", 5.0), fee(10, "a", 5.0, index=1), fee(10, "b", 5.0), fee(11, "a", 5.0, basis="one"), fee(11, "b", waived=True, basis="one_time"), fee(12, "a", percent=1.0, label=None), fee(12, "b", percent=1.0),
    ]
    got = outcomes(spark, sorted({(r[0], r[1]) for r in rows}), rows, FEE, c.fee_facts, c.FEE)
    assert [got[1, k][0] for k in "abc"] == [3, 1, 2] and got[1, "b"][2] is None
    assert {got[2, k][0] for k in "ab"} == {1}
    assert got[3, "a"][1] == "fee_currency_mismatch" and got[4, "a"][1] == "fee_value_type_mismatch" and got[5, "a"][1] == "fee_kind_mismatch" and got[6, "b"][1] == "fee_kind_mismatch"
    assert got[7, "a"][1] == got[7, "b"][1] == "fee_not_numeric"
    assert got[8, "a"][1] == got[9, "b"][1] == got[10, "a"][1] == "multiple_fee_signatures" and got[11, "a"][1] == "fee_basis_mismatch" and got[12, "b"][1] == "fee_rate_context_unknown"


def test_terms_and_rewards(spark):
    term = "request int, record string, index int, status string, maximum_months int, evidence_ids array<string>"
    rows = [(1, "a", 0, "stated", 12, ["e"]), (1, "a", 1, "stated", 36, ["e"]), (1, "b", 0, "stated", 24, ["e"]), (2, "a", 0, "ambiguous", 12, ["e"]), (2, "b", 0, "stated", 12, ["e"])]
    got = outcomes(spark, sorted({(r[0], r[1]) for r in rows}), rows, term, c.term_facts, c.TERM)
    assert got[1, "a"] == (1, "ranked_higher_is_better", 36.0) and got[1, "b"][0] == 2 and got[2, "b"][1] == "term_ambiguous"
    reward = lambda q, r, points, program="Bonus", spend=None: (q, r, 0, "stated", "points", "per_campaign", program, None, None, points, None, None, spend, None, None, ["e"])
    rows = [reward(1, "a", 100.0), reward(1, "b", 300.0), reward(2, "a", 1.0), reward(2, "b", 1.0, program="World"), reward(3, "a", 1.0), reward(3, "b", 1.0, spend=50.0), reward(4, "a", 1.0, program=None), reward(4, "b", 1.0)]
    got = outcomes(spark, sorted({(r[0], r[1]) for r in rows}), rows, REWARD, c.reward_facts, c.REWARD)
    percent = lambda q, r, value, period="monthly", basis="per_campaign": (q, r, 0, "stated", "discount", basis, None, None, None, None, value, period, None, None, None, ["e"])
    rows2 = [percent(1, "a", 5.0), percent(1, "b", 7.0), percent(2, "a", 5.0), percent(2, "b", 5.0, period="annual"), percent(3, "a", 5.0, period="unspecified"), percent(3, "b", 5.0), percent(4, "a", 5.0, basis="unspecified"), percent(4, "b", 5.0)]
    got2 = outcomes(spark, sorted({(r[0], r[1]) for r in rows2}), rows2, REWARD, c.reward_facts, c.REWARD)
    assert got2[1, "b"][0] == 1 and got2[2, "a"][1] == "reward_context_mismatch" and got2[3, "b"][1] == "reward_rate_context_unknown" and got2[4, "b"][1] == "reward_basis_unknown"
    assert got[1, "b"][0] == 1 and got[2, "a"][1] == "reward_program_mismatch" and got[3, "a"][1] == "reward_context_mismatch" and got[4, "a"][1] == "reward_program_unknown"


GATE = "request int, record string, status string, family string, observed_at timestamp, currency string, segments array<string>, channel string, new_customer boolean, mechanism string, secured boolean, starts_on date, ends_on date, validity_status string"


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None), ({"status": "rejected", "family": "card"}, "record_not_validated"), ({"family": "other"}, "product_family_unknown"), ({"family": "card"}, "product_family_mismatch"),
        ({"currency": None}, "currency_context_unknown"), ({"currency": "USD"}, "currency_context_mismatch"), ({"segments": []}, "customer_segment_context_unknown"), ({"segments": ["b"]}, "customer_segment_context_mismatch"),
        ({"channel": "branch"}, "sales_channel_context_unknown"), ({"secured": True}, "security_context_unknown"), ({"observed_at": dt.datetime(2026, 7, 19)}, "not_observed_as_of"),
        ({"starts_on": dt.date(2026, 1, 1), "validity_status": "stated"}, "validity_unknown"), ({"segments": ["s2", "s1"]}, None),
    ],
)
def test_gate(spark, change, reason):
    base = {"status": "validated", "family": "financing", "observed_at": dt.datetime(2026, 7, 1), "currency": "TRY", "segments": ["s1", "s2"], "channel": None, "new_customer": None, "mechanism": None, "secured": None, "starts_on": None, "ends_on": None, "validity_status": None}
    rows = [(1, "a", *base.values()), (1, "b", *{**base, **change}.values())]
    assert c.gate(spark.createDataFrame(rows, GATE), F.expr(AS_OF)).first().gate == reason


def test_issues_in_the_request_s_order(spark):
    rows = [rate(1, "a", 1.0, term=None), rate(1, "b", 1.0, kind="unknown")]
    facts = c.rate_facts(spark.createDataFrame(rows, RATE))
    for positions, reason in (((1, 2), "rate_term_context_unknown"), ((2, 1), "rate_kind_unknown")):
        records = spark.createDataFrame([(1, "a", positions[0]), (1, "b", positions[1])], "request int, record string, position int")
        assert {r.reason_code for r in c.compared(records, facts, c.RATE).collect()} == {reason}


def test_order_does_not_matter(spark):
    rows = [rate(q, r, float(v)) for q in range(5) for v, r in enumerate("abc")]
    records = spark.createDataFrame([(r[0], r[1]) for r in rows], "request int, record string")
    digests = []
    for order in (rows, rows[::-1]):
        facts = c.rate_facts(spark.createDataFrame(order, RATE).repartition(5))
        digests.append({r.request: r.digest for r in c.report_digest(c.compared(records, facts, c.RATE)).collect()})
    assert digests[0] == digests[1]
