"""Sentences of reasons, identities of reports, forms of banks' names."""

import hashlib
import json

from pyspark.sql import functions as F

from factloom.operators import comparison, messages, relevance


def test_every_reason_has_a_sentence(spark):
    codes = {c for d in (comparison.RATE, comparison.FEE, comparison.REWARD, comparison.TERM) for c in (*d.levels, d.many, d.many_values, f"{d.name}_missing", f"peer_{d.name}_missing", f"{d.name}_evidence_missing", f"peer_{d.name}_evidence_missing")}
    told = dict(messages.REASONS)
    assert codes <= set(told) and len(told) == len(messages.REASONS) == 70
    df = spark.createDataFrame([("rate_missing",), ("odd",), (None,)], "c string")
    assert [r[0] for r in df.select(messages.explanation(F.col("c"))).collect()] == ["Oran bilgisi eksik.", None, None]


def test_report_identity(spark):
    rows = [(1, 0, "a", "fee", True, 1, 12.5, "TRY", "ranked_lower_is_better", ["y", "x"]), (1, 1, "b", "fee", True, 2, 100.0, "TRY", "ranked_lower_is_better", ["z"]), (1, 0, "a", "term", False, None, None, None, "term_missing", None)]
    names = "request int, position int, record string, dimension string, comparable boolean, rank int, value double, unit string, reason_code string, evidence_ids array<string>"
    identity = lambda rows: messages.report_identity(spark.createDataFrame(rows, names), "v1", F.lit("2026-07-19")).first().canonical_sha256
    item = lambda r, value: {"campaign_id": r[2], "canonical_value": value, "comparable": r[4], "dimension": r[3], "evidence_ids": sorted(r[9] or []), "rank": r[5], "reason_code": r[8], "unit": r[7]}
    whole = {"as_of": "2026-07-19", "items": [item(rows[0], "12.5"), item(rows[2], None), item(rows[1], "100")], "ruleset_version": "v1"}
    assert identity(rows) == identity(rows[::-1]) == hashlib.sha256(json.dumps(whole, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert identity(rows) != identity([*rows[:2], (*rows[2][:8], "fee_missing", None)])


def test_bank_keys(spark):
    df = spark.createDataFrame([("vakif-katilim", "Vakıf Katılım Bankası A.Ş."), ("x", "A.Ş."), ("tom", "T.O.M. Katılım")], "i string, n string")
    made = [r[0] for r in df.select(relevance.bank_keys(F.col("i"), F.col("n"))).collect()]
    assert made == [["vakif katilim", "vakif katilim bankasi a s"], ["x", "a s"], ["tom", "t o m katilim"]]
