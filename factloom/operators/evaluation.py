"""Evaluation gates over gold rows and predictions, integrity of gold rows, scores of records read by a model, messages of comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import class_report, field_report
from .ranking import first_reason


def _status(too_few: Column, passed: Column) -> Column:
    return F.when(too_few, "insufficient_data").when(passed, "pass").otherwise("fail")


def case_gate(cases: DataFrame, kinds: Sequence[str], least: int) -> DataFrame:
    """One row: status, cases, passed, accuracy of reviewed cases (kind, passed); each of ``kinds`` needs ``least`` cases, one failed case fails."""
    per = [F.count_if(F.col("kind") == k) for k in kinds]
    seen = cases.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.least(*per, F.count("*")).alias("_least"))
    accuracy = F.when(F.col("cases") == 0, 0.0).otherwise(F.col("passed") / F.col("cases"))
    return seen.select(_status(F.col("_least") < least, F.col("passed") == F.col("cases")).alias("status"), "cases", "passed", accuracy.alias("accuracy"))


def evidence_gate(gold: DataFrame, predicted: DataFrame, evidence: DataFrame, least: int, example: str = "example_id", field: str = "field", value: str = "value") -> DataFrame:
    """One row: status, examples, completed, asserted, unevidenced, unsupported, invalid.

    ``gold``: example, field of the reviewed examples, a row with a null field for one without any. ``predicted``: example, field, value and
    ``schema_valid`` of the example. ``evidence``: example, field, reason (null where it holds). A stated field needs one binding that holds, and a place in the gold row.
    """
    reviewed, known = gold.select(example).distinct(), gold.where(F.col(field).isNotNull()).select(example, field).distinct().withColumn("_gold", F.lit(True))
    done = predicted.groupBy(example).agg(F.bool_and(F.coalesce("schema_valid", F.lit(False))).alias("_ok")).join(reviewed, example)
    held = evidence.groupBy(example, field).agg(F.bool_or(F.col("reason").isNull()).alias("_held"))
    stated = predicted.where(F.col(value).isNotNull()).join(reviewed, example).join(held, [example, field], "left").join(known, [example, field], "left")
    fields = stated.agg(F.count("*").alias("asserted"), F.count_if(~F.coalesce("_held", F.lit(False))).alias("unevidenced"), F.count_if(F.col("_gold").isNull()).alias("unsupported")).withColumn("_k", F.lit(1))
    rows = done.agg(F.count("*").alias("completed"), F.count_if(~F.col("_ok")).alias("invalid")).withColumn("_k", F.lit(1))
    total = reviewed.agg(F.count("*").alias("examples")).withColumn("_k", F.lit(1)).join(rows, "_k").join(fields, "_k")
    few = (F.col("examples") < least) | (F.col("completed") < F.col("examples"))
    clean = (F.col("unevidenced") == 0) & (F.col("unsupported") == 0) & (F.col("invalid") == 0)
    return total.select(_status(few, clean).alias("status"), "examples", "completed", "asserted", "unevidenced", "unsupported", "invalid")


def extraction_gate(gold: DataFrame, predicted: DataFrame, fields: Sequence[str], least: int, support: int, threshold: float, example: str = "example_id", field: str = "field", value: str = "value") -> DataFrame:
    """One row: status, examples, macro_precision, macro_recall, macro_f1 over ``fields``, low_support (those with less than ``support`` gold values), unsupported.

    ``gold`` and ``predicted``: example, field, value. Fields that no side states count as zero. Predictions of examples without gold don't count.
    """
    reviewed = gold.select(example).distinct()
    own = predicted.join(reviewed, example, "left_semi")
    wanted = gold.sparkSession.createDataFrame([(f,) for f in fields], f"{field} string")
    report = wanted.join(field_report(gold, own, [example], field, value), field, "left").fillna(0)
    low = F.array_sort(F.collect_list(F.when(F.col("support") < support, F.col(field))))
    macro = report.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), low.alias("low_support")).withColumn("_k", F.lit(1))
    extra = own.where(F.col(value).isNotNull()).join(gold.select(example, field).distinct(), [example, field], "left_anti").agg(F.count("*").alias("unsupported")).withColumn("_k", F.lit(1))
    total = reviewed.agg(F.count("*").alias("examples")).withColumn("_k", F.lit(1)).join(macro, "_k").join(extra, "_k")
    good = (F.least("macro_precision", "macro_recall", "macro_f1") >= threshold) & (F.col("unsupported") == 0)
    return total.select(_status((F.col("examples") < least) | (F.size("low_support") > 0), good).alias("status"), "examples", "macro_precision", "macro_recall", "macro_f1", "low_support", "unsupported")


def classification_gate(pairs: DataFrame, examples: int, least: int, classes: int, support: int, threshold: float) -> DataFrame:
    """One row: status, macro_f1, problems of the pointers of ``pairs`` (pointer, gold, predicted): each needs ``classes`` labels that gold has, with ``support`` each.

    The macro F1 is that of the pointers; a pointer's is that over the labels that either side has. Pointers are few.
    """
    values = None
    for pointer in sorted(r.pointer for r in pairs.select("pointer").distinct().collect()):
        report = class_report(pairs.where(F.col("pointer") == pointer), "gold", "predicted")
        known = F.col("support") > 0
        one = report.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.count_if(known).alias("_n"), F.min(F.when(known, F.col("support"))).alias("_least")).withColumn("pointer", F.lit(pointer))
        values = one if values is None else values.unionByName(one)
    if values is None:
        return pairs.sparkSession.createDataFrame([("insufficient_data", 0.0, [])], "status string, macro_f1 double, problems array<string>")
    named = lambda c, text: F.when(c, F.concat(F.lit(text), F.col("pointer")))
    told = values.select("f1", "pointer", F.array_compact(F.array(named(F.col("_n") < classes, "too_few_classes:"), named(F.col("_least") < support, "low_class_support:"))).alias("_problems"))
    whole = told.agg(F.avg("f1").alias("macro_f1"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pointer", "_problems"))), lambda x: x["_problems"])).alias("problems"))
    return whole.select(_status((F.lit(examples) < least) | (F.size("problems") > 0), F.col("macro_f1") >= threshold).alias("status"), "macro_f1", "problems")


def gold_problems(rows: DataFrame, evidence: DataFrame, example: str = "example_id") -> DataFrame:
    """(example, problem): the first thing wrong with a gold row, else null; one row per input row.

    ``rows``: example, excerpt, excerpt_sha256, fields (map of pointer to value), status, reviewers (array), reviewed_at. ``evidence``: example,
    pointer, quote, start, end, digest. Repeated ids, excerpts and hashes come first, then bindings, then stated fields
    without evidence, then the review: a verified row needs two reviewers and a time.
    """
    again = rows.groupBy(example).agg(F.count("*").alias("_n"))
    pointers = rows.dropDuplicates([example]).select(example, F.map_keys("fields").alias("_known"))
    span = F.col("quote").isNull() | (F.col("quote") == "") | F.col("start").isNull() | F.col("end").isNull() | (F.col("end") - F.col("start") != F.length("quote"))
    wrong = F.when(F.col("pointer").isNull() | ~F.coalesce(F.array_contains("_known", F.col("pointer")), F.lit(False)), 0).when(span, 1).when(~F.sha2("quote", 256).eqNullSafe(F.col("digest")), 2)
    bound = evidence.join(pointers, example).groupBy(example).agg(F.min(wrong).alias("_bad"), F.collect_set("pointer").alias("_evidenced"))
    none = F.array().cast("array<string>")
    bare = F.exists(F.map_entries("fields"), lambda e: e["value"].isNotNull() & ~F.array_contains(F.coalesce("_evidenced", none), e["key"]))
    codes = F.element_at(F.lit(["evidence_outside_fields", "invalid_evidence_span", "evidence_hash_mismatch"]), F.col("_bad") + 1)
    problem = first_reason(
        (F.col(example).isNull(), "example_id_missing"), (F.col("_n") > 1, "duplicate_example_id"), (F.coalesce("excerpt", F.lit("")) == "", "excerpt_missing"), (~F.sha2("excerpt", 256).eqNullSafe(F.col("excerpt_sha256")), "excerpt_hash_mismatch"),
        (F.col("fields").isNull(), "fields_missing"), (F.col("_bad").isNotNull(), codes), (bare, "field_without_evidence"), (~F.coalesce(F.col("status").isin("pending", "verified", "rejected"), F.lit(False)) | F.col("reviewers").isNull(), "invalid_review_state"),
        ((F.col("status") == "verified") & ((F.size(F.array_distinct("reviewers")) < 2) | F.col("reviewed_at").isNull()), "verified_without_two_reviewers"),
    )
    return rows.join(again, example, "left").join(bound, example, "left").select(example, problem.alias("problem"))


#: Numbers that differ by less are the same.
TOLERANCE = 1e-9


def field_verdicts(expected: DataFrame, read: DataFrame, sources: DataFrame, key: str = "bank") -> DataFrame:
    """(key, field, verdict, grounded, inverted) of what a model read of a source.

    ``expected``: key, field, value (text). ``read``: key, field, value, quote; ``sources``: key, text. Values are alike as numbers within TOLERANCE, else as
    trimmed text; null is alike only with null. grounded: whether the quote stands in the source, null without one.
    inverted: a fee read as charged for waived, or the other way round.
    """
    both = expected.select(key, "field", F.col("value").alias("_want")).join(read.select(key, "field", F.col("value").alias("_got"), "quote"), [key, "field"], "left").join(sources, key, "left")
    want, got = F.col("_want"), F.col("_got")
    as_number = lambda c: c.try_cast("double")
    numbers = as_number(want).isNotNull() & as_number(got).isNotNull()
    alike = F.when(want.isNull() | got.isNull(), want.isNull() & got.isNull()).when(numbers, F.abs(as_number(want) - as_number(got)) < TOLERANCE).otherwise(F.trim(want) == F.trim(got))
    verdict = F.when(alike, "correct").when(got.isNull(), "missing").otherwise("wrong")
    inverted = F.coalesce((F.col("field") == "fee_status") & F.array_sort(F.array(want, got)).eqNullSafe(F.lit(["charged", "waived"])), F.lit(False))
    return both.select(key, "field", verdict.alias("verdict"), F.when(F.col("quote").isNotNull(), F.contains("text", "quote")).alias("grounded"), inverted.alias("inverted"))


def field_totals(verdicts: DataFrame, key: str = "bank") -> DataFrame:
    """(key, correct, wrong, missing, quotes, grounded, inversions)."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verdicts.groupBy(key).agg(n("correct"), n("wrong"), n("missing"), F.count("grounded").alias("quotes"), F.count_if("grounded").alias("grounded"), F.count_if("inverted").alias("inversions"))


# What is said beside a comparison where no record states an axis.
NOTES = (
    ("channel", "Satış kanalı ekseni 'kısıt kanıtı yok' olarak uyumlu sayıldı: hiçbir kayıtta kanal kanıtı bulunmuyor."),
    ("new_customer", "Yeni müşteri ekseni 'kısıt kanıtı yok' olarak uyumlu sayıldı: hiçbir kayıtta yeni müşteri kısıtına dair kanıt bulunmuyor."),
    ("mechanism", "Ürün mekanizması ekseni 'kısıt kanıtı yok' olarak uyumlu sayıldı: hiçbir kayıtta mekanizma kanıtı bulunmuyor."),
    ("secured", "Teminat ekseni 'kısıt kanıtı yok' olarak uyumlu sayıldı: hiçbir kayıtta teminat kanıtı bulunmuyor."),
    ("validity", "Geçerlilik ekseni 'süre kanıtı yok' olarak uyumlu sayıldı: hiçbir kayıt bir kampanya süresi beyan etmiyor (duran ürün sayfaları)."),
)


def context_notes(records: DataFrame, gates: DataFrame) -> DataFrame:
    """(request, notes): the axes of a request that passes the gate which none of its records states, in order; security counts for financing only.

    ``records`` as for the comparison's gate: request, family, channel, new_customer, mechanism, secured, starts_on, ends_on.
    """
    dated = F.col("starts_on").isNotNull() | F.col("ends_on").isNotNull()
    bare = {"channel": F.count("channel") == 0, "new_customer": F.count("new_customer") == 0, "mechanism": F.count("mechanism") == 0, "secured": (F.count("secured") == 0) & (F.min("family") == "financing"), "validity": F.count_if(dated) == 0}
    seen = records.groupBy("request").agg(F.array_compact(F.array(*(F.when(bare[axis], F.lit(axis)) for axis, _ in NOTES))).alias("_axes"))
    text = F.create_map(*(F.lit(x) for pair in NOTES for x in pair))
    return seen.join(gates, "request").where("gate IS NULL").select("request", F.transform("_axes", lambda a: F.element_at(text, a)).alias("notes"))
