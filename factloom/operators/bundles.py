"""Answers to whole questions: sentences of several records under one length, numbered citations, warnings, or an abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of an answer, those kept free for notes, and citations of one answer.
CHARS, SPARE, CITATIONS = 5_000, 600, 20
# What an answer says beside its facts.
ABSTAINED = "Bu soruyu yanıtlamak için yeterli doğrulanmış kaynak kanıtı bulunamadı."
UNSCOPED = "Soru bir bankaya veya ürün ailesine bağlanamadığı için cevaplanmadı."
ABSENT = (("rate", "kâr payı oranı"), ("term", "vade"), ("fee", "ücret"), ("reward", "ödül/fayda"))
ABSENCE = ("İncelenen doğrulanmış kayıtlarda ", " bilgisi kaynak kanıtıyla yer almıyor.")
UNRANKED = "Değerler aynı bazda doğrulanamadığı için sıralama yapılmadı; banka değerleri yan yana sunuldu."
NO_DIMENSION = "Açık bir karşılaştırma boyutu belirtilmediği için sıralama yapılmadı; doğrulanmış değerler yan yana sunuldu."
ONE_RECORD = "Yalnızca bir bankanın doğrulanmış kaydı bulunduğu için karşılaştırma yapılamadı; mevcut doğrulanmış değerler sunuldu."
CLOSED, NEEDS_SCOPE = ("unknown", "glossary", "coverage"), ("detail", "list")


def record_sentence(bank: Column, title: Column, facts: Column) -> Column:
    """One record's facts (an array with ``clause``): the first leads, each other one is added."""
    lead = F.concat(bank, F.lit(" "), title, F.lit(" ürününde "), F.get(facts, F.lit(0))["clause"], F.lit("."))
    more = F.transform(F.slice(facts, 2, F.greatest(F.size(facts) - 1, F.lit(0))), lambda f: F.concat(F.lit("Ayrıca "), f["clause"], F.lit(".")))
    return F.trim(F.concat(lead, F.lit(" "), F.array_join(more, " ")))


def bundles(
    requests: DataFrame, records: DataFrame, verdicts: DataFrame, notes: DataFrame, chars: int = CHARS, spare: int = SPARE, citations: int = CITATIONS
) -> DataFrame:
    """One row per request: answer, insufficient, citations (array of n, id, quote), warnings, compose_allowed.

    ``requests``: request, intent, dimensions (array), scoped (whether a bank, a family or a type is named). ``records``, the selected
    ones in order: request, position, bank_name, title, present (dimensions in the data), facts (array of clause and
    evidence: array of id and quote). ``verdicts`` and ``notes``: request, dimension, text. A record whose sentence goes beyond the length is left out and the next one tried; citations are numbered
    over the records said, each once. What the question asks for and no record states is said to be absent. Questions outside the kept
    facts, without a scope, or without a fact that can be cited, are abstained from. A request's records are a bounded selection.
    """
    citable = records.where(F.size("facts") > 0).select("request", "position", "present", "facts", record_sentence(F.col("bank_name"), F.col("title"), F.col("facts")).alias("sentence"))
    room = chars - spare
    step = lambda acc, r: F.when(
        acc["used"] + F.length(r["sentence"]) + 1 > room, acc
    ).otherwise(F.struct((acc["used"] + F.length(r["sentence"]) + 1).alias("used"), F.concat(acc["said"], F.array(r)).alias("said")))
    said_type = "array<struct<position:bigint,sentence:string>>"
    listed = citable.groupBy("request").agg(
        F.count("*").alias("_n"), F.array_distinct(F.flatten(F.collect_list("present"))).alias("_present"),
        F.array_sort(F.collect_list(F.struct(F.col("position").cast("bigint").alias("position"), "sentence"))).alias("_all"),
    )
    listed = listed.withColumn("_said", F.aggregate("_all", F.struct(F.lit(0).alias("used"), F.array().cast(said_type).alias("said")), step, lambda acc: acc["said"])).drop("_all")
    told = listed.select("request", F.explode("_said.position").alias("position"))
    cited = citable.join(told, ["request", "position"]).select("request", "position", F.posexplode("facts").alias("_f", "fact")).select("request", "position", "_f", F.posexplode("fact.evidence").alias("_e", "e"))
    unique = cited.groupBy("request", F.col("e.id").alias("id")).agg(F.min(F.struct("position", "_f", "_e", F.col("e.quote").alias("quote"))).alias("at"))
    numbered = unique.withColumn("n", F.row_number().over(Window.partitionBy("request").orderBy("at.position", "at._f", "at._e"))).where(F.col("n") <= citations)
    gathered = numbered.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("n", "id", F.col("at.quote").alias("quote")))).alias("_citations"))
    by_dimension = lambda rows, name: rows.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "text"))), lambda x: x["text"]).alias(name))
    own = (
        requests.join(listed, "request", "left").join(gathered, "request", "left").join(by_dimension(verdicts, "_verdicts"), "request", "left").join(by_dimension(notes, "_notes"), "request", "left")
    )
    none = F.array().cast("array<string>")
    asked = F.filter(F.lit([d for d, _ in ABSENT]), lambda d: F.array_contains("dimensions", d))
    asked = F.filter("dimensions", lambda d: F.array_contains(asked, d))
    stated = (F.size(asked) == 0) | F.coalesce(F.arrays_overlap("_present", asked), F.lit(False))
    names = F.array_join(F.transform(asked, lambda d: F.element_at(F.create_map(*(F.lit(x) for pair in ABSENT for x in pair)), d)), ", ")
    absence = F.when(stated, none).otherwise(F.array(F.concat(F.lit(ABSENCE[0]), names, F.lit(ABSENCE[1]))))
    compares = F.col("intent") == "compare"
    ranks = compares & (F.col("_n") >= 2) & (F.size("dimensions") > 0)
    winners, remarks = F.when(ranks, F.coalesce("_verdicts", none)).otherwise(none), F.when(ranks, F.coalesce("_notes", none)).otherwise(none)
    warning = F.when(compares & (F.col("_n") < 2), ONE_RECORD).when(compares & (F.size("dimensions") == 0), NO_DIMENSION).when(ranks & (F.size(winners) == 0), UNRANKED)
    closed, unscoped = F.col("intent").isin(*CLOSED), F.col("intent").isin(*NEEDS_SCOPE) & ~F.col("scoped")
    fails = closed | unscoped | F.coalesce(F.size("_said") <= 0, F.lit(True))
    parts = F.concat(absence, winners, F.transform("_said", lambda r: r["sentence"]), F.transform(remarks, lambda x: F.concat(F.lit("Not: "), x, F.lit("."))))
    text = F.trim(F.substring(F.array_join(parts, " "), 1, chars))
    empty = F.array().cast("array<struct<n:int,id:string,quote:string>>")
    return own.select(
        "request", F.when(fails, ABSTAINED).otherwise(text).alias("answer"), fails.alias("insufficient"), F.when(fails, empty).otherwise(F.coalesce("_citations", empty)).alias("citations"),
        F.when(closed, none).when(unscoped, F.array(F.lit(UNSCOPED))).when(fails, none).otherwise(F.array_compact(F.array(warning))).alias("warnings"), (~fails & stated & ~compares).alias("compose_allowed"),
    )
