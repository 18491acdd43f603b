"""The extraction draft of a document: what rules alone read out of its blocks, each fact with the span that states it.

Blocks are read in order and blocks that try to take over instructions not at all. A scalar that the document
names once is bound; one that it names in several ways stays open, and says so. All steps are joins,
aggregates and windows over a document's blocks and sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html, marks, normalizers, wording
from ..functions.normalizers import holds, let
from ..functions.text import search_text
from ..sources.strict import ensure_checkpoint_dir
from .blocks import table_context
from .candidates import out_of_force, rate_question_open
from .filters import injection

FIELDS = (
    "title", "product_family", "campaign_type", "rate", "financing_amount", "term", "fee", "reward", "validity", "customer_segment", "eligibility_condition", "sales_channel", "new_customer_only",
)
TITLE_MOST = 500
# Fixed values (folded text): what makes a sentence worth a reader, and what table headers name.
PERCENT = r"%|‰|\byuzde\b|\bbinde\b|\bbaz\s+puan\b"
FEE_CONTEXT = r"\b(?:ucret|masraf|tahsis|aidat|komisyon)"
MONEY = r"₺|\btl\b|\btry\b|\bturk\s+lirasi\b|\busd\b|\beur\b|\bdolar\b|\beuro\b"
AMOUNT_CONTEXT, OTHER_AMOUNT = r"\b(?:finansman|kullandirim|tutar)\b", r"\b(?:ucret|masraf|tahsis|aidat|iade|indirim|puan)\b"
TERM = r"\b(?:vade|vadeli|\d+\s*(?:ay|yil|sene)(?:[ae]|[dt][ae]|[dt][ae]n|i|in|li[kg]i?|lar|ler)?)\b"
DATE = r"\b\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?\b|\b(?:ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik)\b|bu\s+ay\s+sonuna"
PROFIT_LABEL, COST_LABEL = r"\b(?:aylik\s+)?kar\s+(?:payi\s+)?orani?\b", r"\b(?:yillik|senelik)\s+(?:toplam\s+)?maliyet\s+oran"
NOT_PROFIT, TERM_LABEL, RATE_LIKE = r"\b(?:yillik|senelik)\b|maliyet", r"\b(?:vade|ay)\b", r"oran|%|maliyet|getiri"
DEPOSIT, FINANCING = r"\b(?:katilma\s+hesabi|katilim\s+hesabi|dagitim|paylasim|gecmis\s+getiri)\b", r"\b(?:finansman|kullandirim)\b"
GENERIC, CAP = r"\b(?:aylik\s+)?kar\s+(?:payi\s+)?orani\b", r"\b(?:azami\s+)?finansman\s+oran"
MECHANISM = r"karz\s*[-‐‑‒]\s*i\s+hasen"
MECHANISM_CONTEXT = (rf"\b(?:finansman|kart|urun|hesap)[^.!?;\n]{{0,80}}\(\s*{MECHANISM}\s*\)", rf"\b(?:finansman|urun)\s+(?:yontemi|modeli|mekanizmasi)\s*(?:olarak|:)?\s*{MECHANISM}\b")

#: Parts of words without one of which a pattern above isn't there.
PERCENT_WORDS, AMOUNT_WORDS, FEE_WORDS = ("%", "‰", "yuzde", "binde", "puan"), ("finansman", "kullandirim", "tutar"), ("ucret", "masraf", "tahsis", "aidat", "komisyon")
ELIGIBLE_WORDS = ("yararlan", "kosul", "sart", "gerekmektedir", "zorunlu", "yalnizca", "sadece", "isyeri")

_HINT = "struct<kind:string,period:string,at:int,width:int,sole:boolean,term_at:int,in_months:boolean>"


def _column_hint(text: Column, label: str, but: str | None, kind: str, period: str, financing: Column) -> Column:
    """What a header row says about one of its columns: the only one with this label, beside a column of terms, in a financing context."""

    def judged(names: Column) -> Column:
        named = lambda x: x.rlike(label) & (~x.rlike(but) if but else F.lit(True))
        places = F.filter(F.transform(names, lambda x, k: F.when(named(x), k)), lambda k: k.isNotNull())

        def at_column(at: Column) -> Column:
            terms = F.filter(F.transform(names, lambda x, k: F.when((k != at) & x.rlike(TERM_LABEL), k)), lambda k: k.isNotNull())
            sole = ~F.exists(F.transform(names, lambda x, k: (k != at) & x.rlike(RATE_LIKE)), lambda b: b)
            term_at = F.when(F.size(terms) == 1, F.get(terms, F.lit(0)))
            made = F.struct(
                F.lit(kind).alias("kind"), F.lit(period).alias("period"), at.alias("at"), F.size(names).alias("width"), sole.alias("sole"), term_at.alias("term_at"),
                F.coalesce(F.get(names, term_at).rlike(r"\bay\b"), F.lit(False)).alias("in_months"),
            )
            return F.when(F.size(terms) > 0, made)

        return F.when((F.size(names) > 1) & (F.size(places) == 1) & financing, let(F.get(places, F.lit(0)), at_column))

    return let(F.transform(marks.cells(search_text(text)), lambda c: c["quote"]), judged)


def _general(kind: str, period: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(kind).alias("kind"), period.cast("string").alias("period"), none.alias("at"), none.alias("width"), F.lit(False).alias("sole"), none.alias("term_at"), F.lit(False).alias("in_months"))


def rate_hints(blocks: DataFrame, document: str = "document_id") -> DataFrame:
    """``blocks`` (document, ordinal, kind, text, families: labels of the document) with ``hint``: what context says about the rates of a block.

    A header row speaks for the rows under it in the same table, a label of a profit rate for its own block; a header row
    that says nothing takes the last one's word away.
    """
    key, row = F.col("_key"), F.col("kind") == "table_row"
    has = lambda name: F.array_contains("families", name)
    only_financing, financing = (F.size("families") == 1) & has("financing"), has("financing") & ~has("participation_account")
    in_context = ~key.rlike(DEPOSIT) & (financing | key.rlike(FINANCING))
    columns = F.coalesce(
        _column_hint(F.col("text"), PROFIT_LABEL, NOT_PROFIT, "financing_profit_rate", "monthly", in_context), _column_hint(F.col("text"), COST_LABEL, None, "annual_cost_rate", "annual", in_context)
    )
    monthly = F.when(F.regexp_extract(key, GENERIC, 0).rlike(r"\baylik\b"), "monthly")
    generic = F.when((only_financing | key.rlike(FINANCING)) & ~key.rlike(DEPOSIT), _general("financing_profit_rate", monthly))
    cap = F.when(key.rlike(CAP) & key.rlike(marks.BRACKET), _general("ltv_ratio", F.lit(None)))
    is_generic = holds(key, "orani") & key.rlike(GENERIC)
    of_row = F.when(columns.isNotNull(), columns).when(is_generic, generic).otherwise(cap)
    heads = columns.isNotNull() | is_generic | cap.isNotNull() | (key.rlike("[a-z]") & ~key.rlike(r"\d"))
    judged = blocks.withColumn("_key", search_text(F.col("text"))).withColumns({"_own": F.when(row, of_row).when(is_generic, generic), "_heads": row & heads}).drop("_key")
    placed = table_context(judged, document, "ordinal", row, F.col("_heads"), F.col("_own"))
    return placed.withColumn("hint", F.coalesce("_own", "context")).drop("_own", "_heads", "context")


def _hinted_cell(sentence: Column, hint: Column) -> Column:
    """struct<quote, start, end, months> of the cell that a column hint speaks of, null where none can be told."""

    def judged(own: Column) -> Column:
        percents = F.filter(own, lambda c: search_text(c["quote"]).rlike(PERCENT))
        full = F.size(own) == hint["width"]
        cell = F.when(full, F.get(own, hint["at"])).when(hint["sole"] & (F.size(percents) == 1), F.get(percents, F.lit(0)))
        term = search_text(F.get(own, hint["term_at"])["quote"])
        months = F.when(full, F.coalesce(F.nullif(F.regexp_extract(term, r"^(\d{1,3})\s*ay\b\.?$", 1), F.lit("")), F.when(hint["in_months"], F.nullif(F.regexp_extract(term, r"^(\d{1,3})$", 1), F.lit("")))))
        return let(cell, lambda c: F.when(c.isNotNull() & search_text(c["quote"]).rlike(PERCENT), F.struct(c["quote"].alias("quote"), c["start"].alias("start"), c["end"].alias("end"), months.cast("int").alias("months"))))

    return let(marks.cells(sentence), judged)


def _fact(field: str, value: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """An entry of a sentence's facts; without a place of its own it has the sentence's."""
    return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), (F.col("start") if start is None else F.col("start") + start).alias("start"), (F.col("end") if end is None else F.col("start") + end).alias("end"))


def _rates(day: Column) -> Column:
    quote, hint, key = F.col("quote"), F.col("hint"), F.col("_key")

    def made(cell: Column) -> Column:
        # A hint on a column counts only where the column's cell is known.
        usable = hint.isNotNull() & (hint["at"].isNull() | cell.isNotNull())
        raw = F.coalesce(cell["quote"], quote)
        plain = normalizers.rate(raw)["value"]
        helped = normalizers.rate(raw, kind_hint=F.when(usable, hint["kind"]), period_hint=F.when(usable, hint["period"]))["value"]
        value = let(plain, lambda v: F.when(usable & (v["kind"] == "unknown"), F.struct(helped.alias("v"), cell["months"].alias("m"))).otherwise(F.struct(v.alias("v"), F.lit(None).cast("int").alias("m"))))
        public = let(value, lambda x: F.when(x["v"].isNotNull() & (x["v"]["kind"] != "unknown"), F.to_json(F.struct(x["v"]["value_percent"].alias("value_percent"), x["v"]["kind"].alias("kind"), x["v"]["period"].alias("period"), x["v"]["gross_net_basis"].alias("gross_net_basis"), x["m"].alias("term_months")))))
        return F.struct(public.alias("value"), cell["start"].alias("start"), cell["end"].alias("end"))

    cell = F.when(hint["at"].isNotNull(), _hinted_cell(quote, hint))
    stated = holds(key, *PERCENT_WORDS) & key.rlike(PERCENT) & ~key.rlike(FEE_CONTEXT) & ~(key.rlike(DATE) & out_of_force(quote, day))
    wide = F.length("quote")
    return F.when(stated, let(let(cell, made), lambda r: F.when(r["value"].isNotNull(), F.array(_fact("rate", r["value"], F.coalesce(r["start"], F.lit(0)), F.coalesce(r["end"], wide))))))


def _amounts() -> Column:
    key = F.col("_key")
    one = lambda found: let(F.get(found, F.lit(0)), lambda s: let(normalizers.money(s["quote"])["value"], lambda v: F.when(v.isNotNull(), F.array(_fact("financing_amount", F.to_json(v), s["start"], s["end"])))))
    stated = holds(key, *AMOUNT_WORDS) & key.rlike(MONEY) & key.rlike(AMOUNT_CONTEXT) & ~key.rlike(OTHER_AMOUNT)
    return F.when(stated, let(marks.spans(F.col("quote"), marks.AMOUNT), lambda found: F.when(F.size(found) == 1, one(found))))


def sentence_facts(sentences: DataFrame, day: Column, document: str = "document_id") -> DataFrame:
    """(document, ordinal, no, k, field, value, block_id, start, end) of the list fields from sentences (document, ordinal, block_id, no, quote, start, end, hint); repeats of a fact at one place are one."""
    quote, key = F.col("quote"), F.col("_key")
    terms = let(normalizers.term(quote)["value"], lambda options: F.transform(options, lambda t: _fact("term", F.to_json(t))))
    fees = let(normalizers.fee(quote), lambda v: F.when(v.isNotNull(), F.array(_fact("fee", F.to_json(v)))))
    rewards = let(wording.reward(quote), lambda v: F.when(v.isNotNull(), F.array(_fact("reward", F.to_json(v)))))
    read = (
        _rates(day), _amounts(), F.when((holds(key, "vade") | (key.rlike("[0-9]") & holds(key, "ay", "yil", "sene"))) & key.rlike(TERM), terms), F.when(holds(key, *FEE_WORDS) & key.rlike(normalizers.FEE_MARK), fees),
        F.when(holds(key, "puan", "iade", "indirim", "hediye", "alisveris"), rewards), F.when(holds(key, *ELIGIBLE_WORDS) & key.rlike(marks.ELIGIBLE), F.array(_fact("eligibility_condition", quote))),
    )
    none = F.array().cast("array<struct<field:string,value:string,start:int,end:int>>")
    own = sentences.withColumn("_key", search_text(quote)).withColumn("_facts", F.array_distinct(F.concat(*(F.coalesce(x, none) for x in read))))
    # An inner explode would infer a filter on the array, which would read each sentence a second time.
    return own.select(document, "ordinal", "block_id", "no", F.posexplode_outer("_facts").alias("k", "f")).where("f IS NOT NULL").select(document, "ordinal", "no", "k", "f.field", "f.value", "block_id", "f.start", "f.end")


def draft(blocks: DataFrame, day: Column | None = None, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(facts, states) of the documents of ``blocks`` (document, block_id, ordinal, kind, text).

    Facts: document, field, nth (inside the field), value (text; typed values as JSON), block_id, start, end. States: document, issues in
    order, unresolved (sorted). ``day`` dates what has no year and tells which rates are in force. Null texts are
    empty; documents without blocks have no state. Blocks and sentences are written once in the checkpoint folder.
    """
    ensure_checkpoint_dir(blocks.sparkSession)
    day = F.lit(None).cast("date") if day is None else day
    text = F.coalesce("text", F.lit(""))
    own = blocks.select(document, "block_id", "ordinal", "kind", text.alias("text"))
    heading = F.col("kind") == "heading"
    own = own.withColumns({"_bad": injection(F.col("text")), "_key": search_text(F.col("text"))})
    key, fair = F.col("_key"), ~F.col("_bad")
    read = own.withColumns({
        "_families": F.when(fair, marks.places(key, marks.FAMILIES)), "_types": F.when(fair, marks.campaign_places(key, heading)), "_segments": F.when(fair, marks.segment_places(key)),
        "_new": F.when(fair, marks.restricted(key)), "_mechanism": fair & key.contains("hasen"),
    }).drop("_key").checkpoint()
    safe = read.where("NOT _bad")
    spot = lambda m: F.struct("ordinal", "block_id", m["start"].alias("start"), m["end"].alias("end"))
    ids = read.select(document).distinct()

    def labels(column: str) -> DataFrame:
        """(document, label, spot): the first place of each label."""
        hits = safe.select(document, "ordinal", "block_id", F.posexplode(column).alias("_k", "m"))
        return hits.groupBy(document, F.col("m.label").alias("label")).agg(F.min(F.struct("ordinal", "_k", "block_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"))).alias("spot"))

    def only(found: DataFrame, name: str) -> DataFrame:
        """(document, name_n, name): the number of labels and, if there is one only, the label with its place."""
        made = found.groupBy(document).agg(F.count("*").alias(f"{name}_n"), F.min(F.struct("spot", "label")).alias("_one"))
        return made.select(document, f"{name}_n", F.when(F.col(f"{name}_n") == 1, F.struct(F.col("_one.label").alias("value"), *(F.col(f"_one.spot.{c}").alias(c) for c in ("block_id", "start", "end")))).alias(name))

    families = labels("_families")
    titles = safe.where(heading & (F.length("text") <= TITLE_MOST)).groupBy(document).agg(F.min_by(F.struct(F.col("text").alias("value"), "block_id", F.lit(0).alias("start"), F.length("text").alias("end"), F.col("_types").alias("types")), "ordinal").alias("title"))
    restricted = safe.where("_new IS NOT NULL").groupBy(document).agg(F.min(spot(F.col("_new"))).alias("_new"))

    named = families.groupBy(document).agg(F.collect_set("label").alias("families"))
    none = F.array().cast("array<string>")
    hinted = rate_hints(safe.select(document, "block_id", "ordinal", "kind", "text").join(named, document, "left").withColumn("families", F.coalesce("families", none)), document)
    cut = html.sentences(hinted.select(F.struct(document, "ordinal", "block_id", "hint").alias("_id"), "text"), "_id", "text").select("_id.*", "no", "quote", "start", "end")
    dated = (key.rlike("[0-9]") | holds(key, *normalizers.MONTHS, "sonuna")) & key.rlike(DATE)
    cut = cut.withColumn("_key", search_text(F.col("quote"))).withColumns({"_channel": marks.channels(key), "_all": marks.universally(key), "_window": F.when(dated, normalizers.validity(F.col("quote"), day)["value"])}).drop("_key").checkpoint()
    listed = sentence_facts(cut, day, document).checkpoint()
    place = lambda m: F.struct("ordinal", "no", "block_id", (F.col("start") + m["start"]).alias("start"), (F.col("start") + m["end"]).alias("end"))

    loudest = cut.where("_channel IS NOT NULL").withColumn("_most", F.max("_channel.priority").over(Window.partitionBy(document))).where("_channel.priority = _most")
    channels = loudest.select(document, "ordinal", "no", "block_id", "start", F.explode("_channel.places").alias("m")).groupBy(document, F.col("m.label").alias("label")).agg(F.min(place(F.col("m"))).alias("spot"))
    everyone = cut.where("_all IS NOT NULL").groupBy(document).agg(F.min(place(F.col("_all"))).alias("_all"))
    windows = cut.where("_window IS NOT NULL").groupBy(document).agg(F.min_by(F.struct(F.to_json("_window").alias("value"), "block_id", "start", "end"), F.struct("ordinal", "no")).alias("validity"))
    mechanism = F.coalesce(*(F.when(key_at > 0, key_at) for key_at in (F.regexp_instr(search_text(F.col("text")), F.lit(p)) for p in MECHANISM_CONTEXT)))
    inner = lambda at: let(F.regexp_instr(search_text(F.substr("text", at, F.lit(1 << 30))), F.lit(MECHANISM)), lambda k: at - 1 + k - 1)
    length = lambda start: F.length(F.regexp_extract(search_text(F.substr("text", start + 1, F.lit(1 << 30))), MECHANISM, 0))
    mechanisms = safe.where("_mechanism").withColumn("_at", mechanism).where("_at IS NOT NULL").withColumn("start", inner(F.col("_at"))).withColumn("end", F.col("start") + length(F.col("start")))
    mechanisms = mechanisms.groupBy(document).agg(F.min(F.struct("ordinal", F.lit("karz_i_hasen").alias("value"), "block_id", "start", "end")).alias("product_mechanism"))

    state = ids.join(titles, document, "left").join(only(families, "product_family"), document, "left").join(only(labels("_types"), "campaign_type"), document, "left").join(only(channels, "sales_channel"), document, "left")
    state = state.join(restricted, document, "left").join(everyone, document, "left").join(windows, document, "left").join(mechanisms, document, "left")
    # Several types in a body: one in the title is the offer.
    in_title = F.col("title.types")
    by_title = (F.col("campaign_type_n") > 1) & F.coalesce(F.size(in_title) == 1, F.lit(False))
    mark = F.get(in_title, F.lit(0))
    titled = F.struct(mark["label"].alias("value"), F.col("title.block_id").alias("block_id"), mark["start"].alias("start"), mark["end"].alias("end"))
    whom = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(v).alias("value"), *(F.col(f"{c}.{x}").alias(x) for x in ("block_id", "start", "end")))) for c, v in (("_new", "true"), ("_all", "false"))))
    state = state.withColumns({"_titled": by_title, "new_customer_only": whom, "campaign_type": F.when(by_title, titled).otherwise(F.col("campaign_type"))}).checkpoint()

    scalars = ("title", "product_family", "campaign_type", "validity", "sales_channel", "new_customer_only", "product_mechanism")
    entry = lambda f: F.struct(F.lit(f).alias("field"), *(F.col(f"{f}.{c}").alias(c) for c in ("value", "block_id", "start", "end")))
    single = state.select(document, F.explode(F.array(*(F.when(F.col(f).isNotNull(), entry(f)) for f in scalars))).alias("f")).where("f IS NOT NULL").select(document, "f.field", F.lit(1).alias("nth"), "f.value", "f.block_id", "f.start", "f.end")
    order = Window.partitionBy(document, "field").orderBy("ordinal", "no", "k")
    numbered = listed.select(document, "field", F.row_number().over(order).alias("nth"), "value", "block_id", "start", "end")
    segments = labels("_segments")
    ranked = segments.select(document, F.lit("customer_segment").alias("field"), F.row_number().over(Window.partitionBy(document).orderBy("spot")).alias("nth"), F.col("label").alias("value"), "spot.block_id", "spot.start", "spot.end")
    facts = single.unionByName(numbered).unionByName(ranked)

    rates = listed.where("field = 'rate'").groupBy(document).agg(F.collect_list("value").alias("_rates"))
    parsed = F.transform(F.coalesce("_rates", none), lambda v: F.struct(F.get_json_object(v, "$.kind").alias("kind"), F.get_json_object(v, "$.period").alias("period")))
    has_lists = listed.select(document, "field").unionByName(ranked.select(document, "field")).groupBy(document).agg(F.collect_set("field").alias("_listed"))
    quarantined = read.where("_bad").groupBy(document).agg(F.array_sort(F.collect_list(F.struct("ordinal", "block_id"))).alias("_held"))
    whole = state.join(rates, document, "left").join(has_lists, document, "left").join(quarantined, document, "left")
    some = lambda c, name: F.when(c, name)
    issues = F.concat(
        F.coalesce(F.transform("_held", lambda b: F.concat(F.lit("quarantined_prompt_injection_block:"), b["block_id"].cast("string"))), none),
        F.array_compact(F.array(
            some(F.col("product_family_n") > 1, "product_family_ambiguous"), F.when(F.col("_titled"), "title_hint:campaign_type").when(F.col("campaign_type_n") > 1, "campaign_type_ambiguous"), some(F.col("sales_channel_n") > 1, "sales_channel_ambiguous"),
        )),
    )
    missing = {f: F.col(f).isNull() for f in scalars if f != "product_mechanism"} | {f: ~F.array_contains(F.coalesce("_listed", none), f) for f in FIELDS if f not in scalars} | {"rate": rate_question_open(parsed)}
    unresolved = F.array_sort(F.array_compact(F.array(*(F.when(missing[f], f) for f in FIELDS))))
    return facts, whole.select(document, issues.alias("issues"), unresolved.alias("unresolved"))
