"""What a sentence says about rewards, sales channels and customers: columns over the folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalizers import let, money, rate
from .text import search_text

# Fixed values (folded text).
POINTS = r"\b(\d+(?:[.,]\d+)?)\s*puan\b"
MONEY_REWARDS = r"\b(?:parafpara|worldpuan)\b|\b(?:nakit\s+iade|para\s+iadesi)\b"
VOUCHER, RAFFLE = r"\b(?:hediye\s+(?:ceki|karti)|alisveris\s+ceki)\w*", r"\b(?:cekilis|kura)\w*"
CHANNELS = (
    (r"\bmobil\s+(?:ve|/)\s+internet\b", "digital"), (r"\bdijital\s+kanal(?:lar)?\b", "digital"), (r"\bmobil\s+(?:sube(?:den)?|uygulama(?:dan)?)\b", "mobile"),
    (r"\binternet\s+(?:subesi|bankaciligi|uzerinden)|\bweb\s+sitesi\b", "web"), (r"(?<!mobil )(?<!internet )\bsube(?:ye|de|den|ler(?:e|de|den)?)?\b", "branch"),
)
CHANNEL_YES = r"\b(?:basvur\w*|uzerinden|kanal\w*|gecerli|yapilabilir|tamamlan\w*|sunul\w*|kullanilabilir|talep\w*)\b"
CHANNEL_NO = r"\b(?:yararlanamaz|faydalanamaz|gecerli\s+degildir|basvur(?:u\s+)?yapilamaz|basvuramaz|kullanilamaz|haric)\b"
ONLY = r"\b(?:yalnizca|sadece)\b"
CUSTOMER = r"musteri(?:lerimiz(?:e|in|den|de)?|ler(?:e|in|den|de)?|miz(?:e|in|den|de)?|ye)?"
EVERYONE = rf"\b(?:tum|butun)\s+musteriler(?:imiz)?(?:e|in|den|de)?\b|\bmevcut\s+ve\s+yeni\s+{CUSTOMER}\b|\byeni\s+ve\s+mevcut\s+musteriler(?:imiz)?(?:e|in|den|de)?\b"
NEW_ONLY = rf"\b(?:yalnizca|sadece)\s+yeni\s+{CUSTOMER}\b|\byeni\s+{CUSTOMER}\s+(?:icin\s+(?:gecerli|ozel)|ozel|(?:kampanyadan\s+)?(?:yararlanabilir|faydalanabilir))\b"
SEGMENT_YES = r"\b(?:yararlanabilir|yararlanmak|gecerli|dahildir|kapsar|ozel|sunulur|yalnizca|sadece|saglan\w*|yonelik)\b"
SEGMENT_NO = r"\b(?:dahil\s+degildir|yararlanamaz|gecerli\s+degildir|kapsam\s+disidir)\b"
SEGMENTS = ((r"\bemekli\w*", "retired"), (r"\bogrenci\w*", "student"), (r"\besnaf\w*", "tradesman"), (r"\bkobi\w*", "sme"), (r"\bciftci\w*", "farmer"))


def reward(raw: Column) -> Column:
    """struct<kind, basis, points, money, rate>, null where the sentence states no single reward.

    In order: one points value; branded or refunded money; a voucher that isn't raffled; a discount as a rate, else as money.
    """

    return let(raw, _reward)


def _reward(raw: Column) -> Column:
    def parts(text: Column) -> Column:
        found = F.when(text.contains("puan"), F.regexp_extract_all(text, F.lit(POINTS), 1))
        as_money = text.rlike(MONEY_REWARDS) | (text.rlike(VOUCHER) & ~text.rlike(RAFFLE))
        points = let(found, lambda f: F.when(F.size(f) == 1, F.translate(F.get(f, F.lit(0)), ",", ".").try_cast("decimal(20,4)")))
        return let(points, lambda n: F.struct(n.alias("points"), F.when(n.isNull(), as_money).alias("as_money"), F.when(n.isNull(), text.contains("indirim")).alias("discount")))

    def valued(p: Column) -> Column:
        """Money and percentages are read only where the words before them leave the reward open."""
        amount, percent = money(raw)["value"], rate(raw, kind_hint=F.lit("discount_rate"))["value"]

        def after(refund: Column) -> Column:
            percent_of = F.when(p["discount"] & refund.isNull(), percent)
            return let(percent_of, lambda r: F.struct(p["points"].alias("points"), p["as_money"].alias("as_money"), p["discount"].alias("discount"), F.when(refund.isNotNull(), refund).when(p["discount"] & ~p["as_money"] & r.isNull(), amount).alias("money"), r.alias("rate")))

        return let(F.when(p["as_money"], amount), after)

    def judged(p: Column) -> Column:
        case = (
            F.when(p["points"].isNotNull(), "points").when(p["as_money"] & p["money"].isNotNull(), "money")
            .when(p["discount"] & (p["rate"].isNotNull() | p["money"].isNotNull()), "discount")
        )
        return let(
            case,
            lambda kind: F.when(
                kind.isNotNull(),
                F.struct(
                    kind.alias("kind"), F.when(kind == "discount", "per_transaction").otherwise("campaign_total").alias("basis"), F.when(kind == "points", p["points"]).alias("points"),
                    F.when((kind == "money") | ((kind == "discount") & p["rate"].isNull()), p["money"]).alias("money"), F.when(kind == "discount", p["rate"]).alias("rate"),
                ),
            ),
        )

    return let(let(let(search_text(raw), parts), valued), judged)


def channel(raw: Column) -> Column:
    """struct<channel, priority>: 2 for an exclusive statement, 1 for a positive one, null without one or against one."""

    def said(text: Column) -> Column:
        name = None
        for pattern, label in CHANNELS:
            name = F.when(text.rlike(pattern), label) if name is None else name.when(text.rlike(pattern), label)
        priority = F.when(text.rlike(CHANNEL_NO), None).when(text.rlike(ONLY), 2).when(text.rlike(CHANNEL_YES), 1)
        return F.when(name.isNotNull() & priority.isNotNull(), F.struct(name.alias("channel"), priority.alias("priority")))

    return let(search_text(raw), said)


def new_customers(raw: Column) -> Column:
    """false where all customers are addressed, true where only new ones are, else null."""
    return let(search_text(raw), lambda text: F.when(text.rlike(EVERYONE), False).when(text.rlike(NEW_ONLY), True))


def segments(raw: Column) -> Column:
    """Segments that a positive statement names; none from a negative one."""

    def named(text: Column) -> Column:
        hits = F.array_compact(F.array(*(F.when(text.rlike(p), label) for p, label in SEGMENTS)))
        return F.when(text.rlike(SEGMENT_YES) & ~text.rlike(SEGMENT_NO), hits).otherwise(F.array().cast("array<string>"))

    return let(search_text(raw), named)


def document_channel(said: Column, ordinal: Column) -> Column:
    """Aggregate: the channel of a document's sentences; exclusive before positive, then the first."""
    return F.min_by(said["channel"], F.when(said.isNotNull(), F.struct((-said["priority"]).alias("p"), ordinal.alias("o"))))
