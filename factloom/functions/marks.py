"""What a text names: places of product families, campaign types, segments, channels and restrictions, with offsets.

Patterns are laid on the folded text, which keeps every character's place, so offsets are those of the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalizers import holds, let
from .text import search_text
from .wording import CHANNEL_NO, CHANNEL_YES, CUSTOMER, ONLY, SEGMENT_NO, SEGMENT_YES

# Fixed values (folded text): label and its patterns; the first pattern that is there gives the place.
FAMILIES = (
    ("financing", (r"\b(?:konut\s+finansmani|tasit\s+finansmani|ihtiyac\s+finansmani|finansman)\b",)),
    ("card", (r"\b(?:kredi\s+karti|banka\s+karti|kartiniz|kart)\b", r"\bparaf(?:para|kart)?\b")),
    ("participation_account", (r"\b(?:katilma\s+hesabi|katilim\s+hesabi|kar\s+payi\s+dagitim)\b",)),
    ("investment", (r"\b(?:yatirim\s+fonu|yatirim|altin\s+hesabi)\b",)),
)
NEW_CUSTOMER = rf"yeni\s+{CUSTOMER}"
RESTRICTED = (
    rf"\b(?:yalnizca|sadece)\s+{NEW_CUSTOMER}\b", rf"\b{NEW_CUSTOMER}\s+icin\s+(?:gecerli|ozel)\b", rf"\b{NEW_CUSTOMER}\s+(?:ozel|(?:kampanyadan\s+)?(?:yararlanabilir|faydalanabilir))\b",
)
UNIVERSAL = (
    r"\b(?:tum|butun)\s+musteriler(?:imiz)?(?:e|in|den|de)?\b", rf"\bmevcut\s+ve\s+{NEW_CUSTOMER}\b", r"\byeni\s+ve\s+mevcut\s+musteriler(?:imiz)?(?:e|in|den|de)?\b",
)
CAMPAIGNS = (
    ("cashback", (r"\b(?:nakit\s+iade|para\s+iadesi)\b",)), ("discount", (r"\bindirim(?:li|i)?\b",)), ("points", (r"\b(?:(?<!baz\s)puan|bonus)\b", r"\b(?:parafpara|worldpuan)\b")),
    ("fee_waiver", (r"\b(?:masrafsiz|ucretsiz|ucret\s+alinmayacak)\b",)), ("welcome", (r"\bhos\s+geldin\b", *RESTRICTED)), ("installment", (r"\btaksit(?:li|lendirme)?\b",)),
    ("financing_rate", (r"\bfinansman(?:\s+kar)?\s+(?:payi\s+)?orani\b",)), ("profit_share", (r"\b(?:kar\s+payi\s+dagitim|kar\s+paylasim)\s+orani\b",)),
)
#: A fee named as a noun; amount brackets; and the financing rates that are no share of a value.
FEE_NOUN, BRACKET = r"\b(?:ucret|masraf|komisyon|aidat)(?!siz)", r"\btutar\b|\baralig"
PRICED = (r"\bfinansman\s+kar\s+(?:payi\s+)?orani\b|\bfinansman\s+payi\s+orani\b",)
UNCAPPED = (r"(?<!\bazami\s)(?<!\bmaksimum\s)(?<!\bmaks\s)(?<!\bmaks\.\s)\bfinansman\s+orani\b|" + PRICED[0],)
SEGMENTS = (
    ("bireysel", (r"\bbireysel\b|\bgercek\s+kisi(?:ler)?\b",)), ("ticari", (r"\bticari\b",)), ("kobi", (r"\bkobi\b",)), ("emekli", (r"\bemekli(?:ler)?\b",)), ("genc", (r"\bgenc(?:ler)?\b",)),
    ("kadin_girisimci", (r"\bkadin\s+girisimci\b",)), ("yeni_musteri", (rf"\b{NEW_CUSTOMER}\b",)),
)
BOTH_DIGITAL = r"\b(?:albaraka\s+)?mobil\s+(?:ve|/)\s+internet(?:\s+bankaciligi)?(?:\s+kanallari)?\s+uzerinden\b"
CHANNELS = (
    ("mobile", (r"\b(?:mobil\s+(?:sube(?:den)?|uygulama(?:dan)?)|albaraka\s+mobil)\b",)), ("web", (r"\b(?:internet\s+(?:subesi|bankaciligi|uzerinden)|web\s+sitesi)\b",)),
    ("branch", (r"(?<!mobil\s)(?<!internet\s)\bsube(?:ye|de|den|ler(?:e|de|den)?)?\b",)), ("digital", (r"\bdijital\s+kanal(?:lar)?\b",)),
)
ELIGIBLE = r"\b(?:yararlanabilir|yararlanmak|kosul|sart|gerekmektedir|zorunlu|yalnizca|sadece|uye\s+isyeri)\b"
AMOUNT = r"(?:₺\s*\d[\d.,]*|\d[\d.,]*\s*(?:(?:bin|milyon|milyar)\s+)?(?:tl|try|turk\s+lirasi|usd|euro|eur|dolar))"
#: Parts of words without one of which a label's patterns aren't there: a plain search saves the patterns.
WORDS = {
    "financing": ("finansman",), "card": ("kart", "paraf"), "participation_account": ("katilma", "katilim", "dagitim"), "investment": ("yatirim", "altin"),
    "cashback": ("iade",), "discount": ("indirim",), "points": ("puan", "bonus", "parafpara"), "fee_waiver": ("masrafsiz", "ucret"), "welcome": ("geldin", "musteri"), "installment": ("taksit",),
    "financing_rate": ("finansman",), "profit_share": ("dagitim", "paylasim"),
    "bireysel": ("bireysel", "gercek"), "ticari": ("ticari",), "kobi": ("kobi",), "emekli": ("emekli",), "genc": ("genc",), "kadin_girisimci": ("girisimci",), "yeni_musteri": ("musteri",),
    "mobile": ("mobil",), "web": ("internet", "web"), "branch": ("sube",), "digital": ("dijital",),
}
#: Longest span of a mark.
MOST = 500


def spans(text: Column, pattern: str, most: int = MOST) -> Column:
    """array<struct<quote, start, end>> of all matches of a pattern in the folded text: ``quote`` is text[start:end] itself.

    Matches and the pieces between them alternate, so their lengths give the places.
    """

    def placed(key: Column) -> Column:
        found, gaps = F.regexp_extract_all(key, F.lit(pattern), F.lit(0)), F.split(key, pattern, -1)
        before = lambda k: F.aggregate(F.slice(gaps, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(found, lambda m, k: F.struct(before(k).alias("start"), (before(k) + F.length(m)).alias("end")))

    made = F.transform(let(search_text(text), placed), lambda p: F.struct(F.substr(text, p["start"] + 1, p["end"] - p["start"]).alias("quote"), p["start"].alias("start"), p["end"].alias("end")))
    return F.filter(made, lambda m: (m["end"] > m["start"]) & (m["end"] - m["start"] <= most))


def cells(text: Column, separator: str = "|") -> Column:
    """array<struct<quote, start, end>>: the trimmed cells of a table row; empty cells have an empty span at their place."""
    step = lambda acc, part: F.struct((acc["at"] + F.length(part) + len(separator)).alias("at"), F.concat(acc["out"], F.array(_cell(part, acc["at"]))).alias("out"))
    none = F.array().cast("array<struct<quote:string,start:int,end:int>>")
    return F.aggregate(F.split(text, f"\\Q{separator}\\E", -1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _cell(part: Column, at: Column) -> Column:
    trimmed = F.trim(part)
    start = at + F.length(part) - F.length(F.ltrim(part))
    start = F.when(F.length(trimmed) == 0, at).otherwise(start)
    return F.struct(trimmed.alias("quote"), start.alias("start"), (start + F.length(trimmed)).alias("end"))


def _first(key: Column, patterns: tuple[str, ...]) -> Column:
    """struct<start, end> of the first pattern that is in the key, else null."""
    found = []
    for p in patterns:
        at, m = F.regexp_instr(key, F.lit(p)), F.length(F.regexp_extract(key, p, 0))
        found.append(F.when((at > 0) & (m > 0) & (m <= MOST), F.struct((at - 1).alias("start"), (at - 1 + m).alias("end"))))
    return F.coalesce(*found)


def first_places(text: Column, table) -> Column:
    """array<struct<label, start, end>>: for each label of the table that the text names, its first place, in the table's order."""
    return let(search_text(text), lambda key: places(key, table))


def places(key: Column, table) -> Column:
    """first_places() of a text given as search_text()."""
    one = lambda label, patterns: let(F.when(holds(key, *WORDS[label]), _first(key, patterns)), lambda p: F.when(p.isNotNull(), F.struct(F.lit(label).alias("label"), p["start"].alias("start"), p["end"].alias("end"))))
    return F.array_compact(F.array(*(one(label, patterns) for label, patterns in table)))


def campaign_places(key: Column, heading: Column) -> Column:
    """places() of the campaign types with their vetoes: a free side service names no waiver outside a heading unless the text has
    a fee noun too; a capped financing rate, or one among amount brackets, is a share of a value unless it names the profit."""
    plain = tuple((label, p) for label, p in CAMPAIGNS if label != "financing_rate")
    names = [label for label, _ in CAMPAIGNS]

    def judged(key: Column) -> Column:
        waiver = heading | key.rlike(FEE_NOUN)
        stated = F.when(key.rlike(BRACKET), places(key, (("financing_rate", PRICED),))).otherwise(places(key, (("financing_rate", UNCAPPED),)))
        rates = F.when(holds(key, *WORDS["financing_rate"]), stated).otherwise(F.array().cast("array<struct<label:string,start:int,end:int>>"))
        kept = F.filter(places(key, plain), lambda m: (m["label"] != "fee_waiver") | waiver)
        return F.array_sort(F.concat(kept, rates), lambda a, b: F.array_position(F.lit(names), a["label"]).cast("int") - F.array_position(F.lit(names), b["label"]).cast("int"))

    return let(key, judged)


def named(text: Column, table) -> Column:
    """Labels of the table that the text names."""
    return F.transform(first_places(text, table), lambda m: m["label"])


def channel_places(sentence: Column) -> Column:
    """struct<priority, places>: the channels of a positive statement, an exclusive one (2) before others (1); else null.

    A place that says by itself what is positive is the mark, else the whole sentence is.
    """
    return let(search_text(sentence), channels)


def channels(key: Column) -> Column:
    """channel_places() of a sentence given as search_text()."""

    def judged(key: Column) -> Column:
        both = F.when(holds(key, "mobil"), _first(key, (BOTH_DIGITAL,)))
        # What the joint wording covers names no channel of its own.
        kept = F.filter(places(key, CHANNELS), lambda m: both.isNull() | (m["end"] <= both["start"]) | (m["start"] >= both["end"]))
        own = F.concat(F.array_compact(F.array(F.when(both.isNotNull(), F.struct(F.lit("digital").alias("label"), both["start"].alias("start"), both["end"].alias("end"))))), kept)
        said = lambda own: F.transform(
            own,
            lambda m: F.when(F.substr(key, m["start"] + 1, m["end"] - m["start"]).rlike(CHANNEL_YES), m).otherwise(F.struct(m["label"].alias("label"), F.lit(0).alias("start"), F.length(key).alias("end"))),
        )
        priority = F.when(key.rlike(ONLY), 2).otherwise(1)
        return let(own, lambda x: F.when((F.size(x) > 0) & key.rlike(CHANNEL_YES) & ~key.rlike(CHANNEL_NO), F.struct(priority.alias("priority"), said(x).alias("places"))))

    return let(key, judged)


def segment_places(key: Column) -> Column:
    """Segments that a text (given as search_text()) states positively; new customers only where the text restricts itself to them."""

    def judged(key: Column) -> Column:
        positive, restricted = key.rlike(SEGMENT_YES) & ~key.rlike(SEGMENT_NO), _first(key, RESTRICTED)
        return F.filter(places(key, SEGMENTS), lambda m: F.when(m["label"] == "yeni_musteri", restricted.isNotNull()).otherwise(positive))

    return let(key, judged)


def restriction(text: Column) -> Column:
    """struct<start, end> of the wording that restricts an offer to new customers, else null."""
    return let(search_text(text), restricted)


def restricted(key: Column) -> Column:
    """restriction() of a text given as search_text()."""
    return F.when(holds(key, "musteri"), _first(key, RESTRICTED))


def universal(sentence: Column) -> Column:
    """struct<start, end> of the wording that opens an offer to everyone, null in a negative sentence."""
    return let(search_text(sentence), universally)


def universally(key: Column) -> Column:
    """universal() of a sentence given as search_text()."""
    return F.when(holds(key, "musteri") & ~key.rlike(SEGMENT_NO) & ~key.rlike(CHANNEL_NO), _first(key, UNIVERSAL))


def eligible(text: Column) -> Column:
    return search_text(text).rlike(ELIGIBLE)
