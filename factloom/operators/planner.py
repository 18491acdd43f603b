"""Questions to typed plans by rule tables: vetoes, banks, family, campaign type, dimensions, intent, keywords."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold

# Fixed values, all folded. In each table the first label with a term in the question decides.
UNSAFE = (
    "onceki talimatlari unut", "talimatlari yok say", "sistem mesajini", "system prompt", "ignore previous", "developer message", "drop table", "select from", "sql calistir", "arac cagrisi", "tool call",
)
FAMILIES = (
    ("financing", ("finansman", "konut", "tasit", "ihtiyac")), ("card", ("kart", "kredi karti")), ("participation_account", ("katilma hesabi", "kar payi")), ("investment", ("yatirim", "fon", "altin")),
)
CAMPAIGNS = (
    ("cashback", ("nakit iade", "cashback")), ("discount", ("indirim",)), ("points", ("puan",)), ("installment", ("taksit",)), ("fee_waiver", ("ucretsiz", "ucret muafiyeti")),
    ("welcome", ("hos geldin", "yeni musteri")), ("profit_share", ("kar payi",)), ("financing_rate", ("finansman orani", "kar orani")),
)
DIMENSIONS = (
    ("rate", ("oran", "kar payi", "maliyet")), ("term", ("vade", "azami sure", "taksit suresi")), ("fee", ("ucret", "masraf")), ("reward", ("odul", "puan", "indirim", "nakit iade")),
    ("eligibility", ("kosul", "uygunluk", "kimler")),
)
INTENTS = (
    ("coverage", ("kapsam", "hangi bankalar", "erisilemeyen", "toplanan banka")),
    ("compare", ("karsilastir", "kiyasla", "hangisi daha", "farklari", "en uygun", "en dusuk", "en yuksek", "en avantajli", "daha avantajli", "hangi banka", "hangisinde")),
    ("glossary", ("ne demek", "sozluk")), ("detail", ("detay", "ayrinti", "kosullari", "kac ay", "kac tl", "ne kadar", "nedir", "yuzde kac")), ("list", ("listele", "goster", "kampanya", "urun")),
)
BANKS = (
    ("albaraka-turk", r"\balbaraka\b(?: turk\w*)?(?: katilim\w*)?(?: bankasi\w*)?"), ("adil-katilim", r"\badil katilim\w*(?: bankasi\w*)?"), ("dunya-katilim", r"\bdunya katilim\w*(?: bankasi\w*)?"),
    ("emlak-katilim", r"\bemlak\b(?: katilim\w*)?(?: bankasi\w*)?"), ("hayat-finans", r"\bhayat finans\w*(?: katilim\w*)?(?: bankasi\w*)?"),
    ("kuveyt-turk", r"\bkuveyt\b(?: turk\w*)?(?: katilim\w*)?(?: bankasi\w*)?"), ("tom-katilim", r"\b(?:tom|t o m) katilim\w*(?: bankasi\w*)?"), ("turkiye-finans", r"\bturkiye finans\w*(?: katilim\w*)?(?: bankasi\w*)?"),
    ("vakif-katilim", r"\bvakif\b(?: katilim\w*)?(?: bankasi\w*)?"), ("ziraat-katilim", r"\bziraat\b(?: katilim\w*)?(?: bankasi\w*)?"),
)
#: Institutions whose names resemble those of the banks above, and names that keep a question in scope.
OUTSIDE = (
    "vakifbank", "vakiflar bankasi", "ziraat bankasi", "emlak konut", "halkbank", "garanti", "akbank", "is bankasi", "isbank", "yapi kredi", "denizbank", "qnb", "seker bank", "sekerbank",
)
INSIDE = ("vakif katilim", "ziraat katilim", "emlak katilim", "turkiye finans", "kuveyt turk", "hayat finans", "albaraka", "dunya katilim", "tom katilim", "adil katilim")
SUBFAMILIES = ("konut", "tasit", "ihtiyac")
MONTHS = r"(?:^| )\d{1,4} ay(?: |$)"
STOP = (
    "acaba", "avantajli", "bana", "banka", "bankada", "bankalar", "bankalarda", "bankanin", "bankasi", "bankasinda", "bankasinin", "bir", "bu", "daha", "da", "dan", "de", "den", "en", "hangi", "hangisi",
    "icin", "ile", "in", "kac", "kadar", "kampanya", "kampanyalari", "kampanyalarini", "mi", "mu", "ne", "nin", "nun", "gore", "olan", "sunuyor", "un", "uygun", "var", "ve",
)

def _any_term(key: Column, terms) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(key, F.lit(term))
    return out


def _first_label(key: Column, table) -> Column:
    return F.coalesce(*(F.when(_any_term(key, terms), label) for label, terms in table))


def _named(key: Column, names) -> Column:
    return key.rlike(r"\b(?:" + "|".join(names) + ")")


@F.arrow_udf(T.ArrayType(T.StringType()))
def free_words(keys: pa.Array) -> pa.Array:
    """Words of two characters or more that touch no term of the rule tables, no bank's name and no number of
    months, and aren't stop words; each once, in order."""
    terms = {t for table in (INTENTS, FAMILIES, CAMPAIGNS, DIMENSIONS) for _, own in table for t in own}
    taken = [re.compile(re.escape(t)) for t in terms] + [re.compile(p) for _, p in BANKS] + [re.compile(MONTHS)]
    out = []
    for key in keys.to_pylist():
        covered = bytearray(len(key))
        for pattern in taken:
            for m in pattern.finditer(key):
                covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
        free = (m.group() for m in re.finditer(r"\S{2,}", key) if m.group() not in STOP and not any(covered[m.start() : m.end()]))
        out.append(list(dict.fromkeys(free)))
    return pa.array(out, pa.list_(pa.string()))


def plan(questions: DataFrame, text_col: str, most: int = 10) -> DataFrame:
    """Adds status (planned, unsafe, out_of_scope), intent, bank_ids, family, campaign_type, dimensions and keywords.

    The vetoes come first and leave the intent unknown and the rest empty. In a question on the
    rate of a financing, a campaign type that only repeats the rate is dropped, and the kind of financing
    leads the keywords. A null question is planned as an empty one.
    """
    own = questions.withColumn("_key", fold(F.coalesce(F.col(text_col), F.lit(""))))
    key, none = F.col("_key"), F.array().cast("array<string>")
    status = F.when(_any_term(key, UNSAFE), "unsafe").when(_named(key, OUTSIDE) & ~_named(key, INSIDE), "out_of_scope").otherwise("planned")
    own = own.withColumns({"status": status, "_free": free_words(key), "_family": _first_label(key, FAMILIES), "_type": _first_label(key, CAMPAIGNS)})
    stated = [F.when(_any_term(key, terms) | (key.rlike(MONTHS) if label == "term" else F.lit(False)), label) for label, terms in DIMENSIONS]
    # A number of months alone names the term after the other dimensions.
    late = ~_any_term(key, dict(DIMENSIONS)["term"]) & key.rlike(MONTHS)
    dims = F.array_compact(F.array(*(F.when(~late, s) if label == "term" else s for (label, _), s in zip(DIMENSIONS, stated, strict=True)), F.when(late, "term")))
    financing = F.coalesce(F.col("_family") == "financing", F.lit(False))
    kinds = F.array_compact(F.array(*(F.when(financing & key.rlike(rf"\b{s}") & ~F.array_contains("_free", s), s) for s in SUBFAMILIES)))
    repeats_rate = financing & F.col("_type").isin("profit_share", "financing_rate") & F.array_contains(dims, "rate")
    ok = F.col("status") == "planned"
    return own.select(
        *questions.columns, "status", F.when(ok, F.coalesce(_first_label(key, INTENTS), F.lit("unknown"))).otherwise("unknown").alias("intent"),
        F.when(ok, F.array_compact(F.array(*(F.when(key.rlike(p), bank) for bank, p in BANKS)))).otherwise(none).alias("bank_ids"), F.when(ok, F.col("_family")).alias("family"),
        F.when(ok & ~F.coalesce(repeats_rate, F.lit(False)), F.col("_type")).alias("campaign_type"), F.when(ok, dims).otherwise(none).alias("dimensions"),
        F.when(ok, F.slice(F.concat(kinds, F.slice("_free", 1, most)), 1, most)).otherwise(none).alias("keywords"),
    )
