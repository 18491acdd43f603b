"""Typed normalizers as column expressions.

Each returns struct<status, reason_code, value>; ``value`` is set only where the status is
"normalized". A normalizer is a list of (condition, status, reason) checks over the folded text;
the first that holds wins, so the order of the checks is part of the contract.

The raw text is bound once, and a part of it is read only where a check or the value needs it: a pattern
is laid only on texts that hold one of its words, and an empty part never reaches a parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MISSING_WORDS, search_text, states_nothing

MONEY_TYPE, RATE_TYPE = "decimal(20,4)", "decimal(12,6)"

# Fixed values of the money grammar (folded text).
NUMBER = r"(?<!\w)[+-]?(?:\d{1,3}(?:[.,\s]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?!\w)"
SCALES = {"bin": 1_000, "milyon": 1_000_000, "milyar": 1_000_000_000}
CURRENCIES = {
    "TRY": r"turk\s+lirasi|tl|try|₺", "USD": r"abd\s+dolari|amerikan\s+dolari|usd", "EUR": r"eur|euro|avro|€", "GBP": r"gbp|sterlin|£",
}
CURRENCY = r"(?:(?<![a-z0-9])(?:turk\s+lirasi|abd\s+dolari|amerikan\s+dolari|tl|try|usd|eur|euro|avro|gbp|sterlin)(?![a-z0-9])|[₺€£$])"
SCALE = r"(?:\s*(bin|milyon|milyar)\b)?"
WAIVER = (
    r"\bucretsiz\b|\bmasrafsiz\b|\bucret\s+alinma(?:z|yacaktir)\b|\bucret\s+tahsil\s+edilme(?:z|yecektir)\b"
    r"|\b(?:tahsis\s+)?ucret(?:i)?\s+yoktur\b|\bherhangi\s+bir\s+ucret\s+(?:yoktur|bulunmamaktadir)\b"
)
WAIVER_NEGATED = r"\b(?:ucretsiz|masrafsiz)\s+degil\b|\bucret\s+alinmaz\s+degil\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: repeated use of a long expression would copy it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def missing(raw: Column, folded: Column) -> Column:
    """is_missing() of a text whose folded form is known (leading and trailing spaces don't count)."""
    # A text with a digit states something unless one of these words takes it back.
    return raw.isNull() | ((~folded.rlike("[0-9]") | holds(folded, *MISSING_WORDS)) & states_nothing(folded))


def holds(text: Column, *words: str) -> Column:
    """Whether a text holds one of some words: a plain search that saves a pattern."""
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def outcome(checks: list[tuple[Column, str, str]], value: Column, reason: Column | str) -> Column:
    """struct<status, reason_code, value> by the first check that holds, else normalized."""
    failed = None
    for condition, status, why in checks:
        entry = F.struct(F.lit(status).alias("status"), F.lit(why).alias("reason_code"))
        failed = F.when(condition, entry) if failed is None else failed.when(condition, entry)
    done = F.struct(F.lit("normalized").alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason_code"))
    return let(
        failed.otherwise(done),
        lambda v: F.struct(v["status"].alias("status"), v["reason_code"].alias("reason_code"), F.when(v["status"] == "normalized", value).alias("value")),
    )


def decimal_number(token: Column, currency: Column, to: str = MONEY_TYPE) -> Column:
    """A number token as a decimal, null where it isn't one.

    With both separators the later one is the decimal sign; a repeated separator groups by
    three; one comma is the decimal sign; one dot before three digits groups thousands, else it
    is the decimal sign, but not for TRY.
    """
    groups_dot, groups_comma = r"^\d{1,3}(?:\.\d{3})+", r"^\d{1,3}(?:,\d{3})+"

    def plain(raw: Column) -> Column:
        return (
            F.when(raw.rlike(r"^\d+$"), raw)
            .when(raw.rlike(r"^\d+,\d+$"), F.translate(raw, ",", "."))
            .when(raw.rlike(groups_dot + "$"), F.translate(raw, ".", ""))
            .when(raw.rlike(groups_comma + "$"), F.translate(raw, ",", ""))
            .when(raw.rlike(groups_dot + r",\d+$"), F.translate(F.translate(raw, ".", ""), ",", "."))
            .when(raw.rlike(groups_comma + r"\.\d+$"), F.translate(raw, ",", ""))
            .when(raw.rlike(r"^\d+\.\d{3}$"), F.translate(raw, ".", ""))
            .when(raw.rlike(r"^\d+\.\d+$") & ~currency.eqNullSafe(F.lit("TRY")), raw)
        ).try_cast(to)

    return let(F.regexp_replace(F.regexp_replace(token, r"\s", ""), r"^\+", ""), plain)


def _currency_code(marker: Column, hint: Column) -> Column:
    out = F.when(marker == "$", F.when(hint == "USD", "USD"))
    for code, names in CURRENCIES.items():
        out = out.when(marker.rlike(f"^(?:{names})$"), code)
    return out


def money(raw: Column, hint: Column | None = None, fee_context: bool = False) -> Column:
    """One amount with its currency: value struct<amount, currency, inferred>."""
    hint = F.lit(None).cast("string") if hint is None else hint
    return let(raw, lambda own: _money(own, hint, fee_context))


def _money(raw: Column, hint: Column, fee_context: bool) -> Column:
    before, behind, bare = rf"({CURRENCY})\s*({NUMBER}){SCALE}", rf"({NUMBER}){SCALE}\s*({CURRENCY})", rf"({NUMBER}){SCALE}"

    def parts(text: Column) -> Column:
        """What the text holds: its numbers and currency marks."""
        marks = F.regexp_extract_all(text, F.lit(f"({CURRENCY})"), 1)
        return F.struct(
            text.alias("text"), F.size(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)).alias("numbers"), marks.alias("marks"), (holds(text, "ucret", "masraf") & text.rlike(WAIVER)).alias("waived"),
        )

    def placed(p: Column) -> Column:
        """The number next to a mark; with more than one number, or none, or a waiver it doesn't count."""

        def picked(pattern: str, token: int, scale: int, mark: int | None) -> Column:
            g = lambda k: F.regexp_extract(p["text"], pattern, k)
            return F.struct(g(token).alias("token"), g(scale).alias("scale"), (g(mark) if mark else F.lit(None).cast("string")).alias("mark"))

        marked = F.size(p["marks"]) > 0
        candidate = F.when(marked & p["text"].rlike(behind), picked(behind, 1, 2, 3)).when(marked & p["text"].rlike(before), picked(before, 2, 3, 1)).when(~marked, picked(bare, 1, 2, None))
        return F.struct(
            p["text"].alias("text"), p["numbers"].alias("numbers"), p["marks"].alias("marks"), F.when((p["numbers"] == 1) & ~p["waived"], candidate).alias("candidate"),
            F.array_distinct(F.transform(p["marks"], lambda m: _currency_code(m, hint))).alias("codes"), p["waived"].alias("waived"),
        )

    def priced(p: Column) -> Column:
        code = F.coalesce(_currency_code(p["candidate"]["mark"], hint), hint)
        factor = F.lit(1).cast("decimal(10,0)")
        for name, times in SCALES.items():
            factor = F.when(p["candidate"]["scale"] == name, F.lit(times).cast("decimal(10,0)")).otherwise(factor)
        amount = let(code, lambda own: F.struct(own.alias("code"), (decimal_number(p["candidate"]["token"], own) * factor).try_cast(MONEY_TYPE).alias("amount")))
        return let(F.when(p["candidate"].isNotNull(), amount), lambda c: judged(p, c["code"], c["amount"]))

    def judged(p: Column, code: Column, amount: Column) -> Column:
        waived, marks = p["waived"], p["marks"]
        checks = [
            (missing(raw, p["text"]), "missing", "money_missing"),
            (holds(p["text"], "degil") & p["text"].rlike(WAIVER_NEGATED), "invalid", "fee_waiver_negated"),
            (waived & F.lit(not fee_context), "unsupported", "fee_waiver_requires_fee_context"),
            (waived & hint.isNull(), "ambiguous", "money_currency_unknown"),
            (~waived & F.array_contains(marks, "$") & ~hint.eqNullSafe(F.lit("USD")), "ambiguous", "currency_symbol_ambiguous"),
            (~waived & hint.isNotNull() & F.exists(p["codes"], lambda c: c != hint), "ambiguous", "currency_hint_conflict"),
            (~waived & (F.size(marks) == 0) & hint.isNull(), "ambiguous", "money_currency_unknown"),
            (~waived & ((p["numbers"] > 1) | (F.size(p["codes"]) > 1)), "ambiguous", "multiple_money_values"),
            (~waived & ((p["numbers"] == 0) | p["candidate"].isNull()), "invalid", "money_value_not_found"),
            (~waived & amount.isNull(), "invalid", "invalid_money_number"),
        ]
        value = F.struct(
            F.when(waived, F.lit(0).cast(MONEY_TYPE)).otherwise(amount).alias("amount"), F.when(waived, hint).otherwise(code).alias("currency"), waived.alias("inferred")
        )
        return outcome(checks, value, F.when(waived, "explicit_fee_waiver_normalized").otherwise("money_normalized"))

    return let(let(let(search_text(F.trim(raw)), parts), placed), priced)


# Fixed values of the rate grammar (folded text); first match wins.
RATE_KINDS = (
    (r"\byillik\s+(?:toplam\s+)?maliyet\s+oran", "annual_cost_rate"),
    (r"\b(?:azami|maksimum|maks)\s+finansman\s+oran|\bdeger(?:i|si)?nin\s+(?:en\s+fazla\s+|azami\s+)?(?:%|yuzde\b)", "ltv_ratio"),
    (r"\b(?:kar\s+(?:payi\s+)?dagitim|kar\s+paylasim)\s+oran", "profit_share_distribution_rate"),
    (r"\b(?:gecmis|tarihsel|gerceklesen)\s+(?:yillik\s+)?getiri", "historical_return_rate"),
    (r"\bindirim(?:\s+orani)?\b", "discount_rate"),
    (r"\b(?:nakit\s+)?iade\s+orani\b|\bodul\s+orani\b", "reward_rate"),
)
#: A word of each kind above; texts without any are of none.
RATE_WORD = r"maliyet|finansman|deger|dagitim|paylasim|getiri|indirim|iade|odul"
FINANCING_RATE = r"\b(?:finansman(?:\s+kar\s+payi)?|kullandirim\s+kar\s+payi)\s+orani\b"
AMOUNT_NEAR = r"\d[\d.,]*\s*(?:tl|try)\b|₺\s*\d"
RATE_PERIODS = ((r"\b(?:vade\s+sonu(?:nda)?|vade\s+toplami|toplam\s+oran)\b", "term_total"), (r"\byillik\b|\bsenelik\b", "annual"), (r"\baylik\b", "monthly"))
RATE_LABELS = ((r"\befektif\b", "effective"), (r"\bnominal\b", "nominal"), (r"\bbilesik\b", "compound"), (r"\bbasit\b", "simple"))
RATE_BOUND = r"\b(?:itibaren|baslayan|kadar|varan|en\s+az|en\s+fazla|asgari|arasi(?:nda)?)\b"
DATE_FROM = r"\btarih(?:inden|inde|in)?\s+itibaren\b"
PLAIN = r"-?\d+(?:[.,]\d+)?"


def _first(text: Column, table, otherwise: Column | str) -> Column:
    out = None
    for pattern, label in table:
        out = F.when(text.rlike(pattern), label) if out is None else out.when(text.rlike(pattern), label)
    return out.otherwise(otherwise)


def _hinted(inferred: Column, hint: Column | None, unknown: str) -> tuple[Column, Column]:
    """(value, conflict): a hint fills what the text leaves open and conflicts with another stated value."""
    if hint is None:
        return inferred, F.lit(False)
    return F.when(inferred == unknown, F.coalesce(hint, F.lit(unknown))).otherwise(inferred), hint.isNotNull() & (inferred != unknown) & (inferred != hint)


def rate(raw: Column, kind_hint: Column | None = None, period_hint: Column | None = None, gross_net_hint: Column | None = None) -> Column:
    """One exact percentage: value struct<value_percent, kind, period, gross_net_basis, basis_label>.

    Per mille and basis points become percent. Bounds ("up to", "from") are ambiguous unless
    they belong to a date.
    """
    return let(raw, lambda own: _rate(own, kind_hint, period_hint, gross_net_hint))


def _rate(raw: Column, kind_hint: Column | None, period_hint: Column | None, gross_net_hint: Column | None) -> Column:
    def numbers(text: Column) -> Column:
        def found(pattern: str, divisor: int, *signs: str) -> Column:
            every = F.transform(
                F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: (F.translate(x, ",", ".").try_cast("decimal(20,8)") / divisor).cast("decimal(20,8)")
            )
            return F.when(holds(text, *signs), every).otherwise(F.array().cast("array<decimal(20,8)>"))

        every = F.concat(
            found(rf"(?:%|\byuzde)\s*({PLAIN})", 1, "%", "yuzde"), found(rf"(?<![\d.,])({PLAIN})\s*%(?!\s*\d)", 1, "%"), found(rf"(?:‰|\bbinde)\s*({PLAIN})", 10, "‰", "binde"),
            found(rf"({PLAIN})\s*‰", 10, "‰"), found(rf"({PLAIN})\s*(?:baz\s+puan|bps)\b", 100, "puan", "bps"),
        )
        return F.struct(text.alias("text"), every.alias("every"))

    def parts(t: Column) -> Column:
        """What the text says about its number; nothing where it hasn't exactly one."""
        text, one = t["text"], F.size(t["every"]) == 1
        gross, net = holds(text, "brut") & text.rlike(r"\bbrut\b"), holds(text, "net") & text.rlike(r"\bnet\b")
        financing = F.when(holds(text, "orani") & text.rlike(FINANCING_RATE) & (text.rlike(r"\bkar\b") | ~text.rlike(AMOUNT_NEAR)), "financing_profit_rate").otherwise("unknown")
        kind = F.when(text.rlike(RATE_WORD), _first(text, RATE_KINDS, financing)).otherwise(financing)
        labels = F.array_compact(F.array(*(F.when(text.rlike(p), label) for p, label in RATE_LABELS)))
        bound = F.when(holds(text, "tarih"), F.regexp_replace(text, DATE_FROM, " ").rlike(RATE_BOUND)).otherwise(text.rlike(RATE_BOUND))
        return F.struct(
            text.alias("text"), t["every"].alias("every"), F.when(one, kind).alias("kind"), F.when(one, _first(text, RATE_PERIODS, "unspecified")).alias("period"),
            F.when(one, F.when(gross & ~net, "gross").when(net & ~gross, "net").otherwise("unspecified")).alias("basis"),
            F.when(one & holds(text, "efektif", "nominal", "bilesik", "basit"), labels).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(one, bound).alias("bound"),
        )

    def judged(p: Column) -> Column:
        every = p["every"]
        kind, kind_conflict = _hinted(p["kind"], kind_hint, "unknown")
        period, period_conflict = _hinted(p["period"], period_hint, "unspecified")
        basis, basis_conflict = _hinted(p["basis"], gross_net_hint, "unspecified")
        checks = [
            (missing(raw, p["text"]), "missing", "rate_missing"),
            (F.exists(every, lambda v: v.isNull() | (v < 0) | (v > 1000)), "invalid", "invalid_rate_number"),
            (F.size(every) == 0, "invalid", "rate_value_not_found"),
            ((F.size(every) > 1) | p["bound"], "ambiguous", "non_exact_or_multiple_rates"),
            (kind_conflict, "ambiguous", "rate_kind_hint_conflict"),
            (period_conflict, "ambiguous", "rate_period_hint_conflict"),
            (basis_conflict, "ambiguous", "gross_net_hint_conflict"),
        ]
        made = F.struct(
            F.get(every, F.lit(0)).cast(RATE_TYPE).alias("value_percent"), kind.alias("kind"), period.alias("period"), basis.alias("gross_net_basis"),
            F.when(F.size(p["labels"]) == 1, F.get(p["labels"], F.lit(0))).alias("basis_label"),
        )
        return outcome(checks, made, "rate_normalized")

    return let(let(let(search_text(F.trim(raw)), numbers), parts), judged)


TERM_NUMBER, TERM_UNIT = r"\d+(?:[.,]\d+)?", r"(?:aylik|ay|yillik|yil|senelik|sene)"


def _months(number: Column, unit: Column) -> Column:
    """Whole months from 1 to 1200, else null."""
    # An empty number never reaches the parser, whose failures cost much more than a test.
    parsed = F.when(F.length(number) > 0, F.translate(number, ",", ".").try_cast("decimal(12,4)")) * F.when(F.startswith(unit, F.lit("ay")), 1).otherwise(12)
    return let(parsed, lambda n: F.when((n == F.floor(n)) & (n > 0) & (n <= 1200), n.cast("int")))


def term(raw: Column) -> Column:
    """Months: value array<struct<minimum_months, maximum_months>>, one entry for each discrete option."""
    return let(raw, _term)


def _term(raw: Column) -> Column:
    span = rf"({TERM_NUMBER})\s*({TERM_UNIT})?\s*(?:-|ile|ila)\s*({TERM_NUMBER})\s*({TERM_UNIT})\b"
    suffix = rf"({TERM_NUMBER})\s*(ay|yil|sene)dan\s+({TERM_NUMBER})\s*(ay|yil|sene)a\s+kadar"
    most = rf"(?:en\s+fazla|azami)\s+({TERM_NUMBER})\s*({TERM_UNIT})\b"
    upto = rf"({TERM_NUMBER})\s*(ay|yil|sene)a\s+(?:kadar|varan)\b"
    mixed = r"(\d+)\s*(?:yil|sene)\s*(?:ve\s*)?(\d+)\s*ay\b"
    single = rf"({TERM_NUMBER})\s*({TERM_UNIT})\b"
    pair = lambda low, high: F.struct(low.alias("minimum_months"), high.alias("maximum_months"))

    def lists(text: Column) -> Column:
        listed = holds(text, "secenek", "taksit") & text.rlike(r"\b(?:secenek|taksit)\w*\b") & text.rlike(r"[,/]\s*\d|\d\s+ve\s+\d")
        options = F.when(listed, F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("int"))))
        return let(options, lambda o: F.struct(text.alias("text"), o.alias("options"), F.coalesce((F.size(o) >= 2) & F.forall(o, lambda x: x.isNotNull() & (x > 0) & (x <= 1200)), F.lit(False)).alias("discrete")))

    def parts(t: Column) -> Column:
        """The first form that the text has, with its numbers; later forms aren't read then."""
        text = t["text"]
        g = lambda pattern, k: F.regexp_extract(text, pattern, k)
        to, limit, years_named = holds(text, "kadar"), holds(text, "kadar", "varan"), holds(text, "yil", "sene")
        name = (
            F.when(t["discrete"], "discrete").when(text.rlike(span), "span").when(to & text.rlike(suffix), "suffix").when(holds(text, "fazla", "azami") & text.rlike(most), "most")
            .when(limit & text.rlike(upto), "upto").when(years_named & text.rlike(mixed), "mixed").otherwise("single")
        )

        def numbered(form: Column) -> Column:
            only = lambda own, value: F.when(form == own, value)
            unit = let(g(span, 2), lambda u: F.when(u == "", g(span, 4)).otherwise(u))
            years = F.coalesce(g(mixed, 1).try_cast("int"), F.lit(0)) * 12 + F.coalesce(g(mixed, 2).try_cast("int"), F.lit(0))
            ranged = only("span", pair(_months(g(span, 1), unit), _months(g(span, 3), g(span, 4)))).when(form == "suffix", pair(_months(g(suffix, 1), g(suffix, 2)), _months(g(suffix, 3), g(suffix, 4))))
            return F.struct(
                F.when(form.isin("span", "suffix"), "range").when(form == "upto", "most").otherwise(form).alias("form"), text.alias("text"), t["options"].alias("options"), ranged.alias("range"),
                only("most", _months(g(most, 1), g(most, 2))).when(form == "upto", _months(g(upto, 1), g(upto, 2))).alias("top"), only("mixed", years).alias("years"),
                only("single", F.array_distinct(F.regexp_extract_all(text, F.lit(single), 0))).alias("singles"), only("single", _months(g(single, 1), g(single, 2))).alias("exact"),
            )

        return let(name, numbered)

    def judged(p: Column) -> Column:
        name = p["form"]
        text, low, high = p["text"], p["range"]["minimum_months"], p["range"]["maximum_months"]
        checks = [
            (missing(raw, text), "missing", "term_missing"),
            (holds(text, "gun", "hafta") & text.rlike(r"\b(?:gun|hafta)\b"), "unsupported", "non_month_term_unit"),
            (holds(text, "uzeri", "fazla", "itibaren") & text.rlike(r"\b(?:ve\s+uzeri|den\s+fazla|asgariden\s+itibaren)\b"), "unsupported", "open_ended_term_not_representable"),
            (holds(text, "taksit") & text.rlike(rf"{TERM_NUMBER}\s*taksit") & text.rlike(r"\btaksit\b") & ~text.rlike(rf"{TERM_NUMBER}\s*ay\s+taksit"), "unsupported", "installment_count_is_not_term"),
            (text.contains("erteleme") & (text.contains("taksit") | text.contains("vade")), "ambiguous", "multiple_term_roles"),
            ((name == "range") & (low.isNull() | high.isNull()), "invalid", "invalid_term_range"),
            ((name == "range") & (low > high), "invalid", "reversed_term_range"),
            ((name == "most") & p["top"].isNull(), "invalid", "invalid_term_maximum"),
            ((name == "mixed") & ((p["years"] < 1) | (p["years"] > 1200)), "invalid", "term_out_of_range"),
            ((name == "single") & (F.size(p["singles"]) == 0), "invalid", "term_value_not_found"),
            ((name == "single") & (F.size(p["singles"]) > 1), "ambiguous", "multiple_term_values"),
            ((name == "single") & p["exact"].isNull(), "invalid", "invalid_term_number"),
        ]
        value = (
            F.when(name == "discrete", F.transform(p["options"], lambda x: pair(x, x))).when(name == "range", F.array(pair(low, high)))
            .when(name == "most", F.array(pair(F.lit(None).cast("int"), p["top"]))).when(name == "mixed", F.array(pair(p["years"], p["years"]))).otherwise(F.array(pair(p["exact"], p["exact"])))
        )
        reasons = {"discrete": "discrete_terms", "range": "term_range", "most": "maximum_term", "mixed": "mixed_term", "single": "exact_term"}
        reason = F.lit(None).cast("string")
        for own, label in reasons.items():
            reason = F.when(name == own, f"{label}_normalized").otherwise(reason)
        return outcome(checks, value, reason)

    return let(let(let(search_text(F.trim(raw)), lists), parts), judged)


# Month names (folded), January first.
MONTHS = ("ocak", "subat", "mart", "nisan", "mayis", "haziran", "temmuz", "agustos", "eylul", "ekim", "kasim", "aralik")
MONTH = "(" + "|".join(MONTHS) + ")"
ISO, DOTTED, NAMED, DAY_MONTH = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\d)", rf"(?<!\d)(\d{{1,2}})\s+{MONTH}(?:\s+(\d{{4}}))?(?!\d)", r"(?<![\d./])(\d{1,2})[./](\d{1,2})(?![\d./])"


def _date_of(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, null where there is no such day."""
    stated = year.isNotNull() & (F.length(year.cast("string")) > 0) & month.isNotNull() & (month.try_cast("int") > 0) & (F.length(day.cast("string")) > 0)
    # Days past a month's end are told by its length: a parser's failures cost much more than a test.
    first = F.when(stated & (month.try_cast("int") <= 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    return let(first, lambda f: F.when(f.isNotNull() & (day.cast("int") >= 1) & (day.cast("int") <= F.dayofmonth(F.last_day(f))), F.date_add(f, day.cast("int") - 1)))


def _month_number(name: Column) -> Column:
    return F.array_position(F.lit(list(MONTHS)), name).cast("int")


def dates_in(text: Column, reference: Column) -> Column:
    """Dates of a folded text in order of their patterns: array<struct<date, yearless>>; the year
    of a yearless date is the reference's (null without one)."""
    year = F.year(reference)

    none = F.array().cast("array<struct<date:date,yearless:boolean>>")
    dated = lambda y, m, d, yearless: F.struct(_date_of(y, m, d).alias("date"), yearless.alias("yearless"))
    full = F.lit(False)

    def g(x, pattern, k):
        return F.regexp_extract(x, pattern, k)

    def each(pattern: str, build, acc: Column) -> Column:
        """struct<found, left> after one more pattern: what it takes is no longer there for the next ones."""

        def taken(hits: Column) -> Column:
            return F.when(F.size(hits) > 0, F.struct(F.concat(acc["found"], F.transform(hits, build)).alias("found"), F.regexp_replace(acc["left"], pattern, " ").alias("left"))).otherwise(acc)

        return let(F.regexp_extract_all(acc["left"], F.lit(pattern), 0), taken)

    def named(x: Column) -> Column:
        return let(g(x, NAMED, 3), lambda y: dated(F.when(y == "", year.cast("string")).otherwise(y), _month_number(g(x, NAMED, 2)), g(x, NAMED, 1), y == ""))

    forms = (
        (ISO, lambda x: dated(g(x, ISO, 1), g(x, ISO, 2), g(x, ISO, 3), full)), (DOTTED, lambda x: dated(g(x, DOTTED, 3), g(x, DOTTED, 2), g(x, DOTTED, 1), full)),
        (NAMED, named), (DAY_MONTH, lambda x: dated(year.cast("string"), g(x, DAY_MONTH, 2), g(x, DAY_MONTH, 1), F.lit(True))),
    )

    def read(acc: Column, rest: tuple) -> Column:
        return let(each(rest[0][0], rest[0][1], acc), lambda a: read(a, rest[1:])) if rest else acc["found"]

    # All forms begin with a digit.
    return F.when(text.rlike("[0-9]"), let(F.struct(none.alias("found"), text.alias("left")), lambda acc: read(acc, forms))).otherwise(none)


def date(raw: Column, reference: Column | None = None) -> Column:
    """One calendar date. "bugün" and "yarın" and dates without a year need a reference."""
    reference = F.lit(None).cast("date") if reference is None else reference
    return let(F.struct(raw.alias("raw"), reference.alias("day")), lambda x: _date(x["raw"], x["day"]))


def _date(raw: Column, reference: Column) -> Column:
    def parts(text: Column) -> Column:
        return F.struct(
            text.alias("text"), text.rlike(r"\b(?:bugun|yarin)\b").alias("relative"), text.rlike(r"\byarin\b").alias("tomorrow"), dates_in(text, reference).alias("found"),
            text.rlike(rf"\b{MONTH}\b|\b(?:19|20)\d\d\b").alias("rough"),
        )

    def judged(p: Column) -> Column:
        relative, found = p["relative"], p["found"]
        first = F.get(found, F.lit(0))
        checks = [
            (missing(raw, p["text"]), "missing", "date_missing"),
            (relative & reference.isNull(), "ambiguous", "relative_date_needs_reference"),
            (~relative & (F.size(found) > 1), "ambiguous", "multiple_dates"),
            (~relative & (F.size(found) == 0) & p["rough"], "ambiguous", "date_precision_ambiguous"),
            (~relative & (F.size(found) == 0), "invalid", "date_value_not_found"),
            (~relative & first["yearless"] & reference.isNull(), "ambiguous", "date_year_missing"),
            (~relative & first["date"].isNull(), "invalid", "invalid_calendar_date"),
        ]
        shifted = F.date_add(reference, F.when(p["tomorrow"], 1).otherwise(0))
        return outcome(checks, F.when(relative, shifted).otherwise(first["date"]), F.when(relative, "relative_date_normalized").otherwise("date_normalized"))

    return let(let(search_text(F.trim(raw)), parts), judged)


def validity(raw: Column, reference: Column | None = None) -> Column:
    """A validity window: value struct<starts_on, ends_on>."""
    reference = F.lit(None).cast("date") if reference is None else reference
    return let(F.struct(raw.alias("raw"), reference.alias("day")), lambda x: _validity(x["raw"], x["day"]))


def _validity(raw: Column, reference: Column) -> Column:
    within = rf"(?<!\d)(\d{{1,2}})\s*(?:-|ile|ila)\s*(\d{{1,2}})\s+{MONTH}(?:\s+(\d{{4}}))?"
    whole = rf"^\s*{MONTH}\s+(?:ayi\s+)?(\d{{4}})(?:\s+(?:ayi|boyunca|ayi\s+boyunca))?\s*$"
    connected = r"-|\bile\b|\bila\b|\barasi(?:nda)?\b|(?:dan|den|tan|ten|itibaren)\b.*(?:kadar|dek)\b"
    until = r"\b(?:kadar|dek|son(?:a)?\s+er|sonuna)\b|\bson\s+(?:gun|tarih)\b"
    since = r"\b(?:itibaren|baslayan|basla)\w*\b"
    clock = r"\b(?:saat\s*)?\d{1,2}[:.]\d{2}\s*(?:'?(?:e|a|ye|ya)\s+kadar)|\bsaat\s+\d"

    def parts(text: Column) -> Column:
        g = lambda p, k: F.regexp_extract(text, p, k)
        form = F.when(holds(text, "sonuna") & text.rlike(r"\bbu\s+ay\s+sonuna\s+kadar\b"), "this_month").when(text.rlike(within), "within").when(text.rlike(whole), "whole").otherwise("dates")

        def shaped(name: Column) -> Column:
            only = lambda own, value: F.when(name == own, value)
            year = F.when(g(within, 4) == "", F.year(reference).cast("string")).otherwise(g(within, 4))
            rough = lambda n: F.when(n == 0, text.rlike(rf"\b{MONTH}\b|\b(?:19|20)\d\d\b"))
            return let(
                only("dates", dates_in(text, reference)),
                lambda found: F.struct(
                    text.alias("text"), name.alias("form"), only("within", g(within, 4) == "").alias("yearless"), found.alias("found"), text.rlike(clock).alias("clock"),
                    only("within", _date_of(year, _month_number(g(within, 3)), g(within, 1))).alias("a"), only("within", _date_of(year, _month_number(g(within, 3)), g(within, 2))).alias("b"),
                    only("whole", _date_of(g(whole, 2), _month_number(g(whole, 1)), F.lit("1"))).alias("month"), F.when(F.size(found) == 2, text.rlike(connected)).alias("connected"),
                    F.when(F.size(found) == 1, text.rlike(until)).alias("until"), F.when(F.size(found) == 1, text.rlike(since)).alias("since"), rough(F.size(found)).alias("rough"),
                ),
            )

        return let(form, shaped)

    def judged(p: Column) -> Column:
        form, found, a, b = p["form"], p["found"], p["a"], p["b"]
        free, n = form == "dates", F.size(found)
        x, y = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        # A yearless first date after a second one belongs to the year before.
        start = F.when(x["yearless"] & (x["date"] > y["date"]), F.add_months(x["date"], -12)).otherwise(x["date"])
        checks = [
            (missing(raw, p["text"]), "missing", "validity_missing"),
            (p["clock"], "unsupported", "time_of_day_not_representable"),
            ((form == "this_month") & reference.isNull(), "ambiguous", "relative_date_needs_reference"),
            ((form == "within") & p["yearless"] & reference.isNull(), "ambiguous", "validity_year_missing"),
            ((form == "within") & (a.isNull() | b.isNull()), "invalid", "invalid_validity_window"),
            ((form == "within") & (a > b), "invalid", "reversed_validity_window"),
            (free & (n > 2), "ambiguous", "multiple_validity_dates"),
            (free & (n == 2) & ~p["connected"], "ambiguous", "multiple_validity_roles"),
            (free & F.exists(found, lambda d: d["yearless"]) & reference.isNull(), "ambiguous", "validity_year_missing"),
            (free & F.exists(found, lambda d: d["date"].isNull()), "invalid", "invalid_validity_window"),
            (free & (n == 2) & (start > y["date"]), "invalid", "reversed_validity_window"),
            (free & (n == 0) & p["rough"], "ambiguous", "validity_precision_ambiguous"),
            (free & (n == 0), "invalid", "validity_date_not_found"),
            (free & (n == 1) & (p["until"] == p["since"]), "ambiguous", "validity_boundary_role_unknown"),
        ]
        window = lambda s, e: F.struct(s.alias("starts_on"), e.alias("ends_on"))
        none = F.lit(None).cast("date")
        value = (
            F.when(form == "this_month", window(none, F.last_day(reference))).when(form == "within", window(a, b))
            .when(form == "whole", window(p["month"], F.last_day(p["month"]))).when(n == 2, window(start, y["date"]))
            .when(p["until"], window(none, x["date"])).otherwise(window(x["date"], none))
        )
        reason = (
            F.when(form == "this_month", "relative_validity_normalized").when(form == "whole", "full_month_validity_normalized")
            .when((form == "within") | (n == 2), "validity_range_normalized").otherwise("open_validity_normalized")
        )
        return outcome(checks, value, reason)

    return let(let(search_text(F.trim(raw)), parts), judged)


# Fixed values of the fee grammar (folded text).
FEE_MARK = r"\b(?:ucret|masraf|tahsis|aidat|komisyon)"
NEGATED = r"(?:maz|mez|miyor|muyor|mayacak|meyecek|mamakta|memekte|mamis|memis|madi|medi)"
FEE_WAIVED = (
    rf"\b(?:ucretsiz|masrafsiz)\b|\b(?:alin|yansitil|tahsil\s+edil|talep\s+edil|uygulan){NEGATED}\w*|\bbanka\s+tarafindan\s+karsilan\w*|\b(?:yoktur|bulunmamaktadir|bulunmaz)\b"
)
FEE_DOUBT = r"\b\w*(?:ma|me)(?:z|yacak|yecek|makta|mekte|mis|di|ya|ye)\w*\b|\b\w*(?:miyor|muyor)\b|\b\w*(?:abilir|ebilir)\w*\b|\b(?:degil|haric|istisna|yerine|kosuluyla)\b"
FEE_KINDS = (
    (r"\berken\s+(?:kapama|kapatma|odeme)\b", "early_exit", "one_time"), ("tahsis", "allocation", "one_time"), ("aidat|yillik", "annual", "per_year"),
    ("aylik", "monthly", "per_month"), ("islem", "transaction", "per_transaction"),
)


def fee(raw: Column) -> Column:
    """What a sentence says about a fee: struct<kind, basis, waived, waiver_limit, money, rate>, null
    where it says none or its polarity is open. A waiver is decided before any amount is read."""
    return let(raw, _fee)


def _fee(raw: Column) -> Column:
    ceiling = money(F.regexp_extract(raw, r"(?i)^(.*?)\bkadar\b", 1))["value"]

    def parts(text: Column) -> Column:
        marked = text.rlike(FEE_MARK)
        return F.struct(text.alias("text"), marked.alias("marked"), F.when(marked, text.rlike(FEE_WAIVED)).alias("waived"))

    def priced(p: Column) -> Column:
        """An amount, and a percentage where there is none; neither of a waiver or an open statement."""
        stated = p["marked"] & ~p["waived"] & ~p["text"].rlike(FEE_DOUBT)
        said = let(money(raw)["value"], lambda amount: F.struct(amount.alias("money"), F.when(amount.isNull(), rate(raw)["value"]).alias("rate")))
        return let(F.when(stated, said), lambda v: judged(p["text"], p["marked"], p["waived"], v["money"], v["rate"]))

    def judged(text: Column, marked: Column, waived: Column, amount: Column, percent: Column) -> Column:
        basis = _first(text, [(p, b) for p, _, b in FEE_KINDS], "one_time")
        made = F.struct(
            _first(text, [(p, k) for p, k, _ in FEE_KINDS], "other").alias("kind"), F.when(percent.isNotNull(), "percent_of_amount").otherwise(basis).alias("basis"), waived.alias("waived"),
            F.when(waived & text.rlike(r"\bkadar\b"), ceiling).alias("waiver_limit"), amount.alias("money"), percent.alias("rate"),
        )
        return F.when(marked & (waived | amount.isNotNull() | percent.isNotNull()), made)

    return let(let(search_text(raw), parts), priced)
