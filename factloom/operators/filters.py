"""Typed filters as columns: equality, membership, nested paths, validity, screens."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalizers import holds, let
from ..functions.text import swapped


def equal_filters(filters: dict[str, object]) -> Column:
    """Conjunction of equalities; a filter whose value is None doesn't apply."""
    out = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def contains_ci(array: Column, value: str) -> Column:
    """Whether the array has the value in any casing."""
    return F.exists(array, lambda x: F.lower(x) == value.lower())


def validity(starts: Column, ends: Column, day: date | Column, bucket: str) -> Column:
    """Validity on a day. active: inside the window and at least one bound is stated; upcoming
    and expired need their bound; unknown: neither bound is stated."""
    at = F.lit(day) if isinstance(day, date) else day
    return {
        "active": (starts.isNull() | (starts <= at)) & (ends.isNull() | (ends >= at)) & (starts.isNotNull() | ends.isNotNull()),
        "upcoming": starts > at,
        "expired": ends < at,
        "unknown": starts.isNull() & ends.isNull(),
    }[bucket]


# Signs that a page asks to prove access.
CHALLENGES = (
    "captcha", "g-recaptcha", "hcaptcha", "cf-chl-", "cloudflare turnstile", "verify you are human", "insan oldugunuzu dogrulayin", "insan olduğunuzu doğrulayın",
)


def access_challenge(html: Column) -> Column:
    """Whether the first million characters of a page have one of the signs of an access challenge, A-Z in either case; null: no."""
    head = F.translate(F.substring(html, 1, 1_000_000), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.lit(False)
    for mark in CHALLENGES:
        out = out | head.contains(mark)
    return F.coalesce(out, F.lit(False))


# Phrases by which a text tries to take over instructions, each behind parts of words without one of which it isn't there.
INJECTIONS = (
    (("ignore",), r"\bignore\s+(?:all\s+)?(?:previous|prior)\s+instructions?\b"),
    (("nceki",), r"\b(?:onceki|önceki)\s+(?:(?:tum|tüm)\s+)?(?:talimatlari|talimatları|yonergeleri|yönergeleri)\s+(?:yoksay|yok\s+say|unut|gormezden\s+gel|görmezden\s+gel)"),
    (("mesaj", "promptunu"), r"\b(?:sistem|system)\s+(?:mesajini|mesajını|promptunu)\s+(?:yoksay|yok\s+say|gormezden\s+gel|görmezden\s+gel)"),
    (("prompt", "message", "mesaj"), r"\b(?:system|developer|assistant)\s*(?:prompt|message|mesaji|mesajı)\b"),
    (("json",), r"\b(?:return|output|çıktı|cikti)\s+(?:only\s+)?json\b"),
    (("tool", "function"), r"\b(?:tool|function)\s*(?:call|çağrısı|cagrisi)\b"),
    (("sql", "shell", "command"), r"\b(?:execute|run|çalıştır|calistir)\s+(?:this\s+)?(?:sql|shell|command)"),
    (("curl",), r"\bcurl\s+https?://"),
    (("/etc/passwd", "key", "parolay"), r"(?:/etc/passwd|api[_ -]?key|secret[_ -]?key|parolayi?\s+goster)"),
    (("parola", "ifre", "key"), r"\b(?:yönetici|yonetici|admin|sistem|system)[^\n]{0,48}(?:parola|şifre|sifre|api[_ -]?key|secret[_ -]?key)[^\n]{0,80}"
    r"(?:cevap|yanıt|yanit|başlık|baslik|çıktı|cikti|output)[^\n]{0,48}(?:ekle|yaz|göster|goster|döndür|dondur|paylaş|paylas)"),
    (("masa",), r"\b(?:kaynakta|kanıtta|kanitta)\s+(?:yazmasa|olmasa|bulunmasa)\s+da\b"),
    (("sahte", "uydur"), r"\b(?:sahte|uydur(?:ulmuş|ulmus)?)\b[^\n]{0,48}(?:citation(?:_id)?|atıf|atif|kaynak)[^\n]{0,48}(?:üret|uret|ekle|yaz|döndür|dondur)"),
)
#: Letters that are equal to one of a-z in either case although their lower case isn't.
ALIKE_FROM, ALIKE_TO = "\u0131\u0130\u017f\u212a", "iisk"


def injection(text: Column) -> Column:
    """Whether a text carries an obvious takeover phrase; null: no."""

    def found(low: Column) -> Column:
        out = F.lit(False)
        for words, pattern in INJECTIONS:
            # A plain search for a part of the phrase saves most patterns.
            out = out | (holds(low, *words) & text.rlike(f"(?iU){pattern}"))
        return F.coalesce(out, F.lit(False))

    return let(F.lower(swapped(text, ALIKE_FROM, ALIKE_TO)), found)
