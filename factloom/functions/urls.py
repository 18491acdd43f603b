"""URL canonical forms, allowlists, slug labels, sitemap and robots locations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slug words and the label each suggests, and the order of preference of labels.
SLUG_LABELS = {"arac": "tasit", "finansman": "finansman", "ihtiyac": "ihtiyac", "kampanya": "kampanya", "kart": "kart", "konut": "konut", "tasit": "tasit"}
PRODUCTS, GENERIC = ("konut", "tasit", "ihtiyac"), ("kampanya", "kart", "finansman")
SUFFIX = "(?:[iu]|lar[iu]?|ler[iu]?)?"
SITEMAP_LOCS = 5000


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def canonical(url: Column) -> Column:
    """https URLs without credentials and with no port but 443, fragment dropped, host lower-cased; else null."""
    parts = r"^(https)://([A-Za-z0-9.-]+)(?::443)?(/[^?#\\]*)?(\?[^#\\]*)?(?:#.*)?$"
    path = F.regexp_extract(url, parts, 3)
    built = F.concat(
        F.lit("https://"), F.lower(F.regexp_extract(url, parts, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, parts, 4)
    )
    return F.when(url.rlike(parts), built)


def trimmed(url: Column) -> Column:
    """Comparison form without the last slash."""
    return F.regexp_replace(url, "/+$", "")


def slug_words(path: Column) -> Column:
    return F.array_remove(F.split(F.lower(path), "[^a-z0-9]+"), "")


def slug_tokens(path: Column) -> Column:
    """Known slug words of a path, also with a suffix, in alphabetic order."""
    found = slug_words(path)
    hits = [_hit(found, t) for t in sorted(SLUG_LABELS)]
    return F.array_compact(F.array(*hits))


def _hit(found: Column, token: str) -> Column:
    return F.when(F.exists(found, lambda w: w.rlike(f"^{token}{SUFFIX}$")), token)


def slug_label(tokens: Column) -> Column:
    """The preferred label among those the tokens suggest; none: null."""
    out = None
    for label in (*PRODUCTS, *GENERIC):
        hit = F.arrays_overlap(tokens, F.lit([t for t, own in SLUG_LABELS.items() if own == label]))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def slug_score(tokens: Column) -> Column:
    product = F.arrays_overlap(tokens, F.lit([t for t, own in SLUG_LABELS.items() if own in PRODUCTS]))
    return F.size(tokens) + product.cast("int")


def sitemap_locations(xml: Column) -> Column:
    """Distinct <loc> values in order, the first 5000: that bound is the format's."""
    return F.slice(F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s][^<]*?)\s*</loc>"), 1)), 1, SITEMAP_LOCS)


def robots_sitemaps(robots: Column) -> Column:
    """Distinct Sitemap directives of a robots.txt body in order."""
    lines = F.transform(F.split(robots, "\r?\n"), lambda x: F.regexp_extract(F.split(x, "#")[0], r"(?i)^\s*sitemap\s*:\s*(\S+)\s*$", 1))
    return F.array_distinct(F.array_remove(lines, ""))


def detail_path(path: Column, prefix: str) -> Column:
    """Whether a path lies under the prefix and isn't it; traversal, backslashes and stacked escapes are refused."""
    unsafe = path.rlike(r"(?i)(?:^|/)\.{1,2}(?:/|$)|\\|%2e|%2f|%5c|%25")
    return F.startswith(path, F.lit(prefix)) & (F.rtrim(F.regexp_replace(path, "/+$", "")) != prefix.rstrip("/")) & ~unsafe


def links(html: Column) -> Column:
    """Distinct href values of anchors in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'\\]+)["']"""), 1))


def absolute(link: Column, base_host: Column) -> Column:
    """A site-absolute link on its page's host; full URLs stay."""
    return F.when(F.startswith(link, F.lit("/")) & ~F.startswith(link, F.lit("//")), F.concat(F.lit("https://"), base_host, link)).otherwise(link)
