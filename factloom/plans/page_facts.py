"""The SQL of facts that pages state: tags to blocks, blocks to sentences, sentences to typed facts, all pages alike.

It states the rules of functions/html.py and functions/normalizers.py once more, without looking around in patterns: where those look at
a neighbour, every character that is no part of a word is followed here by a mark, so that two matches can share it.
"""

from __future__ import annotations

from html import entities

from ..functions import html, normalizers
from ..functions import text as texts
from ..operators import filters

# Characters that no text holds: a mark behind others, and a decoded ampersand.
MARK, AMP, CUT = "﷐", "﷑", "﷒"
NAMES = r"turk\s+lirasi|abd\s+dolari|tl|try|usd|eur|euro|avro|gbp|sterlin"
#: What Python's patterns and strip() take for spaces.
SPACE = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# What html.unescape() does with numbers of no character.
_CONTROLS = {0x00: "�", 0x0D: "\r"} | {k: bytes([k]).decode("cp1252", "replace").replace("�", chr(k)) for k in range(0x80, 0xA0)}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(map(quoted, sorted(names))) + ")"


def _map(pairs: dict) -> str:
    key = lambda k: quoted(k) if isinstance(k, str) else str(k)
    return "MAP {" + ", ".join(f"{key(k)}: {quoted(v) if v.isprintable() else _chars(v)}" for k, v in pairs.items()) + "}"


def _chars(v: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in v)


def blocks_sql(pages: str) -> str:
    """CTEs ending in blocks(page_id, text) of ``pages`` (page_id, html)."""
    inside = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*"""
    raw = "|".join(rf"(?i:<{t}(?:[\s/]{inside}[^/>]|[\s]*)?>(?s:.*?)(?:</\s*{t}\s*>|\z))" for t in ("script", "style"))
    token = rf"<!--(?s:.*?)--\s*>|{raw}|</?[a-zA-Z]{inside}>|<!--[^>]*>|<[!?/][^>]*>|[^<]+|<"
    name = r"^</?\s*([a-zA-Z][^\t\n\r\f />]*)"
    bare = rf"""regexp_replace(x, '=\s*(?:"[^"]*"|''[^'']*'')', '="" ', 'g')"""
    style = rf"""lower(replace(regexp_extract(x, '(?i)[\s/"'']style\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*)', 1), ' ', ''))"""
    hidden = rf"""(regexp_matches({bare}, '(?i)[\s/"'']hidden[\s=/>]') OR regexp_matches(x, '[\s/"''](?i:aria-hidden)\s*=\s*["'']?true["''\s/>]') OR contains({style}, 'display:none'))"""
    ref = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;{AMP}]{{1,32}};?)"
    hexed = "list_reduce(list_transform(string_split(lower(regexp_extract(r, '^&#[xX]([0-9a-fA-F]+)', 1)), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: least(a * 16 + c, 99999999))"
    number = f"CASE WHEN regexp_matches(r, '^&#[xX]') THEN {hexed} ELSE coalesce(TRY_CAST(regexp_extract(r, '[0-9]+') AS BIGINT), 99999999) END"
    return f"""src AS ({pages}), tok AS (SELECT page_id, regexp_extract_all(html, {quoted(token)}) AS toks FROM src WHERE html IS NOT NULL),
        cls AS (SELECT page_id, toks, list_transform(toks, lambda x: struct_pack(tag := lower(regexp_extract(x, {quoted(name)}, 1)),
            k := CASE WHEN regexp_matches(x, '(?i)^<(?:script|style)(?:[\\s]|>)') AND NOT ends_with(x, '/>') THEN 'x' WHEN regexp_matches(x, '^</[a-zA-Z]') THEN 'c' WHEN regexp_matches(x, '^<[a-zA-Z].*>$', 's') THEN CASE WHEN ends_with(x, '/>') THEN 'e' ELSE 'o' END
                WHEN regexp_matches(x, '^<!--.*--\\s*>$', 's') OR regexp_matches(x, '^<(?:[?/]|![^-]|!-[^-]|!>)') THEN 'x' ELSE 't' END, hid := starts_with(x, '<') AND {hidden})) AS e FROM tok),
        run AS (SELECT page_id, toks, list_reduce(e, lambda s, x: CASE
            WHEN x.k = 't' THEN struct_pack(st := s.st, off := s.off, a := s.a || CASE WHEN s.off = 0 THEN 't' ELSE 'x' END)
            WHEN x.k = 'x' THEN struct_pack(st := s.st, off := s.off, a := s.a || 'x')
            WHEN x.k IN ('o', 'e') AND x.tag IN {_in(html.VOID)} THEN struct_pack(st := s.st, off := s.off, a := s.a || CASE WHEN x.tag = 'br' THEN 'b' ELSE 'x' END)
            WHEN x.k IN ('o', 'e') THEN struct_pack(st := CASE WHEN x.k = 'o' THEN list_append(s.st, x.tag) ELSE s.st END,
                off := CASE WHEN x.k = 'o' AND (x.hid OR s.off > 0 OR x.tag IN {_in(html.DROPPED)}) THEN s.off + 1 ELSE s.off END,
                a := s.a || CASE WHEN s.off > 0 OR x.tag NOT IN {_in(html.BLOCKS)} THEN 'x' WHEN x.tag IN ('td', 'th') AND list_contains(s.st, 'tr') THEN 'p' ELSE 'f' END)
            WHEN list_contains(s.st, x.tag) THEN struct_pack(st := s.st[:len(s.st) - list_position(list_reverse(s.st), x.tag)], off := CAST(greatest(0, s.off - list_position(list_reverse(s.st), x.tag)) AS INTEGER),
                a := s.a || CASE WHEN list_has_any(s.st[len(s.st) - list_position(list_reverse(s.st), x.tag) + 1:len(s.st) - s.off], [{_in(html.BLOCKS - {"td", "th"})[1:-1]}]) THEN 'f' ELSE 'x' END)
            ELSE struct_pack(st := s.st, off := s.off, a := s.a || 'x') END, struct_pack(st := []::VARCHAR[], off := 0::INTEGER, a := ''::VARCHAR)).a AS a FROM cls),
        act AS (SELECT page_id, unnest(toks) AS x, unnest(string_split(a, '')) AS a, unnest(range(len(toks))) AS i FROM run),
        num AS (SELECT page_id, i, x, a, sum(CASE WHEN a = 'f' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS b FROM act WHERE a <> 'x'),
        amp AS (SELECT page_id, i, a, b, replace(x, '&amp;', '{AMP}') AS x FROM num),
        dec AS (SELECT page_id, i, b, CASE a WHEN 'p' THEN ' | ' WHEN 'b' THEN ' ' WHEN 'f' THEN '' ELSE replace(CASE WHEN NOT contains(x, '&') THEN x ELSE
            list_aggregate(list_transform(list_zip(string_split_regex(x, {quoted(ref)}), list_append(list_transform(regexp_extract_all(x, {quoted(ref)}), lambda r: CASE
                WHEN r LIKE '&#%' THEN list_transform([{number}], lambda n: CASE WHEN map_contains({_map(_CONTROLS)}, CAST(n AS INTEGER)) THEN {_map(_CONTROLS)}[CAST(n AS INTEGER)] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533)
                    WHEN n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n IN (11, 127) OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END)[1]
                ELSE coalesce(list_filter(list_transform(range(len(r) - 1, 1, -1), lambda n: named[r[2:n + 1]] || r[n + 2:]), lambda y: y IS NOT NULL)[1], r) END), '')), lambda y: y[1] || y[2]), 'string_agg', '') END, '{AMP}', '&') END AS x
            FROM amp, (SELECT {_map(entities.html5)} AS named)),
        joined AS (SELECT page_id, b, trim(trim(regexp_replace(string_agg(x, '' ORDER BY i), '{SPACE}+', ' ', 'g'), ' |')) AS text FROM dec GROUP BY page_id, b),
        blocks AS (SELECT page_id, substr(text, CAST(pos + 1 AS BIGINT), {html.MAX_BLOCK}) AS text FROM (SELECT page_id, text, unnest(range(0, len(text), {html.MAX_BLOCK})) AS pos FROM joined WHERE text <> ''))"""


def _takeover() -> str:
    alike = lambda x: x.translate(str.maketrans(filters.ALIKE_FROM, filters.ALIKE_TO))
    every = " OR ".join(f"regexp_matches(low, {quoted('(?i)' + alike(p))})" for _, p in filters.INJECTIONS)
    return f"(SELECT *, translate(text, {quoted(filters.ALIKE_FROM)}, {quoted(filters.ALIKE_TO)}) AS low FROM blocks) WHERE NOT ({every})"


def facts_sql(pages: str) -> str:
    """CTEs ending in facts(page_id, kind, value, width) of ``pages`` (page_id, html)."""
    n = normalizers
    has = lambda p, t="t": f"regexp_matches({t}, {quoted(p)})"
    part = lambda p, k, t="t": f"regexp_extract({t}, {quoted(p)}, {k})"
    every = lambda p, t="t", k=1: f"regexp_extract_all({t}, {quoted(p)}, {k})"
    percent = lambda found, by: f"list_transform({found}, lambda x: CAST(TRY_CAST(replace(x, ',', '.') AS DECIMAL(20,8)) / {by} AS DECIMAL(20,8)))"
    rates = ", ".join(
        (
            percent(every(rf"(?:%|\byuzde)\s*({n.PLAIN})"), 1), percent(every(rf"(?:^|[^\d.,])({n.PLAIN})\s*%", f"regexp_replace(t, '%(\\s*\\d)', '{MARK}\\1', 'g')"), 1), percent(every(rf"(?:‰|\bbinde)\s*({n.PLAIN})"), 10),
            percent(every(rf"({n.PLAIN})\s*‰"), 10), percent(every(rf"({n.PLAIN})\s*(?:baz\s+puan|bps)\b"), 100),
        )
    )
    missing = f"((NOT {has('[0-9]')} OR {' OR '.join(f'contains(t, {quoted(w)})' for w in texts.MISSING_WORDS)}) AND (key IN {_in(texts.MISSING)} OR {has(texts.MISSING_FIELD, 'key')}))"
    # Money: z is the text with the mark behind every character that is no part of a word.
    gap, sep = rf"(?:\s{MARK})", rf"[.,\s]{MARK}"
    number = rf"(?:[+-]{MARK})?(?:\d{{1,3}}(?:{sep}\d{{3}})+(?:[.,]{MARK}\d+)?|\d+(?:[.,]{MARK}\d+)?)"
    names, edge, end = NAMES.replace(r"\s+", gap + "+"), rf"(?:[^\w{MARK}]|$)", "(?:[^a-z0-9]|$)"
    scale = "(bin|milyon|milyar)"
    behind = rf"(?:^|{MARK})({number})(?:{gap}+{scale}\b)?(?:{gap}*[₺€£$]|{gap}+(?:{names}){end})"
    before = rf"(?:[₺€£$]{MARK}{gap}*|(?:^|[^a-z0-9])(?:{names}){gap}+)({number})(?:{gap}+{scale}\b|{edge})"
    code = " ".join(f"WHEN {has(f'^(?:{p})$', 'm')} THEN '{c}'" for c, p in n.CURRENCIES.items())
    dots, commas = r"^\d{1,3}(?:\.\d{3})+", r"^\d{1,3}(?:,\d{3})+"
    plain = f"""CASE WHEN {has('^[0-9]+$', 'x')} THEN x WHEN {has('^[0-9]+,[0-9]+$', 'x')} THEN replace(x, ',', '.') WHEN {has(dots + '$', 'x')} THEN replace(x, '.', '') WHEN {has(commas + '$', 'x')} THEN replace(x, ',', '')
        WHEN {has(dots + ',[0-9]+$', 'x')} THEN replace(replace(x, '.', ''), ',', '.') WHEN {has(commas + '[.][0-9]+$', 'x')} THEN replace(x, ',', '') WHEN {has('^[0-9]+[.][0-9]{3}$', 'x')} THEN replace(x, '.', '')
        WHEN {has('^[0-9]+[.][0-9]+$', 'x')} AND codes[1] <> 'TRY' THEN x END"""
    # Terms.
    num, unit = n.TERM_NUMBER, n.TERM_UNIT
    span, suffix = rf"({num})\s*({unit})?\s*(?:-|ile|ila)\s*({num})\s*({unit})\b", rf"({num})\s*(ay|yil|sene)dan\s+({num})\s*(ay|yil|sene)a\s+kadar"
    most, upto = rf"(?:en\s+fazla|azami)\s+({num})\s*({unit})\b", rf"({num})\s*(ay|yil|sene)a\s+(?:kadar|varan)\b"
    mixed, single = r"(\d+)\s*(?:yil|sene)\s*(?:ve\s*)?(\d+)\s*ay\b", rf"({num})\s*({unit})\b"
    months = lambda number, unit: f"list_transform([TRY_CAST(replace({number}, ',', '.') AS DECIMAL(12,4)) * CASE WHEN starts_with({unit}, 'ay') THEN 1 ELSE 12 END], lambda x: CASE WHEN x = floor(x) AND x > 0 AND x <= 1200 THEN CAST(x AS INTEGER) END)[1]"
    years = f"coalesce(TRY_CAST({part(mixed, 1)} AS INTEGER), 0) * 12 + coalesce(TRY_CAST({part(mixed, 2)} AS INTEGER), 0)"
    either = f"CASE WHEN {part(span, 2)} = '' THEN {part(span, 4)} ELSE {part(span, 2)} END"
    refused = (
        r"\b(?:gun|hafta)\b", r"\b(?:ve\s+uzeri|den\s+fazla|asgariden\s+itibaren)\b",
    )
    installments = rf"({has(rf'{num}\s*taksit')} AND {has(r'\btaksit\b')} AND NOT {has(rf'{num}\s*ay\s+taksit')})"
    listed = rf"{has(r'\b(?:secenek|taksit)\w*\b')} AND {has(r'[,/]\s*\d|\d\s+ve\s+\d')}"
    return f"""{blocks_sql(pages)},
        cut AS (SELECT page_id, trim(unnest(string_split(regexp_replace(regexp_replace(text, '([!?;]+)', '\\1{CUT}', 'g'), '\\.( |$)', '.{CUT}\\1', 'g'), '{CUT}'))) AS s FROM {_takeover()}),
        quotes AS (SELECT page_id, substr(s, CAST(pos + 1 AS BIGINT), 500) AS q FROM (SELECT page_id, s, unnest(range(0, len(s), 500)) AS pos FROM cut WHERE s <> '')),
        folded AS (SELECT page_id, len(q) AS width, replace(lower(translate(trim(q), {quoted(texts.FOLD_FROM)}, {quoted(texts.FOLD_TO)})), chr(160), ' ') AS t FROM quotes),
        said AS (SELECT row_number() OVER () AS id, page_id, width, t, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(t, '(\\W)', '\\1{MARK}', 'g') AS z FROM folded WHERE {has('[0-9]')} OR {has(n.FEE_MARK)}),
        marked AS (SELECT *, list_concat({rates}) AS rates, {missing} AS nothing,
            list_concat(regexp_extract_all(t, '[₺€£$]'), list_transform({every(f'(?:^|[^a-z0-9])({names}){end}', 'z')}, lambda m: replace(m, '{MARK}', ''))) AS marks,
            len({every(rf'(?:^|{MARK})({number}){edge}', 'z')}) AS numbers, CASE WHEN {has(behind, 'z')} THEN struct_pack(x := {part(behind, 1, 'z')}, s := {part(behind, 2, 'z')}) WHEN {has(before, 'z')} THEN struct_pack(x := {part(before, 1, 'z')}, s := {part(before, 2, 'z')}) END AS near,
            CASE WHEN {listed} THEN list_transform({every(r'\b(\d+)\b')}, lambda y: TRY_CAST(y AS INTEGER)) END AS listed FROM said),
        coded AS (SELECT *, list_distinct(list_transform(marks, lambda m: CASE {code} END)) AS codes, ltrim(regexp_replace(near.x, '[\\s{MARK}]', '', 'g'), '+') AS x,
            CASE WHEN len(rates) = 1 AND NOT nothing AND rates[1] BETWEEN 0 AND 1000 AND NOT {has(n.RATE_BOUND, f"regexp_replace(t, {quoted(n.DATE_FROM)}, ' ', 'g')")} THEN CAST(CAST(rates[1] AS DECIMAL(12,6)) AS VARCHAR) END AS rate FROM marked),
        priced AS (SELECT *, CASE WHEN len(marks) > 0 AND len(codes) = 1 AND numbers = 1 AND NOT nothing AND NOT list_contains(marks, '$') AND NOT {has(n.WAIVER_NEGATED)} AND NOT {has(n.WAIVER)}
            THEN CAST(TRY_CAST(TRY_CAST({plain} AS DECIMAL(20,4)) * CAST(CASE near.s WHEN 'bin' THEN 1000 WHEN 'milyon' THEN 1000000 WHEN 'milyar' THEN 1000000000 ELSE 1 END AS DECIMAL(10,0)) AS DECIMAL(20,4)) AS VARCHAR) END AS amount,
            CASE WHEN len(list_distinct(listed)) >= 2 AND len(list_filter(listed, lambda y: coalesce(y BETWEEN 1 AND 1200, false))) = len(listed) THEN 'discrete' WHEN {has(span)} THEN 'span' WHEN {has(suffix)} THEN 'suffix'
                WHEN {has(most)} THEN 'most' WHEN {has(upto)} THEN 'upto' WHEN {has(mixed)} THEN 'mixed' ELSE 'single' END AS form FROM coded),
        termed AS (SELECT *, CASE WHEN NOT {has(r'\b(?:ay|yil|vade)\b')} OR nothing OR {' OR '.join(map(has, refused))} OR {installments} OR (contains(t, 'erteleme') AND (contains(t, 'taksit') OR contains(t, 'vade'))) THEN NULL
            WHEN form = 'discrete' THEN list_filter(listed, lambda y, i: list_position(listed, y) = i)[-1]
            WHEN form = 'span' THEN CASE WHEN {months(part(span, 1), either)} <= {months(part(span, 3), part(span, 4))} THEN {months(part(span, 3), part(span, 4))} END
            WHEN form = 'suffix' THEN CASE WHEN {months(part(suffix, 1), part(suffix, 2))} <= {months(part(suffix, 3), part(suffix, 4))} THEN {months(part(suffix, 3), part(suffix, 4))} END
            WHEN form = 'most' THEN {months(part(most, 1), part(most, 2))} WHEN form = 'upto' THEN {months(part(upto, 1), part(upto, 2))} WHEN form = 'mixed' THEN CASE WHEN {years} BETWEEN 1 AND 1200 THEN {years} END
            WHEN len(list_distinct({every(single, 't', 0)})) = 1 THEN {months(part(single, 1), part(single, 2))} END AS term,
            CASE WHEN NOT {has(n.FEE_MARK)} THEN NULL WHEN {has(n.FEE_WAIVED)} THEN 'waived' WHEN {has(n.FEE_DOUBT)} THEN NULL ELSE coalesce(amount, rate) END AS fee FROM priced),
        facts AS (SELECT page_id, unnest(['rate', 'amount', 'term', 'fee']) AS kind, unnest([rate, CASE WHEN fee IS NULL THEN amount END, CAST(term AS VARCHAR), fee]) AS value, CAST(width AS BIGINT) AS width FROM termed)"""
