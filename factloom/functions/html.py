"""HTML to ordered text blocks, robots rules and sentences with offsets: small parsers inside Arrow tasks."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Elements that hold no content, that begin a block, and that are headings.
DROPPED = frozenset("script style noscript template svg nav footer header aside form iframe".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li tr blockquote pre dt dd figcaption caption td th div section article main body".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAX_BLOCK = 50_000
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects (locator, kind, text) in document order; a table row is one block with " | " between cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.counts: list[dict[str, int]] = [{}]
        self.off = 0
        self.parts: list[str] = []
        self.at: tuple[str, str] | None = None
        self.out: list[tuple[str, str, str]] = []

    def _flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" |").strip()
        if text and self.at:
            self.out += [(self.at[0], self.at[1], text[k : k + MAX_BLOCK]) for k in range(0, len(text), MAX_BLOCK)]
        self.parts = []

    def _place(self):
        tag = next((t.split(":")[0] for t in reversed(self.stack) if t.split(":")[0] in BLOCKS), "body")
        row = next((t for t in reversed(self.stack) if t.startswith("tr:")), None)
        kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else "table_row" if row else "list_item" if tag == "li" else "paragraph"
        self.at = ("/".join(self.stack), kind)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        hidden = dict(attrs)
        index = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        if tag in BLOCKS and not self.off:
            if tag in ("td", "th") and any(t.startswith("tr:") for t in self.stack):
                self.parts.append(" | ")
            else:
                self._flush()
        self.stack.append(f"{tag}:{index}")
        self.counts.append({})
        style = (hidden.get("style") or "").replace(" ", "").lower()
        if tag in DROPPED or "hidden" in hidden or hidden.get("aria-hidden") == "true" or "display:none" in style or self.off:
            self.off += 1
        elif tag in BLOCKS and tag not in ("td", "th"):
            self._place()

    def handle_endtag(self, tag):
        depth = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].split(":")[0] == tag), None)
        if depth is None:
            return
        while len(self.stack) > depth:
            if self.off:
                self.off -= 1
            elif self.stack[-1].split(":")[0] in BLOCKS - {"td", "th"}:
                self._flush()
            self.stack.pop()
            self.counts.pop()
        if not self.off:
            self._place()

    def handle_data(self, data):
        if not self.off and data.strip():
            if self.at is None:
                self._place()
            self.parts.append(data)
        elif not self.off:
            self.parts.append(" ")


def blocks_of(html: str | None) -> list[tuple[str, str, str]]:
    """(locator, kind, text) of a page; null: none."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.out


def _mapped(df: DataFrame, columns: list[str], schema: T.StructType, rows) -> DataFrame:
    """One output row for each tuple that ``rows(*values)`` yields, behind the first column."""

    def run(batches):
        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [part.column(k).to_pylist() for k in range(part.num_columns)]
                made = [(values[0], *row) for values in zip(*lists, strict=True) for row in rows(*values[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], type=f.type) for k, f in enumerate(target)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(``id_col``, ordinal, locator, kind, text, sha256): the blocks of each page in order."""
    schema = T.StructType([pages.schema[id_col]]).add("ordinal", "integer").add("locator", "string").add("kind", "string").add("text", "string").add("sha256", "string")

    def rows(html):
        return [(k, *b, hashlib.sha256(b[2].encode("utf-8", "replace")).hexdigest()) for k, b in enumerate(blocks_of(html))]

    return _mapped(pages, [id_col, html_col], schema, rows)


_SENTENCE = re.compile(r"[!?;]+|\.(?=\s|$)|\n")


def sentences(blocks: DataFrame, id_col: str, text_col: str, most: int = 500) -> DataFrame:
    """(``id_col``, no, quote, start, end): trimmed sentences of at most ``most`` characters with code-point offsets.

    Longer sentences are cut in pieces, so no text is lost.
    """
    schema = T.StructType([blocks.schema[id_col]]).add("no", "integer").add("quote", "string").add("start", "integer").add("end", "integer")

    def rows(text):
        text, out, at = text or "", [], 0
        for stop in [*(m.end() for m in _SENTENCE.finditer(text)), len(text)]:
            piece = text[at:stop]
            start = at + len(piece) - len(piece.lstrip())
            quote = piece.strip()
            for k in range(0, len(quote), most):
                part = quote[k : k + most]
                out.append((len(out), part, start + k, start + k + len(part)))
            at = stop
        return out

    return _mapped(blocks, [id_col, text_col], schema, rows)


_ROBOT_LINE = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*([^#]*)")


def _robots_pattern(rule: str) -> re.Pattern:
    body = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$"))
    return re.compile(body + ("$" if rule.endswith("$") else ""))


def robots_decision(body: str | None, path: str, agent: str) -> tuple[bool, str | None, float | None]:
    """(allowed, matched rule, crawl delay): the group of the agent, else of *; the longest rule wins, allow wins ties."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    delays: dict[str, float] = {}
    names: list[str] = []
    open_group = False
    for line in (body or "").splitlines():
        if not (m := _ROBOT_LINE.match(line)):
            continue
        field, value = m.group(1).lower(), m.group(2).strip()
        if field == "user-agent":
            names = [value.lower()] if not open_group else [*names, value.lower()]
            open_group = True
            for name in names:
                groups.setdefault(name, [])
        else:
            open_group = False
            for name in names:
                if field in ("allow", "disallow") and value:
                    groups[name].append((field == "allow", value))
                elif field == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                    delays[name] = max(delays.get(name, 0.0), float(value))
    name = agent.lower() if agent.lower() in groups else "*"
    hits = [(len(rule.replace("*", "").removesuffix("$")), allow, rule) for allow, rule in groups.get(name, []) if _robots_pattern(rule).match(path)]
    best = max(hits, default=(0, True, None))
    return best[1], best[2], delays.get(name)


def robots_decisions(df: DataFrame, id_col: str, status_col: str, body_col: str, path_col: str, agent: str, most: int = 512_000) -> DataFrame:
    """(``id_col``, allowed, reason, rule, crawl_delay): 401 and 403 deny, other 4xx allow, other failures deny,
    and so does a body of more than ``most`` bytes."""
    schema = T.StructType([df.schema[id_col]]).add("allowed", "boolean").add("reason", "string").add("rule", "string").add("crawl_delay", "double")

    def rows(status, body, path):
        if status in (401, 403):
            return [(False, "robots_access_denied", None, None)]
        if status is not None and 400 <= status < 500:
            return [(True, "robots_unavailable_allow", None, None)]
        if status is None or not 200 <= status < 300:
            return [(False, "robots_unreachable", None, None)]
        if len((body or "").encode("utf-8", "replace")) > most:
            return [(False, "robots_too_large", None, None)]
        allowed, rule, delay = robots_decision(body, path or "/", agent)
        return [(allowed, "robots_rule" if rule else "robots_no_rule", rule, delay)]

    return _mapped(df, [id_col, status_col, body_col, path_col], schema, rows)


def with_digest(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("sha256", F.sha2(text_col, 256))
