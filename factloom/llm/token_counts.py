"""Token counts by a map-side two-tier lookup.

First pass: every task summarises its pre-tokens in a bounded heavy-hitter
summary, and the summaries (never the pre-tokens) are merged in a tree. The
result, at most ``TABLE`` entries, is broadcast as a compact table of lengths.
Second pass: a task counts a text's tokens by looking each pre-token up in that
table; misses go through the worker's own cache and are encoded on a miss there.
The table only decides what is looked up first; counts are exact without it.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_batches, slices

#: The byte-level pre-tokenizer's pattern (a fixed value of the tokenizer file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the broadcast table, and the longest pre-token (characters) in it: a few MB at most.
TABLE, LONGEST = 1 << 15, 48
#: Entries of a worker's own cache; it starts anew when full. Longer pre-tokens aren't cached.
CACHE, CACHED = 1 << 18, 96
#: Entries of a task's running summary and of what it hands on.
RUNNING, SUMMARY = 1 << 17, 1 << 13
FAN_IN = 64
#: Outside these ranges Unicode versions differ on what a letter is; texts with such
#: characters are split by the tokenizer file's own pre-tokenizer.
SETTLED = "\\x00-\u0530\u0590-\u088e\u0900-\u0c5b\u0e00-\u1c88\u1c8a-\u208e\u20a0-\ua7ca\uac00-\uffff\U0001f000-\U0001faff\U00020000-\U0002a6df"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_UNSETTLED = regex.compile(f"[^{SETTLED}]").search


def settled(text: str) -> bool:
    return text.isascii() or _UNSETTLED(text) is None


class Pretokenizer:
    """Splits text as the byte-level pre-tokenizer does; added tokens in the text stand alone."""

    def __init__(self, specials: list[str]):
        self.find = regex.compile(PATTERN).findall
        self.specials = specials
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))).split if specials else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the ordinary text, and the number of added tokens in it."""
        if self.split is None or not any(s in text for s in self.specials):
            return self.find(text), 0
        parts = self.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1


class Lengths(dict):
    """Tier one is the dict itself (the broadcast table); a miss goes to the cache, then to the encoder."""

    def __init__(self, table, encode):
        super().__init__(table)
        self.encode, self.cache = encode, {}

    def __missing__(self, piece: str) -> int:
        found = self.cache.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(piece) <= CACHED:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = found
        return found


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials_of(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def piece_encoder(path: str):
    """Number of tokens of one pre-token, by the vocabulary's own merges."""
    model, table = _tokenizer(path).model, byte_symbols()
    return lambda piece: len(model.tokenize("".join([table[b] for b in piece.encode("utf-8", "replace")])))


def _kept(counts: Counter, n: int) -> Counter:
    """The ``n`` largest entries, each reduced by what the first dropped one had (a heavy-hitter summary)."""
    if len(counts) <= n:
        return counts
    ordered = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    less = ordered[n][1]
    return Counter({k: v - less for k, v in ordered[:n] if v > less})


def frequent(docs: DataFrame, specials: list[str], text_col: str = "text", entries: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """Frequent pre-tokens of all texts, most frequent first.

    Each task makes one summary of at most ``summary`` entries; groups of summaries are
    merged until ``FAN_IN`` or fewer are left, which the driver merges one by one.
    """

    def count(batches):
        pre, counts = Pretokenizer(specials), Counter()
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if text:
                    counts.update(pre(text)[0])
            if len(counts) > RUNNING:
                counts = _kept(counts, RUNNING // 2)
        short = Counter({k: v for k, v in counts.items() if len(k) <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(_kept(short, summary)))], pa.binary())], names=["summary"])

    def merge(batches):
        total = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total.update(pickle.loads(blob))
                total = _kept(total, 4 * summary)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(total))], pa.binary())], names=["summary"])

    made = docs.select(text_col).mapInArrow(count, "summary binary")
    n = docs.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        made = made.repartition(n).mapInArrow(merge, "summary binary")
    total = Counter()
    for row in made.collect():  # at most FAN_IN summaries of bounded size
        total.update(pickle.loads(row.summary))
        total = _kept(total, 4 * entries)
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level BPE file. Null and empty texts have 0 bytes and
    0 tokens. Repeated rows and null ids are kept. An added token's string inside a text counts
    as that one token, which is the library's default.
    """
    specials = specials_of(tokenizer)
    pieces = frequent(docs, specials, text_col, entries)
    encode = piece_encoder(tokenizer)
    # The table's size is bounded by entries * LONGEST characters.
    table = docs.sparkSession.sparkContext.broadcast((pieces, [encode(p) for p in pieces]))

    def make():
        frequent_pieces, lengths = table.value
        pre, own = Pretokenizer(specials), _tokenizer(tokenizer)
        look = Lengths(zip(frequent_pieces, lengths, strict=True), piece_encoder(tokenizer)).__getitem__

        def work(ids, texts):
            n_bytes, n_tokens = [], []
            for t in texts:
                t = t or ""
                n_bytes.append(len(t.encode()))
                if settled(t):
                    found, added = pre(t)
                    n_tokens.append(sum(map(look, found)) + added)
                else:
                    parts = pre.split(t) if pre.split else [t]
                    pieces = [x for part in parts for x, _ in own.pre_tokenizer.pre_tokenize_str(part)]
                    n_tokens.append(sum(len(own.model.tokenize(x)) for x in pieces) + len(parts) - 1)
            return ids, n_bytes, n_tokens

        return work

    counted = map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
