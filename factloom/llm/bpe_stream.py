"""Streaming BPE encoding with bounded lookahead, and incremental decoding.

Encoding. A merge decision can depend on symbols to its right only through a
chain of earlier-ranked merges that compete for the same tokens. ``lookahead``
bounds the length of every such chain from the merge list alone, in one pass in
rank order. So a boundary that has that many symbols behind it can't change any
more: the transducer keeps a window of bounded size, merges inside it, emits the
tokens whose end is stable, and goes on from the last stable boundary (nothing
crosses a final boundary, so what follows it merges on its own).

Decoding. Tokens are turned into text one at a time by a state machine that
holds at most an incomplete character and whether anything came before.

A text is read in pieces that end before white space, and a word longer than a
piece in stretches of symbols; ids and decoded text leave as they are made, into
running hashes. So beside the text itself memory doesn't grow with its length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_type, map_batches
from .token_counts import _tokenizer, byte_symbols, settled

#: Entries of a worker's cache of words (one older cache of that size is kept), and the longest word in it.
CACHE, CACHED = 1 << 16, 64
#: Characters of a piece of a text, and symbols of a long word fed at a time.
PIECE, STRETCH = 1 << 16, 1 << 12
_BREAK = re.compile(r"[ \n]").search


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols right of a boundary that settle it, whatever follows.

    For the merge of rank r with parts (u, v): until r is reached, the derivation of
    u+v can only be broken by an earlier merge (x, w) whose left part x is one of the
    derivation's tokens and ends at some boundary q at or after the end of u. Such a
    merge reaches at most ``reach`` symbols beyond q, so the reach of r is the largest
    offset(q) + reach(x, .), over those x, and at least the length of v.
    """
    parts: dict[str, tuple[str, str]] = {}
    size: dict[str, int] = {}
    best: dict[str, int] = {}  # by left part, over the ranks so far
    ends: dict[str, tuple[tuple[int, str], ...]] = {}  # (end offset, token) of a token's derivation
    most = 0

    def derivation(token: str) -> tuple[tuple[int, str], ...]:
        if (known := ends.get(token)) is None:
            if token in parts:
                a, b = parts[token]
                n = size[a]
                known = (*derivation(a), *((n + q, x) for q, x in derivation(b)), (size[token], token))
            else:
                size.setdefault(token, 1)
                known = ((1, token),)
            ends[token] = known
        return known

    for u, v in merges:
        left, right = derivation(u), derivation(v)
        n = size[u]
        reach = max(size[v], *(best.get(x, 0) for q, x in left if q == n), *(q + best.get(x, 0) for q, x in right))
        best[u] = max(best.get(u, 0), reach)
        most = max(most, reach)
        if (made := u + v) not in parts:
            parts[made], size[made] = (u, v), size[u] + size[v]
            ends.pop(made, None)
    return most


@dataclass
class Vocabulary:
    """What a tokenizer file says: ids, merge ranks, added tokens, end-of-word mark."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    added: dict[str, int]
    suffix: str
    reach: int

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(merges):
            ranks.setdefault(pair, k)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(model["vocab"], ranks, added, model.get("end_of_word_suffix") or "", lookahead(merges))

    def token(self, i: int) -> str:
        if not hasattr(self, "_names"):
            self._names = {v: k for k, v in {**self.ids, **self.added}.items()}
        return self._names[i]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """All merges inside ``symbols``: lowest rank first, leftmost first among equals."""
    word = list(symbols)
    if len(word) <= 64:
        none = len(ranks)
        get = ranks.get
        now = [get(p, none) for p in zip(word, word[1:])]
        while now:
            low = min(now)
            if low == none:
                break
            i = now.index(low)
            word[i : i + 2] = [word[i] + word[i + 1]]
            del now[i]
            if i:
                now[i - 1] = get((word[i - 1], word[i]), none)
            if i < len(now):
                now[i] = get((word[i], word[i + 1]), none)
        return word
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(word, word[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if word[i] != a or j >= n or word[j] != b:
            continue
        word[i], word[j] = a + b, ""
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (r := ranks.get((word[i], word[j]))) is not None:
                heapq.heappush(heap, (r, i, word[i], word[j]))
        if (h := before[i]) >= 0 and (r := ranks.get((word[h], word[i]))) is not None:
            heapq.heappush(heap, (r, h, word[h], word[i]))
    return [w for w in word if w]


class Transducer:
    """Feed symbols, get tokens as soon as they are stable; memory is bounded by the window."""

    def __init__(self, vocabulary: Vocabulary, reach: int | None = None):
        self.v, self.reach = vocabulary, vocabulary.reach if reach is None else reach
        self.window = 2 * self.reach + 256
        self.held: list[str] = []

    def feed(self, symbols) -> list[str]:
        """Tokens that no later symbol can change."""
        if len(self.held) + len(symbols) <= self.window:
            self.held += symbols
            return []
        out: list[str] = []
        for s in symbols:
            self.held.append(s)
            if len(self.held) > self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[str]:
        # The last symbol may yet become a word's end, so it counts as unknown.
        settled, at, out = len(self.held) - 1 - self.reach, 0, []
        for token in merged(self.held, self.v.ranks):
            width = len(token)
            if at + width > settled:
                break
            at += width
            out.append(token)
        del self.held[:at]
        return out

    def finish(self) -> list[str]:
        """The end of a word: the rest of its tokens."""
        if not self.held:
            return []
        if self.v.suffix:
            self.held[-1] += self.v.suffix
        out, self.held = merged(self.held, self.v.ranks), []
        return out


def normalized(text: str) -> str:
    """NFC and lower case, character by character. The file's replacement of white-space runs by
    one space is left out: the pre-tokenizer drops white space whatever it is."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    # str.lower() lowers a final sigma by its context; the tokenizer doesn't.
    return text.replace("Σ", "σ").lower()


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters that end before a space or a line's end."""
    at = 0
    while len(text) - at > size and (end := _BREAK(text, at + size)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; made by the transducer, kept while short."""

    #: The pre-tokenizer's pattern (a fixed value of the tokenizer file).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__()
        self.path, self.v = path, Vocabulary.load(path)
        self.words = regex.compile(self.PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.v.added, key=len, reverse=True)) + ")").split if self.v.added else None
        self.symbols = byte_symbols()
        self.machine = Transducer(self.v)
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.v.ids.items()}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = b"".join(self._stream(self._symbols(word)))
        if len(word) <= CACHED:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def _symbols(self, word: str) -> list[str]:
        # Printable ASCII characters stand for themselves in byte-level vocabularies.
        return list(word) if word.isascii() and word.isprintable() else [self.symbols[b] for b in word.encode("utf-8", "replace")]

    def _stream(self, symbols: list[str]) -> Iterator[bytes]:
        """Ids of a word's symbols as they become stable."""
        machine, packed = self.machine, self.packed
        for k in range(0, len(symbols), STRETCH):
            if out := machine.feed(symbols[k : k + STRETCH] if k or len(symbols) > STRETCH else symbols):
                yield b"".join([packed[t] for t in out])
        yield b"".join([packed[t] for t in machine.finish()])

    def _long(self, text: str) -> Iterator[list[bytes]]:
        """Ids of a piece that holds a very long word, word by word."""
        for found in regex.finditer(self.PATTERN, normalized(text)):
            if found.end() - found.start() <= STRETCH:
                yield [self[found.group()]]
                continue
            for k in range(found.start(), found.end(), STRETCH):
                symbols = self._symbols(found.string[k : min(k + STRETCH, found.end())])
                if out := self.machine.feed(symbols):
                    yield [self.packed[t] for t in out]
            yield [self.packed[t] for t in self.machine.finish()]

    def _ordinary(self, text: str) -> Iterator[list[bytes]]:
        if settled(text):
            if len(text) > 2 * PIECE:
                yield from self._long(text)
            else:
                yield list(map(self.__getitem__, self.words(normalized(text))))
            return
        own = _tokenizer(self.path)
        for piece, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text)):
            yield from ([x] for x in self._stream(list(piece)))

    def __call__(self, text: str) -> Iterator[list[bytes]]:
        """Ids of the whole text in lists of blocks, a block for each word, part of a long word, or added token."""
        for piece in pieces(text):
            if self.split is None or not any(s in piece for s in self.v.added):
                yield from self._ordinary(piece)
                continue
            for k, part in enumerate(self.split(piece)):
                if k % 2:
                    yield [self.v.added[part].to_bytes(4, "little")]
                else:
                    yield from self._ordinary(part)


class ByteText(dict):
    """Ids to the encoded text, in UTF-8: bytes pass through an incremental byte-to-text state machine.

    State: the bytes of an incomplete character, at most three, and whether anything came before. A word end
    becomes a space. Wrong bytes become replacement characters. The dict keeps the bytes of short blocks of ids.
    """

    #: What stands between two tokens.
    between = b""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.code = {c: b for b, c in enumerate(byte_symbols())}
        self.reset()

    def reset(self) -> None:
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def _bytes(self, i: int) -> bytes:
        name, suffix = self.v.token(i), self.v.suffix
        if name in self.v.added:
            return name.encode()
        ends = bool(suffix) and name.endswith(suffix)
        core = name[: -len(suffix)] if ends else name
        return bytes([self.code[c] for c in core]) + b" " * ends

    def __missing__(self, ids: bytes) -> bytes:
        raw = self.between.join([self._bytes(i) for i in np.frombuffer(ids, dtype="<u4").tolist()])
        if len(ids) <= 4 * CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[ids] = raw
        return raw

    def feed(self, blocks: list[bytes]) -> bytes:
        """Text of some blocks of ids, but for an incomplete character at the end; empty blocks add nothing."""
        raw = self.between.join(map(self.__getitem__, filter(None, blocks)))
        if raw and self.begun:
            raw = self.between + raw
        self.begun = self.begun or bool(raw)
        return self.state.decode(raw).encode()

    def finish(self) -> bytes:
        return self.state.decode(b"", True).encode()


class TokenText(ByteText):
    """The same machine for a file without a decoder: the bytes are those of the tokens' own strings, joined by spaces."""

    between = b" "

    def _bytes(self, i: int) -> bytes:
        return self.v.token(i).encode()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (array of int), ``n_tokens``.

    No begin or end tokens are added; added tokens' strings in a text become those tokens.
    Null and empty texts give an empty array. Repeated rows and null ids are kept.
    """

    def make():
        words = WordEncoder(tokenizer)

        def work(ids, texts):
            blocks = [b"".join(chain.from_iterable(words(t or ""))) for t in texts]
            lists = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in blocks]
            return ids, pa.array(lists, pa.list_(pa.int32())), [len(x) for x in lists]

        return work

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, ids array<int>, n_tokens bigint")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids", as_tokens: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``text``. Null or empty ids give an empty text.

    By default the encoded text (normalised, a space after each word's end); with
    ``as_tokens`` what the library's decode() gives for a file that names no decoder.
    """

    def make():
        v = Vocabulary.load(tokenizer)
        machine = TokenText(v) if as_tokens else ByteText(v)

        def one(x):
            machine.reset()
            block = np.array(x or [], dtype="<u4")
            text = b"".join([machine.feed([block[k : k + 64].tobytes()]) for k in range(0, len(block), 64)])
            return (text + machine.finish()).decode()

        return lambda ids, lists: (ids, [one(x) for x in lists])

    return map_batches(encoded, [id_col, ids_col], make, f"`{id_col}` {id_type(encoded, id_col)}, text string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text in one pass and return digests of both (and ``ids``, if asked for).

    ``id_col``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers)
    and ``decoded_sha256`` (UTF-8 of the decoded token text, as the file names no decoder).
    Null text: as an empty one.
    """

    def make():
        words = WordEncoder(tokenizer)
        back = TokenText(words.v)

        def work(ids, texts):
            n, enc, dec, lists = [], [], [], []
            for t in texts:
                back.reset()
                made, decoded, size, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for blocks in words(t or ""):
                    raw = b"".join(blocks)
                    size += len(raw)
                    made.update(raw)
                    decoded.update(back.feed(blocks))
                    if with_ids:
                        kept.append(raw)
                decoded.update(back.finish())
                n.append(size // 4)
                enc.append(made.hexdigest())
                dec.append(decoded.hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(b"".join(kept), dtype="<u4").astype(np.int32))
            return (ids, n, enc, dec, *([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []))

        return work

    schema = f"`{id_col}` {id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs, [id_col, text_col], make, schema)
