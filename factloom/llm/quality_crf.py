"""Quality rules: counts of a text, and a linear-chain conditional random field over its lines.

Viterbi decoding marks each line as content or boilerplate; the share of content characters
decides whether the text is kept. The field is fitted on the driver from a bounded sample of
labelled documents, whose line features Spark extracts: line labels start as the document's
label, and are decoded anew in rejected documents after each round of fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, id_type, map_batches

#: Bound of the labelled sample that the field is fitted on: documents, and lines of a document that may be in it.
SAMPLE, LINES = 3000, 2000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
CONTENT_SHARE = 0.5

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _END, _STOP = b"0123456789", b".!?;:", b".,;:!?"


def _level(share: float) -> int:
    return 0 if share <= 0 else 1 if share < 0.02 else 2 if share < 0.08 else 3 if share < 0.3 else 4


#: (first index, number of values) of each group of line features; one value of each group holds.
_GROUPS = {"words": 6, "symbols": 5, "upper": 5, "digits": 5, "bang": 5, "end": 3, "dup": 2, "mean": 4, "distinct": 3, "url": 2}
FEATURES = sum(_GROUPS.values())
_BASE = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()])[:-1].tolist(), strict=True))


def line_features(line: bytes, words: list[bytes], seen: bool) -> list[int]:
    """Indices of the features that hold for a line with at least one word."""
    n, w = len(line), len(words)
    upper = n - len(line.translate(None, _UPPER))
    letters = upper + n - len(line.translate(None, _LOWER))
    mean = (n - w + 1) / w
    last = words[-1][-1:]
    return [
        _BASE["words"] + (0 if w <= 2 else 1 if w <= 5 else 2 if w <= 12 else 3 if w <= 30 else 4 if w <= 80 else 5),
        _BASE["symbols"] + _level((n - len(line.translate(None, SYMBOLS))) / n),
        _BASE["upper"] + _level(0 if not letters else upper / letters if upper / letters > 0.3 else 0.01),
        _BASE["digits"] + _level((n - len(line.translate(None, _DIGIT))) / n),
        _BASE["bang"] + _level(line.count(b"!") / n),
        _BASE["end"] + (0 if last in _END and last else 1 if last in b"#*$%&|<>" else 2),
        _BASE["dup"] + int(seen),
        _BASE["mean"] + (0 if mean < 3 else 1 if mean < 8 else 2 if mean < 14 else 3),
        _BASE["distinct"] + (0 if (d := len(set(words)) / w) < 0.5 else 1 if d < 0.8 else 2),
        _BASE["url"] + int(b"://" in line or b"www." in line),
    ]


@dataclass
class Field:
    """Linear-chain CRF with two states, 0 boilerplate and 1 content."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @classmethod
    def blank(cls) -> Field:
        return cls(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))

    def gradient(self, lines: np.ndarray, states: np.ndarray, grad: Field) -> float:
        """Adds the log likelihood's gradient for one document; returns the likelihood."""
        e = self.emit[lines].sum(axis=1)
        n = len(e)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = self.start + e[0]
        for t in range(1, n):
            a[t] = np.logaddexp(a[t - 1, 0] + self.move[0], a[t - 1, 1] + self.move[1]) + e[t]
        for t in range(n - 2, -1, -1):
            after = e[t + 1] + b[t + 1]
            b[t] = np.logaddexp(self.move[:, 0] + after[0], self.move[:, 1] + after[1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        p = np.exp(a + b - z)
        diff = -p
        diff[np.arange(n), states] += 1
        np.add.at(grad.emit, lines.ravel(), np.repeat(diff, lines.shape[1], axis=0))
        grad.start += diff[0]
        if n > 1:
            pair = np.exp(a[:-1, :, None] + self.move[None] + (e[1:] + b[1:])[:, None, :] - z)
            grad.move -= pair.sum(axis=0)
            np.add.at(grad.move, (states[:-1], states[1:]), 1)
        return float(self.start[states[0]] + e[np.arange(n), states].sum() + self.move[states[:-1], states[1:]].sum() - z)

    def viterbi(self, scores: list[list[float]]) -> list[int]:
        """The best state of each line, from its two emission scores."""
        (m00, m01), (m10, m11) = self.move.tolist()
        back, (v0, v1) = [], (self.start[0] + scores[0][0], self.start[1] + scores[0][1])
        for s0, s1 in scores[1:]:
            a0, b0, a1, b1 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
            back.append((a0 < b0, a1 < b1))
            v0, v1 = (b0 if a0 < b0 else a0) + s0, (b1 if a1 < b1 else a1) + s1
        state = int(v1 >= v0)
        out = [state]
        for pair in reversed(back):
            state = int(pair[state])
            out.append(state)
        return out[::-1]


def lines_of(text: str) -> tuple[list[list[int]], list[int]]:
    """Feature indices and characters of the text's lines that have a word."""
    found, sizes, seen = [], [], set()
    for line in text.split("\n"):
        raw = line.encode("utf-8", "replace")
        words = raw.split()
        if words:
            found.append(line_features(raw.strip(), words, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return found, sizes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, rounds: int = 3, epochs: int = 6) -> Field:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of the id, all their lines; documents
    of more than LINES lines are not fitted on. Without labels of both kinds every line counts as content."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    chosen = known.join(F.broadcast(bounded_ids(known, id_col, sample)), id_col)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).dropDuplicates([id_col]).where(F.size(F.split(F.col(text_col), "\n")) <= LINES)

    def make():
        def work(labels, texts):
            return labels, pa.array([np.array(lines_of(t)[0], np.int16).ravel() for t in texts], pa.list_(pa.int16()))

        return work

    rows = [
        (int(r.label), np.array(r.lines, dtype=np.int64).reshape(-1, len(_GROUPS)))
        for r in map_batches(texts, ["_label", text_col], make, "label int, lines array<smallint>").collect() if len(r.lines)
    ]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    model = Field.blank()
    if len({label for label, _ in rows}) < 2:
        model.start += [-1.0, 1.0]
        model.emit[:, 1] += 0.1
        return model
    rng, rate = np.random.default_rng(5), 0.3
    squares = Field(np.full_like(model.emit, 1e-6), np.full_like(model.move, 1e-6), np.full_like(model.start, 1e-6))
    states = [np.full(len(lines), label, dtype=np.int64) for label, lines in rows]
    for _ in range(rounds):
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                grad = Field.blank()
                for k in order[at : at + 64]:
                    model.gradient(rows[k][1], states[k], grad)
                for name in ("emit", "move", "start"):
                    g = getattr(grad, name) / 64 - 1e-4 * getattr(model, name)
                    getattr(squares, name)[...] += g * g
                    getattr(model, name)[...] += rate * g / np.sqrt(getattr(squares, name))
        for k, (label, lines) in enumerate(rows):
            if not label:
                decoded = np.array(model.viterbi(model.emit[lines].sum(axis=1).tolist()))
                states[k] = decoded if (decoded == 0).any() else np.zeros(len(lines), dtype=np.int64)
    return model


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur at least twice in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    # Equal hashes are checked word for word.
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), dtype=bool)
    for k in range(window):
        equal &= ids[left + k] == ids[right + k]
    if not equal.all():
        groups: dict[bytes, list[int]] = {}
        for i in np.unique(np.concatenate([left, right])).tolist():
            groups.setdefault(ids[i : i + window].tobytes(), []).append(i)
        starts = np.array([i for g in groups.values() if len(g) > 1 for i in g], dtype=np.int64)
    else:
        starts = np.unique(np.concatenate([left, right]))
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def judge(text: str | None, model: Field, emit: list[list[float]] | None = None, share: float = CONTENT_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup, scores, sizes = set(), 0, [], []
    e0, e1 = emit if emit is not None else (model.emit[:, 0].tolist(), model.emit[:, 1].tolist())
    for line in text.split("\n"):
        own = line.encode("utf-8", "replace")
        if not (w := own.split()):
            continue
        repeated = line in seen
        dup += repeated
        seen.add(line)
        at = line_features(own.strip(), w, repeated)
        scores.append((sum([e0[k] for k in at]), sum([e1[k] for k in at])))
        sizes.append(len(line))
    repeats = repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    content = 0.0
    if sizes:
        states = model.viterbi(scores)
        content = sum(s for s, x in zip(sizes, states, strict=True) if x) / sum(sizes)
    return n, chars, symbols, dup, repeats, failed, content, not failed and content >= share


def quality(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, content_share, kept.

    Null texts count as without words, and fail. Repeated rows and null ids are kept.
    """

    def make():
        emit = (model.emit[:, 0].tolist(), model.emit[:, 1].tolist())

        def work(ids, texts):
            made = [judge(t, model, emit, share) for t in texts]
            return ids, *([m[k] for m in made] for k in range(8))

        return work

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, {schema}")
