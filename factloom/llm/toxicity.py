"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms and accents, homoglyphs of other alphabets, and
digits or signs that stand for letters. The lexicon holds whole words and word beginnings; its
entries come from labelled documents (counted by Spark), their weights from a sparse logistic
regression on a bounded sample. Matches inside an exception phrase don't count. A text's weight
is normalised by its length before the logistic link.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, crc32_mod, id_type, map_batches, slices
from .linear import Ftrl

#: Bound of the labelled sample that the lexicon and its weights are fitted on (rows).
SAMPLE = 24_000
#: Bound of the model: entries of the lexicon.
ENTRIES = 4_000
PREFIXES = range(4, 11)
THRESHOLD = 0.3

# Letters of other alphabets that look like Latin ones, and signs used for letters.
HOMOGLYPHS = dict(zip("абвгеёзіійкмнорстухшьѕјԁɡαβεηικμνορτυχωı", "abbreezіijkmhopctyxwbsjdgabenikuvoptuxwi", strict=True)) | {"і": "i"}
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i"}

#: Harmless phrases (folded) whose words don't count.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "trash collection", "sore loser", "weight loser", "pond scum", "idiot proof", "stupid simple")

_SIGN = regex.compile(r"[@$!](?=[^\W_])")


class _Fold(dict):
    def __missing__(self, code: int):
        c = chr(code)
        if unicodedata.combining(c):
            to = None
        else:
            to = HOMOGLYPHS.get(c, DIGITS.get(c, c if c.isalnum() else " "))
        self[code] = to
        return to


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded text with single spaces around every word; at least one space."""
    text = text if text.isascii() else unicodedata.normalize("NFKD", text)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return " " + " ".join(text.lower().translate(_FOLD).split()) + " "


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a folded word supports: itself and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in PREFIXES if k <= len(word))]


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the link; ``entries`` is bounded by ENTRIES."""

    entries: list[str]
    weights: np.ndarray
    bias: float
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for k, entry in enumerate(self.entries):
                self._machine.add_word(entry, (k, len(entry)))
            for phrase in self.exceptions:
                if (text := f" {phrase} ") not in self._machine:
                    self._machine.add_word(text, (-1, len(text)))
            self._machine.make_automaton()
        return self._machine

    def matches(self, folded: str) -> Counter:
        """Entry index -> number of matches outside exception phrases."""
        found = list(self.machine().iter(folded)) if len(self.machine()) else []
        if not found:
            return Counter()
        free = sorted((end - n + 1, end) for end, (k, n) in found if k < 0)
        starts, reach = [a for a, _ in free], [-1, *accumulate((b for _, b in free), max)]
        # Inside a phrase: of the phrases that begin no later, one reaches as far.
        return Counter(k for end, (k, n) in found if k >= 0 and reach[bisect_right(starts, end - n + 1)] < end)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        folded = fold(text or "")
        return normalised(self.matches(folded), folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        at, x = self.features(text)
        return float(1 / (1 + np.exp(-(self.bias + x @ self.weights[at]))))


def normalised(found: Counter, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Damped counts over a length that grows with the logarithm of the words."""
    at = np.array(sorted(found), dtype=np.int64)
    counts = np.array([found[k] for k in at.tolist()], dtype=np.float64)
    return at, np.log1p(counts) / (1 + 0.15 * np.log1p(max(0, words) / 100))


def _supported(sample: DataFrame, text_col: str, label_col: str, only: frozenset | None) -> DataFrame:
    """(entry, pos, neg): in how many texts of each label an entry occurs; counted per task first."""

    def run(batches):
        pos, neg = Counter(), Counter()
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = {e for w in set(fold(text or "").split()) for e in entries_of(w)}
                (pos if label else neg).update(own if only is None else own & only)
        names = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([pos[k] for k in names], pa.int64()), pa.array([neg[k] for k in names], pa.int64())], names=["entry", "pos", "neg"]
        )

    return sample.select(text_col, label_col).mapInArrow(run, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, entries: int = ENTRIES) -> Lexicon:
    """Learn the lexicon from at most ``sample`` labelled documents, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    chosen = known.join(F.broadcast(bounded_ids(known, id_col, sample)), id_col)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(text_col).agg(F.max("_label").alias("_label")).persist()
    try:
        sizes = {r._label: r.n for r in texts.groupBy("_label").agg(F.count("*").alias("n")).collect()}
        n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
        if not n_pos or not n_neg:
            return Lexicon([], np.zeros(0), float(np.log((n_pos + 0.5) / (n_neg + 0.5))))
        least = max(3, round(0.004 * n_pos))
        toxic = _supported(texts.where("_label = 1"), text_col, "_label", None).where(F.col("pos") >= least)
        # At most (entries of all sampled positive texts) / least rows.
        names = frozenset(r.entry for r in toxic.select("entry").toLocalIterator())
        rate = n_pos / (n_pos + n_neg)
        share = F.col("pos") / (F.col("pos") + F.col("neg"))
        ratio = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        strong = (
            _supported(texts, text_col, "_label", names).where((F.col("pos") >= least) & (share > min(0.9, 3 * rate)))
            .select("entry", (F.col("pos") * ratio).alias("gain"), "pos", "neg").orderBy(F.desc("gain"), "entry").limit(entries)
        )
        chosen_entries = [r.entry for r in strong.collect()]
        lexicon = Lexicon(chosen_entries, np.zeros(len(chosen_entries)), 0.0)
        shared = docs.sparkSession.sparkContext.broadcast(lexicon)

        def make():
            lexicon = shared.value

            def work(labels, texts):
                made = [lexicon.features(t) for t in texts]
                return labels, [a.tolist() for a, _ in made], [x.tolist() for _, x in made]

            return work

        rows, target = [], []
        for r in map_batches(texts, ["_label", text_col], make, "label int, at array<int>, x array<double>").collect():
            target.append(r.label)
            rows.append((np.array(r.at, dtype=np.int64), np.array(r.x)))
    finally:
        texts.unpersist()
    order = sorted(range(len(rows)), key=lambda k: (target[k], rows[k][0].tobytes(), rows[k][1].tobytes()))
    rows, target = [rows[k] for k in order], np.array([target[k] for k in order])
    model = Ftrl(max(1, len(chosen_entries)), 2, alpha=0.3, l1=1.0, l2=0.02).fit(rows, target, epochs=6)
    w = model.weights()
    lexicon.weights, lexicon.bias = w[: len(chosen_entries), 1] - w[: len(chosen_entries), 0], float(model.bias[1] - model.bias[0])
    keep = np.flatnonzero(lexicon.weights)
    return Lexicon([chosen_entries[k] for k in keep], lexicon.weights[keep], lexicon.bias)


def scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, ``score`` (0 to 1), ``predicted`` (1 where score >= threshold).

    Null and empty texts get the score of a text without matches. Repeated rows and null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(lexicon.entries, lexicon.weights, lexicon.bias, lexicon.exceptions))

    def make():
        lexicon = shared.value
        return lambda ids, texts: (ids, [lexicon.score(t) for t in texts])

    scored = map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, modulo 4, is 2 (a null id isn't held out)."""
    return F.coalesce(crc32_mod(id_col, 4) == 2, F.lit(False))
