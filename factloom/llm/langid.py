"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is fitted on the driver from a bounded sample of labelled rows whose features
Spark extracts; prediction runs over every whole text inside tasks. A feature's value is its
share of the text's n-grams times its inverse document frequency, so a text's logits are a
sum over its n-grams and long texts are read in pieces of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, id_type, map_batches
from .linear import Ftrl, softmax, temperature

#: Bound of the labelled sample that the classifier is fitted on (rows).
SAMPLE = 6000
BITS = 18
ORDERS = (1, 2, 3)
#: Share of the sample kept out of the fit for the temperature.
CALIBRATION = 0.2
SCALE = 30.0
UNKNOWN = "und"
#: Characters read at a time.
PIECE = 1 << 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; beyond the table all count as letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x30000)), dtype=bool, count=0x30000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(low: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Code points; a run of other characters becomes one boundary. ``after_letter`` says what came before, and comes back."""
    points = np.frombuffer(low.encode("utf-32-le", "replace"), dtype="<u4")
    table = _letters()
    letter = table[np.minimum(points, len(table) - 1)]
    codes = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if after_letter and len(keep):
        keep[0] = True
    return codes[keep], bool(letter[-1]) if len(letter) else after_letter


def ngram_buckets(text: str, piece: int = PIECE):
    """Hash buckets of the n-grams of the lower-case text between two boundaries, piece by piece: what
    comes over a seam is carried on, so pieces of any size give the same n-grams."""
    low, carried, after_letter = text.lower(), np.array([32], np.uint64), False
    fresh = 1  # codes at the end of ``carried`` that no n-gram has ended on
    for at in range(0, max(1, len(low)), piece):
        codes, after_letter = _codes(low[at : at + piece], after_letter)
        codes = np.concatenate([carried, codes, np.array([32] * (at + piece >= len(low)), np.uint64)])
        old = len(carried) - fresh
        for n in ORDERS:
            part = codes[max(0, old - n + 1) :]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(64 - BITS)).astype(np.int64)
        carried, fresh = codes[-(max(ORDERS) - 1) :], 0


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text."""
    parts = list(ngram_buckets(text))
    at, counts = np.unique(np.concatenate(parts), return_counts=True)
    return at, counts / counts.sum()


@dataclass
class LanguageModel:
    """``table``: idf times weight per bucket and language (float32), at most 2^18 rows."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); a null text or one without a letter: ("und", 0)."""
        if text is None or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for at in ngram_buckets(text):
            total += self.table.take(at, axis=0).sum(axis=0, dtype=np.float64)
            n += len(at)
        p = softmax((SCALE * total / n + self.bias) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most ``sample`` rows with a text and a label, chosen by a hash of the id."""
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, label_col)
    chosen = usable.join(F.broadcast(bounded_ids(usable, id_col, sample)), id_col).dropDuplicates([id_col])

    def make():
        def work(labels, texts):
            made = [features(t) if has_letter(t) else (np.empty(0, np.int64), np.empty(0)) for t in texts]
            return labels, pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([s.astype(np.float32) for _, s in made], pa.list_(pa.float32()))

        return work

    found = map_batches(chosen.withColumn(label_col, F.col(label_col).cast("string")), [label_col, text_col], make, "label string, at array<int>, share array<float>")
    rows, labels = [], []
    for row in found.where(F.size("at") > 0).toArrow().to_batches():
        for label, at, share in zip(*(row.column(i) for i in range(3)), strict=True):
            labels.append(label.as_py())
            rows.append((at.values.to_numpy(), share.values.to_numpy()))
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    # A fixed order, whatever order the rows arrived in.
    order = sorted(range(len(rows)), key=lambda k: (labels[k], len(rows[k][0]), rows[k][0].tobytes(), rows[k][1].tobytes()))
    rows, labels = [rows[k] for k in order], [labels[k] for k in order]
    target = np.array([languages.index(x) for x in labels])
    seen = np.zeros(1 << BITS)
    for at, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    rows = [(at, SCALE * share * idf[at]) for at, share in rows]
    held = np.random.default_rng(11).random(len(rows)) < CALIBRATION if len(rows) >= 50 else np.zeros(len(rows), bool)
    model = Ftrl(1 << BITS, len(languages)).fit([r for r, h in zip(rows, held, strict=True) if not h], target[~held])
    w = model.weights()
    logits = np.array([x @ w[at] + model.bias for (at, x), h in zip(rows, held, strict=True) if h]).reshape(-1, len(languages))
    return LanguageModel(languages, (w * idf[:, None]).astype(np.float32), model.bias, temperature(logits, target[held]))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score`` (0 to 1).

    Null texts and texts without a letter: "und" and 0. Repeated rows and null ids are kept.
    The broadcast model is bounded by 2^18 buckets for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(ids, texts):
            made = [model.predict(t) for t in texts]
            return ids, [a for a, _ in made], [b for _, b in made]

        return work

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that language identification rejects: no letter in the text (or
    no text), or a score under ``least``. All columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(texts):
        model = shared.value
        return pa.array([(found := model.predict(t.as_py()))[0] != UNKNOWN and found[1] >= least for t in texts], pa.bool_())

    return docs.where(keep(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train: crc32 of the id as text, modulo 3, is 1 (a null id isn't held out)."""
    from .common import crc32_mod

    return F.coalesce(crc32_mod(id_col, 3) == 1, F.lit(False))
