"""Ranked lexical search with range-maximum tables and best-first document intervals.

Each document is read once into a row of the terms that some query asks for and how often it holds them. A task
makes blocks of such rows, in order of length: posting lists by term with their impacts, and over each
list a sparse table of range maxima. For a query, an interval of documents can score no more than the sum of its terms'
maxima in it. The intervals with the highest bounds are opened first: their document of greatest impact is scored
and splits the interval, and intervals whose bound is below the tenth score so far are never opened.
Intervals of at most LEAF documents are scored whole. Nothing is lost: every document is in some interval.
A task's ten best documents of each query meet those of other tasks, first in salted groups.

Queries are taken in blocks of TERMS terms, so that what each task knows of them stays bounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, map_batches, shared_dir, small_batches

BEST = 10
#: Documents in a block, and postings from which on a block is closed.
BLOCK, POSTINGS = 8192, 1 << 20
#: Documents that an interval is scored whole with, and intervals opened at a time.
LEAF, WIDTH = 64, 128
#: Terms of queries, repeats between queries included, that are searched in one pass over the index.
TERMS = 200_000
SALTS = 256
#: Characters of a text that are split at a time.
PIECE = 1 << 20

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = {k: k + 32 for k in range(65, 91)}


def lowered(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(_LOWER)


def term_counts(text: str | None) -> Counter:
    """Terms of a whole text, A-Z as they stand, and how often each occurs; null: none."""
    out: Counter = Counter()
    at, text = 0, text or ""
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        out.update(_TERM.findall(text, at, end))
        at = end
    return out


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row per query that has terms: its number, ``item_id`` and distinct terms."""

    def make():
        def work(ids, texts):
            return ids, [sorted({lowered(t) for t in term_counts(x)}) for x in texts]

        return work

    named = map_batches(items, [item_col, text_col], make, f"`{item_col}` {id_type(items, item_col)}, terms array<string>")
    return named.where(F.size("terms") > 0).select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"), "terms").checkpoint()


def index(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, n (terms with repeats), and the numbers and counts of the terms that are in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def make():
        known = shared.value

        def work(ids, texts):
            lengths, terms, counts = [], [], []
            for text in texts:
                found: dict[int, int] = {}
                raw = term_counts(text)
                for term, n in raw.items():
                    k = known.get(lowered(term))
                    if k is not None:
                        found[k] = found.get(k, 0) + n
                lengths.append(raw.total())
                terms.append(list(found))
                counts.append(list(found.values()))
            return ids, lengths, terms, counts

        return work

    made = map_batches(docs, [id_col, text_col], make, f"`{id_col}` {id_type(docs, id_col)}, n bigint, terms array<int>, counts array<bigint>")
    return made.select(F.col(id_col).cast("bigint").alias("doc_id"), "n", "terms", "counts").checkpoint()


class _Block:
    """Posting lists of one block with a sparse table of the place of the greatest impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((ids, lengths))
        self.ids, place = ids[order], np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], dtype=np.int64)
        owner = np.repeat(np.arange(len(ids)), sizes)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owner]))
        self.width = len(ids) + 1
        keys = terms.astype(np.int64) * self.width + place[owner]
        order = np.argsort(keys)
        self.keys, self.impact = keys[order], impact[order]
        self.docs = (self.keys % self.width).astype(np.int32)
        longest = int(np.unique(self.keys // self.width, return_counts=True)[1].max())
        level = np.arange(len(keys), dtype=np.int32)
        self.table = [level]
        for k in range(longest.bit_length() - 1):
            step = 1 << k
            other = level[step:]
            level = level.copy()
            level[:-step] = np.where(self.impact[level[:-step]] >= self.impact[other], level[:-step], other)
            self.table.append(level)
        self.table = np.stack(self.table)

    def bounds(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals with posting ranges (rows: intervals, columns: terms): the bound and the document of greatest impact."""
        size = end - start
        filled = size > 0
        k = np.frexp(np.maximum(size, 1))[1] - 1
        low = np.where(filled, start, 0)
        a, b = self.table[k, low], self.table[k, np.where(filled, end - (1 << k), 0)]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        value = np.where(filled, self.impact[best], 0)
        rows = np.arange(len(start))
        return value.sum(axis=1), self.docs[best[rows, value.argmax(axis=1)]]

    def whole(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents with postings in these ranges, and their scores."""
        start, size = start.ravel(), (end - start).ravel()
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        docs, back = np.unique(self.docs[at], return_inverse=True)
        scores = np.zeros(len(docs), dtype=np.int64)
        np.add.at(scores, back, self.impact[at])
        return docs, scores

    def search(self, terms: np.ndarray, top: _Top) -> None:
        base = terms.astype(np.int64) * self.width
        start, end = np.searchsorted(self.keys, base), np.searchsorted(self.keys, base + self.width - 1)
        held = end > start
        if not held.any():
            return
        base, start, end = base[held], start[None, held], end[None, held]
        low, high = np.array([0]), np.array([len(self.ids)])
        bound, split = self.bounds(start, end)
        while True:
            live = bound >= top.least
            if not live.any():
                return
            low, high, start, end, bound, split = (x[live] for x in (low, high, start, end, bound, split))
            first = np.argpartition(-bound, WIDTH)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
            rest = np.ones(len(bound), dtype=bool)
            rest[first] = False
            small = first[high[first] - low[first] <= LEAF]
            if len(small):
                docs, scores = self.whole(start[small], end[small])
                top.add(self.ids[docs], scores)
            large = first[high[first] - low[first] > LEAF]
            if len(large):
                at = np.searchsorted(self.keys, base + split[large, None])
                here = (at < end[large]) & (self.keys[np.minimum(at, len(self.keys) - 1)] == base + split[large, None])
                top.add(self.ids[split[large]], np.where(here, self.impact[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1))
                lows = np.concatenate([low[large], split[large] + 1])
                highs = np.concatenate([split[large], high[large]])
                starts, ends = np.concatenate([start[large], at + here]), np.concatenate([at, end[large]])
                bounds, splits = self.bounds(starts, ends)
            else:
                lows, highs, starts, ends, bounds, splits = (x[:0] for x in (low, high, start, end, bound, split))
            low, high, start, end, bound, split = (
                np.concatenate([x[rest], y]) for x, y in ((low, lows), (high, highs), (start, starts), (end, ends), (bound, bounds), (split, splits))
            )


class _Top:
    """The best documents of one query so far; ids of null documents stand as the largest number."""

    def __init__(self, best: int):
        self.best, self.least = best, 1
        self.ids, self.scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
        order = np.lexsort((ids, -scores))[: self.best]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.best:
            self.least = max(1, int(self.scores[-1]))


#: Stands for a null id inside a task: after all others in a tie.
_NO_ID = np.iinfo(np.int64).max


def searched(indexed: DataFrame, asked: list, numbers: dict[str, int], n_docs: int, n_terms: int, best: int) -> DataFrame:
    """(part, query, doc_id, score): for each task the best documents of each query."""
    holds = dict(indexed.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds.get(k, 0) + 1))) for k in range(len(numbers))], dtype=np.int64)
    shared = indexed.sparkSession.sparkContext.broadcast((weights, [(row.query, np.array([numbers[t] for t in row.terms])) for row in asked]))

    def run(batches):
        weights, queries = shared.value
        tops = {q: _Top(best) for q, _ in queries}
        held, rows, postings = [], 0, 0

        def close():
            ids, lengths, terms, counts, sizes = (np.concatenate([h[k] for h in held]) for k in range(5))
            block = _Block(ids, lengths, terms, counts, sizes, weights, n_docs, n_terms)
            for q, wanted in queries:
                block.search(wanted, tops[q])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            terms, counts = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            held.append((ids, batch.column(1).to_numpy(), terms, counts, batch.column(2).value_lengths().to_numpy()))
            rows, postings = rows + len(ids), postings + len(terms)
            if rows >= BLOCK or postings >= POSTINGS:
                close()
                held, rows, postings = [], 0, 0
        if held:
            close()
        part = TaskContext.get().partitionId()
        for q, top in tops.items():
            if len(top.ids):
                ids = pa.array(top.ids, mask=top.ids == _NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids)), pa.array([q] * len(ids)), ids, pa.array(top.scores)], names=["part", "query", "doc_id", "score"])

    return indexed.where(F.size("terms") > 0).mapInArrow(run, "part bigint, query bigint, doc_id bigint, score bigint")


def ranked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", best: int = BEST
) -> DataFrame:
    """For each row of ``items`` its ``best`` documents: item_id, rank, doc_id and score.

    Null texts hold no term; queries without a term, and documents that share none with a query, give no rows. Each row is a
    document, or a query, of its own, repeated ids too. Documents with a null id come last among equal scores.
    Empty tables give an empty result; other columns are ignored. Ids of documents are whole numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared_dir(spark)
    queries = query_terms(items, item_col, item_text_col)
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / TERMS))
    dealt = queries.withColumn("pass", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    found = []
    for k in range(blocks):
        asked = dealt.where(F.col("pass") == k).select("query", "terms").collect()  # about TERMS terms
        numbers = {t: n for n, t in enumerate(sorted({t for row in asked for t in row.terms}))}
        indexed = index(docs, list(numbers), id_col, text_col)
        n_docs, n_terms = indexed.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if n_docs and asked:
            found.append(searched(indexed, asked, numbers, n_docs, n_terms, best).checkpoint())
    if not found:
        empty = f"item_id {id_type(items, item_col)}, rank int, doc_id bigint, score bigint"
        return spark.createDataFrame([], empty)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("query", "salt").orderBy(*order)
    last = Window.partitionBy("query").orderBy(*order)
    gathered = reduce(DataFrame.unionByName, found).withColumn("salt", F.col("part") % SALTS)
    top = gathered.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= best).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= best)
    return top.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def ranked_sql(best: int = BEST) -> str:
    """DuckDB SQL for the rows of ``ranked`` over ``documents`` and ``benchmark``: every shared term is scored."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all({lower.format("text")}, '{term}')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
m AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM size, total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lower.format("text")}, '{term}')) AS term FROM benchmark WHERE text IS NOT NULL),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total WHERE term IN (SELECT term FROM asked)),
scored AS (
  SELECT a.item_id, t.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
  FROM asked a JOIN weight w ON w.term = a.term JOIN tf t ON t.term = a.term JOIN m ON m.doc_id = t.doc_id GROUP BY a.item_id, t.doc_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ordered WHERE rank <= {best}"""
