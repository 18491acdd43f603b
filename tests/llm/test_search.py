"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from factloom.llm import lexical_search as L

DOCS, ITEMS = "doc_id bigint, text string, score string", "item_id bigint, text string, rank string"
WORDS = ["the", "The", "café", "CAFÉ", "x1", "語", "zürich", "a", "b", "c", "needle", "hay"] + [f"w{k}" for k in range(60)]


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def by_hand(docs, items, best=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            score = 0
            for t in set(terms(text)) & set(c):
                m = 10 + 90 * c.total() * n_docs // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items):
    made = L.ranked(spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "x") for i in items], ITEMS))
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, made.collect()), key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(len(WORDS))], k=k))
    docs = [(k, pick(rng.choice([1, 5, 20, 200]))) for k in range(n)]
    docs += [(n + k, docs[0][1]) for k in range(30)]
    return docs, [(k, pick(rng.choice([1, 4, 15]))) for k in range(25)]


@pytest.mark.parametrize("leaf, width, block", [(64, 128, 8192), (1, 2, 50), (3, 1, 7)])
def test_against_all_scores(spark, monkeypatch, leaf, width, block):
    from factloom.llm import common

    for name, value in (("LEAF", leaf), ("WIDTH", width), ("BLOCK", block)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(common, "ARROW_ROWS", min(block, 1000))
    docs, items = corpus(250)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_queries_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(L, "TERMS", 40)
    docs, items = corpus(80)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 7)
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, "needle"), (4, "needle"), (4, "needle hay"), (None, "needle"), (5, "NEEDLE" * 3 + " needle " * 500), (6, "a_b-c"), (7, "語語 語　x")]
    items = [(1, "needle needle Needle"), (2, None), (3, "..."), (None, "hay"), (4, "absent"), (5, "b 語"), (5, "b 語")]
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_intervals_are_pruned(spark, monkeypatch):
    """Documents of low bounds are never scored."""
    import numpy as np

    lengths = np.concatenate([np.full(20, 5), np.full(5000, 400)])
    block = L._Block(np.arange(5020), lengths, np.zeros(5020, dtype=np.int32), np.ones(5020, dtype=np.int64), np.ones(5020, dtype=np.int64), np.array([500]), 5020, int(lengths.sum()))
    top, seen = L._Top(10), []
    monkeypatch.setattr(top, "add", lambda ids, scores, add=top.add: (seen.append(len(ids)), add(ids, scores)))
    block.search(np.array([0]), top)
    assert top.ids.tolist() == list(range(10)) and sum(seen) < 500


def test_sql(spark):
    docs, items = corpus(120)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(c.execute(L.ranked_sql()).fetchall(), key=repr) == by_hand(docs, items)
