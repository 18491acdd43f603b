"""The conversation tree against a plain walk."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from factloom.llm import conversation_trie as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def by_hand(rows):
    own = defaultdict(list)
    sign = lambda r, t: hashlib.sha256((hashlib.sha256(r.encode()).hexdigest() + hashlib.sha256(t.encode()).hexdigest()).encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, sign(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) > len(n) and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


def found(spark, rows):
    made = C.prefix_trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, made.collect()), key=repr)


def rows_of(n, longest=7, words=("a", "bé", "", "long text")):
    return [(c, t, "user" if t % 2 == 0 else "assistant", words[zlib.crc32(f"{c // 7 if t < 3 else c % 3} {t}".encode()) % len(words)]) for c in range(n) for t in range(1 + c * 5 % longest)]


@pytest.mark.parametrize("n, longest", [(60, 7), (30, 13)])
def test_against_a_plain_walk(spark, n, longest):
    rows = rows_of(n, longest)
    assert found(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "a"), (0, None, "user", "first"), (0, 1, "user", "tie"), (0, 1, None, None), (1, 5, "user", "own"), (None, 1, "user", "nobody"), (3, None, None, None),
        (-3, 0, "user", "x"), (-7, 0, "user", "x"), (-7, 0, "user", "x"), (10, 0, "user", "y" * 3000), (11, 0, "user", "y" * 3000), (11, 9, "user", "z"), (22, 0, "u", "m"), (24, 2, "u", "n"),
    ]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "nobody")]) == []


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3)
    rows = rows_of(20) + [(2, t, "user", f"t{t % 11}") for t in range(8, 400)] + [(c, 0, "user", "same") for c in range(1000, 1300)]
    assert found(spark, rows) == by_hand(rows)


def test_sql(spark):
    rows = rows_of(40) + [(0, None, "user", "x"), (1, None, None, None), (None, 1, "u", "t")]
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(c.execute(C.prefix_trie_sql()).fetchall(), key=repr) == by_hand(rows)
