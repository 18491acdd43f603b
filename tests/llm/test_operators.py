"""Operators against brute force and edge cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe_stream, cdc_dedup, decontam, langid, linear, quality_crf, queries, secret_scan, simhash, token_counts, toxicity, url_templates

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t ", "a", "Z z", "the same text here again", "the same text here again", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ don't I'LL 12345 é é 日本語 😀😀",
    "x" * 40_000, "ab " * 9_000, "<|endoftext|> b<|startoftext|>c", "token = \"abcdefabcdefabcdefabcdefabcdef\"", "\x1c\x85  odd spaces", "﻿…!!!???",
    "abc \x00\x00 def \x00", "".join(map(chr, range(1, 300))), "\x00",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge rows with a null id, a repeated row, and extra columns whose names clash with results."""
    rows = [(k, t, "en", "s", float(k), "x", "y", k) for k, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None, None), (5, ODD[5], "en", "s", 1.0, "x", "y", 5)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double, fingerprint string, spans string, fp bigint")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# 1. Secret scans

def base_by_hand(text):
    text = text or ""
    found = []
    for kind, pattern in (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m.group(2)) >= 6, "access": lambda: len(m.group()) >= 20, "hex": lambda: len(m.group()) >= 24}[kind]():
                found.append((m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def test_secret_base_spans(docs, odd):
    for df in (docs, odd):
        texts = collected(df)
        for key, rows in collected(secret_scan.scan(df)).items():
            assert len(rows) == len(texts[key])
            by_hand = base_by_hand(texts[key][0].text)
            assert rows[0].base_sha256 == hashlib.sha256(",".join(by_hand).encode()).hexdigest()
            assert rows[0].n_hex == sum(x.startswith("hex") for x in by_hand)
            assert set(by_hand) <= set(rows[0].spans.split(","))


def test_guess_costs():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    assert cost("password") < 2 and cost("P4ssword") < 4
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4 and cost("2024-05-17") < 6
    assert cost("password2019") < cost("xqzvjwkb2019") < cost("xqzvjwkb7h3k")
    assert cost("kX9$vQ2!mZ7p") > 15
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(5000))
    assert cost(long, 8.0) >= 8.0


def cheapest_by_hand(value, ranks, start=0, single=None):
    """All segmentations from ``start`` on into all pieces, each priced by its own definition."""
    from math import inf, log10

    n, low, single = len(value), value.lower(), single or secret_scan._alphabet(value)
    plain = low.translate(secret_scan.LEET)
    ways = [[None] + [way(low[k - 1], low[k]) for k in range(1, n)] for way in secret_scan.WAYS]

    def cost(i, j):
        found = single if j == i + 1 else inf
        if j - i >= 3:
            found = min(found, secret_scan._word_cost(value[i:j], low[i:j], plain[i:j], ranks))
            for near in ways:
                if not all(near[i + 1 : j]):
                    continue
                a, e = i, j
                while a and near[a]:
                    a -= 1
                while e < n and near[e]:
                    e += 1
                turns = sum(near[k] != near[k - 1] for k in range(i + 2, j))
                found = min(found, log10(47) + log10(e - a) + turns * log10(4))
        if j - i >= 4 and low[j - 1].isdigit() and j - i <= secret_scan.DATE_MAX and secret_scan.DATE.fullmatch(low, i, j):
            found = min(found, log10(200) if j - i == 4 else log10(365 * 120 * 4))
        for p in range(1, i + 1):
            if j - i >= p and low[i - p : j - p] == low[i:j]:
                a, e = i - p, j
                while a and low[a - 1] == low[a - 1 + p]:
                    a -= 1
                while e < n and low[e] == low[e - p]:
                    e += 1
                found = min(found, log10(e - a))
        return found

    def least(i):
        return 0.0 if i == n else min(cost(i, j) + least(j) for j in range(i + 1, n + 1))

    return least(start)


def test_costs_of_all_ends_in_one_pass():
    rng = random.Random(8)
    ranks = secret_scan.Ranks(["love", "abc", "cat", "qwe", "password"])
    for _ in range(150):
        value = "".join(rng.choice(["love", "1", "a", "99", "qwe", "z", "ab", "c4t", "1999", "ABC", "cba", "fgh", "ü", "abab"]) for _ in range(rng.randrange(1, 5)))[:10]
        found = secret_scan.costs_to_go(value, 1.5, ranks)
        for k in range(len(value)):
            assert found[k] == pytest.approx(cheapest_by_hand(value, ranks, k, 1.5))


def test_long_runs_of_contexts_stay_linear():
    ranks = secret_scan.dictionary(WORD)
    for unit in ("password=", "login:", "token=aaaa;"):
        began = time.process_time()
        secret_scan.spans(unit * (60_000 // len(unit)), ranks=ranks)
        assert time.process_time() - began < 12, unit
    assert [k for *_, k in secret_scan.spans("login:" * 500 + "kX9v!Q2m#Z7pLw", ranks=ranks)] == ["guess"]


def test_addresses_are_no_secrets():
    for text in ("login: https://example.org/sign-in/Xy7kQpRt9", "Login: jane.doe+x9Kq2@mail.example.org"):
        assert secret_scan.spans(text) == []
    assert [k for *_, k in secret_scan.spans("login: https://jane:kX9vQ2mZ7pLw@example.org")] == ["guess"]
    assert [k for *_, k in secret_scan.spans("login: https://example.org/?session_token=kX9v!Q2mZ7pLw")] == ["guess"]


def test_guess_cost_is_the_cheapest_segmentation():
    """Against all segmentations of short values into all pieces, and with an early end against the full program."""
    rng = random.Random(3)
    ranks = secret_scan.Ranks(["love", "abc", "cat", "qwe", "password"])
    for _ in range(300):
        value = "".join(rng.choice(["love", "1", "a", "99", "qwe", "z", "ab", "c4t", "1999", "ABC", "cba", "fgh", "ü"]) for _ in range(rng.randrange(1, 5)))[:10]
        assert secret_scan.guess_cost(value, ranks=ranks) == pytest.approx(cheapest_by_hand(value, ranks))
    for _ in range(300):
        unit = "".join(rng.choice("ab1xyz$Q") for _ in range(rng.randrange(1, 60)))
        value = "".join(rng.choice([unit, unit[:7], "password", "qwertyuiop"]) for _ in range(rng.randrange(1, 9)))
        whole, early = secret_scan.guess_cost(value, ranks=ranks), secret_scan.guess_cost(value, 8.0, ranks)
        assert early == whole or (whole >= early >= 8.0)


def test_repeats_and_walks_of_any_length():
    cost = secret_scan.guess_cost
    assert cost("a" * 200) < 4 and cost("a" * 300_000) < 8 and cost("password1" * 5) < 6 and cost("x7$kQ" * 4) < 11.5
    assert cost("password1x" * 40) < 7.5 and cost("qwertyuiop" * 3 + "q") < 5 and cost("abcdefghijklmnopqrstuvwxyz" * 9) < 6
    rng = random.Random(9)
    for _ in range(200):
        value = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 24)))
        by_hand = set()
        for p in range(1, len(value)):
            for a in range(len(value)):
                e = a + p
                while e < len(value) and value[e] == value[e - p]:
                    e += 1
                if e - a >= 2 * p and (a == 0 or value[a - 1] != value[a - 1 + p]):
                    by_hand.add((a, e))
        found = secret_scan.repeats(value)
        assert {(a, e) for a, e, _ in found} == by_hand
        assert all(value[a:e] == (value[a : a + p] * (e - a))[: e - a] for a, e, p in found)


def test_prose_is_no_secret():
    ranks = secret_scan.dictionary(WORD)
    for text in (
        "The password is incorrect.", "the token is required here", "bearer certificates are", "my secret is ingredients", "login: required", "the passphrase is user-defined", "credentials: incorrect",
        "passphrase is Wrzlbrmpft", "auth: certificate",
    ):
        assert secret_scan.spans(text, ranks=ranks) == [], text
    assert [k for _, _, k in secret_scan.spans("the passphrase is kX9vQ2mZ7pLw", ranks=ranks)] == ["guess"]


def test_context_values():
    found = secret_scan.spans("passphrase: kX9vQ2mZ7pLw and bearer zP4tR8wQ1nM6xY3v; pin = 123456 passwort is sunshine")
    assert [k for _, _, k in found] == ["guess", "guess"]
    assert secret_scan.masked("a password=hunter22 b") == "a [SECRET] b"
    assert secret_scan.masked("") == ""


@pytest.mark.parametrize("text,kinds,left", [
    ("a password = hunter22!kX$9q#Vw b", ["assign", "guess"], "a [SECRET] b"),
    ("password:     S3cr#t!9xQz", ["guess"], "[SECRET]"),
    ("passphrase \t=\t kX9vQ2mZ7pLw.", ["guess"], "[SECRET]."),
    ("login: password: kX9v!Q2m#Z7pLw", ["guess"], "login: [SECRET]"),
    ("token = 0123456789abcdef01234567", ["assign", "hex"], "[SECRET]"),
    ("password = hunter22!", ["assign"], "[SECRET]!"),
])
def test_costly_values_over_fixed_spans(text, kinds, left):
    assert [k for _, _, k in secret_scan.spans(text)] == kinds
    assert secret_scan.masked(text) == left


def test_every_context_value_is_costed(monkeypatch):
    seen, cost = [], secret_scan.guess_cost
    monkeypatch.setattr(secret_scan, "guess_cost", lambda v, *more: seen.append(v) or cost(v, *more))
    secret_scan.spans("token = 0123456789abcdef01234567 and password: S3cr#t!9xQz")
    assert seen == ["0123456789abcdef01234567", "S3cr#t!9xQz"]


# 2 and 7. Tokens

def test_bpe_matches_library(docs, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(WORD)
    for df in (docs, odd):
        texts = collected(df)
        for key, rows in collected(bpe_stream.digests(df, WORD)).items():
            ids = own.encode(texts[key][0].text or "", add_special_tokens=False).ids
            assert rows[0].n_tokens == len(ids)
            assert rows[0].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert rows[0].decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_stream.digests(none, WORD).count() == 0


def test_long_words_and_pieces(monkeypatch):
    """Texts in small pieces, and words far longer than a stretch, against the library; nothing is held beyond the window."""
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(WORD)
    monkeypatch.setattr(bpe_stream, "PIECE", 50)
    monkeypatch.setattr(bpe_stream, "STRETCH", 40)
    monkeypatch.setattr(bpe_stream.pieces, "__defaults__", (50,))
    rng = random.Random(23)
    words = bpe_stream.WordEncoder(WORD)
    back = bpe_stream.TokenText(words.v)
    for text in [t or "" for t in ODD] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(30_000)), "日本語" * 4000 + " x", "é " * 300, "a" * 9000 + " <|endoftext|>" + "b" * 9000]:
        ids, decoded, longest = [], b"", 0
        back.reset()
        for blocks in words(text):
            ids += np.frombuffer(b"".join(blocks), dtype="<u4").tolist()
            decoded += back.feed(blocks)
            longest = max(longest, len(blocks), len(words.machine.held))
        expected = own.encode(text, add_special_tokens=False).ids
        assert ids == expected
        assert decoded.decode() == own.decode(expected, skip_special_tokens=False)
        assert longest <= words.machine.window + 41


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(1, "Hello  Wörld 😀, it's 42"), (2, None), (3, "")], "doc_id int, text string")
    back = {r.doc_id: r.text for r in bpe_stream.decode(bpe_stream.encode(df, WORD), WORD).collect()}
    assert back == {1: "hello wörld 😀, it 's 4 2 ", 2: "", 3: ""}


def test_lookahead_is_enough():
    """A transducer with the computed lookahead gives the tokens of the whole text, on small merge lists and the real one."""
    rng = random.Random(5)
    for _ in range(60):
        symbols, merges = list("abc"), []
        for _ in range(rng.randrange(3, 14)):
            pair = (rng.choice(symbols), rng.choice(symbols))
            if pair not in merges:
                merges.append(pair)
                symbols.append("".join(pair))
        ranks = {p: k for k, p in enumerate(merges)}
        v = bpe_stream.Vocabulary({}, ranks, {}, "", bpe_stream.lookahead(merges))
        for _ in range(6):
            text = [rng.choice("abc") for _ in range(rng.randrange(1, 400))]
            t = bpe_stream.Transducer(v)
            t.window = v.reach + max(map(len, symbols)) + 2
            out = []
            for c in text:
                out += t.feed([c])
            assert len(t.held) <= t.window + 1
            assert out + t.finish() == bpe_stream.merged(text, ranks)


def test_token_counts_match_library(docs, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(BYTE)
    for df, entries in ((docs, 500), (odd, 10)):
        texts = collected(df)
        for key, rows in collected(token_counts.token_counts(df, BYTE, entries=entries)).items():
            text = texts[key][0].text or ""
            assert (rows[0].n_bytes, rows[0].n_tokens) == (len(text.encode()), len(own.encode(text, add_special_tokens=False).ids))
            assert rows[0].over_limit == (rows[0].n_tokens > 1024)
    assert token_counts.token_counts(none, BYTE).count() == 0


# 3. URL filters

def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "https://A.Example.ORG/es/9?x", "http://example.org/en/17#t", "http://example.org/en/2", "https://com/fr/", "https://m.shop.com/de/4", "https://com.net/de/4",
        "http://org", "http://x.org:80/", "ftp://u@org/p", "http://?q", "https://notexample.org/es/1",
    ]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judged(df).collect()}
    assert len(got) == len(urls)
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/es/9", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][2] is None and got[9][:3] == ("org", "", None) and got[10][:3] == ("x.org:80", "/", None)
    assert got[11][:3] == ("u@org", "/p", None) and got[12][:3] == ("", "", None) and got[13][2] == "org/"


def test_templates_learn_from_labels(spark):
    rows = [(k, f"https://a.test/{'bad' if k % 2 else 'good'}/{k}/x") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id int, url string")
    rules = (("a.test/bad/1", "block"), ("a.test/good/", "allow"))
    got = url_templates.judged(df, rules=rules).collect()
    assert {r.verdict for r in got if "/bad/" in r.path} == {"block"} and {r.verdict for r in got if "/good/" in r.path} == {"allow"}
    assert {r.template for r in got if "/bad/" in r.path} == {"/bad/*/x"}
    assert url_templates.judged(df.limit(0)).count() == 0


def tree_by_hand(rows, alike=url_templates.ALIKE, prior_n=url_templates.PRIOR):
    """(host, shape) -> (template, purity) from (host, shape, label), with dictionaries."""
    from math import sqrt

    labelled = [v for _, _, v in rows if v]
    base = (labelled.count("allow") + 1) / (len(labelled) + 2)
    tree = {(h, s): () for h, s, _ in rows}
    tally = lambda keep: tuple(sum(1 for h, s, v in rows if keep(h, s) and v == x) for x in ("allow", "block"))
    todo, level, final = set(tree), 0, {}
    while todo:
        members = defaultdict(set)
        for h, s in todo:
            members[h, tree[h, s]].add((h, s))
        for group in members.values():
            for h, s in group:
                if len(group) == 1 or len(s) <= level:
                    final[h, s] = tree[h, s] + s[level:]
        todo -= set(final)
        members = {k: g & todo for k, g in members.items() if g & todo}
        stats = {}
        for (h, t), group in members.items():
            for seg in {s[level] for _, s in group}:
                inside = {x for x in group if x[1][level] == seg}
                child = defaultdict(int)
                for h2, s2, _ in rows:
                    if (h2, s2) in inside:
                        child[s2[level + 1] if len(s2) > level + 1 else ""] += 1
                stats[h, t, seg] = (child, *tally(lambda h2, s2, i=inside: (h2, s2) in i))
        share = {}
        for (h, t, seg), (_, g, b) in stats.items():
            og = sum(x[1] for (_, t2, s2), x in stats.items() if (t2, s2) == (t, seg)) - g
            ob = sum(x[2] for (_, t2, s2), x in stats.items() if (t2, s2) == (t, seg)) - b
            w = min(prior_n, og + ob)
            share[h, t, seg] = (g + (w * og / (og + ob) if w else 0), g + b + w)
        new = {}
        for (h, t), group in members.items():
            segs = {s[level] for _, s in group}
            n = {x: sum(stats[h, t, x][0].values()) for x in segs}
            pool = defaultdict(int)
            for x in segs:
                for c, k in stats[h, t, x][0].items():
                    pool[c] += k
            total = sum(n.values())
            for x in segs:
                apart = sum(abs(stats[h, t, x][0].get(c, 0) / n[x] - k / total) for c, k in pool.items()) / 2
                q, labels = share[h, t, x]
                rest = (sum(share[h, t, y][0] for y in segs if y != x) + prior_n * base) / (sum(share[h, t, y][1] for y in segs if y != x) + prior_n)
                same = apart <= alike + 1 / sqrt(n[x]) and (labels == 0 or abs(q / labels - rest) <= alike + 1 / sqrt(labels))
                new[h, t, x] = url_templates.MERGED if len(segs) > 1 and x != url_templates.ANY and same else x
        for h, s in todo:
            tree[h, s] += (new[h, tree[h, s], s[level]],)
        level += 1
    smooth = lambda g, b, p: (g + prior_n * p) / (g + b + prior_n)
    out = {}
    for (h, s), t in final.items():
        g, b = tally(lambda h2, s2: h2 == h and final[h2, s2] == t)
        ag, ab = tally(lambda h2, s2: final[h2, s2] == t)
        hg, hb = tally(lambda h2, s2: h2 == h)
        out[h, s] = ("/" + "/".join(t), smooth(g, b, smooth(hg - g, hb - b, smooth(ag - g, ab - b, base))))
    return out


def test_template_tree_against_brute_force(spark):
    rng = random.Random(31)
    rules = (("h0.test/bad/", "block"), ("h0.test/news/", "allow"), ("h1.test/a/b/c/bad/", "block"), ("h1.test/a/b/c/good/", "allow"), ("h2.test/s1", "allow"))
    urls = []
    for _ in range(500):
        host = f"h{rng.randrange(5)}.test"
        path = rng.choice([
            f"bad/{rng.randrange(99)}", f"news/{rng.choice('xyz')}/item", f"s{rng.randrange(40)}/page", f"a/b/c/{rng.choice(['bad', 'good'])}/p", "", "about", f"{rng.choice('uvw')}/{rng.choice('uvw')}/{rng.choice('uvw')}/q/r",
            f"{rng.randrange(10**9)}/bad", f"deep/{rng.choice('ab')}/" + "z/" * 9,
        ])
        urls.append(f"https://{host}/{path}")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = url_templates.judged(df, rules=rules).collect()
    shapes = {r.page_id: tuple(r.s) for r in df.select("page_id", url_templates.segments(url_templates.path_of(F.col("url"))).alias("s")).collect()}
    verdict = dict(rules)
    expected = tree_by_hand([(r.host, shapes[r.page_id], verdict.get(r.rule)) for r in got])
    assert len(got) == len(urls)
    for r in got:
        template, purity = expected[r.host, shapes[r.page_id]]
        assert (r.template, r.purity) == (template, pytest.approx(purity))
        assert r.verdict == (verdict.get(r.rule) or ("block" if purity < url_templates.PURITY else "allow"))
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


@pytest.mark.parametrize("sections", [10, 40])
def test_width_and_depth_change_nothing(spark, sections):
    """A blocked section stays blocked beside many others; deep branches keep their own verdicts."""
    urls = [f"https://a.test/bad/p{x}/q" for x in "abcdefghijklmnopqrst"] + [f"https://a.test/s-{chr(97 + k // 26)}{chr(97 + k % 26)}/p/q" for k in range(sections)]
    urls += [f"https://b.test/a/b/c/{v}/x{x}" for v in ("good", "bad") for x in "abcdefgh"]
    rules = (*((f"a.test/bad/p{x}", "block") for x in "abcdefgh"), ("a.test/s-", "allow"))
    rules += tuple((f"b.test/a/b/c/{v}/x{x}", "allow" if v == "good" else "block") for v in ("good", "bad") for x in "abcde")
    got = url_templates.judged(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=rules).collect()
    assert {r.verdict for r in got if "/bad/" in r.path} == {"block"} and {r.verdict for r in got if "/bad/" not in r.path} == {"allow"}


def test_long_shared_paths_are_one_step(spark):
    """Levels at which nothing branches cost no jobs."""
    trap = "/".join(f"s{chr(97 + k % 26)}" for k in range(1000))
    urls = [f"https://a.test/{trap}/{x}" for x in ("p", "q/r", "q/s")] + ["https://b.test/" + trap]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    began = time.time()
    got = {r.page_id: r.template for r in url_templates.judged(df, rules=()).collect()}
    assert time.time() - began < 60
    assert got[3] == f"/{trap}" and all(got[k].startswith(f"/{trap}/") for k in range(3))


def test_urls_on_odd_rows(spark):
    rows = [(1, "https://a.org/x/y"), (None, "https://a.org/x/y"), (1, "https://a.org/x/y"), (2, None), (3, "https://b.net/" + "d/" * 3), (4, "https://b.net/" + "d/" * 3 + "e"), (5, "http:///\x00//")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "page_id int, url string, template string, n int, good int")
    got = url_templates.judged(df).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows) and got[0].verdict in ("allow", "block")


# 4. Toxicity

def test_folding():
    assert toxicity.fold("Ѕtup1d, ÎDIOT! m0r0n 5cum") == " stupid idiot moron scum "
    assert toxicity.fold("") == "  "


def test_exception_phrases():
    lexicon = toxicity.Lexicon([" clown "], np.array([3.0]), -2.0)
    assert sum(lexicon.matches(toxicity.fold("a clown fish and a clown")).values()) == 1
    assert lexicon.score("you clown") > lexicon.score("clown fish") == lexicon.score("") == lexicon.score(None)
    assert lexicon.score("clown " + "word " * 5000) < lexicon.score("clown")


def test_matches_inside_exception_phrases():
    lexicon = toxicity.Lexicon([" trash ", " tra", " can "], np.ones(3), 0.0, ("trash can", "can and trash can", "and tra"))
    rng = random.Random(2)
    for _ in range(100):
        folded = toxicity.fold(" ".join(rng.choice(["trash", "can", "and", "tray"]) for _ in range(12)))
        at = lambda entry: [k for k in range(len(folded)) if folded.startswith(entry, k)]
        free = [(k, k + len(p) + 2) for p in lexicon.exceptions for k in at(f" {p} ")]
        by_hand = {n: sum(not any(a <= k and k + len(e) <= b for a, b in free) for k in at(e)) for n, e in enumerate(lexicon.entries)}
        found = lexicon.matches(folded)
        assert {n: found[n] for n in by_hand} == by_hand
    began = time.process_time()
    lexicon.matches(toxicity.fold("trash can and trash " * 40_000))
    assert time.process_time() - began < 5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right > 0.93, right


def test_toxicity_edges(odd, none, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(odd, labels)
    assert toxicity.scores(odd, lexicon).count() == odd.count()
    assert toxicity.scores(none, toxicity.fit(none, labels.limit(0))).count() == 0


# 5. Decontamination

def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    item = [rng.choice(words) for _ in range(40)]
    swapped = [w if k % 9 else "other" for k, w in enumerate(item)]
    other = [w if k % 2 else "other" for k, w in enumerate(item)]
    filler = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(1, filler(30) + item + filler(30)), (2, filler(5) + swapped), (3, filler(200)), (4, other), (5, item[:5]), (6, item[10:32] + filler(5)), (7, [w.upper() + "," for w in item])]
    df = spark.createDataFrame([(k, " ".join(w), 0) for k, w in rows] + [(8, None, 0), (9, "", 0), (None, " ".join(item), 0), (1, " ".join(item), 0)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "short item")], "item_id bigint, text string")
    for block in (decontam.BLOCK_SEEDS, 10):
        got = {r.doc_id for r in decontam.overlaps(df, bench, block_seeds=block).collect()}
        assert got == {1, 2, 6, 7}, got
    # Rows are judged by their text: the one with a null id goes too.
    assert sorted(r.doc_id for r in decontam.decontaminated(df, bench).collect()) == [3, 4, 5, 8, 9]
    assert decontam.overlaps(df.limit(0), bench).count() == 0 and decontam.overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_finds_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op5_benchmark_decontamination(spark, sf).collect()}
    assert planted and planted <= got and len(got - planted) <= 0.1 * len(planted)


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "so what is two plus two?"), (2, "what is two"), (3, "Yes"), (4, "a yes man"), (5, "two plus what is"), (6, "")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "What is two plus two"), (2, "yes!"), (3, "..."), (4, None)], "item_id int, text string")
    for block in (decontam.BLOCK_SEEDS, 1):
        got = {(r.doc_id, r.item_id, r.first_token, r.overlap) for r in decontam.overlaps(docs, bench, block_seeds=block).collect()}
        assert got == {(1, 1, 1, 1.0), (3, 2, 0, 1.0), (4, 2, 1, 1.0)}


def test_seed_rows_are_bounded(spark):
    words = [f"w{k}" for k in range(20_000)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    found, lengths = decontam.seeds(bench)
    assert found.count() == 2 * 20_000 - 6 - 7 and lengths == []
    assert found.agg(F.max(F.size("near"))).first()[0] == decontam.AROUND
    docs = spark.createDataFrame([(1, " ".join(words[19_950:])), (2, " ".join(words[5:19_000:40]))], "doc_id int, text string")
    assert [(r.doc_id, r.first_token, r.overlap) for r in decontam.overlaps(docs, bench).collect()] == [(1, 0, 1.0)]


def overlaps_by_hand(docs, items):
    """(doc, item) -> (first_token, overlap), comparing all places of all windows."""
    words = lambda t: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w]
    out = {}
    for i, item in items:
        b = words(item)
        for d, text in docs:
            a, hits = words(text), []
            for mask in decontam.MASKS if len(b) >= decontam.SHORTEST else ():
                on = [j for j, c in enumerate(mask) if c == "1"]
                for p in range(len(b) - len(mask) + 1):
                    first = max(0, min(p - 6, len(b) - decontam.AROUND))
                    near = b[first : first + decontam.AROUND]
                    for q in range(len(a) - len(mask) + 1):
                        if all(a[q + j] == b[p + j] for j in on):
                            start = q - p + first
                            share = sum(0 <= start + k < len(a) and a[start + k] == w for k, w in enumerate(near)) / len(near)
                            if share >= decontam.SIMILARITY:
                                hits.append((start, share))
            if 0 < len(b) < decontam.SHORTEST:
                hits += [(q, 1.0) for q in range(len(a) - len(b) + 1) if a[q : q + len(b)] == b]
            if hits:
                out[d, i] = (max(0, min(h[0] for h in hits)), max(h[1] for h in hits))
    return out


def test_overlaps_against_brute_force(spark):
    """Substitutions, repeated words, items shorter than the compared window, cut passages."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 7, 9, 15, 25, 60])))) for k in range(25)] + [(90, "go " * 30), (91, "go stop " * 15), (92, "go " * 8)]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split()
        w = [rng.choice(words) if rng.random() < rng.choice([0, 0.1, 0.2, 0.3]) else x for x in w][rng.randrange(3) :]
        docs.append((k, ", ".join([rng.choice(words) for _ in range(rng.randrange(12))] + w + [rng.choice(words) for _ in range(rng.randrange(12))])))
    docs += [(90, "go " * 70), (91, "stop go " * 40)]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    expected = overlaps_by_hand(docs, items)
    for options in ({}, {"block_seeds": 400}, {"hot": 0}, {"hot": 2, "block_seeds": 900}):
        got = {(r.doc_id, r.item_id): (r.first_token, r.overlap) for r in decontam.overlaps(df, bench, **options).collect()}
        assert got == expected
    assert len(expected) > 30


def test_items_with_one_opening(spark):
    """Documents that only share the opening of very many items are not laid on each of them."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    opening = "choose the one best answer to the question below"
    items = [(k, f"{opening} " + " ".join(rng.choices(words, k=25))) for k in range(1500)]
    docs = [(k, f"{opening} " + " ".join(rng.choices(words, k=60))) for k in range(300)] + [(1000 + k, items[k * 7][1].replace("question", "task")) for k in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string")
    found = decontam.overlaps(df, bench).where("overlap >= 0.9")
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1000 + k, k * 7) for k in range(20)]
    laid = decontam._tables(decontam.seeds(bench)[0].withColumn("cls", F.xxhash64("seed", "offset", "near")), decontam.SIMILARITY, decontam.HOT_CLASSES)
    assert laid[0].groupBy("seed").count().agg(F.max("count")).first()[0] <= decontam.HOT_CLASSES
    assert laid[1].groupBy("part").count().agg(F.max("count")).first()[0] <= 40


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    expected = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in expected.description)
    rows = sorted(map(str, (tuple(dict(zip([c[0] for c in expected.description], r))[c] for c in columns) for r in expected.fetchall())))
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == rows and rows


def test_repeated_words_stay_linear(spark):
    docs = spark.createDataFrame([(1, "go " * 100_000), (2, "other " * 100_000)], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "go " * 60), (2, "go " * 20_000)], "item_id int, text string")
    assert decontam.seeds(bench)[0].count() <= 4 * 2 * decontam.AROUND
    assert {(r.doc_id, r.item_id, r.first_token, r.overlap) for r in decontam.overlaps(docs, bench).collect()} == {(1, 1, 0, 1.0), (1, 2, 0, 1.0)}


def test_scripts_without_spaces(spark):
    item = "今天的天气很好我们一起去公园散步吧然后回家吃饭"
    docs = spark.createDataFrame([(1, "前面的话" + item + "后面的话"), (2, "完全不同的内容在这里没有关系的句子而已啊啊"), (3, "前面" + item.replace("公", "花") + "吗")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    assert {(r.doc_id, r.first_token) for r in decontam.overlaps(docs, bench).collect()} == {(1, 4), (3, 2)}


def test_decontamination_on_odd_rows(odd, none):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("near"))
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(odd, bench).collect()}
    assert {(k, k) for k, t in enumerate(ODD) if t and re.search(r"\w", t)} <= got
    left = decontam.decontaminated(odd, bench.where("item_id = 5")).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(str(r.doc_id) for r in odd.collect() if r.text not in (ODD[5],)) and len(left[0]) == len(odd.columns)
    assert decontam.decontaminated(odd, bench.limit(0)).count() == odd.count() and decontam.decontaminated(none, bench).count() == 0


def test_decontamination_is_native(spark):
    plan = queries.op5_benchmark_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 6. SimHash

def by_hand(texts):
    fps = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        made = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps


def groups(ids, fps, radius=3):
    low = {}
    left = set(range(len(ids)))
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= radius}
            left -= near
            todo += near
        known = [ids[i] for i in seen if ids[i] is not None]
        for i in seen:
            low[ids[i], fps[i]] = min(known, default=None)
    return low


def test_simhash_against_brute_force(docs, odd, none):
    for df in (docs, odd):
        rows = df.collect()
        fps = by_hand([r.text for r in rows])
        expected = groups([r.doc_id for r in rows], fps)
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.fingerprint): r.component_id for r in got} == {(i, f"{f:016x}"): c for (i, f), c in expected.items()}
    assert simhash.near_duplicates(none).count() == 0


def test_links_in_small_blocks(spark):
    """Long chains and a dense group, in blocks much smaller than the tiles."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        for _ in range(3):
            chain ^= 1 << rng.randrange(64)
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, block=8)).collect()}
    expected = groups(signed, fps)
    parts, ours = defaultdict(set), defaultdict(set)
    for s, f in zip(signed, fps, strict=True):
        parts[expected[s, f]].add(s)
        ours[got.get(s, s)].add(s)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, ours.values()))


def test_one_document_of_each_group_stays(odd):
    kept = simhash.deduplicated(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in (r.component_id for r in simhash.near_duplicates(odd).collect()) if c is not None})
    assert len(kept[0]) == len(odd.columns)


# 8. Substring dedup

def test_cuts_cover_and_resist_shifts():
    rng = random.Random(6)
    raw = bytes(rng.randrange(97, 123) for _ in range(20_000))
    for text in (b"", b"a", raw, b"ab" * 4000, b"\x00" * 5000):
        ends = cdc_dedup.cuts(text)
        sizes = np.diff([0, *ends])
        assert (not text and not ends) or (ends[-1] == len(text) and sizes.max() <= cdc_dedup.MAX and sizes[:-1].min(initial=cdc_dedup.MIN) >= cdc_dedup.MIN)
    pieces = lambda t: {t[a:b] for a, b in zip([0, *cdc_dedup.cuts(t)], cdc_dedup.cuts(t))}
    assert len(pieces(raw) & pieces(raw[:7000] + b"inserted" + raw[7000:])) > 0.97 * len(pieces(raw))


def test_repeated_passages(spark, none):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(60), text(8)
    rows = [(1, text(80) + " " + passage + " " + text(50)), (2, passage + " " + text(30)), (3, text(300)), (4, line + "\n" + text(90)), (5, line + "\n" + text(90)), (6, None), (7, ""), (None, passage)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, start int")
    found = collected(cdc_dedup.repeated_passages(df))
    assert set(found) == {1, 2} and found[1][0].kept and not found[2][0].kept and found[2][0].first_id == 1
    cut = {r.doc_id: r.text for r in cdc_dedup.deduplicated(df).collect()}
    assert cut[1] == rows[0][1] and len(cut[2]) < len(rows[1][1]) - 250 and cut[3] == rows[2][1] and cut[6] is None
    assert cdc_dedup.repeated_passages(none).count() == 0


def pieces_of(text):
    raw = (text or "").encode()
    ends = cdc_dedup.cuts(raw)
    return [(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)]


def passages_by_hand(rows, least):
    """(id, text, start, end, kept) of all stretches, from plain dictionaries."""
    texts = sorted({(i, t) for i, t in rows if i is not None and t})
    places = defaultdict(set)
    for i, t in texts:
        for a, b, raw in pieces_of(t):
            places[raw].add((i, t, a))
    out = []
    for i, t in texts:
        run = []
        for a, b, raw in [*pieces_of(t), (0, 0, None)]:
            if raw is not None and len(places[raw]) > 1:
                run.append((a, b, raw))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                out.append((i, t, run))
            run = []
    return out, places


def test_every_repeated_text_has_an_owner(spark):
    """Random documents of shared passages, with repeated ids, repeated rows, repeats inside a text and nulls."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopäß日") for _ in range(rng.randrange(3, 9)))
    blocks = [" ".join(word() for _ in range(rng.randrange(30, 60))) for _ in range(6)]
    rows = []
    for k in range(40):
        rows.append((rng.randrange(30), " ".join(rng.choice([*blocks, word(), word()]) for _ in range(rng.randrange(1, 5)))))
    a, b = blocks[0], blocks[1]
    rows += [(103, a), (105, a + " " + b), (107, a + " " + b), (110, b + " x " + b), (111, None), (112, ""), (None, a), (113, "ab " * 4000), (7, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs, places = passages_by_hand(rows, cdc_dedup.LEAST_BYTES)
    found = cdc_dedup.repeated_passages(df).collect()
    covered = {(r.doc_id, r.row): set() for r in found}
    for r in found:
        covered[r.doc_id, r.row] |= set(range(r.start, r.end))
    hashes = {t: h for t, h in df.where("text is not null").select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    assert covered == {(i, hashes[t]): {x for j, u, run in runs if (j, u) == (i, t) for a, b, _ in run for x in range(a, b)} for i, t, _ in runs}
    owners = defaultdict(list)
    for r in found:
        text = next(t for i, t in rows if i == r.doc_id and t and hashes[t] == r.row)
        for a, b, raw in pieces_of(text):
            if r.start <= a and b <= r.end:
                owners[raw].append(((r.doc_id, r.row, a), r.kept))
    for raw, seen in owners.items():
        kept = [p for p, k in seen if k]
        first = min((i, hashes[t], a) for i, t, a in places[raw])
        assert len(kept) <= 1 and all(p == first for p in kept)
    left = [r.text for r in cdc_dedup.deduplicated(df).collect()]
    assert len(left) == len(rows)
    whole = "\n".join(t for t in left if t)
    assert "\ufffd" not in whole
    for raw in places:
        if len(places[raw]) > 1:
            assert raw.decode() in whole
    for block in blocks:
        assert sum(t.count(block) for t in left if t) <= sum(t.count(block) for i, t in rows if i is None) + 2


def test_substring_dedup_on_odd_rows(odd):
    found = collected(cdc_dedup.repeated_passages(odd))
    assert set(found) <= {8, 9} and all(r.first_id == r.doc_id for rows in found.values() for r in rows)
    assert [r.kept for r in sorted(found[8], key=lambda r: r.start)] == [True, False]
    assert sorted(map(str, (r.doc_id for r in cdc_dedup.deduplicated(odd).collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))


def test_long_repeats_are_found(spark):
    """Documents that share 51 words in a row, against a search of all windows."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    at = defaultdict(set)
    for r in rows:
        w = r.text.split()
        for k in range(len(w) - 50):
            at[tuple(w[k : k + 51])].add(r.doc_id)
    truth = {d for v in at.values() if len(v) > 1 for d in v}
    got = {r.doc_id for r in queries.op8_substring_dedup(spark, sf).select("doc_id").distinct().collect()}
    assert len(truth & got) >= 0.97 * len(truth)


# 9. Language ID

def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_edges(odd, none):
    model = langid.fit(odd)
    got = collected(langid.predict(odd, model))
    assert got[0][0].lang_pred == got[1][0].lang_pred == got[2][0].lang_pred == got[13][0].lang_pred == "und"
    assert len(got[5]) == 1 + 1 and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
    assert langid.predict(none, langid.fit(none)).count() == 0


def ngrams_by_hand(text):
    """Buckets of all n-grams of the lower-case text, from the definition."""
    codes, inside = [32], False
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif inside:
            codes.append(32)
        inside = c.isalpha()
    codes.append(32)
    out = defaultdict(int)
    for n in langid.ORDERS:
        for k in range(len(codes) - n + 1):
            h = n
            for c in codes[k : k + n]:
                h = (h ^ c) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out[h >> (64 - langid.BITS)] += 1
    return out


def test_ngrams_against_brute_force():
    """In pieces of any size, and the score of a model against a sum over the n-grams."""
    rng = random.Random(17)
    texts = [t for t in ODD if t and len(t) < 2000] + ["".join(rng.choice("ab cß.İΣé7 ") for _ in range(rng.randrange(60))) for _ in range(60)]
    table = np.random.default_rng(1).normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    model = langid.LanguageModel(["a", "b", "c"], table, np.array([0.1, 0.0, -0.1]), 1.3)
    for text in texts:
        by_hand = ngrams_by_hand(text)
        for piece in (1, 2, 3, 7, 1 << 16):
            at, counts = np.unique(np.concatenate(list(langid.ngram_buckets(text, piece))), return_counts=True)
            assert dict(zip(at.tolist(), counts.tolist())) == by_hand
        logits = (langid.SCALE * sum(k * table[b].astype(float) for b, k in by_hand.items()) / sum(by_hand.values()) + model.bias) / model.heat
        p = np.exp(logits - logits.max())
        found = model.predict(text)
        assert found == ("und", 0.0) if not any(map(str.isalpha, text)) else found == ("abc"[p.argmax()], pytest.approx(p.max() / p.sum(), rel=1e-4))


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(400):
        label = int(rng.integers(3))
        rows.append((np.array([label, int(rng.integers(10, 200))]), np.array([1.0, 0.2])))
        y.append(label)
    model = linear.Ftrl(256, 3, l1=0.5).fit(rows, np.array(y))
    w = model.weights()
    assert all((x @ w[at] + model.bias).argmax() == t for (at, x), t in zip(rows, y, strict=True))
    assert (w == 0).mean() > 0.8
    assert 0.05 <= linear.temperature(np.array([[3.0, 0.0], [0.0, 3.0]]), np.array([0, 1])) < 1


def test_scores_against_brute_force():
    """Lexicon entries found by plain search in the folded text."""
    rng = random.Random(5)
    entries = [" clown ", " idio", " moron ", " trash "]
    lexicon = toxicity.Lexicon(entries, np.array([1.0, 2.0, 3.0, 0.5]), -1.0)
    for _ in range(200):
        text = " ".join(rng.choice(["clown", "idi0t", "IDIOTIC", "m0ron", "trash", "can", "a", "fish", "trashy"]) for _ in range(rng.randrange(9)))
        folded = toxicity.fold(text)
        plain = {e: sum(folded.startswith(e, k) for k in range(len(folded))) for e in entries}
        found = lexicon.matches(folded)
        for k, e in enumerate(entries):
            assert found.get(k, found.get(e, 0)) <= plain[e]
            if "fish" not in text and "can" not in text:
                assert found.get(k, found.get(e, 0)) == plain[e]


# 10. Quality rules

def test_quality_base_counts(docs, odd):
    model = quality_crf.Field.blank()
    for df in (docs, odd):
        texts = collected(df)
        for key, rows in collected(quality_crf.quality(df, model)).items():
            text = texts[key][0].text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines, seen, dup = text.split("\n"), set(), 0
            for line in lines:
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            at = defaultdict(list)
            for k in range(len(words) - 7):
                at[tuple(words[k : k + 8])].append(k)
            cover = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
            n = len(words)
            r = rows[0]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))
            assert r.base_failed == (n < 20 or 100 * len(cover) > 30 * n) and (not r.base_failed or not r.kept)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(2)
    model = quality_crf.Field(np.zeros((quality_crf.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7):
        scores = rng.normal(size=(n, 2))
        best = max(
            (tuple(b >> k & 1 for k in range(n)) for b in range(2**n)),
            key=lambda s: model.start[s[0]] + sum(scores[k, s[k]] for k in range(n)) + sum(model.move[s[k], s[k + 1]] for k in range(n - 1)),
        )
        assert tuple(model.viterbi(scores.tolist())) == best


def test_field_gradient():
    rng = np.random.default_rng(3)
    model = quality_crf.Field(rng.normal(size=(quality_crf.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lines, states = rng.integers(0, quality_crf.FEATURES, size=(5, 4)), np.array([0, 1, 1, 0, 1])
    grad = quality_crf.Field.blank()
    model.gradient(lines, states, grad)
    for name, at in (("emit", (int(lines[0, 0]), 1)), ("move", (1, 0)), ("start", (1,))):
        old = getattr(model, name)[at]
        getattr(model, name)[at] = old + 1e-5
        up = model.gradient(lines, states, quality_crf.Field.blank())
        getattr(model, name)[at] = old - 1e-5
        down = model.gradient(lines, states, quality_crf.Field.blank())
        getattr(model, name)[at] = old
        assert abs((up - down) / 2e-5 - getattr(grad, name)[at]) < 1e-4


def test_quality_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_quality_edges(none, odd, spark):
    model = quality_crf.fit(none, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality_crf.quality(none, model).count() == 0
    assert not any(r.kept for r in quality_crf.quality(odd, model).where("n_words = 0").collect())
