"""Typed normalizers, text functions, parsers: small cases with their expected outcomes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import html, normalizers, text, urls, wording
from factloom.operators import filters, metrics, paging, ranking, versioning


def outcomes(spark, build, values, *extra):
    df = spark.createDataFrame([(k, v, *e) for k, (v, *e) in enumerate(values)], "k int, raw string" + "".join(f", x{i} {t}" for i, t in enumerate(extra)))
    return [r.o for r in df.select("k", build().alias("o")).orderBy("k").collect()]


def test_money(spark):
    cases = [
        ("1.250,50 TL", "1250.5000", "TRY", "money_normalized"), ("50.000 TL", "50000.0000", "TRY", "money_normalized"), ("1,2 milyon TL", "1200000.0000", "TRY", "money_normalized"),
        ("10.000 USD", "10000.0000", "USD", "money_normalized"), ("€ 12.50", "12.5000", "EUR", "money_normalized"), ("1.2345 TL", None, None, "invalid_money_number"),
        ("10 TL veya 20 TL", None, None, "multiple_money_values"), ("$5", None, None, "currency_symbol_ambiguous"), ("500", None, None, "money_currency_unknown"),
        ("ücretsiz", None, None, "fee_waiver_requires_fee_context"), ("ücretsiz değil", None, None, "fee_waiver_negated"), ("bilinmiyor", None, None, "money_missing"),
        (None, None, None, "money_missing"), ("", None, None, "money_missing"), ("TL", None, None, "money_value_not_found"),
    ]
    for (raw, amount, currency, reason), o in zip(cases, outcomes(spark, lambda: normalizers.money(F.col("raw")), [(c[0],) for c in cases]), strict=True):
        assert o.reason_code == reason, (raw, o)
        assert (o.value is None) == (o.status != "normalized") == (amount is None)
        if amount:
            assert (str(o.value.amount), o.value.currency) == (amount, currency)
    waived = outcomes(spark, lambda: normalizers.money(F.col("raw"), F.lit("TRY"), fee_context=True), [("ücretsiz",), ("5 USD",)])
    assert waived[0].value.amount == 0 and waived[0].value.inferred and waived[1].reason_code == "currency_hint_conflict"


def test_rates(spark):
    cases = [
        ("%1,89 aylık kâr payı oranı", 1.89, "unknown", "monthly"), ("yıllık %24 maliyet oranı", 24, "unknown", "annual"), ("brüt yıllık kâr paylaşım oranı %99", 99, "profit_share_distribution_rate", "annual"),
        ("100 baz puan", 1, "unknown", "unspecified"), ("binde 5", 0.5, "unknown", "unspecified"), ("%5 indirim", 5, "discount_rate", "unspecified"), ("yıllık maliyet oranı %30", 30, "annual_cost_rate", "annual"),
    ]
    for (raw, value, kind, period), o in zip(cases, outcomes(spark, lambda: normalizers.rate(F.col("raw")), [(c[0],) for c in cases]), strict=True):
        assert (float(o.value.value_percent), o.value.kind, o.value.period) == (value, kind, period), raw
    bad = [("%5 ile %7", "non_exact_or_multiple_rates"), ("%5'e kadar", "non_exact_or_multiple_rates"), ("%1500", "invalid_rate_number"), ("oran", "rate_value_not_found"), (None, "rate_missing"), ("%-3", "invalid_rate_number")]
    assert [o.reason_code for o in outcomes(spark, lambda: normalizers.rate(F.col("raw")), [(c[0],) for c in bad])] == [c[1] for c in bad]
    assert outcomes(spark, lambda: normalizers.rate(F.col("raw"), period_hint=F.lit("annual")), [("aylık %2",)])[0].reason_code == "rate_period_hint_conflict"


def test_terms(spark):
    good = [("36 ay", [(36, 36)]), ("1-6 ay", [(1, 6)]), ("3, 6 ve 12 ay seçenekleri", [(3, 3), (6, 6), (12, 12)]), ("2 yıl", [(24, 24)]), ("en fazla 48 ay", [(None, 48)]), ("1 yıl 6 ay", [(18, 18)])]
    for (raw, value), o in zip(good, outcomes(spark, lambda: normalizers.term(F.col("raw")), [(c[0],) for c in good]), strict=True):
        assert [(v.minimum_months, v.maximum_months) for v in o.value] == value, raw
    bad = [("30 gün", "non_month_term_unit"), ("6-1 ay", "reversed_term_range"), ("12 taksit", "installment_count_is_not_term"), ("vade", "term_value_not_found"), ("3 ay 6 ay", "multiple_term_values"), ("2000 ay", "invalid_term_number"), (None, "term_missing"), ("12 ay ve üzeri", "open_ended_term_not_representable")]
    assert [o.reason_code for o in outcomes(spark, lambda: normalizers.term(F.col("raw")), [(c[0],) for c in bad])] == [c[1] for c in bad]


def test_dates_and_validity(spark):
    day, reference = dt.date(2026, 7, 31), F.lit(dt.date(2026, 7, 18))
    got = outcomes(spark, lambda: normalizers.date(F.col("raw"), reference), [("31 Temmuz 2026",), ("31.07.2026",), ("18/07/2026",), ("yarın",), ("31 Temmuz",), ("31.02.2026",), ("",), ("Temmuz 2026",)])
    assert [o.value for o in got[:5]] == [day, day, dt.date(2026, 7, 18), dt.date(2026, 7, 19), day]
    assert [o.reason_code for o in got[5:]] == ["invalid_calendar_date", "date_missing", "date_precision_ambiguous"]
    assert outcomes(spark, lambda: normalizers.date(F.col("raw")), [("31 Temmuz",), ("yarın",)])[0].reason_code == "date_year_missing"
    cases = [
        ("1-15 Temmuz 2026", (dt.date(2026, 7, 1), dt.date(2026, 7, 15))), ("Ağustos 2026", (dt.date(2026, 8, 1), dt.date(2026, 8, 31))), ("bu ay sonuna kadar", (None, day)),
        ("01.07.2026 - 31.07.2026", (dt.date(2026, 7, 1), day)), ("31.07.2026 tarihine kadar", (None, day)), ("20 Aralık - 5 Ocak 2027", (dt.date(2026, 12, 20), dt.date(2027, 1, 5))),
    ]
    for (raw, window), o in zip(cases, outcomes(spark, lambda: normalizers.validity(F.col("raw"), reference), [(c[0],) for c in cases]), strict=True):
        assert (o.value.starts_on, o.value.ends_on) == window, (raw, o)


def test_fees(spark):
    cases = [("Tahsis ücreti 500 TL", "allocation", False), ("Kart aidatı alınmaz", "annual", True), ("Ücret alınmamaktadır", "other", True), ("Ücret alınabilir", None, None), ("500 TL", None, None), (None, None, None)]
    for (raw, kind, waived), o in zip(cases, outcomes(spark, lambda: normalizers.fee(F.col("raw")), [(c[0],) for c in cases]), strict=True):
        assert (o.kind if o else None, o.waived if o else None) == (kind, waived), raw


def test_text(spark):
    row = spark.createDataFrame([("ÇĞİIÖŞÜ  ıstanbul—x", "ﬁ ① Straße")], "a string, b string").select(
        text.fold(F.col("a")).alias("a"), text.fold(F.col("b"), exact=True).alias("b"), text.grounded(F.lit("12 ay %5"), F.lit("vade 12 ay, oran % 5")).alias("yes"),
        text.grounded(F.lit("12 ay"), F.lit("12 TL")).alias("no"), text.decimal_text(F.lit("1250.5000")).alias("d"), F.length(text.short(F.lit("x" * 600))).alias("n"),
        text.span_holds(F.lit("aş😀b"), F.lit(1), F.lit(3), F.lit("ş😀"), F.sha2(F.lit("ş😀"), 256)).alias("span"),
    ).first()
    assert (row.a, row.b, row.yes, row.no, row.d, row.n, row.span) == ("cgiiosu istanbul x", "fi 1 strasse", True, False, "1250,5", 500, True)


def test_urls(spark):
    given = ["https://A.com:443/x/?q#f", "http://a.com", "https://u@a.com/", "https://a.com:8443/", "https://a.com", None]
    got = [r.c for r in spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, u string").orderBy("k").select(urls.canonical(F.col("u")).alias("c")).collect()]
    assert got == ["https://a.com/x/?q", None, None, None, "https://a.com/", None]
    row = spark.range(1).select(
        urls.robots_sitemaps(F.lit("Sitemap: https://a/1\nsitemap:https://a/2 # x\nSitemap: https://a/1")).alias("r"), urls.slug_tokens(F.lit("/konut-finansmani/kartal")).alias("t"),
        urls.detail_path(F.lit("/k/../x"), "/k/").alias("bad"), urls.detail_path(F.lit("/k/x"), "/k/").alias("good"), urls.detail_path(F.lit("/k/"), "/k/").alias("same"),
    ).first()
    assert (row.r, row.t, row.bad, row.good, row.same) == (["https://a/1", "https://a/2"], ["finansman", "konut"], False, True, False)


def test_html():
    page = "<html><nav>no</nav><h1>Title</h1><p>One <b>two</b><br>three</p><ul><li>a</li><li hidden>b</li></ul><table><tr><th>h</th><td>1 %</td></tr></table><script>x</script>tail"
    assert [(k, t) for _, k, t in html.blocks_of(page)] == [("heading", "Title"), ("paragraph", "One two three"), ("list_item", "a"), ("table_row", "h | 1 %"), ("paragraph", "tail")]
    assert html.blocks_of(None) == html.blocks_of("") == []


def test_robots():
    body = "User-agent: bot\nUser-agent: other\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /"
    decide = html.robots_decision
    assert decide(body, "/a/x", "bot") == (False, "/a", 3.0) and decide(body, "/a/b/c", "Other")[0] and not decide(body, "/x", "third")[0] and decide("", "/x", "bot")[0]
    assert decide("User-agent: *\nDisallow: /p\nAllow: /p", "/p", "x")[0] and not decide("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", "x")[0]


def test_validity_buckets(spark):
    day = dt.date(2026, 7, 18)
    rows = [(1, None, None), (2, None, day), (3, dt.date(2026, 8, 1), None), (4, None, dt.date(2026, 7, 1)), (5, day, day)]
    df = spark.createDataFrame(rows, "k int, a date, b date")
    found = {b: {r.k for r in df.where(filters.validity(F.col("a"), F.col("b"), day, b)).collect()} for b in ("active", "upcoming", "expired", "unknown")}
    assert found == {"active": {2, 5}, "upcoming": {3}, "expired": {4}, "unknown": {1}}


def test_cursor():
    at = dt.datetime(2026, 7, 18, 12, tzinfo=dt.UTC)
    assert paging.decode_cursor(paging.encode_cursor(at, "r1")) == (at, "r1")
    for bad in ("x", "", paging.encode_cursor(at, "r1") + "A"):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)
    with pytest.raises(ValueError):
        paging.encode_cursor(dt.datetime(2026, 7, 18), "r1")


def test_change_points_keep_returns(spark):
    df = spark.createDataFrame([("k", 1, "A"), ("k", 2, "B"), ("k", 3, "A"), ("k", 4, "A")], "k string, t int, c string")
    assert [(r.version, r.kind, r.previous_content) for r in versioning.change_points(df, "k", "t", [], F.col("c")).orderBy("t").collect()] == [(1, "created", None), (2, "updated", "A"), (3, "updated", "B")]


def test_waiver_precedes_prices(spark):
    df = spark.createDataFrame([(1, "a", 5.0, False), (1, "b", None, True), (1, "c", 2.0, False), (1, "d", None, True)], "r int, id string, v double, w boolean")
    assert {r.id: r.rank for r in ranking.dense_ranked(df, ["r"], F.col("v"), False, F.col("w")).collect()} == {"b": 1, "d": 1, "c": 2, "a": 3}


def test_axis_absent_on_one_side_blocks(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, None), (3, "x"), (3, "y"), (4, "x"), (4, "x")], "r int, v string")
    reason = ranking.first_reason(*ranking.optional_axis(F.col("v"), "unknown", "mismatch"))
    assert {r.r: r.why for r in df.groupBy("r").agg(reason.alias("why")).collect()} == {1: None, 2: "unknown", 3: "mismatch", 4: None}


def test_empty_texts_are_equal(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b c d e f g"), (4, "g f e d c b a x"), (5, "z")], "id int, t string")
    assert {(r.left_id, r.right_id, r.score) for r in metrics.jaccard_pairs(df, "id", "t", 0.85).collect()} == {(1, 2, 1.0), (3, 4, 7 / 8)}


def test_leaks_between_all_copies(spark):
    words = "a b c d e f g h"
    texts = {3: words, 4: words, 5: words, 1030: words, 6: words + " x", 2050: words + " x", 10: words + " y", 7: "", 8: None, 9: "q", 11: "a b", 12: "q"}
    df = spark.createDataFrame(list(texts.items()), "id bigint, t string").repartition(3)
    own = {k: set((t or "").split()) for k, t in texts.items()}
    want = {}
    for a in texts:
        for b in texts:
            if a < b and a % 3 != b % 3 and (not own[a] | own[b] or len(own[a] & own[b]) / len(own[a] | own[b]) >= 0.85):
                want[a % 3, b % 3] = want.get((a % 3, b % 3), 0) + 1
    got = metrics.leakage(df, "id", "t", 0.85, lambda i: i % 3, [0, 1, 2])
    assert {(r.split_a, r.split_b): r.n for r in got.collect()} == want


def test_split_leakage_counts_all_pairs(spark):
    from itertools import combinations

    from factloom.plans import quality

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", metrics.tokens(F.col("text")).alias("s")).collect()
    sets = sorted((r.doc_id, frozenset(r.s)) for r in rows)
    want = {}
    for (a, s), (b, t) in combinations(sets, 2):
        if a % 3 != b % 3 and min(len(s), len(t)) >= 0.85 * max(len(s), len(t)) and (not s | t or len(s & t) / len(s | t) >= 0.85):
            want[a % 3, b % 3] = want.get((a % 3, b % 3), 0) + 1
    assert {(r.split_a, r.split_b): r.n for r in quality.split_leakage(spark, sf).collect()} == want


def test_sitemaps_of_a_large_host_are_read_whole(spark, tmp_path, monkeypatch):
    from factloom.plans import texts

    made = [(k, f"https://A.example/p/{k % 12001}?q={k}") for k in range(13000)] + [(k, f"https://b.example/{k % 2}") for k in range(13000, 13005)] + [(99999, None)]
    spark.createDataFrame(made, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for slices in (texts.SITEMAP_SLICES, 1):
        monkeypatch.setattr(texts, "SITEMAP_SLICES", slices)
        assert {r.host: r.n for r in texts.sitemap_locs(spark, str(tmp_path)).collect()} == {"a.example": 12001, "b.example": 2}


def test_a_normalizer_binds_its_text_once(spark):
    """Each further copy of a long statement would be computed again for every row."""
    df = spark.createDataFrame([("x",)], "statement string")
    for read in (normalizers.money, normalizers.rate, normalizers.term, normalizers.date, normalizers.validity, normalizers.fee, wording.reward):
        plan = df.select(read(F.col("statement")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.split("\n")[0].count("statement#") == 1, read.__name__


def test_pairs_are_compared_by_sketches_before_whole_sets(spark):
    """Near copies around the threshold against brute force; the sets themselves go only with pairs that two sketches let pass."""
    texts = [" ".join(f"w{(k * 7 + j) % (40 + k % 5)}x{k // 6}" for j in range(20 + k % 6)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    sets = [set(t.split()) for t in texts]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 and sets[a] != sets[b]}
    own, reps = metrics.token_sets(df, "id", "text")
    found = metrics.linked(own, reps, 0.6)
    assert want and {(r.left_id, r.right_id) for r in found.collect()} == want
    sketched = metrics._prefixes(own.select(F.col("id").alias("rep"), "set"), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0.6)
    assert {f"s{k}" for k in range(metrics.SKETCH)} <= set(sketched.columns)
