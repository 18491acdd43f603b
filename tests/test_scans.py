"""Scans and security runs by hand."""

import random

from pyspark.sql import functions as F

from factloom.operators import scans, security


def walk(roots, bodies, fetches, pool):
    """One queue for each host, one body after another."""
    found = {}
    for queue in roots:
        queue = [u for u in queue if "bad" not in u]
        while queue and fetches > 0:
            url = queue.pop(0)
            fetches -= 1
            for loc in bodies.get(url, []):
                if "bad" in loc:
                    continue
                if loc.lower().endswith(".xml"):
                    if loc not in queue:
                        queue.append(loc)
                    continue
                if len(found) >= pool:
                    return list(found)
                found.setdefault(loc)
    return list(found)


def test_sitemap_walk(spark):
    rng = random.Random(9)
    maps = [f"m{k}.xml" for k in range(12)] + ["bad.xml", "M.XML"]
    bodies = {m: rng.choices([*maps, *(f"p{k}" for k in range(30)), "bad/p"], k=rng.randrange(9)) for m in maps if rng.random() < 0.8}
    roots = {s: [rng.sample(maps, rng.randrange(4)) for _ in range(rng.randrange(4))] for s in range(60)}
    for fetches, pool in ((6, 3000), (3, 5)):
        made = scans.sitemap_walk(
            spark.createDataFrame(list(roots.items()), "source_id int, roots array<array<string>>"), spark.createDataFrame(list(bodies.items()), "url string, locs array<string>"), lambda u: ~u.contains("bad"), fetches=fetches, pool=pool,
        )
        got = {s: [] for s in roots}
        for r in sorted(made.collect(), key=lambda r: r.nth):
            got[r.source_id].append(r.url)
        assert got == {s: walk(r, bodies, fetches, pool) for s, r in roots.items()}


def test_dispositions(spark):
    rows = [
        ("blocked", False, "robots", None, None, None, None, None, ("fetch", "blocked", "blocked", "succeeded", "robots")), ("failed", True, None, None, None, None, None, None, ("fetch", "fetch_failed", "unreachable", "retry", "failed")),
        ("failed", False, "x", None, None, None, None, None, ("fetch", "fetch_failed", "unreachable", "failed", "x")), ("success", False, None, "failed", True, None, None, None, ("clean", "clean_failed", "partial", "retry", "clean_failed")),
        ("success", False, None, "ok", None, "abstained", "no title", None, ("extract", "extraction_abstained", "partial", "succeeded", "extraction_abstained: no title")),
        ("success", False, None, "ok", None, "needs_review", None, True, ("persist", "review_required", "partial", "succeeded", "review_required")), ("success", False, None, "ok", None, "validated", None, True, ("persist", "record_created", "success", "succeeded", None)),
        ("success", False, None, "ok", None, "validated", None, False, ("persist", "record_unchanged", "success", "succeeded", None)), ("odd", False, None, None, None, None, None, None, None),
    ]
    names = "f string, r boolean, e string, c string, cr boolean, x string, i string, k boolean"
    df = spark.createDataFrame([r[:8] for r in rows], names).coalesce(1)
    got = [r.d and tuple(r.d) for r in df.select(scans.disposition(*(F.col(c) for c in "f r e c cr x i k".split())).alias("d")).collect()]
    assert got == [r[8] for r in rows]


def test_first_success(spark):
    rows = [
        (1, 0, "a", "detail", "blocked", None, None, None, 0), (1, 1, "b", "detail", "success", None, None, "broken", 5), (1, 2, "c", "detail", "success", None, None, None, 2), (1, 3, "d", "detail", "success", None, None, None, 9),
        (2, 0, "h", "homepage", "success", None, None, None, 0), (3, 0, "x", "detail", "failed", "http_404", "no\npage", None, 0), (3, 1, "y", "detail", "failed", "robots_disallowed", None, None, 0), (4, 0, "z", "detail", "success", None, None, "broken", 0),
    ]
    made = scans.first_successes(spark.createDataFrame(rows, "source_id int, ordinal int, url string, kind string, fetch string, error string, detail string, cleaning_error string, campaigns int"))
    assert sorted(map(tuple, made.collect())) == [
        (1, "success", scans.FETCHED, "c", 2, 2, 3), (2, "not_found", scans.NO_DETAIL, "h", 1, 0, 1), (3, "blocked", "robots_disallowed: no additional detail", "y", 0, 0, 2), (4, "unreachable", "cleaning_failed: broken", "z", 1, 0, 1),
    ]


def test_attempts_agree(spark):
    sources = spark.createDataFrame([(1, "success"), (2, "success"), (3, "blocked"), (4, "success"), (5, "blocked"), (6, "success"), (7, "blocked")], "source_id int, status string")
    rows = [(1, 0, "failed", "blocked"), (1, 1, "success", "success"), (2, 0, "failed", "success"), (3, 0, "success", "success"), (4, 0, "failed", "blocked"), (5, 0, "blocked", "blocked"), (6, 0, "success", "success"), (6, 1, "success", "success")]
    made = scans.attempt_problems(sources, spark.createDataFrame(rows, "source_id int, ordinal int, fetch string, coverage string"))
    assert sorted(map(tuple, made.collect())) == [
        (1, None, 1), (2, "inconsistent_attempt", None), (3, "unexpected_successful_attempt", None), (4, "no_successful_attempt", None), (5, None, None), (6, "multiple_successful_attempts", None), (7, "attempts_missing", None),
    ]


def test_scan_results(spark):
    indexes = spark.createDataFrame([(1, 0, "success", True, None), (1, 1, "blocked", False, "e1"), (2, 0, "failed", False, "e2"), (3, 0, "not_modified", False, None)], "source_id int, position int, status string, changed boolean, error string")
    known = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "source_id int, url string")
    seen = spark.createDataFrame([(1, 0, "a"), (1, 0, "n"), (1, 1, "m"), (2, 0, "q")], "source_id int, position int, url string")
    results, targets = scans.scan_results(indexes, known, seen)
    assert sorted(map(tuple, results.collect())) == [(1, "blocked", 1, 1, 2, True, "e1"), (2, "failed", 2, 0, 2, False, "e2"), (3, "not_modified", 0, 0, 0, False, None)]
    assert sorted(map(tuple, targets.collect())) == [(1, "a", False), (1, "n", True), (2, "b", False), (2, "c", False)]


def test_security(spark):
    cases = spark.createDataFrame([(k, f"i{k}", False, 0) for k in range(6)], "case_id int, input_sha256 string, expected_escape boolean, expected_unsupported int")
    evidence = spark.createDataFrame([(0, "/t", "good"), (1, "/t", "good"), (1, "/t", "bad"), (1, "/r", "gone")], "case_id int, pointer string, block_id string")
    blocks = spark.createDataFrame([(k, b, b == "good") for k in range(6) for b in ("good", "bad")], "case_id int, block_id string, trusted boolean")
    tainted = security.tainted_pointers(evidence, blocks)
    assert [tuple(r) for r in tainted.collect()] == [(1, ["/r", "/t"])]
    runs = [(0, True, "candidate", "evidence_only", False, False, 0, 0, "i0", "p", "s"), (1, True, "candidate", "unsafe_acceptance", False, False, 0, 0, "i1", "p", "s"), (2, True, "abstained", "abstain", False, False, 0, 0, "old", "p", "s"), (3, False, "error", "incomplete", True, False, 0, 2, "i3", "p", "s"), (4, True, "abstained", "abstain", False, False, 0, 0, "i4", "p", "t")]
    names = "case_id int, completed boolean, outcome string, decision string, said_escape boolean, model_attempted boolean, model_facts int, network_attempts int, input_sha256 string, profile string, suite string"
    made = security.run_outcomes(cases, spark.createDataFrame(runs, names), tainted, {"suite": F.lit("s")})
    got = {r.case_id: (r.completed, r.passed, r.errors) for r in made.collect()}
    assert got[0] == (True, True, []) and got[1] == (True, False, []) and got[2] == (False, False, ["input_stale"]) and got[4] == (False, False, ["suite_stale"]) and got[5] == (False, False, ["prediction_missing"])
    assert got[3] == (False, False, ["decision_mismatch", "network_attempted", "product_outcome_invalid", "product_path_incomplete"])
    assert tuple(security.security_gate(made).first()) == ("insufficient_data", 6, 2, 0, 2)
    assert security.security_gate(made.where("case_id < 2"), 2).first().status == "fail" and security.security_gate(made.where("case_id < 1"), 1).first().status == "pass"


def test_a_walk_makes_its_bodies_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    bodies = spark.createDataFrame([("a.xml", ["b.xml", "p1"]), ("b.xml", ["c.xml", "p2"]), ("c.xml", ["p3"])], "url string, locs array<string>")
    sources = spark.createDataFrame([(1, [["a.xml"]])], "source_id int, roots array<array<string>>")
    walked = scans.sitemap_walk(sources, bodies.mapInArrow(seen, bodies.schema), lambda u: F.lit(True), fetches=3, pool=9)
    assert [r.url for r in walked.orderBy("nth").collect()] == ["p1", "p2", "p3"]
    assert made.value == 3
