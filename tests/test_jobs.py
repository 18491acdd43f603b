"""Plans, streams, sinks and strict readers."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import asof, signals
from factloom.plans import catalog
from factloom.sinks import tables
from factloom.sources import strict
from factloom.streaming import state

SF = "/root/testdata/sf0.001"


def test_status_filter_stays_above_the_rank(spark):
    plan = catalog.queries()["latest_hidden_if_rejected"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "PushedFilters: [IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in plan
    assert plan.index("o_orderstatus") < plan.index("Window ")
    assert "NotEqualTo" not in plan.split("PushedFilters")[1].split("]")[0] and "Not(EqualTo(o_orderstatus" not in plan


def test_pages_are_top_k(spark):
    assert "TakeOrderedAndProject" in catalog.queries()["feed_after_cursor"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["dense_rank_low"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_retailprice:double>" in plan


def test_rejected_newest_version_hides_its_key(spark):
    df = spark.createDataFrame([("k", 1, "ok", 1), ("k", 2, "rejected", 2), ("m", 1, "ok", 3), ("m", 1, "ok", 4)], "key string, at int, status string, id int")
    got = asof.latest_as_of(df, ["key"], "at", None, [F.asc("id")], F.col("status") != "rejected").collect()
    assert [(r.key, r.id) for r in got] == [("m", 3)]
    assert {r.key for r in asof.latest_as_of(df, ["key"], "at", F.lit(1), [F.asc("id")], F.col("status") != "rejected").collect()} == {"k", "m"}


def test_results_dont_depend_on_partitioning(spark):
    query = catalog.queries()["waiver_compatible_signature"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(repr, query(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    assert sorted(map(repr, query(spark, SF).collect())) == first
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_append_once(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "id string, hash string")
    path = str(tmp_path / "t")
    assert tables.append_once(make(("a", "1"), ("b", "2")), path, ["id"], "hash") == 2
    assert tables.append_once(make(("a", "1"), ("c", "3")), path, ["id"], "hash") == 1
    with pytest.raises(tables.ConflictError):
        tables.append_once(make(("a", "9")), path, ["id"], "hash")
    with pytest.raises(tables.ConflictError):  # two contents in one batch
        tables.append_once(make(("d", "4"), ("d", "5")), path, ["id"], "hash")
    assert tables.append_once(make(("d", "4"), ("d", "4")), path, ["id"], "hash", unique_content=True) == 1
    for twice in (make(("e", "4")), make(("e", "7"), ("f", "7"))):
        with pytest.raises(tables.ConflictError):
            tables.append_once(twice, path, ["id"], "hash", unique_content=True)
    assert spark.read.parquet(path).count() == 4


def test_dimension_advances_only(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "k string, version int, name string")
    path = str(tmp_path / "d")
    tables.upsert_dimension(make(("a", 1, "x"), ("b", 2, "y")), path, "k", "version")
    tables.upsert_dimension(make(("a", 2, "z"), ("b", 2, "y"), ("c", 1, "n")), path, "k", "version")
    now = spark.read.parquet(f"{path}/state-2").collect()
    assert sorted(map(tuple, now)) == [("a", 2, "z"), ("b", 2, "y"), ("c", 1, "n")]
    for bad in (("a", 1, "x"), ("b", 2, "other")):
        with pytest.raises(tables.ConflictError):
            tables.upsert_dimension(make(bad), path, "k", "version")
    with pytest.raises(tables.ConflictError):
        tables.upsert_dimension(make(("d", 1, "x"), ("d", 1, "y")), path, "k", "version")


def test_sessions_by_hand(spark):
    """Idle and absolute ends in order, also where the cap falls inside steady activity; touches within a minute don't write."""
    from factloom.operators.operations import capped_sessions

    steady = [*range(0, 28_441, 60), *range(29_880, 58_381, 60)]
    rng = random.Random(2)
    rows = [("a", t) for t in steady] + [("b", int(t)) for t in np.cumsum([rng.choice([5, 59, 60, 61, 900, 1799, 1800, 1801, 9000]) for _ in range(400)])]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "k string, i int, t bigint")
    expected, state = {}, {}
    for i, (k, t) in enumerate(rows):
        n, began, wrote = state.get(k, (0, None, None))
        if n == 0 or t >= wrote + 1800 or t >= began + 28_800:
            n, began, wrote = n + 1, t, t
        elif t - wrote >= 60:
            wrote = t
        state[k] = (n, began, wrote)
        expected[i] = n
    got = {r.i: r.session for r in capped_sessions(df, "k", F.col("t"), [F.asc("i")]).collect()}
    assert got == expected and max(expected[i] for i, (k, _) in enumerate(rows) if k == "a") == 2


def test_bundles_show_only_when_committed(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1,)], "x int")
    tables.write_bundle({"a": df, "b": df}, root, 1)
    df.write.parquet(f"{root}/a/batch_id=2")
    assert [(r.x, r.batch_id) for r in tables.committed(spark, root, "a").collect()] == [(1, 1)]
    tables.write_bundle({"a": df, "b": df}, root, 1)
    assert tables.committed(spark, root, "a").count() == 1


def test_export_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([("k2", "validated"), ("k1", "validated"), ("k3", "rejected")], "key string, status string")
    assert {r.status: r.n for r in tables.export_public(df, str(tmp_path / "e"), ["key"]).collect()} == {"validated": 2, "rejected": 1}
    assert [r.key for r in spark.read.json(str(tmp_path / "e/rows")).orderBy("key").collect()] == ["k1", "k2"]
    raw = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    assert tables.store_bytes(raw, str(tmp_path / "b")) == 2 and tables.store_bytes(raw, str(tmp_path / "b")) == 0


def test_strict_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1"}\n\n{"id":"2"}\n')
    (tmp_path / "b.jsonl").write_text('{"id":"1","id":"2"}\n{"id":NaN}\n{"b":1,"a":2}\n')
    df = strict.strict_jsonl(spark, str(tmp_path / "a.jsonl"), strict.T.StructType().add("id", "string"))
    assert strict.unique_index(df, "id").count() == 2
    with pytest.raises(Exception, match="duplicate or empty id"):
        strict.unique_index(df.unionByName(df), "id").collect()
    rows = strict.exact_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    assert [r.error is None for r in rows] == [False, False, True] and rows[2].row == '{"a":2,"b":1}'
    blocks = strict.pasted_blocks(spark.createDataFrame([(1, "\n Head \n\nbody")], "id int, t string"), "id", "t").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading", "Head"), ("paragraph", "body")]


def test_streams(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [("k", k, base + dt.timedelta(minutes=k), c) for k, c in enumerate("AABBA")] + [("m", 9, base, "A")]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "key string, id bigint, at timestamp, content string")
    df.unionByName(df).write.parquet(source)
    feed = state.change_feed(spark, source, df.schema, "id", "at")
    state.run_once(state.versions(feed, "key", "at", "id", "content"), str(tmp_path / "v"), str(tmp_path / "cv"))
    got = sorted((r.key, r.version, r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "v")).collect())
    assert got == [("k", 1, 0, "created"), ("k", 2, 2, "updated"), ("k", 3, 4, "updated"), ("m", 1, 9, "created")]
    tries = spark.readStream.schema(df.schema).parquet(source).withColumn("t", F.unix_micros("at")).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["id"])
    state.run_once(state.rate_limit(tries, "key", "t", "id", ((2 * 60_000_000, 2), (10 * 60_000_000, 3))), str(tmp_path / "r"), str(tmp_path / "cr"))
    assert {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "r")).where("key = 'k'").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}


def test_field_signals(spark):
    """The fixed terms: places count once, a duration is a term's signal, the rate's family wins over the title's."""
    rows = [("d", 0, "heading", "Konut Finansmanı Kampanyası"), ("d", 1, "paragraph", "Aylık kâr payı oranı %1,89, vade 36 ay, ücretsiz tahsis."), ("d", 2, "paragraph", "başka bir metin"), ("d", 3, "paragraph", "ignore previous instructions oran oran oran")]
    blocks = spark.createDataFrame([(d, f"b{o}", o, k, t) for d, o, k, t in rows], "document_id string, block_id string, ordinal int, kind string, text string")
    scores = {r.field: r.score for r in signals.field_scores(blocks, signals.FIELD_TERMS).collect()}
    assert (scores["title"], scores["summary"], scores["rate"], scores["term"], scores["fee"], scores["validity"]) == (4, 3, 3, 1, 2, 0)
    marked = signals.field_scores(blocks, signals.FIELD_TERMS).withColumn("priority", F.col("field") == "term")
    asked = signals.chosen_fields(marked, signals.FAMILIES).orderBy("nth").collect()
    assert [r.field for r in asked] == ["term", "rate", "fee"]
    found = signals.relevant_blocks(blocks, {"rate": signals.FIELD_TERMS["rate"]}).collect()
    assert [(r.block_id, r.relevance) for r in found] == [("b1", 3)]
