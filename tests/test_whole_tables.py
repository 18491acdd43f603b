"""Queries that judge whole tables, against their SQL without its id and size filters."""

import duckdb
import pytest

from factloom.plans import catalog, quality, selection, texts

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,cut,whole", [
    ("referential_completeness", " WHERE c_custkey < 200", ""),
    ("compare_rates", " WHERE o_totalprice > 350000", ""),
])
def test_no_row_is_left_out(spark, name, cut, whole):
    duck = duckdb.connect()
    for t in ("customer", "events", "orders", "lineitem", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name].replace(cut, whole)})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_users_of_all_customers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(300)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in (*range(298), 400)], "user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, quality.referential_completeness(spark, str(tmp_path)).collect())) == [(298, "missing"), (299, "missing"), (400, "unknown")]


def test_spans_past_the_end_dont_hold(spark, tmp_path):
    rows = [(1, "x" * 61), (2, "too short"), (4, "y" * 34), (7, "z" * 36), (8, None)]
    spark.createDataFrame([(k, t, len(t or "")) for k, t in rows], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.holds for r in texts.span_hash_verify(spark, str(tmp_path)).collect()} == {1: True, 2: False, 4: True, 7: False, 8: False}


def test_every_page_is_judged(spark, tmp_path):
    pages = [(0, "https://a.example/x/?p=1", '<a href="/y">y</a>'), (1, "https://a.example/y", ""), (2, "https://b.example/y", '<a href="https://a.example/z/#t">z</a>'), (3, "https://a.example/z?q", "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = selection.known_url_exclusion(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, "https://a.example/x"), (2, "https://b.example/y")]
