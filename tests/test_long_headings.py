"""Queries over pages against their SQL, where titles and headings are long."""

import os

import pytest

import __spark_entry__ as entry

from lanternfish.sources import html

SMALL = "/root/testdata/sf0.001"


def test_headings_are_whole(spark):
    words = " ".join(f"mot{k}" for k in range(400))
    page = f"<html><head><title>{words}</title></head><body><h1>{words}</h1><h1>deux <b>{words}</b></h1></body></html>"
    r = html.page_records(html.parsed(spark.createDataFrame([(1, "https://a.b/", page)], "page_id bigint, url string, html string"))).first()
    assert r.title == words and r.h1 == [words, f"deux {words}"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The small pages; every second one has words of its own and words that others share behind the first 200 characters of its heading."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    place = tmp_path_factory.mktemp("headings")
    con = duckdb.connect()
    long = "repeat(' encore', 30) || ' page' || page_id || ' tiers' || page_id % 3 || repeat(' fin' || page_id % 7, 40) || '</h1>'"
    con.execute(rf"CREATE TABLE pages AS SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(html, '\s*</h1>', {long}, 'g') ELSE html END AS html FROM read_parquet('{SMALL}/pages.parquet')")
    con.execute(f"COPY pages TO '{place}/pages.parquet' (FORMAT parquet)")
    return con, str(place)


@pytest.mark.parametrize("name", ["title_words", "near_titles", "page_records"])
def test_same_rows_as_sql(spark, tables, name):
    con, place = tables
    want = con.sql(entry.oracle_sql()[name])
    rows = entry.queries()[name](spark, place).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
    if name == "title_words":
        assert {"tiers0", "tiers1", "tiers2"} & {r.token for r in rows}
