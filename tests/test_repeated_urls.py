"""Queries over pages against their SQL, where several records have one url."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The small pages, with a second record for twelve urls, for one in three (of its own page or of the next one) and one for one in nine."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    place = tmp_path_factory.mktemp("repeated")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE p AS SELECT page_id, url, html FROM read_parquet('{SMALL}/pages.parquet')")
    con.execute("CREATE TABLE m AS SELECT a.page_id * 2 AS o, a.url, b.html FROM p a JOIN p b ON b.page_id = a.page_id + a.page_id % 2 WHERE a.page_id % 3 = 0 UNION ALL SELECT page_id * 2 + 1, url, html FROM p WHERE page_id % 9 = 0")
    con.execute("CREATE TABLE pages AS SELECT page_id, url, html FROM p UNION ALL SELECT page_id + 48, url, html FROM p WHERE page_id BETWEEN 2 AND 13 UNION ALL SELECT 61 + row_number() OVER (ORDER BY o), url, html FROM m")
    con.execute(f"COPY pages TO '{place}/pages.parquet' (FORMAT parquet)")
    return con, str(place)


@pytest.mark.parametrize("name", [
    "canonical_findings",
    "font_findings",
    "redirect_chains",
    "sitemap_membership",
    "skipped_heading_pages",
    "merged_identities",
    "module_observations",
    "near_titles",
    "duplicate_findings",
])
def test_same_rows_as_sql(spark, tables, name):
    con, place = tables
    want = con.sql(entry.oracle_sql()[name])
    rows = entry.queries()[name](spark, place).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
