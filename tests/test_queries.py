"""Queries against their checking SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SF = "/root/testdata/sf0.001"
FAST = ["title_clean", "release_season_episode", "forum_title", "identity_keys", "link_parse", "links_latest", "episode_links", "link_rank",
        "availability", "catalog_page", "gap_report", "cascade_delete", "merge_threads", "enroll_series", "file_pick_movie", "page_listings",
        "stream_first_seen"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in cur.description], cur.fetchall())
    got = canonical(df.columns, df.collect())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
