"""What is written, moved and held at once."""

import pytest
from pyspark.sql import functions as F

from reelweave import session
from reelweave.functions import links as ln
from reelweave.operators import aggregates as ag
from reelweave.operators import joins as jn
from reelweave.operators import ranking as rk
from reelweave.plans import repair
from reelweave.sources import entities
from reelweave.sources import pages as pg
from reelweave.workload import ingest_queries, queries, request_queries
from reelweave.workload.fixtures import fixture

TIMES = "TIMESTAMP '2024-01-01 00:00:00'"


@pytest.fixture
def small(spark, tmp_path):
    """Tables of a few parts with three links each."""
    spark.range(24).selectExpr("id AS p_partkey", "concat('red bolt ', id % 5) AS p_name", "'Brand#1' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(72).selectExpr("id AS l_orderkey", "id % 3 + 1 AS l_linenumber", "id % 24 AS l_partkey", "id % 7 AS l_suppkey", f"{TIMES} AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("events", "documents", "pages"):
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _recorded(monkeypatch, module):
    """(label, table) of everything a module writes from now on."""
    seen, write = [], module.materialize

    def record(df, label, *more, **named):
        out = write(df, label, *more, **named)
        seen.append((label, out))
        return out
    monkeypatch.setattr(module, "materialize", record)
    return seen


def test_summary_counts_whole_matches(spark, small, monkeypatch):
    seen = _recorded(monkeypatch, queries)
    got = queries.match_summary(spark, small).first()
    (label, rows), = seen
    assert label == "title-matches" and rows.columns == ["thread_id", "ref_id", "score"]
    found = rows.filter("ref_id IS NOT NULL").count()
    assert tuple(got) == (found, 24 - found) and found > 0
    assert rows.filter("ref_id IS NOT NULL AND score IS NULL").count() == 0


def test_files_count_as_what_they_take_in_memory(spark, small):
    spark.conf.unset(session.SIZE_CONF)
    fixture(spark, small, "fx_threads")
    assert float(spark.conf.get(session.SIZE_CONF)) == session.MEMORY_OF_FILE
    spark.conf.set(session.SIZE_CONF, "50.0")  # a larger one stays
    session.materialize(spark.range(3), "three")
    assert float(spark.conf.get(session.SIZE_CONF)) == 50.0
    spark.conf.unset(session.SIZE_CONF)


def test_links_are_grouped_where_their_parts_met(spark, small):
    links = fixture(spark, small, "fx_links", by_part=True).select("thread_id", "magnet").distinct().groupBy("thread_id").agg(F.collect_list("magnet").alias("m"))
    # all that moves are the few columns that links are made of
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plain = fixture(spark, small, "fx_links").select("thread_id", "magnet").distinct().groupBy("thread_id").agg(F.collect_list("magnet").alias("m"))
    assert sorted((r.thread_id, sorted(r.m)) for r in links.collect()) == sorted((r.thread_id, sorted(r.m)) for r in plain.collect())


def test_stored_threads_are_made_once(spark, small, monkeypatch):
    seen = _recorded(monkeypatch, ingest_queries)
    tables = ingest_queries.stored(spark, small)
    assert [label for label, _ in seen] == ["stored-threads"]
    assert sorted(r.id for r in tables["threads"].filter("id < 1000000").select("id").collect()) == list(range(0, 24, 2))
    raw = {r.thread_hash: r.raw_title for r in tables["threads"].collect()}
    assert all(raw[r.thread_hash] == r.raw_title for r in tables["watchlist"].collect())


def test_latest_links_are_made_once_for_requests(spark, small, monkeypatch):
    seen = _recorded(monkeypatch, request_queries)
    out = request_queries.links_for_request(spark, small)
    assert [label for label, _ in seen] == ["latest-links"] and out.count() > 0


def test_name_of_the_latest_link(spark):
    link = lambda n, name: f"magnet:?xt=urn:btih:{n:040x}&dn={name}"
    rows = [(f"{1:040x}", link(1, "a"), 1), (f"{1:040x}", link(1, "c"), 2), (f"{1:040x}", link(1, "b"), 2), (f"{1:040x}", link(1, "z"), None), (f"{2:040x}", None, 1), ("", link(3, "x"), 1), (None, link(4, "y"), 1)]
    cache = spark.createDataFrame(rows, "infohash string, magnet string, created_at int")
    asked = spark.createDataFrame([(f"{1:040x}",), (f"{2:040x}",), ("",), (None,)], "infohash string")
    got = {r.infohash: r.display_name for r in jn.with_display_name(asked, cache).collect()}
    assert got == {f"{1:040x}": "c", f"{2:040x}": "", "": "", None: ""}


@pytest.mark.parametrize("written", [False, True])
def test_numbers_follow_the_order(spark, written):
    rows = [("d", 7), ("b", None), ("c", 0), ("a", 3), ("e", None)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(3)
    got = rk.assign_ids(df, ["k"], written=written)
    assert got.columns == ["k", "id"] and dict(map(tuple, got.collect())) == {"d": 7, "a": 3, "b": 8, "c": 9, "e": 10}


def test_only_faulty_rows_are_kept_as_text(spark, monkeypatch):
    seen = _recorded(monkeypatch, entities)
    rows = [("a", "[broken"), ("b", '["magnet:?xt=urn:btih:' + "0" * 40 + '"]'), ("c", " "), ("", "[]")]
    threads = spark.createDataFrame([(i, h, m, f"Show {i}", "movie", "") for i, (h, m) in enumerate(rows)], "id long, thread_hash string, magnet_uris string, raw_title string, type string, url string")
    _, bad, report = entities.import_legacy({"threads": threads})
    legacy = dict(seen)["legacy-threads"]
    assert legacy.filter("_fault IS NULL AND _text IS NOT NULL").count() == 0
    got = {r.key: (r.fault, r.raw) for r in bad.collect()}
    assert {k: f for k, (f, _) in got.items()} == {"a": "magnet_uris is no list", "": "no key"}
    assert '"magnet_uris":"[broken"' in got["a"][1] and '"id":3' in got[""][1]
    assert report.first().quarantined == 2


def test_repair_writes_links_twice(spark, monkeypatch):
    seen = _recorded(monkeypatch, repair)
    link = lambda n: f"magnet:?xt=urn:btih:{n:040x}"
    rows = [(i, f"old{i}", f"Show {i} (2001)", "movie", f"https://f.example.com/index.php?/forums/topic/{i // 2}-x/", [link(i), link(9)], 2001) for i in range(6)]
    threads = spark.createDataFrame(rows, "id long, thread_hash string, raw_title string, type string, url string, magnet_uris array<string>, year int")
    threads = threads.selectExpr("*", "'7' AS tmdb_id", "'linked' AS status", f"{TIMES} AS updated_at", "raw_title AS clean_title")
    canonical = spark.createDataFrame([("7", "tt7")], "tmdb_id string, canonical string")
    out = repair.repaired_threads(threads, canonical).collect()
    assert [label for label, df in seen if "magnet_uris" in df.columns] == ["keyed-threads", "repaired-threads"]
    assert sorted(sorted(int(m[-40:], 16) for m in r.magnet_uris) for r in out) == [[0, 1, 9], [2, 3, 9], [4, 5, 9]]
    assert {r.tmdb_id for r in out} == {"tt7"}


def test_links_of_a_summary_are_made_once(spark, monkeypatch):
    seen = _recorded(monkeypatch, ln)
    link = f"magnet:?xt=urn:btih:{1:040X}&dn=Show+S01E02+1080p"
    threads = spark.createDataFrame([(1, "Show", "Show (2001)", "series", link), (2, "Show", "Show (2001)", "series", "no link"), (3, "Show", "x", "movie", None)], "thread_id long, clean_title string, raw_title string, type string, magnet string")
    got = ag.link_summary(threads, spark.createDataFrame([(f"{1:040x}",)], "infohash string")).collect()
    assert [tuple(r) for r in got] == [(1, "Show", f"{1:040x}", "1080p", "en", True)]
    (label, rows), = seen
    assert label == "keyed-links" and "magnet" not in rows.columns and rows.count() == 3


def test_hash_of_a_link(spark):
    plain = "magnet:?xt=urn:btih:" + "aB" * 20 + "&dn=x" * 50
    encoded = "magnet:?xt=urn%3Abtih%3A" + "QRST" * 8
    df = spark.createDataFrame([(plain,), (encoded,), ("magnet:?dn=x",), ("",), (None,)], "m string").select(ln.infohash(F.col("m")).alias("h"))
    assert [r.h for r in df.collect()] == ["ab" * 20, "qrst" * 8, None, None, None]
    # what stands behind the hash is not run over
    assert "[\\s\\S]" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_reach_python_a_few_at_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    page = '<div class="ipsPad"><a href="magnet:?xt=urn:btih:' + "0" * 40 + '">x</a></div>'
    pages = spark.range(3).select("id", F.lit(page).alias("html"))
    assert [r.magnet_uris for r in pg.extract_links(pages).collect()] == [["magnet:?xt=urn:btih:" + "0" * 40]] * 3
    assert int(spark.conf.get(name).rstrip("b")) <= pg.BYTES_AT_ONCE
    spark.conf.unset(name)
