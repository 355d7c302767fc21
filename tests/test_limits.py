"""Inputs beyond what a fixed limit would hold, and merges whose batch must win."""

from datetime import datetime

from pyspark.sql import functions as F

from reelweave.functions import identity as idn
from reelweave.functions import release as rel
from reelweave.functions import text as tx
from reelweave.operators import filters as fl
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.plans import catalog as ct
from reelweave.sources import pages as pg


def one(df):
    return [tuple(r) for r in df.collect()]


def test_brackets_nest_to_any_depth(spark):
    rows = [("x " + "(" * 8 + "1080p" + ")" * 8 + " y",), ("a (b [720p] c) d",), ("keep (this) [one]",), ("open ( 1080p",), ("a ) b (x264) c",), ("(ab)(ab 1080p)",)]
    got = [r[0] for r in one(spark.createDataFrame(rows, "t string").select(tx.strip_bracket_metadata(F.col("t"))))]
    assert got == ["x  y", "a  d", "keep (this) [one]", "open ( 1080p", "a ) b  c", "(ab)"]


def test_long_numbers_in_ids_and_keys(spark):
    ids = [("tt1:1:1234567890",), ("tt1:2:99999999999999999999",), ("tt2",), ("tt3:4:5",)]
    got = {r["id"]: (r["base_id"], r["season"], r["episode"]) for r in fl.split_request_ids(spark.createDataFrame(ids, "id string")).collect()}
    assert got["tt1:1:1234567890"] == ("tt1", 1, 1234567890)
    assert got["tt1:2:99999999999999999999"][1:] == (-1, -1)
    assert got["tt3:4:5"] == ("tt3", 4, 5)
    names = ["a" + "1" * 25, "a" + "1" * 24 + "2", "a9", "a10", "a0009"]
    keys = dict(one(spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.natural_sort_key(F.col("n")))))
    assert len({keys[n] for n in names[:2]}) == 2
    assert keys["a9"] == keys["a0009"] < keys["a10"] < keys[names[0]] < keys[names[1]]


def test_links_are_read_inside_their_block_and_in_any_quotes(spark):
    html = ("<html><h1 class='ipsType_pageTitle'>T</h1><div class=\"ipsPad\"><div><a href='magnet:?xt=a&amp;dn=x'>1</a></div><a href=magnet:?xt=b>2</a></div>"
            "<div class='footer'><a href=\"magnet:?xt=c\">3</a></div></html>")
    bare = "<div><p><a href='magnet:?xt=d'>d</a></p><a href='magnet:?xt=e'>e</a></div><a href='magnet:?xt=f'>f</a>"
    pages = spark.createDataFrame([(1, html), (2, bare), (3, None), (4, "")], "page_id int, html string")
    got = {r["page_id"]: r["magnet_uris"] for r in pg.extract_links(pages).collect()}
    assert got == {1: ["magnet:?xt=a&dn=x", "magnet:?xt=b"], 2: ["magnet:?xt=d", "magnet:?xt=e"]}


def test_listing_attributes_in_single_quotes(spark):
    html = "<h4 class='ipsDataItem_title'><span class='ipsType_break'><a href='/index.php?/topic/12-a/'>Some title</a></span></h4><time datetime='2024-01-02T03:04:05Z'>"
    page = spark.createDataFrame([("https://my_host.example.net/forums/", html)], "url string, html string")
    row = pg.extract_listings(page).first()
    assert row["raw_title"] == "Some title" and row["topic_url"].startswith("https://my_host.example.net/")


def test_hosts_stay(spark):
    urls = ["https://my_host.example.net/index.php?/topic/12-a/", "HTTP://u@h.example:8080/x y/topic/3-b|c", "/topic/9-z/"]
    got = [r[0] for r in one(spark.createDataFrame([(u,) for u in urls], "u string").select(idn.canonical_url(F.col("u"))))]
    assert got[0].startswith("https://my_host.example.net/")
    assert got[1].startswith("http://h.example:8080/")
    assert got[2].startswith(idn.DEFAULT_ORIGIN)


def test_the_batch_wins(spark):
    now = datetime(2024, 1, 1)
    cache = spark.createDataFrame([("aa", "downloading", "n1", datetime(2030, 1, 1)), ("bb", "downloaded", "n2", now)], "infohash string, status string, note string, last_checked timestamp")
    infos = spark.createDataFrame([("AA", "downloaded"), ("cc", "queued")], "infohash string, status string")
    got = {r["infohash"]: (r["status"], r["note"]) for r in mg.record_downloads(cache, infos, F.lit(now)).collect()}
    assert got == {"aa": ("downloaded", "n1"), "bb": ("downloaded", "n2"), "cc": ("queued", None)}
    stored = spark.createDataFrame([("h", "old", datetime(2030, 1, 1))], "thread_hash string, reason string, last_attempt timestamp")
    batch = spark.createDataFrame([("h", "new", now)], "thread_hash string, reason string, last_attempt timestamp")
    assert one(mg.log_failures(stored, batch).select("reason")) == [("new",)]
    assert one(mg.clear_failures(stored, batch)) == []


def test_keys_are_folded(spark):
    rows = spark.createDataFrame([("t", "AA", 1), ("t", "aa", 2)], "tmdb_id string, infohash string, seen int")
    assert one(rk.latest_by_key(rows, ["tmdb_id", "infohash"], ["seen"], fold=["infohash"])) == [("t", "aa", 2)]


def test_names_are_parsed_once(spark):
    rows = spark.createDataFrame([("Show S01E02 1080p", "series", i) for i in range(50)] + [("", "movie", 99), (None, None, 100)], "name string, type string, n int")
    once = rel.parse_distinct(rows, "name", "type", prefix="p_").orderBy("n").collect()
    each = rel.parse_releases(rows, "name", "type", prefix="p_").orderBy("n").collect()
    assert [r.asDict() for r in once] == [r.asDict() for r in each]


def test_pages_start_behind_the_skipped(spark):
    threads = spark.createDataFrame([(f"h{i:02d}", f"T{i}", "movie", "linked", "c", f"t{i}", datetime(2024, 1, 1 + i % 5), 2000) for i in range(12)], "thread_hash string, raw_title string, type string, status string, catalog string, tmdb_id string, posted_at timestamp, year int")
    meta = spark.createDataFrame([(f"t{i}", f"tt{i}", f"T{i}") for i in range(12)], "tmdb_id string, imdb_id string, title string")
    threads = threads.withColumn("status", F.lit(ct.fv.LINKED))
    every = [r["imdb_id"] for r in threads.join(meta, "tmdb_id").orderBy(F.desc("posted_at"), "thread_hash").collect()]
    for skip, k in ((0, 5), (5, 4), (12, 5), (20, 5)):
        got = {r["imdb_id"] for r in ct.catalog_page(threads, meta, skip, k).collect()}
        assert got == set(every[skip:skip + k]), (skip, k)
