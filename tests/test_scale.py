"""Work that must spread over the cores, and patterns that must stay cheap."""

import random

import pytest
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import links as ln
from reelweave.functions import paths as pt
from reelweave.functions import regex as rx
from reelweave.functions import text as tx
from reelweave.operators import filters as fl
from reelweave.operators import joins as jn
from reelweave.operators import ranking as rk
from reelweave.plans import catalog as ct
from reelweave.workload.fixtures import fixture


def test_threads_of_one_file_are_spread(spark, tmp_path):
    spark.range(50).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("lineitem", "events", "documents", "pages"):
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(str(tmp_path / "lineitem.parquet")).createOrReplaceTempView("lineitem")
    threads = fixture(spark, str(tmp_path), "fx_threads")
    assert threads.count() == 50
    assert threads.select(F.spark_partition_id().alias("p")).distinct().count() >= min(8, spark.sparkContext.defaultParallelism)


def test_boundary_is_one_look_where_a_word_is_sure():
    assert rx.to_java(r"(?i)\b(?:tamil|tam)\b") == r"(?i)(?=[tT])(?<!\w)(?:tamil|tam)(?!\w)"
    assert rx.to_java(r"\b(?:ep)?\s*(\d+)?\b").count("(?<=") == 2


@pytest.mark.parametrize("pattern", [fv.FORUM_BOUNDARY, fv.DAILY_DATE, fv.CHANNEL_TEXT, fv.LOOSE_RANGE, fv.EPISODE_TOKEN, fv.ORPHAN_TAIL, fv.AUDIO_CODECS[0][0], r"(?i)\b[\w.]+-[a-z]\b", r"\b_\w\b"])
def test_boundary_matches_as_before(spark, pattern):
    rng = random.Random(7)
    parts = ["s01", "EP", "e5", " ", "-", "_", "1", "2019", "0503", "dd+", "ddp", "5.1", "Day 3", "TRUE", "4K", ".", "(", ")", "é", "K", "ſ", "tamil", "720P"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 6))),) for _ in range(400)]
    # every boundary looked at from both sides
    plain = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))".join(rx.to_java(p) for p in pattern.split(r"\b")) if "(?i)" not in pattern else None
    texts = spark.createDataFrame(rows, "t string")
    flagged = "(?i)" + "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))".join(rx.to_java(p) for p in pattern.replace("(?i)", "").split(r"\b")) if plain is None else plain
    got = texts.filter(~rx.extract_all(F.col("t"), pattern, 0).eqNullSafe(F.regexp_extract_all("t", F.lit(flagged), F.lit(0))))
    assert got.count() == 0


def test_name_behind_a_long_head(spark):
    long = "magnet:?xt=urn:btih:" + "d" * 50_000 + "&dn=a+b&tr=dn=c"
    rows = [(long,), ("dn=x&y",), ("xdn=x&dn=y",), ("a?dn=",), ("ddn=q",), ("?d&dn=k",), ("p &nbsp;&dn=m n",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string").select(ln.raw_name(F.col("m"))).collect()]
    assert got == ["a+b", "x", "", "", "", "k", "m n", None]


def test_links_are_looked_up_before_requests_multiply_them(spark, monkeypatch):
    streams = spark.createDataFrame([("7", f"{i:040x}", "1080p", "en", i, 1, None, None) for i in range(6)],
                                    "tmdb_id string, infohash string, quality string, language string, link_id long, season int, episode int, episode_end int")
    requests = spark.createDataFrame([(f"{base}:1:{e}",) for base in ("7", "tt7") for e in range(1, 11)], "id string")
    metadata = spark.createDataFrame([("7", "tt7", 2000)], "tmdb_id string, imdb_id string, year int")
    threads = spark.createDataFrame([("h", "7", "linked", 1, "series", "Show (2000)", "Show", 2000)],
                                    "thread_hash string, tmdb_id string, status string, updated_at long, type string, raw_title string, clean_title string, year int")
    said = spark.createDataFrame([(f"{i:040X}", i % 2 == 0) for i in range(4)], "infohash string, cached boolean")
    kept = spark.createDataFrame([(f"{5:040x}", "downloaded"), (f"{3:040x}", "error")], "infohash string, status string")
    cache = spark.createDataFrame([], "infohash string, magnet string, created_at timestamp")
    met, looked_up = [], jn.with_availability
    monkeypatch.setattr(jn, "with_availability", lambda links, *more: met.append(links.count()) or looked_up(links, *more))
    rows = ct.links_for_request(requests, metadata, threads, streams, said, kept, cache).collect()
    assert met == [6]
    shown = {}
    for r in sorted(rows, key=lambda r: (r.id, r.shown_rank)):
        shown.setdefault(r.id, []).append((int(r.infohash, 16), r.is_cached))
    assert len(shown) == 20 and all(v == [(0, True), (2, True), (5, True), (1, False), (3, False), (4, False)] for v in shown.values())


def test_titles_of_links_are_compared_once(spark, monkeypatch):
    name = lambda n, s, t: (f"magnet:?xt=urn:btih:{n:040x}{s}", "movie", t, "Quiet Hill")
    rows = [name(n, "&dn=Red+River+2001+1080p", "Red River") for n in range(9)] + [name(n, "&dn=Blue+Zoo+Omega+1999+720p", "Red River") for n in range(9, 12)]
    rows += [name(12, "", "Red River"), (None, "movie", "Red River", None), name(13, "&dn=Blue+Zoo+Omega+1999+720p", "Blue Zoo Omega")]
    met, add = [], tx.add_dice
    monkeypatch.setattr(tx, "add_dice", lambda df, *more: met.append(df.count()) or add(df, *more))
    links = spark.createDataFrame(rows, "link string, type string, a string, b string")
    got = fl.drop_divergent_links(links, "link", "type", ["a", "b"])
    assert got.columns == ["link", "type", "a", "b", "infohash", "display_name", "stripped_link"]
    assert sorted(-1 if r.infohash is None else int(r.infohash, 16) for r in got.collect()) == [-1, *range(9), 12, 13]
    assert met == [3, 3]


def test_paths_are_read_once_for_all_requests(spark):
    mb = 1 << 20
    files = [(1, 1, "a/Show S01E03.mkv", 30 * mb), (1, 2, "a/Show S01 EP (04-06).mkv", 40 * mb), (1, 3, "a/Show S01E03.mp4", 50 * mb), (1, 4, "a/sample S01E04.mkv", 60 * mb),
             (2, 1, "Season 1/x b.mkv", 30 * mb), (2, 2, "Season 1/x a.mkv", 30 * mb), (2, 3, "Season 2/x 0.mkv", 30 * mb), (3, 1, "Special 01.mkv", 30 * mb), (3, 2, "Special 01.srt", 30 * mb),
             (4, 1, "no request 1.mkv", 30 * mb)]
    asked = [(1, 1, 3), (1, 1, 5), (1, 1, 5), (1, 2, 9), (2, 1, 2), (3, 0, 1), (3, 1, 1), (5, 1, 1)]
    got = rk.pick_episode_file(spark.createDataFrame(files, "t bigint, f bigint, path string, bytes bigint"), spark.createDataFrame(asked, "t bigint, season int, episode int"), "t", "f")
    # 5 of a range, the second in natural order, and a special for season 0 only
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 1, 3, 3), (1, 1, 5, 2), (2, 1, 2, 1), (3, 0, 1, 1)]
    one = pt.path_reading(F.col("id").cast("string"), F.lit(1))
    count = (lambda df: df._jdf.queryExecution().optimizedPlan().toString().count(rx.to_java(fv.PATH_S_E_RANGE)))
    assert count(got) <= 2 * count(spark.range(1).select(one))  # as written and with canonical tokens


def test_ranges_of_no_path_are_unknown(spark):
    df = spark.createDataFrame([(None,), ("a/1-5.mkv",), ("1-5/a.mkv",), ("a\\3 To 4",), ("1.2-5",)], "p string")
    assert [r[0] for r in df.select(pt.covers_episode(F.col("p"), F.lit(4))).collect()] == [None, True, False, True, False]
