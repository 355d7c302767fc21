"""Hand-worked rows for the parsers."""

import pytest
from pyspark.sql import functions as F

from reelweave.functions import links, paths, release
from reelweave.functions import text as tx
from reelweave.operators import aggregates as ag
from reelweave.sources import entities, pages


@pytest.mark.parametrize("title,kind,want", [
    ("Tom & Jerry (2021) 1080p WEB-DL", "movie", dict(clean_title="Tom", year=2021, resolution="1080p", source="WEB-DL", release_group="DL")),
    ("Show (2023) S01E02 1080p", "series", dict(season=1, is_season_pack=True, episode_count=0)),
    ("Show (2023) S01 EP02 1080p", "series", dict(season=1, episode_start=2, episode_end=2, is_season_pack=False)),
    ("Show (2023) S01 EP (01-08) 1080p", "series", dict(season=1, episode_start=1, episode_end=8, episode_count=8)),
])
def test_release_rows(spark, title, kind, want):
    row = release.parse_releases(spark.createDataFrame([(title, kind)], ["t", "type"]), "t", "type").first().asDict()
    assert {k: row[k] for k in want} == want


def test_titles(spark):
    df = spark.createDataFrame([("Boys, The",), ("The Boys",), ("A  [x] & b",)], ["t"])
    assert [r[0] for r in tx.normalize_titles(df, "t").select("norm_title").collect()] == ["boys the", "boys", "x and b"]


def test_nested_metadata_brackets(spark):
    df = spark.createDataFrame([("(1080p) [x (1080p)] keep (a) [b (c)]",), ("(( open 720p)",)], ["t"])
    assert [r[0] for r in df.select(tx.strip_bracket_metadata(F.col("t"))).collect()] == ["  keep (a) [b (c)]", "("]


def test_media_type(spark):
    df = spark.createDataFrame([("tv",), ("Show",), ("",), ("anime",)], ["t"])
    assert [r[0] for r in df.select(tx.normalize_media_type(F.col("t"))).collect()] == ["series", "series", "movie", "movie"]


def test_nameless_link(spark):
    df = spark.createDataFrame([("magnet:?xt=urn:btih:" + "A" * 40, "movie"), ("no link", "movie")], ["l", "type"])
    rows = links.parse_links(df, "l", "type").select("kind", "quality", "language", "infohash").collect()
    assert [tuple(r) for r in rows] == [("SINGLE_EPISODE", "sd", "ta", "a" * 40)]


def test_paths(spark):
    df = spark.createDataFrame([("a/Show.S01E04.mkv",), ("Show 1x01-03.mp4",), ("x 2019.avi",), ("Movie 1.5-8 v.mkv",)], ["p"])
    got = paths.parse_file_paths(df, "p", 7).withColumn("c", paths.covers_episode(F.col("p"), F.lit(6))).collect()
    assert [(r.season, r.episode, r.episode_end, r.c) for r in got] == [
        (1, 4, 0, False), (1, 1, 3, False), (7, 0, 0, False), (7, 5, 8, False)]


def test_link_union_keeps_order(spark):
    df = spark.createDataFrame([(["b", "", "c"], ["a", "b"])], ["n", "o"])
    assert df.select(ag.merge_links(F.col("n"), F.col("o"))).first()[0] == ["b", "c", "a"]


def test_natural_order(spark):
    df = spark.createDataFrame([("E10",), ("e2",), ("E02b",)], ["p"])
    assert [r.p for r in df.orderBy(tx.natural_sort_key(F.col("p"))).collect()] == ["e2", "E02b", "E10"]


EPISODE_TEXTS = ["S02 EP (03-09)", "S02 EP03", "12-14 x", "abc 12-13", "1-2000 3-4", "EP 5-3 7-9", "2019-03-04", "a 2019.12.31b", "x 105 y", "E00-E02 E7", "s1 e2 to 4 x", "1 - 2\n3-4", "", None]


def test_episode_texts_are_read_once_a_pattern(spark):
    # the readings of each text, worked out by the patterns one by one
    from reelweave import fixed_values as fv
    from reelweave.functions import regex as rx
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EPISODE_TEXTS)], "i int, t string")
    got = {r.i: r.e for r in release.add_readings(df, "t", "e").collect()}
    text = F.col("t")
    want = df.select("i", *[rx.to_int(rx.extract(text, p, g)).alias(n) for n, p, g in (
        ("lo", fv.EPISODE_RANGE, 1), ("hi", fv.EPISODE_RANGE, 2), ("single", fv.EPISODE_SINGLE, 1), ("century", fv.DAILY_DATE, 1),
        ("month", fv.DAILY_DATE, 2), ("bare", fv.BARE_EPISODE, 1))], rx.extract_all(text, fv.LOOSE_RANGE, 1).alias("a"), rx.extract_all(text, fv.LOOSE_RANGE, 2).alias("b"))
    for r in want.collect():
        e = got[r.i]
        if EPISODE_TEXTS[r.i] is None:
            assert e is None
            continue
        assert (e.explicit.lo, e.explicit.hi, e.single, e.century, e.month, e.bare) == (r.lo, r.hi, r.single, r.century, r.month, r.bare)
        loose = next(((int(a), int(b)) for a, b in zip(r.a, r.b) if int(a) < 1000 and int(b) < 1000 and int(a) <= int(b)), None)
        assert (e.loose and tuple(e.loose)) == (None if r.lo is not None and r.hi is not None and r.lo <= r.hi else loose)
    parsed = release.parse_releases(spark.createDataFrame([("Show S01", "series")], "t string, type string"), "t", "type")
    plan = parsed.select("season", "episode_count")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rx.to_java(fv.EPISODE_SINGLE)) == 2  # the remainder and the raw name, once each


def test_trim_takes_every_space(spark):
    from reelweave.functions import regex as rx
    spaces = "\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    df = spark.createDataFrame([(spaces + "a" + spaces + "\u200bb" + spaces,), (spaces,), ("",), (None,), ("\u200b a",)], "t string")
    assert [r[0] for r in df.select(rx.trim_space(F.col("t"))).collect()] == ["a" + spaces + "\u200bb", "", "", None, "\u200b a"]
    plan = df.select(rx.trim_space(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_link_summary_reads_no_title_a_link_does_not_need(spark):
    magnet = "magnet:?xt=urn:btih:" + "a" * 40
    rows = [(1, magnet, "movie", "Red Widget (2001) 1080p", ""), (2, magnet, "movie", "Green (2002)", "Kept"), (3, magnet, None, None, None), (4, magnet, "series", "Red Widget (2001) 1080p", None)]
    t = spark.createDataFrame(rows, "thread_id int, magnet string, type string, raw_title string, clean_title string")
    out = ag.link_summary(t, spark.createDataFrame([], "infohash string"))
    assert {r.thread_id: r.label for r in out.collect()} == {1: "Red Widget", 2: "Kept", 3: None, 4: "Red Widget"}
    # titles are read above an aggregate that makes them distinct, never in a link's own row
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_unnamed" in plan


def test_hash_and_stripped_links(spark):
    h = "AB" * 20
    given = [f"magnet:?xt=urn:btih:{h}&dn=a+b%20c&tr=x", f"x BTIH:{h}\nbtih:{'0' * 40}", "magnet:?xt=urn%3Abtih%3AXyZ&dn=q", "magnet:?xt=urn:btih:", "", None]
    df = spark.createDataFrame([(given,)], "l array<string>")
    assert [r[0] for r in df.select(F.explode("l").alias("l")).select(links.infohash(F.col("l"))).collect()] == [h.lower(), h.lower(), "xyz", None, None, None]
    assert df.select(links.stripped_links(F.col("l"))).first()[0] == [
        f"magnet:?xt=urn:btih:{h.lower()}&dn=a+b+c", f"magnet:?xt=urn:btih:{h.lower()}", "magnet:?xt=urn:btih:xyz&dn=q", *given[3:]]


def test_legacy_threads_take_lists_and_json(spark):
    link = "magnet:?xt=urn:btih:" + "a" * 40
    rows = spark.createDataFrame([("h", "Red (2001)", "movie", "", [link + "&tr=x", link])], "thread_hash string, raw_title string, type string, url string, magnet_uris array<string>")
    as_list = entities.import_legacy_threads(rows).first()
    assert as_list.magnet_uris == [link]
    assert as_list == entities.import_legacy_threads(rows.withColumn("magnet_uris", F.to_json("magnet_uris"))).first()


def test_plain_pages_are_read_as_the_parser_reads_them(spark):
    bits = ['<a href="magnet:?x&amp;dn=a&copy=1">', "<a HREF='magnet:?y&amp;z'>", "<a href=magnet:?bare>", "</a>", '<div class="ipsPad x">', "</div>", "<article>", "</article>", "<br/>", "text & more",
            '<!-- <a href="magnet:?no"> -->', "<!doctype html>", '<script>if(a<b){"<a href=magnet:?s>"}</script>', "<title>t <b></title>", "<title>ok</title>", "<p disabled>", "<p", "a < b", '<a\nhref="magnet:?n">']

    class Slow(pages._Links):
        def _read_plain(self, page):
            return False

    for n in range(len(bits) ** 2):
        page = "".join((bits[4], bits[n % len(bits)], bits[0], bits[n // len(bits)], bits[5], bits[0]))
        assert pages._Links("magnet:?").read(page) == Slow("magnet:?").read(page), page
    assert pages._Links("magnet:?")._read_plain('<html><div class="ipsPad"><a href="magnet:?x">x</a><br><a href="magnet:?y">y</a></div></html>')


def test_recorded_downloads_move_no_other_column(spark, monkeypatch):
    from reelweave.workload import queries
    rows = [(2, "1", "aa", 1, "x"), (3, "1", "AA", 2, "y"), (4, "2", "bb", 1, "z"), (9, "2", "cc", 1, "z"), (6, "", "dd", 1, "z")]
    streams = spark.createDataFrame(rows, "link_id long, tmdb_id string, infohash string, seen_at int, quality string")
    monkeypatch.setattr(queries, "fixture", lambda *a: streams)
    assert "quality" not in queries._latest(spark, "", "link_id").columns and "quality" in queries._latest(spark, "").columns
    got = queries.record_downloads(spark, "").collect()
    assert sorted((r.infohash, r.status, r.note) for r in got) == [("aa", "downloaded", None), ("bb", "queued", 4), ("cc", "downloaded", None)]
