"""Repair, corrections by hand and bulk links on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reelweave.plans import relink, repair
from reelweave.schemas import ENTITIES

NOW, OLD = datetime(2024, 3, 1), datetime(2024, 1, 1)


def link(n, name=""):
    return f"magnet:?xt=urn:btih:{n:040x}" + (f"&dn={name}" if name else "")


def thread(n, raw, tmdb, links, kind="movie", status="linked", url=None, at=OLD, title=None):
    return {"id": n, "thread_hash": f"h{n}", "raw_title": raw, "clean_title": title or raw, "tmdb_id": tmdb, "status": status if tmdb else "pending_tmdb", "type": kind,
            "magnet_uris": links, "url": url if url is not None else f"https://forum.example.com/index.php?/forums/topic/{n}-a/", "created_at": OLD, "updated_at": at}


def table(spark, name, rows):
    fields = ENTITIES[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], ENTITIES[name])


@pytest.fixture(scope="module")
def tables(spark):
    t = [thread(1, "Red Widget (2001) 1080p", "100", [link(1, "Red.Widget.2001"), link(9, "Red.Widget.2001.2160p")]),
         thread(2, "Red Widget (2001) 1080p", "100", [link(2, "Red.Widget.2001.720p")], url="https://forum.example.com/index.php?/forums/topic/1-other/", at=NOW),
         thread(3, "Lost Planet S01 EP (01-03)", "200", [link(3, "Lost.Planet.S01E02")], "TV", title="Lost Planet"),
         thread(4, "Unknown Thing", None, [link(4)], url="https://elsewhere.example.com/x"),
         thread(5, "Blue Bolt (1990)", None, [link(5, "Blue.Bolt.1990"), link(6, "Green.Apple")])]
    s = [{"id": 1, "tmdb_id": "100", "infohash": f"{1:040x}", "quality": "1080p", "language": "en"}, {"id": 2, "tmdb_id": "100", "infohash": f"{8:040x}"},
         {"id": 3, "tmdb_id": "200", "infohash": f"{3:040x}", "season": 1, "episode": 2, "episode_end": 2, "quality": "", "language": "en"}]
    return {"threads": table(spark, "threads", t), "streams": table(spark, "streams", s),
            "tmdb_metadata": table(spark, "tmdb_metadata", [{"tmdb_id": "100", "imdb_id": "tt1", "year": 2001}, {"tmdb_id": "101", "imdb_id": "tt1", "year": 2001}, {"tmdb_id": "200", "year": 2010}]),
            "link_cache": table(spark, "link_cache", [{"infohash": "a", "magnet": "m", "created_at": OLD}, {"infohash": "b", "magnet": "m", "created_at": NOW}]),
            "failed_threads": table(spark, "failed_threads", []),
            "watchlist": table(spark, "watchlist", [{"thread_hash": "gone", "status": "active"}])}


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([("100", "tt1", "Red Widget", 2001, "movie"), ("200", None, "Lost Planet", 2010, "series"), ("300", "tt3", "Blue Bolt", 1990, "movie"), ("400", "tt4", "Red Widget", 2003, "series")],
                                 "tmdb_id string, imdb_id string, title string, year int, type string")


def kept(out):
    return {n: df.sparkSession.createDataFrame(df.collect(), df.schema) for n, df in out.items()}


def test_repair_twice_changes_nothing(tables):
    out = kept(repair.repair(tables, F.lit(NOW)))
    rows = {r["raw_title"]: r for r in out["threads"].collect()}
    assert len(rows) == 4
    red = rows["Red Widget (2001) 1080p"]
    assert red["tmdb_id"] == "tt1" and red["clean_title"] == "Red Widget" and red["magnet_uris"] == [link(2, "Red.Widget.2001.720p"), link(1, "Red.Widget.2001"), link(9, "Red.Widget.2001.2160p")]
    assert rows["Unknown Thing"]["url"] == "" and rows["Lost Planet S01 EP (01-03)"]["type"] == "series"
    assert sorted((r["tmdb_id"], int(r["infohash"], 16)) for r in out["streams"].collect()) == [("200", 3), ("tt1", 1), ("tt1", 2), ("tt1", 9)]
    ids = {int(r["infohash"], 16): r["id"] for r in out["streams"].collect()}
    assert (ids[1], ids[3]) == (1, 3) and len(set(ids.values())) == 4
    assert sorted(r["tmdb_id"] for r in out["tmdb_metadata"].collect()) == ["200", "tt1"]
    assert [r["infohash"] for r in out["link_cache"].collect()] == ["b"]
    watch = out["watchlist"].collect()
    assert len(watch) == 1 and watch[0]["thread_hash"] == rows["Lost Planet S01 EP (01-03)"]["thread_hash"]
    report = {(r["table_name"], r["change"]) for r in repair.dry_run(tables, out).collect()}
    assert ("threads", "added") in report and ("watchlist", "removed") in report and ("link_cache", "removed") in report
    again = repair.repair(out, F.lit(NOW))
    assert repair.dry_run(out, again).collect() == []
    assert sorted(map(str, again["threads"].collect())) == sorted(map(str, out["threads"].collect()))
    assert sorted(map(str, again["streams"].collect())) == sorted(map(str, out["streams"].collect()))


def test_corrections_in_order(spark, tables, reference):
    asked = spark.createDataFrame([(1, 1, "400"), (2, 1, "series:tt4"), (3, 1, "100"), (4, 5, "series:tt3"), (5, 5, "tt3"), (6, 99, "tt3"), (7, 3, "tt999"), (8, 2, "movie:100")], "seq int, thread_id bigint, official_id string")
    out = kept(relink.apply_link_corrections(tables, asked, reference, F.lit(NOW)))
    outcomes = {r["seq"]: r["outcome"] for r in out["outcomes"].collect()}
    # the third is refused as the second made the thread a series
    assert outcomes == {1: "type differs", 2: "linked", 3: "type differs", 4: "type differs", 5: "linked", 6: "no such thread", 7: "no such title", 8: "linked"}
    rows = {r["id"]: r for r in out["threads"].collect()}
    assert (rows[1]["tmdb_id"], rows[1]["type"], rows[1]["year"], rows[1]["clean_title"]) == ("400", "series", 2003, "Red Widget")
    assert (rows[5]["tmdb_id"], rows[5]["status"], rows[5]["clean_title"]) == ("300", "linked", "Blue Bolt")
    found = {(r["tmdb_id"], int(r["infohash"], 16)) for r in out["streams"].collect()}
    # thread 1 takes its own links along, those of others stay; a link of another title gets no row
    assert found == {("400", 1), ("400", 9), ("100", 8), ("100", 2), ("200", 3), ("300", 5)}
    assert {"400", "300", "100"} <= {r["tmdb_id"] for r in out["tmdb_metadata"].collect()}
    assert len(rows) == 5 and {r["thread_hash"] for r in out["watchlist"].collect()} == {"gone", "h1"}


def test_bulk_links(spark, tables, reference):
    out = kept(relink.auto_link(tables, spark.createDataFrame([(4,), (5,), (77,)], "thread_id bigint"), reference, F.lit(NOW)))
    assert {r["thread_id"]: r["ref_id"] for r in out["results"].collect()} == {4: None, 5: "300", 77: None}
    rows = {r["id"]: r for r in out["threads"].collect()}
    assert rows[5]["status"] == "linked" and rows[4]["status"] == "pending_tmdb" and len(rows) == 5
    assert {int(r["infohash"], 16) for r in out["streams"].filter("tmdb_id = '300'").collect()} == {5}
