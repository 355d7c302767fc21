"""Pages to tables in two batches, with a crash between, against one batch; repair, corrections and the match index."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reelweave.plans import ingest as ig
from reelweave.sources.store import Store
from reelweave.streaming import intake
from reelweave.workload.ingest_queries import long_form

NOW = datetime(2024, 3, 1)
PAGES = "page_id bigint, url string, html string"


def page(n, title, links, site="https://forum.example.com"):
    body = "".join(f"<a href='{m}'>x</a>" for m in links)
    return n, f"{site}/index.php?/forums/topic/{n}-x/", f"<html><h1 class='ipsType_pageTitle'>{title}</h1><div class='ipsPad'>{body}</div></html>"


def magnet(n, name):
    return f"magnet:?xt=urn:btih:{n:040x}&amp;dn={name}&amp;tr=x"


FIRST = [page(1, "Red Widget (2001) 1080p WEB-DL", [magnet(1, "Red.Widget.2001.1080p"), magnet(2, "Green.Apple.1999.720p")]),
         page(2, "Lost Planet S01 EP (01-03) 720p", [magnet(3, "Lost.Planet.S01E02.720p")]), page(3, "1080p", [magnet(4, "x")]),
         (4, "https://forum.example.com/index.php?/forums/topic/4-x/", "cloudflare captcha <a href='magnet:?xt=urn:btih:00'>x</a>")]
SECOND = [page(1, "Red Widget (2001) 4K BluRay", [magnet(5, "Red.Widget.2001.2160p")]), page(5, "Unknown Thing Nobody Knows (1950)", [magnet(6, "Unknown.Thing.1950")])]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame([("100", "tt100", "Red Widget", 2001, "movie"), ("200", None, "The Lost Planet", 2010, "series"), ("300", "tt300", "Blue Bolt", 1990, "movie")],
                                 "tmdb_id string, imdb_id string, title string, year int, type string")


ROUTES = [("https://forum.example.com/index.php?/forums/topic/2", "series", "shows")]


def drop(spark, rows, path):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(path)


def test_two_drops_a_crash_and_a_rerun(spark, tmp_path, reference, monkeypatch):
    store, inbox = Store(spark, f"{tmp_path}/store"), f"{tmp_path}/in"

    def run():
        pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(inbox)
        intake.stream_ingest(pages, store, reference, ROUTES, F.lit(NOW))

    def tables(version=None):
        return {(r.t, r.k): r.v for r in long_form({t: store.read(t, version) for t in intake.TABLES}).collect()}

    real, calls = ig.ingest_tables, []

    def broken(*args):  # fails when the third table is written
        out = real(*args)
        calls.append(1)
        third = list(out)[2]
        return out | {third: out[third].withColumn("id", F.raise_error(F.lit("executor lost")).cast("bigint"))}

    drop(spark, FIRST, inbox)
    monkeypatch.setattr(ig, "ingest_tables", broken)
    with pytest.raises(Exception):  # noqa: B017  (the streaming query's)
        run()
    assert calls and store.versions() == [] and tables() == {}
    monkeypatch.setattr(ig, "ingest_tables", real)
    drop(spark, SECOND, inbox)
    run()  # the first batch again, then the second
    run()  # nothing new: nothing happens
    assert store.versions() == [1, 2]
    before = tables(1)
    assert sorted(v.split("|")[1] for (t, _), v in before.items() if t == "threads") == ["Red Widget", "The Lost Planet"]
    assert [v for (t, _), v in before.items() if t == "failed_threads"]
    assert len([k for t, k in before if t == "streams"]) == 2  # the link of another title is left out
    got = tables()
    red = next(v for (t, _), v in got.items() if t == "threads" and "Red Widget" in v)
    assert red.startswith("Red Widget (2001) 4K BluRay|Red Widget|2001|100|linked|movie|")
    assert f"{5:040x}" in red and f"{1:040x}" in red and f"{2:040x}" not in red
    assert {r["decision"] for r in store.read("changes").filter("batch = 1").collect()} == {"updated", "pending"}
    ids = [r[0] for r in store.read("threads").select("id").collect()]
    assert len(set(ids)) == len(ids) == 3


def test_watched_pages_join_the_index(spark):
    index, watched = spark.createDataFrame(FIRST[:1], PAGES), spark.createDataFrame(FIRST[1:2], PAGES)
    rows = {r["type"]: r["posted_at"] for r in intake.batch_rows(intake.both_crawls(index, watched, F.lit(NOW)), ROUTES).collect()}
    assert rows == {"movie": None, "series": NOW}
