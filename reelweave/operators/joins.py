"""Lookups, interval joins and keyed deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import links as ln
from reelweave.operators import ranking as rk


def id_alias(metadata: DataFrame) -> DataFrame:
    """Every id a title answers to, with its tmdb_id."""
    ids = F.array_distinct(F.filter(F.array("tmdb_id", "imdb_id"), lambda i: i.isNotNull() & (i != "")))
    return metadata.select(F.explode(ids).alias("alias"), "tmdb_id").groupBy("alias").agg(F.min("tmdb_id").alias("tmdb_id"))


def resolve_ids(df: DataFrame, metadata: DataFrame, id_col: str) -> DataFrame:
    """``df`` with the stored tmdb_id and imdb_id of an id of either kind."""
    alias = id_alias(metadata).join(metadata.select("tmdb_id", "imdb_id", F.col("year").alias("meta_year")), "tmdb_id")
    return df.join(alias.withColumnsRenamed({"alias": id_col}), id_col)


def catalog_rows(threads: DataFrame, metadata: DataFrame) -> DataFrame:
    known = metadata.filter(F.coalesce(F.col("imdb_id"), F.lit("")) != "").select("tmdb_id", "imdb_id")
    return threads.join(known, "tmdb_id")




def episode_links(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """Streams that serve a requested (tmdb_id, season, episode).

    The season is part of the key where a stream has one, so a hot title spreads
    over its seasons; only the episode interval is a residual condition.  Streams
    of no season serve every request of their title.
    """
    r = requests.select("tmdb_id", F.col("season").alias("req_season"), F.col("episode").alias("req_episode"))
    s = streams.withColumnRenamed("tmdb_id", "_id")
    seasonal = s.filter(F.col("season").isNotNull())
    covers = (F.col("episode").isNull() | (F.col("episode_end").isNull() & (F.col("episode") == F.col("req_episode")))
              | F.col("req_episode").between(F.col("episode"), F.col("episode_end")))
    a = r.join(seasonal, (r.tmdb_id == seasonal["_id"]) & (r.req_season == seasonal.season) & covers)
    whole = s.filter(F.col("season").isNull() & F.col("episode").isNull())
    b = r.join(whole, r.tmdb_id == whole["_id"])
    return a.unionByName(b).drop("_id")


def title_links(requests: DataFrame, streams: DataFrame) -> DataFrame:
    return requests.select("tmdb_id").distinct().join(streams, "tmdb_id")


def with_watch_status(threads: DataFrame, watchlist: DataFrame) -> DataFrame:
    status = watchlist.select("thread_hash", F.col("status").alias("watch_status"))
    return threads.join(status, "thread_hash", "left").withColumn("watch_status", F.coalesce("watch_status", F.lit("none")))


def with_lock_flag(links: DataFrame, locks: DataFrame) -> DataFrame:
    held = locks.select(F.lower("infohash").alias("_h")).distinct().withColumn("is_locked", F.lit(True))
    return links.join(held, F.lower(links["infohash"]) == F.col("_h"), "left").drop("_h").withColumn(
        "is_locked", F.coalesce("is_locked", F.lit(False)))


def with_availability(links: DataFrame, provider_status: DataFrame, download_cache: DataFrame) -> DataFrame:
    """``is_cached``: the provider says so, or the download cache holds it finished."""
    said = provider_status.groupBy(F.lower("infohash").alias("_h")).agg(F.bool_or("cached").alias("_said"))
    kept = download_cache.filter(F.col("status") == "downloaded").select(F.lower("infohash").alias("_h")).distinct().withColumn(
        "_kept", F.lit(True))
    flags = said.join(kept, "_h", "full")
    key = F.lower(links["infohash"])
    return links.join(flags, key == F.col("_h"), "left").withColumn(
        "is_cached", F.coalesce("_said", F.lit(False)) | F.coalesce("_kept", F.lit(False))).drop("_h", "_said", "_kept")


def with_display_name(links: DataFrame, link_cache: DataFrame) -> DataFrame:
    # the order holds the link, so it moves once
    names = link_cache.filter(F.coalesce("infohash", F.lit("")) != "").groupBy("infohash").agg(F.max(F.struct("created_at", "magnet")).alias("m"))
    names = names.select("infohash", ln.display_name(F.col("m.magnet")).alias("display_name"))
    return links.join(names, "infohash", "left").withColumn("display_name", F.coalesce("display_name", F.lit("")))


def orphaned_index_rows(index: DataFrame, threads: DataFrame) -> DataFrame:
    return index.join(threads.select("thread_hash"), "thread_hash", "left_anti")


def split_brain_links(metadata: DataFrame, streams: DataFrame) -> DataFrame:
    """Streams still kept under a title's own id although it has a canonical ``tt`` id."""
    moved = metadata.filter(F.startswith("imdb_id", F.lit("tt")) & (F.col("imdb_id") != F.col("tmdb_id"))).select("tmdb_id", "imdb_id")
    return streams.join(moved, "tmdb_id")


def canonicalize_ids(df: DataFrame, metadata: DataFrame) -> DataFrame:
    canonical = metadata.filter(F.startswith("imdb_id", F.lit("tt"))).groupBy("tmdb_id").agg(F.min("imdb_id").alias("_tt"))
    return df.join(canonical, "tmdb_id", "left").withColumn("tmdb_id", F.coalesce("_tt", "tmdb_id")).drop("_tt")


def unshared_ids(threads: DataFrame, victims: DataFrame) -> DataFrame:
    """tmdb_ids of deleted threads that no remaining thread holds."""
    kept = threads.join(victims.select("thread_hash"), "thread_hash", "left_anti")
    held = kept.filter(F.col("tmdb_id").isNotNull()).select("tmdb_id").distinct()
    gone = threads.join(victims.select("thread_hash"), "thread_hash", "left_semi").filter(F.col("tmdb_id").isNotNull())
    return gone.select("tmdb_id").distinct().join(held, "tmdb_id", "left_anti")


def cascade_delete(threads: DataFrame, streams: DataFrame, watchlist: DataFrame, victims: DataFrame):
    """Threads, streams and watch list without the victims and what only they held."""
    hashes = victims.select("thread_hash").distinct()
    return (threads.join(hashes, "thread_hash", "left_anti"),
            streams.join(unshared_ids(threads, hashes), "tmdb_id", "left_anti"),
            watchlist.join(hashes, "thread_hash", "left_anti"))


def _title_ids(metadata: DataFrame, asked: DataFrame, id_col: str) -> DataFrame:
    """(asked id, every id of that title)."""
    found = resolve_ids(asked.select(id_col).distinct(), metadata, id_col)
    ids = F.array_distinct(F.filter(F.array("tmdb_id", "imdb_id"), lambda i: i.isNotNull() & (i != "")))
    return found.select(id_col, F.explode(ids).alias("any_id"))


def purge_title(threads: DataFrame, streams: DataFrame, watchlist: DataFrame, metadata: DataFrame, asked: DataFrame, id_col: str):
    """All four tables without the asked titles and everything kept under either of their ids."""
    ids = _title_ids(metadata, asked, id_col).select(F.col("any_id").alias("tmdb_id")).distinct()
    victims = threads.join(ids, "tmdb_id", "left_semi").select("thread_hash")
    t, s, w = cascade_delete(threads, streams, watchlist, victims)
    m = metadata.join(ids, "tmdb_id", "left_anti")
    return t, s.join(ids, "tmdb_id", "left_anti"), w, m


def purge_preview(threads: DataFrame, streams: DataFrame, metadata: DataFrame, asked: DataFrame, id_col: str) -> DataFrame:
    """Per asked id: tmdb_id, shown title, number of threads and of streams a purge would remove."""
    found = resolve_ids(asked.select(id_col).distinct(), metadata, id_col)
    ids = _title_ids(metadata, asked, id_col).withColumnRenamed("any_id", "_any")
    t = ids.join(threads, ids["_any"] == threads["tmdb_id"]).groupBy(id_col).agg(
        F.count("*").alias("threads"), F.min(F.struct("thread_hash", "clean_title"))["clean_title"].alias("title"))
    s = streams.join(found.select("tmdb_id").distinct(), "tmdb_id", "left_semi").groupBy("tmdb_id").agg(F.count("*").alias("streams"))
    out = found.join(t, id_col, "left").join(s, "tmdb_id", "left")
    return out.select(id_col, "tmdb_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Linked Title")).alias("title"),
                      F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("streams", F.lit(0)).alias("streams"))


def relink_cleanup(streams: DataFrame, relinked: DataFrame) -> DataFrame:
    """Streams without the (old id, hash) pairs of threads that moved to another id.

    ``relinked``: old_id, new_id, magnet.
    """
    moved = relinked.filter((F.coalesce("old_id", F.lit("")) != "") & (F.col("old_id") != F.col("new_id")))
    pairs = moved.select(F.col("old_id").alias("tmdb_id"), ln.infohash(F.col("magnet")).alias("_h")).filter(
        F.col("_h").isNotNull()).distinct()
    return streams.join(pairs, (streams["tmdb_id"] == pairs["tmdb_id"]) & (F.lower(streams["infohash"]) == pairs["_h"]), "left_anti")


def first_thread_per_title(threads: DataFrame) -> DataFrame:
    """tmdb_id to the linked thread written last."""
    linked = threads.filter((F.col("status") == fv.LINKED) & F.col("tmdb_id").isNotNull())
    return linked.groupBy("tmdb_id").agg(F.max_by("thread_hash", F.struct("updated_at", "thread_hash")).alias("thread_hash"))
