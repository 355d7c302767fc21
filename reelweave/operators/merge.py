"""Keyed merges of the entity tables.

Every merge takes the stored table and a batch and returns the new table; time
is an argument, so a job can be repeated with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import text as tx
from reelweave.operators import aggregates as ag
from reelweave.operators import ranking as rk


def fold_batch(batch: DataFrame, seq: str, scalars: list[str]) -> DataFrame:
    """Rows of one hash applied in order: last scalars, last non-empty url, links newest first."""
    top = batch.groupBy("thread_hash").agg(
        F.max_by(F.struct(*scalars), seq).alias("k"),
        F.max_by("url", F.when(F.coalesce("url", F.lit("")) != "", F.col(seq))).alias("url"))
    # lists move once as they are; their links need not move again to be grouped
    rows = batch.select("thread_hash", seq, "magnet_uris").repartition("thread_hash")
    rows = rows.select("thread_hash", seq, F.posexplode("magnet_uris").alias("_pos", "_link")).filter(F.coalesce("_link", F.lit("")) != "")
    first = rows.groupBy("thread_hash", "_link").agg(F.min(F.struct((-F.col(seq)).alias("newest"), "_pos")).alias("at"))
    links = first.groupBy("thread_hash").agg(F.sort_array(F.collect_list(F.struct("at", "_link"))).alias("l")).select(
        "thread_hash", F.col("l._link").alias("magnet_uris"))
    return top.select("thread_hash", "k.*", "url").join(links, "thread_hash", "left")


def upsert_threads(target: DataFrame, batch: DataFrame, seq: str, scalars: list[str]) -> DataFrame:
    """Merge by hash: batch scalars replace, an empty url keeps the old one, links are united."""
    new = fold_batch(batch.withColumn("type", tx.normalize_media_type(F.col("type"))), seq, scalars)
    old = target.select("thread_hash", *[F.col(c).alias(f"_o_{c}") for c in [*scalars, "url", "magnet_uris"]])
    both = new.withColumn("_new", F.lit(True)).join(old, "thread_hash", "full")
    out = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in scalars]
    return both.select("thread_hash", *out, F.coalesce(F.nullif("url", F.lit("")), F.col("_o_url"), F.lit("")).alias("url"),
                       ag.merge_links(F.col("magnet_uris"), F.col("_o_magnet_uris")).alias("magnet_uris"))


def orphaned_by_relink(target: DataFrame, merged: DataFrame) -> DataFrame:
    """tmdb_ids threads moved away from that no thread holds any more; their streams go."""
    old = target.select("thread_hash", F.col("tmdb_id").alias("_old")).filter(F.col("_old").isNotNull())
    moved = old.join(merged.select("thread_hash", "tmdb_id"), "thread_hash").filter(~F.col("_old").eqNullSafe(F.col("tmdb_id")))
    return moved.select(F.col("_old").alias("tmdb_id")).distinct().join(merged.select("tmdb_id"), "tmdb_id", "left_anti")


def enroll_series(watchlist: DataFrame, threads: DataFrame, as_of: Column, force_active: bool = False) -> DataFrame:
    """Linked series added as active; known ones refreshed, their status kept."""
    t = threads.filter((tx.normalize_media_type(F.col("type")) == "series") & (F.col("thread_hash") != ""))
    t = t.select("thread_hash", F.coalesce("url", F.lit("")).alias("_url"), F.col("raw_title").alias("_raw"),
                 F.coalesce(F.nullif("clean_title", F.lit("")), F.col("raw_title")).alias("_title"), F.lit(True).alias("_hit"))
    w = watchlist.join(t, "thread_hash", "full")
    status = F.lit("active") if force_active else F.coalesce("status", F.lit("active"))
    return w.select(
        "thread_hash", F.coalesce(F.nullif("_url", F.lit("")), F.col("url"), F.lit("")).alias("url"),
        F.coalesce("_title", "title").alias("title"), F.coalesce("_raw", "raw_title").alias("raw_title"),
        F.when(F.col("_hit"), status).otherwise(F.col("status")).alias("status"),
        F.coalesce("episode_count", F.lit(0)).alias("episode_count"),
        F.when(F.col("_hit"), as_of).otherwise(F.col("last_updated")).alias("last_updated"))


def enroll_requests(watchlist: DataFrame, requests: DataFrame, threads: DataFrame, as_of: Column) -> DataFrame:
    """Threads asked for by hash (else by id) put on the list as active, with the url given."""
    by_hash = requests.select("thread_hash", "req_url").join(threads, "thread_hash")
    rest = requests.join(threads.select("thread_hash"), "thread_hash", "left_anti").select("thread_id", "req_url")
    by_id = rest.join(threads, "thread_id")
    cols = ["thread_hash", "raw_title", "clean_title", "type", "req_url", "url"]
    hit = by_hash.select(*cols).unionByName(by_id.select(*cols))
    # of several requests for a thread, the one with an url and then the smallest
    blank = F.coalesce("req_url", F.lit("")) == ""
    hit = rk.first_seen(hit.withColumn("_blank", blank), ["thread_hash"], ["_blank", "req_url", "raw_title"]).drop("_blank")
    hit = hit.withColumn("url", F.coalesce(F.nullif("req_url", F.lit("")), F.col("url")))
    return enroll_series(watchlist, hit, as_of, force_active=True)


def set_watch_status(watchlist: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Statuses of ``changes`` (thread_hash, new_status) applied to known rows; ``delete`` removes."""
    c = changes.filter((F.coalesce("thread_hash", F.lit("")) != "") & F.col("new_status").isin([*fv.WATCH_STATUSES, "delete"]))
    w = watchlist.join(c, "thread_hash", "left").filter(F.coalesce("new_status", F.lit("")) != "delete")
    hit = F.col("new_status").isNotNull()
    return w.withColumns({"status": F.coalesce("new_status", "status"),
                          "last_updated": F.when(hit, as_of).otherwise(F.col("last_updated"))}).drop("new_status")


def watch_changes_count(watchlist: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes counted: every delete, and every status set on a known row."""
    c = changes.filter(F.coalesce("thread_hash", F.lit("")) != "").join(
        watchlist.select("thread_hash", F.lit(True).alias("_known")), "thread_hash", "left")
    return c.agg(F.count_if((F.col("new_status") == "delete") | F.coalesce("_known", F.lit(False))).alias("updated"))


def archive_inactive(watchlist: DataFrame, as_of: Column, days: int = fv.WATCH_INACTIVE_DAYS) -> DataFrame:
    stale = (F.col("status") == "active") & (F.col("last_updated") < as_of - F.make_dt_interval(F.lit(days)))
    return watchlist.withColumn("status", F.when(stale, "archived").otherwise(F.col("status")))


def log_failures(failures: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch replaces what is stored, whatever its time; of its own rows the latest counts."""
    both = failures.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return rk.latest_by_key(both, ["thread_hash"], ["_batch", "last_attempt"]).drop("_batch")


def clear_failures(failures: DataFrame, done: DataFrame) -> DataFrame:
    return failures.join(done.select("thread_hash"), "thread_hash", "left_anti")


def apply_custom_meta(threads: DataFrame, corrections: DataFrame) -> DataFrame:
    """Posters and descriptions set by hand; a blank one clears the field."""
    def blank_to_null(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c))

    c = corrections.select("thread_id", F.lit(True).alias("_hit"), blank_to_null("poster").alias("_p"), blank_to_null("description").alias("_d"))
    hit = F.coalesce("_hit", F.lit(False))
    return threads.join(c, "thread_id", "left").withColumns({
        "custom_poster": F.when(hit, F.col("_p")).otherwise(F.col("custom_poster")),
        "custom_description": F.when(hit, F.col("_d")).otherwise(F.col("custom_description")),
    }).drop("_hit", "_p", "_d")


def record_downloads(cache: DataFrame, infos: DataFrame, as_of: Column) -> DataFrame:
    """The fields of ``infos`` taken over, the others kept; a touched row counts as checked now.

    Of rows of one hash the greatest counts (by ``seq`` first, where there is one).
    """
    fields = [c for c in infos.columns if c not in ("infohash", "last_checked", "seq")]
    order = ["seq", *fields] if "seq" in infos.columns else fields
    new = rk.latest_by_key(infos, ["infohash"], order, fold=["infohash"]).select("infohash", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in fields])
    old = cache.withColumn("infohash", F.lower("infohash")).join(new, "infohash", "full")
    hit = F.coalesce("_hit", F.lit(False))
    kept = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields if c in cache.columns}
    return old.withColumns({**kept, "last_checked": F.when(hit, as_of).otherwise(F.col("last_checked"))}).select(*cache.columns)
