"""Offline repair of the stored tables, and what it would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import identity as idn
from reelweave.functions import text as tx
from reelweave.operators import aggregates as ag
from reelweave.operators import filters as fl
from reelweave.operators import joins as jn
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.session import materialize

KEYS = {"threads": ["thread_hash"], "tmdb_metadata": ["tmdb_id"], "streams": ["tmdb_id", "infohash"], "watchlist": ["thread_hash"],
        "link_cache": ["infohash"], "failed_threads": ["thread_hash"]}


def canonical_ids(metadata: DataFrame) -> DataFrame:
    """(tmdb_id, canonical): the least ``tt`` id that the aliases of an id lead to.

    Where a ``tt`` id is itself kept under another one, the walk goes on; its
    length doubles each round, and only falling ids are taken over, so it ends.
    """
    known = metadata.filter(F.startswith("imdb_id", F.lit("tt")) & (F.col("imdb_id") != F.col("tmdb_id")))
    now = materialize(known.groupBy("tmdb_id").agg(F.min("imdb_id").alias("canonical")), "id-aliases")
    while True:
        hop = now.select(F.col("tmdb_id").alias("canonical"), F.col("canonical").alias("next"))
        further = now.join(hop, "canonical", "left").select("tmdb_id", F.least("canonical", "next").alias("canonical"), F.coalesce(F.col("next") < F.col("canonical"), F.lit(False)).alias("moved"))
        further = materialize(further, "id-aliases")
        if further.filter("moved").isEmpty():
            return now
        now = further.drop("moved")


def _renamed(df: DataFrame, canonical: DataFrame) -> DataFrame:
    return df.join(canonical, "tmdb_id", "left").withColumn("tmdb_id", F.coalesce("canonical", "tmdb_id")).drop("canonical")


def repaired_metadata(metadata: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per title under its canonical id; of several the latest."""
    renamed = _renamed(metadata, canonical)
    return rk.latest_by_key(renamed, ["tmdb_id"], ["updated_at", "imdb_id", "year"]).select(*metadata.columns)


def repaired_threads(threads: DataFrame, canonical: DataFrame, default_origin: str = idn.DEFAULT_ORIGIN) -> DataFrame:
    """Threads of one identity as one row under their key, types normalised, ids canonical, urls that name no topic blanked."""
    keyed = idn.add_identity_keys(threads.withColumnRenamed("thread_hash", "_old_hash"), default_origin=default_origin)
    keyed = materialize(keyed.drop("topic_id", "canonical_url"), "keyed-threads")
    groups = keyed.groupBy("thread_hash").agg(F.count("*").alias("_n"), F.bool_or(F.col("_old_hash") != F.col("thread_hash")).alias("_moved"))
    # only the hashes are written again, not the rows with their links
    groups = materialize(groups.filter("_n > 1 OR _moved").select("thread_hash"), "merged-hashes")
    merging = keyed.join(groups, "thread_hash", "left_semi")
    merged = ag.consolidate_duplicates(merging.drop("_old_hash").withColumn("thread_id", F.col("id")), default_origin, keyed=True)
    # fields that merging has no rule for come from the latest record
    rest = [c for c in threads.columns if c not in merged.columns]
    latest = merging.withColumn("_newest", F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("newest"), "id"))
    latest = latest.groupBy("thread_hash").agg(F.min_by(F.struct(*rest), "_newest").alias("_r")).select("thread_hash", "_r.*")
    merged = merged.withColumn("magnet_uris", F.coalesce("magnet_uris", F.array().cast("array<string>")))
    merged = merged.join(latest, "thread_hash").select(*threads.columns)
    alone = keyed.join(groups, "thread_hash", "left_anti").select(*threads.columns)
    both = _renamed(merged.unionByName(alone), canonical).withColumn("type", tx.normalize_media_type(F.col("type")))
    both = both.withColumn("url", F.when(idn.topic_id(F.coalesce("url", F.lit(""))) == "", F.lit("")).otherwise(F.col("url")))
    return rk.assign_ids(materialize(both.select(*threads.columns), "repaired-threads"), ["thread_hash"], written=True)


def repair(tables: dict[str, DataFrame], as_of: Column, default_origin: str = idn.DEFAULT_ORIGIN) -> dict[str, DataFrame]:
    """All tables after the repair: ids canonical, duplicates merged, links rebuilt from the threads, rows of lost threads gone, old cache rows expired.

    A second repair at the same time changes nothing.
    """
    canonical = canonical_ids(tables["tmdb_metadata"])
    threads = repaired_threads(tables["threads"], canonical, default_origin)
    built = ag.build_links(threads.select("tmdb_id", "type", "status", "magnet_uris"))
    built = rk.latest_by_key(built, ["tmdb_id", "infohash"], ["season", "episode", "episode_end", "quality", "language"], fold=["infohash"])
    # a link that stands keeps its number and the time it was found
    stood = _renamed(tables["streams"], canonical).groupBy("tmdb_id", F.lower("infohash").alias("infohash")).agg(
        F.min("id").alias("id"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    built = built.join(stood, ["tmdb_id", "infohash"], "left").withColumns({c: F.coalesce(c, as_of) for c in ("created_at", "updated_at")})
    streams = rk.assign_ids(built, ["tmdb_id", "infohash"])
    watched = jn.orphaned_index_rows(tables["watchlist"], threads)
    watchlist = tables["watchlist"].join(watched.select("thread_hash"), "thread_hash", "left_anti")
    series = fl.by_status(threads, fv.LINKED).join(watchlist.select("thread_hash"), "thread_hash", "left_anti")
    fresh = mg.enroll_series(watchlist.limit(0), series, as_of)
    return {
        "threads": threads, "tmdb_metadata": repaired_metadata(tables["tmdb_metadata"], canonical), "streams": streams.select(*tables["streams"].columns),
        "watchlist": watchlist.unionByName(fresh, allowMissingColumns=True).select(*tables["watchlist"].columns),
        "link_cache": fl.expire(tables["link_cache"], "created_at", as_of, days=fv.LINK_CACHE_DAYS)[0],
        "failed_threads": fl.expire(tables["failed_threads"], "last_attempt", as_of, days=fv.FAILED_LOG_DAYS)[0],
    }


def dry_run(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """table_name, key, change (added, removed or changed) of every row a repair would touch, times and numbers aside."""
    rows = None
    for name, key in KEYS.items():
        if name not in after:
            continue
        values = [c for c in after[name].columns if c not in (*key, "id", "created_at", "updated_at", "last_seen", "last_checked", "last_updated")]

        def side(df: DataFrame, label: str) -> DataFrame:
            text = F.to_json(F.struct(*[F.col(c) for c in values]))
            return df.groupBy(F.concat_ws("/", *key).alias("key")).agg(F.min(text).alias(label), F.count("*").alias(f"{label}_n"))

        both = side(before[name], "was").join(side(after[name], "now"), "key", "full")
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")) | (F.col("was_n") != F.col("now_n")), "changed")
        one = both.select(F.lit(name).alias("table_name"), "key", change.alias("change")).filter("change IS NOT NULL")
        rows = one if rows is None else rows.unionByName(one)
    return rows
