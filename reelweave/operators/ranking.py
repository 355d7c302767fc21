"""First-of-group, ranks, pages and picks."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import paths as pt
from reelweave.functions import regex as rx
from reelweave.functions import text as tx
from reelweave.operators import filters as fl


def latest_by_key(df: DataFrame, key: list[str], order: list[str], fold: list[str] = ()) -> DataFrame:
    """Last written row of every key; rows with an empty key part are skipped.  Combines map-side.

    Key parts in ``fold`` are compared and given in lower case.
    """
    for k in fold:
        df = df.withColumn(k, F.lower(k))
    for k in key:
        df = df.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def _rank(col: Column, ranks: dict[str, int]) -> Column:
    out = None
    for name, rank in ranks.items():
        out = F.when(col == name, rank) if out is None else out.when(col == name, rank)
    return out.otherwise(fv.OTHER_QUALITY_RANK)


def rank_by_quality(links: DataFrame) -> DataFrame:
    return links.withColumn("quality_rank", _rank(F.upper("quality"), fv.STORED_QUALITY_RANK))


def shown_quality_rank(quality: Column) -> Column:
    return _rank(F.coalesce(rx.non_empty(quality), F.lit("SD")), fv.SHOWN_QUALITY_RANK)


def rank_links(links: DataFrame, partition: list[str], position: list[str]) -> DataFrame:
    """Order links are shown in: direct before peer, quality, language, cached first, then position."""
    lang = F.lower(F.coalesce(rx.non_empty(F.col("language")), F.lit("zz")))
    df = links.withColumns({"_rank": shown_quality_rank(F.col("quality")), "_lang": lang})
    w = W.partitionBy(*partition).orderBy("is_p2p", "_rank", "_lang", F.desc("is_cached"), *position)
    return df.withColumn("shown_rank", F.row_number().over(w)).drop("_rank", "_lang")


def dedupe_links(links: DataFrame, partition: list[str], position: list[str]) -> DataFrame:
    """First link of every (quality, language, infohash), then of every shown key."""
    stored = first_seen(links, [*partition, "quality", "language", "infohash"], position)
    shown = stored.withColumns({
        "_q": F.coalesce(rx.non_empty(F.col("quality")), F.lit("SD")),
        "_l": F.lower(F.coalesce(rx.non_empty(F.col("language")), F.lit("NA"))),
    })
    keys = [*partition, "is_p2p", "_q", "_l", "infohash"]
    return first_seen(shown, keys, ["_uncached", *position] if "_uncached" in links.columns else position).drop("_q", "_l")


def assign_ids(df: DataFrame, order: list[str], id_col: str = "id", written: bool = False) -> DataFrame:
    """Rows with id 0 or null numbered after the largest id, without one global window.

    Rows are range-partitioned by the order, numbered inside their partition and
    shifted by the counts of the partitions in front.  All rows are written for it
    once; of a table that is ``written``, only the rows to be numbered.
    """
    from reelweave.session import materialize

    missing = F.coalesce(F.col(id_col), F.lit(0)) == 0
    placed = (df.filter(missing) if written else df).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "unnumbered")
    todo, df = placed.filter(missing), df if written else placed.drop("_part")
    counts = todo.groupBy("_part").count()
    shift = counts.withColumn("_before", F.sum("count").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    top = df.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("m"))
    numbered = todo.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(F.broadcast(shift), "_part")
    numbered = numbered.withColumn("_top", top.scalar()).withColumn(id_col, (F.col("_top") + F.col("_before") + F.col("_n")).cast("long"))
    return df.filter(~missing).unionByName(numbered.drop("_n", "_before", "_part", "_top"))


def pending(threads: DataFrame) -> DataFrame:
    return fl.by_status(threads, fv.PENDING).orderBy(F.desc_nulls_last("posted_at"), "thread_hash")


def recent_linked(threads: DataFrame, offset: int = 0, limit: int = 15) -> DataFrame:
    return fl.by_status(threads, fv.LINKED).orderBy(F.desc("updated_at"), "thread_hash").offset(offset).limit(limit)


def failed(failures: DataFrame, offset: int = 0, limit: int = 15) -> DataFrame:
    return failures.orderBy(F.desc("last_attempt"), "thread_hash").offset(offset).limit(limit)


def watchlist_by_update(watchlist: DataFrame) -> DataFrame:
    return watchlist.orderBy(F.desc("last_updated"), "thread_hash")


def pick_movie_file(files: DataFrame, group: str, file_id: str) -> DataFrame:
    """Largest selected video of a download, largest selected file without a video.

    One aggregate per group, combined map-side.
    """
    f = files.filter(F.col("selected") == 1)
    best = F.min(F.struct((~pt.is_video(F.col("path"), fv.MOVIE_SUFFIXES)).alias("other"), (-F.col("bytes")).alias("minus"),
                          F.col(file_id).alias(file_id), "path"))
    return f.groupBy(group).agg(best.alias("b")).select(group, f"b.{file_id}", "b.path", (-F.col("b.minus")).alias("bytes"))


#: Stands in a path's reading for the season asked for; no path names it.
_ASKED = -1


def pick_episode_file(files: DataFrame, requests: DataFrame, group: str, file_id: str) -> DataFrame:
    """File of a download that serves a requested season and episode.

    ``requests``: ``group``, season, episode.  A file that names the episode wins,
    largest first; otherwise the e-th file in natural order, unless it names
    another episode.
    """
    asked = requests.select(group, F.struct(F.col("season").alias("want_s"), F.col("episode").alias("want_e")).alias("r"))
    asked = asked.groupBy(group).agg(F.collect_set("r").alias("_asked"))
    extra, special = pt.is_extra(F.col("path")), pt.is_extra(F.col("path"), fv.EXTRA_WORDS_SPECIALS)
    c = fl.large_videos(files).join(asked, group).withColumns({"_extra": extra, "_special": special}).filter(~(F.col("_extra") & F.col("_special")))
    # a path is read once, however many requests it is held against; the season to fall back on is the one asked for, put in after
    c = pt.parse_path_twice(c, "path", _ASKED, "p_", "q_")
    c = c.withColumns({"_ranges": pt.number_ranges(F.col("path")), "_natural": tx.natural_sort_key(F.col("path")),
                       "_folders": F.transform(rx.extract_all(F.col("path"), fv.SEASON_FOLDER), rx.to_int)})
    c = c.select("*", F.inline("_asked")).filter(~F.when(F.col("want_s") == 0, F.col("_special")).otherwise(F.col("_extra")))
    p_season, q_season = (F.when(F.col(n) == _ASKED, F.col("want_s")).otherwise(F.col(n)) for n in ("p_season", "q_season"))
    covers = pt.in_ranges(F.col("_ranges"), F.col("want_e"))
    same = (((q_season == F.col("want_s")) & (F.col("q_episode") == F.col("want_e")))
            | ((p_season == F.col("want_s")) & (F.col("p_episode") == F.col("want_e")))
            | ((q_season == F.col("want_s")) & covers))
    wrong = (F.col("p_episode") != 0) & (F.col("p_episode") != F.col("want_e")) & ~covers
    fits = ~F.exists("_folders", lambda n: F.coalesce(n != F.col("want_s"), F.lit(False)))
    key = [group, "want_s", "want_e"]
    w = W.partitionBy(*key).orderBy("_natural", file_id).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = c.select(*key, file_id, "path", "bytes", "_natural", same.alias("_same"), wrong.alias("_wrong"), fits.alias("_fits"))
    c = c.withColumn("_n", F.count_if("_fits").over(w))
    nth = F.col("_fits") & (F.col("_n") == F.col("want_e")) & ~F.col("_wrong")
    row = F.struct(file_id, "path", "bytes")
    best = F.max_by(row, F.when(F.col("_same"), F.struct("bytes", (-F.col(file_id)).alias("first"))))
    out = c.groupBy(*key).agg(F.coalesce(best, F.max(F.when(nth, row))).alias("b")).filter("b IS NOT NULL")
    return out.select(group, F.col("want_s").alias("season"), F.col("want_e").alias("episode"), f"b.{file_id}", "b.path", "b.bytes")


def flag_rate_limited(events: DataFrame, key: str, ts: str, event_id: str, n: int = fv.RATE_LIMIT_EVENTS,
                      seconds: int = fv.RATE_LIMIT_SECONDS) -> DataFrame:
    """``admitted``: fewer than ``n`` admitted events in the trailing window.

    Each decision depends on earlier ones, so a run of activity is read in order.
    Runs are cut where a key was silent for a whole window, found on the (key,
    window) pairs only; a run's rows stream through in batches with at most ``n``
    times of state, never as one group in memory.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(key, event_id, micros.alias("_us")).withColumn("_slot", F.floor(F.col("_us") / (seconds * 1_000_000)))
    slots = e.select(key, "_slot").distinct()
    w = W.partitionBy(key).orderBy("_slot")
    slots = slots.withColumn("_new", F.when(F.col("_slot") - F.lag("_slot").over(w) <= 1, 0).otherwise(1))
    slots = slots.withColumn("_run", F.sum("_new").over(w)).drop("_new")
    runs = e.join(slots, [key, "_slot"]).repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", event_id)
    schema = f"{key} {dict(events.dtypes)[key]}, {event_id} {dict(events.dtypes)[event_id]}, admitted boolean"
    window = seconds * 1_000_000

    def admit(batches):
        current, kept = None, deque()
        for pdf in batches:
            flags = []
            for k, run, us in zip(pdf[key], pdf["_run"], pdf["_us"]):
                if (k, run) != current:
                    current, kept = (k, run), deque()
                while kept and kept[0] <= us - window:
                    kept.popleft()
                flags.append(len(kept) < n)
                if flags[-1]:
                    kept.append(us)
            yield pd.DataFrame({key: pdf[key], event_id: pdf[event_id], "admitted": flags})

    return runs.select(key, "_run", "_us", event_id).mapInPandas(admit, schema)
