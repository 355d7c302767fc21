"""Counts, merges and nested views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import forum
from reelweave.functions import identity as idn
from reelweave.functions import links as ln
from reelweave.functions import regex as rx
from reelweave.functions import release as rel
from reelweave.functions import text as tx
from reelweave.operators import joins as jn
from reelweave.operators import ranking as rk
from reelweave.session import materialize


def status_counts(threads: DataFrame, failures: DataFrame) -> DataFrame:
    counts = threads.agg(F.count_if(F.col("status") == fv.LINKED).alias("linked"),
                         F.count_if(F.col("status") == fv.PENDING).alias("pending"))
    return counts.withColumn("failed", failures.agg(F.count("*")).scalar())


def reconcile_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows per table on both sides and whether they agree."""
    def counts(tables, name):
        out = None
        for table, df in tables.items():
            one = df.agg(F.count("*").alias(name)).select(F.lit(table).alias("table_name"), name)
            out = one if out is None else out.unionByName(one)
        return out

    both = counts(before, "source_rows").join(counts(after, "target_rows"), "table_name", "full")
    return both.withColumn("agrees", F.coalesce(F.col("source_rows") == F.col("target_rows"), F.lit(False)))


def duplicate_groups(threads: DataFrame) -> DataFrame:
    keyed = idn.add_identity_keys(threads.drop("thread_hash"))
    return keyed.groupBy("thread_hash").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def audit_duplicates(threads: DataFrame) -> DataFrame:
    return duplicate_groups(threads).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("redundant"))


def merge_links(new: Column, old: Column) -> Column:
    """Ordered union of two link lists, incoming first, empties dropped."""
    both = F.concat(F.coalesce(new, F.array().cast("array<string>")), F.coalesce(old, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(both, lambda m: m.isNotNull() & (m != "")))


def is_unchanged(old_title: Column, new_title: Column, old_url: Column, new_url: Column, old: Column, new: Column) -> Column:
    same_url = (old_url == "") | (new_url == "") | (old_url == new_url)
    return (old_title == new_title) & same_url & (F.size(old) == F.size(new)) & (F.size(F.array_except(new, old)) == 0)


def consolidated_links(threads: DataFrame, key: str) -> DataFrame:
    """Ordered distinct stripped links of every identity, newest record first.

    Lists move once as they are.  First occurrences are found by key and link
    before anything is collected, so one task never holds the copies of a hot
    group, only its distinct links.
    """
    rows = threads.select(key, F.unix_micros(F.col("updated_at").cast("timestamp")).alias("_u"), "thread_id", "magnet_uris").repartition(key)
    rows = rows.select(key, "_u", "thread_id", F.posexplode("magnet_uris").alias("_pos", "_link"))
    # a link without hash stays as it is, so only an empty one has an empty key
    rows = ln.add_link_keys(rows.filter(F.col("_link") != ""), "_link")
    first = rows.groupBy(key, "stripped_link").agg(F.min(F.struct((-F.col("_u")).alias("newest"), "thread_id", "_pos")).alias("at"))
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "stripped_link"))).alias("l")).select(
        key, F.col("l.stripped_link").alias("magnet_uris"))


def consolidate_duplicates(threads: DataFrame, default_origin: str = idn.DEFAULT_ORIGIN, keyed: bool = False) -> DataFrame:
    """One row per identity: the latest record, with links and url taken over from the others.

    ``keyed``: ``thread_hash`` is the identity already, and the rows are written.
    """
    # read twice below, and keys computed from titles are costly to repeat
    t = threads if keyed else materialize(idn.add_identity_keys(threads.drop("thread_hash"), default_origin=default_origin), "keyed-threads")
    newest = F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("newest"), "thread_id")
    keep = [c for c in ("thread_id", "raw_title", "clean_title", "type", "year", "tmdb_id", "status", "catalog", "posted_at", "updated_at") if c in t.columns]
    top = t.groupBy("thread_hash").agg(
        F.min_by(F.struct(*keep), newest).alias("k"),
        F.min_by("url", F.when(F.coalesce("url", F.lit("")) != "", newest)).alias("url"),
        F.count("*").alias("rows"))
    top = top.select("thread_hash", "k.*", F.coalesce("url", F.lit("")).alias("url"), "rows")
    top = top.withColumn("url", F.when(idn.topic_id(F.col("url")) != "", idn.canonical_url(F.col("url"), default_origin)).otherwise(F.lit("")))
    top = top.withColumn("type", tx.normalize_media_type(F.col("type")))
    top = rel.add_title_parts(top, "raw_title", "_title", "_year", "_rest")
    top = top.withColumn("_error", tx.validation_error("_title", "_year"))
    old_title = F.col("clean_title") if "clean_title" in keep else F.lit(None).cast("string")
    top = top.withColumn("clean_title", F.when(F.col("_error").isNull(), F.col("_title")).otherwise(old_title))
    top = top.drop("_title", "_year", "_rest", "_error")
    return top.join(consolidated_links(t, "thread_hash"), "thread_hash", "left") if "magnet_uris" in threads.columns else top


def build_links(threads: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Stream rows of linked threads: one per link with a hash.

    ``threads``: tmdb_id, type, status and magnet_uris (or an exploded ``magnet``).
    """
    t = threads.filter((F.col("status") == fv.LINKED) & F.col("tmdb_id").isNotNull())
    if "magnet" not in t.columns:
        t = t.select("*", F.posexplode("magnet_uris").alias("link_no", "magnet"))
    t = ln.parse_links(t, "magnet", "type")
    series = tx.normalize_media_type(F.col("type")) == "series"
    start = F.when(F.col("kind") == "SINGLE_EPISODE", F.col("episode")).when(F.col("kind") == "EPISODE_PACK", F.col("episode_start"))
    end = F.when(F.col("kind") == "SINGLE_EPISODE", F.col("episode")).when(F.col("kind") == "EPISODE_PACK", F.col("episode_end"))
    return t.select(*carry, "tmdb_id", "infohash", "quality", "language",
                    F.when(series, F.when(F.col("season") == 0, F.lit(1)).otherwise(F.col("season"))).alias("season"),
                    F.when(series, start).alias("episode"), F.when(series, end).alias("episode_end"))


def episode_coverage(streams: DataFrame) -> DataFrame:
    """Distinct episodes the streams of a title cover.

    Ranges are made distinct before they are expanded, and expansion is narrow.
    """
    last = F.coalesce("episode_end", "episode")
    ranges = streams.filter(F.col("season").isNotNull() & F.col("episode").isNotNull()).select(
        "tmdb_id", "season", "episode", last.alias("last")).filter(F.col("last") >= F.col("episode")).distinct()
    out = ranges.select("tmdb_id", "season", F.explode(F.sequence("episode", "last")).alias("episode")).distinct()
    return out.withColumn("title", F.concat(F.lit("Season "), F.col("season").cast("string"), F.lit(" - Episode "), F.col("episode").cast("string")))


def match_summary(results: DataFrame, id_col: str = "ref_id") -> DataFrame:
    return results.agg(F.count_if(F.col(id_col).isNotNull()).alias("success_count"),
                       F.count_if(F.col(id_col).isNull()).alias("fail_count"))


def link_summary(threads: DataFrame, locks: DataFrame) -> DataFrame:
    """Label, hash, quality, language and lock of every link; ``threads`` carry ``magnet``."""
    # a thread's title is read once, not once a link, and only where there is no clean one
    t = threads.withColumn("_unnamed", F.when(F.coalesce("clean_title", F.lit("")) == "", F.coalesce("raw_title", F.lit("")))).withColumn("_type", F.coalesce("type", F.lit("")))
    names = t.filter(F.col("_unnamed").isNotNull()).select("_unnamed", "_type").distinct()
    names = forum.add_display_title(names.withColumn("clean_title", F.lit("")), raw_col="_unnamed", type_col="_type")
    t = ln.parse_links(t.withColumn("_titled", F.col("raw_title").isNotNull()), "magnet", "type", only=["thread_id", "clean_title", "_titled", "_unnamed", "_type"])
    t = t.join(names.select("_unnamed", "_type", "display_title"), ["_unnamed", "_type"], "left")
    t = t.withColumn("label", F.when(F.coalesce("clean_title", F.lit("")) != "", F.col("clean_title")).otherwise(F.when(F.col("_titled"), F.col("display_title"))))
    return jn.with_lock_flag(t, locks).select("thread_id", "label", "infohash", "quality", "language", "is_locked")


def gap_status(tmdb_id: Column, imdb_id: Column, any_pending: Column) -> Column:
    known = F.coalesce(tmdb_id, F.lit("")) != ""
    mapped = (F.coalesce(imdb_id, F.lit("")) != "") | F.coalesce(F.startswith(tmdb_id, F.lit("tt")), F.lit(False))
    return (F.when(known & mapped, "HEALTHY").when(known, "MISSING_IMDB_GAP")
            .when(any_pending, "PENDING_MATCH").otherwise("UNLINKED"))


def entities(threads: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per title (or lone thread): its first thread's names, counts and gap status."""
    t = threads.withColumn("entity_key", F.coalesce(F.nullif("tmdb_id", F.lit("")), F.col("thread_hash")))
    e = t.groupBy("entity_key").agg(
        F.min_by(F.struct("tmdb_id", F.coalesce(F.nullif("clean_title", F.lit("")), F.col("raw_title")).alias("title"), "year"), "thread_hash").alias("p"),
        F.count("*").alias("threads"), F.bool_or(F.col("status") == fv.PENDING).alias("any_pending"))
    m = metadata.select("tmdb_id", "imdb_id", F.col("year").alias("meta_year"))
    e = e.select("entity_key", "p.*", "threads", "any_pending").join(m, "tmdb_id", "left")
    status = gap_status(F.col("tmdb_id"), F.col("imdb_id"), F.col("any_pending"))
    reason = None
    for name, text in fv.GAP_REASONS.items():
        reason = F.when(F.col("gap_status") == name, text) if reason is None else reason.when(F.col("gap_status") == name, text)
    return e.withColumn("year", F.coalesce("meta_year", "year", F.lit(0))).withColumn("gap_status", status).withColumn(
        "gap_reason", reason).drop("meta_year", "any_pending")


def gap_report(threads: DataFrame, metadata: DataFrame) -> DataFrame:
    return entities(threads, metadata).groupBy("gap_status").agg(F.count("*").alias("entities"))


def entity_graph(threads: DataFrame, metadata: DataFrame, streams: DataFrame, watchlist: DataFrame, locks: DataFrame) -> DataFrame:
    """Entities with their threads and streams nested, for threads a search selected."""
    e = entities(threads, metadata)
    t = jn.with_watch_status(threads, watchlist).withColumn("entity_key", F.coalesce(F.nullif("tmdb_id", F.lit("")), F.col("thread_hash")))
    nested = t.groupBy("entity_key").agg(F.sort_array(F.collect_list(F.struct("thread_hash", "raw_title", "status", "watch_status"))).alias("thread_list"))
    ids = e.select("entity_key", F.explode(F.array_distinct(F.filter(F.array("tmdb_id", "imdb_id"), lambda i: i.isNotNull() & (i != "")))).alias("tmdb_id"))
    s = jn.with_lock_flag(rk.first_seen(streams, ["tmdb_id", "infohash"], ["link_id"]), locks)
    s = ids.join(s, "tmdb_id").groupBy("entity_key").agg(F.sort_array(F.collect_list(
        F.struct("tmdb_id", "infohash", "season", "episode", "quality", "language", "is_locked"))).alias("stream_list"))
    return e.join(nested, "entity_key").join(s, "entity_key", "left")
