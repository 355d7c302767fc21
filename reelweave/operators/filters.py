"""Filters and projections over the entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import links as ln
from reelweave.functions import paths as pt
from reelweave.functions import regex as rx
from reelweave.functions import release as rel
from reelweave.functions import text as tx
from reelweave.session import materialize


def by_status(threads: DataFrame, status: str) -> DataFrame:
    return threads.filter(F.col("status") == status)


def active_watchlist(watchlist: DataFrame) -> DataFrame:
    return watchlist.filter((F.col("status") == "active") & (F.coalesce(F.col("url"), F.lit("")) != ""))


def search_series(threads: DataFrame, watchlist: DataFrame, q: str, limit: int = 15) -> DataFrame:
    """First series (by hash) whose title holds ``q``, with their watch status."""
    needle = F.lit(q.strip().lower())
    hit = F.contains(F.lower("clean_title"), needle) | F.contains(F.lower("raw_title"), needle)
    found = threads.filter((tx.normalize_media_type(F.col("type")) == "series") & hit).orderBy("thread_hash").limit(limit)
    status = watchlist.select("thread_hash", F.col("status").alias("watch_status"))
    return found.join(status, "thread_hash", "left").withColumn("watch_status", F.coalesce("watch_status", F.lit("none")))


def search_entities(threads: DataFrame, q: str, media_type: str) -> DataFrame:
    """Threads with the id ``q``; when there are none, threads whose title holds it."""
    q = q.strip()
    norm_q = tx.normalize_title(F.lit(q))
    t = threads.filter(tx.normalize_media_type(F.col("type")) == tx.normalize_media_type(F.lit(media_type)))
    if q.startswith("tt") or q[:1].isdigit():
        exact = t.filter(F.col("tmdb_id") == q)
        if not exact.isEmpty():
            return exact
    return t.filter(F.contains(tx.normalize_title(F.col("clean_title")), norm_q)
                    | F.contains(tx.normalize_title(F.col("raw_title")), norm_q))


def drop_divergent_links(links: DataFrame, link_col: str, type_col: str, title_cols: list[str]) -> DataFrame:
    """Links whose name parses to a valid title unlike every title of their thread are dropped.

    Titles are compared as they are, not normalised.  The links of a thread
    repeat few names and fewer titles, so each pair of titles is compared once
    and links are met only by the names that are dropped.
    """
    titles = [f"_title{i}" for i in range(len(title_cols))]
    # hash and stripped link repeat the link, so they are made after the rows are written
    df = links.withColumn("display_name", ln.display_name(F.col(link_col)))
    columns = [*[c for c in links.columns if c not in ln.LINK_KEYS], *ln.LINK_KEYS]
    df = df.withColumns({t: F.coalesce(F.col(c), F.lit("")) for t, c in zip(titles, title_cols, strict=True)})
    df = materialize(df.withColumn("_kind", F.lower(F.coalesce(F.col(type_col), F.lit("")))), "keyed-links")
    name = [*titles, "display_name", "_kind"]
    names = rel.parse_distinct(df.filter("display_name <> ''").select(*name).distinct(), "display_name", "_kind", prefix="n_")
    # written first: a filter on parsed columns would be pushed down and repeat the parsing at every step
    names = materialize(names.select(*name, "n_is_valid", "n_clean_title"), "link-names").filter(F.col("n_is_valid") & (F.col("n_clean_title") != ""))
    pairs = names.select(*titles, "n_clean_title").distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    for i, t in enumerate(titles):
        pairs = tx.add_dice(pairs, t, "n_clean_title", f"_dice{i}")
    pairs = materialize(pairs, "compared-titles")
    for i in range(len(titles)):
        pairs = pairs.filter(F.col(f"_dice{i}") < fv.DIVERGENT_BELOW)
    dropped = materialize(names.join(pairs, [*titles, "n_clean_title"], "left_semi").select(*name), "divergent-names")
    return ln.add_link_keys(df.join(dropped, name, "left_anti"), link_col).select(*columns)


def large_videos(files: DataFrame, path_col: str = "path", size_col: str = "bytes") -> DataFrame:
    """Video files of real size, extras too."""
    return files.filter((F.col(size_col) >= fv.MIN_VIDEO_BYTES) & pt.is_video(F.col(path_col)))


def playable_files(files: DataFrame, relaxed: Column | None = None, path_col: str = "path", size_col: str = "bytes") -> DataFrame:
    """Video files of real size that are no extras; ``relaxed`` rows allow specials."""
    extra = pt.is_extra(F.col(path_col))
    if relaxed is not None:
        extra = F.when(relaxed, pt.is_extra(F.col(path_col), fv.EXTRA_WORDS_SPECIALS)).otherwise(extra)
    return large_videos(files, path_col, size_col).filter(~extra)


def download_state(col: Column) -> Column:
    state = F.lower(col)
    out = None
    for names, value in fv.DOWNLOAD_STATES:
        out = F.when(state.isin(names), value) if out is None else out.when(state.isin(names), value)
    return out.otherwise("downloading")


def flag_stale_downloads(df: DataFrame, as_of: Column) -> DataFrame:
    """``is_stale`` for unfinished downloads that broke, stalled or are older than a day."""
    state = F.lower(F.coalesce(rx.non_empty(F.col("download_state")), F.col("status"), F.lit("")))
    text = F.coalesce(rx.non_empty(F.col("created_at")), rx.non_empty(F.col("updated_at")), rx.non_empty(F.col("timestamp")))
    at = F.coalesce(
        F.when(F.regexp_like(text, F.lit(r"T.*(?:Z|[+-]\d\d:\d\d)\z")), F.try_to_timestamp(text)),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    df = df.withColumns({"state": state, "started_at": at})
    finished = F.col("state").isin(fv.FINISHED_STATES) | (F.coalesce(F.col("progress"), F.lit(0.0)) >= 1.0)
    old = F.coalesce(F.col("started_at") < as_of - F.expr("INTERVAL 24 HOURS"), F.lit(False))
    broken = F.col("state").isin(fv.BROKEN_STATES) | F.contains("state", F.lit("stalled"))
    return df.withColumn("is_stale", ~finished & (broken | old))


def expire(df: DataFrame, ts_col: str, as_of: Column, days: int = 0, hours: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows still alive at ``as_of`` and rows strictly older than the cutoff."""
    old = F.col(ts_col) < as_of - F.make_dt_interval(F.lit(days), F.lit(hours))
    return df.filter(~old | F.col(ts_col).isNull()), df.filter(old)


def split_request_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``base:season:episode`` split from the right; -1 where there are no 64-bit numbers."""
    pattern = r"(?s)^(.*):([+-]?\d+):([+-]?\d+)\z"
    df = df.withColumn("_id", F.regexp_replace(F.col(id_col), r"(?s)^.*?:pending:", ""))
    numbers = [F.regexp_extract("_id", pattern, g).try_cast("bigint") for g in (2, 3)]
    split = numbers[0].isNotNull() & numbers[1].isNotNull()
    return df.withColumns({
        "base_id": F.when(split, F.regexp_extract("_id", pattern, 1)).otherwise(F.col("_id")),
        "season": F.when(split, numbers[0]).otherwise(F.lit(-1).cast("bigint")),
        "episode": F.when(split, numbers[1]).otherwise(F.lit(-1).cast("bigint")),
    }).drop("_id")


_PROVIDER_ITEM = ("struct<id:string,name:string,status:string,download_state:string,"
                  "files:array<struct<id:string,name:string,size:bigint>>>")


def map_file_nodes(df: DataFrame, payload_col: str, id_col: str, selection_col: str | None = None) -> DataFrame:
    """Provider payload (one object or a list, the first counts) to status, files and links."""
    item = F.coalesce(F.get(F.from_json(payload_col, f"array<{_PROVIDER_ITEM}>"), 0), F.from_json(payload_col, _PROVIDER_ITEM))
    df = df.withColumn("_item", item)
    chosen = F.col(selection_col) if selection_col else F.array().cast("array<int>")
    df = df.withColumn("_chosen", F.coalesce(chosen, F.array().cast("array<int>")))
    df = df.withColumn("state", download_state(F.coalesce(
        rx.non_empty(F.col("_item.download_state")), F.col("_item.status"), F.lit(""))))

    def node(f: Column, i: Column) -> Column:
        fid = F.coalesce(rx.to_int(f["id"]), i.cast("int"))
        picked = (F.size("_chosen") == 0) | F.array_contains("_chosen", fid)
        return F.struct(fid.alias("id"), f["name"].alias("path"), f["size"].alias("bytes"), F.when(picked, 1).otherwise(0).alias("selected"))

    df = df.withColumn("files", F.transform("_item.files", node))
    link = F.transform("files", lambda f: F.when(F.col("state") == "downloaded", F.concat(
        F.lit("tb:"), F.col(id_col).cast("string"), F.lit(":"), f["id"].cast("string"))).otherwise(F.lit("")))
    return df.withColumn("links", link).drop("_item", "_chosen")
