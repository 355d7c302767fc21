"""Scheduled intake of stored pages: every batch of new pages becomes one commit over all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.functions import identity as idn
from reelweave.operators import merge as mg
from reelweave.plans import ingest as ig
from reelweave.session import materialize
from reelweave.sources import pages as pg
from reelweave.sources.store import Store

TABLES = ("threads", "tmdb_metadata", "streams", "link_cache", "failed_threads", "watchlist")


def both_crawls(index_pages: DataFrame, watched_pages: DataFrame, as_of: Column) -> DataFrame:
    """Pages found by the index and pages of the watch list, as they come; a watched page without a date counts as new."""
    return index_pages.withColumn("seen_at", F.lit(None).cast("timestamp")).unionByName(watched_pages.withColumn("seen_at", as_of))


def batch_rows(pages: DataFrame, routes: list[tuple[str, str, str]], default_origin: str = idn.DEFAULT_ORIGIN) -> DataFrame:
    """One row per topic of the pages that hold links; of a topic's pages the greatest url is the last."""
    pages = pg.flag_blocked_pages(pages).filter(~F.col("is_blocked")).drop("is_blocked")
    found = pg.extract_links(pg.route_pages(pages, routes))
    if "seen_at" in found.columns:
        found = found.withColumn("posted_at", F.coalesce("posted_at", "seen_at"))
    keyed = idn.add_identity_keys(found, default_origin=default_origin).withColumn("url", F.col("canonical_url"))
    # written first: joins on computed keys would repeat the whole parse in a filter
    keyed = materialize(keyed.withColumn("_order", F.xxhash64("url", "raw_title", "magnet_uris")), "keyed-pages")
    return mg.fold_batch(keyed, "_order", ["raw_title", "type", "catalog", "posted_at"])


def take_batch(pages: DataFrame, batch_id: int, store: Store, reference: DataFrame, routes: list[tuple[str, str, str]], as_of: Column, name: str = "intake") -> None:
    """Decide a batch against the stored tables and commit all of them with its number; a batch that is committed is left alone."""
    if store.manifest()["batches"].get(name, -1) >= batch_id:
        return
    now = store.manifest()["version"] or None
    tables = {t: store.read(t, now) if now else store.read(t) for t in TABLES}
    out = ig.ingest_tables(batch_rows(pages, routes), tables, reference, as_of)
    changes = out.pop("changes").withColumn("batch", F.lit(batch_id).cast("bigint"))
    old = store.read("changes", schema=changes.schema)
    store.commit(out | {"changes": old.unionByName(changes)}, (name, batch_id), base=now)


def stream_ingest(pages: DataFrame, store: Store, reference: DataFrame, routes: list[tuple[str, str, str]], as_of: Column, name: str = "intake") -> None:
    """Take all pages that are there; run again, it goes on behind the last batch it finished."""
    def take(batch: DataFrame, batch_id: int) -> None:
        take_batch(batch, batch_id, store, reference, routes, as_of, name)

    q = (pages.writeStream.option("checkpointLocation", f"{store.root}/checkpoints/{name}").foreachBatch(take).trigger(availableNow=True).start())
    q.awaitTermination()
