"""Named queries of streams and stored tables, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.operators import merge as mg
from reelweave.session import new_folder
from reelweave.sources.store import Store
from reelweave.streaming import jobs, stateful
from reelweave.workload import sqltext as sq
from reelweave.workload.fixtures import fixture, tables
from reelweave.workload.queries import AS_OF, T, _threads, as_of, query

# --- streams -----------------------------------------------------------------

#: Event time up to which the replayed events are decided, a marker behind all of them.
END = "TIMESTAMP '2024-03-01 00:00:00'"


def _event_stream(spark, d) -> DataFrame:
    tables(spark, d)
    raw = spark.readStream.schema(spark.table("events").schema).parquet(f"{d}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _ended(spark, stream: DataFrame) -> DataFrame:
    """The stream and a row without key at ``END``, which lets the watermark pass all others."""
    path = new_folder(spark, "stream-end")
    last = [F.expr(END).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*last).write.parquet(path)
    return stream.union(spark.readStream.schema(stream.schema).parquet(path))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    out = jobs.stream_first_seen(_event_stream(spark, d), ["user_id", "event_type"], "ts", "60 days")
    return jobs.run_to_table(out, new_folder(spark, "first-seen")).select("user_id", "event_type")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_status_counts(spark, d):
    s = jobs.stream_status_counts(_event_stream(spark, d), "ts", "event_type", "1 day")
    out = jobs.run_keyed(s, Store(spark, new_folder(spark, "store")), "status_counts", ["day", "event_type"])
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(sq.admitted("events", "user_id", "ts", "event_id", 8, 43200))
def stream_rate_limit(spark, d):
    s = _ended(spark, _event_stream(spark, d).select("user_id", "event_id", "ts"))
    return jobs.run_to_table(stateful.stream_rate_limit(s, "user_id", "ts", "event_id", 8, 43200), new_folder(spark, "rate-limit"))


_WATCH = "CASE event_type WHEN 'purchase' THEN 'paused' ELSE 'active' END"
_LAST = f"l AS (SELECT user_id, arg_max({_WATCH}, ts) AS status, max(ts) AS last_updated FROM events GROUP BY 1)"


@query(f"WITH {_LAST} SELECT user_id, CASE WHEN status = 'active' AND last_updated < {END} - INTERVAL 1 DAY - INTERVAL 35 DAY THEN 'archived' ELSE status END AS status FROM l")
def stream_inactivity(spark, d):
    s = _event_stream(spark, d).select("user_id", F.expr(_WATCH).alias("status"), F.col("ts").alias("last_updated"), "ts").drop("ts")
    s = _ended(spark, s.withColumnRenamed("last_updated", "ts")).withColumnRenamed("ts", "last_updated")
    out = stateful.stream_inactivity(s, "user_id", days=35, late="1 day")
    out = out.withColumn("_timer", F.col("status") == "archived").filter("user_id IS NOT NULL")
    found = jobs.run_keyed(out, Store(spark, new_folder(spark, "store")), "watchlist", ["user_id"], ["last_updated", "_timer"], "append")
    return found.select("user_id", "status")


_TABLE = "CASE event_type WHEN 'view' THEN 'download_cache' WHEN 'click' THEN 'failed_threads' WHEN 'purchase' THEN 'link_cache' ELSE 'locks' END"


@query(f"""WITH l AS (SELECT {_TABLE} AS table_name, user_id, max(ts) AS ts FROM events GROUP BY 1, 2) SELECT table_name, user_id, ts FROM l
WHERE ts < {END} - INTERVAL 30 DAY - INTERVAL 1 DAY * CASE table_name WHEN 'download_cache' THEN 5 WHEN 'failed_threads' THEN 7 WHEN 'link_cache' THEN 30 ELSE 1 END""")
def stream_expiry(spark, d):
    s = _ended(spark, _event_stream(spark, d).select(F.expr(_TABLE).alias("table_name"), "user_id", "ts"))
    out = stateful.stream_expiry(s, "user_id", "ts", late="30 days")
    found = jobs.run_to_table(out, new_folder(spark, "expired")).filter("user_id IS NOT NULL")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT page_id FROM pages WHERE NOT (contains(html, 'cloudflare') AND (contains(html, 'captcha') OR contains(html, 'challenge-platform') OR contains(html, 'Access denied')))")
def stream_pages(spark, d):
    tables(spark, d)
    raw = spark.readStream.schema(spark.table("pages").schema).parquet(f"{d}/pages.parque[t]")
    return jobs.stream_pages(raw, new_folder(spark, "pages")).select("page_id")


# --- stored tables -------------------------------------------------------------


@query(f"""{T} SELECT 1::BIGINT AS version, 'watchlist' AS table_name, count(*) AS n, count(*) FILTER (status = 'archived') AS archived FROM fx_watchlist
UNION ALL SELECT 1, 'threads', count(*), 0 FROM th
UNION ALL SELECT 2, 'watchlist', count(*), count(*) FILTER (status = 'archived' OR (status = 'active' AND last_updated < {AS_OF} - INTERVAL 30 DAY)) FROM fx_watchlist
UNION ALL SELECT 2, 'threads', count(*), 0 FROM th
UNION ALL SELECT 3, 'watchlist', count(*), count(*) FILTER (status = 'archived' OR (status = 'active' AND last_updated < {AS_OF} - INTERVAL 30 DAY)) FROM fx_watchlist
UNION ALL SELECT 3, 'threads', count(*), 0 FROM th WHERE status = 'linked'""")
def entity_versions(spark, d):
    store = Store(spark, new_folder(spark, "store"))
    store.commit({"watchlist": fixture(spark, d, "fx_watchlist"), "threads": _threads(spark, d)})
    store.commit({"watchlist": mg.archive_inactive(store.read("watchlist"), as_of())})
    store.commit({"threads": store.read("threads").filter("status = 'linked'")})
    rows = None
    for version in store.versions():
        for name in ("watchlist", "threads"):
            t = store.read(name, version)
            archived = F.count_if(F.col("status") == "archived") if name == "watchlist" else F.lit(0)
            one = t.agg(F.count("*").alias("n"), archived.cast("bigint").alias("archived")).select(F.lit(version).cast("bigint").alias("version"), F.lit(name).alias("table_name"), "n", "archived")
            rows = one if rows is None else rows.unionByName(one)
    return rows
