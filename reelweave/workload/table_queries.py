"""Named queries of single operators over the entity tables, with their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.operators import aggregates as ag
from reelweave.operators import filters as fl
from reelweave.operators import linkage as lk
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.schemas import ENTITIES
from reelweave.session import new_folder
from reelweave.sources import entities
from reelweave.workload import sqltext as sq
from reelweave.workload.fixtures import fixture, with_clause
from reelweave.workload.queries import AS_OF, FILES, LINKS, REF, STREAMS, T, THREADS, _threads, as_of, query

WATCH = "fx_watchlist"


@query(f"{T} SELECT thread_hash FROM fx_watchlist WHERE status = 'active' AND url <> ''")
def watch_active(spark, d):
    return fl.active_watchlist(fixture(spark, d, WATCH)).select("thread_hash")


@query(f"{T} SELECT thread_hash, last_updated FROM fx_watchlist ORDER BY last_updated DESC, thread_hash LIMIT 25")
def watch_latest(spark, d):
    return rk.watchlist_by_update(fixture(spark, d, WATCH)).limit(25).select("thread_hash", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query(f"""{T}, c AS (SELECT thread_hash, CASE thread_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'paused' ELSE 'active' END AS ns FROM th WHERE thread_id % 6 < 4)
SELECT count(*) FILTER (ns = 'delete' OR thread_hash IN (SELECT thread_hash FROM fx_watchlist)) AS updated FROM c""")
def watch_changes(spark, d):
    c = _threads(spark, d).filter("thread_id % 6 < 4").selectExpr("thread_hash", "CASE thread_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'paused' ELSE 'active' END AS new_status")
    return mg.watch_changes_count(fixture(spark, d, WATCH), c)


@query(f"""{T}, hit AS (SELECT th.*, CASE WHEN thread_id % 3 = 0 THEN '' ELSE 'https://asked.example.com/' || thread_id END AS req_url FROM th WHERE thread_id % 5 = 0),
s AS (SELECT *, CASE WHEN req_url = '' THEN url ELSE req_url END AS u FROM hit WHERE {sq.media_type('type')} = 'series')
SELECT COALESCE(s.thread_hash, w.thread_hash) AS thread_hash, COALESCE(NULLIF(s.u, ''), w.url, '') AS url, CASE WHEN s.thread_hash IS NOT NULL THEN 'active' ELSE w.status END AS status, CASE WHEN s.thread_hash IS NOT NULL THEN {AS_OF} ELSE w.last_updated END AS last_updated
FROM s FULL JOIN fx_watchlist w ON w.thread_hash = s.thread_hash""")
def watch_requests(spark, d):
    t = _threads(spark, d)
    url = F.when(F.col("thread_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://asked.example.com/"), F.col("thread_id").cast("string")))
    # half of them name the thread by its hash, the others by its id
    asked = t.filter("thread_id % 5 = 0").select(F.when(F.col("thread_id") % 2 == 0, F.col("thread_hash")).otherwise("none").alias("thread_hash"), "thread_id", url.alias("req_url"))
    out = mg.enroll_requests(fixture(spark, d, WATCH), asked, t, as_of())
    return out.select("thread_hash", "url", "status", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


_MATCHES = "SELECT tmdb_id, imdb_id, type, CASE CAST(tmdb_id AS BIGINT) % 3 WHEN 0 THEN 'TV' WHEN 1 THEN 'movie' ELSE '' END AS matched FROM fx_reference"


@query(f"""{with_clause(REF)}, m AS ({_MATCHES}), ok AS (SELECT * FROM m WHERE matched = '' OR {sq.media_type('matched')} = {sq.media_type('type')}),
known AS (SELECT imdb_id, min('x' || tmdb_id) AS known_id FROM fx_reference WHERE imdb_id IS NOT NULL AND CAST(tmdb_id AS BIGINT) % 2 = 0 GROUP BY 1)
SELECT m.tmdb_id AS asked, CASE WHEN ok.tmdb_id IS NULL THEN NULL ELSE COALESCE(known_id, m.tmdb_id) END AS tmdb_id FROM m LEFT JOIN ok USING (tmdb_id) LEFT JOIN known ON known.imdb_id = m.imdb_id""")
def adopted_ids(spark, d):
    ref = fixture(spark, d, REF)
    matches = spark.sql(_MATCHES).withColumn("asked", F.col("tmdb_id"))
    same, other = lk.split_cross_type(matches, "type", "matched")
    stored = ref.filter("CAST(tmdb_id AS BIGINT) % 2 = 0").select(F.concat(F.lit("x"), "tmdb_id").alias("tmdb_id"), "imdb_id")
    return lk.adopt_existing_id(same, stored).select("asked", "tmdb_id").union(other.select("asked", F.lit(None).cast("string")))


@query(f"""{with_clause(LINKS, THREADS)}, src AS (SELECT l.link_id, l.thread_id, l.magnet, t.type, t.raw_title FROM fx_links l JOIN fx_threads t USING (thread_id)), {sq.links('src', 'type')}
SELECT thread_id, 'T' || thread_id AS label, infohash, quality, language, infohash IN (SELECT lower(substr(magnet, 21, 40)) FROM fx_links WHERE link_id % 5 = 2) AS is_locked FROM pl""")
def link_summary(spark, d):
    t = fixture(spark, d, LINKS).join(spark.table(THREADS), "thread_id").withColumn("clean_title", F.concat(F.lit("T"), F.col("thread_id").cast("string")))
    locks = spark.table(LINKS).filter("link_id % 5 = 2").select(F.lower(F.substring("magnet", 21, 40)).alias("infohash"))
    return ag.link_summary(t, locks)


_PROVIDER = "CASE torrent_id % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'downloading' WHEN 2 THEN 'error' ELSE 'Completed' END"


@query(f"""{with_clause(FILES)}, f AS (SELECT *, CASE torrent_id % 4 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'downloading' WHEN 2 THEN 'error' ELSE 'downloaded' END AS state,
 bool_or(selected = 1) OVER (PARTITION BY torrent_id) AND torrent_id % 3 = 0 AS choosing FROM fx_files)
SELECT torrent_id, CAST(file_id AS INTEGER) AS file_id, path, bytes, CASE WHEN NOT choosing OR bool_or(selected = 1) OVER (PARTITION BY torrent_id, file_id) THEN 1 ELSE 0 END AS selected, state, CASE WHEN state = 'downloaded' THEN 'tb:' || torrent_id || ':' || file_id ELSE '' END AS link FROM f""")
def file_nodes(spark, d):
    f = fixture(spark, d, FILES)
    one = f.groupBy("torrent_id").agg(F.sort_array(F.collect_list(F.struct(F.col("file_id").cast("string").alias("id"), F.col("path").alias("name"), F.col("bytes").alias("size")))).alias("files"),
                                      F.sort_array(F.collect_list(F.when(F.col("selected") == 1, F.col("file_id").cast("int")))).alias("picked"))
    item = F.struct(F.col("torrent_id").cast("string").alias("id"), F.expr(_PROVIDER).alias("download_state"), "files")
    payload = F.when(F.col("torrent_id") % 2 == 0, F.to_json(F.array(item))).otherwise(F.to_json(item))
    one = one.select("torrent_id", payload.alias("payload"), F.when(F.col("torrent_id") % 3 == 0, F.col("picked")).alias("chosen"))
    out = fl.map_file_nodes(one, "payload", "torrent_id", "chosen")
    rows = out.select("torrent_id", "state", F.explode(F.arrays_zip("files", "links")).alias("z"))
    return rows.select("torrent_id", F.col("z.files.id").alias("file_id"), F.col("z.files.path").alias("path"), F.col("z.files.bytes").alias("bytes"), F.col("z.files.selected").alias("selected"), "state", F.col("z.links").alias("link"))


@query(f"""{with_clause(STREAMS)} SELECT 'good' AS side, CAST(link_id AS VARCHAR) AS k FROM fx_streams WHERE link_id % 11 <> 3
UNION ALL SELECT 'bad', '{{"infohash": ' || link_id FROM fx_streams WHERE link_id % 11 = 3""")
def tolerant_rows(spark, d):
    s = fixture(spark, d, STREAMS)
    text = F.when(F.col("link_id") % 11 == 3, F.concat(F.lit('{"infohash": '), F.col("link_id").cast("string"))).otherwise(
        F.to_json(F.struct(F.col("link_id").cast("string").alias("infohash"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))))
    path = new_folder(spark, "records")
    s.select(text.alias("value")).write.text(path)
    good, bad = entities.read_tolerant(spark, path, ENTITIES["locks"])
    return good.select(F.lit("good").alias("side"), F.col("infohash").alias("k")).union(bad.select(F.lit("bad"), "raw"))


@query(f"""{T}, n AS (SELECT count(*) AS n FROM th WHERE status = 'linked' AND catalog <> '') SELECT 'any' AS wanted, CASE WHEN n > 50 THEN 'incremental' ELSE 'full' END AS mode FROM n UNION ALL SELECT 'all', 'full'""")
def load_mode(spark, d):
    t = _threads(spark, d)
    modes = F.array(*[F.struct(F.lit(n).alias("wanted"), F.lit(entities.choose_load_mode(t, force)).alias("mode")) for n, force in (("any", False), ("all", True))])
    return t.limit(1).select(F.explode(modes).alias("m")).select("m.*")
