"""Inputs derived from the given tables by portable SQL.

Every statement runs unchanged on Spark and on DuckDB, so a query and its
checking SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelweave.session import size_files_as_memory

TABLES = ["part", "lineitem", "events", "documents", "pages"]
# few bytes a row, much work on each: read from few splits, all of it would run in as many tasks
SPREAD = ["part"]

SQL: dict[str, str] = {}

SQL["fx_threads"] = """
SELECT p_partkey AS thread_id,
       p_name || ' ' || p_brand ||
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' (' || CAST(1990 + p_partkey % 35 AS STRING) || ')' END ||
         CASE WHEN p_partkey % 2 = 1 THEN ''
              WHEN p_partkey % 3 = 0 THEN ' S0' || CAST(1 + p_partkey % 9 AS STRING) || ' EP (01-' || lpad(CAST(2 + p_partkey % 9 AS STRING), 2, '0') || ')'
              WHEN p_partkey % 3 = 1 THEN ' S0' || CAST(1 + p_partkey % 9 AS STRING) || ' EP0' || CAST(1 + p_partkey % 9 AS STRING)
              ELSE ' S0' || CAST(1 + p_partkey % 9 AS STRING) || ' Complete' END ||
         CASE p_partkey % 4 WHEN 0 THEN ' Tamil' WHEN 1 THEN ' Hindi + English' WHEN 2 THEN ' Dual Audio Telugu' ELSE '' END ||
         CASE p_partkey % 5 WHEN 0 THEN ' 1080p WEB-DL x264 DDP 5.1' WHEN 1 THEN ' 4K BluRay HEVC HDR10' WHEN 2 THEN ' [720p HDTV AAC 2.0]' WHEN 3 THEN ' Extended 480p DVDRip' ELSE '' END ||
         CASE WHEN p_partkey % 6 = 0 THEN ' 1.4GB' ELSE '' END || '-GRP' || CAST(p_partkey % 11 AS STRING) AS raw_title,
       CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 'TV' ELSE 'series' END ELSE 'movie' END AS type,
       CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'https://forum.example.com/index.php?/forums/topic/' || CAST(p_partkey % 1500 AS STRING) || '-x/' END AS url,
       CASE p_partkey % 3 WHEN 0 THEN 'cat-a' WHEN 1 THEN 'cat-b' ELSE '' END AS catalog,
       CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(p_partkey % 977 AS INT) END AS posted_at
FROM part
"""

SQL["fx_links"] = """
SELECT l_orderkey * 10 + l_linenumber AS link_id, l_partkey AS thread_id,
       'magnet:?xt=urn:btih:' || upper(md5(CAST(l_partkey AS STRING) || '/' || CAST(l_suppkey AS STRING)) || substr(md5(CAST(l_suppkey AS STRING)), 1, 8)) ||
       CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE '&dn=www.example.com+-+' || replace(p_name, ' ', '+') || '+S01E0' || CAST(l_linenumber AS STRING) || '+1080p' END ||
       '&tr=udp%3A%2F%2Ft.example.com' AS magnet,
       l_shipdate AS seen_at
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

SQL["fx_reference"] = """
SELECT CAST(100000 + p_partkey AS STRING) AS tmdb_id,
       CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE 'tt' || lpad(CAST(p_partkey AS STRING), 7, '0') END AS imdb_id,
       CASE WHEN p_partkey % 3 = 0 THEN 'The ' ELSE '' END || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || replace(p_brand, '#', ' ') AS title,
       1990 + p_partkey % 35 + CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 0 END AS year,
       CASE WHEN p_partkey % 2 = 0 THEN 'series' ELSE 'movie' END AS type
FROM part
"""

SQL["fx_linked"] = """
SELECT t.*,
       CASE WHEN thread_id % 4 = 2 THEN NULL ELSE CAST(100000 + thread_id % 1600 AS STRING) END AS tmdb_id,
       CASE WHEN thread_id % 4 = 2 THEN 'pending_tmdb' ELSE 'linked' END AS status,
       TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' MINUTE * CAST((thread_id * 37) % 5003 AS INT) AS updated_at
FROM fx_threads t
"""

SQL["fx_streams"] = """
SELECT link_id, CAST(100000 + thread_id % 1600 AS STRING) AS tmdb_id, lower(substr(magnet, 21, 40)) AS infohash,
       CASE WHEN thread_id % 2 = 1 THEN NULL ELSE CAST(1 + thread_id % 9 AS INT) END AS season,
       CASE WHEN thread_id % 2 = 1 OR link_id % 5 = 0 THEN NULL ELSE CAST(1 + link_id % 7 AS INT) END AS episode,
       CASE WHEN thread_id % 2 = 1 OR link_id % 5 = 0 THEN NULL ELSE CAST(1 + link_id % 7 + link_id % 3 AS INT) END AS episode_end,
       CASE link_id % 7 WHEN 0 THEN '2160p' WHEN 1 THEN '1080p' WHEN 2 THEN '720p' WHEN 3 THEN '480p' WHEN 4 THEN 'sd' WHEN 5 THEN '4K' ELSE '' END AS quality,
       CASE link_id % 4 WHEN 0 THEN 'ta' WHEN 1 THEN 'HI' WHEN 2 THEN 'en' ELSE '' END AS language,
       seen_at
FROM fx_links
"""

SQL["fx_files"] = """
SELECT l_orderkey AS torrent_id, l_linenumber AS file_id,
       replace(p_name, ' ', '.') || CASE WHEN l_partkey % 9 = 0 THEN '/Sample/' ELSE '/Season 1/' END ||
         CASE l_linenumber % 4 WHEN 0 THEN 'Show.S01E0' || CAST(l_linenumber AS STRING)
                               WHEN 1 THEN 'Show 1x0' || CAST(l_linenumber AS STRING)
                               WHEN 2 THEN 'Show S01 EP (0' || CAST(l_linenumber AS STRING) || '-0' || CAST(l_linenumber + 2 AS STRING) || ')'
                               ELSE 'Show Episode 0' || CAST(l_linenumber AS STRING) END ||
         CASE l_suppkey % 4 WHEN 0 THEN '.mkv' WHEN 1 THEN '.mp4' WHEN 2 THEN '.srt' ELSE '.avi' END AS path,
       CAST(floor(l_extendedprice * 1000) AS BIGINT) AS bytes,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS selected
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

# watch list of the series threads, with a status and an age of its own
SQL["fx_watchlist"] = """
SELECT sha256('topic_' || CAST(thread_id AS STRING)) AS thread_hash, url, 'old ' || raw_title AS title, raw_title,
       CASE thread_id % 5 WHEN 0 THEN 'paused' WHEN 1 THEN 'archived' ELSE 'active' END AS status,
       CAST(thread_id % 12 AS INT) AS episode_count,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((thread_id * 13) % 1700 AS INT) AS last_updated
FROM fx_threads WHERE type <> 'movie' AND thread_id % 3 <> 0
"""

# two kinds of stored pages: one listing page per catalog and page number, one detail page per thread
SQL["fx_listing_pages"] = """
SELECT 'https://forum.example.com/index.php?/forums/forum/' || CAST(thread_id % 8 AS STRING) || '-f/page/' || CAST(thread_id % 40 AS STRING) AS url,
       thread_id, '<li class="ipsDataItem"><h4 class="ipsDataItem_title"><span class="ipsType_break"><a href="' ||
       CASE WHEN thread_id % 4 = 0 THEN '/index.php?/forums/topic/' || CAST(thread_id AS STRING) || '-t/' ELSE url END || '" title="x"> ' ||
       replace(raw_title, '&', '&amp;') || ' </a></span></h4><time datetime="' ||
       '2024-01-' || lpad(CAST(1 + thread_id % 28 AS STRING), 2, '0') || 'T0' || CAST(thread_id % 10 AS STRING) || ':00:00Z">x</time></li>' AS item
FROM fx_threads
"""


def tables(spark: SparkSession, sf_dir: str, by_part: bool = False) -> None:
    size_files_as_memory(spark)
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in SPREAD:
            table = table.repartition(2 * spark.sparkContext.defaultParallelism)
        if by_part and name == "lineitem":
            table = table.repartition("l_partkey")
        table.createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str, by_part: bool = False) -> DataFrame:
    """One derived table; the ones it reads are registered as views first.

    ``by_part``: rows of ``lineitem`` meet by their part before links are made of
    them, so links can be grouped by thread without being moved.
    """
    tables(spark, sf_dir, by_part)
    order = list(SQL)
    for key in order[: order.index(name) + 1]:
        text = SQL[key].replace("sha256(", "sha2(") if "sha256(" in SQL[key] else SQL[key]
        if "sha2(" in text:
            text = text.replace("AS STRING))", "AS STRING), 256)")
        spark.sql(text).createOrReplaceTempView(key)
    return spark.table(name)


def needed(name: str) -> list[str]:
    """Fixtures a fixture reads, in order, itself last."""
    out: list[str] = []
    for other in SQL:
        if other != name and other in SQL[name]:
            out += [x for x in needed(other) if x not in out]
    return out + [name]


def with_clause(*names: str) -> str:
    """``WITH`` list of the fixtures in use, for checking SQL."""
    order: list[str] = []
    for name in names:
        order += [x for x in needed(name) if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)
