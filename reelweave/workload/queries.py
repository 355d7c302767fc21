"""Named queries over the given tables, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave import fixed_values as fv
from reelweave.functions import forum, labels
from reelweave.functions import identity as idn
from reelweave.functions import links as ln
from reelweave.functions import paths as pt
from reelweave.functions import release as rel
from reelweave.functions import text as tx
from reelweave.operators import aggregates as ag
from reelweave.operators import filters as fl
from reelweave.operators import joins as jn
from reelweave.operators import linkage as lk
from reelweave.operators import merge as mg
from reelweave.operators import ranking as rk
from reelweave.session import materialize
from reelweave.sources import pages as pg
from reelweave.workload import sqltext as sq
from reelweave.workload.fixtures import fixture, tables, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-03-04 00:00:00'"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


def as_of():
    return F.expr(AS_OF)


THREADS, LINKS, LINKED, STREAMS, FILES, REF = ("fx_threads", "fx_links", "fx_linked", "fx_streams", "fx_files", "fx_reference")
PARSED = with_clause(THREADS) + "," + sq.titles(THREADS, "raw_title")


# --- titles and attributes ---------------------------------------------------

@query(f"{with_clause(THREADS)} SELECT thread_id, {sq.media_type('type')} AS media_type FROM fx_threads")
def media_type_norm(spark, d):
    return fixture(spark, d, THREADS).select("thread_id", tx.normalize_media_type(F.col("type")).alias("media_type"))


@query(f"{PARSED} SELECT thread_id, clean_title, year, rest AS remainder FROM pt")
def title_clean(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "remainder")
    return t.select("thread_id", "clean_title", "year", "remainder")


@query(f"{with_clause(REF)} SELECT tmdb_id, {sq.norm('title')} AS norm_title FROM fx_reference")
def title_norm(spark, d):
    return tx.normalize_titles(fixture(spark, d, REF), "title").select("tmdb_id", "norm_title")


@query(f"SELECT doc_id, {sq.norm('text')} AS norm_title FROM documents")
def title_norm_documents(spark, d):
    tables(spark, d)
    return tx.normalize_titles(spark.table("documents"), "text").select("doc_id", "norm_title")


@query(f"{PARSED} SELECT thread_id, {sq.valid_error('clean_title', 'year')} AS validation_error, {sq.valid_error('clean_title', 'year')} IS NULL AS is_valid FROM pt")
def title_valid(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "remainder")
    return tx.validate_titles(t).select("thread_id", "validation_error", "is_valid")


_SRC = sq.cases("rest", [(p, s) for p, s, _ in fv.SOURCES])
_SMOD = sq.cases("rest", [(p, m) for p, _, m in fv.SOURCES])


@query(f"""{PARSED}, q0 AS (SELECT thread_id, rest, {_SRC} AS source, {sq.cases('rest', fv.RESOLUTIONS)} AS resolution, {_SMOD} AS sm FROM pt),
q1 AS (SELECT *, CASE WHEN {sq.hit('rest', fv.MOD_DV_HDR10)} THEN 'DV HDR10' WHEN {sq.hit('rest', fv.MOD_DOLBY_VISION)} THEN trim(sm || ' DV')
  WHEN {sq.hit('rest', fv.MOD_HDR10PLUS)} THEN 'HDR10Plus' WHEN {sq.hit('rest', fv.MOD_HDR10)} THEN 'HDR10'
  WHEN {sq.hit('rest', fv.MOD_HDR)} AND sm = '' THEN 'HDR' ELSE sm END AS modifier FROM q0)
SELECT thread_id, source, resolution, modifier, CASE WHEN source <> '' AND resolution <> '' THEN source || '-' || resolution || CASE WHEN modifier <> '' THEN ' ' || modifier ELSE '' END
  WHEN resolution <> '' THEN resolution WHEN source <> '' THEN source ELSE 'Unknown' END AS quality,
  {sq.cases('rest', fv.VIDEO_CODECS)} AS video_codec, {sq.cases('rest', fv.AUDIO_CODECS)} AS audio_codec, {sq.cases('rest', fv.AUDIO_CHANNELS)} AS audio_channels FROM q1""")
def release_quality(spark, d):
    r = rel.parse_releases(fixture(spark, d, THREADS), "raw_title", "type")
    return r.select("thread_id", "source", "resolution", "modifier", "quality", "video_codec", "audio_codec", "audio_channels")


_LANG_RULES = sorted(fv.LANGUAGES + [(fv.LANGUAGE_MULTI, "multi")], key=lambda r: r[1])
_LANG = "concat_ws(',', " + ", ".join(f"CASE WHEN {sq.hit('rest', p)} THEN {sq.q(c)} END" for p, c in _LANG_RULES) + ")"
_GROUP = sq.ext("rest", fv.GROUP_TRAILING)
_METAS = "(" + ",".join(sq.q(w) for w in fv.METADATA_WORDS) + ")"


@query(f"""{PARSED} SELECT thread_id, CASE WHEN {_LANG} = '' THEN 'en' ELSE {_LANG} END AS languages, {sq.cases('raw_title', fv.LANGUAGES, 'en')} AS primary_language,
  CASE WHEN {_GROUP} <> '' AND lower({_GROUP}) NOT IN {_METAS} THEN {_GROUP} ELSE {sq.ext('rest', fv.GROUP_LEADING)} END AS release_group,
  concat_ws(' ', {', '.join(f"CASE WHEN {sq.hit('rest', p)} THEN {sq.q(label)} END" for p, _, label in fv.EDITIONS)}) AS edition,
  concat_ws(',', {', '.join(f"CASE WHEN {sq.hit('rest', p)} THEN {sq.q(tag)} END" for p, tag in fv.SPECIAL_TAGS)}) AS special_tags FROM pt""")
def release_languages(spark, d):
    r = rel.parse_releases(fixture(spark, d, THREADS), "raw_title", "type")
    return r.select("thread_id", F.array_join("languages", ",").alias("languages"), "primary_language", "release_group", "edition",
                    F.array_join("special_tags", ",").alias("special_tags"))


@query(f"""{with_clause(THREADS)}, src AS (SELECT thread_id, raw_title, {sq.media_type('type')} AS mtype FROM fx_threads), {sq.titles('src', 'raw_title')},{sq.release_episodes('pt', 'raw_title', 'mtype')}
SELECT thread_id, season, episode_start, episode_end, episode_count, is_season_pack FROM pe""")
def release_season_episode(spark, d):
    t = fixture(spark, d, THREADS).withColumn("type", tx.normalize_media_type(F.col("type")))
    r = rel.parse_releases(t, "raw_title", "type")
    return r.select("thread_id", "season", "episode_start", "episode_end", "episode_count", "is_season_pack")


@query(f"""{with_clause(THREADS)}, f0 AS (SELECT thread_id, raw_title, lower(type) = 'movie' AS mv, {sq.ext('raw_title', fv.YEAR_BRACKETED, 0)} AS mark FROM fx_threads),
f1 AS (SELECT *, COALESCE({sq.num(sq.ext('mark', fv.YEAR_BRACKETED))}, 0) AS year, CASE WHEN mark <> '' THEN trim(substr(raw_title, 1, strpos(raw_title, mark) - 1)) ELSE '' END AS bef,
   CASE WHEN mark <> '' THEN trim(substr(raw_title, strpos(raw_title, mark) + length(mark))) ELSE '' END AS aft FROM f0),
f2 AS (SELECT * EXCLUDE (bef, aft), CASE WHEN bef = '' THEN raw_title ELSE bef END AS bef, CASE WHEN aft = '' THEN raw_title ELSE aft END AS txt FROM f1),
f3 AS (SELECT *, CASE WHEN year = 0 AND {sq.hit('bef', fv.FORUM_BOUNDARY)} AND length(regexp_extract(bef, {sq.q('(?s)^(.*?)' + fv.FORUM_BOUNDARY)}, 1)) > 0
   THEN trim(regexp_extract(bef, {sq.q('(?s)^(.*?)' + fv.FORUM_BOUNDARY)}, 1)) ELSE bef END AS head FROM f2),
f4 AS (SELECT *, regexp_replace({sq.strip_brackets('head')}, {sq.q(fv.EPISODE_TOKEN)}, '\\1E\\2', 'g') AS h2 FROM f3),
f5 AS (SELECT *, {sq.clean("trim(" + sq.sub(sq.sub("h2", r"\s+", " "), fv.BOXSET_WORDS) + ", ' .-_[]()/\\')")} AS title,
   {sq.num(sq.ext('txt', fv.SEASON))} AS s0, {sq.num(sq.ext('txt', fv.EPISODE_RANGE, 1))} AS lo, {sq.num(sq.ext('txt', fv.EPISODE_RANGE, 2))} AS hi,
   {sq.num(sq.ext('txt', fv.EPISODE_SINGLE))} AS one, lower({sq.ext('raw_title', fv.FORUM_QUALITY)}) AS ql FROM f4),
f6 AS (SELECT *, COALESCE(lo <= hi, false) AS rg FROM f5)
SELECT thread_id, title, CAST(year AS INTEGER) AS year, CAST(CASE WHEN mv THEN 0 WHEN s0 > 0 THEN s0 ELSE 1 END AS INTEGER) AS season,
  CAST(CASE WHEN mv THEN 0 WHEN rg THEN lo ELSE COALESCE(one, 0) END AS INTEGER) AS episode_start, CAST(CASE WHEN mv THEN 0 WHEN rg THEN hi ELSE COALESCE(one, 0) END AS INTEGER) AS episode_end,
  CASE WHEN mv THEN false ELSE rg OR one IS NULL END AS is_pack, {sq.cases('raw_title', fv.FORUM_LANGUAGES, 'en')} AS language,
  CASE WHEN ql IN ('4k', 'uhd', '2160p') THEN '4K' WHEN ql = '' THEN 'sd' ELSE ql END AS quality FROM f6""")
def forum_title(spark, d):
    t = forum.parse_forum_titles(fixture(spark, d, THREADS), "raw_title", "type", prefix="")
    return t.select("thread_id", "title", "year", "season", "episode_start", "episode_end", "is_pack", "language", "quality")


_IDT = "lower(trim(regexp_replace(regexp_replace(replace(CASE WHEN clean_title = '' THEN raw_title ELSE clean_title END, '&', 'and'), '[()\\[\\]\\-_]', ' ', 'g'), '\\s+', ' ', 'g')))"
_TOPIC = sq.ext("url", fv.TOPIC_ID)
KEYED = f"""{PARSED}, keyed AS (SELECT *, {_TOPIC} AS topic_id, sha256(CASE WHEN {_TOPIC} <> '' THEN 'topic_' || {_TOPIC}
   ELSE lower(type) || CASE WHEN clean_title <> '' AND year <> 0 THEN '_' || year ELSE '' END || '_' || {_IDT} END) AS thread_hash,
   CASE WHEN {_TOPIC} <> '' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/index.php?/forums/topic/' || {_TOPIC} || '-a/' ELSE url END AS canonical_url FROM pt)"""


@query(f"{KEYED} SELECT thread_id, topic_id, canonical_url, thread_hash FROM keyed")
def identity_keys(spark, d):
    return idn.add_identity_keys(fixture(spark, d, THREADS)).select("thread_id", "topic_id", "canonical_url", "thread_hash")


@query(f"""{with_clause(THREADS, LINKS)}, l AS (SELECT thread_id, list_sort(list(DISTINCT magnet)) AS m FROM fx_links GROUP BY 1)
SELECT thread_id, sha256(raw_title || array_to_string(m, '')) AS hash_v0, sha256(lower(trim(regexp_replace(raw_title, '\\s+', ' ', 'g')))) AS hash_v1 FROM fx_threads JOIN l USING (thread_id)""")
def legacy_hashes(spark, d):
    t = fixture(spark, d, THREADS)
    links = fixture(spark, d, LINKS).select("thread_id", "magnet").distinct().groupBy("thread_id").agg(F.collect_list("magnet").alias("m"))
    return idn.add_legacy_hashes(t.join(links, "thread_id"), "raw_title", "m").select("thread_id", "hash_v0", "hash_v1")


@query(f"{KEYED} SELECT thread_hash, count(*) AS rows FROM keyed GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return ag.duplicate_groups(fixture(spark, d, THREADS))


@query(f"{KEYED}, g AS (SELECT count(*) AS n FROM keyed GROUP BY thread_hash HAVING count(*) > 1) SELECT count(*) AS groups, CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS redundant FROM g")
def audit_duplicates(spark, d):
    return ag.audit_duplicates(fixture(spark, d, THREADS))


@query(f"""{with_clause(THREADS)} SELECT thread_id, CASE WHEN quality IN ('4K', '2160P') THEN '🚀 4K UHD' WHEN quality = '1080P' THEN '🔥 1080p HD' WHEN quality = '720P' THEN '⚡ 720p HD'
  WHEN quality IN ('480P', 'SD', '360P') THEN '📼 SD' ELSE '🎥 ' || quality END AS quality_badge, size_label FROM (SELECT thread_id, upper({sq.ext('raw_title', fv.FORUM_QUALITY)}) AS quality,
  upper({sq.ext('raw_title', fv.SIZE_TEXT, 0)}) AS size_label FROM fx_threads)""")
def shown_labels(spark, d):
    t = fixture(spark, d, THREADS)
    from reelweave.functions import regex as rx
    return t.select("thread_id", labels.quality_badge(rx.extract(F.col("raw_title"), fv.FORUM_QUALITY)).alias("quality_badge"),
                    labels.size_label(F.col("raw_title")).alias("size_label"))


@query()
def stream_titles(spark, d):
    t = rel.parse_releases(fixture(spark, d, THREADS).withColumn("type", tx.normalize_media_type(F.col("type"))), "raw_title", "type", prefix="n_")
    return labels.render_labels(t, "raw_title", "n_clean_title", "type", "n_").select(
        "thread_id", "badge_line", "stream_title", "quality_badge", "size_label", "language_label")


@query()
def plain_titles(spark, d):
    return tx.filter_noise_words(fixture(spark, d, THREADS), "raw_title").select("thread_id", "plain_title")


@query(f"""{with_clause(THREADS)} SELECT thread_id, {sq.cases('raw_title', [(r[3], r[2]) for r in fv.RULE_TAGS])} AS rule_tag FROM fx_threads""")
def rule_tag(spark, d):
    return rel.rule_tags(fixture(spark, d, THREADS), "raw_title").select("thread_id", F.coalesce("rule_tag", F.lit("")).alias("rule_tag"))


@query()
def sanitized_documents(spark, d):
    tables(spark, d)
    return tx.sanitize_names(spark.table("documents"), "text").select("doc_id", "clean_name")


# --- links and files ---------------------------------------------------------

LINK_SOURCE = f"{with_clause(LINKS, THREADS)}, src AS (SELECT l.link_id, l.thread_id, l.magnet, t.type FROM fx_links l JOIN fx_threads t USING (thread_id)), {sq.links('src', 'type')}"


def _typed_links(spark, d) -> DataFrame:
    t = fixture(spark, d, THREADS).select("thread_id", "type")
    return fixture(spark, d, LINKS).join(t, "thread_id")


@query(f"{LINK_SOURCE} SELECT link_id, infohash, display_name, kind, season, episode_start, episode_end, quality, language FROM pl")
def link_parse(spark, d):
    return ln.parse_links(_typed_links(spark, d), "magnet", "type").select(
        "link_id", "infohash", "display_name", "kind", "season", "episode_start", "episode_end", "quality", "language")


@query(f"""{with_clause(LINKS)} SELECT link_id, 'magnet:?xt=urn:btih:' || {sq.LINK_HASH} || CASE WHEN {sq.LINK_NAME} <> '' THEN '&dn=' || regexp_extract(magnet, 'dn=([^&]*)', 1) ELSE '' END AS stripped_link FROM fx_links""")
def link_strip(spark, d):
    return ln.add_link_keys(fixture(spark, d, LINKS), "magnet").select("link_id", "stripped_link")


@query(f"""{with_clause(FILES)}, f AS (SELECT torrent_id, file_id, path, bytes, regexp_extract(path, '([^/]*)$', 1) AS nm FROM fx_files)
SELECT torrent_id, file_id, CAST(CASE WHEN file_id % 4 = 3 THEN 7 ELSE 1 END AS INTEGER) AS season,
  CAST(CASE file_id % 4 WHEN 0 THEN {sq.num(sq.ext('nm', fv.PATH_S_E, 2))} WHEN 1 THEN {sq.num(sq.ext('nm', fv.PATH_N_X_N, 2))}
   WHEN 2 THEN {sq.num(sq.ext('nm', fv.PATH_EP, 1))} ELSE {sq.num(sq.ext('nm', fv.PATH_NUMBER, 1))} END AS INTEGER) AS episode FROM f""")
def path_parse(spark, d):
    return pt.parse_file_paths(fixture(spark, d, FILES), "path", 7).select("torrent_id", "file_id", "season", "episode")


@query(f"""{with_clause(FILES)} SELECT torrent_id, file_id FROM fx_files WHERE bytes >= 15728640 AND regexp_matches(lower(path), '\\.(mkv|mp4|avi|flv|webm|mov)$')
  AND NOT regexp_matches(lower(path), 'special|bonus|trailer|featurette|recap|sample|extra|behind the scenes|interview')""")
def playable_files(spark, d):
    return fl.playable_files(fixture(spark, d, FILES)).select("torrent_id", "file_id")


@query(f"""{with_clause(FILES)}, f AS (SELECT torrent_id, file_id, regexp_extract(path, '([^/]*)$', 1) AS nm FROM fx_files)
SELECT torrent_id, file_id, COALESCE({sq.num(sq.ext('nm', fv.LOOSE_RANGE, 1))} <= 3 AND {sq.num(sq.ext('nm', fv.LOOSE_RANGE, 2))} >= 3, false) AS covers FROM f""")
def path_covers_episode(spark, d):
    return fixture(spark, d, FILES).select("torrent_id", "file_id", pt.covers_episode(F.col("path"), F.lit(3)).alias("covers"))


@query(f"""{with_clause(FILES)}, r AS (SELECT *, row_number() OVER (PARTITION BY torrent_id ORDER BY CASE WHEN regexp_matches(lower(path), '\\.(mkv|mp4|avi|mov)$') THEN 0 ELSE 1 END, bytes DESC, file_id) AS n
  FROM fx_files WHERE selected = 1) SELECT torrent_id, file_id, path, bytes FROM r WHERE n = 1""")
def file_pick_movie(spark, d):
    return rk.pick_movie_file(fixture(spark, d, FILES), "torrent_id", "file_id")


@query()
def file_pick_episode(spark, d):
    f = fixture(spark, d, FILES)
    want = f.select("torrent_id").distinct().select("torrent_id", F.lit(1).alias("season"), F.explode(F.array(F.lit(1), F.lit(4))).alias("episode"))
    return rk.pick_episode_file(f, want, "torrent_id", "file_id")


# --- linkage -----------------------------------------------------------------

def _score_ctes(left: str, left_norm: str, left_year: str, left_kind: str, left_id: str) -> str:
    """CTEs t and r: distinct titles with bigrams, ready to be scored against each other."""
    return f"""t0 AS (SELECT DISTINCT {left_norm} AS norm, {left_year} AS year, {left_kind} AS kind FROM {left}),
{sq.bigrams('t0', 'norm', 'bg', 't').strip()}, r0 AS (SELECT {sq.norm('title')} AS norm, CAST(year AS INTEGER) AS year, type AS kind, min(tmdb_id) AS ref_id FROM fx_reference GROUP BY 1, 2, 3),
{sq.bigrams('r0', 'norm', 'bg', 'r').strip()}"""


_T_NORM = sq.norm(r"trim(regexp_replace(clean_title, '[(\[][0-9]{4}[)\]]', ''))")
_PAIR_SCORE = sq.score(sq.dice("t.norm", "r.norm", "t.bg", "r.bg"), "t.year", "r.year")
MATCHED = f"""{with_clause(THREADS, REF)},{sq.titles(THREADS, 'raw_title')}, src AS (SELECT thread_id, {_T_NORM} AS norm, year, {sq.media_type('type')} AS kind, clean_title FROM pt),
{_score_ctes('src', 'norm', 'year', 'kind', 'thread_id')},
p AS (SELECT t.norm, t.year, t.kind, r.ref_id, {_PAIR_SCORE} AS score FROM t JOIN r ON t.kind = r.kind),
b AS (SELECT norm, year, kind, ref_id, score FROM p WHERE score >= 40 QUALIFY row_number() OVER (PARTITION BY norm, year, kind ORDER BY score DESC, ref_id) = 1)"""


@query(f"{MATCHED} SELECT src.thread_id, b.ref_id, round(b.score, 6) AS score FROM src LEFT JOIN b USING (norm, year, kind)")
def title_match(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "_rest")
    m = lk.match_titles(t.select("thread_id", "clean_title", "year", "type"), fixture(spark, d, REF))
    return m.select("thread_id", "ref_id", F.round("score", 6).alias("score"))


@query(f"{MATCHED} SELECT count(*) FILTER (b.ref_id IS NOT NULL) AS success_count, count(*) FILTER (b.ref_id IS NULL) AS fail_count FROM src LEFT JOIN b USING (norm, year, kind)")
def match_summary(spark, d):
    # written first: a count over the plan would leave out the scores and whatever else it has no need of
    return ag.match_summary(materialize(title_match(spark, d), "title-matches"))


@query()
def alias_match(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "_rest")
    m = lk.expand_aliases(t.select("thread_id", "clean_title", "year", "type"), fixture(spark, d, REF))
    return m.select("thread_id", "ref_id", F.round("score", 6).alias("score"))


_TOP_SCORE = sq.score(sq.dice("t.norm", "r.norm", "t.bg", "r.bg"), "0", "0")


@query(f"""{with_clause(THREADS, REF)},{sq.titles(THREADS, 'raw_title')}, src AS (SELECT thread_id, {sq.norm('clean_title')} AS norm FROM pt), t0 AS (SELECT DISTINCT norm FROM src),
{sq.bigrams('t0', 'norm', 'bg', 't').strip()}, ids AS (SELECT {sq.norm('title')} AS norm, tmdb_id FROM fx_reference), r0 AS (SELECT DISTINCT norm FROM ids), {sq.bigrams('r0', 'norm', 'bg', 'r').strip()},
p AS (SELECT t.norm, r.norm AS rn, {_TOP_SCORE} AS score FROM t CROSS JOIN r), p10 AS (SELECT * FROM p WHERE score > 0 QUALIFY dense_rank() OVER (PARTITION BY norm ORDER BY score DESC) <= 10),
x AS (SELECT p10.norm, ids.tmdb_id AS ref_id, score, row_number() OVER (PARTITION BY p10.norm ORDER BY score DESC, ids.tmdb_id) AS rank FROM p10 JOIN ids ON ids.norm = p10.rn)
SELECT thread_id, ref_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM src JOIN x USING (norm) WHERE rank <= 10""")
def top_candidates(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "_rest")
    return lk.top_candidates(t, fixture(spark, d, REF), "thread_id", "clean_title").select("thread_id", "ref_id", F.round("score", 6).alias("score"), "rank")


@query()
def confident_winner(spark, d):
    t = rel.add_title_parts(fixture(spark, d, THREADS), "raw_title", "clean_title", "year", "_rest").select(
        "thread_id", F.col("clean_title").alias("title"), "year", "type")
    ref = fixture(spark, d, REF)
    c = lk.top_candidates(t, ref, "thread_id", "title").select("thread_id", "ref_id").join(t, "thread_id")
    c = c.join(ref.select(F.col("tmdb_id").alias("ref_id"), F.col("title").alias("cand_title"), F.col("year").alias("cand_year"), F.col("type").alias("cand_type")), "ref_id")
    w = lk.confident_winner(c.withColumnRenamed("ref_id", "cand_id"), "thread_id")
    return w.select("thread_id", "cand_id", F.round("score", 6).alias("score"))


@query(f"""{with_clause(LINKED)},{sq.titles(LINKED, 'raw_title')}, n AS (SELECT thread_id, {sq.norm('clean_title')} AS norm, year, {sq.media_type('type')} AS kind, status, tmdb_id FROM pt),
k AS (SELECT norm, year, kind, arg_min(tmdb_id, sha256(CAST(thread_id AS STRING))) AS local_id FROM n WHERE status = 'linked' AND year > 0 AND tmdb_id IS NOT NULL AND norm <> '' GROUP BY 1, 2, 3)
SELECT n.thread_id, k.local_id FROM n LEFT JOIN k USING (norm, year, kind)""")
def local_match(spark, d):
    t = rel.add_title_parts(fixture(spark, d, LINKED), "raw_title", "clean_title", "year", "_rest")
    t = t.withColumn("thread_hash", F.sha2(F.col("thread_id").cast("string"), 256))
    return lk.match_local(t, t).select("thread_id", "local_id")


# --- streams -----------------------------------------------------------------

LATEST = with_clause(STREAMS) + ", latest AS (SELECT * FROM fx_streams QUALIFY row_number() OVER (PARTITION BY tmdb_id, infohash ORDER BY seen_at DESC, link_id DESC) = 1)"


def _latest(spark, d, *columns: str):
    """The latest streams; of the rows only ``columns`` move, where they are named."""
    s = fixture(spark, d, STREAMS)
    s = s.select(*dict.fromkeys(["tmdb_id", "infohash", "seen_at", "link_id", *columns])) if columns else s
    return rk.latest_by_key(s, ["tmdb_id", "infohash"], ["seen_at", "link_id"], fold=["infohash"])


@query(f"{LATEST} SELECT tmdb_id, infohash, link_id, season, episode, episode_end, quality, language FROM latest")
def links_latest(spark, d):
    return _latest(spark, d).select("tmdb_id", "infohash", "link_id", "season", "episode", "episode_end", "quality", "language")


REQ = "req AS (SELECT DISTINCT tmdb_id, season AS rs, e AS re FROM latest, (SELECT unnest(range(1, 10)) AS e) WHERE season IS NOT NULL)"


def _requests(streams):
    r = streams.filter(F.col("season").isNotNull()).select("tmdb_id", "season").distinct()
    return r.select("tmdb_id", "season", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("episode"))


@query(f"""{LATEST}, {REQ} SELECT req.tmdb_id, CAST(rs AS INTEGER) AS req_season, CAST(re AS INTEGER) AS req_episode, infohash FROM req JOIN latest s ON s.tmdb_id = req.tmdb_id AND (
  (s.season = rs AND (s.episode IS NULL OR (s.episode_end IS NULL AND s.episode = re) OR re BETWEEN s.episode AND s.episode_end)) OR (s.season IS NULL AND s.episode IS NULL))""")
def episode_links(spark, d):
    s = _latest(spark, d)
    return jn.episode_links(_requests(s), s).select("tmdb_id", "req_season", "req_episode", "infohash")


@query(f"""{with_clause(STREAMS, LINKED)} SELECT s.tmdb_id, s.link_id, s.infohash FROM fx_streams s WHERE tmdb_id IN (SELECT tmdb_id FROM fx_linked WHERE type = 'movie')""")
def title_links(spark, d):
    asked = fixture(spark, d, LINKED).filter("type = 'movie' AND tmdb_id IS NOT NULL")
    return jn.title_links(asked, fixture(spark, d, STREAMS)).select("tmdb_id", "link_id", "infohash")


@query(f"""{with_clause(STREAMS)}, e AS (SELECT DISTINCT tmdb_id, season, CAST(unnest(range(episode, COALESCE(episode_end, episode) + 1)) AS INTEGER) AS episode FROM fx_streams WHERE season IS NOT NULL AND episode IS NOT NULL)
SELECT tmdb_id, season, episode, 'Season ' || season || ' - Episode ' || episode AS title FROM e""")
def episode_coverage(spark, d):
    return ag.episode_coverage(fixture(spark, d, STREAMS))


@query(f"""{with_clause(LINKED, LINKS)}, src AS (SELECT l.link_id, l.magnet, t.type, t.tmdb_id FROM fx_links l JOIN fx_linked t USING (thread_id) WHERE status = 'linked' AND tmdb_id IS NOT NULL), {sq.links('src', 'type')}
SELECT link_id, tmdb_id, infohash, quality, language, CASE WHEN {sq.media_type('type')} = 'series' THEN CASE WHEN season = 0 THEN 1 ELSE season END END AS season,
 CASE WHEN {sq.media_type('type')} = 'series' AND kind <> 'SEASON_PACK' THEN episode_start END AS episode, CASE WHEN {sq.media_type('type')} = 'series' AND kind <> 'SEASON_PACK' THEN episode_end END AS episode_end FROM pl""")
def links_build(spark, d):
    t = fixture(spark, d, LINKED).select("thread_id", "type", "status", "tmdb_id")
    return ag.build_links(fixture(spark, d, LINKS).join(t, "thread_id"), carry=["link_id"]).select(
        "link_id", "tmdb_id", "infohash", "quality", "language", "season", "episode", "episode_end")


@query(f"""{with_clause(STREAMS)} SELECT link_id, CAST(CASE upper(quality) WHEN '4K' THEN 1 WHEN '2160P' THEN 1 WHEN '1080P' THEN 2 WHEN '720P' THEN 3 WHEN '480P' THEN 4 WHEN 'SD' THEN 5 ELSE 99 END AS INTEGER) AS quality_rank FROM fx_streams""")
def quality_rank(spark, d):
    return rk.rank_by_quality(fixture(spark, d, STREAMS)).select("link_id", "quality_rank")


def _shown(spark, d):
    return fixture(spark, d, STREAMS).withColumns({"is_p2p": F.col("link_id") % 3 == 0, "is_cached": F.col("link_id") % 4 == 0})


@query(f"""{with_clause(STREAMS)} SELECT tmdb_id, link_id, CAST(row_number() OVER (PARTITION BY tmdb_id ORDER BY link_id % 3 = 0,
  CASE CASE WHEN quality = '' THEN 'SD' ELSE quality END WHEN '4K' THEN 1 WHEN '2160p' THEN 1 WHEN '1080p' THEN 2 WHEN '720p' THEN 3 WHEN '480p' THEN 4 WHEN 'SD' THEN 5 ELSE 99 END,
  lower(CASE WHEN language = '' THEN 'zz' ELSE language END), link_id % 4 <> 0, link_id) AS INTEGER) AS shown_rank FROM fx_streams""")
def link_rank(spark, d):
    return rk.rank_links(_shown(spark, d), ["tmdb_id"], ["link_id"]).select("tmdb_id", "link_id", "shown_rank")


@query(f"""{with_clause(STREAMS)}, a AS (SELECT *, link_id % 3 = 0 AS p FROM fx_streams QUALIFY row_number() OVER (PARTITION BY tmdb_id, quality, language, infohash ORDER BY link_id) = 1)
SELECT tmdb_id, link_id FROM a QUALIFY row_number() OVER (PARTITION BY tmdb_id, p, CASE WHEN quality = '' THEN 'SD' ELSE quality END, lower(CASE WHEN language = '' THEN 'NA' ELSE language END), infohash ORDER BY link_id) = 1""")
def link_dedupe(spark, d):
    return rk.dedupe_links(_shown(spark, d), ["tmdb_id"], ["link_id"]).select("tmdb_id", "link_id")


@query(f"""{with_clause(STREAMS)}, said AS (SELECT infohash, bool_or(link_id % 3 = 0) AS c FROM fx_streams WHERE link_id % 2 = 0 GROUP BY 1),
kept AS (SELECT DISTINCT infohash FROM fx_streams WHERE link_id % 7 = 1 AND link_id % 4 = 1)
SELECT s.link_id, COALESCE(said.c, false) OR kept.infohash IS NOT NULL AS is_cached FROM fx_streams s LEFT JOIN said USING (infohash) LEFT JOIN kept USING (infohash)""")
def availability(spark, d):
    s = fixture(spark, d, STREAMS)
    said = s.filter("link_id % 2 = 0").select(F.upper("infohash").alias("infohash"), (F.col("link_id") % 3 == 0).alias("cached"))
    cache = s.filter("link_id % 7 = 1").select("infohash", F.when(F.col("link_id") % 4 == 1, "downloaded").otherwise("error").alias("status"))
    return jn.with_availability(s, said, cache).select("link_id", "is_cached")


@query(f"{with_clause(STREAMS)} SELECT link_id, infohash IN (SELECT infohash FROM fx_streams WHERE link_id % 5 = 2) AS is_locked FROM fx_streams")
def lock_flags(spark, d):
    s = fixture(spark, d, STREAMS)
    locks = s.filter("link_id % 5 = 2").select(F.upper("infohash").alias("infohash"))
    return jn.with_lock_flag(s, locks).select("link_id", "is_locked")


@query(f"""{with_clause(STREAMS)}, c AS (SELECT lower(substr(magnet, 21, 40)) AS infohash, arg_max({sq.LINK_NAME}, (seen_at, magnet)) AS nm FROM fx_links GROUP BY 1)
SELECT link_id, COALESCE(nm, '') AS display_name FROM fx_streams LEFT JOIN c USING (infohash)""")
def display_names(spark, d):
    s = fixture(spark, d, STREAMS)
    cache = spark.table(LINKS).select(ln.infohash(F.col("magnet")).alias("infohash"), "magnet", F.col("seen_at").alias("created_at"))
    return jn.with_display_name(s, cache).select("link_id", "display_name")


# --- catalog, audit, deletes -------------------------------------------------

def _threads(spark, d):
    """Linked listings with a hash of their own and a parsed title."""
    t = fixture(spark, d, LINKED).withColumn("thread_hash", F.sha2(F.concat(F.lit("topic_"), F.col("thread_id").cast("string")), 256))
    return rel.add_title_parts(t, "raw_title", "clean_title", "year", "_rest").drop("_rest")


T = with_clause(LINKED, REF, STREAMS, "fx_watchlist") + "," + sq.titles(LINKED, "raw_title") + ", th AS (SELECT *, sha256('topic_' || CAST(thread_id AS STRING)) AS thread_hash FROM pt)"


@query(f"{T} SELECT count(*) FILTER (status = 'linked') AS linked, count(*) FILTER (status = 'pending_tmdb') AS pending, (SELECT count(*) FROM fx_threads WHERE url = '') AS failed FROM th")
def status_counts(spark, d):
    return ag.status_counts(_threads(spark, d), spark.table(THREADS).filter("url = ''"))


@query(f"{T} SELECT thread_id, posted_at FROM th WHERE status = 'pending_tmdb'")
def pending(spark, d):
    return rk.pending(_threads(spark, d)).select("thread_id", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query(f"{T} SELECT thread_id FROM th WHERE status = 'linked' ORDER BY updated_at DESC, thread_hash LIMIT 15 OFFSET 15")
def recent_linked(spark, d):
    return rk.recent_linked(_threads(spark, d), 15, 15).select("thread_id")


@query(f"{T} SELECT t.thread_id, COALESCE(w.status, 'none') AS watch_status FROM (SELECT * FROM th WHERE {sq.media_type('type')} = 'series' AND (contains(lower(clean_title), 'gear') OR contains(lower(raw_title), 'gear')) ORDER BY thread_hash LIMIT 15) t LEFT JOIN fx_watchlist w USING (thread_hash)")
def series_search(spark, d):
    return fl.search_series(_threads(spark, d), fixture(spark, d, "fx_watchlist"), "gear").select("thread_id", "watch_status")


@query(f"{T} SELECT thread_id, COALESCE(w.status, 'none') AS watch_status FROM th LEFT JOIN fx_watchlist w USING (thread_hash)")
def watch_status(spark, d):
    return jn.with_watch_status(_threads(spark, d), fixture(spark, d, "fx_watchlist")).select("thread_id", "watch_status")


@query(f"{T} SELECT thread_id, imdb_id FROM th JOIN fx_reference r USING (tmdb_id) WHERE imdb_id IS NOT NULL")
def catalog_rows(spark, d):
    return jn.catalog_rows(_threads(spark, d), fixture(spark, d, REF)).select("thread_id", "imdb_id")


@query(f"""{T}, a AS (SELECT unnest([tmdb_id, imdb_id]) AS alias, tmdb_id, imdb_id FROM fx_reference) SELECT alias, tmdb_id, imdb_id FROM a WHERE alias IS NOT NULL""")
def resolved_ids(spark, d):
    ref = fixture(spark, d, REF)
    asked = ref.select(F.explode(F.array("tmdb_id", "imdb_id")).alias("alias")).filter("alias IS NOT NULL")
    return jn.resolve_ids(asked, ref, "alias").select("alias", "tmdb_id", "imdb_id")


_GAP = "CASE WHEN tmdb_id IS NOT NULL AND imdb_id IS NOT NULL THEN 'HEALTHY' WHEN tmdb_id IS NOT NULL THEN 'MISSING_IMDB_GAP' WHEN pend THEN 'PENDING_MATCH' ELSE 'UNLINKED' END"
ENT = f"""{T}, e0 AS (SELECT COALESCE(th.tmdb_id, thread_hash) AS entity_key, arg_min(th.tmdb_id, thread_hash) FILTER (th.tmdb_id IS NOT NULL) AS tmdb_id, arg_min(CASE WHEN clean_title = '' THEN raw_title ELSE clean_title END, thread_hash) AS title,
  arg_min(year, thread_hash) AS ty, count(*) AS threads, bool_or(status = 'pending_tmdb') AS pend FROM th GROUP BY 1),
e1 AS (SELECT e0.*, imdb_id, COALESCE(r.year, ty) AS year FROM e0 LEFT JOIN fx_reference r USING (tmdb_id))"""


@query(f"{ENT} SELECT {_GAP} AS gap_status, count(*) AS entities FROM e1 GROUP BY 1")
def gap_report(spark, d):
    return ag.gap_report(_threads(spark, d), fixture(spark, d, REF))


@query(f"""{ENT}, ids AS (SELECT entity_key, tmdb_id FROM e1), s AS (SELECT entity_key, count(DISTINCT infohash) AS streams, count(DISTINCT infohash) FILTER (infohash IN (SELECT infohash FROM fx_streams WHERE link_id % 5 = 2)) AS locked FROM ids JOIN fx_streams USING (tmdb_id) GROUP BY 1)
SELECT entity_key, title, CAST(year AS INTEGER) AS year, {_GAP} AS gap_status, threads, COALESCE(streams, 0) AS streams, COALESCE(locked, 0) AS locked FROM e1 LEFT JOIN s USING (entity_key)""")
def entity_graph(spark, d):
    s = fixture(spark, d, STREAMS)
    locks = s.filter("link_id % 5 = 2").select("infohash")
    g = ag.entity_graph(_threads(spark, d), fixture(spark, d, REF), s, fixture(spark, d, "fx_watchlist"), locks)
    n = F.coalesce(F.size("stream_list"), F.lit(0))
    locked = F.coalesce(F.size(F.filter("stream_list", lambda x: x["is_locked"])), F.lit(0))
    return g.select("entity_key", "title", F.col("year").cast("int").alias("year"), "gap_status", F.size("thread_list").cast("long").alias("threads"),
                    F.when(F.col("stream_list").isNull(), 0).otherwise(n).cast("long").alias("streams"),
                    F.when(F.col("stream_list").isNull(), 0).otherwise(locked).cast("long").alias("locked"))


@query(f"{T} SELECT thread_id FROM th WHERE {sq.media_type('type')} = 'movie' AND (contains({sq.norm('clean_title')}, 'red widget') OR contains({sq.norm('raw_title')}, 'red widget'))")
def entity_search(spark, d):
    return fl.search_entities(_threads(spark, d), "Red Widget", "movie").select("thread_id")


@query(f"{T} SELECT link_id FROM fx_streams WHERE tmdb_id NOT IN (SELECT tmdb_id FROM th WHERE tmdb_id IS NOT NULL)")
def orphans(spark, d):
    s = fixture(spark, d, STREAMS).withColumnRenamed("tmdb_id", "thread_hash")
    t = _threads(spark, d).filter("tmdb_id IS NOT NULL").select(F.col("tmdb_id").alias("thread_hash"))
    return jn.orphaned_index_rows(s, t).select("link_id")


@query(f"{T} SELECT link_id, imdb_id FROM fx_streams JOIN fx_reference USING (tmdb_id) WHERE imdb_id LIKE 'tt%' AND imdb_id <> tmdb_id")
def split_brain(spark, d):
    return jn.split_brain_links(fixture(spark, d, REF), fixture(spark, d, STREAMS)).select("link_id", "imdb_id")


@query(f"{T} SELECT thread_id, COALESCE(imdb_id, th.tmdb_id) AS tmdb_id FROM th LEFT JOIN fx_reference r ON r.tmdb_id = th.tmdb_id")
def canonical_ids(spark, d):
    return jn.canonicalize_ids(_threads(spark, d), fixture(spark, d, REF)).select("thread_id", "tmdb_id")


@query(f"""{T}, gone AS (SELECT * FROM th WHERE catalog = 'cat-a'), kept AS (SELECT * FROM th WHERE catalog <> 'cat-a')
SELECT link_id FROM fx_streams WHERE tmdb_id NOT IN (SELECT tmdb_id FROM gone WHERE tmdb_id IS NOT NULL AND tmdb_id NOT IN (SELECT tmdb_id FROM kept WHERE tmdb_id IS NOT NULL))""")
def cascade_delete(spark, d):
    t = _threads(spark, d)
    return jn.cascade_delete(t, fixture(spark, d, STREAMS), fixture(spark, d, "fx_watchlist"), t.filter("catalog = 'cat-a'"))[1].select("link_id")


@query(f"""{T}, ids AS (SELECT tmdb_id FROM fx_reference WHERE imdb_id LIKE '%7') SELECT 'streams' AS t, CAST(link_id AS STRING) AS k FROM fx_streams WHERE tmdb_id NOT IN (SELECT * FROM ids)
UNION ALL SELECT 'threads', CAST(thread_id AS STRING) FROM th WHERE tmdb_id IS NULL OR tmdb_id NOT IN (SELECT * FROM ids)
UNION ALL SELECT 'metadata', tmdb_id FROM fx_reference WHERE tmdb_id NOT IN (SELECT * FROM ids)""")
def purge_title(spark, d):
    ref = fixture(spark, d, REF)
    asked = ref.filter("imdb_id LIKE '%7'").select(F.col("imdb_id").alias("asked"))
    t, s, _, m = jn.purge_title(_threads(spark, d), fixture(spark, d, STREAMS), fixture(spark, d, "fx_watchlist"), ref, asked, "asked")
    return (s.select(F.lit("streams").alias("t"), F.col("link_id").cast("string").alias("k"))
            .unionByName(t.select(F.lit("threads").alias("t"), F.col("thread_id").cast("string").alias("k")))
            .unionByName(m.select(F.lit("metadata").alias("t"), F.col("tmdb_id").alias("k"))))


@query(f"""{T}, a AS (SELECT imdb_id AS asked, tmdb_id FROM fx_reference WHERE imdb_id LIKE '%7'), c AS (SELECT tmdb_id, count(*) AS threads, arg_min(clean_title, thread_hash) AS title FROM th WHERE tmdb_id IS NOT NULL GROUP BY 1),
s AS (SELECT tmdb_id, count(*) AS streams FROM fx_streams GROUP BY 1)
SELECT asked, a.tmdb_id, COALESCE(NULLIF(title, ''), 'Unknown Linked Title') AS title, COALESCE(threads, 0) AS threads, COALESCE(streams, 0) AS streams FROM a LEFT JOIN c USING (tmdb_id) LEFT JOIN s USING (tmdb_id)""")
def purge_preview(spark, d):
    ref = fixture(spark, d, REF)
    asked = ref.filter("imdb_id LIKE '%7'").select(F.col("imdb_id").alias("asked"))
    return jn.purge_preview(_threads(spark, d), fixture(spark, d, STREAMS), ref, asked, "asked")


@query(f"""{T}, m AS (SELECT DISTINCT t.tmdb_id AS old_id, lower(substr(magnet, 21, 40)) AS h FROM th t JOIN fx_links USING (thread_id) WHERE t.tmdb_id IS NOT NULL AND thread_id % 3 = 0)
SELECT link_id FROM fx_streams s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.old_id = s.tmdb_id AND m.h = s.infohash)""")
def relink_cleanup(spark, d):
    moved = _threads(spark, d).filter("thread_id % 3 = 0").select("thread_id", F.col("tmdb_id").alias("old_id"), F.lit("tt1").alias("new_id"))
    return jn.relink_cleanup(fixture(spark, d, STREAMS), moved.join(spark.table(LINKS), "thread_id")).select("link_id")


@query(f"{T} SELECT tmdb_id, arg_max(thread_hash, (updated_at, thread_hash)) AS thread_hash FROM th WHERE status = 'linked' AND tmdb_id IS NOT NULL GROUP BY 1")
def first_thread(spark, d):
    return jn.first_thread_per_title(_threads(spark, d))


@query(f"""{T}, i AS (SELECT *, row_number() OVER (PARTITION BY catalog, type ORDER BY COALESCE(posted_at, TIMESTAMP '1970-01-01') DESC, thread_hash) AS n FROM th WHERE status = 'linked' AND catalog <> ''),
j AS (SELECT i.*, r.imdb_id, row_number() OVER (PARTITION BY catalog, i.type ORDER BY n) AS m FROM i JOIN fx_reference r USING (tmdb_id) WHERE n > 20 AND imdb_id IS NOT NULL)
SELECT catalog, type, imdb_id, thread_id, regexp_replace(clean_title, ' S0.*$', '') AS name, CASE WHEN year > 0 THEN CAST(year AS VARCHAR) ELSE '' END AS release_info, CASE WHEN thread_id % 3 = 0 THEN 'p' || thread_id ELSE 'https://images.metahub.space/poster/medium/' || imdb_id || '/img' END AS poster,
  CASE WHEN thread_id % 2 = 0 THEN 'd' || thread_id ELSE '' END AS description FROM j WHERE m <= 40 QUALIFY row_number() OVER (PARTITION BY catalog, type, imdb_id ORDER BY m) = 1""")
def catalog_page(spark, d):
    from reelweave.plans import catalog as ct
    return ct.catalog_page(_custom_fields(_threads(spark, d)), fixture(spark, d, REF), skip=20).select(
        "catalog", "type", "imdb_id", "thread_id", "name", "release_info", "poster", "description")


def _custom_fields(threads):
    number = F.col("thread_id").cast("string")
    return threads.withColumns({"custom_poster": F.when(F.col("thread_id") % 3 == 0, F.concat(F.lit("p"), number)),
                                "custom_description": F.when(F.col("thread_id") % 2 == 0, F.concat(F.lit("d"), number)).otherwise(F.lit(""))})


# --- merges ------------------------------------------------------------------

_MERGE_SRC = f"""{with_clause(THREADS, LINKS)}, l AS (SELECT thread_id, list(m ORDER BY first_id, m) AS mags FROM (SELECT thread_id, magnet AS m, min(link_id) AS first_id FROM fx_links GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT t.thread_id, raw_title, {sq.media_type('type')} AS type, url, COALESCE(mags, []) AS mags, CAST(thread_id % 1500 AS STRING) AS h FROM fx_threads t LEFT JOIN l USING (thread_id)),
o AS (SELECT * FROM s WHERE thread_id < 1500), n AS (SELECT * FROM s WHERE thread_id >= 1500 AND thread_id < 3000)"""


def _merge_sides(spark, d):
    t = fixture(spark, d, THREADS)
    l = fixture(spark, d, LINKS).groupBy("thread_id", "magnet").agg(F.min("link_id").alias("i")).groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "magnet"))).alias("l")).select("thread_id", F.col("l.magnet").alias("magnet_uris"))
    s = t.join(l, "thread_id", "left").withColumn("magnet_uris", F.coalesce("magnet_uris", F.array().cast("array<string>")))
    s = s.withColumn("thread_hash", (F.col("thread_id") % 1500).cast("string")).withColumn("type", tx.normalize_media_type(F.col("type")))
    return s.filter("thread_id < 1500"), s.filter("thread_id >= 1500")


_MERGE_ALL = _MERGE_SRC.replace("thread_id >= 1500 AND thread_id < 3000", "thread_id >= 1500")
_FOLD = """, nl AS (SELECT h, list(m ORDER BY newest DESC, pos) AS mags FROM (SELECT h, m, max(thread_id) AS newest, min_by(pos, -thread_id) AS pos FROM (SELECT h, thread_id, unnest(mags) AS m, generate_subscripts(mags, 1) AS pos FROM n) GROUP BY 1, 2) GROUP BY 1),
nn AS (SELECT h, max(thread_id) AS thread_id, arg_max(raw_title, thread_id) AS raw_title, arg_max(type, thread_id) AS type, arg_max(url, thread_id) FILTER (url <> '') AS url FROM n GROUP BY 1),
mg AS (SELECT COALESCE(nn.h, o.h) AS h, COALESCE(nn.thread_id, o.thread_id) AS thread_id, COALESCE(nn.raw_title, o.raw_title) AS raw_title, COALESCE(nn.type, o.type) AS type, COALESCE(nn.url, o.url, '') AS url,
  list_concat(COALESCE(nl.mags, []), list_filter(COALESCE(o.mags, []), lambda x: NOT list_contains(COALESCE(nl.mags, []), x))) AS mags FROM nn FULL JOIN o ON nn.h = o.h LEFT JOIN nl ON nl.h = nn.h)"""


@query(_MERGE_ALL + _FOLD + " SELECT h AS thread_hash, thread_id, raw_title, type, url, array_to_string(mags, ' ') AS links FROM mg")
def merge_threads(spark, d):
    old, new = _merge_sides(spark, d)
    m = mg.upsert_threads(old, new, "thread_id", ["thread_id", "raw_title", "type"])
    return m.select("thread_hash", "thread_id", "raw_title", "type", "url", F.array_join("magnet_uris", " ").alias("links"))


@query(_MERGE_ALL + """ SELECT n.thread_id, o.raw_title = n.raw_title AND (o.url = '' OR n.url = '' OR o.url = n.url) AND len(o.mags) = len(n.mags) AND len(list_filter(n.mags, lambda x: NOT list_contains(o.mags, x))) = 0 AS unchanged FROM n JOIN o USING (h)""")
def unchanged_rows(spark, d):
    old, new = _merge_sides(spark, d)
    o = old.select("thread_hash", F.col("raw_title").alias("t0"), F.col("url").alias("u0"), F.col("magnet_uris").alias("m0"))
    n = new.join(o, "thread_hash")
    return n.select("thread_id", ag.is_unchanged(F.col("t0"), F.col("raw_title"), F.col("u0"), F.col("url"), F.col("m0"), F.col("magnet_uris")).alias("unchanged"))


_STRIPPED = "'magnet:?xt=urn:btih:' || lower(substr(magnet, 21, 40)) || CASE WHEN regexp_matches(magnet, 'dn=') THEN '&dn=' || regexp_extract(magnet, 'dn=([^&]*)', 1) ELSE '' END"


@query(f"""{with_clause(LINKED, LINKS)},{sq.titles(LINKED, 'raw_title')},
keyed AS (SELECT *, {_TOPIC} AS topic_id, sha256(CASE WHEN {_TOPIC} <> '' THEN 'topic_' || {_TOPIC} ELSE lower(type) || CASE WHEN clean_title <> '' AND year <> 0 THEN '_' || year ELSE '' END || '_' || {_IDT} END) AS thread_hash,
 CASE WHEN {_TOPIC} <> '' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/index.php?/forums/topic/' || {_TOPIC} || '-a/' ELSE '' END AS cu FROM pt),
top AS (SELECT thread_hash, arg_max(thread_id, (updated_at, -thread_id)) AS thread_id, count(*) AS rows, COALESCE(arg_max(cu, (updated_at, -thread_id)) FILTER (url <> ''), '') AS url FROM keyed GROUP BY 1),
l AS (SELECT k.thread_hash, {_STRIPPED} AS s, max((updated_at, -k.thread_id)) AS best FROM keyed k JOIN fx_links l USING (thread_id) GROUP BY 1, 2),
c AS (SELECT thread_hash, count(*) AS links FROM l GROUP BY 1)
SELECT thread_hash, top.thread_id, rows, url, clean_title, COALESCE(links, 0) AS links FROM top JOIN (SELECT thread_id, clean_title FROM pt) USING (thread_id) LEFT JOIN c USING (thread_hash)""")
def consolidate(spark, d):
    t = fixture(spark, d, LINKED)
    l = fixture(spark, d, LINKS).groupBy("thread_id", "magnet").agg(F.min("link_id").alias("i")).groupBy("thread_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "magnet"))).alias("l")).select("thread_id", F.col("l.magnet").alias("magnet_uris"))
    c = ag.consolidate_duplicates(t.join(l, "thread_id", "left"))
    return c.select("thread_hash", "thread_id", "rows", "url", "clean_title", F.when(F.col("magnet_uris").isNull(), 0).otherwise(F.size("magnet_uris")).cast("long").alias("links"))


@query(f"""{T} SELECT COALESCE(t.thread_hash, w.thread_hash) AS thread_hash, COALESCE(NULLIF(t.url, ''), w.url, '') AS url, COALESCE(CASE WHEN t.clean_title = '' THEN t.raw_title ELSE t.clean_title END, w.title) AS title,
  COALESCE(w.status, 'active') AS status, COALESCE(w.episode_count, 0) AS episode_count, CASE WHEN t.thread_hash IS NOT NULL THEN {AS_OF} ELSE w.last_updated END AS last_updated
  FROM (SELECT * FROM th WHERE status = 'linked' AND {sq.media_type('type')} = 'series') t FULL JOIN fx_watchlist w USING (thread_hash)""")
def enroll_series(spark, d):
    w = mg.enroll_series(fixture(spark, d, "fx_watchlist"), _threads(spark, d).filter("status = 'linked'"), as_of())
    return w.select("thread_hash", "url", "title", "status", "episode_count", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query(f"""{T} SELECT thread_hash, CASE WHEN status = 'active' AND last_updated < {AS_OF} - INTERVAL 30 DAY THEN 'archived' ELSE status END AS status FROM fx_watchlist""")
def archive_inactive(spark, d):
    return mg.archive_inactive(fixture(spark, d, "fx_watchlist"), as_of()).select("thread_hash", "status")


@query(f"""{T}, c AS (SELECT thread_hash, CASE thread_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'paused' ELSE 'active' END AS ns FROM th WHERE thread_id % 6 < 4)
SELECT thread_hash, COALESCE(ns, status) AS status, CASE WHEN ns IS NOT NULL THEN {AS_OF} ELSE last_updated END AS last_updated FROM fx_watchlist LEFT JOIN c USING (thread_hash) WHERE ns IS NULL OR ns <> 'delete'""")
def set_watch_status(spark, d):
    c = _threads(spark, d).filter("thread_id % 6 < 4").selectExpr("thread_hash", "CASE thread_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'paused' ELSE 'active' END AS new_status")
    return mg.set_watch_status(fixture(spark, d, "fx_watchlist"), c, as_of()).select(
        "thread_hash", "status", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


_STATE = "CASE event_type WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'stalled (no seeds)' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'error' ELSE '' END"


@query(f"""WITH s AS (SELECT event_id, lower(CASE WHEN {_STATE} = '' THEN 'queued' ELSE {_STATE} END) AS st, value / 50.0 AS progress, ts FROM events)
SELECT event_id, st AS state, NOT (st IN ('completed', 'cached', 'downloaded', 'seeding', 'uploading') OR progress >= 1.0) AND (st IN ('expired', 'error', 'failed', 'paused') OR contains(st, 'stalled') OR date_trunc('second', ts) < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR) AS is_stale FROM s""")
def stale_downloads(spark, d):
    tables(spark, d)
    s = spark.table("events").select(
        "event_id", F.expr(_STATE).alias("download_state"), F.lit("queued").alias("status"), (F.col("value") / 50.0).alias("progress"),
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        F.lit("").alias("updated_at"), F.lit("").alias("timestamp"))
    return fl.flag_stale_downloads(s, F.expr("TIMESTAMP '2024-01-20 00:00:00'")).select("event_id", "state", "is_stale")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def ttl_expire(spark, d):
    tables(spark, d)
    return fl.expire(spark.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.expr("TIMESTAMP '2024-01-20 00:00:00'"), days=7)[0].select("event_id")


@query(sq.admitted("events", "user_id", "ts", "event_id", 8, 43200))
def rate_limited(spark, d):
    tables(spark, d)
    e = spark.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rk.flag_rate_limited(e, "user_id", "ts", "event_id", n=8, seconds=43200)


@query("SELECT event_id, (max(0) OVER ()) + row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def assigned_ids(spark, d):
    tables(spark, d)
    e = spark.table("events").select("event_id", "ts", F.lit(0).cast("long").alias("id"))
    return rk.assign_ids(e, ["ts", "event_id"]).select("event_id", "id")


# --- pages -------------------------------------------------------------------

@query("SELECT page_id, contains(html, 'cloudflare') AND (contains(html, 'captcha') OR contains(html, 'challenge-platform') OR contains(html, 'Access denied')) AS is_blocked FROM pages")
def page_blocked(spark, d):
    tables(spark, d)
    return pg.flag_blocked_pages(spark.table("pages")).select("page_id", "is_blocked")


_ROUTES = [("http://", "series", "plain"), ("https://m.", "movie", "mobile/"), ("https://th", "series", "thirds")]


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://th') THEN 'series' WHEN starts_with(url, 'https://m.') THEN 'movie' WHEN starts_with(url, 'http:') THEN 'series' ELSE 'movie' END AS type,
CASE WHEN starts_with(url, 'https://th') THEN 'thirds' WHEN starts_with(url, 'https://m.') THEN 'mobile/' WHEN starts_with(url, 'http:') THEN 'plain' ELSE 'tamil-hd-movies' END AS catalog FROM pages""")
def page_routes(spark, d):
    tables(spark, d)
    return pg.route_pages(spark.table("pages"), _ROUTES).select("page_id", "type", "catalog")


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim({x})"


@query(f"SELECT page_id, {_unescape('''regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')''')} AS title FROM pages")
def page_titles(spark, d):
    tables(spark, d)
    return spark.table("pages").select("page_id", pg.page_title(F.col("html")).alias("title"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(regexp_extract(html, '(?is)(<article\\b.*?</article>)', 1), '(?is)<a\\b[^>]*?\\bhref="(http[^"]*)"', 1))) AS link FROM pages""")
def page_links(spark, d):
    tables(spark, d)
    p = pg.extract_links(spark.table("pages"), scheme="http")
    return p.select("page_id", F.explode("magnet_uris").alias("link"))


@query(f"""{with_clause(THREADS)}, x AS (SELECT thread_id, trim(raw_title) AS raw_title, CASE WHEN thread_id % 4 = 0 THEN 'https://forum.example.com/index.php?/forums/topic/' || thread_id || '-t/' ELSE url END AS u FROM fx_threads)
SELECT raw_title, 'https://forum.example.com/index.php?/forums/topic/' || {sq.ext('u', fv.TOPIC_ID)} || '-a/' AS topic_url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(thread_id % 28 AS INT) + INTERVAL 1 HOUR * CAST(thread_id % 10 AS INT) AS posted_at FROM x WHERE u <> ''""")
def page_listings(spark, d):
    items = fixture(spark, d, "fx_listing_pages")
    pages = items.groupBy("url", F.pmod(F.hash("thread_id"), F.lit(64)).alias("sheet")).agg(F.concat_ws("\n", F.collect_list("item")).alias("html"))
    return pg.extract_listings(pages).select("raw_title", "topic_url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query(f"""{with_clause(THREADS, LINKS)} SELECT DISTINCT t.thread_id, trim(raw_title) AS raw_title, magnet FROM fx_threads t JOIN fx_links USING (thread_id)""")
def page_magnets(spark, d):
    t = fixture(spark, d, LINKS).join(spark.table(THREADS).select("thread_id", "raw_title"), "thread_id")
    anchors = F.concat(F.lit('<a href="'), F.replace("magnet", F.lit("&"), F.lit("&amp;")), F.lit('">x</a>'))
    html = F.concat(F.lit('<html><h1 class="ipsType_pageTitle"> '), F.first("raw_title"), F.lit(' </h1><div class="ipsPad">'),
                    F.concat_ws("<br>", F.collect_list(anchors)), F.lit("</div></html>"))
    pages = t.groupBy("thread_id").agg(html.alias("html"))
    return pg.extract_links(pages).select("thread_id", "raw_title", F.explode("magnet_uris").alias("magnet"))


# --- requests, merges and pages that nothing above reaches ----------------------

_REQUESTS = f"{LATEST}, asked AS (SELECT tmdb_id || ':' || season || ':' || (link_id % 40) AS id FROM latest WHERE season IS NOT NULL UNION SELECT tmdb_id FROM latest UNION SELECT 'x:pending:' || tmdb_id || ':1:' || (4000000000 + link_id) FROM latest)"


@query(f"""{_REQUESTS}, s AS (SELECT id, string_split(regexp_replace(id, '^.*?:pending:', ''), ':') AS p FROM asked)
SELECT id, p[1] AS base_id, CASE WHEN len(p) = 3 THEN p[2]::BIGINT ELSE -1 END AS season, CASE WHEN len(p) = 3 THEN p[3]::BIGINT ELSE -1 END AS episode FROM s""")
def request_ids(spark, d):
    s = _latest(spark, d)
    numbered = s.filter("season IS NOT NULL").select(F.concat_ws(":", "tmdb_id", "season", F.col("link_id") % 40).alias("id"))
    waiting = s.select(F.concat(F.lit("x:pending:"), "tmdb_id", F.lit(":1:"), (F.lit(4000000000) + F.col("link_id")).cast("string")).alias("id"))
    return fl.split_request_ids(numbered.union(s.select("tmdb_id")).union(waiting).distinct())


_DOWN = f"""{LATEST}, c AS (SELECT infohash, max(link_id) AS note FROM latest WHERE link_id % 2 = 0 GROUP BY 1), n AS (SELECT infohash, max(link_id) AS link_id FROM latest WHERE link_id % 3 = 0 GROUP BY 1)"""


@query(f"""{_DOWN} SELECT COALESCE(c.infohash, n.infohash) AS infohash, CASE WHEN n.infohash IS NOT NULL THEN 'downloaded' ELSE 'queued' END AS status, c.note,
CASE WHEN n.infohash IS NOT NULL THEN {AS_OF} ELSE TIMESTAMP '2030-01-01 00:00:00' END AS last_checked FROM c FULL JOIN n USING (infohash)""")
def record_downloads(spark, d):
    # read twice below: the streams are grouped once
    s = materialize(_latest(spark, d, "link_id").select("infohash", "link_id"), "latest-streams")
    cache = s.filter("link_id % 2 = 0").groupBy("infohash").agg(F.max("link_id").alias("note")).select(
        "infohash", F.lit("queued").alias("status"), "note", F.expr("TIMESTAMP '2030-01-01 00:00:00'").alias("last_checked"))
    infos = s.filter("link_id % 3 = 0").select(F.upper("infohash").alias("infohash"), F.lit("downloaded").alias("status"))
    return mg.record_downloads(cache, infos, as_of()).withColumn("last_checked", F.col("last_checked").cast("timestamp_ntz"))


@query(f"""{T}, o AS (SELECT thread_hash FROM th WHERE thread_id % 3 = 0), b AS (SELECT thread_hash FROM th WHERE thread_id % 2 = 0), x AS (SELECT thread_hash FROM th WHERE thread_id % 5 = 0)
SELECT COALESCE(o.thread_hash, b.thread_hash) AS thread_hash, CASE WHEN b.thread_hash IS NOT NULL THEN 'new' ELSE 'old' END AS reason FROM o FULL JOIN b USING (thread_hash) WHERE COALESCE(o.thread_hash, b.thread_hash) NOT IN (SELECT thread_hash FROM x)""")
def failures(spark, d):
    t = _threads(spark, d)
    old = t.filter("thread_id % 3 = 0").select("thread_hash", F.lit("old").alias("reason"), F.expr("TIMESTAMP '2030-01-01 00:00:00'").alias("last_attempt"))
    new = t.filter("thread_id % 2 = 0").select("thread_hash", F.lit("new").alias("reason"), as_of().alias("last_attempt"))
    return mg.clear_failures(mg.log_failures(old, new), t.filter("thread_id % 5 = 0")).select("thread_hash", "reason")


@query(f"""{T} SELECT thread_hash, {AS_OF} - INTERVAL 1 HOUR * CAST(thread_id AS INT) AS last_attempt FROM th ORDER BY last_attempt DESC, thread_hash LIMIT 15 OFFSET 30""")
def failed_page(spark, d):
    rows = _threads(spark, d).select("thread_hash", (as_of() - F.make_dt_interval(F.lit(0), F.col("thread_id").cast("int"))).alias("last_attempt"))
    return rk.failed(rows, offset=30).withColumn("last_attempt", F.col("last_attempt").cast("timestamp_ntz"))


@query(f"""{T} SELECT thread_id, CASE WHEN thread_id % 2 = 0 THEN CASE WHEN thread_id % 4 = 0 THEN NULL ELSE 'p' || thread_id END ELSE 'old' END AS custom_poster,
CASE WHEN thread_id % 2 = 0 THEN 'text' ELSE 'was' END AS custom_description FROM th""")
def custom_meta(spark, d):
    t = _threads(spark, d).select("thread_id", F.lit("old").alias("custom_poster"), F.lit("was").alias("custom_description"))
    made = t.filter("thread_id % 2 = 0").select("thread_id", F.when(F.col("thread_id") % 4 == 0, " ").otherwise(F.concat(F.lit("p"), F.col("thread_id").cast("string"))).alias("poster"), F.lit("text").alias("description"))
    return mg.apply_custom_meta(t, made)


@query(f"""{LATEST} SELECT link_id, CASE WHEN contains(lower(quality), '2160') OR contains(lower(quality), '4k') THEN '4k' WHEN contains(quality, '1080') THEN '1080p' WHEN contains(quality, '720') THEN '720p' WHEN contains(quality, '480') THEN '480p' WHEN contains(quality, '360') THEN '360p' ELSE 'sd' END AS by_text,
CASE link_id % 7 WHEN 0 THEN '4K' WHEN 1 THEN '1080p' WHEN 2 THEN '720p' WHEN 3 THEN '480p' WHEN 4 THEN '576p' WHEN 5 THEN '360p' ELSE 'sd' END AS by_height FROM latest""")
def qualities(spark, d):
    heights = F.get(F.array(*[F.lit(h) for h in (2160, 1080, 720, 480, 576, 360, 144)]), (F.col("link_id") % 7).cast("int"))
    return _latest(spark, d).select("link_id", rel.quality_from_text(F.col("quality")).alias("by_text"), rel.quality_from_height(heights).alias("by_height"))


@query(f"""{with_clause(THREADS, LINKS)} SELECT 'links' AS table_name, (SELECT count(*) FROM fx_links) AS source_rows, (SELECT count(*) FROM fx_links WHERE link_id % 2 = 0) AS target_rows, false AS agrees
UNION ALL SELECT 'threads', (SELECT count(*) FROM fx_threads), (SELECT count(*) FROM fx_threads), true""")
def reconcile(spark, d):
    t, l = fixture(spark, d, THREADS), fixture(spark, d, LINKS)
    return ag.reconcile_counts({"threads": t, "links": l}, {"threads": t, "links": l.filter("link_id % 2 = 0")})
