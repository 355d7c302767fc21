"""Pieces of checking SQL (DuckDB dialect, RE2 patterns as they are)."""

from __future__ import annotations

from reelweave import fixed_values as fv


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bare(pattern: str) -> str:
    return pattern.replace("(?i)", "")


def hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def ext(col: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({col}, {q(pattern)}, {group})"


def sub(col: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(by)}, 'g')"


def num(text: str) -> str:
    return f"TRY_CAST({text} AS INTEGER)"


def soften(x: str) -> str:
    x = f"replace({x}, '&', 'and')"
    return sub(sub(sub(x, fv.BRACKETS, " "), fv.SPACED_PUNCT, " "), fv.SUFFIX_PUNCT, r"\1")


def norm(x: str) -> str:
    x = f"lower(trim({sub(soften(x), r'[ \t\n]+', ' ')}))"
    return f"trim(regexp_replace({x}, '^(?:the|a|an|le|la|les) ', ''))"


def clean(x: str) -> str:
    return f"trim({sub(sub(sub(soften(x), fv.ORPHAN_TAIL), fv.TRAILING_PUNCT), r'[ \t\n]+', ' ')})"


def strip_brackets(x: str) -> str:
    tokens = "|".join(t.replace(".", r"\.") for t in fv.BRACKET_TOKENS) + "|" + bare(fv.SIZE_TEXT)
    return sub(x, rf"(?i)[\[(][^\[\]()]*(?:{tokens})[^\[\]()]*[\])]")


def media_type(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ('tv','series','tvshow','show') THEN 'series' ELSE 'movie' END"


def prefixes(x: str) -> str:
    for p in (fv.PREFIX_BRACKETED_SITE, fv.PREFIX_DOMAIN, fv.PREFIX_SITE_NAME):
        x = f"regexp_replace({x}, {q(p)}, '')"
    return f"trim({x})"


def cases(col: str, rules, default: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {hit(col, p)} THEN {q(v)}" for p, v in rules) + f" ELSE {q(default)} END"


def titles(source: str, title: str, name: str = "pt") -> str:
    """CTEs ending in ``name``: source rows with clean_title, year (0 unknown) and remainder."""
    bound = "(?i)(?:" + "|".join(fv.BOUNDARIES) + ")"
    return f"""
{name}_a AS (SELECT *, {prefixes(title)} AS w FROM {source}),
{name}_b AS (SELECT *, CASE WHEN {hit('w', fv.YEAR_BRACKETED)} THEN {ext('w', fv.YEAR_BRACKETED)}
                      ELSE {ext('w', fv.YEAR_BARE_RANGE)} END AS y FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN y <> '' THEN strpos(w, y) - CASE WHEN strpos(w, y) > 1 AND w[strpos(w, y)-1] IN ('(', '[') THEN 2 ELSE 1 END ELSE 0 END AS ya,
   CASE WHEN {hit('w', bound)} THEN length(regexp_extract(w, {q('(?s)^(.*?)' + bound)}, 1)) ELSE 0 END AS ba FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN ya > 0 THEN ya ELSE ba END AS cut FROM {name}_c),
{name}_e AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN cut > 0 THEN substr(w, 1, cut) ELSE w END, '\\($', ''), '\\[$', '')) AS head,
   CASE WHEN cut > 0 THEN substr(w, cut + 1) ELSE '' END AS rest FROM {name}_d),
{name} AS (SELECT * EXCLUDE (w, y, ya, ba, cut, head), {clean(strip_brackets('head'))} AS clean_title,
   CAST(COALESCE(TRY_CAST(y AS INTEGER), 0) AS INTEGER) AS year FROM {name}_e)"""


def valid_error(title: str, year: str | None = None) -> str:
    words = f"list_filter(string_split_regex(lower({title}), '\\s+'), lambda x: x <> '')"
    metas = "[" + ",".join(q(w) for w in fv.METADATA_WORDS) + "]"
    year_rule = f"WHEN {year} <> 0 AND ({year} < 1900 OR {year} > 2030) THEN {q(fv.INVALID_YEAR)}" if year else ""
    return (f"CASE WHEN trim({title}) = '' THEN {q(fv.INVALID_EMPTY)} "
            f"WHEN len(list_filter({words}, lambda x: list_contains({metas}, x))) * 2 > len({words}) THEN {q(fv.INVALID_METADATA)} {year_rule} END")


def episodes(source: str, col: str, name: str, tag: str = "e") -> str:
    """CTE ``name``: source rows with {tag}_season, {tag}_lo, {tag}_hi, {tag}_n of a text column."""
    lo1, hi1 = num(ext(col, fv.EPISODE_RANGE, 1)), num(ext(col, fv.EPISODE_RANGE, 2))
    loose = (f"list_filter(list_zip(regexp_extract_all({col}, {q(fv.LOOSE_RANGE)}, 1), regexp_extract_all({col}, {q(fv.LOOSE_RANGE)}, 2)), "
             "lambda r: TRY_CAST(r[1] AS INTEGER) < 1000 AND TRY_CAST(r[2] AS INTEGER) < 1000 AND TRY_CAST(r[1] AS INTEGER) <= TRY_CAST(r[2] AS INTEGER))")
    return f"""
{name}_a AS (SELECT *, {num(ext(col, fv.SEASON))} AS s0, {lo1} AS l1, {hi1} AS h1, {loose} AS lz, {num(ext(col, fv.EPISODE_SINGLE))} AS one,
   {num(ext(col, fv.DAILY_DATE, 1))} AS cen, {num(ext(col, fv.DAILY_DATE, 2))} AS mon, {num(ext(col, fv.BARE_EPISODE))} AS bare FROM {source}),
{name}_b AS (SELECT *, CASE WHEN l1 <= h1 THEN l1 WHEN len(lz) > 0 THEN TRY_CAST(lz[1][1] AS INTEGER) ELSE COALESCE(one, CASE WHEN mon IS NULL THEN bare END) END AS lo,
   CASE WHEN l1 <= h1 THEN h1 WHEN len(lz) > 0 THEN TRY_CAST(lz[1][2] AS INTEGER) ELSE COALESCE(one, CASE WHEN mon IS NULL THEN bare END) END AS hi FROM {name}_a),
{name} AS (SELECT * EXCLUDE (s0, l1, h1, lz, one, cen, mon, bare, lo, hi), COALESCE(cen, CASE WHEN s0 > 0 THEN s0 ELSE 1 END) AS {tag}_season,
   COALESCE(mon, lo, 0) AS {tag}_lo, COALESCE(mon, hi, 0) AS {tag}_hi,
   CASE WHEN lo IS NULL THEN 0 ELSE hi - lo + 1 END + CASE WHEN mon IS NULL THEN 0 ELSE 1 END AS {tag}_n FROM {name}_b)"""


def release_episodes(source: str, raw: str, kind: str, name: str = "pe") -> str:
    """CTEs ending in ``name``: season, episode_start, episode_end, episode_count, is_season_pack."""
    return f"""{episodes(source, 'rest', name + '_r', 'r')},{episodes(name + '_r', raw, name + '_w', 'w')},
{name}_x AS (SELECT *, lower({kind}) = 'series' AND r_n = 0 AS again, lower({kind}) = 'movie' AS mv FROM {name}_w),
{name} AS (SELECT * EXCLUDE (again, mv, r_season, r_lo, r_hi, r_n, w_season, w_lo, w_hi, w_n),
   CAST(CASE WHEN mv THEN 0 WHEN again THEN w_season ELSE r_season END AS INTEGER) AS season,
   CAST(CASE WHEN mv THEN 0 WHEN again THEN w_lo ELSE r_lo END AS INTEGER) AS episode_start,
   CAST(CASE WHEN mv THEN 0 WHEN again THEN w_hi ELSE r_hi END AS INTEGER) AS episode_end,
   CAST(CASE WHEN mv THEN 0 WHEN again THEN w_n ELSE r_n END AS INTEGER) AS episode_count,
   CASE WHEN mv THEN false WHEN again THEN w_n = 0 ELSE r_n = 0 END AS is_season_pack FROM {name}_x)"""


LINK_HASH = f"lower(regexp_extract(magnet, {q(fv.INFOHASH)}, 1))"
LINK_NAME = "url_decode(replace(regexp_extract(magnet, '[?&]dn=([^&]*)', 1), '+', ' '))"


def links(source: str, kind: str, name: str = "pl") -> str:
    """CTEs ending in ``name``: parsed links of a source with ``magnet`` and a type column."""
    return f"""
{name}_s AS (SELECT *, {LINK_HASH} AS infohash, {LINK_NAME} AS display_name FROM {source}),
{name}_n AS (SELECT *, {prefixes('display_name')} AS nm FROM {name}_s WHERE infohash <> ''),{titles(name + '_n', 'nm', name + '_t')},
{release_episodes(name + '_t', 'nm', kind, name + '_e')},
{name}_f AS (SELECT * EXCLUDE (season, episode_start, episode_end), season AS s1, episode_start AS lo1, episode_end AS hi1,
   display_name = '' AS nameless, lower({kind}) = 'movie' AS mv FROM {name}_e),
{name} AS (SELECT * EXCLUDE (s1, lo1, hi1, nameless, mv),
   CASE WHEN nameless THEN 'SINGLE_EPISODE' WHEN mv THEN 'MOVIE' WHEN is_season_pack THEN 'SEASON_PACK'
        WHEN episode_count > 1 OR (lo1 > 0 AND hi1 > 0) THEN 'EPISODE_PACK' ELSE 'SINGLE_EPISODE' END AS kind,
   CAST(CASE WHEN nameless OR mv THEN 0 WHEN s1 = 0 THEN 1 ELSE s1 END AS INTEGER) AS season,
   CAST(CASE WHEN nameless OR mv THEN 0 ELSE lo1 END AS INTEGER) AS episode_start,
   CAST(CASE WHEN nameless OR mv THEN 0 ELSE hi1 END AS INTEGER) AS episode_end,
   CASE WHEN nameless THEN 'sd' ELSE {cases('rest', fv.RESOLUTIONS)} END AS quality,
   CASE WHEN nameless THEN 'ta' ELSE {cases('nm', fv.LANGUAGES, 'en')} END AS language FROM {name}_f)"""


def bigrams(source: str, col: str, out: str, name: str) -> str:
    """CTE ``name``: source rows with the distinct look-alike bigrams of a column."""
    reps = "CASE c " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.LOOK_ALIKES.items()) + " ELSE c END"
    chars = f"list_transform(string_split({col}, ''), lambda c: string_split({reps}, ''))"
    pairs = (f"list_distinct(flatten(list_transform(range(1, length({col})), lambda i: flatten(list_transform({out}_c[i], "
             f"lambda a: list_transform({out}_c[i + 1], lambda b: a || b))))))")
    return f"""
{name}_a AS (SELECT *, {chars} AS {out}_c FROM {source}),
{name} AS (SELECT * EXCLUDE ({out}_c), {pairs} AS {out} FROM {name}_a)"""


def dice(a: str, b: str, ba: str, bb: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({ba}) = 0 OR len({bb}) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * len(list_intersect({ba}, {bb}))::DOUBLE / (len({ba}) + len({bb}))::DOUBLE END")


def score(d: str, ya: str, yb: str) -> str:
    part = (f"CASE WHEN {ya} > 0 AND {yb} > 0 THEN CASE WHEN {ya} = {yb} THEN 40.0::DOUBLE WHEN abs({ya} - {yb}) = 1 THEN 25.0::DOUBLE "
            f"WHEN abs({ya} - {yb}) <= 3 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 20.0::DOUBLE END")
    return f"CASE WHEN {d} < 0.18::DOUBLE THEN {d} * 60.0::DOUBLE ELSE {part} + {d} * 60.0::DOUBLE END"


def admitted(source: str, key: str, ts: str, event: str, n: int, seconds: int) -> str:
    """Rows with ``admitted``, decided one after the other within a key."""
    return f"""WITH RECURSIVE e AS (SELECT {key}, {event}, epoch_us({ts}) AS us, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {event}) AS i FROM {source}),
s({key}, i, {event}, admitted, kept) AS (
  SELECT {key}, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, []::BIGINT[] FROM (SELECT DISTINCT {key} FROM e)
  UNION ALL
  SELECT {key}, i, {event}, len(k) < {n}, CASE WHEN len(k) < {n} THEN list_append(k, us) ELSE k END
  FROM (SELECT e.*, list_filter(s.kept, lambda t: t > e.us - {seconds * 1_000_000}) AS k FROM s JOIN e ON e.{key} = s.{key} AND e.i = s.i + 1))
SELECT {key}, {event}, admitted FROM s WHERE i > 0"""
