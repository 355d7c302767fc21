"""The queries of this package and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from reelweave.llm.blocks import small_batches

    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE [ws[i], ws[i + 1]] END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT DISTINCT a, a FROM edge UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.doc_id WHERE reach.r < e.b),
least_ AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.r, d.doc_id) AS component_id, coalesce(l.r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_ l USING (doc_id)
"""


@query(_OP1)
def op1_minhash(spark, d):
    from reelweave.llm import minhash

    return minhash.near_duplicates(table(spark, d, "documents"), words=2)


@query()
def op2_bpe(spark, d):
    from reelweave.llm import bpe

    return bpe.encode_documents(table(spark, d, "documents"))


@query()
def op10_langid(spark, d):
    from reelweave.llm import langid

    return langid.predict(table(spark, d, "documents"))


_OP6 = f"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size,
         (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))[:8])::BIGINT
          + (row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1) * 2654435769) % 4294967296 AS u FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
weighed AS (SELECT source, n, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM total),
ranked AS MATERIALIZED (SELECT *, 2.0::DOUBLE * n AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source IS NULL, encode(source)) AS k FROM weighed),
filled(k, rest, weight, source, target) AS (
  SELECT 0::BIGINT, 1.5::DOUBLE * (SELECT sum(n) FROM ranked)::DOUBLE, (SELECT sum(w) FROM ranked), NULL::VARCHAR, 0.0::DOUBLE
  UNION ALL
  SELECT r.k, CASE WHEN r.w * f.rest / f.weight >= r.most THEN f.rest - r.most ELSE f.rest END,
         CASE WHEN r.w * f.rest / f.weight >= r.most THEN f.weight - r.w ELSE f.weight END, r.source,
         CASE WHEN r.w * f.rest / f.weight >= r.most THEN r.most ELSE r.w * (f.rest / f.weight) END
  FROM filled f JOIN ranked r ON r.k = f.k + 1),
rate AS MATERIALIZED (
  SELECT r.source, r.n, f.target, CASE WHEN r.n > 0 THEN floor(f.target / r.n) ELSE 0 END::BIGINT AS whole,
         CASE WHEN r.n > 0 THEN (f.target / r.n - floor(f.target / r.n)) * 4294967296 ELSE 0 END AS part
  FROM ranked r JOIN filled f USING (k)),
turned AS (
  SELECT r.source, t.k, abs(any_value(r.whole * r.n) + sum(CASE WHEN (s.u + t.k * 134217728) % 4294967296 < r.part THEN s.size ELSE 0 END) - any_value(r.target)) AS off_by
  FROM sized s JOIN rate r ON s.source IS NOT DISTINCT FROM r.source, range(32) t(k) GROUP BY r.source, t.k),
best AS (SELECT source, arg_min(k, (off_by, k)) AS k FROM turned GROUP BY source)
SELECT s.doc_id, s.size::BIGINT AS size, r.n AS source_size, r.target,
       (r.whole + CASE WHEN (s.u + b.k * 134217728) % 4294967296 < r.part THEN 1 ELSE 0 END)::BIGINT AS copies,
       (s.size * (r.whole + CASE WHEN (s.u + b.k * 134217728) % 4294967296 < r.part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rate r ON s.source IS NOT DISTINCT FROM r.source JOIN best b ON s.source IS NOT DISTINCT FROM b.source
"""


@query(_OP6)
def op6_mixing(spark, d):
    from reelweave.llm import mixing

    return mixing.taken(table(spark, d, "documents"))


_OP8 = f"""
WITH raw AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
line AS MATERIALIZED (SELECT doc_id, line, l, {_WORDS.format("l")} AS ws FROM raw),
first_ AS MATERIALIZED (SELECT ws, min((doc_id, line)) AS o FROM line WHERE len(ws) >= 1 GROUP BY ws),
near AS MATERIALIZED (SELECT ws, o, unnest(range(1, len(ws) + 1)) AS i FROM first_ WHERE len(ws) >= 8),
variant AS MATERIALIZED (SELECT ws, o, i, ws[:i - 1] || ws[i + 1:] AS v FROM near),
changed AS (SELECT v, i, min(o) AS o FROM variant GROUP BY v, i HAVING count(*) > 1),
gone AS (
  SELECT a.ws FROM variant a JOIN changed c ON a.v = c.v AND a.i = c.i WHERE c.o < a.o
  UNION
  SELECT CASE WHEN b.o < a.o THEN a.ws ELSE b.ws END FROM variant a JOIN first_ b ON a.v = b.ws WHERE len(b.ws) >= 8),
judged AS (SELECT line.*, coalesce((doc_id, line) > f.o OR g.ws IS NOT NULL, false) AS drop FROM line LEFT JOIN first_ f ON f.ws = line.ws LEFT JOIN gone g ON g.ws = line.ws)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_removed,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT drop), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query(_OP8)
def op8_linededup(spark, d):
    from reelweave.llm import linededup

    return linededup.report(table(spark, d, "documents"))


_OP3 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
least_ AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM win JOIN least_ USING (h) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN left_ l USING (doc_id)
"""


@query(_OP3)
def op3_substring(spark, d):
    from reelweave.llm import substring

    return substring.digests(table(spark, d, "documents"))


_CONTROL = r"'([<\[])(\\*)(<SYS>>|</SYS>>|s>|/s>|INST\]|/INST\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g'"
_OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(len(regexp_replace(text, {_CONTROL})) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + len(base64(encode(role))) END)::BIGINT AS formatted_chars,
       count(*) FILTER (bad) AS errors
FROM (SELECT *, (coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '^') || '>' || role) NOT IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user') AS bad FROM t)
GROUP BY conv_id
"""


@query(_OP4)
def op4_chat(spark, d):
    from reelweave.llm import chat

    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.format_conversations(rows))


@query()
def op7_ann(spark, d):
    from pyspark.sql import functions as F

    from reelweave.llm import ann

    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op9_lm(spark, d):
    from reelweave.llm import lm

    return lm.score(table(spark, d, "documents"))


@query()
def op5_fingerprint(spark, d):
    from reelweave.llm import fingerprint

    return fingerprint.likenesses(table(spark, d, "documents"))


_OP12 = r"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split_ AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
site AS (SELECT DISTINCT host, path FROM split_),
hit AS (SELECT host, path, arg_max({'r': rh || rp, 'v': v}, len(rh || rp)) AS best FROM site JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT s.page_id, s.host, s.path, h.best.r AS rule, coalesce(h.best.v, 'allow') AS verdict FROM split_ s LEFT JOIN hit h USING (host, path)
"""


@query(_OP12)
def op12_urlfilter(spark, d):
    from reelweave.llm import urlfilter

    rules = spark.sql("SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS t(host, path, verdict)")
    return urlfilter.judge(table(spark, d, "pages"), rules, keep=["page_id"])


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    one = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda c, b: {one}))"


_NEXT_ROLE = "CASE {} WHEN 'u' THEN 'a' ELSE 'u' END"
_FULL_ROLE = "CASE {} WHEN 'a' THEN 'assistant' ELSE 'user' END"
_OP11 = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE kind <> 0),
ordered AS MATERIALIZED (SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS MATERIALIZED (
  SELECT conv_id, turn, role, text, ini, i,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM ordered),
ids AS (SELECT DISTINCT conv_id FROM conversations),
step(conv_id, i, st, best) AS (
  SELECT conv_id, 0::BIGINT, 'n', {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} FROM ids
  UNION ALL
  SELECT conv_id, i, st, min(best) FROM (
    SELECT conv_id, i, m.st AS st, {{'c': c0 + m.c, 'a': a0 || m.a, 'o': list_concat(o0, m.o)}} AS best FROM (
      SELECT conv_id, i, c0, a0, o0, unnest([
          {{'ok': true, 'st': st0, 'c': 2::BIGINT, 'a': 'D', 'o': []::VARCHAR[]}},
          {{'ok': fault IN ('', 't') AND ((st0 = 'n' AND ini IN ('s', 'u')) OR (st0 = 's' AND ini = 'u') OR (st0 = 'u' AND ini = 'a') OR (st0 = 'a' AND ini = 'u')),
            'st': ini, 'c': more, 'a': 'K', 'o': [role || ':' || text]}},
          {{'ok': fault IN ('', 't'), 'st': {_NEXT_ROLE.format('st0')}, 'c': 1 + more, 'a': 'R', 'o': [{_FULL_ROLE.format('(' + _NEXT_ROLE.format('st0') + ')')} || ':' || text]}}]) AS m
      FROM (
        SELECT r.conv_id, r.i, r.role, r.text, r.ini, r.fault, CASE r.fault WHEN 't' THEN 5 ELSE 0 END::BIGINT AS more,
               p.st AS st0, s.best.c + p.c AS c0, s.best.a || p.a AS a0, list_concat(s.best.o, p.o) AS o0
        FROM step s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1,
             LATERAL (SELECT unnest([{{'st': s.st, 'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}},
                                     {{'st': {_NEXT_ROLE.format('s.st')}, 'c': 5::BIGINT, 'a': 'I', 'o': [{_FULL_ROLE.format('(' + _NEXT_ROLE.format('s.st') + ')')} || ':']}}]) AS p))) WHERE m.ok)
  GROUP BY conv_id, i, st),
size_ AS (SELECT i.conv_id, coalesce(max(j.i), 0) AS n FROM ids i LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM i.conv_id GROUP BY i.conv_id),
ended AS (
  SELECT s.conv_id, min(CASE s.st WHEN 'u' THEN {{'c': s.best.c + 5, 'a': s.best.a || 'I', 'o': list_append(s.best.o, 'assistant:')}} ELSE s.best END) AS best
  FROM step s JOIN size_ z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i WHERE s.st <> 's' GROUP BY s.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM judged) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.best.c AS cost, e.best.a AS audit, sha256(array_to_string(e.best.o, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query(_OP11)
def op11_structure(spark, d):
    from reelweave.llm import structure

    rows = table(spark, d, "conversations")
    return structure.digests(structure.damage(rows), rows)


_OP13 = rf"""
WITH own AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, k, role, text FROM ids i JOIN own o ON o.conv_id = i.base AND o.k <= i.h
  UNION ALL SELECT i.conv_id, 1, k, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.k > i.h),
seq AS MATERIALIZED (SELECT i.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY part, k) FILTER (k IS NOT NULL), []) AS s FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id),
prefix AS MATERIALIZED (SELECT conv_id, d, md5(s[1:d]::VARCHAR) AS p, md5(s[1:d - 1]::VARCHAR) AS up, s[d].t AS last, len(s) = d AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seq)),
node AS MATERIALIZED (
  SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n,
         CASE WHEN d = 0 THEN 0 ELSE len({_WORDS.format("any_value(last)")}) END AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM prefix GROUP BY d, p),
child AS MATERIALIZED (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY d, up),
full_ AS MATERIALIZED (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, p)),
-- a node's subtree: nodes whose smallest member begins with it
below AS (
  SELECT a.d, a.p, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.words)::BIGINT AS saved
  FROM full_ b JOIN prefix x ON x.conv_id = b.conv_id AND x.d <= b.d JOIN full_ a ON a.d = x.d AND a.p = x.p GROUP BY a.d, a.p)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN below USING (d, p) LEFT JOIN full_ u ON u.d = f.d - 1 AND u.p = f.up
"""


@query(_OP13)
def op13_trie(spark, d):
    from reelweave.llm import trie

    rows, ids = trie.grafted(table(spark, d, "conversations"))
    return trie.trie(rows, ids)
