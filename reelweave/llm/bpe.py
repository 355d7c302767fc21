"""Byte-level BPE encoding and decoding.

Each task keeps a cache from text piece to ids; the words of pieces it has not
met go to a recursive DuckDB query: token-position rows join the merge table,
and each word's leftmost pair of minimum rank is contracted until no pair of
any word is in the table.  Decoding is an ordered aggregation of the tokens'
bytes over the id list.  No shuffle; the vocabulary is read on each executor
from the installed tokenizer files.

Defined results: a null or empty text has no tokens and decodes to nothing;
repeated rows and repeated ids each give their own row; other columns of the
input are never read, so clashing names don't matter.  A word of more than
``LONG_WORD`` bytes is merged with a heap instead of by recursion (one
contraction a step would take quadratic time); the result is the same.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reelweave.llm.blocks import text_blocks, trim

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG_WORD = 256
WORDS_A_QUERY = 20_000
CACHE = 200_000
_VOCABULARIES: dict = {}

_ENCODE = """
WITH RECURSIVE s(w, t, done) AS (
  SELECT w, t, false FROM words
  UNION ALL
  SELECT s.w, CASE WHEN k IS NULL THEN s.t ELSE s.t[:k % 65536 - 1] || [(k // 65536)::INT] || s.t[k % 65536 + 2:] END, k IS NULL
  FROM s LEFT JOIN (
    SELECT w, min(m.n + p.i) AS k
    FROM (SELECT w, unnest(t[:-2]) AS l, unnest(t[2:]) AS r, unnest(range(1, len(t))) AS i FROM s WHERE NOT done) p
    JOIN merges m ON m.pair = p.l::BIGINT * 4294967296 + p.r
    GROUP BY w) g ON g.w = s.w
  WHERE NOT s.done)
SELECT w, t FROM s WHERE done ORDER BY w
"""
_DECODE = """
SELECT d, unhex(coalesce(list_aggregate(list_transform(ids, lambda i: tokens[i + 1]), 'string_agg', ''), '')) AS b
FROM docs, vocabulary ORDER BY d
"""


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank. ``path``: a rank file; the installed 50k vocabulary by default."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def vocabulary(path: str | None) -> tuple[dict[bytes, int], pa.Table, pa.Table]:
    """Ranks, mergeable pairs with rank and result, and tokens by id; made once a worker."""
    if path not in _VOCABULARIES:
        ranks = load_ranks(path)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        # rank and place are compared as one number: the minimum is the leftmost of the least rank
        pairs = pa.table({"pair": (np.array(left, np.int64) << 32) + np.array(right, np.int64), "n": np.array(rank, np.int64) << 16})
        by_id = [""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            by_id[r] = token.hex()
        _VOCABULARIES[path] = ranks, pairs, pa.table({"i": np.arange(len(by_id)), "h": by_id})
    return _VOCABULARIES[path]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, path: str | None = None):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks, pairs, by_id = vocabulary(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = regex.compile(r"^\s|\s$| \s|\s ").search
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.bytes_to_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.con.register("pairs", pairs)
        self.con.execute("CREATE TABLE merges AS SELECT pair, n FROM pairs")
        self.con.register("by_id", by_id)
        self.con.execute("CREATE TABLE vocabulary AS SELECT list(h ORDER BY i) AS tokens FROM by_id")

    def close(self) -> None:
        self.con.close()
        self.cache.clear()
        trim()

    def pieces(self, text: str) -> list[str]:
        """Parts of the text that the pattern matches separately: it never matches across a single space between two
        other characters but from that space on."""
        if not text:
            return []
        if self.odd(text) is None:
            first, *rest = text.split(" ")
        else:
            first, *rest = self.cut(text)
        return [first, *[" " + p for p in rest]]

    def learn(self, pieces: set[str]) -> None:
        """Encode what the cache does not have."""
        split = {p: [p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else self.find(p) for p in pieces}
        fresh: dict[bytes, bytes] = {}
        for found in split.values():
            for w in found:
                fresh.setdefault(w.encode(), b"")
        todo = []
        for w in fresh:
            if (r := self.ranks.get(w)) is not None:
                fresh[w] = r.to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                fresh[w] = np.array(self.merge_long(w), "<u4").tobytes()
            else:
                todo.append(w)
        for start in range(0, len(todo), WORDS_A_QUERY):
            self._recurse(todo[start:start + WORDS_A_QUERY], fresh)
        for p, found in split.items():
            self.cache[p] = b"".join([fresh[w.encode()] for w in found])

    def _recurse(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        off = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        ids = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        self.con.register("words", pa.table({"w": np.arange(len(words), dtype=np.int32), "t": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))}))
        lists = self.con.sql(_ENCODE).to_arrow_table().column("t").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))) * 4
        for w, a, b in zip(words, at[:-1].tolist(), at[1:].tolist(), strict=True):
            into[w] = flat[a:b]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges with a heap of pairs, for words where a step a contraction is too slow."""
        n = len(word)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        ends = [*range(1, n + 1)]
        rank = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j], ends[i], after[i] = False, end, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(word[i:ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := rank(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [self.ranks[word[i:ends[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t or "") for t in texts]
        fresh = set().union(*cut).difference(self.cache)
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = set().union(*cut)
        if fresh:
            self.learn(fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id list."""
        off = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        self.con.register("docs", pa.table({"d": np.arange(len(ids), dtype=np.int32), "ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))}))
        return self.con.sql(_DECODE).to_arrow_table().column("b").to_pylist()


def _slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for part, _, _ in text_blocks(batch, "text", limit):
        yield part


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, digests of the ids and of the decoded bytes; with ``keep_ids`` also ``ids``.

    ``path`` is a rank file that every executor can open; by default the installed vocabulary.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int64()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        try:
            for batch in batches:
                for part in _slices(batch, 2 << 20):
                    ids = codec.encode(part.column("text").to_pylist())
                    back = codec.decode(ids)
                    columns = [part.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                    if keep_ids:
                        columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
        finally:
            codec.close()

    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be an integer column, not {kind}")
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * keep_ids
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, schema)
