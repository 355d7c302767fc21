"""Line dedup by a deletion-neighbourhood join.

Lines are compared as word sequences; their order is (doc_id, line number).
A line goes if an earlier one has the same words, or, from ``near_from`` words
on, if an earlier distinct line is within one word edit (a word changed, added
or left out).  Both are judged on the input, so the earliest stays.

A distinct line's variants are its words without the one at i, keyed by hash
and i, and the line itself (i = -1).  Two lines that differ by one changed
word have an equal variant at the same i; if one has a word more, the other
itself equals a variant of it.  So a group's earliest member is all that a
line must be compared with: no pairs are formed inside a group.  Every
candidate is then verified on the words.  Only lines that share half of their
words with another one emit variants: of two lines one edit apart, either the
half before or the half after it is the same in both.

Lines of fewer than ``exact_from`` words are always kept.  Defined results: a
null text stays null with no lines; an empty text has one empty line; rows of
equal doc_id are told apart by a hash of their text, the smaller hash being
earlier, and rows repeated whole are treated alike; rows without doc_id are
left alone and do not remove anything.  Other columns are kept, but for one
named ``_removed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm import blocks as bl
from reelweave.llm.folders import Folder

EXACT_FROM, NEAR_FROM = 1, 8
BROADCAST_ROWS = 200_000
#: What tells the rows of a table apart, and their order.
_ROW = ("doc_id", "text_key")
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; and of every line that has words: text, number in the text, first word, number of words."""
    starts, ends, counts = bl.spans(buf, off)
    word = bl.span_hashes(buf, starts, ends)
    breaks = np.flatnonzero(_NEWLINE[buf]) if len(buf) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, off[:-1])[text]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(fresh)
    return word, text[first], number[first], first, np.diff(np.append(first, len(starts)))


def _prefix(word: np.ndarray) -> np.ndarray:
    """Sums of place-weighted hashes: equal runs of words give equal values once divided by the power of their start."""
    powers, _ = _word_powers(len(word))
    total = np.zeros(len(word) + 1, _U)
    np.cumsum(bl.mix64(word) * powers, out=total[1:])
    return total


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(size, base & (1 << 64) - 1, _U)))) for base in (_STEP, pow(_STEP, -1, 1 << 64)))
    return tuple(p[:n + 1] if k else p[:n] for k, p in enumerate(_POWERS[size]))


def _run_hash(total: np.ndarray, inverse: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (total[hi] - total[lo]) * inverse[lo]


def _scan(near_from: int):
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("words", pa.int32()), ("h", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text"):
                word, text, number, lo, n = _lines(buf, off)
                total, (_, inverse) = _prefix(word), _word_powers(len(word))
                whole = bl.mix64(_run_hash(total, inverse, lo, lo + n) + n.astype(_U))
                keys = []
                for longer in (n, n + 1):  # as the longer or the shorter of two lines
                    half = (longer - 1) // 2
                    for side, at in ((1, lo), (2, lo + n - half)):
                        keys.append(bl.mix64(_run_hash(total, inverse, at, at + half) + bl.mix64((longer * 4 + side).astype(_U))))
                near = n >= near_from
                flat = np.stack(keys, axis=1)[near].ravel() if len(n) else np.zeros(0, _U)
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(near, 4, 0)))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(text)) for c in _ROW], pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], schema=out)
    return run


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the asked lines of each text."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("h", pa.int64()), ("hashes", pa.binary())])
    for batch in batches:
        for part, buf, off in bl.text_blocks(batch, "text"):
            word, text, number, lo, n = _lines(buf, off)
            asked = part.column("asked")
            per = asked.value_lengths().to_numpy(zero_copy_only=False)
            flat = asked.flatten()
            owner = np.repeat(np.arange(part.num_rows), per)
            wanted = owner * (1 << 32) + flat.field("line").to_numpy(zero_copy_only=False)
            at = np.searchsorted(text * (1 << 32) + number, wanted)
            size = n[at]
            take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[at], size)
            yield pa.RecordBatch.from_arrays([*[part.column(c).take(pa.array(owner)) for c in _ROW], flat.field("line").cast(pa.int32()), flat.field("h"), bl.binary_rows(word[take], size)], schema=out)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("v", pa.int64()), ("i", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("line", pa.int32()), ("h", pa.int64())])
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            data = batch.column("hashes").to_pylist()
            n = np.array([len(x) // 8 for x in data])
            word = np.frombuffer(b"".join(data), _U)
            total, (_, inverse) = _prefix(word), _word_powers(len(word))
            lo = np.cumsum(n) - n
            each, row = n + 1, np.repeat(np.arange(len(n)), n + 1)
            i = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) - 1
            begin, end = lo[row], (lo + n)[row]
            cut = np.where(i < 0, end, begin + i)  # the words before the cut, and those after it moved up by one
            skip = np.minimum(cut + 1, end)
            code = _run_hash(total, inverse, begin, cut)
            rest = total[end] - total[skip]
            code = code + rest * inverse[begin] * _U(pow(_STEP, -1, 1 << 64))
            size = np.where(i < 0, n[row], n[row] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bl.mix64(code + bl.mix64(size.astype(_U))).view(np.int64)), pa.array(i.astype(np.int32)), *[batch.column(c).take(pa.array(row)) for c in (*_ROW, "line", "h")]], schema=out)


def _within_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
            short = min(len(x), len(y))
            head = int(np.argmin(np.append(x[:short] == y[:short], False)))
            tail = int(np.argmin(np.append((x[::-1][:short] == y[::-1][:short]), False)))
            good.append(abs(len(x) - len(y)) <= 1 and head + tail >= max(len(x), len(y)) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(good, pa.bool_()))], names=["h"])


def removed_lines(docs: DataFrame, exact_from: int = EXACT_FROM, near_from: int = NEAR_FROM) -> DataFrame:
    """doc_id, text_key and the sorted numbers of the lines that go; only rows that lose one."""
    folder = Folder(docs.sparkSession, "lines")
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    lines = folder.write(docs.mapInArrow(_scan(near_from), "doc_id bigint, text_key bigint, line int, words int, h bigint, keys array<bigint>").filter(F.col("words") >= exact_from), "lines")
    first = folder.write(lines.groupBy("h").agg(F.min(F.struct(*_ROW, "line")).alias("at")), "first")
    # candidates: lines that have a half in common with another line
    keyed = lines.filter(F.size("keys") > 0).select("h", F.explode("keys").alias("key")).distinct().repartition("key")
    crowded = keyed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    flagged = keyed.join(crowded, "key").select("h").distinct()
    asked = folder.write(first.join(flagged, "h").groupBy("at.doc_id", "at.text_key").agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "h")).alias("asked")), "asked")
    few = asked.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(asked.select(*_ROW)) if few else asked.select(*_ROW), list(_ROW), "left_semi")
    picked = folder.write(texts.join(asked, list(_ROW)).mapInArrow(_pick, "doc_id bigint, text_key bigint, line int, h bigint, hashes binary").dropDuplicates(["h"]), "picked")
    # earliest of every variant group
    variants = picked.mapInArrow(_variants, "v bigint, i int, doc_id bigint, text_key bigint, line int, h bigint").repartition("v")
    order = F.struct(*_ROW, "line", "h")
    groups = variants.groupBy("v", "i").agg(F.min(order).alias("e"), F.max(order).alias("l"))
    many = groups.filter("i >= 0 AND e.h <> l.h").select("v", "i", "e")
    changed = variants.join(many, ["v", "i"]).filter("h <> e.h").selectExpr("h", "e.h AS other")
    own = variants.filter("i < 0").select("v", F.struct(*_ROW, "line").alias("o"), F.col("h").alias("own"))
    left_out = variants.filter("i >= 0").select("v", F.struct(*_ROW, "line").alias("x"), "h")
    pairs = left_out.join(own, "v").filter("h <> own").selectExpr("CASE WHEN o < x THEN h ELSE own END AS h", "CASE WHEN o < x THEN own ELSE h END AS other")
    pairs = changed.union(pairs).distinct()
    words = picked.select("h", "hashes")
    near = pairs.join(words.withColumnRenamed("hashes", "x"), "h").join(words.selectExpr("h AS other", "hashes AS y"), "other").select("h", "x", "y").mapInArrow(_within_one, "h bigint").distinct()
    near = folder.write(near, "near")
    later = lines.join(first, "h").filter("doc_id <> at.doc_id OR text_key <> at.text_key OR line <> at.line").select(*_ROW, "line")
    also = lines.join(near, "h", "left_semi").select(*_ROW, "line")
    return later.union(also).groupBy(*_ROW).agg(F.sort_array(F.collect_set("line")).alias("gone"))


def _rewrite(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left = [], []
            own = list(batch.columns[:-1])
            at = schema.get_field_index("text")
            for text, gone in zip(own[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                if gone and text is not None:
                    drop = set(gone)
                    rows = text.split("\n")
                    text = "\n".join(x for k, x in enumerate(rows) if k not in drop)
                texts.append(text)
                left.append(len(gone or ()))
            own[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, pa.array(left, pa.int64())], schema, strict=True)], schema=schema)
    return run


def dedup_lines(docs: DataFrame, exact_from: int = EXACT_FROM, near_from: int = NEAR_FROM) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts, and ``_removed``, how many those were."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop("_removed")
    taken = {c.lower() for c in docs.columns}
    doc, key, own, lines = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("doc_of", "key_of", "own_key", "lines_of"))
    gone = removed_lines(docs, exact_from, near_from).toDF(doc, key, lines)
    schema = T.StructType([*docs.schema.fields, T.StructField("_removed", T.LongType())])
    # the hash is a column before the join, which would compute it anew at each comparison; the lists come last, whatever the others are called
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(gone, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(key)), "left").select(*docs.columns, lines).mapInArrow(_rewrite(to_arrow_schema(schema)), schema)


def report(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what is left, per row."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint")
    out = dedup_lines(docs.select("doc_id", "text", n_lines.alias("n_lines")), **rules)
    return out.select("doc_id", "n_lines", F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
