"""Substring dedup: words covered by a long window that an earlier document has too.

A window is ``window`` consecutive words.  Every window has an anchor, the run
of half as many words in it whose hash is least; equal windows have equal
anchors at the same place.  First pass: sketches of the partitions, counts by
hashed cell of the documents that have an anchor, are merged by adding them
up.  A cell can only count too much, so what it says is never under a
window's true count.  Second pass: only windows whose anchor is estimated to
be in two documents or more are grouped, by a 128-bit hash of their words and
anchor, and the smallest doc_id of each decides.  All windows of one anchor
are one row, a run; equal runs are grouped first, and single windows only of
anchors that are in different runs.  Windows are judged on the input.

Defined results: a null text has no words; texts shorter than a window lose
nothing; rows of equal doc_id never remove each other's words, and lose the
union of what either loses; rows without doc_id lose nothing and remove
nothing.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm import blocks as bl
from reelweave.llm.folders import Folder

WINDOW = 50
#: Cells of the merged sketch; only those that are not zero exist anywhere.
CELLS = 1 << 40
_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(size, base, _U)))) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS[size]


def _runs(word: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from every place on."""
    n = len(word) - length + 1
    power, inverse = _powers(len(word))
    total = np.zeros(len(word) + 1, _U)
    np.cumsum(bl.mix64(word) * power[:len(word)], out=total[1:])
    return bl.mix64((total[length:] - total[:-length])[:n] * inverse[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first of equals) among each ``width`` values in a row."""
    at = np.arange(len(values))
    best, span = at, 1
    while span < width:  # widths double, the last step overlaps
        step = min(span, width - span)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best


class _Anchored:
    """Words, windows and their anchors of a block of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int, lanes: int = 1):
        self.starts, self.ends, self.counts = bl.spans(buf, off)
        word = bl.span_hashes(buf, self.starts, self.ends)
        n = len(word)
        first = np.cumsum(self.counts) - self.counts
        self.first = first
        if n < window:
            self.window = self.anchor = self.text = np.zeros(0, np.int64)
            self.codes = np.zeros(0, _U)
            return
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        half = window // 2
        self.codes = _runs(word, half)
        inside = text[:n - window + 1] == text[window - 1:]
        anchor = _least(self.codes, window - half + 1)
        self.window = np.flatnonzero(inside)  # first word of each window
        self.anchor = anchor[self.window]
        self.text = text[self.window]
        if lanes > 1:
            second = bl.span_hashes(buf, self.starts, self.ends, 1)
            self.hash = _runs(second, window)[self.window]


def _anchors(window: int):
    """Cell of every distinct anchor of each text, with its text's id."""
    out = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text"):
                a = _Anchored(buf, off, window)
                if not len(a.window):
                    continue
                fresh = np.ones(len(a.anchor), bool)
                fresh[1:] = (a.anchor[1:] != a.anchor[:-1]) | (a.text[1:] != a.text[:-1])
                cell = (a.codes[a.anchor[fresh]] % _U(CELLS)).astype(np.int64)
                text = a.text[fresh]
                order = np.lexsort((cell, text))
                cell, text = cell[order], text[order]
                first = np.ones(len(cell), bool)
                first[1:] = (cell[1:] != cell[:-1]) | (text[1:] != text[:-1])
                of = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("text_key").take(of), pa.array(cell[first])], schema=out)
    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count-min sketch of a batch: its cells and their counts."""
    for batch in batches:
        cells, n = np.unique(batch.column("cell").to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])


#: A run's key and place; its windows' hashes in order; how far its anchor stands from its first word.
_RUNS = "c bigint, x bigint, doc_id bigint, text_key bigint, at int, n int, off int, hashes array<bigint>"


def _repeated(window: int):
    """Windows of the asked anchors, a run of all that share one anchor as a row."""
    out = pa.schema([("c", pa.int64()), ("x", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text"):
                a = _Anchored(buf, off, window, 2)
                asked = part.column("cells")
                per = asked.value_lengths().to_numpy(zero_copy_only=False)
                flat = asked.flatten().to_numpy(zero_copy_only=False)
                if not len(a.window) or not len(flat):
                    continue
                # whether (text, cell) is asked: both are looked up as one sorted list
                cell = (a.codes % _U(CELLS)).astype(np.int64)[a.anchor]
                cells, inverse = np.unique(np.concatenate((flat, cell)), return_inverse=True)
                wanted = np.unique(np.repeat(np.arange(len(per)), per) * len(cells) + inverse[:len(flat)])
                own = a.text * len(cells) + inverse[len(flat):]
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hit = wanted[at] == own
                text, start, anchor, hashes = a.text[hit], a.window[hit], a.anchor[hit], a.hash[hit]
                if not len(text):
                    continue
                # windows of one anchor follow each other
                first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
                n = np.diff(np.append(first, len(text)))
                away = anchor[first] - start[first]
                # a run is no longer than a window, so its first and last one hold all its words
                x = bl.mix64(hashes[first] + bl.mix64(hashes[first + n - 1] + bl.mix64((n * window + away).astype(_U))))
                of = pa.array(text[first])
                offsets = pa.array(np.append(first, len(text)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(a.codes[anchor[first]].view(np.int64)), pa.array(x.view(np.int64)), part.column("doc_id").take(of), part.column("text_key").take(of),
                    pa.array((start[first] - a.first[text[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(away.astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], schema=out)
    return run


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key and its windows that a smaller doc_id has too, as runs: first word and number of windows; docs: bigint doc_id, text_key, text.

    The hash of the text keeps rows of one id apart: places in a text are that text's alone.
    """
    folder = Folder(docs.sparkSession, "substring")
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    row = ["doc_id", "text_key"]
    anchors = folder.write(docs.mapInArrow(_anchors(window), "doc_id bigint, text_key bigint, cell bigint"), "anchors")
    sketch = anchors.select("cell").mapInArrow(_sketch, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    often = sketch.filter("n > 1").select("cell")
    asked = anchors.join(often, "cell").groupBy(*row).agg(F.collect_set("cell").alias("cells"))
    runs = docs.join(asked, row).select(*row, "text", "cells").mapInArrow(_repeated(window), _RUNS)
    runs = folder.write(runs, "runs")
    # equal runs have equal windows; a window can only be in other runs too where its anchor has several
    groups = folder.write(runs.groupBy("c", "x").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "groups")
    several = groups.groupBy("c").agg(F.count("*").alias("k"), F.min("lo").alias("lo"), F.max("lo").alias("hi")).filter("k > 1 AND lo < hi").select("c")
    several = folder.write(several, "several")  # read back, so that the join has an exchange of its own on both sides, which a hot anchor needs to be split
    # the key is a struct so that equal runs are put together before they move again, and a hot anchor's part of the join can be split
    mixed = runs.join(several, "c").groupBy("x", F.struct("c").alias("of")).agg(F.min("doc_id").alias("lo"), F.first("off").alias("off"), F.first("hashes").alias("hashes"))
    mixed = folder.write(mixed.select("of.c", "x", "lo", "off", "hashes"), "mixed")
    windows = mixed.select("c", "x", "lo", "off", F.posexplode("hashes").alias("k", "w")).withColumn("place", F.col("off") - F.col("k")).drop("off")
    least = windows.groupBy("c", "place", "w").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).filter("least < most").drop("most")
    sooner = windows.join(least, ["c", "place", "w"]).filter("least < lo").groupBy("c", "x").agg(F.collect_set("k").alias("sooner"))
    marks = groups.join(sooner, ["c", "x"], "left").filter("lo < hi OR sooner IS NOT NULL").drop("hi")
    found = runs.select("c", "x", *row, "at", "n").join(marks, ["c", "x"]).filter("doc_id > lo OR sooner IS NOT NULL")
    some = F.transform("sooner", lambda k: F.struct((F.col("at") + k).alias("at"), F.lit(1).alias("n")))
    places = F.when(F.col("doc_id") > F.col("lo"), F.array(F.struct("at", "n"))).otherwise(some)
    return found.groupBy(*row).agg(F.flatten(F.collect_set(places)).alias("at"))


def _cut(window: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text"):
                starts, ends, counts = bl.spans(buf, off)
                first = np.cumsum(counts) - counts
                at = part.column("at")
                per = at.value_lengths().to_numpy(zero_copy_only=False)
                runs = at.flatten()
                place = np.repeat(first, per) + runs.field("at").to_numpy(zero_copy_only=False)
                depth = np.zeros(len(starts) + 1, np.int64)
                np.add.at(depth, place, 1)
                np.add.at(depth, np.minimum(place + runs.field("n").to_numpy(zero_copy_only=False) - 1 + window, len(starts)), -1)
                gone = np.cumsum(depth)[:-1] > 0
                text = np.repeat(np.arange(len(counts)), counts)
                left = np.bincount(text[~gone], minlength=len(counts))
                flat, woff = bl.gather_spans(buf, starts[~gone], ends[~gone], 0x20)
                stops = woff[np.cumsum(left)]  # each text's words with a space after each
                begin = woff[np.cumsum(left) - left]
                data = flat.tobytes()
                kept = [data[b:e - 1].decode() if e > b else "" for b, e in zip(begin.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(counts - left), pa.array(kept, pa.string())], schema=out)
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    cut = covered(docs, window)
    at = F.coalesce("at", F.array().cast(cut.schema["at"].dataType)).alias("at")
    return docs.join(cut, ["doc_id", "text_key"], "left").select("doc_id", "text", at).mapInArrow(_cut(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
