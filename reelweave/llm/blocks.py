"""Arrow text columns as byte blocks: word spans, word hashes and per-document sums, all in numpy.

A block is a slice of a record batch of about ``BLOCK`` bytes (one text at
least), so a task's memory depends on that and on its longest text only.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
ARROW_ROWS = 1_000
_SEG = 1 << 20
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche; a bijection on 64 bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = [mix64(np.arange(1, 257, dtype=_U) * _U(b)) for b in _BASES]
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    n = max(n, _SEG + 1)
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        steps = np.full(n, base, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= _SEG + 1:
            _POWERS[(base, 0)] = have
    return have


def small_batches(spark) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows for this session, if it has no smaller ones: texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def trim() -> None:
    """Give freed memory back: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with their text bytes and offsets; a null text has no bytes."""
    col = batch.column(column)
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(col))
        yield batch.slice(start, stop - start), buf[off[start]:off[stop]], off[start:stop + 1] - off[start]
        start = stop
    trim()


def rebatch(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows (the last may have fewer), for work that pays by the call."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def grouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches of about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray, off: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ``breaks`` bytes, and how many each text has."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    inside = ~breaks[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = off[:-1][np.diff(off) > 0]
    first[heads] = inside[heads]
    tails = off[1:][np.diff(off) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes; equal bytes give equal hashes wherever they stand. Two lanes make 128 bits."""
    out = np.zeros(len(starts), _U)
    base = _BASES[lane]
    inverse = _inverse(base)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(ends, lo + _SEG, "right")), i + 1)
        hi = int(ends[j - 1])
        x = _BYTES[lane][buf[lo:hi]]
        x *= _powers(base, hi - lo)[:hi - lo]
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(x, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * _powers(inverse, hi - lo)[s]
        i = j
    return mix64(out + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def gather_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, joint: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after another, each followed by the byte ``joint``; and the offsets."""
    length = ends - starts + 1
    off = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(off[-1]) - np.repeat(off[:-1] - starts, length)
    at[off[1:] - 1] = 0
    out = buf[at] if len(buf) else np.zeros(off[-1], np.uint8)
    out[off[1:] - 1] = joint
    return out, off


def as_array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_int64(kind) and values.dtype == _U:
        values = values.view(np.int64)
    return pa.array(values, kind)


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per count, of that many consecutive items of ``values``."""
    off = np.concatenate(([0], np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def utf8_rows(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Strings from bytes and offsets."""
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).cast(pa.string())


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's run of ``values``."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    stops = np.cumsum(counts)
    return total[stops] - total[stops - counts]
