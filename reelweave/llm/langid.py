"""Language identification with interpolated Kneser-Ney character models, one per language.

Words are lower-cased and padded, and grams of four characters are counted
over labelled rows.  ``TRAIN_ROWS`` bounds the labelled rows a language
contributes (all of them below that); which rows is decided by a hash of the
id, so reruns agree.  The lower orders are continuation counts of the distinct
grams.  The model is a sorted array of gram codes per order with one row of
log-probabilities a gram, all languages side by side.  A document's score for
a language is its mean log-probability a character over the whole text; the
highest wins.  ``reject_below`` of a language is calibrated on all labelled rows:
a text is rejected if its mean lies ``MARGIN`` times as far under the language's
median as the ``LOW`` quantile does, or if it has no letter.

Defined results: null, empty and letterless texts get ``und`` with score 0;
so does every text if no labelled row exists.  Ties go to the language that
sorts first.  Repeated rows each give their own row.  Columns other than the
named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm import blocks as bl

ORDER = 4
TRAIN_ROWS = 20_000
LOW = 0.01
DISCOUNT = 0.75
MARGIN = 3.0
UNKNOWN = "und"
_BOS, _EOS = 1, 2
_U = np.uint64


def _symbols(points: np.ndarray) -> np.ndarray:
    """16 bits a character: the code point, or a hash of it beyond the basic plane."""
    points = points.astype(_U)
    return np.where(points < _U(1 << 16), points, (points * _U(40503)) & _U(0xFFFF))


def grams(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram codes of newline-ended words, oldest character in the high bits, and their number a word.

    ``words``: bytes of the words, each followed by a newline; ``off``: their offsets.
    """
    text = bytes(words).decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = points == 10
    stops = np.flatnonzero(ends)
    counts = np.diff(stops, prepend=-1)
    place = np.arange(len(points)) - np.repeat(np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops, counts)
    symbols = _symbols(points)
    symbols[ends] = _EOS
    code = symbols.copy()
    for back in range(1, ORDER):
        before = np.full(len(points), _BOS, _U)
        before[back:] = symbols[:-back] if back < len(points) else before[back:]
        before[place < back] = _BOS
        code |= before << _U(16 * back)
    return code, counts


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block: bytes and offsets of the distinct ones, place of each word among them, words a text, symbols a distinct word has."""
    starts, ends, counts = bl.spans(buf, off)
    _, index, inverse = np.unique(bl.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    flat, woff = bl.gather_spans(buf, starts[index], ends[index], 10)
    return flat, woff, inverse, counts, index


@dataclass
class Model:
    languages: list[str]
    codes: list[np.ndarray]  # of order 1 .. ORDER
    logp: list[np.ndarray]  # rows of codes, columns of languages
    backoff: list[np.ndarray]  # log weight that a context of order 1 .. ORDER - 1 leaves to the next lower order
    contexts: list[np.ndarray]
    floor: np.ndarray
    accept: np.ndarray

    def word_scores(self, code: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word under each language."""
        distinct, inverse = np.unique(code, return_inverse=True)
        each = self._lookup(distinct)
        total = np.zeros((len(code) + 1, len(self.languages)))
        np.cumsum(each[inverse], axis=0, out=total[1:])
        stops = np.cumsum(counts)
        return total[stops] - total[stops - counts]

    def _lookup(self, code: np.ndarray, top: int = ORDER) -> np.ndarray:
        out = np.broadcast_to(self.floor, (len(code), len(self.languages))).copy()
        for order in range(1, top + 1):
            keep = _U((1 << (16 * order)) - 1)
            if order > 1:  # an unseen gram leaves the context's backoff weight
                at, hit = _find(self.contexts[order - 2], (code & keep) >> _U(16))
                out[hit] += self.backoff[order - 2][at[hit]]
            at, hit = _find(self.codes[order - 1], code & keep)
            out[hit] = self.logp[order - 1][at[hit]]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """Model from each language's gram codes and counts."""
    n = len(languages)
    vocabulary = len(np.unique(np.concatenate([c for c, _ in counts]) & _U(0xFFFF))) + 1 if counts else 1
    floor = np.full(n, -np.log(vocabulary))
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for code, count in counts:
        seen[ORDER - 1].append((code, count.astype(np.float64)))
        for order in range(ORDER - 1, 0, -1):
            code, types = np.unique(code & _U((1 << (16 * order)) - 1), return_counts=True)
            seen[order - 1].append((code, types.astype(np.float64)))
    model = Model(languages, [], [], [], [], floor, np.full(n, -np.inf))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([c for c, _ in seen[order - 1]]))
        contexts = np.unique(union >> _U(16))
        lower = model._lookup(union, order - 1) if order > 1 else np.broadcast_to(floor, (len(union), n)).copy()
        own = np.zeros((len(union), n))
        left = np.zeros((len(contexts), n))
        for k, (code, count) in enumerate(seen[order - 1]):
            at = np.searchsorted(contexts, code >> _U(16))
            total = np.bincount(at, count, len(contexts))
            types = np.bincount(at, minlength=len(contexts))
            left[:, k] = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            own[np.searchsorted(union, code), k] = (count - DISCOUNT) / total[at]
        weight = left[np.searchsorted(contexts, union >> _U(16))]
        model.codes.append(union)
        model.logp.append(np.log(own + weight * np.exp(lower)))
        if order > 1:
            model.contexts.append(contexts)
            model.backoff.append(np.log(left))
    return model


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        for part, buf, off in bl.text_blocks(batch, "text"):
            flat, woff, inverse, counts, _ = distinct_words(buf, off)
            if not len(inverse):
                continue
            code, lengths = grams(flat, woff)
            langs = part.column("lang").dictionary_encode()
            of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False), counts)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                words = np.bincount(inverse[of_word == k], minlength=len(lengths))
                used = np.repeat(words > 0, lengths)
                found, at = np.unique(code[used], return_inverse=True)
                n = np.bincount(at, np.repeat(words, lengths)[used], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], schema=out)


def _bounded(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """About ``limit`` rows of each language at most, by a hash of the id; all where there are fewer."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, limit / n)
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20) + 0.999999)))
    return rows.filter(keep)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Model of the languages in ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    What reaches the driver is the gram table of at most ``train_rows`` texts a language and two numbers a language.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sample = _bounded(rows, train_rows, 17)
    table = sample.select("text", "lang").mapInArrow(_count_grams, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    if not languages:
        return Model([], [], [], [], [], np.zeros(0), np.zeros(0))
    counts = []
    for lang in languages:
        own = table[table["lang"] == lang]
        counts.append((own["code"].to_numpy(np.int64).view(_U), own["n"].to_numpy(np.int64)))
    model = kneser_ney(counts, languages)
    means = score(rows, model, ["lang"]).filter("lang = lang_pred")
    stats = means.groupBy("lang").agg(F.percentile_approx("mean_logp", [0.5, LOW], 10_000).alias("q")).collect()
    for r in stats:
        middle, low = r["q"]
        model.accept[languages.index(r["lang"])] = middle - MARGIN * max(middle - low, 0.2)
    return model


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


def score(docs: DataFrame, model: Model, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score, mean_logp, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    fields = [docs.schema[c] for c in ["doc_id", *keep]]
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mean_logp", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text"):
                n = part.num_rows
                letters = bl.sums_by_row(ascii_letter[buf].astype(np.float64), np.diff(off)) > 0
                for i in np.flatnonzero(~letters & (np.diff(off) > 0)).tolist():
                    letters[i] = has_letter(part.column("text")[i].as_py())
                mean = np.full((n, max(1, len(model.languages))), -np.inf)
                length = np.zeros(n)
                if model.languages and len(buf):
                    flat, woff, inverse, counts, _ = distinct_words(buf, off)
                    if len(inverse):
                        code, lengths = grams(flat, woff)
                        words = model.word_scores(code, lengths)
                        length = bl.sums_by_row(lengths[inverse].astype(np.float64), counts)
                        mean = np.stack([bl.sums_by_row(words[inverse, k], counts) / np.maximum(length, 1) for k in range(len(model.languages))], axis=1)
                known = letters & (length > 0) & bool(model.languages)
                best = np.argmax(mean, axis=1)
                top = mean[np.arange(n), best]
                with np.errstate(invalid="ignore", over="ignore"):
                    odds = np.exp((mean - top[:, None]) * np.minimum(length, 50)[:, None]).sum(axis=1)
                share = np.where(known, 1 / np.maximum(np.nan_to_num(odds, nan=1.0), 1), 0.0)
                accepted = known & (top >= model.accept[best]) if model.languages else known
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                columns = [part.column(f.name) for f in fields] + [pa.array(names, pa.string()), pa.array(share), pa.array(np.where(known, top, np.nan), from_pandas=True), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, out.types, strict=True)], schema=out)

    return docs.select(*dict.fromkeys(["doc_id", "text", *keep])).mapInArrow(run, schema)


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def predict(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted: trained on the rows that are not held out, applied to all."""
    model = train(docs.filter(~F.coalesce(is_held_out(), F.lit(False))), train_rows)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
