"""Mixing sources to target weights.

Words are summed per source; weights cycle over the sources in code point
order (null last) and share a budget; a target stops at ``cap`` times its
source's words, and what is over is shared by weight among the others until
none is above.  A source's rate is target / words.  A document is taken
floor(rate) times, and once more with probability equal to the fraction: a
draw hashed from its id and text, turned by an offset of its source.  Of
``OFFSETS`` offsets each source uses the one whose taken words come nearest to
its target (one more sum over all documents); each leaves the probability as it
is.

Defined results: null or empty texts have size 0; a source without words has
target and rate 0; a null id draws like the text 'null', a null text like an
empty one.  Rows that repeat an id, source and text are counted before they are
drawn, and their draws are spread evenly, so that as many of them are taken as
the rate says.  Other columns are kept as they are by ``mix``, whatever their
names, and never read.  What reaches the driver is one row a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelweave.llm import blocks as bl
from reelweave.llm.folders import Folder

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
OFFSETS = 32
_FULL = 1 << 32
#: Draws of repeated rows are this far apart: any run of them is spread over the whole range (golden ratio).
_STEP = 2654435769
_RUN = 4_096
#: Keys of repeated rows are broadcast up to this many (40 bytes each), and shuffled beyond.
_FEW_KEYS = 200_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [bl.spans(buf, off)[2] for _, buf, off in bl.text_blocks(batch, "text")]
        column = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], column], names=[*kept, "size"])


def digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def sizes(docs: DataFrame, content: Column | None = None) -> DataFrame:
    """doc_id, source, digest of the text, ``content`` (a hash of the row, if asked for), size of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [] if content is None else [content.alias("content")]
    read = docs.select("doc_id", F.col("source").cast("string").alias("source"), digest().alias("digest"), *more, "text")
    return read.mapInArrow(_count_words, f"doc_id {kind}, source string, digest string, {'content bigint, ' if more else ''}size bigint")


def drawn(sized: DataFrame) -> DataFrame:
    """doc_id, source, size and the draw ``u`` of every row; repeated rows are counted, then numbered by generating them."""
    groups = sized.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n"))
    return numbered(groups.withColumn("u", draw()), "n").select("doc_id", "source", "size", "u")


def numbered(groups: DataFrame, n: str) -> DataFrame:
    """``n`` rows of every row, with draws ``u`` set apart from the row's own; runs bound what is held at once."""
    runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / _RUN))))
    each = runs.withColumn("_k", F.explode(F.sequence(F.col("_run") * _RUN, F.least(F.col("_run") * _RUN + (_RUN - 1), F.col(n) - 1))))
    return each.withColumn("u", (F.col("u") + F.pmod(F.col("_k"), F.lit(1 << 31)) * _STEP) % _FULL).drop("_run", "_k")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> dict[str | None, float]:
    """Words that each source should give. ``totals``: words of each source."""
    ranked = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    rows = sorted((cap * size / (w := weights[k % len(weights)]), source is None, source or "", w, cap * size) for k, (source, size) in enumerate(ranked))
    left, weight = budget * sum(size for _, size in totals), sum(r[3] for r in rows)
    out: dict[str | None, float] = {}
    for ratio, null, source, w, most in rows:  # those that fill up first come first
        if w * left / weight >= most:
            out[None if null else source] = most
            left, weight = left - most, weight - w
        else:
            out[None if null else source] = w * (left / weight)
    return out


def draw() -> Column:
    """A number under 2**32 hashed from ``doc_id`` and ``digest``."""
    key = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("digest"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """One row a source: source, source_size, target, whole, part (of 2**32), turn. ``rows``: what ``drawn`` gives."""
    spark = rows.sparkSession
    totals = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    target = targets(totals, weights, budget, cap)
    rates = []
    for source, n in totals:
        rate = target[source] / n if n else 0.0
        whole = int(rate)
        rates.append((source, n, target[source], whole, (rate - whole) * _FULL))
    known = spark.createDataFrame(rates, "source string, source_size bigint, target double, whole int, part double")
    met = rows.join(known, rows["source"].eqNullSafe(known["source"])).select(rows["source"], "size", "part", "u")
    sums = met.groupBy("source").agg(*[F.sum(F.when((F.col("u") + k * (_FULL // OFFSETS)) % _FULL < F.col("part"), F.col("size")).otherwise(0)).alias(f"k{k}") for k in range(OFFSETS)]).collect()
    extra = {r["source"]: [r[f"k{k}"] for k in range(OFFSETS)] for r in sums}
    final = []
    for source, n, goal, whole, part in rates:
        got = extra.get(source, [0] * OFFSETS)
        turn = min(range(OFFSETS), key=lambda k: (abs(whole * n + got[k] - goal), k))
        final.append((source, n, goal, whole, part, turn * (_FULL // OFFSETS)))
    return spark.createDataFrame(final, "source string, source_size bigint, target double, whole int, part double, turn bigint")


def _copies(whole: Column, u: Column, turn: Column, part: Column) -> Column:
    return (whole + ((u + turn) % _FULL < part).cast("int")).cast("bigint")


def _written_draws(docs: DataFrame) -> DataFrame:
    """Draws are read three times and texts once: they are written in between."""
    return Folder(docs.sparkSession, "mixing").write(drawn(sizes(docs)), "draws")


def taken(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row."""
    rows = _written_draws(docs)
    rates = plan(rows, **rules).withColumnRenamed("source", "_of")
    out = rows.join(rates, F.col("source").eqNullSafe(F.col("_of"))).withColumn("copies", _copies(F.col("whole"), F.col("u"), F.col("turn"), F.col("part")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken.

    Texts cross the network only where an id, source and text repeat: such rows
    are counted before they meet.
    """
    folder = Folder(docs.sparkSession, "mixing")
    content = F.xxhash64(*[docs[f.name] for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    key = ["doc_id", "source", "digest"]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["source"].cast("string").alias("source"), digest().alias("digest"), content.alias("content"))
    sized = folder.write(sizes(docs, content), "sizes")
    rates = plan(drawn(sized), **rules)
    repeats = sized.groupBy(*key).agg(F.count("*").alias("n"), F.min("content").alias("least")).filter("n > 1")
    repeats = folder.write(repeats.select("least", *[F.col(c).alias(f"k_{c}") for c in key]), "repeats")
    few = repeats.count()
    if few:
        side = F.broadcast(repeats) if few <= _FEW_KEYS else repeats
        same = (F.col("digest") == F.col("k_digest")) & F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source"))
        once = keyed.join(side, same, "left_anti").withColumn("u", draw())
        again = keyed.join(side, same).groupBy("row", *key, "content", "least").agg(F.count("*").alias("n"))
        # of rows that differ in other columns only, the first keeps the draw of the id and text
        own = F.when(F.col("content") == F.col("least"), F.lit(0)).otherwise(F.pmod("content", F.lit(_FULL)))
        rows = once.select("row", "source", "u").unionByName(numbered(again.withColumn("u", (draw() + own) % _FULL), "n").select("row", "source", "u"))
    else:
        rows = keyed.select("row", "source", draw().alias("u"))
    rates = rates.withColumnRenamed("source", "of")
    often = _copies(F.col("whole"), F.col("u"), F.col("turn"), F.col("part")).cast("int")
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", often)
    return joined.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
