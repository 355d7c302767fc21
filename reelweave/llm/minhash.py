"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find grouping.

A document is the set of its distinct word shingles.  SuperMinHash visits the
signature's slots in a random order of each element, round by round; a slot
keeps the least (round, draw).  A document's rounds stop once every slot has a
value of an earlier round, so long texts need one round.  Documents of equal
sets are one node.  Nodes that agree in all slots of a band meet in a bucket.
Each bucket has a head, the member that meets most others.  Members near the
head (by estimate) are compared with it on the full sets; many copies of one
text are linked that way without forming pairs of them.  What else can be
linked is found without all pairs too: two members near a head of which one
is not linked to it can only be linked if they share so much of their
difference to it that one of the rarest elements of the other's difference is
among it, so differences are joined by element.  Members far from their head
are compared within the bucket.  Everything found is verified on the full
sets.  No bucket is capped, and no pair that shares a bucket is lost.

Defined results: a text without words (null and empty ones too) has an empty
set, which is linked with nothing; a text of fewer words than a shingle has
its whole sequence as the only one.  Rows of equal doc_id are one document for
linking and each give a row.  A row without doc_id is linked with nothing,
its component is null, and it is kept.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelweave.llm import blocks as bl
from reelweave.llm.folders import Folder
from reelweave.llm.graph import components

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _seed(n: int) -> np.uint64:
    return _U(n * int(_STEP) & (1 << 64) - 1)


BANDS, ROWS = 32, 4
#: A pair whose signatures agree less than the threshold by so much isn't verified: over seven standard deviations of the estimate.
SLACK = 0.25
#: Agreement with a bucket's head from which a member is compared with it on the full sets.
CLOSE = 0.25
#: So many ids (8 bytes each) are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number a text."""
    buf = bl.lower_ascii(buf)
    starts, ends, counts = bl.spans(buf, off)
    word = bl.span_hashes(buf, starts, ends)
    first = np.cumsum(counts) - counts
    size = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    if not len(word):
        return word, size
    # position and length of every shingle
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    length = np.repeat(np.minimum(counts, words), size)
    code = length.astype(_U)
    for k in range(words):
        use = length > k
        code[use] = bl.mix64(code[use] * _STEP + word[at[use] + k])
    out, kept = [], np.zeros(len(size), np.int64)
    stops = np.cumsum(size)
    for i in np.flatnonzero(size).tolist():
        part = np.unique(code[stops[i] - size[i]:stops[i]])
        out.append(part)
        kept[i] = len(part)
    return np.concatenate(out) if out else code[:0], kept


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, a row a set; a slot's value is round * 2**32 + draw, and stays at its maximum in an empty set's row."""
    rows = len(counts)
    sig = np.full(rows * slots, np.iinfo(np.uint64).max, _U)
    row = np.repeat(np.arange(rows), counts)
    order: np.ndarray | None = None
    for j in range(slots):
        x = bl.mix64(elements + _seed(j + 1))
        draw = x >> _U(32)
        k = (j + (((x & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64))
        if order is None:
            slot = k
        else:
            i = np.arange(len(elements))
            slot = order[i, k].astype(np.int64)
            order[i, k] = order[:, j]
        np.minimum.at(sig, row * slots + slot, draw + (_U(j) << _U(32)))
        # sets with a slot that this or an earlier round hasn't reached go on
        open_rows = sig.reshape(rows, slots).max(axis=1) >= _U(j + 1) << _U(32)
        go = open_rows[row]
        if not go.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(go.sum()), 1))
            order[np.arange(len(order)), k[go]] = 0
        elif not go.all():
            order = order[go]
        elements, row = elements[go], row[go]
    return sig.reshape(rows, slots)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows, slots = sig.shape
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (rows, bands)).copy()
    for r in range(slots // bands):
        key = bl.mix64(key * _STEP + sig[:, r::slots // bands])
    return key


def _signatures(words: int, bands: int, rows: int):
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in bl.text_blocks(batch, "text", 2 << 20):
                codes, counts = shingle_sets(buf, off, words)
                stops = np.cumsum(counts)
                digest = []
                for salt in (1, 2):
                    total = np.zeros(len(codes) + 1, _U)
                    np.cumsum(bl.mix64(codes + _seed(salt)), out=total[1:])
                    digest.append((total[stops] - total[stops - counts]).view(np.int64))
                sig = superminhash(codes, counts, bands * rows)
                full = counts > 0
                keys = band_keys(sig[full], bands)
                short = (bl.mix64(sig[full].ravel()) & _U(0xFF)).astype(np.uint8)
                sizes = np.where(full, bands, 0)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(digest[0]), pa.array(digest[1]),
                    bl.binary_rows(short, np.where(full, bands * rows, 0)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))], schema=out)
    return run


@F.pandas_udf(T.DoubleType())
def _agreement(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="float64")
    a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (x, y))
    same = (a == b).mean(axis=1)
    return pd.Series((same - 1 / 256) / (1 - 1 / 256))  # a byte agrees by chance


def _compare(words: int, percent: int, differences: bool):
    """Pairs (a, b) with whether they are linked; with ``differences`` also that of a to b: sizes and elements."""
    fields = [("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())]
    extra = [("more", pa.int64()), ("less", pa.int64()), ("diff", pa.list_(pa.int64()))]
    out = pa.schema([*fields, *extra] if differences else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.append_column("k", pa.array(np.arange(batch.num_rows)))
            for part, buf, off in bl.text_blocks(batch, "text_a"):
                for piece, other, ooff in bl.text_blocks(part, "text_b", 8 << 20):
                    lo = piece.column("k").to_numpy() - part.column("k")[0].as_py()
                    x, nx = shingle_sets(buf, off, words)
                    y, ny = shingle_sets(other, ooff, words)
                    ex, ey = np.cumsum(nx), np.cumsum(ny)
                    linked, more, less, diff = [], [], [], []
                    for i, at in enumerate(lo.tolist()):
                        u, v = x[ex[at] - nx[at]:ex[at]], y[ey[i] - ny[i]:ey[i]]
                        if differences:
                            a, r = np.setdiff1d(u, v, assume_unique=True), np.setdiff1d(v, u, assume_unique=True)
                            both = len(u) - len(a)
                            more.append(len(a))
                            less.append(len(r))
                            diff.append(np.concatenate((a | _U(1), r & ~_U(1))).view(np.int64))
                        else:
                            both = len(np.intersect1d(u, v, assume_unique=True))
                        linked.append(both > 0 and 100 * both >= percent * (len(u) + len(v) - both))
                    columns = [piece.column("a"), piece.column("b"), pa.array(linked, pa.bool_())]
                    if differences:
                        columns += [pa.array(v, kind) for v, (_, kind) in zip((more, less, diff), extra, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
    return run


def compared(docs: DataFrame, pairs: DataFrame, words: int, percent: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b) of doc_ids compared on their full shingle sets."""
    ids = pairs.selectExpr("a AS doc_id").union(pairs.selectExpr("b AS doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").repartition("doc_id")
    left = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_compare(words, percent, differences), "a bigint, b bigint, linked boolean" + ", more bigint, less bigint, diff array<bigint>" * differences)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles.
    A pair at the threshold shares a bucket but with probability (1 - s**rows)**bands: 5e-8 for 80 % and the defaults.
    """
    folder = Folder(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = folder.write(docs.mapInArrow(_signatures(words, bands, rows), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary, bands array<bigint>"), "sets")
    full = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one node, named by the smallest id
    nodes = folder.write(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    member = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = folder.write(member.join(shared, "bucket"), "met")
    popular = met.groupBy("doc_id").agg(F.sum("n").alias("popular"))
    heads = met.join(popular, "doc_id").groupBy("bucket").agg(F.max(F.struct("popular", (-F.col("doc_id")).alias("id"))).alias("h")).select("bucket", (-F.col("h.id")).alias("head"))
    members = folder.write(met.select("doc_id", "bucket").join(heads, "bucket"), "members")
    small = nodes.selectExpr("doc_id", "n_shingles AS n", "sig")

    def near(pairs: DataFrame, least: float, sized: bool) -> DataFrame:
        """Pairs whose signatures agree enough and, if ``sized``, whose sizes allow a link."""
        x, y = small.toDF("a", "na", "sa"), small.toDF("b", "nb", "sb")
        both = pairs.distinct().join(x, "a").join(y, "b")
        if sized:
            both = both.filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return both.select("a", "b", "na", "nb", _agreement("sa", "sb").alias("near")).filter(F.col("near") >= least)

    rays = members.filter("doc_id <> head").selectExpr("doc_id AS a", "head AS b")
    rays = folder.write(near(rays, -1.0, False), "rays")
    stars = folder.write(compared(docs, rays.filter(F.col("near") >= CLOSE), words, percent, True), "stars")
    roots = components(folder.write(stars.filter("linked").select("a", "b"), "links"), folder)
    found = near(_by_difference(stars.join(rays.select("a", "b", "na", "nb"), ["a", "b"]), percent).union(_far(members, rays, stars, roots, percent)), percent / 100 - SLACK, True)
    found = folder.write(compared(docs, folder.write(found, "pairs"), words, percent).filter("linked").select("a", "b"), "found")
    roots = components(stars.filter("linked").select("a", "b").union(found), folder)
    classes = nodes.select("d1", "d2", F.col("doc_id").alias("node"))
    named = full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).join(roots.selectExpr("a AS node", "b AS root"), "node", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))
    out = sets.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_difference(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs near one head, one of them not linked to it, that can share enough of their differences to it.

    With ``more`` elements that the head lacks, ``less`` that it has alone, and p = percent / 100, a link of x and y
    takes (1 + p) * shared >= (p * more + less of x - (1 - p) * head's size) + (p * more + less of y), where the first
    part is over 0 if x is not linked to the head.  So shared is over s = (p * more + less of y) / (1 + p), and x has one
    of any (elements - s) of y's elements; the rarest ones are taken.
    """
    open_heads = stars.filter("NOT linked").select("b").distinct()
    rays = stars.join(open_heads, "b", "left_semi").select("a", "b", "linked", (F.floor((F.col("more") * percent + F.col("less") * 100) / (100 + percent)) + 1).alias("least"), "diff", _similarity().alias("like"),
        (F.col("more") * percent + F.col("less") * 100).alias("cost"), (F.col("nb") * (100 - percent)).alias("spare"))
    carried = ["a", "b", "linked", "least", "like", "cost", "spare"]
    each = rays.select(*carried, F.size("diff").alias("size"), F.explode("diff").alias("element"))
    often = each.groupBy("b", "element").agg(F.count("*").alias("often"))
    ordered = each.join(often, ["b", "element"]).groupBy(*carried, "size").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("elements"))
    prefix = ordered.withColumn("keep", F.greatest(F.lit(0), F.col("size") - F.col("least") + 1).cast("int")).filter("keep > 0")
    given = prefix.select("b", F.col("a").alias("y"), F.col("like").alias("ly"), F.col("cost").alias("cy"), "size", F.posexplode(F.slice("elements", F.lit(1), F.col("keep"))).alias("place", "e")).select("b", "y", "ly", "cy", (F.col("size") - F.col("place")).alias("left"), F.col("e.element").alias("element"))
    asked = each.filter("NOT linked").select("b", F.col("a").alias("x"), F.col("like").alias("lx"), (F.col("cost") - F.col("spare")).alias("cx"), "element")
    # at the first element that y's order has in common with x, what is left of y must be enough
    enough = (100 + percent) * F.col("left") >= F.col("cx") + F.col("cy")
    return asked.join(given, ["b", "element"]).filter((F.col("x") != F.col("y")) & enough & (F.abs(F.col("lx") - F.col("ly")) <= 1 - percent / 100 + 1e-9)).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _similarity() -> Column:
    """Of a ray's ends, from the sizes and what they differ by."""
    apart = F.col("more") + F.col("less")
    return 1 - 2 * apart / (F.col("na") + F.col("nb") + apart)


def _far(members: DataFrame, rays: DataFrame, stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket of which one is far from the head, in different components.

    Distances (1 - similarity) obey the triangle inequality: two linked members' similarities to the head differ by
    1 - percent / 100 at most, and by ``SLACK`` more where one is an estimate.
    """
    exact = stars.select("a", "b", "more", "less")
    to_head = rays.join(exact, ["a", "b"], "left").select(F.col("a").alias("doc_id"), F.col("b").alias("head"), F.col("more").isNull().alias("far"), F.coalesce(_similarity(), "near").alias("like"))
    rooted = members.join(roots.selectExpr("a AS doc_id", "b AS root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).join(to_head, ["doc_id", "head"])
    far = rooted.filter("far").selectExpr("bucket", "doc_id AS x", "root AS rx", "like AS lx")
    reach = 1 - percent / 100 + SLACK
    pairs = far.join(rooted.selectExpr("bucket", "doc_id AS y", "root AS ry", "like AS ly"), "bucket").filter((F.col("rx") != F.col("ry")) & (F.col("x") != F.col("y")) & (F.abs(F.col("lx") - F.col("ly")) <= reach))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
