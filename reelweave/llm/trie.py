"""Trie of the turns that conversations begin with, from vertical bitmaps.

A node is a distinct sequence of first turns (role, text); the conversations
that begin with it are its members.  Conversations, sorted by id, are dealt to
shards of ``SHARD``; a shard indexes (position, turn) to a bitset of its
conversations.  A depth-first walk intersects a node's bitset with the
postings of its members' next turns: each intersection is a child, its set
bits are counted, and those that have no next turn are the node's end list.
What shards found of one node is added up by the node's key, a digest of its
turns, so no prefix, however common, is gathered anywhere.

Long conversations are walked in blocks of ``BLOCK`` turns.  A block starts at
the node that the blocks before it lead to, whose key adds up from their hashes.

Sums over subtrees: the smallest member of a node names a chain, the nodes that
have it as smallest member, which are the deepest part of its path.  Chains
hang off each other; pointer doubling over chains adds up what hangs below each
in as many rounds as the logarithm of their nesting, and running sums from the
deepest node up give every node its subtree.

Defined results: turns are ordered by turn (null first), ties by a digest of
role and text; a null role or text is empty; rows without conv_id are in no
conversation; whole repeated rows are turns like others; conversations without
turns end at the root.  No conversations, no nodes.  Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelweave.llm.folders import Folder

BLOCK = 256
SHARD = 512
#: Rows without turn come first.
_NO_TURN = -(1 << 62)


def running(rows: DataFrame, key: str, block: Column, order: str, values: list[str], down: bool = False) -> DataFrame:
    """``values`` summed along ``order`` (from its end if ``down``) within ``key``; each block is summed by itself, then shifted by those before it."""
    way = F.desc if down else F.asc
    rows = rows.withColumn("_block", block)
    before = rows.groupBy(key, "_block").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.partitionBy(key).orderBy(way("_block")).rowsBetween(W.unboundedPreceding, -1)
    before = before.select(key, "_block", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inside = W.partitionBy(key, "_block").orderBy(way(order))
    out = rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, [key, "_block"])
    return out.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_block", *[f"_{v}" for v in values])


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 1), digest, words; ``rows``: conv_id, turn, role, text.  Texts are not moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    chunk = F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(_NO_TURN))
    counted = slim.withColumn("_chunk", chunk).groupBy("conv_id", "_chunk").agg(F.count("*").alias("n"))
    before = counted.select("conv_id", "_chunk", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "_chunk").orderBy(F.asc_nulls_first("turn"), "digest"))
    numbered = slim.withColumn("_chunk", chunk).withColumn("_at", inside).join(before, ["conv_id", "_chunk"])
    return numbered.select("conv_id", (F.col("_at") + F.col("before")).alias("position"), "digest", "words")


def _blocks(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """conv_id, block, digests, words, more (goes on behind the block), x, y (hashes of the block)."""
    at = F.greatest(F.col("position") - 1, F.lit(0))
    parts = rows.select("conv_id", F.expr(f"(position - 1) div {size}").alias("block"), "position", "digest", "words")
    goes_on = rows.filter((F.col("position") > 1) & (at % size == 0)).select(
        "conv_id", (F.expr(f"(position - 1) div {size}") - 1).alias("block"), "position", F.lit(None).cast("binary"), F.lit(None).cast("bigint"))
    exists = ids.select("conv_id", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(None).cast("binary"), F.lit(None).cast("bigint"))
    found = parts.union(goes_on).union(exists).groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("position", "digest", "words")))).alias("t"), F.max("position").alias("last"))
    return found.select("conv_id", "block", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"), (F.col("last") > (F.col("block") + 1) * size).alias("more"),
                        *[F.xxhash64(F.lit(n), "block", "t.digest").cast("decimal(20,0)").alias(c) for n, c in ((1, "x"), (2, "y"))])


_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string()), ("first_end", pa.int64())])
_NODE_SQL = "key binary, parent binary, depth bigint, words bigint, n bigint, conv_id bigint, ends string, first_end bigint"


def _boundary(depth: int, x: int, y: int) -> bytes:
    return hashlib.md5(f"{depth}:{x}:{y}".encode()).digest()


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(shard: list[tuple], size: int = BLOCK) -> Iterator[tuple]:
    """Nodes of one block of some conversations: (conv_id, block, digests, words, more, x, y, sums of x and y before the block), sorted by conv_id."""
    base = shard[0][1] * size
    postings: dict[tuple[int, bytes], int] = {}
    starts: dict[tuple[int, int], int] = {}
    stops = [0] * (size + 1)  # by position: no next turn in this block
    over = 0
    for i, (_, _, digests, _, more, *_, x0, y0) in enumerate(shard):
        bit = 1 << i
        starts[x0, y0] = starts.get((x0, y0), 0) | bit
        stops[len(digests)] |= bit
        over |= bit * (not more)
        for at, digest in enumerate(digests, 1):
            postings[at, digest] = postings.get((at, digest), 0) | bit
    stack = [(bits, 0, _boundary(base, x, y), None) for (x, y), bits in starts.items()]
    while stack:
        bits, at, key, parent = stack.pop()
        first = shard[(bits & -bits).bit_length() - 1]
        if at or not base:
            ended = [shard[i][0] for i in _bits(bits & stops[at] & over)]
            yield (key, parent, base + at, first[3][at - 1] if at else 0, bits.bit_count(), first[0], ",".join(map(str, ended)) if ended else None, ended[0] if ended else None)
        rest = bits & ~stops[at]
        while rest:
            one = shard[(rest & -rest).bit_length() - 1]
            child = rest & postings[at + 1, one[2][at]]
            rest ^= child
            deep = base + at + 1
            below = _boundary(deep, one[7] + one[5], one[8] + one[6]) if at + 1 == size else hashlib.md5(key + one[2][at]).digest()
            stack.append((child, at + 1, below, key))


def _walk_shards(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Shards of at most ``most`` conversations from blocks sorted by block and conv_id."""
    def found(shard: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes = list(walk(shard, size))
        for i in range(0, len(nodes), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*nodes[i:i + 4096], strict=True), _NODE, strict=True)], schema=_NODE)

    shard: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "digests", "words", "more")]
        columns += [[int(v) for v in batch.column(c).to_pylist()] for c in ("x", "y", "x0", "y0")]
        for row in zip(*columns, strict=True):
            if shard and (len(shard) == most or shard[0][1] != row[1]):
                yield from found(shard)
                shard = []
            shard.append(row)
    if shard:
        yield from found(shard)


_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End lists of one node, sorted, as one digest."""
    key, state = None, None
    for batch in batches:
        out = []
        for now, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if now != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ENDS, strict=True)], schema=_ENDS)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=_ENDS)


def _chain_totals(chains: DataFrame, folder: Folder) -> DataFrame:
    """conv_id, leaves, saved of a chain and all that hangs below it; ``chains``: conv_id, up, leaves, saved."""
    now, old = folder.write(chains.selectExpr("conv_id", "up AS hop", "leaves", "saved"), "totals"), None
    while not now.filter("hop IS NOT NULL").isEmpty():
        below = now.filter("hop IS NOT NULL").groupBy("hop").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("hop", "conv_id")
        further = now.filter("hop IS NOT NULL").selectExpr("conv_id AS hop", "hop AS next")
        step = now.join(below, "conv_id", "left").join(further, "hop", "left")
        old, now = now, folder.replace(step.selectExpr("conv_id", "next AS hop", "leaves + coalesce(l, 0) AS leaves", "saved + coalesce(s, 0) AS saved"), "totals", now)
    return now.drop("hop")


def trie(rows: DataFrame, ids: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``rows``: as ``turns`` returns; ``ids``: conv_id of every conversation, also of those without turns.
    """
    folder = Folder(rows.sparkSession, "trie")
    blocks = folder.write(_blocks(rows, ids, block), "blocks")
    # what long conversations have before a block
    ahead = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    nested = blocks.filter("block > 0").select("conv_id").distinct()
    sums = blocks.select("conv_id", "block", "x", "y").join(nested, "conv_id", "left_semi").select(
        "conv_id", "block", *[F.sum(c).over(ahead).cast("decimal(38,0)").alias(f"{c}0") for c in ("x", "y")]).filter("block > 0")
    zero = F.lit(0).cast("decimal(38,0)")
    entered = blocks.filter("block = 0").withColumns({"x0": zero, "y0": zero}).unionByName(blocks.filter("block > 0").join(sums, ["conv_id", "block"]))
    found = folder.write(entered.repartitionByRange("block", "conv_id").sortWithinPartitions("block", "conv_id").mapInArrow(partial(_walk_shards, size=block, most=shard), _NODE_SQL), "found")

    ends = found.filter("ends IS NOT NULL").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    merged = found.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    children = found.select("parent", "key").filter("parent IS NOT NULL").distinct().groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key")
    nodes = merged.join(children, "key", "left").join(ends, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = folder.write(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")

    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "parent")).alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = tops.select("conv_id", "top.depth", F.col("top.parent").alias("key"), "leaves", "saved")
    chains = folder.write(tops.join(nodes.select("key", F.col("conv_id").alias("up")), "key", "left").drop("key"), "chains")
    totals = _chain_totals(chains, folder)
    hung = chains.filter("up IS NOT NULL").select("conv_id", F.col("up"), (F.col("depth") - 1).alias("at")).join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    own = nodes.drop("key", "parent", "words").join(chains.select("conv_id", "depth", "up"), ["conv_id", "depth"], "left")
    both = own.unionByName(hung, allowMissingColumns=True)
    summed = running(both, "conv_id", F.expr(f"depth div {block}"), "depth", ["leaves", "saved"], down=True).filter("n_convs IS NOT NULL")
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))
    return summed.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                         F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def grafted(rows: DataFrame, of: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin like others do.

    The first h = crc32(conv_id) % ``most`` turns of a conversation give way to
    those of conversation conv_id - conv_id % ``of``, as many as it has.
    """
    rows = Folder(rows.sparkSession, "trie").write(turns(rows), "turns")
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % of).alias("base")
    ids = rows.filter("position = 1").select("conv_id", h, base)
    heads = rows.filter((F.col("conv_id") % of == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "base")
    taken = ids.join(heads, "base").filter("position <= h")
    counted = ids.join(taken.groupBy("conv_id").agg(F.count("*").alias("taken")), "conv_id", "left")
    own = rows.join(counted, "conv_id").filter("position > h").select("conv_id", (F.col("position") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("position"), "digest", "words")
    return taken.select("conv_id", "position", "digest", "words").union(own), ids.select("conv_id")
