"""Connected components of an edge table, without collecting edges anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm.folders import Folder

EDGES = 500_000
_SCHEMA = "a bigint, b bigint"
_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node that it is connected to, for nodes that aren't the smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], np.int64)
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of what a task holds, about ``EDGES`` edges: batch by batch, then together."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = union_find(np.concatenate((a, batch.column("a").to_numpy())), np.concatenate((b, batch.column("b").to_numpy())))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_ARROW)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.selectExpr("b AS a", "a AS b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a AND b <> m").selectExpr("b AS a", "m AS b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").filter("b <> m").selectExpr("b AS a", "m AS b")
    return rest.union(least.selectExpr("a", "m AS b")).distinct()


def components(edges: DataFrame, folder: Folder) -> DataFrame:
    """(a, b): b is the smallest node that a is connected to; nodes that are the smallest themselves have no row.

    ``edges``: a written table with bigint columns a, b.  Union-find contracts ``EDGES`` edges a task; where there are
    more, what is left is contracted by alternating stars, whose rounds grow with the logarithm of a component's size.
    A node's edges are never gathered.
    """
    parts = max(1, -(-edges.count() // EDGES))
    now = folder.write(edges.select("a", "b").coalesce(parts).mapInArrow(_contract, _SCHEMA), "links")
    mark = None
    while parts > 1:
        fresh = folder.replace(_small_star(_large_star(now.distinct())), "links", now)
        after = fresh.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        now, mark = fresh, after
    return now
