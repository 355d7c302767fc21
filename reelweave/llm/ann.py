"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each half has its own codebook, and a vector's
cell is the pair of its nearest centroids.  A query ranks the centroids of
each half by distance (minus the inner product) and walks the pairs by summed
distance with a heap until the cells it has met hold ``candidates`` vectors;
those are ranked by the exact inner product in double precision.

The codebooks are fitted on ``SAMPLE`` vectors, chosen by a hash of the id;
every vector is indexed.  What is broadcast is the codebooks and a count a
cell, both bounded by ``MAX_CENTROIDS``.  The cells of one first-half centroid
are cut into blocks of about ``BLOCK`` vectors and the queries that visit them
into groups of about ``QUERIES``, so copies of one vector don't meet in one
task; each block keeps the k best of each query.

Defined results: vectors that are null or zero, or hold a null or non-finite
component, and rows without id, take no part; nor do vectors whose dimension
isn't the most frequent one (of equals the largest).  A query never finds rows
of its own id; rows of equal id are candidates each, and one query (the least
vector).  Ties go to the smaller id.  An empty table gives no rows.  Other
columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 20_000
MAX_CENTROIDS = 128
#: A query meets so many vectors at least, and this share of all: 0.45 gives a recall over 0.9 even for directions drawn at random, the worst case.
CANDIDATES = 6_000
SHARE = 0.45
BLOCK = 1_000
QUERIES = 1_000
ROUNDS = 12


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers ** 2).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i:i + 4096] = np.argmax(x[i:i + 4096] @ centers.T - half, axis=1)
    return out


def walk(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, candidates: int) -> list[int]:
    """Cells in order of summed distance until they hold ``candidates`` vectors."""
    cut = books[0].shape[1]
    dist = [-(books[0] @ q[:cut]), -(books[1] @ q[cut:])]
    rank = [np.argsort(d, kind="stable") for d in dist]
    a, b = (d[r].tolist() for d, r in zip(dist, rank, strict=True))
    width = len(books[1])
    heap, seen, met, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0, []
    while heap and met < candidates:
        _, i, j = heapq.heappop(heap)
        cell = int(rank[0][i]) * width + int(rank[1][j])
        if sizes[cell]:
            out.append(cell)
            met += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, candidates: int = CANDIDATES, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found."""
    spark = vectors.sparkSession
    out_schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    kinds = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], out_schema)
    dim, total = kinds[0]["d"], kinds[0]["n"]
    rows = rows.filter(F.size("v") == dim)
    candidates = max(candidates, int(np.ceil(share * total)))
    picked = rows if total <= sample else rows.filter(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1 << 20)) < max(1, (sample << 20) // total))
    points = np.array([r["v"] for r in picked.select("v").collect()], float).reshape(-1, dim)
    cut = max(1, dim // 2)
    n = int(min(MAX_CENTROIDS, max(2, round(4.2 * total ** 0.25))))
    books = (codebook(points[:, :cut], n, 1), codebook(points[:, cut:], n, 2) if dim > cut else np.zeros((1, 0)))
    width = len(books[1])
    shared = spark.sparkContext.broadcast(books)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                cell = nearest(x[:, :first.shape[1]], first) * len(second) + nearest(x[:, first.shape[1]:], second)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell)], names=["vec_id", "v", "cell"])

    index = rows.mapInArrow(locate, "vec_id bigint, v array<double>, cell bigint")
    sizes = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    counts = spark.sparkContext.broadcast(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query and first-half centroid the second-half centroids whose cells it visits."""
        for batch in batches:
            rows, firsts, seconds = [], [], []
            for k, q in enumerate(_matrix(batch.column("v"))):
                by: dict[int, list[int]] = {}
                for cell in walk(q, shared.value, counts.value, candidates):
                    by.setdefault(cell // width, []).append(cell % width)
                rows += [k] * len(by)
                firsts += by
                seconds += by.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(firsts, pa.int64()), pa.array(seconds, pa.list_(pa.int32()))], names=["query_id", "q", "first", "seconds"])

    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    visits = queries.mapInArrow(visit, "query_id bigint, q array<double>, first bigint, seconds array<int>")
    held = sizes.reshape(len(books[0]), width).sum(axis=1)
    n_queries = queries.count()
    groups = max(1, -(-n_queries // QUERIES))
    layout = F.broadcast(spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(held.tolist()) if n], "first bigint, blocks int"))  # a row a centroid
    left = visits.join(layout, "first").select("query_id", "q", "first", "seconds", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"))
    right = index.withColumn("first", F.expr(f"cell div {width}")).join(layout, "first").select(
        "vec_id", "v", (F.col("cell") % width).cast("int").alias("second"), "first", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def rank(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qs) and len(vs):
            vs = vs.sort_values("vec_id", kind="stable")
            ids, second, x = vs["vec_id"].to_numpy(), vs["second"].to_numpy(), np.stack(vs["v"].to_numpy())
            qid, q = qs["query_id"].to_numpy(), np.stack(qs["q"].to_numpy())
            visited = np.zeros((len(qs), width), bool)
            for i, own in enumerate(qs["seconds"]):
                visited[i, own] = True
            for start in range(0, len(qid), 256):
                rough = q[start:start + 256] @ x.T
                rough[~visited[start:start + 256][:, second] | (ids[None, :] == qid[start:start + 256, None])] = -np.inf
                # the k-th best within rounding; those get the exact product
                least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(rough), -np.inf)
                for i, (row, low) in enumerate(zip(rough, least, strict=True)):
                    at = np.flatnonzero((row > -np.inf) & (row >= low - 1e-9 * max(1.0, abs(low) if np.isfinite(low) else 1.0)))
                    score = (x[at] * q[start + i]).sum(axis=1)
                    best = np.argsort(-score, kind="stable")[:k]
                    found.append((np.full(len(best), qid[start + i]), ids[at[best]], score[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*found, strict=True), strict=True)})

    key = ["first", "block", "group"]
    ranked = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
