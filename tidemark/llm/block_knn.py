"""Operator 10: nearest neighbours by a block matrix join. Int8 product tiles give inner products with bounds of their
quantisation error; pairs that can still be among the nearest are recomputed in double precision and merged by heaps.

Every vector is x = s * q + e with q in int8. By Cauchy and Schwarz, |<x, y> - s_x s_y <q_x, q_y>| is at most
|x| |e_y| + |e_x| |s_y q_y|. A pair survives if its upper bound reaches the k-th best lower bound or exact score so far, so
the result is exact. Products of int8 are summed in float32, exactly for up to 1,000 components, beyond that in float64.

Candidates are dealt to shards of SHARD_BYTES at most, queries to groups that stream past a shard; each (shard, group) is a
task of its own and gives the k best of each of its queries. Vectors travel and stay as they are stored; double precision is
for tiles of them. The k best of all shards follow by one window a query, which holds
k rows a shard.

Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part. Vectors of other
lengths never meet. Repeated ids: a query never meets rows of its own id. Ties go to the smaller id. With fewer candidates
than k all are returned; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, QUERY_STEP = 20, 20
#: Candidates in a shard at most, in rows and in bytes of their components, and at least where there are cores for more
#: shards; queries in a group, which stream past a shard; sides of a tile.
SHARD_ROWS, SHARD_BYTES, SMALL_SHARD_ROWS, GROUP_ROWS, TILE_QUERIES, TILE_ROWS = 131_072, 64 << 20, 4_096, 262_144, 256, 8_192
SLACK = 1e-6


class Quantised:
    """Vectors in int8 with scales, norms and residual norms, made tile by tile."""

    def __init__(self, x: np.ndarray):
        self.code = np.empty(x.shape, np.int8)
        self.scale, self.norm, self.near_norm, self.residual = (np.empty(len(x)) for _ in range(4))
        for a in range(0, len(x), TILE_ROWS):
            b, own = min(a + TILE_ROWS, len(x)), x[a : a + TILE_ROWS].astype(np.float64)
            self.scale[a:b] = np.abs(own).max(1) / 127
            self.code[a:b] = np.rint(own / self.scale[a:b, None])
            near = self.code[a:b] * self.scale[a:b, None]
            for to, y in ((self.norm, own), (self.near_norm, near), (self.residual, own - near)):
                to[a:b] = np.sqrt(np.einsum("ij,ij->i", y, y))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of component."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k].astype(np.float64) * y[:, k].astype(np.float64)
    return out


class Shard:
    """The candidates of a task."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.codes = Quantised(self.vectors)
        self.wide = np.float32 if vectors.shape[1] <= 1000 else np.float64

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
        """Of each query a heap of its k best (score, -id)."""
        own, codes = Quantised(vectors), self.codes
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        reach = np.full(len(ids), -np.inf)
        left = own.code.astype(self.wide)
        for a in range(0, len(self.ids), TILE_ROWS):
            b = min(a + TILE_ROWS, len(self.ids))
            near = left @ codes.code[a:b].astype(self.wide).T
            near = near.astype(np.float64) * own.scale[:, None] * codes.scale[a:b]
            bound = (own.norm[:, None] * codes.residual[a:b] + own.residual[:, None] * codes.near_norm[a:b]) * (1 + SLACK) + SLACK * own.norm[:, None] * codes.norm[a:b]
            near[ids[:, None] == self.ids[a:b]] = -np.inf
            if b - a > k:
                lower = near - bound
                reach = np.maximum(reach, np.partition(lower, b - a - k, axis=1)[:, b - a - k])
            q, c = np.nonzero((near + bound >= reach[:, None]) & np.isfinite(near))
            scores = np.concatenate([exact(vectors[q[i : i + TILE_ROWS]], self.vectors[a + c[i : i + TILE_ROWS]]) for i in range(0, len(q), TILE_ROWS)] or [np.zeros(0)])
            for i, score, name in zip(q.tolist(), scores.tolist(), self.ids[a + c].tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -name))
                elif (score, -name) > heap[0]:
                    heapq.heapreplace(heap, (score, -name))
            for i in np.unique(q).tolist():
                if len(heaps[i]) == k:
                    reach[i] = max(reach[i], heaps[i][0][0])
        return heaps


def usable(vector: str) -> Column:
    x = F.col(vector)
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, rank, <id>, score): for each row of `queries` the k rows of `vectors` with the largest inner products."""
    # float is exact in double; anything else becomes double.
    kind = "array<float>" if all(dict(x.dtypes)[vector_col] == "array<float>" for x in (vectors, queries)) else "array<double>"
    clean = [x.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"), F.size(vector_col).alias("dim")) for x in (vectors, queries)]
    n, longest = clean[0].agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    n_queries = clean[1].count()
    shard_rows = max(1, min(shard_rows, shard_bytes // ((4 if kind == "array<float>" else 8) * longest)))
    shards = max(-(-n // shard_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_SHARD_ROWS)), 1)
    groups = max(-(-n_queries // group_rows), 1)

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    candidates = clean[0].select("dim", dealt(shards).alias("shard"), numbers(groups).alias("group"), F.lit(0).alias("kind"), "id", "vector")
    asked = clean[1].select("dim", numbers(shards).alias("shard"), dealt(groups).alias("group"), F.lit(1).alias("kind"), "id", "vector")
    rows = candidates.unionByName(asked).repartition("dim", "shard", "group").sortWithinPartitions("dim", "shard", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, parts = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            ids = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1), len(keys)]
            out = ([], [], [])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                vectors_ab = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, int(keys[a][0]))
                if at != tuple(keys[a][:3]):
                    at, shard, parts = tuple(keys[a][:3]), None, []
                if keys[a][3] == 0:
                    parts.append((ids[a:b], vectors_ab))
                    continue
                if shard is None and parts:
                    shard, parts = Shard(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])), []
                for c in range(a, b, TILE_QUERIES) if shard else ():
                    some = slice(c, min(c + TILE_QUERIES, b))
                    for name, heap in zip(ids[some].tolist(), shard.nearest(ids[some], vectors_ab[c - a : some.stop - a], k), strict=True):
                        out[0].extend([name] * len(heap))
                        out[1].extend(-x for _, x in heap)
                        out[2].extend(x for x, _ in heap)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "found", "score"])

    best = rows.mapInArrow(run, "query_id long, found long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every row whose vec_id is divisible by 20, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


SQL = """
WITH clean AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM clean q JOIN clean c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
