"""Exact nearest neighbours by a block matrix join: int8 tiles with error bounds, then floats."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship, table

#: Bytes of the vectors of a group, in double precision, which one task holds at a time; candidates of a tile within it.
GROUP, TILE = 32 << 20, 2_048
#: Queries of a block.
QUERIES = 512


def usable(vector: str) -> Column:
    """Whether a vector is neither null, empty nor zero and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """int8 vectors with a scale each, and what is needed to bound the error of a product."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.scale = np.abs(v).max(1) / 127
        self.q = np.rint(v / self.scale[:, None]).astype(np.int8)
        near = self.q * self.scale[:, None]
        self.length, self.near, self.off = (np.linalg.norm(x, axis=1) for x in (v, near, v - near))

    def products(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Approximate inner products and bounds of their errors: |ab - a'b'| <= |a - a'||b| + |a'||b - b'|."""
        # sums of at most 1024 int8 products are exact in float32, where the fast kernel is
        p = np.zeros((len(self.q), len(other.q)))
        for at in range(0, self.q.shape[1], 1024):
            p += self.q[:, at : at + 1024].astype(np.float32) @ other.q[:, at : at + 1024].astype(np.float32).T
        p *= self.scale[:, None]
        p *= other.scale
        bound = (self.off[:, None] * other.length + self.near[:, None] * other.off) * (1 + 1e-6) + 1e-12 * self.length[:, None] * other.length
        return p, bound


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed up from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def nearest(queries: np.ndarray, query_rows: np.ndarray, tiles: list[tuple[np.ndarray, np.ndarray, Quantised]], k: int) -> list[list[tuple[float, int, int]]]:
    """For each query a heap of its k best (score, -vec_id, -row) among the tiles' candidates (vec_ids, rows, vectors)."""
    own = Quantised(queries)
    heaps: list[list[tuple[float, int, int]]] = [[] for _ in query_rows]
    for ids, rows, tile in tiles:
        least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        if (own.length * tile.length.max() * (1 + 1e-9) < least).all():
            continue  # no candidate of the tile is long enough
        p, bound = own.products(tile)
        low = p - bound
        same = query_rows[:, None] == rows
        low[same] = -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((p + bound >= np.maximum(kth, least)[:, None]) & ~same)
        score = np.empty(len(i))
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            score[part] = in_order(queries[i[part]], tile.v[j[part]])
        for a, *found in zip(i.tolist(), score.tolist(), (-ids[j]).tolist(), (-rows[j]).tolist(), strict=True):
            heap, item = heaps[a], tuple(found)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
    return heaps


def few_copies(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places without the rows that k + 1 rows of the same vector precede by id and row: they can't be in any result. Longest vectors first."""
    seen: dict[bytes, int] = {}
    keep = []
    for at in np.lexsort((rows, ids)).tolist():
        n = seen[key] = seen.get(key := v[at].tobytes(), 0) + 1
        if n <= k + 1:
            keep.append(at)
    return np.array(keep)[np.argsort(-np.linalg.norm(v[keep], axis=1), kind="stable")]


def search(df: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each query row its ``k`` rows of largest inner product: query_id, rank, vec_id, score.

    All rows but the query's own are candidates and nothing is left out: a candidate is dropped
    only where its error bound proves that k others are nearer, the others are computed in double
    precision, summed up from the first component to the last. Nearest first, ties to the smaller id.
    Rows whose id is null, or whose vector is null, zero or holds null or non-finite components,
    take no part; vectors meet only those of their own length. Rows that repeat an id are rows of
    their own, as candidates and as queries, whether or not their vectors are equal. An empty table
    gives an empty result; other columns are ignored.

    Candidates are dealt out in groups of bounded size by a hash of the row; each group meets all
    query blocks in turn, so a task holds one group and passes on k rows for each query.
    """
    ship(df.sparkSession)
    kind = "<f4" if "float" in dict(df.dtypes)[vector] else "<f8"
    rows = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = cut(rows.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")))
    groups = max(1, math.ceil(rows.agg(F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()[0] * 8 / GROUP))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, dim, numbers, vectors) of at most QUERIES vectors of one group and length; numbers are ids and rows."""
        held: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}

        def packed(at: tuple[int, int]) -> pa.RecordBatch:
            got = held.pop(at)
            numbers = np.array([x[:2] for x in got], "<i8").tobytes()
            return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([numbers], pa.binary()), pa.array([b"".join(x for _, _, x in got)], pa.binary())], ["g", "dim", "numbers", "vectors"])

        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(b.column(3).to_numpy())
            for i, row, dim, g, end in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)), ends.tolist(), strict=True):
                held.setdefault((g, dim), []).append((i, row, flat[end - dim : end].tobytes()))
                if len(held[g, dim]) >= QUERIES:
                    yield packed((g, dim))
        for at in list(held):
            yield packed(at)

    shape = "g int, dim int, numbers binary, vectors binary"
    spread = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    candidates = rows.select("id", "row", "v", "dim", spread.alias("g")).mapInArrow(pack, shape).withColumn("asks", F.lit(0))
    asked = rows.where("is_query").select("id", "row", "v", "dim", F.lit(0).alias("g")).mapInArrow(pack, shape)
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("asks", F.lit(1))
    meet = candidates.unionByName(asked).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "dim", "asks")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tiles = None, [], None
        for batch in batches:
            for n in range(batch.num_rows):
                (r,) = batch.slice(n, 1).to_pylist()
                if at != (r["g"], r["dim"]):
                    at, held, tiles = (r["g"], r["dim"]), [], None
                ids, numbers = np.frombuffer(r["numbers"], "<i8").reshape(-1, 2).T
                v = np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"]).astype(np.float64)
                if not r["asks"]:
                    held.append((ids, numbers, v))
                    continue
                if tiles is None:
                    tiles = []
                    if held:
                        all_ids, all_rows, all_v = (np.concatenate(x) for x in zip(*held, strict=True))
                        keep = few_copies(all_ids, all_rows, all_v, k)
                        tiles = [(all_ids[some], all_rows[some], Quantised(all_v[some])) for i in range(0, len(keep), TILE) for some in [keep[i : i + TILE]]]
                    held = []
                best = nearest(v, numbers, tiles, k)
                out = [(q, own, -c, -row, s) for q, own, heap in zip(ids.tolist(), numbers.tolist(), best, strict=True) for s, c, row in heap]
                if out:
                    yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], ["query_id", "own", "vec_id", "row", "score"])

    found = meet.mapInArrow(join, "query_id long, own long, vec_id long, row long, score double")
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = r"""
WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS own, c.vec_id, c.r,
    list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
"""
