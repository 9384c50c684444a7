"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt into blocks, one task each, and every query goes once to every block (a stated
query set against all rows, in blocks): a candidate is moved once, whatever the number of queries, and
a block reads the queries as a stream behind its candidates. Inside a block each dimension is a list of
the candidates (``LIST_ROWS`` at a time) sorted by their contribution to the query's score. The lists
are read sequentially, deeper and deeper; a candidate's lower bound takes the lists' last values for
what has not been read of it, its upper bound the values at the reading depth. Reading stops when all
but a few candidates cannot reach the k-th best lower bound, of these lists or of those read before;
the final scores of those few are then resolved exactly. The blocks' best meet in one ranking.

Cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
different length are not compared; rows that repeat a vec_id are rows of their own, and a query
leaves out all rows with its own id; ties go to the smaller vec_id; fewer than k candidates give
fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import materialize, ship, table

K = 10
#: Candidates of a block, components (rows x length) that it may hold, and rows of its lists.
CANDIDATE_BLOCK, BLOCK_VALUES, LIST_ROWS = 32_768, 1 << 22, 4096
SCALE = 1024
EXACT = float(1 << 53)


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and holds only finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False))


class Lists:
    """The sorted lists of one candidate block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.up = np.argsort(self.x, axis=0, kind="stable").T.copy()  # per dimension, ascending
        self.values = np.take_along_axis(self.x, self.up.T, axis=0).T.copy()
        self.largest = int(np.abs(self.x).max(initial=0))

    def top(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (id, score) of these, without rows of the query's own id; what is below ``least`` may be left out."""
        n = len(self.ids)
        other = self.ids != query_id
        if not other.any():
            return []
        near = np.flatnonzero(other)
        dims = np.flatnonzero(q)
        exact = float(self.largest) * float(np.abs(q).max(initial=0)) * len(q) < EXACT
        if len(dims) and exact and n > 8 * k:
            near = self._read(q, dims, other, k, least)
        score = self.x[near].astype(np.int64) @ q.astype(np.int64)
        best = np.lexsort((self.ids[near], -score))[:k]
        return [(int(self.ids[near[i]]), int(score[i])) for i in best]

    def _read(self, q: np.ndarray, dims: np.ndarray, other: np.ndarray, k: int, floor: float) -> np.ndarray:
        """Candidates that may be among the k best, by bounds from sequential reads."""
        n = len(self.ids)
        weight = q[dims].astype(np.float64)
        falling = weight > 0  # the best contribution is at the end of the ascending list
        lists = np.where(falling[:, None], self.up[dims, ::-1], self.up[dims])
        gains = np.where(falling[:, None], self.values[dims, ::-1], self.values[dims]) * weight[:, None]
        least = gains[:, -1]
        seen = np.zeros((n, len(dims)))
        sums = np.zeros(n)
        column = np.arange(len(dims))[:, None]
        depth, reach = 0, max(32, n // 16)
        while True:
            reach = min(reach, n)
            part, gain = lists[:, depth:reach], gains[:, depth:reach]
            sums += np.bincount(part.ravel(), weights=gain.ravel(), minlength=n)
            seen[part, np.broadcast_to(column, part.shape)] = 1.0
            depth = reach
            edge = gains[:, depth - 1]
            lower = np.where(other, sums + least.sum() - seen @ least, -np.inf)
            upper = np.where(other, sums + edge.sum() - seen @ edge, -np.inf)
            kth = max(floor, np.partition(lower, n - k)[n - k])
            open_ = np.flatnonzero(upper >= kth)
            if depth == n or len(open_) <= 8 * k:
                return open_
            reach = depth + max(32, n // 8)


def best_of(lists: list[Lists], query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (id, score) over several lists; what one list gives is the bar for the next."""
    best: list[tuple[int, int]] = []
    for part in lists:
        bar = best[k - 1][1] if len(best) >= k else -np.inf
        best = sorted(best + part.top(query_id, q, k, bar), key=lambda x: (-x[1], x[0]))[:k]
    return best


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides have ``vec_id`` and ``x array<bigint>``."""
    spark = ship(candidates.sparkSession)
    sizes = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, room = sizes["n"], max(1, min(CANDIDATE_BLOCK, BLOCK_VALUES // max(1, sizes["dim"] or 1)))
    blocks = max(1, -(-n // room), min(spark.sparkContext.defaultParallelism, n // LIST_ROWS))
    columns = ["vec_id", "x", F.size("x").alias("dim")]
    # any even deal will do: the blocks' results do not depend on it
    left = candidates.select(*columns, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    right = queries.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    # a partition is a block: per length its candidates come first, then the queries
    dealt = left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("dim", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held, lists = None, [], []
        for batch in batches:
            dims, asks = batch.column(2).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)], strict=True):
                if a == b:
                    continue
                if dims[a] != dim:
                    dim, held, lists = dims[a], [], []
                ids, x = batch.column(0).slice(a, b - a).to_numpy(), _matrix(batch.column(1).slice(a, b - a))
                if not asks[a]:
                    held.append((ids, x))
                    continue
                if held:
                    whole, values = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                    lists = [Lists(whole[at : at + LIST_ROWS], values[at : at + LIST_ROWS]) for at in range(0, len(whole), LIST_ROWS)]
                    held = []
                out = [(int(i), v, s) for i, q in zip(ids, x, strict=True) for v, s in best_of(lists, int(i), q, k)]
                found = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["query_id", "vec_id", "score"])

    best = dealt.select("vec_id", "x", "dim", "block", "asks").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, in doubles where these hold them exactly."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1)
    return x if np.abs(flat).max(initial=0) >= EXACT else x.astype(np.float64)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector of ``embeddings`` among all others."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    vectors = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")), "topk-vectors")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
