"""Centroid clustering by Yinyang grouping, in whole numbers.

Vectors are turned into integers and assigned to the nearest of ``k`` centroids (squared Euclidean
distance, ties to the smaller number); each round then replaces every non-empty centroid by the floor of
its vectors' mean. The centroids are clustered into groups once. Every vector carries its centroid, an
upper bound of the distance to it and one lower bound per group of the distance to the group's other
centroids. When centroids move, the bounds are loosened by the moves (by the group's largest move): a
vector whose upper bound lies below all its lower bounds keeps its centroid unseen; else its own
distance is computed, and only in groups that may still hold a nearer centroid are the centroids scanned,
each one only if the group's bound, loosened by that centroid's own move, lets it in. Scanned distances
are exact integers, bounds are rounded outwards, and only strictly larger distances are ruled out, so the
result is that of comparing every vector with every centroid.

A round is one pass over the vectors, which lie in a table with their bounds (an older round's table is
deleted), and one sum per centroid, combined in the workers. The driver holds the ``k`` centroids alone.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out;
rows that repeat a ``vec_id`` are vectors of their own; a null ``vec_id`` is drawn last as a centroid; fewer
vectors than ``k`` make fewer centroids; an empty table gives no rows; extra columns are ignored. A
component of ``LARGEST`` or more is an error, because squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.topk import finite
from spanloom.session import discard, materialize, ship, table

K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, 1
GROUP_SIZE, GROUP_ROUNDS = 4, 5
LARGEST = 1 << 27
EXACT = float(1 << 53)
#: Bounds are rounded outwards by this share.
MARGIN = 1e-12
STATE = "vec_id {id}, x binary, cluster int, distance bigint, upper double, lower binary"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``x`` to rows ``c``."""
    most = float(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return out.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def _up(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + MARGIN)


def _down(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - MARGIN)


def group_centroids(c: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """The group of every centroid: a few rounds of plain clustering of the centroids themselves."""
    n = max(1, -(-len(c) // size))
    own = c[:: max(1, len(c) // n)][:n].astype(np.float64)
    near = np.zeros(len(c), dtype=np.int64)
    for _ in range(GROUP_ROUNDS):
        near = ((c[:, None, :] - own[None]) ** 2).sum(axis=2).argmin(axis=1)
        own = np.stack([c[near == g].mean(axis=0) if (near == g).any() else own[g] for g in range(len(own))])
    return np.unique(near, return_inverse=True)[1]


@dataclass
class Move:
    """Where the centroids are, how far they moved, and their groups."""

    c: np.ndarray
    drift: np.ndarray
    group: np.ndarray

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1

    def group_drift(self) -> np.ndarray:
        out = np.zeros(self.groups)
        np.maximum.at(out, self.group, self.drift)
        return out


def start(x: np.ndarray, m: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, squared distance, upper bound and group bounds of vectors that have none yet."""
    d2 = squared(x, m.c)
    at = d2.argmin(axis=1)
    own = d2[np.arange(len(x)), at]
    return at, own, _up(own), _lowest(_down(d2), at, m)


def _lowest(bound: np.ndarray, at: np.ndarray, m: Move) -> np.ndarray:
    """Per group, the least bound of the centroids other than the vector's own."""
    other = bound.copy()
    other[np.arange(len(at)), at] = np.inf
    return np.stack([other[:, m.group == g].min(axis=1, initial=np.inf) for g in range(m.groups)], axis=1)


def follow(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, m: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New centroids and bounds of vectors after a move, and how many distances were computed."""
    at, before = at.copy(), lower
    upper = upper + m.drift[at]
    lower = before - m.group_drift()[None, :]
    computed = 0
    rows = np.flatnonzero(lower.min(axis=1) <= upper)  # global filter
    if len(rows):
        own = ((x[rows] - m.c[at[rows]]) ** 2).sum(axis=1)
        computed += len(rows)
        upper[rows] = _up(own)
        still = lower[rows].min(axis=1) <= upper[rows]
        rows, own = rows[still], own[still]
    if not len(rows):
        return at, upper, lower, computed
    bound = lower[rows][:, m.group]
    best, least = at[rows], own.copy()
    inside = lower[rows] <= upper[rows, None]  # group filter
    for j in range(len(m.c)):
        g = m.group[j]
        sure = before[rows, g] - m.drift[j]
        near = np.flatnonzero(inside[:, g] & (at[rows] != j) & (sure <= upper[rows]))
        skipped = inside[:, g] & (at[rows] != j)
        bound[skipped, j] = sure[skipped]
        if not len(near):
            continue
        d2 = ((x[rows[near]] - m.c[j]) ** 2).sum(axis=1)
        computed += len(near)
        bound[near, j] = _down(d2)
        better = (d2 < least[near]) | ((d2 == least[near]) & (j < best[near]))
        best[near[better]], least[near[better]] = j, d2[better]
    bound[np.arange(len(rows)), at[rows]] = _down(own)
    at[rows], upper[rows] = best, _up(least)
    lower[rows] = _lowest(bound, best, m)
    return at, upper, lower, computed


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """``vec_id, x array<long>`` of the vectors that take part."""
    kept = vectors.where((F.size(vector) == dim) & finite(F.col(vector)))
    return kept.select("vec_id", F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("x"))


def _first(whole: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The first centroids: vectors in the order of a hash of their id, equal ids by their components."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(drawn.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], dtype=np.int64).reshape(len(rows), dim)


def _check(x: np.ndarray) -> np.ndarray:
    if max(x.max(initial=0), -1 - x.min(initial=0)) >= LARGEST:  # also where the negative has no positive
        raise OverflowError(f"a component is not below {LARGEST}")
    return x


def _pass(rows: DataFrame, m: Move, id_type: str) -> DataFrame:
    """The vectors with their centroids and bounds after a move; ``rows`` are vectors or an earlier pass."""
    begun = "x" in rows.columns and "upper" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if begun:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i4").reshape(n, -1).astype(np.int64)
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), dtype="<f8").reshape(n, -1)
                at, upper, lower, _ = follow(x, batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), lower, m)
                own = ((x - m.c[at]) ** 2).sum(axis=1)
            else:
                x = _check(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
                at, own, upper, lower = start(x, m)
            packed = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (x.astype("<i4"), lower.astype("<f8"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed[0], pa.array(at.astype(np.int32)), pa.array(own), pa.array(upper), packed[1]],
                names=["vec_id", "x", "cluster", "distance", "upper", "lower"],
            )

    return rows.mapInArrow(run, STATE.format(id=id_type))


def _sums(state: DataFrame, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """How many vectors every centroid has, and their exact sums; workers add up before anything is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i4").reshape(batch.num_rows, -1)
            at = batch.column("cluster").to_numpy()
            total = np.zeros((k, x.shape[1]), dtype=np.int64) if total is None else total
            np.add.at(total, at, x)
            count += np.bincount(at, minlength=k)
        if total is not None:
            there = np.flatnonzero(count)
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(there, d).astype(np.int32)),
                    pa.array(np.tile(np.arange(d), len(there)).astype(np.int32)),
                    pa.array(np.repeat(count[there], d)),
                    pa.array(total[there].ravel()),
                ],
                names=["cluster", "dim", "n", "total"],
            )

    parts = state.select("x", "cluster").mapInArrow(run, "cluster int, dim int, n bigint, total bigint")
    sums = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    count, total = np.zeros(k, dtype=np.int64), [{} for _ in range(k)]
    for r in sums.collect():  # k times the length of a vector
        count[r["cluster"]] = r["n"]
        total[r["cluster"]][r["dim"]] = int(r["total"])
    return count, [[t[d] for d in sorted(t)] for t in total]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, vector: str = "embedding", scale: int = SCALE, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids."""
    spark = ship(vectors.sparkSession)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    whole = integers(vectors, vector, scale, dim)
    c = _check(_first(whole, k, seed, dim))
    if not len(c):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance bigint"), c
    m = Move(c, np.zeros(len(c)), group_centroids(c))
    state = materialize(_pass(whole, m, id_type), "centroid-state")
    for _ in range(rounds):
        count, total = _sums(state, len(c))
        new = m.c.copy()
        for j in np.flatnonzero(count):
            new[j] = [t // int(count[j]) for t in total[j]]
        m = Move(new, _up(((new - m.c) ** 2).sum(axis=1)), m.group)
        after = materialize(_pass(state, m, id_type), "centroid-state")
        discard(state)
        state = after
    return state.select("vec_id", "cluster", "distance"), m.c


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all ``embeddings``, with inertias and a digest of every centroid."""
    rows, c = cluster(table(spark, sf_dir, "embeddings"))
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most K rows
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    whole = sum(inertia.values())
    per = [(j, s, whole, digest[j]) for j, s in sorted(inertia.items())]
    kinds = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return rows.join(F.broadcast(spark.createDataFrame(per, kinds)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same by comparing every vector with every centroid."""
    floor = "((t - ((t % n) + n) % n) // n)::BIGINT"  # of t / n
    parts = [
        """WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), v AS (SELECT rid, vec_id, i, floor(64 * e::DOUBLE)::BIGINT AS x FROM (SELECT rid, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS e FROM kept)
), seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) - 1 AS c FROM kept QUALIFY c < 16
), c0 AS (SELECT s.c, v.i, v.x FROM seeds s JOIN v ON v.rid = s.rid)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"d{r} AS (SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c ON c.i = v.i GROUP BY ALL"
            f"), a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"
        )
        if r < ROUNDS:
            parts.append(
                f"s{r} AS (SELECT a.c, v.i, sum(v.x)::BIGINT AS t, count(*) AS n FROM a{r} a JOIN v ON v.rid = a.rid GROUP BY ALL"
                f"), c{r + 1} AS (SELECT c.c, c.i, coalesce({floor}, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c AND s.i = c.i)"
            )
    return (
        ", ".join(parts)
        + f""", h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256 FROM a{ROUNDS} a JOIN kept k ON k.rid = a.rid JOIN h ON h.c = a.c"""
    )


ORACLE = _oracle()
