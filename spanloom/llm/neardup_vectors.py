"""Near-duplicate embeddings by NN-descent.

Equal vectors are collapsed into one node first. A node travels as its unit vector in bytes, with
the length of what the rounding left over, so a product of two codes bounds the true cosine from
both sides and no pair at the threshold can be ruled out by mistake.

Start: random hyperplanes deal the nodes into buckets of about ``BLOCK`` rows, ``starts`` times
over; every bucket is compared whole (large ones in pairs of blocks), which gives each node its
nearest neighbour of each start and the pairs that may reach the threshold. Two vectors at the
threshold part at a hyperplane with probability ``acos(THRESHOLD) / pi``, so the number of starts
follows from the number of bits: a pair is in no common bucket with probability ``MISS`` at most.
Rounds: a node's neighbour list holds its ``LIST`` nearest; at each node its neighbours and those
that hold it as a neighbour are compared with one another (in parts of ``PART``, each part with the
node itself). A list that is full of vectors within the threshold is saturated and doubles. The
rounds end when one finds next to no pair across the components that the pairs found so far make.
Every component is then compared whole by exact cosines in double precision, which counts links and
keeps only true ones. Audit: a hashed sample of nodes is compared with all nodes by brute force;
while less than ``RECALL`` of the sample's links are found, further starts with other hyperplanes
follow, and after ``MORE_STARTS`` of them all pairs of blocks are compared (:func:`compare_all`).

A tight group larger than ``BLOCK`` is compared in pairs of blocks, at a cost that grows with the
square of its distinct vectors, as the count of its links does. No group is ever held whole.

Cases: vectors that are null, empty, zero or hold null or non-finite components have no links;
vectors of different length do not link; rows that repeat a vec_id are one vector (the smallest);
rows with a null vec_id are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.graph import components
from spanloom.llm.topk import finite
from spanloom.session import materialize, ship, table

THRESHOLD = 0.95
BLOCK = 4096
#: Components (rows x length) of a block: 32 MB as doubles.
BLOCK_VALUES = 1 << 22
#: Rows of a tile: what a pair of blocks holds of its similarities at once.
TILE = 1024
#: Links of a tile that are passed on one by one, per node that has any.
SPARSE = 4
SEED = 4_099
#: Probability that a pair at the threshold shares no bucket of a start.
MISS = 1e-3
LIST, PART, ROUNDS = 4, 128, 4
#: A round that joins fewer components than this share of the nodes is the last.
SETTLED = 0.0005
RECALL, MORE_STARTS, AUDIT_ROWS = 0.99, 3, 1024
#: Buckets (one row each) that may be broadcast.
BUCKETS_SENT = 100_000
#: Rounding of products in single precision.
SLACK = 1e-5
FOUND = "id bigint, linked bigint, other bigint"
NEAR = "a bigint, b bigint, sim float, link boolean"


def _unit(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    # scaled first: squares of very large or very small components leave the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every ``vec_id`` with its node (the smallest id of its equals), and the nodes."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    one = ids.where("vec_id is not null").groupBy("vec_id").agg(F.min("x").alias("x"))
    usable = finite(F.col("x")) & F.exists("x", lambda e: e != 0)
    keyed = one.withColumn("usable", usable).withColumn("k1", F.xxhash64("x")).withColumn("k2", F.xxhash64(F.lit(SEED), "x"))
    keyed = materialize(keyed, "vec-rows")
    good = keyed.where("usable")
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("equals"))
    owned = good.join(classes, ["k1", "k2"])
    nodes = materialize(owned.where("vec_id = id").select("id", "equals", "x", F.size("x").alias("dim")), "vec-nodes")
    return keyed.select("vec_id").join(owned.select("vec_id", F.col("id").alias("node")), "vec_id", "left"), nodes


def plan_starts(n: int, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, and how many starts leave a pair at the threshold apart with probability ``miss``."""
    bits = max(0, math.ceil(math.log2(max(1, n) / BLOCK)))
    together = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, 1 if together >= 1 else math.ceil(math.log(miss) / math.log(1 - together))


def codes_of(nodes: DataFrame) -> DataFrame:
    """``id, dim, code, scale, off``: unit vectors in bytes, and the length of what the rounding left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x = _unit(rows.column(2), rows.num_rows)
                scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
                code = np.rint(x / scale).clip(-127, 127).astype(np.int8)
                off = np.linalg.norm(x - code * scale.astype(np.float64), axis=1) + SLACK
                columns = [rows.column(0), rows.column(1), pa.array(list(map(bytes, code)), pa.binary())]
                columns += [pa.array(scale[:, 0]), pa.array(off.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "code", "scale", "off"])

    return nodes.select("id", "dim", "x").mapInArrow(run, "id bigint, dim int, code binary, scale float, off float")


def _decoded(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Approximate unit vectors and their errors."""
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(rows.num_rows, -1)
    return code * rows.column("scale").to_numpy()[:, None], rows.column("off").to_numpy()


def _may_link(sim: np.ndarray, off: np.ndarray, off2: np.ndarray) -> np.ndarray:
    """Which products of codes allow a cosine at the threshold."""
    most, most2 = off.max(initial=0), off2.max(initial=0)
    close = sim + (most + most2 + most * most2) >= THRESHOLD
    if close.any():
        close &= sim + off[:, None] + off2[None, :] * (1 + off[:, None]) >= THRESHOLD
    return close


def _stars(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``close`` connects: each node and the smallest id of its component here."""
    none = np.iinfo(np.int64).max
    rows, cols = left.copy(), right.copy()
    while True:
        rows_ = np.minimum(rows, np.where(close, cols[None, :], none).min(axis=1))
        cols_ = np.minimum(cols, np.where(close, rows_[:, None], none).min(axis=0))
        if (rows_ == rows).all() and (cols_ == cols).all():
            return np.concatenate([left, right]), np.concatenate([rows, cols])
        rows, cols = rows_, cols_


def _links(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``close``, or a star per component where they are many."""
    r, c = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    close = close[np.ix_(r, c)]
    if np.count_nonzero(close) <= SPARSE * (len(r) + len(c)):
        i, j = np.nonzero(close)
        return left[r[i]], right[c[j]]
    return _stars(close, left[r], right[c])


def _near(a: np.ndarray, b: np.ndarray, sim: np.ndarray | None = None) -> pa.RecordBatch:
    """Neighbours with their similarity, or pairs that may link."""
    sims = pa.nulls(len(a), pa.float32()) if sim is None else pa.array(sim, pa.float32())
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), sims, pa.array(np.full(len(a), sim is None))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sim", "link"])


def _bucket_pairs(ids: np.ndarray, own: np.ndarray, lo: int, hi: int, x: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nearest neighbours and possible links between two blocks of a bucket (or inside one)."""
    a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    if not len(a) or not len(b):
        return
    y, best, at2 = x[b], np.full(len(b), -2, dtype=np.float32), np.zeros(len(b), dtype=np.int64)
    for first in range(0, len(a), TILE):
        rows = a[first : first + TILE]
        sim = x[rows] @ y.T
        if lo == hi:
            sim[np.arange(len(rows)), first + np.arange(len(rows))] = -2
        j = sim.argmax(axis=1)
        top = sim[np.arange(len(rows)), j]
        some = top > -2
        yield _near(ids[rows[some]], ids[b[j[some]]], top[some])
        if lo != hi:
            i = sim.argmax(axis=0)
            better = sim[i, np.arange(len(b))] > best
            best[better], at2[better] = sim[i, np.arange(len(b))][better], rows[i[better]]
        close = _may_link(sim, off[rows], off[b])
        if lo == hi:
            close &= (first + np.arange(len(rows)))[:, None] < np.arange(len(b))[None, :]
        if close.any():
            yield _near(*_links(close, ids[rows], ids[b]))
    if lo != hi:
        some = best > -2
        yield _near(ids[b[some]], ids[at2[some]], best[some])


def start(codes: DataFrame, bits: int, starts: int, seed: int) -> DataFrame:
    """``a, b, sim, link``: what the buckets of ``starts`` sets of hyperplanes give."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x, _ = _decoded(rows)
                draw = np.random.Generator(np.random.PCG64([SEED, seed, int(dim)]))
                for k in range(starts):
                    side = x @ draw.standard_normal((int(dim), bits)).astype(np.float32) > 0
                    key = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), dtype=np.int64)
                    columns = [*rows.columns, pa.array(np.full(len(x), k, dtype=np.int32)), pa.array(key.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "start", "key"])

    kind = "id bigint, dim int, code binary, scale float, off float, start int, key bigint"
    dealt = codes.mapInArrow(keys, kind)
    at = ["dim", "start", "key"]
    sizes = dealt.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("cuts")).where("cuts > 1")
    sizes = materialize(sizes, "vec-buckets", starts << bits)
    sizes = F.broadcast(sizes) if sizes.count() <= BUCKETS_SENT else sizes
    cut = dealt.join(sizes, at, "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    both = (
        cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other", "cuts")
    )

    def run(rows: pa.Table) -> pa.Table:
        ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
        x, off = _decoded(rows)
        none = np.zeros(0, dtype=np.int64)
        return pa.Table.from_batches([_near(none, none), *_bucket_pairs(ids, own, rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py(), x, off)])

    return both.groupBy(*at, "lo", "hi").applyInArrow(run, NEAR)


def lists_of(near: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """``id, room, near``: every node's nearest neighbours found, as many as it has room for.

    A list full of neighbours that may link is saturated: its room doubles.
    """
    once = near.where("sim is not null").groupBy(F.col("a").alias("id"), "b").agg(F.max("sim").alias("sim"))
    once = once.withColumn("room", F.lit(LIST)) if rooms is None else once.join(rooms, "id", "left").withColumn("room", F.coalesce("room", F.lit(LIST)))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "b"))
    best = once.withColumn("place", place).where(F.col("place") <= F.col("room"))
    lists = best.groupBy("id", "room").agg(F.min("sim").alias("least"), F.collect_list(F.struct("b", "sim")).alias("near"))
    full = (F.size("near") == F.col("room")) & (F.col("least") >= THRESHOLD)
    return lists.select("id", F.when(full, 2 * F.col("room")).otherwise(F.col("room")).alias("room"), "near")


def refine(lists: DataFrame, codes: DataFrame) -> DataFrame:
    """``a, b, sim, link`` of the pairs that meet at a common neighbour.

    At a pivot come together the pivot, its list and the nodes whose lists hold it; many of them come in parts.
    """
    held = lists.select("id", F.explode("near.b").alias("b"))
    met = held.select(F.col("id").alias("pivot"), F.col("b").alias("id")).union(held.select(F.col("b").alias("pivot"), "id")).distinct()
    sizes = met.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = met.join(sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("id", "pivot"), F.col("parts")).cast("int"))
    centre = sizes.select("pivot", F.col("pivot").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = dealt.select("pivot", "id", "part").unionByName(centre)
    # many small groups go through one worker call: pivots are packed into batches by hash
    n = max(1, lists.count() // 512)
    rows = members.join(codes, "id").withColumn("batch", F.pmod(F.xxhash64("pivot", "part"), F.lit(n)).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("pivot", "ascending"), ("part", "ascending"), ("id", "ascending")])
        ids, pivot, part, dims = (rows.column(c).to_numpy() for c in ("id", "pivot", "part", "dim"))
        edges = np.flatnonzero(np.diff(pivot) | np.diff(part)) + 1
        bounds = [0, *edges.tolist(), len(ids)]
        none = np.zeros(0, dtype=np.int64)
        a, b, s, u, v = [none], [none], [np.zeros(0, np.float32)], [none], [none]
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x, off = _decoded(rows.take(pa.array(at)))
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if dims[lo] != dim or hi - lo < 2:
                    continue
                k = place[lo:hi]
                sim = x[k] @ x[k].T
                np.fill_diagonal(sim, -2)
                top = np.argsort(-sim, axis=1)[:, : min(LIST, hi - lo - 1)]
                a.append(np.repeat(ids[lo:hi], top.shape[1]))
                b.append(ids[lo:hi][top.ravel()])
                s.append(np.take_along_axis(sim, top, axis=1).ravel())
                close = np.triu(_may_link(sim, off[k], off[k]), 1)
                if close.any():
                    p, q = _links(close, ids[lo:hi], ids[lo:hi])
                    u.append(p)
                    v.append(q)
        return pa.Table.from_batches([_near(np.concatenate(a), np.concatenate(b), np.concatenate(s)), _near(np.concatenate(u), np.concatenate(v))])

    return rows.groupBy("batch").applyInArrow(run, NEAR).distinct()


def _compare(left: tuple, right: tuple, same: bool) -> Iterator[pa.RecordBatch]:
    """Counts and links between two blocks of ``ids, equals, x``, tile by tile."""
    ids, equals, x = left
    ids2, equals2, y = right
    count, count2 = np.zeros(len(ids)), np.zeros(len(ids2))
    for at in range(0, len(ids), TILE):
        skip = at if same else 0  # of a block and itself, only what lies right of the tile
        close = x[at : at + TILE] @ y[skip:].T >= THRESHOLD
        if same:
            low = np.arange(len(close))
            close[:, : len(close)] &= low[None, :] > low[:, None]
        r, c = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
        if not len(r):
            continue
        close, r, c = close[np.ix_(r, c)], r + at, c + skip
        count[r] += close @ equals2[c].astype(np.float64)
        count2[c] += equals[r].astype(np.float64) @ close
        u, v = _links(close, ids[r], ids2[c])
        yield _found(u, None, v)
    if same:
        count += count2
    for i, n in ((ids, count),) if same else ((ids, count), (ids2, count2)):
        at = np.flatnonzero(n)
        yield _found(i[at], n[at].astype(np.int64), None)


def _found(ids: np.ndarray, linked: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.nulls(len(ids), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (ids, linked, other)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "linked", "other"])


def compare_groups(nodes: DataFrame) -> DataFrame:
    """``id, linked`` (vectors of other nodes within the threshold, in parts) and ``id, other`` (links) inside each ``team``.

    Small teams share a task; a team larger than a block is dealt out in pairs of blocks.
    """
    rows = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.col("dim"))))
    sizes = nodes.groupBy("dim", "team").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select("dim", "team", F.ceil(F.col("n") / rows).cast("int").alias("cuts"), "n"), "vec-teams")
    small = sizes.where("cuts = 1").agg(F.sum(F.col("n") * F.col("dim")).alias("n")).first()["n"] or 0
    batches = max(1, -(-int(small) // BLOCK_VALUES), min(64, int(small) // (BLOCK_VALUES // 64)))
    own = F.broadcast(sizes) if sizes.count() <= BUCKETS_SENT else sizes
    dealt = (
        nodes.join(own, ["dim", "team"])
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("batch", F.when(F.col("cuts") > 1, F.col("team")).otherwise(-1 - F.pmod(F.xxhash64("team"), F.lit(batches))))
        .select("dim", "batch", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "team", "id", "equals", "x")
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("team", "ascending"), ("id", "ascending")])
        ids, equals, own, lo, hi, team = (rows.column(c).to_numpy() for c in ("id", "equals", "own", "lo", "hi", "team"))
        x = _unit(rows.column("x"), len(ids))
        out = [_found(np.zeros(0, dtype=np.int64), None, None)]
        edges = [0, *(np.flatnonzero(np.diff(team)) + 1).tolist(), len(ids)]
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            a, b = (np.flatnonzero(own[first:end] == part[first]) + first for part in (lo, hi))
            left, right = ((ids[k], equals[k], x[k]) for k in (a, b))
            out += _compare(left, right, lo[first] == hi[first])
        return pa.Table.from_batches(out)

    return dealt.groupBy("dim", "batch", "lo", "hi").applyInArrow(run, FOUND)


def compare_all(nodes: DataFrame) -> DataFrame:
    """``compare_groups`` with all nodes of a length in one team: every pair, at a cost that grows with their square."""
    return compare_groups(nodes.withColumn("team", F.lit(0).cast("long")))


def audit(nodes: DataFrame, linked: DataFrame, n: int) -> float:
    """Share of the links of a hashed sample of nodes that ``linked`` (``id, linked``) holds; 1 if the sample has none."""
    dim = nodes.agg(F.max("dim")).first()[0]
    size = max(64, min(AUDIT_ROWS, BLOCK_VALUES // 4 // dim))
    picked = nodes.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / n)))
    held = picked.select("id", "equals", "x", "dim").toArrow()  # about ``size`` rows
    if not held.num_rows:
        return 1.0
    sample = {}
    for d in np.unique(held.column("dim").to_numpy()).tolist():
        own = held.filter(pa.array(held.column("dim").to_numpy() == d))
        sample[d] = (own.column("id").to_numpy(), _unit(own.column("x"), own.num_rows))
    shared = nodes.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d, (ids, x) in shared.value.items():
                rows = batch.filter(pa.array(dims == d))
                if not rows.num_rows:
                    continue
                close = x @ _unit(rows.column(3), rows.num_rows).T >= THRESHOLD
                close &= ids[:, None] != rows.column(0).to_numpy()[None, :]
                total = close @ rows.column(1).to_numpy().astype(np.float64)
                at = np.flatnonzero(total)
                yield _found(ids[at], total[at].astype(np.int64), None).select(["id", "linked"])

    truth = nodes.select("id", "equals", "dim", "x").mapInArrow(run, "id bigint, linked bigint")
    truth = truth.groupBy("id").agg(F.sum("linked").alias("truth"))
    sums = truth.join(linked, "id", "left").agg(F.sum("truth").alias("truth"), F.sum("linked").alias("linked")).first()
    return 1.0 if not sums["truth"] else (sums["linked"] or 0) / sums["truth"]


def descend(nodes: DataFrame, miss: float = MISS) -> DataFrame:
    """``id, linked`` and ``id, other`` of the links that NN-descent finds, as :func:`compare_groups` gives them."""
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    n, most = sizes["n"] or 0, sizes["most"] or 0
    bits, starts = plan_starts(most, miss)
    codes = materialize(codes_of(nodes), "vec-codes")
    near = links = None
    for attempt in range(1 + MORE_STARTS):
        new = materialize(start(codes, bits, starts, attempt), "vec-near")
        near = new if near is None else near.unionByName(new)
        found = new.where("link").select("a", "b")
        links = found if links is None else links.unionByName(found)
        labels = components(links, links.count())
        rooms = None
        for _ in range(ROUNDS if bits else 0):  # without a bit every pair has met
            lists = materialize(lists_of(near, rooms), "vec-lists", n)
            rooms = lists.select("id", "room")
            met = materialize(refine(lists, codes), "vec-met")
            far = met.where("link").join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
            far = far.join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            far = far.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").distinct()
            far = materialize(far, "vec-far", n * LIST)
            joined = far.count()
            if joined:
                links = links.unionByName(far)
                labels = components(links, links.count())
            kept = lists.select(F.col("id").alias("a"), F.explode("near").alias("e")).select("a", "e.b", "e.sim", F.lit(False).alias("link"))
            near = kept.unionByName(met.where("not link"))
            if joined <= SETTLED * n:
                break
        teams = nodes.join(labels.select("id", F.col("component").alias("team")), "id")
        pairs = materialize(compare_groups(teams), "vec-linked")
        if not bits or audit(nodes, pairs.where("linked is not null").groupBy("id").agg(F.sum("linked").alias("linked")), n) >= RECALL:
            return pairs
    return materialize(compare_all(nodes), "vec-linked")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    ship(vectors.sparkSession)
    owned, nodes = nodes_of(vectors)
    pairs = descend(nodes)
    labels = components(pairs.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = pairs.where("linked is not null").groupBy("id").agg(F.sum("linked").alias("linked"))
    found = (
        nodes.select("id", "equals")
        .join(labels, "id", "left")
        .join(linked, "id", "left")
        .select(
            F.col("id").alias("node"),
            (F.col("equals") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    out = owned.join(found, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )


def op9_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE ids AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id
), v AS (
  SELECT vec_id, list_transform(e, lambda y: y::DOUBLE) AS x FROM ids
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(e, lambda y: y <> 0)) > 0
), n AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), component AS (SELECT a, min(b) AS least FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS links FROM links GROUP BY a)
SELECT i.vec_id, coalesce(d.links, 0) AS n_links, least(i.vec_id, coalesce(c.least, i.vec_id)) AS component_id,
  least(i.vec_id, coalesce(c.least, i.vec_id)) = i.vec_id AS kept
FROM ids i LEFT JOIN degree d ON d.a = i.vec_id LEFT JOIN component c ON c.a = i.vec_id
"""
