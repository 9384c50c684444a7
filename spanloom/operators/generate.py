"""Synthetic traces: random shapes drawn per trace from seeded streams, and complete trees in closed form."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.session import ship

SHAPES = ("chain", "star", "kary", "skewed", "branch", "spine", "deepwide", "slab")
SPANS = "trace_id bigint, span_id bigint, parent_id bigint, service string, start_us bigint, end_us bigint, depth int"
# Shares of leaves and of single children, and the exponent of the rest, of the measured offspring law.
LEAF_SHARE, SINGLE_SHARE, BRANCH_EXPONENT = 0.392, 0.542, 1.8
# Times of the complete trees, in microseconds.
BASE_US, STEP_US, LEAF_US = 1_798_570_615_451_777, 1000, 500


@dataclass(frozen=True)
class Shape:
    """What traces to draw."""

    shape: str = "branch"
    depth: int = 6
    fanout: int = 2
    #: fixed, zipf, poisson, geometric or measured.
    fanout_law: str = "fixed"
    fanout_exponent: float = 2.0
    fanout_min: int = 1
    fanout_max: int = 16
    #: fixed or zipf.
    depth_law: str = "fixed"
    depth_exponent: float = 2.0
    max_spans: int = 1000
    #: 0: siblings one after the other; 1: all at once.
    concurrency: float = 0.0
    services: int = 8
    #: Slabs that swell and shrink every so many levels; 0: even ones.
    spindle: int = 0
    seed: int = 42


class Laws:
    """Draws of fan-outs and depths."""

    def __init__(self, c: Shape, draw: np.random.Generator):
        self.c, self.draw = c, draw

    def zipf(self, exponent: float, most: int) -> int:
        """0 to ``most``, with weights (1 + k) to the power of minus the exponent."""
        weight = (1.0 + np.arange(max(1, most) + 1)) ** -max(exponent, 1.001)
        return int(self.draw.choice(len(weight), p=weight / weight.sum()))

    def fanout(self) -> int:
        c = self.c
        if c.fanout_law == "zipf":
            return self.zipf(c.fanout_exponent, c.fanout_max)
        if c.fanout_law == "poisson":
            return min(c.fanout_max, int(self.draw.poisson(c.fanout)))
        if c.fanout_law == "geometric":
            return min(c.fanout_max, int(self.draw.geometric(1 / (c.fanout + 1))) - 1)
        if c.fanout_law == "measured":
            u = self.draw.random()
            return 0 if u < LEAF_SHARE else 1 if u < LEAF_SHARE + SINGLE_SHARE else 2 + self.zipf(BRANCH_EXPONENT, c.fanout_max - 2)
        return c.fanout

    def depth(self) -> int:
        return 1 + self.zipf(self.c.depth_exponent, self.c.depth - 1) if self.c.depth_law == "zipf" else self.c.depth

    def mean_fanout(self, n: int = 2048) -> float:
        """Mean fan-out with its floor, estimated."""
        return max(1.0, sum(max(self.c.fanout_min, self.fanout()) for _ in range(n)) / n)


def draw_tree(c: Shape, draw: np.random.Generator) -> tuple[list[int], list[int]]:
    """Parent positions (-1 for the root) and depths of one trace, parents before children."""
    if c.shape not in SHAPES:
        raise ValueError(f"unknown shape {c.shape}")
    law = Laws(c, draw)
    most = law.depth()
    parent, depth = [-1], [0]

    def add(p: int) -> int:
        parent.append(p)
        depth.append(depth[p] + 1)
        return len(parent) - 1

    def offspring(level: int) -> int:
        if c.shape == "chain":
            return 1
        if c.shape == "star":
            return c.fanout if level == 0 else 0
        if c.shape == "skewed":
            return 1 + int(draw.integers(2 * c.fanout + 1)) if draw.random() < 0.15 else int(draw.integers(c.fanout + 1))
        return c.fanout if c.shape == "kary" else law.fanout()

    def grow(root: int, room: int) -> None:
        todo = deque([root])
        while todo and len(parent) < room:
            at = todo.popleft()
            if depth[at] < most:
                for _ in range(min(offspring(depth[at]), room - len(parent))):
                    todo.append(add(at))

    if c.shape in ("spine", "deepwide"):
        backbone = [0]
        for _ in range(1 if c.shape == "spine" else max(1, c.fanout)):
            at = 0
            while depth[at] < most and len(parent) < c.max_spans:
                at = add(at)
                backbone.append(at)
        share = (c.max_spans - len(parent)) // len(backbone)
        for at in backbone:
            room = min(c.max_spans, len(parent) + share)
            for _ in range(law.fanout() - 1):
                if len(parent) < room:
                    grow(add(at), room)
    elif c.shape == "slab":
        budget = c.max_spans / law.mean_fanout()
        level = np.arange(1, most + 1)
        phase = level % c.spindle if c.spindle > 1 else level
        lobe = phase * (c.spindle - phase) ** 3.0 if c.spindle > 1 else np.ones(most)
        width = np.maximum(1, (budget * lobe / max(lobe.sum(), 1e-9)).astype(int))
        front = [0]
        for d in range(most):
            following: list[int] = []
            for at in front:
                for _ in range(max(c.fanout_min, law.fanout())):
                    if len(parent) < c.max_spans:
                        child = add(at)
                        if len(following) < width[d]:
                            following.append(child)
            front = following
    else:
        grow(0, c.max_spans)
    return parent, depth


def place_times(parent: list[int], concurrency: float) -> tuple[np.ndarray, np.ndarray]:
    """Start and end ticks: a span lasts as long as its subtree needs, siblings follow or slide together."""
    n = len(parent)
    need = [2] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        need[parent[i]] += need[i]
    start, used = [0] * n, [1] * n
    for i in range(1, n):
        p = parent[i]
        start[i] = start[p] + 1 + int((used[p] - 1) * (1 - concurrency))
        used[p] += need[i]
    first = np.array(start, dtype=np.int64)
    return first, first + np.array(need, dtype=np.int64) - 1


def traces(spark: SparkSession, n: int, c: Shape = Shape()) -> DataFrame:
    """``n`` traces, each drawn from a stream of its own (the seed and its number), so any part of them can be made again."""
    return traces_of(spark.range(n).withColumnRenamed("id", "trace_id"), c)


def traces_of(numbers: DataFrame, c: Shape = Shape()) -> DataFrame:
    """A trace for every ``trace_id`` (not negative), drawn from a stream of its own; the rows come trace by trace.

    The numbers are dealt over a stated count of partitions: they are few bytes, which adaptive execution would
    read in one task, while the traces made of them are hundreds of rows each.
    """
    spark = ship(numbers.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = [x.split()[0] for x in SPANS.split(", ")]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                draw = np.random.Generator(np.random.PCG64([c.seed, i]))
                parent, depth = draw_tree(c, draw)
                ids = draw.integers(1, 1 << 63, size=len(parent), dtype=np.int64)
                service = [f"svc-{k}" for k in draw.integers(c.services, size=len(parent))]
                start, end = place_times(parent, c.concurrency)
                up = np.where(np.array(parent) >= 0, ids[np.array(parent)], 0)
                columns = [np.full(len(ids), i, dtype=np.int64), ids, up, pa.array(service), start, end, np.array(depth, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    return numbers.select("trace_id").repartition(parts, F.xxhash64("trace_id")).mapInArrow(run, SPANS)


def complete_trees(spark: SparkSession, grid: list[tuple[int, int]], base_us: int = BASE_US) -> DataFrame:
    """A complete tree per (depth, width), one row per span: ids by level, times depth first, in closed form."""
    out = None
    for t, (depth, width) in enumerate(grid):
        took = [LEAF_US]
        for _ in range(depth):
            took.append(width * (took[-1] + STEP_US))
        before = [sum(width**k for k in range(d)) for d in range(depth + 2)]
        for d in range(depth + 1):
            # the digits of a place in base ``width`` are the child numbers on its path
            steps = F.lit(0).cast("long")
            for j in range(1, d + 1):
                digit = F.floor(F.col("id") / width ** (d - j)).cast("long") % width
                steps = steps + digit * (took[depth - j] + STEP_US)
            up = F.lit(0).cast("long") if d == 0 else (F.floor(F.col("id") / width) + before[d - 1] + 1).cast("long")
            rows = spark.range(width**d).select(
                F.lit(t).cast("long").alias("trace_id"),
                (F.col("id") + before[d] + 1).alias("span_id"),
                up.alias("parent_id"),
                F.concat(F.lit("Service"), (F.col("id") + before[d] + 1).cast("string")).alias("service"),
                (steps + base_us).alias("start_us"),
                (steps + base_us + took[depth - d]).alias("end_us"),
                F.lit(d).alias("depth"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def tree_grid(spark: SparkSession, depths: range = range(2, 11), widths: range = range(1, 21), copies: int = 20) -> DataFrame:
    """The batch of trees to make: depth, width, spans of one, and of all copies."""
    rows = spark.range(depths.start, depths.stop).select(F.col("id").cast("int").alias("depth")).crossJoin(F.broadcast(spark.range(widths.start, widths.stop).select(F.col("id").cast("int").alias("width"))))
    nodes = F.aggregate(F.sequence(F.lit(0), F.col("depth")), F.lit(0).cast("long"), lambda a, d: a + F.pow(F.col("width"), d).cast("long"))
    return rows.withColumn("nodes", nodes).withColumn("total", F.col("nodes") * copies)


def closed_sizes(spark: SparkSession, depths: range, widths: range, distance: int = 1, entry: int = 15) -> DataFrame:
    """Ancestry sizes of complete trees without making them: filters of the path since the last checkpoint, entries per fan-out on it."""
    grid = tree_grid(spark, depths, widths, 1).select("depth", "width", F.col("nodes").alias("total_nodes"))
    level = grid.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    marks = level.where(f"d = 0 or d = depth or d % {distance} = 0") if distance > 0 else level.where("d = 0 or d = depth")
    # the checkpoint before: the level's predecessor among the marked ones
    step = F.when(F.col("d") == 0, 0).when(F.lit(distance > 0), F.when(F.col("d") % max(1, distance) == 0, F.lit(distance)).otherwise(F.col("d") % max(1, distance))).otherwise(F.col("d"))
    rows = marks.withColumn("path", step).withColumn("n", F.pow("width", "d").cast("long"))
    sizes = F.element_at(F.array(*[F.lit(tags.filter_text_bytes(k)).cast("long") for k in range(depths.stop)]), (F.col("path") + 1).cast("int"))
    per = rows.groupBy("depth", "width", "total_nodes").agg(
        F.sum(F.col("n") * sizes).alias("bloom_size"),
        F.sum(F.when(F.col("width") > 1, F.col("n") * F.col("path") * entry).otherwise(0)).cast("long").alias("hash_size"),
        (F.sum("n") * 6).alias("mode_size"),
    )
    out = per.withColumn("total_ancestry_size", F.col("bloom_size") + F.col("hash_size") + F.col("mode_size"))
    return out.withColumn("avg_ancestry_size_per_span", F.col("total_ancestry_size") / F.col("total_nodes"))


def truss_sizes(spark: SparkSession, waves: tuple[int, ...], widths: tuple[int, ...], id_bytes: int = 8, ordinal_bytes: int = 4) -> DataFrame:
    """Mean bytes that a child of a span gets where ``waves`` of ``width`` children start and end wave by wave.

    A child gets the trace's id and the ends of the wave before; the first child of a wave gets those ends
    once more, as the list that was open.
    """
    grid = spark.createDataFrame([(s, w) for s in waves for w in widths], "waves int, width int")
    kids = grid.withColumn("wave", F.explode(F.sequence(F.lit(1), F.col("waves")))).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("width"))))
    pair = id_bytes + ordinal_bytes
    got = F.when(F.col("wave") > 1, id_bytes + F.col("width") * pair + F.when(F.col("j") == 1, F.col("width") * pair).otherwise(0)).otherwise(0)
    return kids.groupBy("waves", "width").agg(F.avg(got).alias("mean_bytes"))
