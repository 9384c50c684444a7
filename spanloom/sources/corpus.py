"""Corpora of traces as Parquet: events in global order, trace side files, per-trace stores and archives.

``events``: ``pos, trace_id, span_id, parent_id, service, kind (0 start, 1 end), ts, depth``, written in
ranges of the global order. ``meta``: one row per trace. ``store``: the events of each trace together,
traces numbered in the order they complete. ``archive``: spans with flags, each trace's together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.hashing import unsigned
from spanloom.operators import cleaning, structure
from spanloom.plans.order import numbered
from spanloom.plans.traces import dealt
from spanloom.plans.tree import with_depth
from spanloom.sources import jaeger

NAMES = ("events", "meta", "store", "archive")
SPAN = ["trace_id", "span_id", "parent_id", "service", "start_ns", "end_ns"]


def unordered_events(spans: DataFrame) -> DataFrame:
    """Two events per span."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("start_ns").alias("ts")), F.struct(F.lit(1).alias("kind"), F.col("end_ns").alias("ts"))))
    rows = spans.select("trace_id", "span_id", "parent_id", "service", "depth", both.alias("e"))
    return rows.select("trace_id", "span_id", "parent_id", "service", "e.kind", "e.ts", "depth")


def event_keys() -> list:
    """The canonical order: time, starts first, starts downwards and ends upwards, then ids as unsigned numbers."""
    turn = F.when(F.col("kind") == 0, F.col("depth")).otherwise(-F.col("depth"))
    return [F.col("ts"), F.col("kind"), turn, unsigned(F.col("trace_id")), unsigned(F.col("span_id"))]


def events_of(spans: DataFrame) -> DataFrame:
    """Events of all traces with their place in the global order."""
    return numbered(unordered_events(spans), event_keys())


def spans_of(events: DataFrame) -> DataFrame:
    """Spans whose start and end are both there."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    per = events.groupBy("trace_id", "span_id").agg(
        F.max("parent_id").alias("parent_id"), F.max("service").alias("service"), at(0).alias("start_ns"), at(1).alias("end_ns"), F.max("depth").alias("depth")
    )
    return per.where("start_ns is not null and end_ns is not null")


def meta_of(events: DataFrame) -> DataFrame:
    """Per trace: spans, services, first and last place, and the order in which traces complete (``completion`` from 1)."""
    per = events.groupBy("trace_id").agg(
        F.count(F.when(F.col("kind") == 0, 1)).alias("num_spans"), F.countDistinct("service").alias("num_services"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    return numbered(per, [F.col("last_pos")], "completion")


def store_of(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Events with their trace's completion and their place inside the trace."""
    inside = F.row_number().over(Window.partitionBy("trace_id").orderBy("pos"))
    return events.withColumn("place", inside).join(meta.select("trace_id", "completion"), "trace_id")


def archive_to_events(archive: DataFrame, exclude_flags: int = 0) -> DataFrame:
    """Events of an archive: without traces that have one of the flags, of several trees the largest, depths anew."""
    bad = archive.where(F.col("flags").bitwiseAND(F.lit(exclude_flags)) != 0).select("trace_id").distinct()
    kept = cleaning.salvage(archive.join(bad, "trace_id", "left_anti").select(*SPAN))
    return events_of(with_depth(kept))


def write(df: DataFrame, path: str, name: str) -> None:
    """Write one part of a corpus; rows of a trace lie together in stores and archives, events in order."""
    by_trace = {"store": ["completion", "place"], "archive": ["trace_id", "start_ns", "span_id"]}
    if name in by_trace:
        df = dealt(df, "trace_id").sortWithinPartitions(*by_trace[name])
    elif name == "events":
        df = df.repartitionByRange("pos").sortWithinPartitions("pos")
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One part of a corpus."""
    if name not in NAMES:
        raise ValueError(f"unknown part {name}")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def prepare(spark: SparkSession, documents: str, path: str, require_clean: bool = True, lines: bool = False) -> None:
    """Documents to a corpus: archive, events, meta and store."""
    spans = jaeger.load(spark, documents, require_clean, lines)
    write(spans, path, "archive")
    write(events_of(read(spark, path, "archive")), path, "events")
    events = read(spark, path, "events")
    write(meta_of(events), path, "meta")
    write(store_of(events, read(spark, path, "meta")), path, "store")


def integrity(archive: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Figures of an archive in one row; with ``meta`` also the traces on which the two disagree."""
    ids = archive.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    rows = archive.join(ids, ["trace_id", "parent_id"], "left")
    per = rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count(F.when(F.col("parent_id") == 0, 1)).alias("roots"),
        F.count(F.when((F.col("parent_id") != 0) & F.col("there").isNull(), 1)).alias("dangling"),
        F.count(F.when(F.col("end_ns") < F.col("start_ns"), 1)).alias("negative"),
        F.max(F.col("flags")).alias("flags"),
    )
    own = [
        F.count(F.lit(1)).alias("traces"),
        F.sum("spans").alias("spans"),
        F.max("spans").alias("largest"),
        F.count(F.when(F.col("roots") != 1, 1)).alias("not_one_root"),
        F.count(F.when(F.col("dangling") > 0, 1)).alias("with_dangling"),
        F.sum("negative").alias("negative_spans"),
        F.count(F.when(F.col("flags") != 0, 1)).alias("flagged"),
    ]
    if meta is None:
        return per.agg(*own)
    both = per.join(meta.select("trace_id", "num_spans"), "trace_id", "full").na.fill(0, ["spans", "roots", "dangling", "negative", "num_spans"])
    return both.agg(*own, F.count(F.when(F.coalesce("spans", F.lit(0)) != F.coalesce("num_spans", F.lit(0)), 1)).alias("mismatches"))


def root_counts(spans: DataFrame) -> DataFrame:
    """How many traces have how many roots."""
    per = spans.groupBy("trace_id").agg(F.count(F.when(F.col("parent_id") == 0, 1)).alias("roots"))
    return per.groupBy("roots").agg(F.count(F.lit(1)).alias("traces"))


#: Sizes up to so many are classes of their own; larger ones share a class with those that differ by one part in so many.
FINE = 64


def size_class(size) -> Column:
    """The class of a size: itself up to ``FINE``, then ``FINE`` classes for every doubling."""
    double = F.floor(F.log2(size.cast("double") / FINE))
    inside = F.floor((size / F.pow(F.lit(2.0), double) - FINE))
    return F.when(size <= FINE, size).otherwise(FINE + double * FINE + inside + 1).cast("int")


def deal_counts(classes: list[tuple[int, int, int]], parts: int) -> dict[int, list[int]]:
    """How many components of each class every part gets: ``(class, components, spans)``, the largest sizes first.

    A class goes to the lightest parts one by one as far as that is a matter of single components, and by the
    level that its parts reach together before.
    """
    load = [0.0] * parts
    out = {}
    for k, n, spans in sorted(classes, key=lambda c: -c[2] / c[1]):
        size, got, left = spans / n, [0] * parts, n
        if n > 4 * parts:
            order, low, filled = sorted(range(parts), key=load.__getitem__), 0.0, 0
            for i, part in enumerate(order, 1):
                low += load[part]
                filled = (low + spans) / i
                if i == parts or filled <= load[order[i]]:
                    break
            for part in order[:i]:
                got[part] = max(0, min(left, int((filled - load[part]) / size)))
                left -= got[part]
                load[part] += got[part] * size
        heap = [(w, part) for part, w in enumerate(load)]
        heapq.heapify(heap)
        for _ in range(left):
            w, part = heapq.heappop(heap)
            got[part] += 1
            heapq.heappush(heap, (w + size, part))
        for w, part in heap:
            load[part] = w
        out[k] = got
    return out


def component_parts(components: DataFrame, parts: int) -> DataFrame:
    """``component, part``: components of traces dealt out by load, the largest first to the lightest part.

    What is dealt are classes of sizes with their counts - a few thousand whatever the number of components -
    and a component's place in its class says which part it belongs to.
    """
    spark = components.sparkSession
    rows = components.select("component", "spans", size_class(F.col("spans")).alias("class"))
    sums = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("spans").alias("spans")).collect()  # one row per class
    counts = deal_counts([(r["class"], r["n"], r["spans"]) for r in sums], parts)
    upto, plan = 0, []
    for r in sorted(sums, key=lambda r: -r["class"]):
        ends, total = [], 0
        for n in counts[r["class"]]:
            total += n
            ends.append(total)
        plan.append((r["class"], upto, ends))
        upto += r["n"]
    known = F.broadcast(spark.createDataFrame(plan, "class int, before long, ends array<long>"))
    placed = numbered(rows, [F.desc("class"), F.col("component")], "_place", first=0).join(known, "class")
    rank = F.col("_place") - F.col("before")
    return placed.select("component", F.size(F.filter("ends", lambda e: e <= rank)).alias("part"))


def part_loads(spans: DataFrame, parts: int) -> DataFrame:
    """Per part: components, traces and spans, and the share by which it is heavier than the mean."""
    labelled = structure.trace_components(spans, "start_ns", "end_ns")
    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    per = labelled.join(sizes, "trace_id").groupBy("component").agg(F.count(F.lit(1)).alias("traces"), F.sum("n").alias("spans"))
    placed = per.join(component_parts(per, parts), "component")
    sums = placed.groupBy("part").agg(F.count(F.lit(1)).alias("components"), F.sum("traces").alias("traces"), F.sum("spans").alias("spans"))
    every = spans.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    sums = every.join(sums, "part", "left").na.fill(0)  # a part may stay empty
    mean = sums.agg((F.sum("spans") / parts).alias("mean"))
    return sums.crossJoin(F.broadcast(mean)).withColumn("over", F.round(F.col("spans") / F.col("mean") - 1, 6)).drop("mean")


def write_parts(spans: DataFrame, path: str, parts: int) -> None:
    """Spans in a folder per part; traces that overlap in time stay together."""
    labelled = structure.trace_components(spans, "start_ns", "end_ns")
    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    per = labelled.join(sizes, "trace_id").groupBy("component").agg(F.sum("n").alias("spans"))
    at = labelled.join(component_parts(per, parts), "component").select("trace_id", "part")
    dealt(spans.join(at, "trace_id"), "part", "trace_id").sortWithinPartitions("part", "trace_id").write.mode("overwrite").partitionBy("part").parquet(path)
