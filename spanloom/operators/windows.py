"""Payloads and prefix links of traces of any size, window by window.

A trace is cut at its checkpoints. A window is a checkpoint, the spans below it down to the next checkpoints,
and those too, as exits: what a span persists depends on its window alone, so windows are shuffled and worked
on instead of traces, many in a worker at a time, and a giant trace is as many tasks as its windows fill. A
checkpoint is in two windows, as the head of its own and as an exit of the one above; its payload is the exit's.
Which window a span lies in is handed down level by level, one join per level between two checkpoints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import id_bytes, unsigned
from spanloom.operators import handlers
from spanloom.operators.handlers import PAYLOAD, Scheme
from spanloom.operators.reconstruct import LINKS
from spanloom.plans.traces import map_traces
from spanloom.plans.tree import with_tree
from spanloom.session import materialize

#: Schemes whose payloads need no more than their window.
SCHEMES = ("vanilla", "pb", "pcr", "pcrb", "cgprb")


def windowed(tree: DataFrame, cpd: int) -> DataFrame:
    """``tree`` (with ``depth``) plus ``window`` and ``head``: every span in its window, non-root checkpoints in both of theirs."""
    level = F.col("depth") % cpd
    out = tree.where(level == 0).withColumns({"window": F.col("span_id"), "head": F.lit(True)})
    above = None
    for r in range(1, cpd + 1):
        own = tree.where((level == r % cpd) & (F.col("depth") > 0))
        if r == 1:
            own = own.withColumn("window", F.col("parent_id"))
        else:
            own = own.join(above.select("trace_id", F.col("span_id").alias("parent_id"), "window"), ["trace_id", "parent_id"])
        above = own.withColumn("head", F.lit(False)).select(*out.columns)
        out = out.unionByName(above)
    return out


def payloads(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """:func:`handlers.payloads` of any trace, one window at a time."""
    s = scheme.settled()
    if s.name not in SCHEMES:
        raise ValueError(f"payloads of {s.name} reach beyond a window")
    tree = materialize(with_tree(spans.select("trace_id", "span_id", "parent_id", "service", "start_us", "end_us")), "windows-tree")
    tree = tree.withColumn("is_leaf", F.col("children") == 0)
    rows = windowed(tree, s.cpd).withColumn("key", F.xxhash64("trace_id", "window"))
    columns = ["key", "trace_id", "window", "head", "span_id", "parent_id", "start_us", "depth", "is_leaf"]

    def run(rows: pa.Table) -> pa.Table:
        trace, window, span = (rows.column(c).to_numpy() for c in ("trace_id", "window", "span_id"))
        head, depth = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("head", "depth"))
        # windows by number: two of one key stay apart
        order = np.lexsort((window, trace))
        edge = (np.diff(trace[order]) != 0) | (np.diff(window[order]) != 0)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.concatenate([[0], np.cumsum(edge)])
        up = np.where(head, 0, rows.column("parent_id").to_numpy())
        own = pa.table(
            [pa.array(number), rows.column("span_id"), pa.array(up), rows.column("start_us"), pa.array(depth), rows.column("is_leaf"), rows.column("parent_id")],
            names=["trace_id", "span_id", "parent_id", "start_us", "at_depth", "is_leaf", "true_parent"],
        )
        out = handlers._simple(own, s)
        out = out.set_column(out.schema.get_field_index("trace_id"), "trace_id", pa.array(trace))
        out = out.set_column(out.schema.get_field_index("parent_id"), "parent_id", rows.column("parent_id").combine_chunks())
        return out.filter(pa.array(~head | (depth == 0)))

    return map_traces(rows.select(*columns), run, PAYLOAD, key="key")


def prefix_links(survivors: DataFrame, scheme: Scheme) -> DataFrame:
    """:func:`reconstruct.by_prefix` (``pcr``) as joins: the nearest carrier of every orphan, and the checkpoint that it names."""
    s = scheme.settled()
    cpd = s.cpd
    level = F.lit(1)
    for i in range(1, 4):
        level = level + (F.col("depth") >= 1 << 7 * i).cast("int")
    head = F.when(F.col("br").isNotNull(), F.substring(F.col("br"), F.lit(2) + level, F.lit(s.prefix)))
    rows = materialize(survivors.select("trace_id", "span_id", "parent_id", "depth", head.alias("prefix")), "prefix-survivors")
    known = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_up"))
    orphans = rows.where("parent_id <> 0").join(known, ["trace_id", "parent_id"], "left").where("_up is null")
    orphans = materialize(orphans.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("depth").alias("o_depth"), "prefix"), "prefix-orphans")
    own = orphans.where("prefix is not null").select("trace_id", "orphan_id", F.col("o_depth").alias("depth"), F.col("orphan_id").alias("carrier_id"), "prefix")
    at = orphans.where("prefix is null").select("trace_id", "orphan_id", ((F.floor(F.col("o_depth") / cpd) + 1) * cpd).alias("band"), F.col("orphan_id").alias("span_id"))
    kids = rows.select("trace_id", F.col("span_id").alias("kid"), F.col("parent_id").alias("span_id"), "depth", "prefix")
    met = own
    for _ in range(cpd):  # a band has so many levels
        below = at.join(kids, ["trace_id", "span_id"]).where("depth <= band")
        met = met.unionByName(below.where("prefix is not null").select("trace_id", "orphan_id", "depth", F.col("kid").alias("carrier_id"), "prefix"))
        at = below.where("prefix is null").select("trace_id", "orphan_id", "band", F.col("kid").alias("span_id"))
    key = F.struct("depth", unsigned(F.col("carrier_id")).alias("key"))
    near = met.groupBy("trace_id", "orphan_id").agg(F.min_by(F.struct("carrier_id", "depth", "prefix"), key).alias("c"))
    top = F.when(F.col("c.depth") % cpd == 0, F.col("c.depth") - cpd).otherwise(F.floor(F.col("c.depth") / cpd).cast("int") * cpd)
    asked = near.select("trace_id", "orphan_id", F.col("c.carrier_id").alias("carrier_id"), top.cast("int").alias("depth"), F.col("c.prefix").alias("prefix"))
    checkpoints = rows.where(F.col("depth") % cpd == 0).select("trace_id", "depth", F.col("span_id").alias("anchor_id"), id_bytes(F.col("span_id"), s.prefix).alias("prefix"))
    hits = asked.join(checkpoints, ["trace_id", "depth", "prefix"])
    hits = hits.groupBy("trace_id", "orphan_id", "depth").agg(F.min_by("anchor_id", unsigned(F.col("anchor_id"))).alias("anchor_id"), F.count(F.lit(1)).alias("n"))
    out = orphans.join(asked.select("trace_id", "orphan_id", "carrier_id"), ["trace_id", "orphan_id"], "left").join(hits, ["trace_id", "orphan_id"], "left")
    via = F.when(F.col("carrier_id").isNotNull() & (F.col("carrier_id") != F.col("orphan_id")), F.col("carrier_id")).otherwise(F.lit(0).cast("long"))
    columns = [
        "trace_id",
        "orphan_id",
        "anchor_id",
        (F.col("o_depth") - F.col("depth") - 1).cast("int").alias("synthetic"),
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"),
        via.alias("via_carrier"),
        F.lit(0).cast("long").alias("fanout"),
    ]
    return out.select(*columns).select(*[c.split()[0] for c in LINKS.split(", ")])
