"""The filter engine as a range join: no worker holds a trace, every step is a join or an aggregate.

Spans lie in bands of depths, cut at the checkpoints; an orphan meets the survivors of the band above it
(equi-join on trace and band, range condition inside), filters are tested as words of bits, and the deepest
hit is an aggregate. What a candidate needs besides itself - the ids named above it up to the window's
top - is the bitwise or of their masks, gathered level by level, so one test covers all of it. The number
of joins follows the checkpoint distance, never the depth or size of a trace. Only the hashing of ids is
a vectorised function over Arrow batches.

The result is that of :func:`reconstruct.by_filter`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import bloom_of_ids, unsigned
from spanloom.operators.handlers import Scheme
from spanloom.operators.reconstruct import LINKS
from spanloom.session import materialize, ship


def words(bits: Column, size: int) -> Column:
    """A filter of ``size`` bytes as numbers of eight bytes each."""
    return F.array(*[F.conv(F.hex(F.substring(bits, at + 1, 8)), 16, -10).cast("long") for at in range(0, size, 8)])


def held(filter_: str, mask: str) -> Column:
    """Whether a filter has all bits of a mask."""
    return F.forall(F.zip_with(filter_, mask, lambda w, m: w.bitwiseAND(m) == m), lambda x: x)


def both(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def decoded(survivors: DataFrame, s: Scheme) -> DataFrame:
    """``trace_id, span_id, parent_id, depth, filter, mask, up_mask`` (masks of the span and of its parent)."""
    ship(survivors.sparkSession)
    m, k = s.filter_size
    size = -(-m // 8)
    mask = lambda c: words(bloom_of_ids(F.array(F.col(c)), m, k), size)
    bits = F.when(F.col("br").isNotNull(), words(F.expr(f"substring(br, octet_length(br) - {size - 1}, {size})"), size))
    return survivors.select("trace_id", "span_id", "parent_id", "depth", bits.alias("filter"), mask("span_id").alias("mask"), mask("parent_id").alias("up_mask"))


def with_needs(rows: DataFrame, cpd: int) -> DataFrame:
    """``rows`` plus ``need``: the mask of a span and of all that can be named above it in its window."""
    level = F.col("depth") % cpd
    top = (level == 0) | (F.col("parent_id") == 0)
    out = done = rows.where(level <= 1).withColumn("need", F.when(top, F.col("mask")).otherwise(both("mask", "up_mask")))
    for r in range(2, cpd):
        above = done.where(level == r - 1).select("trace_id", F.col("span_id").alias("parent_id"), F.col("need").alias("_above"))
        own = rows.where(level == r).join(above, ["trace_id", "parent_id"], "left")
        own = own.withColumn("_above", F.coalesce("_above", "up_mask"))
        done = own.withColumn("need", F.when(F.col("parent_id") == 0, F.col("mask")).otherwise(both("mask", "_above"))).select(*out.columns)
        out = out.unionByName(done)
    return out


def covered(rows: DataFrame, cpd: int) -> DataFrame:
    """Every orphan with the filter that covers the gap above it (null if none), and the carrier it was borrowed from by a guess."""
    known = rows.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_up"))
    orphans = rows.where("parent_id <> 0").join(known, ["trace_id", "parent_id"], "left").where("_up is null").drop("_up")
    orphans = orphans.withColumn("band", (F.floor(F.col("depth") / cpd) + 1) * cpd)
    # carriers below an orphan on surviving edges, inside its band
    at = orphans.where("filter is null").select("trace_id", F.col("span_id").alias("orphan_id"), "band", "span_id")
    kids = rows.select("trace_id", F.col("span_id").alias("kid"), F.col("parent_id").alias("span_id"), "depth", "filter")
    met = None
    for _ in range(cpd):
        below = at.join(kids, ["trace_id", "span_id"]).where("depth <= band")
        found = below.where("filter is not null").select("trace_id", "orphan_id", "depth", F.col("kid").alias("carrier_id"), "filter")
        met = found if met is None else met.unionByName(found)
        at = below.where("filter is null").select("trace_id", "orphan_id", "band", F.col("kid").alias("span_id"))
    key = F.struct("depth", unsigned(F.col("carrier_id")).alias("key"))
    near = met.groupBy("trace_id", "orphan_id").agg(F.min_by("filter", key).alias("near"))
    bare = orphans.where("filter is null").join(near, [orphans["trace_id"] == near["trace_id"], orphans["span_id"] == near["orphan_id"]], "left_anti")
    # any other carrier of the band whose filter holds the orphan
    bare = bare.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("depth").alias("o_depth"), "mask", F.floor(F.col("depth") / cpd).alias("slot"))
    carriers = rows.where("filter is not null").select("trace_id", F.col("span_id").alias("carrier_id"), "depth", "filter", F.floor((F.col("depth") - 1) / cpd).alias("slot"))
    lent = bare.join(carriers, ["trace_id", "slot"]).where((F.col("depth") > F.col("o_depth")) & held("filter", "mask"))
    lent = lent.groupBy("trace_id", "orphan_id").agg(F.min_by(F.struct("filter", "carrier_id"), key).alias("lent"))
    own = orphans.select("trace_id", F.col("span_id").alias("orphan_id"), "depth", "filter")
    own = own.join(near, ["trace_id", "orphan_id"], "left").join(lent, ["trace_id", "orphan_id"], "left")
    cover = F.coalesce("filter", "near", "lent.filter").alias("filter")
    via = F.when(F.col("filter").isNull() & F.col("near").isNull(), F.col("lent.carrier_id")).alias("via")
    return own.select("trace_id", "orphan_id", "depth", cover, F.coalesce(via, F.lit(0).cast("long")).alias("via_carrier"))


def links(survivors: DataFrame, scheme: Scheme) -> DataFrame:
    """Every orphan under the deepest survivor at least two levels up that its filter holds with all that is named above it."""
    s = Scheme(**{**scheme.__dict__, "name": "pb"}).settled()
    rows = materialize(decoded(survivors, s), "range-survivors")
    orphans = materialize(covered(rows, s.cpd), "range-orphans")
    low = F.floor((F.col("depth") - 1) / s.cpd).alias("slot")
    asked = orphans.where("filter is not null").select("trace_id", "orphan_id", F.col("depth").alias("o_depth"), "filter", low)
    near = with_needs(rows, s.cpd).select("trace_id", F.col("span_id").alias("anchor_id"), "depth", "need", F.floor(F.col("depth") / s.cpd).alias("slot"))
    hits = asked.join(near, ["trace_id", "slot"]).where((F.col("depth") <= F.col("o_depth") - 2) & held("filter", "need"))
    per = hits.groupBy("trace_id", "orphan_id", "depth").agg(F.min_by("anchor_id", unsigned(F.col("anchor_id"))).alias("anchor_id"), F.count(F.lit(1)).alias("n"))
    best = per.groupBy("trace_id", "orphan_id").agg(F.max_by(F.struct("anchor_id", "depth", "n"), "depth").alias("best"))
    out = orphans.join(best, ["trace_id", "orphan_id"], "left")
    there = F.col("best").isNotNull()
    columns = [
        "trace_id",
        "orphan_id",
        F.col("best.anchor_id").alias("anchor_id"),
        (F.col("depth") - F.col("best.depth") - 1).cast("int").alias("synthetic"),
        F.coalesce(F.col("best.n") > 1, F.lit(False)).alias("ambiguous"),
        F.when(there, F.col("via_carrier")).otherwise(F.lit(0).cast("long")).alias("via_carrier"),
        F.lit(0).cast("long").alias("fanout"),
    ]
    return out.select(*columns).select(*[c.split()[0] for c in LINKS.split(", ")])
