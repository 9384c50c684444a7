"""Structural analytics of span trees: shape, concurrency, order, time components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans.tree import by_trace, fold_up, with_depth
from spanloom.session import materialize


def trace_shape(spans: DataFrame) -> DataFrame:
    """Per trace: spans, services, time range, depth, fan-out, roots and unreachable spans."""
    deep = with_depth(spans)
    fan = spans.where("parent_id <> 0").groupBy("trace_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    fan = fan.groupBy("trace_id").agg(F.max("n").alias("max_fanout"))
    per = deep.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("num_spans"),
        F.countDistinct("service").alias("num_services"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        (F.max("end_us") - F.min("start_us")).alias("wall_us"),
        F.count(F.when(F.col("end_us") <= F.col("start_us"), 1)).alias("zero_runtime"),
        F.max("depth").cast("long").alias("max_depth"),
        F.count(F.when(F.col("parent_id") == 0, 1)).alias("roots"),
        F.count(F.when(~F.col("rooted"), 1)).alias("unreachable"),
    )
    return per.join(fan, "trace_id", "left").withColumn("max_fanout", F.coalesce("max_fanout", F.lit(0)).cast("long"))


def max_concurrency(spans: DataFrame) -> DataFrame:
    """Per trace, the most spans open at once; at equal times starts count before ends."""
    end = F.greatest("start_us", "end_us")
    steps = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d"))))
    w = Window.partitionBy("trace_id").orderBy("t", F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = by_trace(spans.select("trace_id", steps.alias("s")).select("trace_id", "s.t", "s.d")).withColumn("open", F.sum("d").over(w))
    return running.groupBy("trace_id").agg(F.max("open").alias("max_concurrent"))


def service_totals(spans: DataFrame) -> DataFrame:
    """Per service: spans, spans whose parent is missing, traces."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    marked = spans.join(known, ["trace_id", "parent_id"], "left")
    return marked.groupBy("service").agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count(F.when((F.col("parent_id") != 0) & F.col("known").isNull(), 1)).alias("dangling_spans"),
        F.countDistinct("trace_id").alias("total_traces"),
    )


def ordered_events(spans: DataFrame) -> DataFrame:
    """Start and end events of every trace in the canonical order, with their place."""
    deep = with_depth(spans)
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("start_us").alias("ts")), F.struct(F.lit(1).alias("kind"), F.col("end_us").alias("ts"))))
    events = deep.select("trace_id", "span_id", "depth", both.alias("e")).select("trace_id", "span_id", "depth", "e.kind", "e.ts")
    turn = F.when(F.col("kind") == 0, F.col("depth")).otherwise(-F.col("depth"))
    w = Window.partitionBy("trace_id").orderBy("ts", "kind", turn, "span_id")
    return events.select("trace_id", "span_id", "kind", "ts", F.row_number().over(w).alias("pos"))


def sibling_ordinals(spans: DataFrame) -> DataFrame:
    """A child's place among its siblings by start; 0 for roots."""
    w = Window.partitionBy("trace_id", "parent_id").orderBy("start_us", "span_id")
    seq = F.when(F.col("parent_id") == 0, 0).otherwise(F.row_number().over(w))
    return by_trace(spans).select("trace_id", "span_id", seq.alias("seq"))


def end_lists(spans: DataFrame) -> DataFrame:
    """Per child: ordinals of the siblings that ended since the sibling before it started, in the order they ended."""
    seq = sibling_ordinals(spans.where("parent_id <> 0"))
    at = ordered_events(spans).join(spans.select("trace_id", "span_id", "parent_id"), ["trace_id", "span_id"]).where("parent_id <> 0")
    at = at.join(seq, ["trace_id", "span_id"])
    upto = Window.partitionBy("trace_id", "parent_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = at.withColumn("starts", F.sum((F.col("kind") == 0).cast("int")).over(upto))
    ends = run.where("kind = 1").groupBy("trace_id", "parent_id", (F.col("starts") + 1).alias("starts"))
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("e"))
    return run.where("kind = 0").join(ends, ["trace_id", "parent_id", "starts"]).select("trace_id", "span_id", F.col("e.seq").alias("ends"))


def clip(spans: DataFrame, start: str = "start_us", end: str = "end_us", sized: bool = False) -> DataFrame:
    """``spans`` with bounds clipped to their parent's clipped bounds; what lies outside goes with its subtree."""
    folded = fold_up(spans, {"_lo": (F.col(start), "max"), "_hi": (F.col(end), "min")}, parents=True, sized=sized)
    out = F.coalesce((F.col(end) < F.col("p__lo")) | (F.col(start) > F.col("p__hi")), F.lit(False))
    gone = fold_up(folded.select(*spans.columns, "_lo", "_hi", out.alias("_out")), {"_gone": (F.col("_out"), "any")}, sized=True)
    inside = gone.where(~F.col("_gone")).withColumns({start: F.col("_lo"), end: F.col("_hi")})
    return inside.select(*spans.columns)


def crisp_clip(spans: DataFrame) -> DataFrame:
    """:func:`clip` of the ids and bounds alone."""
    return clip(spans.select("trace_id", "span_id", "parent_id", "start_us", "end_us"))


def leaf_residues(spans: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """Leaves and branch points by depth modulo checkpoint distance, for several distances."""
    deep = with_depth(spans)
    kids = spans.where("parent_id <> 0").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count(F.lit(1)).alias("kids"))
    each = deep.join(kids, ["trace_id", "span_id"], "left").withColumn("cpd", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return each.groupBy("cpd", (F.col("depth") % F.col("cpd")).cast("int").alias("residue")).agg(
        F.count(F.when(F.col("kids").isNull(), 1)).alias("leaves"), F.count(F.when(F.col("kids") > 1, 1)).alias("branches")
    )


def fanout_widths(spans: DataFrame) -> DataFrame:
    """How many spans of all traces have how many children."""
    kids = spans.where("parent_id <> 0").groupBy("trace_id", "parent_id").agg(F.count(F.lit(1)).alias("width"))
    return kids.groupBy("width").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"))


def top_services(spans: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent services of each trace; ties by name."""
    n = spans.groupBy("trace_id", "service").agg(F.count(F.lit(1)).alias("spans"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("spans"), "service")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def trace_components(spans: DataFrame, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """``trace_id, lo, hi, component``: traces whose times overlap, directly or through others, share a number.

    Traces are put in order of their start by ranges. A range knows the furthest end of the ranges before
    it and how many groups began in them (one row per shuffle partition), so no order is global but theirs.
    """
    t = spans.groupBy("trace_id").agg(F.min(start).alias("lo"), F.max(end).alias("hi"))
    parts = max(1, int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(t.repartitionByRange(parts, "lo", "trace_id").withColumn("part", F.spark_partition_id()), "trace-times")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("part").agg(F.max("hi").alias("hi")).select("part", F.max("hi").over(ahead).alias("carried"))
    local = Window.partitionBy("part").orderBy("lo", "trace_id")
    before, upto = local.rowsBetween(Window.unboundedPreceding, -1), local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.greatest(F.max("hi").over(before), "carried")
    starts = dealt.join(F.broadcast(ends), "part").withColumn("reach", reach)
    starts = starts.withColumn("new", (F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).cast("int"))
    counts = starts.groupBy("part").agg(F.sum("new").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    numbers = starts.join(F.broadcast(base), "part").withColumn("component", F.col("base") + F.sum("new").over(upto))
    return numbers.select("trace_id", "lo", "hi", "component")


def time_components(spans: DataFrame) -> DataFrame:
    """Groups of traces that overlap in time: traces, first start, last end."""
    return trace_components(spans).groupBy("component").agg(F.count(F.lit(1)).alias("traces"), F.min("lo").alias("start_us"), F.max("hi").alias("end_us"))


def component_gaps(spans: DataFrame) -> DataFrame:
    """One row: groups, the largest, and the least, median and greatest gap between neighbours (index rule)."""
    c = materialize(time_components(spans), "components")
    nexts = c.select((F.col("component") - 1).alias("component"), F.col("start_us").alias("next_us"))
    gaps = c.join(nexts, "component").select((F.col("next_us") - F.col("end_us")).alias("gap"))
    middle = index_percentiles(gaps, "gap", (0.5,)).select(F.col("value").alias("gap_median"))
    head = c.agg(F.count(F.lit(1)).alias("components"), F.max("traces").alias("largest"))
    ends = gaps.agg(F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"))
    return head.crossJoin(F.broadcast(ends)).join(F.broadcast(middle), F.lit(True), "left")


def density(spans: DataFrame, window_us: int = 86_400_000_000) -> DataFrame:
    """Events per fixed window of time."""
    ts = F.explode(F.array("start_us", "end_us"))
    return spans.select(ts.alias("ts")).groupBy(F.floor(F.col("ts") / window_us).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


def index_percentiles(values: DataFrame, column: str, ps: tuple[float, ...] = (0.5, 0.9, 0.99), rule: str = "floor") -> DataFrame:
    """``p, value``: the value at an index of the sorted column, int(p * (n - 1)) or, by ``rule`` "share", int(p * n).

    Equal values are counted first, and the counted values are dealt by ranges: the ranges' totals (one
    row per shuffle partition) say in which one an index lies.
    """
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    h = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = materialize(h.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "values")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    sums = sums.select("part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("off"), F.sum("m").over(Window.partitionBy()).alias("total"))
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.withColumn("inner", F.sum("n").over(upto)).join(F.broadcast(sums), "part").withColumn("upto", F.col("inner") + F.col("off"))
    p = ranked.withColumn("p", F.explode(F.array(*[F.lit(x) for x in ps])))
    at = F.floor(F.col("p") * (F.col("total") - 1)) if rule == "floor" else F.least(F.floor(F.col("p") * F.col("total")), F.col("total") - 1)
    return p.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select("p", "value")
