"""Which properties of a trace go with lost spans: rank correlations, lift by quantile bins, rates.

Nothing here sorts a whole column in one task. Equal values of a property are counted first, the
counts are dealt by value ranges, and a running count inside each range is set off by the totals of
the ranges before it. Correlations, quantiles, bins and medians follow from those counted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.loss import uniform_mix
from spanloom.operators.structure import service_totals
from spanloom.plans.tree import by_trace, with_depth
from spanloom.session import materialize

PROPERTIES = ("num_spans", "duration_us", "num_services")
BINS, LEAST_IN_BIN, LEAST_ROWS = 20, 10, 100
WIRE_BYTES = 4


def trace_properties(spans: DataFrame) -> DataFrame:
    """Per trace: its properties, and ``hit``, 1 where a span names a parent that is not there."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct().withColumn("there", F.lit(True))
    linked = spans.join(ids, ["trace_id", "parent_id"], "left")
    dangling = (F.col("parent_id") != 0) & F.col("there").isNull()
    return linked.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("num_spans"),
        (F.max("end_us") - F.min("start_us")).alias("duration_us"),
        F.countDistinct("service").alias("num_services"),
        F.max(dangling.cast("int")).alias("hit"),
    )


def counted_values(traces: DataFrame, names: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """``name, value, n, hits, before, total``: distinct values, their rows, and the rows below them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]))
    rows = traces.select(pairs.alias("p"), "hit").select("p.name", "p.value", "hit").where("value is not null")
    counts = rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    parts = max(1, int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(counts.repartitionByRange(parts, "name", "value").withColumn("part", F.spark_partition_id()), "values")
    # one row per name and range: at most as many as there are partitions
    ahead = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("name", "part").agg(F.sum("n").alias("m"))
    sums = sums.select("name", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("off"), F.sum("m").over(Window.partitionBy("name")).alias("total"))
    below = Window.partitionBy("name", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("inner", F.coalesce(F.sum("n").over(below), F.lit(0)))
    return inner.join(sums, ["name", "part"]).select("name", "value", "n", "hits", (F.col("inner") + F.col("off")).alias("before"), "total")


def correlations(spans: DataFrame) -> DataFrame:
    """Spearman and point-biserial correlation of every property with ``hit``.

    Null for fewer than ``LEAST_ROWS`` traces or where a side does not vary.
    """
    c = materialize(counted_values(trace_properties(spans)), "counted").withColumn("place", F.col("before") + (F.col("n") + 1) / 2)
    mean = lambda x: F.sum(x * F.col("n")) / F.sum("n")
    middle = c.groupBy("name").agg(
        mean(F.col("place")).alias("mid_place"), mean(F.col("value")).alias("mid_value"), (F.sum("hits") / F.sum("n")).alias("share")
    )
    both = c.join(middle, "name")

    def corr(x: str):
        off = F.col(x) - F.col(f"mid_{x}")
        cov = F.sum(off * (F.col("hits") - F.col("n") * F.col("share")))
        spread = F.sum(F.col("n") * off * off) * F.first("total") * F.first("share") * (1 - F.first("share"))
        return F.when((F.first("total") >= LEAST_ROWS) & (spread > 0), F.round(cov / F.sqrt(spread), 6))

    return both.groupBy("name").agg(F.first("total").alias("traces"), corr("place").alias("spearman"), corr("value").alias("point_biserial"))


def quantile_lift(spans: DataFrame) -> DataFrame:
    """Share of hit traces per quantile bin of every property, with the bin's median value.

    Edges are the distinct linearly interpolated quantiles; bins of under ``LEAST_IN_BIN`` go.
    """
    c = materialize(counted_values(trace_properties(spans)), "counted")
    steps = F.sequence(F.lit(0), F.lit(BINS)).cast("array<long>")
    low = lambda i: F.floor(i * (F.col("total") - 1) / BINS)
    holds = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("n"))
    at_low = c.select("name", "value", "total", F.explode(F.filter(steps, lambda i: holds(low(i)))).alias("i"))
    high = lambda i: F.least(low(i) + 1, F.col("total") - 1)
    at_high = c.select("name", F.col("value").alias("upper"), F.explode(F.filter(steps, lambda i: holds(high(i)))).alias("i"))
    rest = (F.col("i") * (F.col("total") - 1)) % BINS
    edge = F.col("value") + (F.col("upper") - F.col("value")) * rest.cast("double") / F.lit(float(BINS))
    edges = at_low.join(at_high, ["name", "i"]).groupBy("name").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    reached = F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1
    binned = c.join(edges, "name").withColumn("bin", F.greatest(F.lit(0), F.least(reached, F.size("edges") - 2)))
    bins = binned.groupBy("name", "bin").agg(F.sum("n").alias("traces"), F.sum("hits").alias("hits"), F.min("before").alias("first"))
    inside = binned.join(bins.select("name", "bin", "traces", "first"), ["name", "bin"])
    place = lambda k: F.max(F.when(holds(F.col("first") + F.floor((F.col("traces") - 1 + k) / 2)), F.col("value")))
    centre = inside.groupBy("name", "bin").agg(((place(0) + place(1)) / 2).alias("centre"))
    kept = bins.where(F.col("traces") >= LEAST_IN_BIN).join(centre, ["name", "bin"])
    return kept.select("name", "bin", "traces", "hits", (F.col("hits") / F.col("traces")).alias("rate"), "centre")


def service_rates(spans: DataFrame, least: int = LEAST_ROWS, top: int = 30) -> DataFrame:
    """The services of at least ``least`` spans with the highest share of dangling ones: a top-30 report."""
    rate = F.col("dangling_spans") / F.col("total_spans")
    large = service_totals(spans).where(F.col("total_spans") >= least).withColumn("rate", rate)
    return large.orderBy(F.desc("rate"), "service").limit(top).select("service", "total_spans", "dangling_spans", "rate")


def prefix_bytes(spans: DataFrame, cpd: int = 3) -> DataFrame:
    """Per trace: checkpoints, and the bytes of id prefix that tell them apart (ids are mixed to 31 bits)."""
    marks = with_depth(spans).where(F.col("depth") % cpd == 0).select("trace_id", uniform_mix().alias("wire"))
    before = F.lag("wire").over(Window.partitionBy("trace_id").orderBy("wire"))
    apart = by_trace(marks).withColumn("x", F.col("wire").bitwiseXOR(before))
    common = F.when(F.col("x") == 0, F.lit(WIRE_BYTES)).otherwise(F.floor((8 * WIRE_BYTES - F.length(F.bin("x"))) / 8))
    return apart.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("checkpoints"), (F.coalesce(F.max(common), F.lit(0)) + 1).cast("int").alias("needed_bytes")
    )
