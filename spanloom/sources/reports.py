"""Report files: typed CSV tables, one document of parallel arrays, gzipped JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import structure

TRACES = "start_us bigint, end_us bigint, trace_duration_us bigint, num_spans bigint, num_dangling_spans bigint, max_concurrent_spans bigint, max_depth bigint, max_fanout bigint"
SERVICES = "service_name string, total_spans bigint, total_dangling_spans bigint, total_traces bigint"
METRICS = (
    "trace_id bigint, num_spans bigint, num_ckpt_spans bigint, ckpt_sum bigint, ckpt_max bigint, n_bag bigint, bag_sum bigint, bag_max bigint, "
    "n_depth bigint, depth_sum bigint, n_oc bigint, oc_sum bigint"
)
#: Columns of the metrics table by the name that :func:`spanloom.operators.handlers.trace_metrics` gives them.
METRIC_NAMES = {
    "num_ckpt_spans": "num_checkpoint_spans", "ckpt_sum": "checkpoint_sum", "ckpt_max": "max_checkpoint_payload", "n_bag": "num_baggage_calls", "bag_sum": "baggage_sum",
    "bag_max": "max_baggage_call", "n_depth": "num_depth_spans", "depth_sum": "depth_overhead_sum", "n_oc": "num_order_spans", "oc_sum": "order_overhead_sum",
}


def trace_table(spans: DataFrame) -> DataFrame:
    """Per trace what the arrival study reads; spans are not cleaned."""
    shape = structure.trace_shape(spans).select(
        "trace_id", "start_us", "end_us", F.col("wall_us").alias("trace_duration_us"), "num_spans", "max_depth", "max_fanout"
    )
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    rows = spans.join(ids, ["trace_id", "parent_id"], "left")
    gone = rows.groupBy("trace_id").agg(F.count(F.when((F.col("parent_id") != 0) & F.col("there").isNull(), 1)).alias("num_dangling_spans"))
    open_ = structure.max_concurrency(spans).withColumnRenamed("max_concurrent", "max_concurrent_spans")
    return shape.join(gone, "trace_id").join(open_, "trace_id")


def service_table(spans: DataFrame) -> DataFrame:
    """Per service what the arrival study reads."""
    t = structure.service_totals(spans)
    return t.select(F.col("service").alias("service_name"), "total_spans", F.col("dangling_spans").alias("total_dangling_spans"), "total_traces")


def metrics_table(metrics: DataFrame) -> DataFrame:
    """Per trace the sums that ratios are made of."""
    return metrics.select("trace_id", "num_spans", *[F.coalesce(F.col(c), F.lit(0)).alias(name) for name, c in METRIC_NAMES.items()])


def from_metrics_table(table: DataFrame) -> DataFrame:
    """The ratios behind a metrics table (0 where nothing is counted)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    named = table.select("trace_id", "num_spans", *[F.col(name).alias(c) for name, c in METRIC_NAMES.items()])
    return named.withColumns(
        {
            "amortized_by_total": ratio("checkpoint_sum", "num_spans"),
            "amortized_by_checkpoint": ratio("checkpoint_sum", "num_checkpoint_spans"),
            "avg_baggage_call": ratio("baggage_sum", "num_baggage_calls"),
        }
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed table; lines that start with # are remarks."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def parallel_arrays(df: DataFrame, order: list[Column], header: dict[str, object] | None = None) -> DataFrame:
    """One row: a document of parallel arrays, one per column, in one order, with ``header`` values in front.

    The document is one value, so it is for reports of up to 2 GB; larger ones stay tables.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(order)]
    rows = df.select(F.struct(*keys, *df.columns).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    fields = [F.lit(v).alias(k) for k, v in (header or {}).items()] + [F.col(f"r.{c}").alias(c) for c in df.columns]
    return rows.select(F.to_json(F.struct(*fields)).alias("document"))


def write_lines(df: DataFrame, path: str) -> None:
    """Gzipped JSON, one row a line."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def artifacts(survivors: DataFrame, links: DataFrame) -> DataFrame:
    """Per trace its survivors, links and orphans without a place: what a checker needs to replay a reconstruction."""
    own = survivors.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "parent_id", "depth", F.base64("br").alias("br")))).alias("survivors"))
    placed = F.array_sort(F.collect_list(F.when(F.col("anchor_id").isNotNull(), F.struct("orphan_id", "anchor_id", "synthetic", "ambiguous", "via_carrier"))))
    lost = F.array_sort(F.collect_list(F.when(F.col("anchor_id").isNull(), F.col("orphan_id"))))
    return own.join(links.groupBy("trace_id").agg(placed.alias("links"), lost.alias("unanchored")), "trace_id", "left")


ARTIFACT = (
    "trace_id bigint, survivors array<struct<span_id: bigint, parent_id: bigint, depth: int, br: string>>, "
    "links array<struct<orphan_id: bigint, anchor_id: bigint, synthetic: int, ambiguous: boolean, via_carrier: bigint>>, unanchored array<bigint>"
)


def from_artifacts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors and links of artifact lines."""
    s = lines.select("trace_id", F.explode("survivors").alias("s")).select("trace_id", "s.span_id", "s.parent_id", "s.depth", F.unbase64("s.br").alias("br"))
    b = lines.select("trace_id", F.explode("links").alias("b")).select("trace_id", "b.*", F.lit(0).cast("long").alias("fanout"))
    none = lines.select("trace_id", F.explode("unanchored").alias("orphan_id"))
    return s, b.unionByName(none, allowMissingColumns=True)


def rebuilt_spans(links: DataFrame, truth: DataFrame) -> DataFrame:
    """The survivors and the spans put in for lost ones, as one tree: ``synthetic`` says which are which.

    The lowest lost span keeps the id that its orphan names; those above get ids made from it and their
    distance. Their times are the orphan's, their service is unknown.
    """
    alive = truth.where("not dropped").select("trace_id", "span_id", "parent_id", "service", "start_us", "end_us", F.lit(False).alias("synthetic"))
    placed = links.where("anchor_id is not null and synthetic > 0").select("trace_id", F.col("orphan_id").alias("span_id"), "anchor_id", F.col("synthetic").alias("n"))
    rows = placed.join(alive.drop("synthetic"), ["trace_id", "span_id"])
    # orphans with one lost parent share it; the nearest anchor says what hangs between
    best = F.min(F.struct("n", "anchor_id", "span_id"))
    per = rows.groupBy("trace_id", F.col("parent_id").alias("lost_id")).agg(best.alias("b"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    each = per.select("trace_id", "lost_id", "start_us", "end_us", F.col("b.n").alias("n"), F.col("b.anchor_id").alias("anchor_id"), F.explode(F.sequence(F.lit(1), F.col("b.n"))).alias("k"))
    made = lambda k: F.when(k == 1, F.col("lost_id")).otherwise(F.xxhash64(F.lit("synthetic"), "trace_id", "lost_id", k))
    up = F.when(F.col("k") == F.col("n"), F.col("anchor_id")).otherwise(made(F.col("k") + 1))
    new = each.select("trace_id", made(F.col("k")).alias("span_id"), up.alias("parent_id"), F.lit("unknown").alias("service"), "start_us", "end_us", F.lit(True).alias("synthetic"))
    return alive.unionByName(new)


def loss_report(spans: DataFrame, low: float = 0.05, high: float = 0.25) -> DataFrame:
    """Per trace with dangling spans: their number, share and severity (below ``low``, up to ``high``, above)."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    rows = spans.join(ids, ["trace_id", "parent_id"], "left")
    gone = F.count(F.when((F.col("parent_id") != 0) & F.col("there").isNull(), 1))
    per = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), gone.alias("dangling")).where("dangling > 0")
    share = F.col("dangling") / F.col("spans")
    return per.withColumn("severity", F.when(share < low, "low").when(share <= high, "medium").otherwise("high"))
