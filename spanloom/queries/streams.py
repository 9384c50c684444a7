"""Queries over event streams, run over all that is there."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import handlers
from spanloom.operators.handlers import Scheme
from spanloom.plans.order import numbered
from spanloom.plans.tree import with_depth
from spanloom.queries import recon
from spanloom.queries.base import DEEP, EVENTS, START, Entry
from spanloom.queries.ingest import _folder, in_ns
from spanloom.sources import corpus
from spanloom.sources.views import heap_spans
from spanloom.streaming import assembly

BATCHES = 4


def _stretches(df: DataFrame, path: str) -> int:
    """Rows into ``path``, a file for each stretch of ``pos``; returns how many files make a batch.

    All files are written at once; then their ages are put into the order of the stretches, since a
    stream reads files by age.
    """
    spark = df.sparkSession
    parts = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(parts, "pos").sortWithinPartitions("pos").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    began = int(time.time()) - len(files)
    for i, p in enumerate(files):  # one step per file
        fs.setTimes(p, (began + i) * 1000, -1)
    return max(1, -(-len(files) // BATCHES))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stream of events in stretches of their order, and the table of traces."""
    path = _folder(spark, "stream")
    events = corpus.events_of(with_depth(in_ns(heap_spans(spark, sf_dir)))).select(*[c.split()[0] for c in assembly.EVENTS.split(", ")])
    files = _stretches(events, path)
    return assembly.event_stream(spark, path, files), corpus.meta_of(spark.read.parquet(path))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, meta = _events(spark, sf_dir)
    return assembly.run(assembly.assembled(assembly.with_totals(events, meta)), _folder(spark, "assembled"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, meta = _events(spark, sf_dir)
    path = _folder(spark, "measured")
    assembly.append_csv(assembly.measured(assembly.with_totals(events, meta)), path)
    return spark.read.schema(assembly.METRICS).option("header", True).csv(path)


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = _events(spark, sf_dir)
    out = assembly.run(assembly.densities(events), _folder(spark, "density"), "complete")
    return out.select(F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("long").alias("bucket"), "events")


def _pickups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = heap_spans(spark, sf_dir)
    ends = handlers.delayed_ends(spans, Scheme("crumbs", recon.CPD)).withColumn("kind", F.lit(1)).withColumn("turn", -F.col("depth"))
    starts = handlers._starts(spans).withColumn("kind", F.lit(0)).withColumn("turn", F.col("depth"))
    columns = ["service", "ts", "kind", "turn", "trace_id", "span_id"]
    rows = numbered(starts.select(*columns).unionByName(ends.select(*columns)), [F.col(c) for c in ("ts", "kind", "turn", "trace_id", "span_id")])
    path = _folder(spark, "queue")
    files = _stretches(rows.drop("turn"), path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    return assembly.pick_up(stream, _folder(spark, "pickups"), slice_rows=1000)


def entries() -> dict[str, Entry]:
    """All entries by name."""
    return {
        "stream_assembly": Entry(
            _assembled,
            START + DEEP + " SELECT trace_id, span_id, parent_id, service, start_us * 1000 AS start_ns, end_us * 1000 AS end_ns, depth, true AS complete FROM deep",
        ),
        "stream_metrics": Entry(
            _measured,
            START
            + DEEP
            + """, e AS (SELECT trace_id, span_id, depth, 0 AS kind, start_us * 1000 AS ts FROM deep UNION ALL SELECT trace_id, span_id, depth, 1, end_us * 1000 FROM deep
), p AS (SELECT *, row_number() OVER (ORDER BY ts, kind, CASE WHEN kind = 0 THEN depth ELSE -depth END, trace_id, span_id) AS pos FROM e
), r AS (SELECT *, sum(1 - 2 * kind) OVER (PARTITION BY trace_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT trace_id, count(*) FILTER (kind = 0) AS num_spans, max(depth)::INTEGER AS max_depth, min(CASE WHEN kind = 0 THEN ts END) AS start_ns,
  max(CASE WHEN kind = 1 THEN ts END) AS end_ns, max(n)::BIGINT AS max_concurrent, max(pos) AS last_pos, true AS complete FROM r GROUP BY trace_id""",
        ),
        "stream_density": Entry(
            _density,
            START + " SELECT (ts // 86400000000)::BIGINT AS bucket, count(*) AS events FROM (SELECT start_us AS ts FROM spans UNION ALL SELECT end_us FROM spans) GROUP BY ALL",
        ),
        "stream_pickups": Entry(
            _pickups,
            START
            + DEEP
            + EVENTS
            + recon.DELAYED_SQL
            + """, all_events AS (SELECT service, ts, 0 AS kind, depth AS turn, trace_id, span_id, trace_id AS t, span_id AS s FROM e WHERE kind = 0 UNION ALL
  SELECT service, ts, 1, -depth, trace_id, span_id, NULL, NULL FROM delayed
), w AS (SELECT *, first_value(t IGNORE NULLS) OVER f AS next_trace, first_value(s IGNORE NULLS) OVER f AS next_span FROM all_events
  WINDOW f AS (PARTITION BY service ORDER BY ts, kind, turn, trace_id, span_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT service, trace_id, span_id, ts, next_trace, next_span FROM w WHERE kind = 1 AND next_span IS NOT NULL""",
        ),
    }
