"""Span tables made from the test tables: heap-shaped traces and a view with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import table

HOUR_US = 36_000_000_000
WIDE_SEED = 7 * 1_299_709


def heap_spans(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """One trace per user; the user's events in time order are a k-ary heap of spans."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", zero, F.col("ts").cast("timestamp_ntz"))
    return e.select(
        F.col("user_id").cast("long").alias("trace_id"),
        rank.alias("span_id"),
        F.col("event_type").alias("service"),
        micros.alias("start_us"),
        (micros + F.floor(F.col("value") * HOUR_US).cast("long")).alias("end_us"),
    ).select(
        "trace_id",
        "span_id",
        F.when(F.col("span_id") == 1, F.lit(0)).otherwise(F.floor((F.col("span_id") + (k - 2)) / k)).cast("long").alias("parent_id"),
        "service",
        "start_us",
        "end_us",
    )


def dirty_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``heap_spans`` with missing parents, second roots and repeated spans in some traces."""
    s = heap_spans(spark, sf_dir)
    bent = F.when((F.col("trace_id") % 7 == 1) & (F.col("span_id") == 9), F.lit(900_000)).when(
        (F.col("trace_id") % 5 == 2) & (F.col("span_id") == 4), F.lit(0)
    )
    bent = bent.when((F.col("trace_id") % 11 == 3) & (F.col("span_id") == 5), F.lit(10)).otherwise(F.col("parent_id"))
    s = s.withColumn("parent_id", bent.cast("long"))
    twice = s.where((F.col("trace_id") % 13 == 4) & (F.col("span_id") == 6))
    other = s.where((F.col("trace_id") % 17 == 5) & (F.col("span_id") == 7)).withColumn("end_us", F.col("end_us") + 1)
    return s.unionByName(twice).unionByName(other)


def wide_spans(spans: DataFrame) -> DataFrame:
    """``spans`` with ids that fill 63 bits: mixed bits in front, so that prefixes tell most spans apart."""

    def wide(c: str):
        mixed = (F.col("trace_id") % 100_003) * 7_919 + (F.col(c) % 100_003) * 104_729 + WIDE_SEED
        return ((mixed * 48_271) % 2_147_483_647) * (1 << 32) + F.col(c)

    up = F.when(F.col("parent_id") == 0, F.lit(0).cast("long")).otherwise(wide("parent_id"))
    return spans.withColumns({"span_id": wide("span_id"), "parent_id": up})


def chain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten traces, each one long path of events in time order: deeper than any heap."""
    e = heap_spans(spark, sf_dir, k=1)
    order = Window.partitionBy(F.col("trace_id") % 10).orderBy("start_us", "trace_id", "span_id")
    rank = F.row_number().over(order).cast("long")
    return e.select((F.col("trace_id") % 10).alias("trace_id"), rank.alias("span_id"), (rank - 1).alias("parent_id"), "service", "start_us", "end_us")


HEAP_SQL = """
heap AS (
  SELECT user_id::BIGINT AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS span_id,
    event_type AS service, epoch_us(ts)::BIGINT AS start_us,
    (epoch_us(ts) + floor(value * 36000000000)::BIGINT)::BIGINT AS end_us
  FROM events WHERE user_id IS NOT NULL
), spans AS (
  SELECT trace_id, span_id, (CASE WHEN span_id = 1 THEN 0 ELSE span_id // 2 END)::BIGINT AS parent_id, service, start_us, end_us
  FROM heap
)"""

DIRTY_SQL = (
    HEAP_SQL
    + """, bent AS (
  SELECT trace_id, span_id, (CASE WHEN trace_id % 7 = 1 AND span_id = 9 THEN 900000
      WHEN trace_id % 5 = 2 AND span_id = 4 THEN 0 WHEN trace_id % 11 = 3 AND span_id = 5 THEN 10 ELSE parent_id END)::BIGINT AS parent_id,
    service, start_us, end_us FROM spans
), dirty AS (
  SELECT * FROM bent UNION ALL SELECT * FROM bent WHERE trace_id % 13 = 4 AND span_id = 6
  UNION ALL SELECT trace_id, span_id, parent_id, service, start_us, end_us + 1 FROM bent WHERE trace_id % 17 = 5 AND span_id = 7
)"""
)

WIDE_SQL = (
    HEAP_SQL.replace("), spans AS (", "), narrow AS (")
    + """, spans AS (
  SELECT trace_id, ((((trace_id % 100003) * 7919 + (span_id % 100003) * 104729 + 9097963) * 48271) % 2147483647) * 4294967296 + span_id AS span_id,
    CASE WHEN parent_id = 0 THEN 0 ELSE
      ((((trace_id % 100003) * 7919 + (parent_id % 100003) * 104729 + 9097963) * 48271) % 2147483647) * 4294967296 + parent_id END AS parent_id,
    service, start_us, end_us FROM narrow
)"""
)
