"""Numbers along a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.session import materialize


def numbered(df: DataFrame, keys: list[Column], name: str = "pos", first: int = 1) -> DataFrame:
    """``df`` plus the place of every row in the order of ``keys``.

    Rows are dealt by ranges of the keys and numbered inside each range; the ranges' row counts (one
    row per shuffle partition) give the offsets.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "order")
    counts, upto = [], first - 1
    for r in sorted(dealt.groupBy("_part").count().collect()):
        counts.append((r["_part"], upto))
        upto += r["count"]
    offsets = spark.createDataFrame(counts, "_part int, _off long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_in", place).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")
