"""Sizes of propagated metadata, in closed form, and the sizing of bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import bloom_size
from spanloom.operators.handlers import varint_bytes
from spanloom.operators.loss import with_kind


def scheme_bytes(spans: DataFrame, cpd: int = 3, fp: float = 1e-2, prefix: int = 4) -> DataFrame:
    """Per trace and scheme: emitted payloads, their bytes, calls and baggage bytes.

    ``pb``: bloom filter of the window; ``pcr``: truncated checkpoint id; ``pcrb``: both, the filter
    for at most cpd - 1 members. Spans without a payload emit their depth.
    """
    kinds = with_kind(spans, cpd)
    pb, pcrb = -(-bloom_size(cpd, fp)[0] // 8), -(-bloom_size(max(1, cpd - 1), fp)[0] // 8)
    body = {"vanilla": 0, "pb": pb, "pcr": prefix, "pcrb": prefix + pcrb}
    each = kinds.withColumn("scheme", F.explode(F.array(*[F.lit(s) for s in body])))
    size = F.lit(0)
    for s, n in body.items():
        size = F.when(F.col("scheme") == s, F.lit(n)).otherwise(size)
    # checkpoint prefixes travel with the absolute depth, filters alone with the depth in the window
    level = varint_bytes(F.when(F.col("scheme") == "pb", F.col("depth") % cpd).otherwise(F.col("depth")))
    on = F.col("scheme") != "vanilla"
    payload = F.when(on & F.col("carrier"), 4 + level + size).otherwise(0)
    depth_only = F.when(on & ~F.col("carrier"), 2 + varint_bytes(F.col("depth"))).otherwise(0)
    call = F.when(on & (F.col("parent_id") != 0), 3 + level + size).otherwise(0)
    sums = each.groupBy("trace_id", "scheme").agg(
        F.count(F.lit(1)).alias("num_spans"),
        F.count(F.when(F.col("carrier"), 1)).alias("num_carriers"),
        F.sum(payload).cast("long").alias("payload_bytes"),
        F.sum(depth_only).cast("long").alias("depth_bytes"),
        F.sum(call).cast("long").alias("baggage_bytes"),
        F.max(payload).cast("long").alias("max_payload"),
    )
    return sums.withColumn("amortized_by_total", F.coalesce(F.try_divide("payload_bytes", "num_spans"), F.lit(0.0)))
