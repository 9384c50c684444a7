"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit a task's memory, by a seeded hash of
the whole record; one task then holds one bucket. Pass two puts a bucket into a total order, shuffles
it by Fisher-Yates with a generator seeded by the bucket, and writes it: the places of all buckets
together number the whole permutation, which is cut into ``shards`` runs of equal length (one apart at
most), so a bucket adds one file to the shard it lies in, or one to each of the shards that meet
inside it. The law held is ``rows``: shard counts differ by one at most and slots are gapless.

A bucket has ``BUCKET_BYTES`` of whole records, extra columns included; where that made more than ``MANY_BUCKETS`` of them they grow, up to
``LARGEST_BUCKET``, so that the number of shuffle blocks stays in bounds. The bucket counts (one row
per bucket) are the only thing gathered.

Records that are equal in all columns share a hash. Where more than ``HOT_COPIES`` of them do, they
are counted first (combined before they are moved) and numbered, and the number joins the hash, so
that no bucket holds them all. Equal records cannot be told apart, so reruns agree.

Cases: null text has no bytes (size 8, crc32 of nothing, 0); null ids are dealt like others; rows that
repeat an id and text are dealt like any others; an empty table gives no rows; extra columns are
carried by the operator and dropped by the query. Reruns agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from spanloom.llm.batches import ship_texts
from spanloom.session import materialize, shared_dir, table

SHARDS = 24
BUCKET_BYTES = 16 << 20
LARGEST_BUCKET = 1 << 28
MANY_BUCKETS = 20_000
LEAST_BUCKETS = 8
#: Records of more copies than this, and than their share of ``1 / HOT_RECORDS`` of all rows, are numbered.
HOT_COPIES, HOT_RECORDS = 1000, 100_000
#: Rows that leave a worker at a time.
STEP = 1000
SEED = 77_003
RECORD_BYTES = 8
LAW = "rows"
#: Columns that the operator adds; those of ``docs`` with such a name come back with two underscores in front.
ADDED = ("size", "text_crc32", "shard", "slot", "bucket", "place", "one", "two", "copies")


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of n places; the swaps run from the last place to the first."""
    order = np.arange(n)
    draw = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed)))
    swap = np.floor(draw.random(n) * np.arange(1, n + 1)).astype(np.int64)
    held = order.tolist()
    for i in range(n - 1, 0, -1):
        j = swap[i]
        held[i], held[j] = held[j], held[i]
    return np.array(held, dtype=np.int64)


def size_of(text: str = "text") -> Column:
    """Bytes of a record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def record_bytes(docs: DataFrame) -> Column:
    """About what a whole record takes in memory: the bytes of texts, of other values as text, and a few per column."""
    out = F.lit(2 * len(docs.columns) * RECORD_BYTES).cast("long")
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() not in ("string", "binary"):
            c = F.to_json(F.struct(c)) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else c.cast("string")
        out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out


def crc_of(text: str = "text") -> Column:
    """Unsigned crc32 of the text's bytes; that of nothing where it is null."""
    return F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")


def _hashes(docs: DataFrame, seed: int) -> tuple[Column, Column]:
    """Two hashes of a whole record; a null differs from every value."""
    parts = []
    for f in docs.schema:
        own = F.array_sort(F.map_entries(F.col(f"`{f.name}`"))) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`")
        parts += [own.isNull(), own]
    return F.xxhash64(F.lit(seed), *parts), F.xxhash64(F.lit(seed + 1), *parts)


def _spread(keyed: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """``keyed`` with the hash of records that occur very often made from their number too."""
    at = ["one", "two"]
    hot = hashes.groupBy(*at).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > max(HOT_COPIES, rows // HOT_RECORDS))
    hot = materialize(hot, "shard-hot")
    if not hot.limit(1).count():
        return keyed
    hot = F.broadcast(hot)  # fewer than HOT_RECORDS rows
    rest = keyed.join(hot.select(*at), at, "left_anti")
    carried = [F.first(F.col(f"`{c}`")).alias(c) for c in keyed.columns if c not in at]
    once = keyed.join(hot, at).groupBy(*at).agg(F.first("copies").alias("copies"), *carried)
    each = once.withColumn("place", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("one", F.xxhash64("one", "place"))
    return rest.unionByName(each.select(*keyed.columns))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``size, text_crc32, shard, slot``.

    Columns of ``docs`` with one of the names in ``ADDED`` come back with two underscores in front.
    """
    spark = ship_texts(docs.sparkSession)
    own = docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c in ADDED})
    one, two = _hashes(own, seed)
    keyed = own.withColumn("one", one).withColumn("two", two)
    hashes = materialize(keyed.select("one", "two", record_bytes(own).alias("size")), "shard-hashes")
    sums = hashes.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    rows, total = sums["rows"], int(sums["bytes"] or 0)
    held = max(bucket_bytes, min(LARGEST_BUCKET, total // MANY_BUCKETS))
    buckets = max(LEAST_BUCKETS, -(-total // held))
    bucket = F.pmod("one", F.lit(buckets)).cast("int")
    scattered = _spread(keyed, hashes, rows).withColumn("bucket", bucket)
    counts = _spread(hashes.drop("size"), hashes, rows).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    first, upto = {}, 0
    for r in sorted(counts.collect()):  # one row per bucket
        first[r["bucket"]] = upto
        upto += r["n"]
    first = spark.sparkContext.broadcast(first)
    carried = own.columns
    schema = StructType(list(own.schema)).add("place", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)  # one bucket
        if not whole:
            return
        rows = pa.Table.from_batches(whole)
        del whole
        number = rows.column("bucket")[0].as_py()
        order = rows.select(["one", "two"]).append_column("at", pa.array(np.arange(rows.num_rows)))
        order = order.sort_by([("one", "ascending"), ("two", "ascending")]).column("at")
        order = order.take(pa.array(fisher_yates(rows.num_rows, (seed, number))))
        rows = rows.select(carried)
        for at in range(0, rows.num_rows, STEP):
            part = rows.take(order.slice(at, STEP))
            place = pa.array(np.arange(at, at + part.num_rows) + first.value[number])
            yield from part.append_column("place", place).combine_chunks().to_batches()

    # a partition is a bucket: repartitionById takes the number as it is
    dealt = scattered.select(*own.columns, "one", "two", "bucket").repartitionById(buckets, "bucket").mapInArrow(run, schema)
    least, longer = divmod(rows, shards)
    edge = longer * (least + 1)  # the first shards have one row more
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / (least + 1))).otherwise(longer + F.floor((place - edge) / max(1, least)))
    begin = F.col("shard") * least + F.least("shard", F.lit(longer))
    return (
        dealt.withColumn("size", size_of())
        .withColumn("text_crc32", crc_of())
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (place - begin).cast("long"))
        .drop("place")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled records into ``path``, a folder per shard, and return what was written.

    Each bucket writes its run of slots as one file of a shard (of each shard, where some meet in it).
    """
    out = shuffle_into_shards(docs, shards, seed, bucket_bytes).drop("size", "text_crc32")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards: written, and described from the files."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    written = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return written.select(
        "doc_id", size_of().alias("size"), crc_of().alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
