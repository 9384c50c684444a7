"""Binary corpora byte by byte, in several files, by index and without one; broken ones are refused."""

from __future__ import annotations

import glob
import os
import struct

import pytest
from pyspark.sql import functions as F

from spanloom.sources import binary


def test_an_events_file_from_elsewhere(spark, tmp_path):
    rows = [(10, 5, 0, 7, 0, 1, 0), (11, -1, 5, -7, 300, 65535, 0), (20, -1, 5, -7, 300, 65535, 1)]
    data = struct.pack("<II", 0x42524447, 1) + b"".join(struct.pack("<qqqqHHB3x", *r) for r in rows)
    path = str(tmp_path / "events.bin")
    open(path, "wb").write(data)
    got = binary.read(spark, path, "events").orderBy("pos").collect()
    assert [(r.pos, r.ts, r.span_id, r.parent_id, r.trace_id, r.depth, r.service_id, r.kind) for r in got] == [(i + 1, *r) for i, r in enumerate(rows)]
    assert binary.read(spark, path, "events").select("kind").where("kind = 1").count() == 1
    for broken in (data[:-1], b"", b"\0" * 8, struct.pack("<II", 0x42524447, 2)):
        open(path, "wb").write(broken)
        with pytest.raises(Exception, match="record|version"):
            binary.read(spark, path, "events").count()


def test_blocks_by_index(spark, tmp_path, monkeypatch):
    rows = [(t, s, 3 * s, s - 1, s % 5, t * 10 + s, t * 10 + s + 4, t % 3) for t in range(1, 60) for s in range(1, 2 + t % 7)]
    df = spark.createDataFrame(rows, "trace_id long, place int, span_id long, parent_id long, service_id int, start_ns long, end_ns long, flags int")
    path = str(tmp_path / "archive")
    binary.write(df.repartition(3, "trace_id").sortWithinPartitions("trace_id", "place"), path, "archive")
    want = sorted(rows)
    get = lambda: sorted((r.trace_id, r.place, r.span_id, r.parent_id, r.service_id, r.start_ns, r.end_ns, r.flags) for r in binary.read(spark, path, "archive").collect())
    assert get() == want and len(glob.glob(f"{path}/part-*.bin")) == 3 and not glob.glob(f"{path}/_*")
    for f in glob.glob(f"{path}/*.index"):
        os.remove(f)
    assert get() == want
    some = sorted(glob.glob(f"{path}/*.bin"))[0]
    data = open(some, "rb").read()
    open(some, "wb").write(data[:-3])
    with pytest.raises(Exception, match="ends inside trace"):
        binary.read(spark, path, "archive").count()


def test_many_pieces(spark, tmp_path):
    """More blocks than a piece holds: every piece starts where the index says."""
    n = 3000
    df = spark.range(1, n + 1).select(F.col("id").alias("trace_id"), F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))).alias("place"))
    df = df.select("trace_id", (F.col("place") % 2).alias("kind"), F.col("place").cast("long").alias("span_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(2).alias("service_id"), F.col("trace_id").alias("ts"))
    path = str(tmp_path / "store")
    binary.write(df.coalesce(1).sortWithinPartitions("trace_id", "span_id"), path, "store")
    reader = binary.Reader(path, "store")
    assert len(reader.partitions()) == 3
    back = binary.read(spark, path, "store")
    assert back.groupBy("trace_id").count().where(F.col("count") != F.col("trace_id") % 3 + 1).count() == 0
    assert back.where(F.col("block") + 1 != F.col("trace_id")).count() == 0 and back.where(F.col("place") != F.col("span_id")).count() == 0
    assert binary.read(spark, path, "store").count() == df.count()


def test_services_and_traces(spark, tmp_path):
    rows = [(0, "ä", None, None), (1, "b", None, None), (1, None, 9, 3), (2, None, -4, 70000)]
    path = str(tmp_path / "meta")
    binary.write(spark.createDataFrame(rows, binary.SCHEMAS["meta"]), path, "meta")
    got = binary.read(spark, path, "meta").collect()
    assert [(r.place, r.service) for r in got if r.service] == [(0, "ä"), (1, "b")]
    assert [(r.trace_id, r.num_spans) for r in got if not r.service] == [(9, 3), (-4, 70000)]
