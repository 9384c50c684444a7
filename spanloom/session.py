"""Session helpers shared by every operator: table access, shared storage, lineage cuts."""

from __future__ import annotations

import io
import os
import pathlib
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"
ROWS_OF_A_FILE = 200_000
_shipped: set[str] = set()
_kept: dict[int, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that setting is empty and the
    master is local (tests) does the engine pick a folder of its own; on a cluster an
    empty setting is an error, because a machine-local folder would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    Survives lost executors (unlike ``localCheckpoint``) and prunes columns on reread. Where ``rows``
    bounds the number of rows, they go into files of ``ROWS_OF_A_FILE``: a small table is not spread
    over a file for every shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_OF_A_FILE)))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody waits for a marker
    kept = spark.read.schema(schema).parquet(path)
    _kept[id(kept)] = (weakref.ref(kept, lambda _, key=id(kept): _kept.pop(key, None)), path)
    return kept


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more (a state that the next round replaced)."""
    held = _kept.pop(id(df), None)
    if held is None or held[0]() is not df:
        raise ValueError("not a materialized table")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(held[1])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = pathlib.Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom_ship.zip")
        pathlib.Path(path).write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
