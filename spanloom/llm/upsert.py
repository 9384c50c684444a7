"""Copy-on-write upsert by key into a folder of sorted Parquet files.

A table is a folder of files sorted by a key. A key's home is the last file that begins at or below it,
else the first file. Of all changes of a key the winner is the one with the highest order (combined
before anything is moved), and what is to happen with it may depend on its home. Winners are written
into staged logs, sorted, a folder per home; a home with many winners has several files, so no task
writes them alone. Then one task per touched file reads the file and its log side by side as two sorted
streams, cuts both at the same keys, and lets DuckDB join each slice (FULL JOIN, IS DISTINCT FROM). A
first pass over the slices counts the rows that stay and whether any differs; only then a second
pass writes them, as the fewest sorted files of at most ``rows`` rows, sizes one apart, larger first. At last
small rewritten neighbours are joined, new files take their places and the files they replace go.

Memory: a task holds a slice (``SLICE`` rows of either side, more only where one key has more), the driver a
line per starting file; how many those are is the caller's choice of ``rows`` (at most ``FILES`` of them in
the query). Files that a lost task left behind lie in the staging folder under names of their own; staged
files are moved into the table one by one and a move that is repeated does nothing, so every step can be
run again.

Cases: rows without a key are not written and changes without one are ignored; rows that repeat a key
stay side by side and all of those in its home are changed; changes that tie in order are decided by
their other values; a table without rows has no home, so it stays empty; without changes nothing is
rewritten; a file that loses all rows goes; extra columns of the table are kept, of the changes ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.order import numbered
from spanloom.session import materialize, shared_dir, ship, table

#: Rows of either side that a task joins at a time.
SLICE = 50_000
FILES = 1500
DUCK_MEMORY = "400MB"
PIECES = "home int, piece int, n_rows bigint, path string"
DIGESTS = "first_id bigint, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string, columns string, path string, rewritten boolean"


def filesystem(path: str) -> tuple[pfs.FileSystem, str]:
    """What reads a path in a worker: a URI's own file system, or the local one of a shared mount."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def text_crc(c: str) -> Column:
    """Unsigned crc32 of a value's text."""
    return F.crc32(F.col(c).cast("string").cast("binary"))


# ---- the table ----


def write_sorted(rows: DataFrame, path: str, key: str, size: int) -> list[tuple[str, int, int]]:
    """Write ``rows`` sorted by ``key`` as files of ``size`` rows; returns path, first key and rows of each, in order."""
    spark = rows.sparkSession
    own = rows.columns
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in own])
    placed = numbered(rows.where(F.col(key).isNotNull()), [F.col(key), tie, *[F.col(f"`{c}`") for c in own if c != key]], "_place", first=0)
    last = placed.agg(F.max("_place")).first()[0]
    if last is None:
        return []
    files = last // size + 1
    number = F.floor(F.col("_place") / size).cast("int")
    # a partition is a file: repartitionById takes the number as it is
    placed.withColumn("_file", number).repartitionById(files, "_file").sortWithinPartitions("_place").select(*own).write.parquet(path)
    found = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    names = sorted(found, key=lambda r: r["name"])  # one line per file; names begin with the number
    return [(f"{path}/{r['name']}", r["first"], r["n"]) for r in names]


def homes_of(ids: DataFrame, key: str, firsts: list[int]) -> DataFrame:
    """``ids`` plus ``home`` (number of a file) and ``home_first`` (its first key)."""
    bounds = np.array(firsts, dtype=np.int64)

    @F.pandas_udf("int")
    def home(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds, keys.to_numpy(dtype=np.int64), side="right") - 1, 0), dtype="int32")

    known = ids.sparkSession.createDataFrame(list(enumerate(firsts)), "home int, home_first bigint")
    return ids.withColumn("home", home(key)).join(F.broadcast(known), "home")


def winners_of(changes: DataFrame, key: str, order: list[str], kept: list[str]) -> DataFrame:
    """The change of every key that is highest in ``order``."""
    rest = [c for c in kept if c not in order and c != key]
    best = F.max(F.struct(*[F.col(f"`{c}`") for c in (*order, *rest)])).alias("_w")
    held = changes.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return held.select(key, *[F.col(f"_w.`{c}`").alias(c) for c in dict.fromkeys((*order, *rest))])


# ---- one touched file ----


def _sorted_batches(fs: pfs.FileSystem, paths: list[str]) -> Iterator[pa.Table]:
    for p in paths:
        with fs.open_input_file(p) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=SLICE):
                yield pa.Table.from_batches([batch])


def slices(old: Iterator[pa.Table], log: Iterator[pa.Table], key: str, empty: tuple[pa.Table, pa.Table], size: int = SLICE) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Two streams sorted by key, cut at the same keys: rows of a key are never parted."""
    held, feeds, done = list(empty), [old, log], [False, False]
    while not all(done) or held[0].num_rows or held[1].num_rows:
        for i in (0, 1):
            while not done[i] and held[i].num_rows < size:
                more = next(feeds[i], None)
                done[i] = more is None
                if more is not None:
                    held[i] = pa.concat_tables([held[i], more])
        ends = [held[i].column(key)[-1].as_py() for i in (0, 1) if not done[i]]
        keys = [t.column(key).to_numpy() for t in held]
        cuts = [int(np.searchsorted(k, min(ends), side="left")) if ends else len(k) for k in keys]
        if sum(cuts):
            yield held[0].slice(0, cuts[0]), held[1].slice(0, cuts[1])
            held = [t.slice(c) for t, c in zip(held, cuts, strict=True)]
        else:  # one key fills what is held: read on until it ends
            size *= 2


def cut_sizes(total: int, most: int) -> list[int]:
    """The fewest sizes of at most ``most``, one apart at most, larger first."""
    n = -(-total // most)
    return [total // n + (i < total % n) for i in range(n)]


class Joined:
    """One starting file and its log, joined slice by slice."""

    def __init__(self, path: str, logs: str, key: str, sets: list[str]):
        import duckdb

        self.fs, self.path = filesystem(path)
        _, folder = filesystem(logs)
        with self.fs.open_input_file(self.path) as f:
            self.schema = pq.read_schema(f)
        found = [x.path for x in self.fs.get_file_info(pfs.FileSelector(folder)) if x.is_file and x.path.endswith(".parquet")]
        begins, self.log_schema = [], None
        for p in found:
            with self.fs.open_input_file(p) as f:
                own = pq.ParquetFile(f)
                self.log_schema = own.schema_arrow
                begins.append((next(own.iter_batches(batch_size=1, columns=[key])).column(0)[0].as_py(), p))
        self.logs = [p for _, p in sorted(begins)]
        self.key, self.sets = key, sets
        self.duck = duckdb.connect()
        self.duck.execute(f"SET threads = 1; SET memory_limit = '{DUCK_MEMORY}'; SET temp_directory = ''")

    def __enter__(self) -> Joined:
        return self

    def __exit__(self, *_) -> None:
        self.duck.close()

    def _each(self) -> Iterator[None]:
        """Every slice in turn, as the DuckDB tables ``o`` and ``l``."""
        empty = self.schema.empty_table(), self.log_schema.empty_table()
        for old, log in slices(_sorted_batches(self.fs, [self.path]), _sorted_batches(self.fs, self.logs), self.key, empty):
            self.duck.register("o", old.append_column("_row", pa.array(np.arange(old.num_rows))))
            self.duck.register("l", log)
            yield

    def count(self) -> tuple[int, bool]:
        """Rows that stay, and whether any row differs from the file's."""
        k = f'"{self.key}"'
        differs = " OR ".join(f'o."{c}" IS DISTINCT FROM l."{c}"' for c in self.sets) or "false"
        total, changed = 0, False
        for _ in self._each():
            n, odd = self.duck.execute(
                f"""SELECT count(*) FILTER (WHERE NOT coalesce(l._deletes, false)),
  coalesce(bool_or(CASE WHEN l.{k} IS NULL THEN false WHEN l._deletes THEN o.{k} IS NOT NULL ELSE o.{k} IS NULL OR {differs} END), false)
FROM o FULL JOIN l ON o.{k} = l.{k}"""
            ).fetchall()[0]
            total, changed = total + n, changed or odd
        return total, changed

    def rows(self) -> Iterator[pa.Table]:
        """The rows that stay, in order."""
        k = f'"{self.key}"'
        columns = []
        for c in self.schema.names:
            if c == self.key:
                columns.append(f"coalesce(o.{k}, l.{k}) AS {k}")
            else:
                columns.append(f'CASE WHEN l.{k} IS NULL THEN o."{c}" ELSE l."{c}" END AS "{c}"' if c in self.sets else f'o."{c}"')
        for _ in self._each():
            sql = f"SELECT {', '.join(columns)} FROM o FULL JOIN l ON o.{k} = l.{k} WHERE NOT coalesce(l._deletes, false) ORDER BY coalesce(o.{k}, l.{k}), o._row"
            yield pa.table(self.duck.sql(sql).to_arrow_table()).cast(self.schema)

    def write(self, stem: str, sizes: list[int]) -> list[str]:
        """The rows as files of these sizes."""
        out, left, writer, sink = [], 0, None, None
        for part in self.rows():
            at = 0
            while at < part.num_rows:
                if not left:
                    left = sizes[len(out)]
                    out.append(f"{stem}-{len(out):06d}-{uuid.uuid4().hex}.parquet")
                    sink = self.fs.open_output_stream(filesystem(out[-1])[1])
                    writer = pq.ParquetWriter(sink, self.schema)
                take = min(left, part.num_rows - at)
                writer.write_table(part.slice(at, take))
                at, left = at + take, left - take
                if not left:
                    writer.close()
                    sink.close()
        return out


def rewrite(homes: DataFrame, logs: str, pieces: str, key: str, sets: list[str], size: int) -> DataFrame:
    """``PIECES`` of every touched file (``home, path``): piece -1 where nothing is left of it; none where no row differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, path in zip(batch.column("home").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with Joined(path, f"{logs}/home={home}", key, sets) as both:
                    total, changed = both.count()
                    if not changed:
                        continue
                    sizes = cut_sizes(total, size) if total else []
                    found = both.write(f"{pieces}/{home:06d}", sizes)
                lines = list(zip(range(len(found)), sizes, found, strict=True)) or [(-1, 0, None)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([home] * len(lines), pa.int32()),
                        pa.array([x[0] for x in lines], pa.int32()),
                        pa.array([x[1] for x in lines], pa.int64()),
                        pa.array([x[2] for x in lines], pa.string()),
                    ],
                    names=["home", "piece", "n_rows", "path"],
                )

    return homes.mapInArrow(run, PIECES)


# ---- small neighbours ----


def join_neighbours(homes: int, cut: dict[int, tuple[int, int, int]], size: int) -> dict[int, tuple[int, int]]:
    """Which homes' first pieces join the file at their left, as (home, piece) of the piece that it began with.

    ``cut`` has pieces, rows of the first and of the last piece of every rewritten home. Two pieces of one
    home together are always too long, so only first pieces can join and only last pieces can grow.
    """
    out: dict[int, tuple[int, int]] = {}
    left: tuple[tuple[int, int], int] | None = None
    for home in range(homes):
        if home not in cut:
            left = None  # a file that was not rewritten stands between
            continue
        n, first, last = cut[home]
        if not n:
            continue
        if left and left[1] + first <= size:
            out[home] = left[0]
            left = left[0], left[1] + first
        else:
            left = (home, 0), first
        if n > 1:
            left = (home, n - 1), last
    return out


def place(pieces: DataFrame, joins: dict[int, tuple[int, int]], path: str) -> DataFrame:
    """Move the pieces into the table, those that join as one file; returns ``path`` of every new file."""
    spark = pieces.sparkSession
    plan = spark.createDataFrame([(h, 0, *to) for h, to in joins.items()], "home int, piece int, to_home int, to_piece int")
    known = pieces.where("piece >= 0").join(F.broadcast(plan), ["home", "piece"], "left")
    to = F.struct(F.coalesce("to_home", "home").alias("home"), F.coalesce("to_piece", "piece").alias("piece")).alias("to")
    files = known.groupBy(to).agg(F.array_sort(F.collect_list(F.struct("home", "piece", "path"))).alias("parts"))
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            names = []
            for to_, parts in zip(batch.column("to").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                names.append(f"rewritten-{to_['home']:06d}-{to_['piece']:06d}-{run_id}.parquet")
                target = f"{folder}/{names[-1]}"
                if fs.get_file_info(target).is_file:
                    continue  # an earlier try of this task came so far
                own = [filesystem(p["path"])[1] for p in parts]
                if len(own) == 1:
                    fs.move(own[0], target)
                    continue
                whole = f"{own[0]}.{uuid.uuid4().hex}"
                with fs.open_input_file(own[0]) as f:
                    schema = pq.read_schema(f)
                with fs.open_output_stream(whole) as sink, pq.ParquetWriter(sink, schema) as writer:
                    for part in _sorted_batches(fs, own):
                        writer.write_table(part)
                fs.move(whole, target)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{n}" for n in names], pa.string())], names=["path"])

    return materialize(files.mapInArrow(run, "path string"), "upsert-files")


def upsert(files: list[tuple[str, int, int]], path: str, changes: DataFrame, key: str, order: list[str], sets: list[str], size: int, ignored: Column, deletes: Column, kept: list[str] = ()) -> DataFrame:
    """Apply ``changes`` to the table in ``path``; returns ``path, rewritten`` of all its files.

    ``files`` is what :func:`write_sorted` returned. ``ignored`` and ``deletes`` are conditions over a winner's columns
    (``order``, ``sets``, ``kept``) and ``home_first``; other winners set ``sets``.
    """
    spark = ship(changes.sparkSession)
    base = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    kind = "path string, rewritten boolean"
    if not files:
        return spark.createDataFrame([], kind)
    best = winners_of(changes, key, order, [*order, *sets, *kept])
    best = homes_of(best, key, [f[1] for f in files]).where(~F.coalesce(ignored, F.lit(False)))
    staged = best.select("home", key, F.coalesce(deletes, F.lit(False)).alias("_deletes"), *sets)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = staged.repartitionByRange(parts, "home", key).sortWithinPartitions("home", key)
    staged.write.partitionBy("home").parquet(f"{base}/logs")
    touched = [r["home"] for r in spark.read.schema(staged.schema).parquet(f"{base}/logs").select("home").distinct().collect()]  # at most one per file
    if not touched:
        return spark.createDataFrame([(p, False) for p, _, _ in files], kind)
    fs, folder = filesystem(f"{base}/pieces")
    fs.create_dir(folder)
    homes = spark.createDataFrame([(i, h, files[h][0]) for i, h in enumerate(sorted(touched))], "at int, home int, path string")
    homes = homes.repartitionById(len(touched), "at")  # a task per file
    pieces = materialize(rewrite(homes, f"{base}/logs", f"{base}/pieces", key, sets, size), "upsert-pieces")
    ends = pieces.groupBy("home").agg(F.count(F.when(F.col("piece") >= 0, 1)).alias("n"), F.min_by("n_rows", "piece").alias("first"), F.max_by("n_rows", "piece").alias("last"))
    cut = {r["home"]: (r["n"], r["first"], r["last"]) for r in ends.collect()}  # at most one line per file
    new = place(pieces, join_neighbours(len(files), cut, size), path)
    for home in cut:
        fs.delete_file(filesystem(files[home][0])[1])
    old = spark.createDataFrame([(f[0], False) for i, f in enumerate(files) if i not in cut], kind)
    return old.unionByName(new.select("path", F.lit(True).alias("rewritten")))


# ---- digests ----


def describe(files: DataFrame, key: str, cents: str, text: list[str]) -> DataFrame:
    """``DIGESTS`` of every file, each read from end to end by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, rewritten in zip(batch.column("path").to_pylist(), batch.column("rewritten").to_pylist(), strict=True):
                fs, own = filesystem(path)
                ids, first, n, money, crc = hashlib.sha256(), None, 0, 0, 0
                with fs.open_input_file(own) as f:
                    names = pq.read_schema(f).names
                for part in _sorted_batches(fs, [own]):
                    keys = part.column(key).to_pylist()
                    ids.update((("," if n else "") + ",".join(map(str, keys))).encode())
                    first = keys[0] if first is None else first
                    n += len(keys)
                    value = part.column(cents).to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
                    money += int(np.nansum(np.floor(100 * value + 0.5)))
                    words = zip(*[part.column(c).to_pylist() for c in text], strict=True)
                    crc += sum(zlib.crc32("|".join(x or "" for x in row).encode()) for row in words)
                out.append((first, n, money, crc, ids.hexdigest(), ",".join(names), path, rewritten))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return files.repartition("path").mapInArrow(run, DIGESTS)


def op12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clients`` as sorted files, with the winning ``client_changes`` merged in, and what is in every file then."""
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    path = f"{shared_dir(spark)}/clients-{uuid.uuid4().hex}"
    size = 1 + clients.count() // FILES
    files = write_sorted(clients.where(text_crc("client_id") % 7 > 3), path, "client_id", size)
    h = text_crc("home_first") % 10
    deletes = F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(text_crc("change_id") % 8 < h, F.lit(False))
    sets = ["source", "segment", "city", "balance"]
    found = upsert(files, path, changes, "client_id", ["seq", "change_id"], sets, size, h > 7, deletes, ["op"])
    return describe(found, "client_id", "balance", ["source", "segment", "city"])
