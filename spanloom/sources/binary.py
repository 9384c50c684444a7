"""Binary corpora as a data source: ``spark.read.format("trace_binary").option("part", "events").load(path)``.

A part of a corpus is a file, or a folder of files in order, each with a header of magic number and version
and little-endian records: ``events`` (records of one size in global order), ``store`` and ``archive`` (blocks
of one trace each), ``meta`` (services by number, traces with their span counts). Events are cut by
records, so every task reads its own range of bytes; the places of parts follow from the sizes of the files
before them. Blocks have no marks to start from, so the writer puts an index beside each file - the offset of
every ``STRIDE``-th block - and a task reads the blocks of one entry; a file without an index is read by one task
from its beginning. What a broken file cannot give is an error.

Writers make a file per task. Events come in order of ``pos``, blocks with the rows of a trace together.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spanloom.session import ship

# Magic numbers and versions of the files.
MAGIC = {"events": (0x42524447, 1), "meta": (0x4252444D, 1), "store": (0x54535452, 2), "archive": (0x54415243, 2)}
HEADER = 8
EVENT = np.dtype([("ts", "<i8"), ("span_id", "<i8"), ("parent_id", "<i8"), ("trace_id", "<i8"), ("depth", "<u2"), ("service_id", "<u2"), ("kind", "u1"), ("pad", "u1", 3)])
STORED = np.dtype([("kind", "u1"), ("span_id", "<i8"), ("parent_id", "<i8"), ("service_id", "<u2"), ("ts", "<i8")])
SPAN = np.dtype([("span_id", "<i8"), ("parent_id", "<i8"), ("service_id", "<u2"), ("start_ns", "<i8"), ("end_ns", "<i8")])
META = np.dtype([("trace_id", "<i8"), ("num_spans", "<u4")])
SCHEMAS = {
    "events": "pos bigint, ts bigint, span_id bigint, parent_id bigint, trace_id bigint, depth int, service_id int, kind int",
    "store": "file int, block bigint, place int, trace_id bigint, kind int, span_id bigint, parent_id bigint, service_id int, ts bigint",
    "archive": "file int, block bigint, place int, trace_id bigint, flags int, span_id bigint, parent_id bigint, service_id int, start_ns bigint, end_ns bigint",
    "meta": "place bigint, service string, trace_id bigint, num_spans bigint",
}
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
RANGE = 1 << 20
STRIDE = 1024


def filesystem(path: str) -> tuple[pfs.FileSystem, str]:
    """What reads a path in a worker: a URI's own file system, or the local one of a shared mount."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files of a part in order, with their sizes."""
    fs, own = filesystem(path)
    at = fs.get_file_info(own)
    if at.is_file:
        return [(own, at.size)]
    found = [x for x in fs.get_file_info(pfs.FileSelector(own)) if x.is_file and x.path.endswith(".bin")]
    return [(x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


@dataclass
class Piece(InputPartition):
    """Bytes ``begin`` to ``end`` of a file; ``first`` is the place of the first record or block."""

    path: str
    number: int
    begin: int
    end: int
    first: int


def batch(part: str, columns: dict) -> pa.RecordBatch:
    kinds = [c.split() for c in SCHEMAS[part].split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], ARROW[k]) for n, k in kinds], names=[n for n, _ in kinds])


class Reader(DataSourceReader):
    """Reads one part of a corpus."""

    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def partitions(self) -> list[Piece]:
        fs, _ = filesystem(self.path)
        out, before = [], 0
        for number, (path, size) in enumerate(files_of(self.path)):
            with fs.open_input_file(path) as f:
                head = f.read(HEADER)
            if len(head) < HEADER or struct.unpack("<II", head) != MAGIC[self.part]:
                raise ValueError(f"{path} is no {self.part} file of version {MAGIC[self.part][1]}")
            if self.part == "events":
                if (size - HEADER) % EVENT.itemsize:
                    raise ValueError(f"{path} ends inside a record")
                records = (size - HEADER) // EVENT.itemsize
                for at in range(0, records, RANGE):
                    upto = min(records, at + RANGE)
                    out.append(Piece(path, number, HEADER + at * EVENT.itemsize, HEADER + upto * EVENT.itemsize, before + at + 1))
                before += records
                continue
            index = f"{path}.index"
            offsets = [HEADER]
            if self.part != "meta" and fs.get_file_info(index).is_file:
                with fs.open_input_file(index) as f:
                    offsets = np.frombuffer(f.read(), dtype="<i8").tolist() or offsets
            for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], size], strict=True)):
                out.append(Piece(path, number, a, b, k * STRIDE))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.begin)
            yield from {"events": self._events, "meta": self._meta}.get(self.part, self._blocks)(f, partition)

    def _events(self, f, p: Piece) -> Iterator[pa.RecordBatch]:
        at, left = p.first, (p.end - p.begin) // EVENT.itemsize
        while left:
            rows = np.frombuffer(f.read(min(left, 65_536) * EVENT.itemsize), dtype=EVENT)
            yield batch("events", {n: rows[n].astype(np.int64) for n in EVENT.names} | {"pos": np.arange(at, at + len(rows))})
            at, left = at + len(rows), left - len(rows)

    def _blocks(self, f, p: Piece) -> Iterator[pa.RecordBatch]:
        kind, head = (STORED, 12) if self.part == "store" else (SPAN, 13)
        at, block = p.begin, p.first
        held: list[dict] = []
        rows_held = 0
        while at < p.end:
            top = f.read(head)
            if len(top) < head:
                raise ValueError(f"{p.path} ends inside a block")
            trace, n = struct.unpack("<qI", top[:12])
            body = f.read(n * kind.itemsize)
            if len(body) < n * kind.itemsize:
                raise ValueError(f"{p.path} ends inside trace {trace & (1 << 64) - 1:016x}")
            rows = np.frombuffer(body, dtype=kind)
            own = {c: rows[c].astype(np.int64) for c in kind.names}
            own |= {"file": np.full(n, p.number), "block": np.full(n, block), "place": np.arange(1, n + 1), "trace_id": np.full(n, trace)}
            if head == 13:
                own["flags"] = np.full(n, top[12])
            held.append(own)
            rows_held += n
            at, block = at + head + len(body), block + 1
            if rows_held >= 65_536 or at >= p.end:
                yield batch(self.part, {c: np.concatenate([h[c] for h in held]) for c in held[0]})
                held, rows_held = [], 0

    def _meta(self, f, p: Piece) -> Iterator[pa.RecordBatch]:
        (n,) = struct.unpack("<I", f.read(4))
        for k in range(n):
            (size,) = struct.unpack("<I", f.read(4))
            yield batch("meta", {"place": [k], "service": [f.read(size).decode()], "trace_id": [None], "num_spans": [None]})
        (n,) = struct.unpack("<Q", f.read(8))
        for at in range(0, n, 65_536):
            rows = np.frombuffer(f.read(min(65_536, n - at) * META.itemsize), dtype=META)
            yield batch("meta", {"place": np.arange(at, at + len(rows)), "service": [None] * len(rows), "trace_id": rows["trace_id"], "num_spans": rows["num_spans"].astype(np.int64)})


@dataclass
class Written(WriterCommitMessage):
    """A file of a task under its passing name, and the name that it gets."""

    held: str
    name: str


class Writer(DataSourceArrowWriter):
    """Writes one part of a corpus, a file per task; files get their names when all tasks are done."""

    def __init__(self, path: str, part: str):
        self.path, self.part = path, part

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.bin"
        held = f"{folder}/_{uuid.uuid4().hex}"
        fs.create_dir(folder)
        offsets: list[int] = []
        with fs.open_output_stream(held) as f:
            f.write(struct.pack("<II", *MAGIC[self.part]))
            if self.part == "events":
                for rows in iterator:
                    out = np.zeros(rows.num_rows, dtype=EVENT)
                    for c in EVENT.names[:-1]:
                        out[c] = rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    f.write(out.tobytes())
            elif self.part == "meta":
                self._meta(f, list(iterator))
            else:
                self._blocks(f, iterator, offsets)
        if self.part in ("store", "archive"):
            with fs.open_output_stream(f"{held}.index") as f:
                f.write(np.array(offsets, dtype="<i8").tobytes())
        return Written(held, name)

    def _blocks(self, f, iterator: Iterator[pa.RecordBatch], offsets: list[int]) -> None:
        kind = STORED if self.part == "store" else SPAN
        at, blocks = HEADER, 0
        held: pa.Table | None = None

        def put(rows: pa.Table) -> None:
            nonlocal at, blocks
            if blocks % STRIDE == 0:
                offsets.append(at)
            out = np.zeros(rows.num_rows, dtype=kind)
            for c in kind.names:
                out[c] = rows.column(c).to_numpy()
            top = struct.pack("<qI", rows.column("trace_id")[0].as_py(), rows.num_rows)
            if kind is SPAN:
                top += struct.pack("<B", rows.column("flags")[0].as_py())
            f.write(top + out.tobytes())
            at, blocks = at + len(top) + out.nbytes, blocks + 1

        for rows in iterator:
            if not rows.num_rows:
                continue
            table = pa.Table.from_batches([rows])
            table = table if held is None else pa.concat_tables([held, table])
            keys = table.column("trace_id").to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                put(table.slice(a, b - a))
            held = table.slice(edges[-1])  # the last trace may go on
        if held is not None:
            put(held)

    @staticmethod
    def _meta(f, batches: list[pa.RecordBatch]) -> None:
        services, traces = [], [np.zeros((3, 0), dtype=np.int64)]
        for rows in batches:
            named = pc.is_valid(rows.column("service"))
            own = rows.filter(named)
            services += zip(own.column("place").to_pylist(), own.column("service").to_pylist(), strict=True)
            own = rows.filter(pc.invert(named))
            traces.append(np.stack([own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "trace_id", "num_spans")]))
        place, trace, n = np.concatenate(traces, axis=1)
        order = np.lexsort((n, trace, place))
        out = np.zeros(len(order), dtype=META)
        out["trace_id"], out["num_spans"] = trace[order], n[order]
        f.write(struct.pack("<I", len(services)))
        for _, s in sorted(services):
            f.write(struct.pack("<I", len(s.encode())) + s.encode())
        f.write(struct.pack("<Q", len(out)))
        f.write(out.tobytes())

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.held, m.name)
                if self.part in ("store", "archive"):
                    fs.move(f"{m.held}.index", f"{m.name}.index")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.held)


class TraceBinary(DataSource):
    """``trace_binary``: option ``part`` is events, store, archive or meta."""

    @classmethod
    def name(cls) -> str:
        return "trace_binary"

    def _part(self) -> str:
        part = self.options.get("part", "events")
        if part not in SCHEMAS:
            raise ValueError(f"unknown part {part}")
        return part

    def schema(self) -> str:
        return SCHEMAS[self._part()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._part())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self._part())


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known to it."""
    ship(spark).dataSource.register(TraceBinary)
    return spark


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return registered(spark).read.format("trace_binary").option("part", part).load(path)


def write(df: DataFrame, path: str, part: str) -> None:
    """Rows as they lie: order them first. ``meta`` is a file that is wanted whole, so one task writes it."""
    registered(df.sparkSession)
    rows = df.coalesce(1) if part == "meta" else df
    rows.write.format("trace_binary").mode("append").option("part", part).save(path)
