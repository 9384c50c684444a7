"""Traces from and to JSON documents: one trace, or a wrapper ``{"data": [traces]}``; and OTLP documents.

Ids are up to sixteen hex digits whose bits are kept in signed numbers; 0 means "no parent". Times
are nanoseconds. A start of 10^15 or more counts as nanoseconds already and loses what is finer than
a microsecond on the way, as the format's readers do; durations are always microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.functions import hashing, tags
from spanloom.operators import cleaning, structure
from spanloom.plans.tree import with_depth
from spanloom.session import materialize

SPAN = (
    "spanID: string, parentSpanID: string, operationName: string, name: string, operation_name: string, "
    "references: array<struct<refType: string, traceID: string, spanID: string>>, startTime: bigint, duration: bigint, processID: string, "
    "tags: array<struct<key: string, value: string>>"
)
TRACE = f"traceID: string, spans: array<struct<{SPAN}>>, processes: map<string, struct<serviceName: string>>"
DOCUMENT = f"data array<struct<{TRACE}>>, traceID string, spans array<struct<{SPAN}>>, processes map<string, struct<serviceName: string>>, _corrupt_record string"
OTLP_SPAN = "traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string"
OTLP = (
    "resourceSpans array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>, "
    f"scopeSpans: array<struct<scope: struct<name: string>, spans: array<struct<{OTLP_SPAN}>>>>>>"
)
NO_SERVICE = "missing_service"
FINE = 10**15


def read_documents(spark: SparkSession, path: str, lines: bool = False, camel: bool = False) -> DataFrame:
    """All documents under a path with their file (``source``); ``lines``: one document a line.

    ``camel``: ids are spelled ``spanId`` and the like. A document that is no JSON is kept as such in
    ``_corrupt_record`` (see :func:`bad_documents`).
    """
    spelled = DOCUMENT.replace("ID:", "Id:").replace("traceID ", "traceId ") if camel else DOCUMENT
    reader = spark.read.schema(spelled).option("multiLine", not lines).option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
    docs = reader.option("pathGlobFilter", "*.json").json(path)
    named = StructType.fromDDL(DOCUMENT)
    # a cast of structs goes by place, so it spells the ids one way
    own = [F.col(have).cast(want.dataType).alias(want.name) for have, want in zip(docs.columns, named, strict=True)]
    return docs.select(*own, F.col("_metadata.file_path").alias("source"))


def bad_documents(docs: DataFrame) -> DataFrame:
    """Files with documents that could not be read, and how many of these at least name a trace."""
    return docs.where("_corrupt_record is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("traceID").alias("named"))


def traces_of(docs: DataFrame) -> DataFrame:
    """``source, trace_hex, spans, processes``: one row per trace that has spans."""
    bare = F.array(F.struct("traceID", "spans", "processes"))
    each = docs.where("_corrupt_record is null").select("source", F.posexplode(F.when(F.size("data") > 0, F.col("data")).otherwise(bare)).alias("pos", "t"))
    return each.select("source", "pos", F.col("t.traceID").alias("trace_hex"), F.col("t.spans").alias("spans"), F.col("t.processes").alias("processes")).where("size(spans) > 0")


def child_of(references: Column) -> Column:
    """The distinct parents that references name, in order."""
    named = F.filter(references, lambda r: (r["refType"] == "CHILD_OF") & (F.coalesce(r["spanID"], F.lit("")) != ""))
    return F.coalesce(F.array_distinct(F.transform(named, lambda r: r["spanID"])), F.array().cast("array<string>"))


def micros_of(nanos: Column) -> Column:
    """Whole microseconds of nanoseconds, rounded down, in whole numbers: a double is exact up to 2^53 only."""
    return F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))


def start_ns(start: Column) -> Column:
    """A start time in nanoseconds."""
    micros = F.when(start >= FINE, micros_of(start)).otherwise(start)
    return micros.cast("long") * 1000


def service_of(processes: Column, process: Column, own: Column) -> Column:
    """The process's service name, else the span's own tag, else a stand-in."""
    return F.coalesce(F.nullif(F.try_element_at(processes, process)["serviceName"], F.lit("")), F.nullif(tags.get_tag(own, "service.name"), F.lit("")), F.lit(NO_SERVICE))


def raw_spans(traces: DataFrame, explicit_parent: bool = False) -> DataFrame:
    """One row per span as it stands, with its trace's name and the rules it breaks by itself.

    ``explicit_parent``: a parent field wins over references.
    """
    s = traces.select("source", "trace_hex", "processes", F.posexplode("spans").alias("place", "s"))
    refs = child_of(F.col("s.references"))
    named = F.nullif(F.col("s.parentSpanID"), F.lit(""))
    first = F.try_element_at(refs, F.lit(1))
    parent = F.coalesce(named, first) if explicit_parent else first
    own = tags.tag_map(F.coalesce(F.col("s.tags"), F.array().cast("array<struct<key:string,value:string>>")))
    begin = start_ns(F.coalesce(F.col("s.startTime"), F.lit(0)))
    rows = s.select(
        "source",
        "trace_hex",
        "place",
        F.coalesce(F.col("s.spanID"), F.lit("")).alias("span_hex"),
        F.coalesce(parent, F.lit("")).alias("parent_hex"),
        F.size(refs).alias("refs"),
        service_of(F.col("processes"), F.col("s.processID"), own).alias("service"),
        begin.alias("start_ns"),
        (begin + F.coalesce(F.col("s.duration"), F.lit(0)) * 1000).alias("end_ns"),
        tags.display_name(F.col("s.operationName"), F.col("s.name"), F.col("s.operation_name")).alias("operation"),
        own.alias("tags"),
    )
    ids = {"trace_id": hashing.id_of_hex(F.col("trace_hex")), "span_id": hashing.id_of_hex(F.col("span_hex"))}
    ids["parent_id"] = F.when(F.col("parent_hex") == "", F.lit(0).cast("long")).otherwise(hashing.id_of_hex(F.col("parent_hex")))
    bad = F.col("trace_id").isNull() | F.col("span_id").isNull() | F.col("parent_id").isNull()
    return rows.withColumns(ids).withColumn("bad_id", bad)


KEPT = ["trace_id", "span_id", "parent_id", "service", "start_ns", "end_ns"]


def _finish(spans: DataFrame, carried: list[str]) -> DataFrame:
    """Clipped to the parents' bounds, with depths."""
    clipped = structure.clip(spans, "start_ns", "end_ns", sized=True)
    return with_depth(clipped, sized=True).select(*KEPT, "depth", *carried)


def strict(raw: DataFrame) -> DataFrame:
    """Spans of the traces that keep every rule; of several trees the largest, if its spans keep them."""
    fine = raw.groupBy("trace_hex").agg(F.max("bad_id").alias("bad")).where("not bad").select("trace_hex")
    rows = raw.join(fine, "trace_hex", "left_semi").select(*KEPT, "refs")
    kept = cleaning.salvage(rows)
    many = kept.where("refs > 1").select("trace_id").distinct()
    return _finish(kept.join(many, "trace_id", "left_anti").select(*KEPT).withColumn("flags", F.lit(0)), ["flags"])


def lenient(raw: DataFrame) -> DataFrame:
    """Spans of all traces that can be repaired, with the flags of what was done; ids that are none are an error."""
    checked = raw.withColumn("span_id", F.when(F.col("bad_id"), F.raise_error(F.concat(F.lit("bad id in trace "), F.coalesce("trace_hex", F.lit("?"))))).otherwise(F.col("span_id")))
    return _finish(cleaning.lenient(checked.select(*KEPT)), ["flags"])


def load(
    spark: SparkSession, path: str, require_clean: bool = True, lines: bool = False, first: int | None = None, offset: int = 0, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """The spans of all documents under a path.

    ``offset`` and ``first``: of the traces by file and place, leave out some and take so many;
    ``sample``: of so many files, drawn by a seeded hash of their name.
    """
    docs = read_documents(spark, path, lines)
    if sample is not None:
        drawn = docs.groupBy("source").agg(F.max("traceID").alias("t")).orderBy(F.xxhash64(F.lit(seed), "source"), "source").limit(sample)
        docs = docs.join(F.broadcast(drawn.select("source")), "source", "left_semi")
    traces = traces_of(docs)
    if first is not None or offset:
        traces = traces.orderBy("source", "pos").offset(offset)
        traces = traces if first is None else traces.limit(first)
    raw = materialize(raw_spans(traces), "raw-spans")
    return strict(raw) if require_clean else lenient(raw)


def violation_flags(raw: DataFrame) -> DataFrame:
    """Per trace, each rule on its own: more than one root, dangling parents, several parents, no root, repeated ids."""
    ids = raw.select("trace_hex", F.col("span_hex").alias("parent_hex"), F.lit(True).alias("there")).distinct()
    rows = raw.join(ids, ["trace_hex", "parent_hex"], "left")
    dangling = (F.col("parent_hex") != "") & F.col("there").isNull()
    per = rows.groupBy("trace_hex").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count(F.when(F.col("parent_hex") == "", 1)).alias("roots"),
        F.max(dangling).alias("dangling"),
        F.max(F.col("refs") > 1).alias("multi_parent"),
        (F.count(F.lit(1)) > F.countDistinct("span_hex")).alias("duplicate"),
        F.max(F.col("bad_id")).alias("bad_id"),
    )
    return per.withColumns({"multi_root": F.col("roots") > 1, "rootless": F.col("roots") == 0})


# ---- writing ----


def to_documents(spans: DataFrame, wrap: bool = True) -> DataFrame:
    """One document per trace (a row holds it whole): spans in order of start, processes by service name."""
    hexed = lambda c: hashing.id_hex(F.col(c))
    refs = F.when(
        F.col("parent_id") != 0,
        F.array(F.struct(F.lit("CHILD_OF").alias("refType"), hexed("trace_id").alias("traceID"), hexed("parent_id").alias("spanID"))),
    ).otherwise(F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>"))
    begin = micros_of(F.col("start_ns"))
    span = F.struct(
        hexed("span_id").alias("spanID"),
        F.col("service").alias("operationName"),
        refs.alias("references"),
        begin.alias("startTime"),
        micros_of(F.col("end_ns") - F.col("start_ns")).alias("duration"),
        F.concat(F.lit("p"), F.lower(F.hex(F.xxhash64("service")))).alias("processID"),
    )
    keyed = spans.select("trace_id", F.struct("start_ns", "span_id", span.alias("s")).alias("k"), "service")
    grouped = keyed.groupBy("trace_id").agg(F.array_sort(F.collect_list("k")).alias("k"), F.collect_set("service").alias("services"))
    processes = F.map_from_entries(F.transform(F.array_sort("services"), lambda n: F.struct(F.concat(F.lit("p"), F.lower(F.hex(F.xxhash64(n)))), F.struct(n.alias("serviceName")))))
    trace = F.struct(hexed("trace_id").alias("traceID"), F.col("k.s").alias("spans"), processes.alias("processes"))
    return grouped.select(F.array(trace).alias("data")) if wrap else grouped.select(trace.alias("t")).select("t.*")


def to_otlp(spans: DataFrame) -> DataFrame:
    """One OTLP document per trace: its spans by service."""
    hexed = lambda c: hashing.id_hex(F.col(c))
    span = F.struct(
        F.lpad(hexed("trace_id"), 32, "0").alias("traceId"),
        hexed("span_id").alias("spanId"),
        F.when(F.col("parent_id") != 0, hexed("parent_id")).otherwise(F.lit("")).alias("parentSpanId"),
        F.col("service").alias("name"),
        F.lit(2).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"),
    )
    keyed = spans.select("trace_id", "service", F.struct("start_ns", "span_id", span.alias("s")).alias("k"))
    by_service = keyed.groupBy("trace_id", "service").agg(F.array_sort(F.collect_list("k")).alias("k"))
    attribute = F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))
    part = F.struct(
        F.struct(F.array(attribute).alias("attributes")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("spanloom").alias("name")).alias("scope"), F.col("k.s").alias("spans"))).alias("scopeSpans"),
    )
    return by_service.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("service", part.alias("p")))).alias("p")).select(F.col("p.p").alias("resourceSpans"))


def read_otlp(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Spans of OTLP documents; of a 32-digit trace id the last 16 count."""
    docs = spark.read.schema(StructType.fromDDL(OTLP)).option("multiLine", not lines).json(path)
    parts = docs.select(F.explode("resourceSpans").alias("r"))
    named = F.filter("r.resource.attributes", lambda a: a["key"] == "service.name")
    service = F.coalesce(F.nullif(F.try_element_at(named, F.lit(1))["value"]["stringValue"], F.lit("")), F.lit(NO_SERVICE))
    spans = parts.select(service.alias("service"), F.explode("r.scopeSpans").alias("c")).select("service", F.explode("c.spans").alias("s"))
    parent = F.coalesce(F.nullif(F.col("s.parentSpanId"), F.lit("")), F.lit("0"))
    return spans.select(
        hashing.id_of_hex(F.right(F.col("s.traceId"), F.lit(16))).alias("trace_id"),
        hashing.id_of_hex(F.col("s.spanId")).alias("span_id"),
        hashing.id_of_hex(parent).alias("parent_id"),
        "service",
        F.col("s.startTimeUnixNano").cast("long").alias("start_ns"),
        F.col("s.endTimeUnixNano").cast("long").alias("end_ns"),
    )
