"""Queries of documents, corpora and report files: written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.operators import handlers, reconstruct, scoring, structure
from spanloom.operators.handlers import Scheme
from spanloom.plans.order import numbered
from spanloom.plans.traces import dealt
from spanloom.plans.tree import with_depth
from spanloom.queries import recon
from spanloom.queries.base import DEEP, START, Entry
from spanloom.session import materialize, shared_dir
from spanloom.sources import binary, corpus, jaeger, reports
from spanloom.sources.views import DIRTY_SQL, dirty_spans, heap_spans


def in_ns(spans: DataFrame) -> DataFrame:
    """Spans with times in nanoseconds."""
    times = [(F.col(f"{c}_us") * 1000).alias(f"{c}_ns") for c in ("start", "end")]
    return spans.select("trace_id", "span_id", "parent_id", "service", *times)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _loaded(require_clean: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "documents")
        jaeger.to_documents(in_ns(dirty_spans(spark, sf_dir))).write.json(path)
        return jaeger.load(spark, path, require_clean, lines=True)

    return run


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "documents")
    jaeger.to_documents(in_ns(dirty_spans(spark, sf_dir)), wrap=False).write.json(path)
    raw = jaeger.raw_spans(jaeger.traces_of(jaeger.read_documents(spark, path, lines=True)))
    flags = jaeger.violation_flags(raw).withColumn("trace_id", F.conv("trace_hex", 16, -10).cast("long"))
    return flags.select("trace_id", "spans", "roots", "dangling", "multi_parent", "duplicate", "bad_id", "multi_root", "rootless")


def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "otlp")
    jaeger.to_otlp(in_ns(heap_spans(spark, sf_dir))).write.json(path)
    return jaeger.read_otlp(spark, path)


def _corpus(name: str, *columns: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, "corpus")
        events = corpus.events_of(with_depth(in_ns(heap_spans(spark, sf_dir))))
        corpus.write(events, path, "events")
        events = corpus.read(spark, path, "events")
        if name != "events":
            corpus.write(corpus.meta_of(events), path, "meta")
            meta = corpus.read(spark, path, "meta")
            if name == "store":
                corpus.write(corpus.store_of(events, meta), path, "store")
            if name == "archive":
                corpus.write(corpus.spans_of(events).withColumn("flags", F.lit(0)), path, "archive")
        return corpus.read(spark, path, name).select(*columns)

    return run


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, path = _folder(spark, "documents"), _folder(spark, "corpus")
    jaeger.to_documents(in_ns(dirty_spans(spark, sf_dir))).write.json(documents)
    corpus.prepare(spark, documents, path, require_clean=False, lines=True)
    return corpus.integrity(corpus.read(spark, path, "archive"), corpus.read(spark, path, "meta"))


def _archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _folder(spark, "documents")
    jaeger.to_documents(in_ns(dirty_spans(spark, sf_dir))).write.json(documents)
    archive = materialize(jaeger.load(spark, documents, require_clean=False, lines=True), "archive")
    events = corpus.archive_to_events(archive, exclude_flags=1)
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("trace_id").alias("traces"), F.max("pos").alias("last"))


def _services(rows: DataFrame) -> DataFrame:
    """Services by number, in code point order."""
    names = rows.select("service").distinct()
    return numbered(names, [F.col("service")], "service_id", first=0).withColumn("service_id", F.col("service_id").cast("int"))


def _with_ids(rows: DataFrame, services: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(services), "service")


def _binary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Events in order, the services by number, and a folder for binary files."""
    spans = with_depth(in_ns(heap_spans(spark, sf_dir)))
    events = corpus.events_of(spans)
    return events, materialize(_services(spans), "services"), _folder(spark, "binary")


def _binary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, services, path = _binary(spark, sf_dir)
    rows = _with_ids(events, services).repartitionByRange("pos").sortWithinPartitions("pos")
    binary.write(rows.select(*[c.split()[0] for c in binary.SCHEMAS["events"].split(", ")]), path, "events")
    back = _with_ids(binary.read(spark, path, "events").join(F.broadcast(services), "service_id").drop("service_id"), services)
    return back.select("pos", "trace_id", "span_id", "parent_id", "service", "kind", "ts", "depth")


def _binary_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, services, path = _binary(spark, sf_dir)
    rows = dealt(_with_ids(events, services), "trace_id").sortWithinPartitions("trace_id", "pos")
    binary.write(rows.select("trace_id", "kind", "span_id", "parent_id", "service_id", "ts"), path, "store")
    back = binary.read(spark, path, "store").join(F.broadcast(services), "service_id")
    return back.select("trace_id", "span_id", "parent_id", "service", "kind", "ts", "place")


def _binary_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, services, path = _binary(spark, sf_dir)
    rows = dealt(_with_ids(corpus.spans_of(events).withColumn("flags", F.lit(0)), services), "trace_id").sortWithinPartitions("trace_id", "start_ns")
    binary.write(rows.select("trace_id", "flags", "span_id", "parent_id", "service_id", "start_ns", "end_ns"), path, "archive")
    back = binary.read(spark, path, "archive").join(F.broadcast(services), "service_id")
    return back.select("trace_id", "span_id", "parent_id", "service", "start_ns", "end_ns", "flags")


def _binary_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, services, path = _binary(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    named = services.select(F.col("service_id").cast("long").alias("place"), "service", none("long").alias("trace_id"), none("long").alias("num_spans"))
    traces = corpus.meta_of(events).select(F.col("completion").alias("place"), none("string").alias("service"), "trace_id", "num_spans")
    binary.write(named.unionByName(traces), path, "meta")
    return binary.read(spark, path, "meta").where("service is null").select("trace_id", "num_spans")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all parts, and whether the heaviest one is within four thirds of the least that any rule could reach."""
    spans = _short(spark, sf_dir)
    loads = materialize(corpus.part_loads(spans, 4), "loads")
    labelled = structure.trace_components(spans, "start_ns", "end_ns").groupBy("component").agg(F.count(F.lit(1)).alias("n"))  # a trace is a span here
    least = F.broadcast(labelled.agg(F.greatest(F.max("n"), F.ceil(F.sum("n") / 4)).alias("least")))
    return loads.crossJoin(least).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("components").alias("components"), F.sum("traces").alias("traces"), F.sum("spans").alias("spans"),
        (F.max("spans") <= F.max("least") * 4 / 3 + 1).alias("level"),
    )


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span a trace of its own and a thousandth as long, so that many lie apart in time."""
    s = heap_spans(spark, sf_dir)
    took = F.floor((F.col("end_us") - F.col("start_us")) / 1000).cast("long")
    return s.select(
        (F.col("trace_id") * 1_000_000 + F.col("span_id")).alias("trace_id"), F.lit(1).cast("long").alias("span_id"), F.lit(0).cast("long").alias("parent_id"), "service",
        (F.col("start_us") * 1000).alias("start_ns"), ((F.col("start_us") + took) * 1000).alias("end_ns"), F.lit(0).alias("flags"),
    )


def _trace_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "traces")
    names = [c.split()[0] for c in reports.TRACES.split(", ")]
    reports.write_csv(reports.trace_table(heap_spans(spark, sf_dir)).select(*names), path)
    return reports.read_csv(spark, path, reports.TRACES)


def _service_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "services")
    reports.write_csv(reports.service_table(dirty_spans(spark, sf_dir)), path)
    return reports.read_csv(spark, path, reports.SERVICES)


def _metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "metrics")
    p = handlers.payloads(heap_spans(spark, sf_dir), Scheme("pcr"))
    reports.write_csv(reports.metrics_table(handlers.trace_metrics(p)), path)
    back = reports.from_metrics_table(reports.read_csv(spark, path, reports.METRICS))
    return back.select("trace_id", "num_spans", "checkpoint_sum", "num_checkpoint_spans", "amortized_by_total", "amortized_by_checkpoint")


def _bagsize_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = handlers.trace_metrics(handlers.payloads(heap_spans(spark, sf_dir), Scheme("cgpb")))
    names = ["num_spans", "num_checkpoint_spans", "amortized_by_total", "amortized_by_checkpoint", "max_checkpoint_payload", "num_baggage_calls", "avg_baggage_call", "max_baggage_call"]
    return reports.parallel_arrays(m.select("trace_id", *names), [F.col("trace_id")], {"mode": "cgpb", "checkpoint_distance": 3})


def _score_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, b = recon.rebuilt(spark, sf_dir, "pcr", Scheme("pcr"))
    return reports.parallel_arrays(scoring.score(b, truth), [F.col("trace_id")], {"mode": "pcr", "cpd": 3, "drop_rate": 0.5, "seed": 42})


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scheme("pcr")
    truth, b = recon.rebuilt(spark, sf_dir, "pcr", s)
    path = _folder(spark, "artifacts")
    reports.write_lines(reports.artifacts(truth.where("not dropped"), b), path)
    survivors, links = reports.from_artifacts(reports.read_lines(spark, path, reports.ARTIFACT))
    survivors, links = materialize(survivors, "survivors"), materialize(links, "links")
    return scoring.violations(survivors, links).unionByName(scoring.evidence(survivors, links, s))


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors from a dump, rebuilt again."""
    s = Scheme("pcr")
    path = _folder(spark, "dump")
    recon.truth_of(spark, sf_dir, s).write.parquet(path)
    truth = spark.read.parquet(path)
    return reconstruct.links(truth.where("not dropped"), "pcr", s).groupBy("trace_id").agg(F.count(F.lit(1)).alias("orphans"), F.count("anchor_id").alias("reconnected"))


def _rebuilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt trees as documents, read back: spans, synthetic ones and how many hang together."""
    truth, b = recon.rebuilt(spark, sf_dir, "pcrb", Scheme("pcrb", fp=recon.RARE))
    tree = materialize(reports.rebuilt_spans(b, truth), "rebuilt")
    path = _folder(spark, "rebuilt")
    jaeger.to_documents(in_ns(tree)).write.json(path)
    raw = jaeger.raw_spans(jaeger.traces_of(jaeger.read_documents(spark, path, lines=True)))
    deep = with_depth(raw.select("trace_id", "span_id", "parent_id", "service"))
    return deep.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"), F.count(F.when(F.col("service") == "unknown", 1)).alias("synthetic"), F.count(F.when(F.col("rooted"), 1)).alias("rooted")
    )


def _tag_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    listed = F.array(
        F.struct(F.lit("event").alias("key"), F.col("event_type").alias("value")), F.struct(F.lit("__bag.user").alias("key"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit("event").alias("key"), F.lit("again").alias("value")),
    )
    rows = e.select("event_id", tags.tag_map(listed).alias("t"))
    put = tags.set_tag(F.col("t"), "level", F.lit("high"))
    return rows.select(
        "event_id",
        tags.get_tag(F.col("t"), "event").alias("event"),
        tags.tag_bytes(F.col("t")).alias("bytes"),
        tags.tag_bytes(tags.baggage_of(F.col("t"))).alias("baggage_bytes"),
        tags.tag_bytes(put).alias("with_level"),
        tags.has_tag(tags.without_tag(F.col("t"), "event"), "event").alias("still"),
    )


NORM = """, norm AS (SELECT trace_id, span_id, parent_id, service,
  (CASE WHEN start_us >= 1000000000000000 THEN start_us // 1000 ELSE start_us END) * 1000 AS start_ns,
  (CASE WHEN start_us >= 1000000000000000 THEN start_us // 1000 ELSE start_us END) * 1000 + (end_us - start_us) * 1000 AS end_ns FROM dirty)"""
STRICT = """, rules AS (SELECT d.trace_id, count(*) - count(DISTINCT d.span_id) AS duplicates, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS dangling,
    count(*) FILTER (d.parent_id = 0) AS roots
  FROM norm d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM norm) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.trace_id
), ok AS (SELECT d.* FROM norm d JOIN rules r ON r.trace_id = d.trace_id WHERE duplicates = 0 AND dangling = 0 AND roots > 0
), tree AS (SELECT *, span_id AS root_id FROM ok WHERE parent_id = 0
  UNION ALL SELECT s.*, t.root_id FROM ok s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id
), sizes AS (SELECT trace_id, root_id, count(*) AS n FROM tree GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, root_id) AS place FROM sizes
), kept AS (SELECT t.*, 0 AS flags FROM tree t JOIN best b ON b.trace_id = t.trace_id AND b.root_id = t.root_id WHERE place = 1)"""
LENIENT = """, once AS (SELECT *, count(*) AS copies FROM norm GROUP BY ALL
), per AS (SELECT trace_id, count(*) > count(DISTINCT span_id) AS conflict, max(copies) > 1 AS deduped FROM once GROUP BY trace_id
), ok AS (SELECT o.* EXCLUDE (copies), deduped FROM once o JOIN per p ON p.trace_id = o.trace_id WHERE NOT conflict
), tops AS (SELECT o.trace_id, o.span_id, o.parent_id = 0 AS rooted FROM ok o
  WHERE NOT EXISTS (SELECT 1 FROM ok p WHERE p.trace_id = o.trace_id AND p.span_id = o.parent_id)
), reach AS (SELECT * FROM tops UNION ALL SELECT s.trace_id, s.span_id, r.rooted FROM ok s JOIN reach r ON r.trace_id = s.trace_id AND s.parent_id = r.span_id
), looped AS (SELECT DISTINCT o.trace_id FROM ok o WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.trace_id = o.trace_id AND r.span_id = o.span_id)
), pruned AS (SELECT DISTINCT trace_id FROM reach WHERE NOT rooted
), kept AS (SELECT o.* EXCLUDE (deduped), CASE WHEN o.trace_id IN (SELECT trace_id FROM pruned) THEN 1 ELSE 0 END + CASE WHEN deduped THEN 2 ELSE 0 END AS flags
  FROM ok o JOIN reach r ON r.trace_id = o.trace_id AND r.span_id = o.span_id WHERE r.rooted AND o.trace_id NOT IN (SELECT trace_id FROM looped))"""
CLIPPED = """, clip AS (SELECT trace_id, span_id, parent_id, service, start_ns, end_ns, 0 AS depth, flags FROM kept WHERE parent_id = 0
  UNION ALL SELECT s.trace_id, s.span_id, s.parent_id, s.service, greatest(s.start_ns, c.start_ns), least(s.end_ns, c.end_ns), c.depth + 1, s.flags
  FROM kept s JOIN clip c ON s.trace_id = c.trace_id AND s.parent_id = c.span_id WHERE s.end_ns >= c.start_ns AND s.start_ns <= c.end_ns)"""
ORDER = """, e AS (SELECT trace_id, span_id, parent_id, service, 0 AS kind, start_us * 1000 AS ts, depth FROM deep UNION ALL
  SELECT trace_id, span_id, parent_id, service, 1, end_us * 1000, depth FROM deep
), events AS (SELECT *, row_number() OVER (ORDER BY ts, kind, CASE WHEN kind = 0 THEN depth ELSE -depth END, trace_id, span_id) AS pos FROM e
), meta AS (SELECT trace_id, count(*) FILTER (kind = 0) AS num_spans, count(DISTINCT service) AS num_services, min(pos) AS first_pos, max(pos) AS last_pos FROM events GROUP BY trace_id)"""


#: Largest first, each to the lightest, is never worse than four thirds of the best.
PARTS_SQL = (
    START
    + """, t AS (SELECT trace_id * 1000000 + span_id AS id, start_us * 1000 AS lo, (start_us + (end_us - start_us) // 1000) * 1000 AS hi FROM spans
), m AS (SELECT *, max(hi) OVER (ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t
), c AS (SELECT sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, id ROWS UNBOUNDED PRECEDING) AS component FROM m)
SELECT 4::BIGINT AS parts, count(DISTINCT component) AS components, count(*) AS traces, count(*) AS spans, true AS level FROM c"""
)


def entries() -> dict[str, Entry]:
    """All entries by name."""
    dirty = f"WITH RECURSIVE {DIRTY_SQL}" + NORM
    return {
        "load_strict": Entry(_loaded(True), dirty + STRICT + CLIPPED + " SELECT * FROM clip"),
        "load_lenient": Entry(_loaded(False), dirty + LENIENT + CLIPPED + " SELECT * FROM clip"),
        "violation_flags": Entry(
            _flags,
            f"WITH {DIRTY_SQL}"
            + """ SELECT d.trace_id, count(*) AS spans, count(*) FILTER (d.parent_id = 0) AS roots, bool_or(d.parent_id <> 0 AND k.span_id IS NULL) AS dangling,
  false AS multi_parent, count(*) > count(DISTINCT d.span_id) AS duplicate, false AS bad_id, count(*) FILTER (d.parent_id = 0) > 1 AS multi_root,
  count(*) FILTER (d.parent_id = 0) = 0 AS rootless
FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.trace_id""",
        ),
        "otlp_round_trip": Entry(_otlp, START + " SELECT trace_id, span_id, parent_id, service, start_us * 1000 AS start_ns, end_us * 1000 AS end_ns FROM spans"),
        "corpus_events": Entry(
            _corpus("events", "pos", "trace_id", "span_id", "kind", "ts", "depth"),
            START + DEEP + ORDER.replace("events AS", "ordered AS").replace("FROM events", "FROM ordered") + " SELECT pos, trace_id, span_id, kind, ts, depth FROM ordered",
        ),
        "corpus_meta": Entry(
            _corpus("meta", "trace_id", "num_spans", "num_services", "first_pos", "last_pos", "completion"),
            START
            + DEEP
            + ORDER.replace("events AS", "ordered AS").replace("FROM events", "FROM ordered")
            + " SELECT *, row_number() OVER (ORDER BY last_pos) AS completion FROM meta",
        ),
        "corpus_store": Entry(
            _corpus("store", "trace_id", "span_id", "kind", "completion", "place"),
            START
            + DEEP
            + ORDER.replace("events AS", "ordered AS").replace("FROM events", "FROM ordered")
            + """, done AS (SELECT trace_id, row_number() OVER (ORDER BY last_pos) AS completion FROM meta)
SELECT o.trace_id, o.span_id, o.kind, d.completion, row_number() OVER (PARTITION BY o.trace_id ORDER BY pos)::INTEGER AS place
FROM ordered o JOIN done d ON d.trace_id = o.trace_id""",
        ),
        "corpus_archive": Entry(
            _corpus("archive", "trace_id", "span_id", "parent_id", "service", "start_ns", "end_ns", "depth", "flags"),
            START + DEEP + " SELECT trace_id, span_id, parent_id, service, start_us * 1000 AS start_ns, end_us * 1000 AS end_ns, depth, 0 AS flags FROM deep",
        ),
        "corpus_integrity": Entry(
            _prepared,
            dirty
            + LENIENT
            + CLIPPED
            + """, p AS (SELECT trace_id, count(*) AS spans, count(*) FILTER (parent_id = 0) AS roots, count(*) FILTER (end_ns < start_ns) AS neg, max(flags) AS flags
  FROM clip GROUP BY trace_id)
SELECT count(*) AS traces, sum(spans)::BIGINT AS spans, max(spans) AS largest, count(*) FILTER (roots <> 1) AS not_one_root, 0::BIGINT AS with_dangling,
  sum(neg)::BIGINT AS negative_spans, count(*) FILTER (flags <> 0) AS flagged, 0::BIGINT AS mismatches FROM p""",
        ),
        "archive_events": Entry(
            _archive_events,
            dirty
            + LENIENT
            + CLIPPED
            + """, fine AS (SELECT * FROM clip WHERE flags % 2 = 0), t AS (SELECT *, span_id AS root_id FROM fine WHERE parent_id = 0
  UNION ALL SELECT s.*, t.root_id FROM fine s JOIN t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id
), z AS (SELECT trace_id, root_id, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, root_id) AS place FROM z
), k AS (SELECT t.* FROM t JOIN b ON b.trace_id = t.trace_id AND b.root_id = t.root_id WHERE place = 1
), e AS (SELECT *, 0 AS kind, start_ns AS ts FROM k UNION ALL SELECT *, 1, end_ns FROM k
), o AS (SELECT *, row_number() OVER (ORDER BY ts, kind, CASE WHEN kind = 0 THEN depth ELSE -depth END, trace_id, span_id) AS pos FROM e)
SELECT kind, count(*) AS events, count(DISTINCT trace_id) AS traces, max(pos) AS last FROM o GROUP BY kind""",
        ),
        "root_counts": Entry(
            lambda spark, sf_dir: corpus.root_counts(dirty_spans(spark, sf_dir)),
            f"WITH {DIRTY_SQL}" + ", r AS (SELECT count(*) FILTER (parent_id = 0) AS roots FROM dirty GROUP BY trace_id) SELECT roots, count(*) AS traces FROM r GROUP BY roots",
        ),
        "component_parts": Entry(_parts, PARTS_SQL),
        "binary_events": Entry(
            _binary_events,
            START + DEEP + ORDER.replace("events AS", "ordered AS").replace("FROM events", "FROM ordered") + " SELECT pos, trace_id, span_id, parent_id, service, kind, ts, depth FROM ordered",
        ),
        "binary_store": Entry(
            _binary_store,
            START
            + DEEP
            + ORDER.replace("events AS", "ordered AS").replace("FROM events", "FROM ordered")
            + " SELECT trace_id, span_id, parent_id, service, kind, ts, row_number() OVER (PARTITION BY trace_id ORDER BY pos)::INTEGER AS place FROM ordered",
        ),
        "binary_archive": Entry(
            _binary_archive,
            START + " SELECT trace_id, span_id, parent_id, service, start_us * 1000 AS start_ns, end_us * 1000 AS end_ns, 0 AS flags FROM spans",
        ),
        "binary_meta": Entry(_binary_meta, START + " SELECT trace_id, count(*) AS num_spans FROM spans GROUP BY trace_id"),
        "traces_csv": Entry(
            _trace_csv,
            START
            + DEEP
            + """, steps AS (SELECT trace_id, start_us AS t, 1 AS d FROM spans UNION ALL SELECT trace_id, greatest(start_us, end_us), -1 FROM spans
), run AS (SELECT trace_id, sum(d) OVER (PARTITION BY trace_id ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS n FROM steps
), c AS (SELECT trace_id, max(n)::BIGINT AS n FROM run GROUP BY trace_id
), f AS (SELECT trace_id, max(n) AS n FROM (SELECT trace_id, parent_id, count(*) AS n FROM spans WHERE parent_id <> 0 GROUP BY ALL) GROUP BY trace_id)
SELECT min(start_us) AS start_us, max(end_us) AS end_us, max(end_us) - min(start_us) AS trace_duration_us, count(*) AS num_spans, 0::BIGINT AS num_dangling_spans,
  any_value(c.n) AS max_concurrent_spans, max(depth)::BIGINT AS max_depth, coalesce(any_value(f.n), 0)::BIGINT AS max_fanout
FROM deep d JOIN c ON c.trace_id = d.trace_id LEFT JOIN f ON f.trace_id = d.trace_id GROUP BY d.trace_id""",
        ),
        "services_csv": Entry(
            _service_csv,
            f"WITH {DIRTY_SQL}"
            + """ SELECT d.service AS service_name, count(*) AS total_spans, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS total_dangling_spans,
  count(DISTINCT d.trace_id) AS total_traces
FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.service""",
        ),
        "metrics_csv": Entry(
            _metrics_csv,
            START
            + DEEP
            + """, k AS (SELECT d.*, x.parent_id IS NULL OR d.depth % 3 = 0 AS carrier FROM deep d
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) x ON x.trace_id = d.trace_id AND x.parent_id = d.span_id)
SELECT trace_id, count(*) AS num_spans, (9 * count(*) FILTER (carrier))::BIGINT AS checkpoint_sum, count(*) FILTER (carrier) AS num_checkpoint_spans,
  (9 * count(*) FILTER (carrier))::DOUBLE / count(*) AS amortized_by_total, 9::DOUBLE AS amortized_by_checkpoint FROM k GROUP BY trace_id""",
        ),
        "bagsize_document": Entry(_bagsize_document),
        "score_document": Entry(_score_document),
        "artifact_lines": Entry(_artifacts, recon.NO_ROWS),
        "survivor_dump": Entry(
            _dumped,
            recon.WIDE + recon.KINDS + recon.PREFIX.format(shift=1 << 32) + " SELECT trace_id, count(*) AS orphans, count(anchor_id) AS reconnected FROM links GROUP BY trace_id",
        ),
        "rebuilt_documents": Entry(
            _rebuilt_documents,
            recon.WIDE
            + recon.KINDS
            + recon.ANCHORS
            + """, lost AS (SELECT a.trace_id, d.parent_id, min(a.gap) AS gap FROM anchors a JOIN drops d ON d.trace_id = a.trace_id AND d.span_id = a.span_id GROUP BY ALL
), n AS (SELECT trace_id, sum(gap)::BIGINT AS synthetic FROM lost GROUP BY trace_id)
SELECT d.trace_id, count(*) FILTER (NOT dropped) + coalesce(any_value(synthetic), 0) AS spans, coalesce(any_value(synthetic), 0)::BIGINT AS synthetic,
  count(*) FILTER (NOT dropped) + coalesce(any_value(synthetic), 0) AS rooted
FROM drops d LEFT JOIN n ON n.trace_id = d.trace_id GROUP BY d.trace_id""",
        ),
        "tag_bytes": Entry(
            _tag_bytes,
            """SELECT event_id, event_type AS event, (5 + strlen(event_type) + 10 + strlen(user_id::VARCHAR))::INTEGER AS bytes, (4 + strlen(user_id::VARCHAR))::INTEGER AS baggage_bytes,
  (5 + strlen(event_type) + 10 + strlen(user_id::VARCHAR) + 9)::INTEGER AS with_level, false AS still FROM events""",
        ),
        "loss_report": Entry(
            lambda spark, sf_dir: reports.loss_report(dirty_spans(spark, sf_dir)),
            f"WITH {DIRTY_SQL}"
            + """, p AS (SELECT d.trace_id, count(*) AS spans, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS dangling
FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.trace_id)
SELECT *, CASE WHEN dangling / spans < 0.05 THEN 'low' WHEN dangling / spans <= 0.25 THEN 'medium' ELSE 'high' END AS severity FROM p WHERE dangling > 0""",
        ),
    }
