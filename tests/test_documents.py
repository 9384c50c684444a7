"""Documents by the rules of strict and lenient loading, and what else is read and written."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import tags
from spanloom.operators import generate, studies
from spanloom.sources import corpus, jaeger, reports


def doc(*spans, trace="1a", wrap=True):
    """Spans as (id, parents...) at one time; a dict changes a span's fields."""
    out = []
    for span in spans:
        fields = span[-1] if isinstance(span[-1], dict) else {}
        ids = [x for x in span if not isinstance(x, dict)]
        refs = [{"refType": "CHILD_OF", "spanID": p} for p in ids[1:]]
        out.append({"spanID": ids[0], "references": refs, "startTime": 1000, "duration": 50, "processID": "p1"} | fields)
    body = {"traceID": trace, "spans": out, "processes": {"p1": {"serviceName": "svc"}}}
    return {"data": [body]} if wrap else body


def load(spark, tmp_path, *docs, **options):
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
    return {format(r.span_id, "x"): r for r in jaeger.load(spark, str(tmp_path), **options).collect()}


STRICT = [
    ([("a1",), ("a2", "a1"), ("a3", "a1")], {"a1", "a2", "a3"}),
    ([("a1",), ("a2", "a1"), ("a3", "dead")], set()),
    ([("a1",), ("a2", "a1"), ("b1",), ("b2", "b1"), ("b3", "b2")], {"b1", "b2", "b3"}),
    ([("a1",), ("a2", "a1"), ("b1",), ("c1", "dead")], set()),
    ([("b1",), ("b2", "b1"), ("a1",), ("a2", "a1")], {"a1", "a2"}),
    ([("a1",), ("a2", "a1"), ("a2", "a1")], set()),
    ([("a1",), ("a2", "a1"), ("a3", "a1", "a2")], set()),
    ([("a1",), ("b1",), ("b2", "b1"), ("b3", "b1", "b2")], set()),
    ([("a1",), ("a2", "a1", "c1"), ("c1",), ("c2", "c1"), ("c3", "c1")], {"c1", "c2", "c3"}),
    ([("a1",), ("a2", "a1", "a1")], {"a1", "a2"}),
    ([("a1",), ("zz", "a1")], set()),
    ([("a1",), ("", "a1")], set()),
    ([("a1", "a2"), ("a2", "a1")], set()),
]


@pytest.mark.parametrize("spans, want", STRICT)
def test_strict(spark, tmp_path, spans, want):
    assert set(load(spark, tmp_path, doc(*spans))) == want


LENIENT = [
    ([("a1",), ("a2", "a1"), ("b1",)], {"a1", "a2", "b1"}, 0),
    ([("a1",), ("a2", "a1"), ("e1", "dead"), ("e2", "e1")], {"a1", "a2"}, 1),
    ([("a1",), ("b1", "b2"), ("b2", "b1")], set(), None),
    ([("a1",), ("a2", "a1"), ("a2", "a1")], {"a1", "a2"}, 2),
    ([("a1",), ("a2", "a1"), ("a2", "a1", {"duration": 7})], set(), None),
    ([("a1",), ("a2", "a1"), ("a2", "a1"), ("e1", "dead")], {"a1", "a2"}, 3),
]


@pytest.mark.parametrize("spans, want, flags", LENIENT)
def test_lenient(spark, tmp_path, spans, want, flags):
    got = load(spark, tmp_path, doc(*spans), require_clean=False)
    assert set(got) == want and {r.flags for r in got.values()} == ({flags} if want else set())


def test_lenient_names_a_bad_id(spark, tmp_path):
    with pytest.raises(Exception, match="bad id in trace 1a"):
        load(spark, tmp_path, doc(("a1",), ("zz", "a1")), require_clean=False)


def test_shapes_times_and_services(spark, tmp_path):
    late = {"startTime": 1_700_000_000_123_456, "duration": 10}
    bare = doc(("c1", late), ("c2", "c1", {"processID": "none"} | late), trace="2b", wrap=False)
    got = load(spark, tmp_path, doc(("a1", {"duration": 500}), ("a2", "a1")), bare, "{broken", {"data": []})
    assert set(got) == {"a1", "a2", "c1", "c2"}
    assert (got["a2"].start_ns, got["a2"].end_ns, got["a2"].depth, got["a2"].service) == (1_000_000, 1_050_000, 1, "svc")
    assert got["c1"].start_ns == 1_700_000_000_123 * 1000 and got["c2"].service == jaeger.NO_SERVICE
    docs = jaeger.read_documents(spark, str(tmp_path))
    assert [r.source.rsplit("/", 1)[1] for r in jaeger.bad_documents(docs).collect()] == ["2.json"]
    first = jaeger.load(spark, str(tmp_path), first=1).select("trace_id").distinct().collect()
    assert [r.trace_id for r in first] == [0x1A]
    rest = jaeger.load(spark, str(tmp_path), offset=1).select("trace_id").distinct().collect()
    assert [r.trace_id for r in rest] == [0x2B]
    assert jaeger.load(spark, str(tmp_path), sample=9).count() == 4


def test_explicit_parents_and_camel_case(spark, tmp_path):
    spans = [{"spanId": "a1", "startTime": 5, "duration": 1}, {"spanId": "a2", "parentSpanId": "a1", "name": "x", "startTime": 5, "duration": 1, "tags": [{"key": "service.name", "value": "own"}]}]
    (tmp_path / "x.json").write_text(json.dumps({"traceId": "9", "spans": spans}))
    raw = jaeger.raw_spans(jaeger.traces_of(jaeger.read_documents(spark, str(tmp_path), camel=True)), explicit_parent=True)
    rows = {r.span_hex: (r.parent_hex, r.service, r.operation) for r in raw.collect()}
    assert rows == {"a1": ("", jaeger.NO_SERVICE, ""), "a2": ("a1", "own", "x")}


def test_violation_flags(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(doc(("a1",), ("b1",), ("a2", "a1", "b1"), ("a2", "dead"), ("zz", "a1"))))
    r = jaeger.violation_flags(jaeger.raw_spans(jaeger.traces_of(jaeger.read_documents(spark, str(tmp_path))))).first()
    assert (r.roots, r.dangling, r.multi_parent, r.duplicate, r.bad_id, r.multi_root, r.rootless) == (2, True, True, True, True, True, False)


def test_corpus_round_trip(spark, tmp_path):
    t = generate.complete_trees(spark, [(3, 2), (2, 3)])
    docs = str(tmp_path / "docs")
    jaeger.to_documents(t.select("trace_id", "span_id", "parent_id", "service", (F.col("start_us") * 1000).alias("start_ns"), (F.col("end_us") * 1000).alias("end_ns"))).write.json(docs)
    path = str(tmp_path / "corpus")
    corpus.prepare(spark, docs, path, lines=True)
    archive, meta, store = (corpus.read(spark, path, n) for n in ("archive", "meta", "store"))
    assert archive.count() == t.count() and corpus.integrity(archive, meta).first().mismatches == 0
    back = corpus.spans_of(corpus.read(spark, path, "events"))
    assert back.select("span_id", "start_ns", "end_ns", "depth").exceptAll(archive.select("span_id", "start_ns", "end_ns", "depth")).count() == 0
    assert store.groupBy("trace_id").agg(F.max("place").alias("n")).join(meta, "trace_id").where("n <> 2 * num_spans").count() == 0
    parts = str(tmp_path / "parts")
    corpus.write_parts(archive, parts, 2)
    assert spark.read.parquet(parts).count() == archive.count()
    with pytest.raises(ValueError):
        corpus.read(spark, path, "other")


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5, "x"), (1, None, "y")], "k int, v double, s string")
    text = reports.parallel_arrays(rows, [F.col("k")], {"mode": "m"}).first().document
    assert json.loads(text) == {"mode": "m", "k": [1, 2], "v": [None, 0.5], "s": ["y", "x"]}
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("k,v\n# a remark\n1,2\n")
    assert [tuple(r) for r in reports.read_csv(spark, path, "k bigint, v bigint").collect()] == [(1, 2)]


def test_tags(spark):
    rows = spark.createDataFrame([([("a", "é"), ("__bag.x", "12"), ("a", "later")],), ([],), (None,)], "t array<struct<key:string,value:string>>")
    m = tags.tag_map(F.col("t"))
    got = rows.select(tags.get_tag(m, "a").alias("a"), tags.tag_bytes(m).alias("n"), tags.tag_bytes(tags.baggage_of(m)).alias("b"), tags.has_tag(tags.set_tag(m, "z", F.lit(1)), "z").alias("z")).collect()
    assert [(r.a, r.n, r.b) for r in got] == [("é", 12, 3), (None, 0, 0), (None, 0, 0)] and got[0].z
    assert tags.filter_text_bytes(1) == 36 and tags.filter_text_bytes(0) == 0


def test_generated_traces(spark):
    for shape in generate.SHAPES:
        c = generate.Shape(shape, depth=6, fanout=3, fanout_law="poisson" if shape in ("branch", "spine") else "fixed", max_spans=200, concurrency=0.3, spindle=4)
        t = generate.traces(spark, 6, c)
        rows = t.collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, t.repartition(3).collect()))
        span = {(r.trace_id, r.span_id): r for r in rows}
        assert len(span) == len(rows) and max(r.depth for r in rows) <= (7 if shape in ("spine", "deepwide") else 6)
        for r in rows:
            up = span.get((r.trace_id, r.parent_id))
            assert (up is None) == (r.parent_id == 0)
            if up:
                assert up.depth + 1 == r.depth and up.start_us < r.start_us and r.end_us < up.end_us + 1000
    with pytest.raises(ValueError):
        generate.draw_tree(generate.Shape("knot"), __import__("numpy").random.default_rng(1))


def test_complete_tree_sizes_by_hand(spark):
    """Every span a checkpoint: one filter of one member (36 characters) per span but the root, 6 per mode tag."""
    t = generate.complete_trees(spark, [(2, 2)])
    r = studies.ancestry_sizes(t, 1, id_chars=5).first()
    assert (r.total_nodes, r.bloom_size, r.mode_size, r.hash_size) == (7, 216, 42, 3 * 7)
    closed = {(x.depth, x.width): x for x in generate.closed_sizes(spark, range(2, 4), range(1, 3), 1, entry=7).collect()}
    assert (closed[2, 2].bloom_size, closed[2, 2].mode_size, closed[2, 1].total_ancestry_size) == (216, 42, 90)


def test_multi_parents_meet(spark):
    """4 has parents 2 and 3, both under 1: a diamond; 5 names a parent that is missing."""
    spans = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 1, "a"), (1, 3, 1, "b"), (1, 4, 2, "c"), (1, 5, 4, "a")], "trace_id long, span_id long, parent_id long, service string")
    refs = spark.createDataFrame([(1, 2, 0, 1), (1, 3, 0, 1), (1, 4, 0, 2), (1, 4, 1, 3), (1, 5, 0, 4), (1, 5, 1, 99)], "trace_id long, span_id long, place int, parent_id long")
    got = {r.span_id: r for r in studies.multi_parents(refs, spans).collect()}
    assert (got[4].lca_id, got[4].dist_a, got[4].dist_b, got[4].below, got[4].parent_services, got[4].parents) == (1, 1, 1, 1, "a|b", "all")
    assert (got[5].lca_id, got[5].parents, got[5].children) == (None, "some", 0)
    assert studies.multi_parent_summary(studies.multi_parents(refs, spans)).first().diamonds == 1
    two = spans.unionByName(spark.createDataFrame([(1, 9, 0, "z")], spans.schema))
    r = studies.multi_roots(two, refs).first()
    assert (r.roots, r.parts, r.largest, r.apart) == (2, 2, 5, True)


def test_fine_times_are_rounded_down_in_whole_numbers(spark):
    """Above 2^53 a division in doubles is off by one now and then."""
    micros = [1_704_546_846_418_000, 1_704_154_120_618_000, 1_704_546_846_417_999, 1_704_546_846_418_001, 10**15, 5, 0]
    nanos = [m * 1000 for m in micros] + [m * 1000 + 999 for m in micros] + [-1, -1000, -1001]
    df = spark.createDataFrame([(n,) for n in nanos], "n long")
    assert [r[0] for r in df.select(jaeger.micros_of(F.col("n"))).collect()] == [n // 1000 for n in nanos]
    starts = [*range(1_704_546_846_417_990_000, 1_704_546_846_418_010_000, 977), *range(10**15, 10**15 + 5000, 7)]
    got = spark.createDataFrame([(n,) for n in starts], "n long").select(jaeger.start_ns(F.col("n"))).collect()
    assert [r[0] for r in got] == [n // 1000 * 1000 for n in starts]
    spans = spark.createDataFrame([(1, i + 1, min(i, 1), "a", m * 1000, m * 1000 + 418_000) for i, m in enumerate(micros)], "trace_id long, span_id long, parent_id long, service string, start_ns long, end_ns long")
    written = spark.createDataFrame(jaeger.to_documents(spans).select(F.explode("data.spans").alias("s")).select(F.explode("s").alias("s")).select("s.startTime", "s.duration").collect())
    assert sorted(map(tuple, written.collect())) == sorted((m, 418) for m in micros)


def test_every_part_has_a_load(spark):
    """Parts that no component falls to are there with nothing in them."""
    spans = spark.createDataFrame([(t, 1, 0, "a", 0, 10) for t in range(5)], "trace_id long, span_id long, parent_id long, service string, start_ns long, end_ns long")
    got = sorted((r.part, r.components, r.traces, r.spans, r.over) for r in corpus.part_loads(spans, 4).collect())
    assert got == [(0, 1, 5, 5, 3.0), (1, 0, 0, 0, -1.0), (2, 0, 0, 0, -1.0), (3, 0, 0, 0, -1.0)]
