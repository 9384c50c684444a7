"""Windows give what whole traces give, also for a trace that would fill many tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import handlers, loss, reconstruct, windows
from spanloom.operators.handlers import Scheme
from spanloom.session import materialize
from spanloom.sources.views import chain_spans, heap_spans, wide_spans

SF = "/root/testdata/sf0.001"
rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name, cpd", [("pb", 3), ("pb", 1), ("pcr", 3), ("pcrb", 4), ("pcrb", 2), ("cgprb", 3), ("cgprb", 5), ("vanilla", 3)])
def test_payloads_equal_those_of_whole_traces(spark, name, cpd):
    spans = materialize(wide_spans(heap_spans(spark, SF)).unionByName(chain_spans(spark, SF).withColumn("trace_id", F.col("trace_id") + 1_000_000)), "spans")
    s = Scheme(name, cpd, fp=0.05)
    assert rows_of(windows.payloads(spans, s)) == rows_of(handlers.payloads(spans, s))


def test_schemes_that_reach_further_are_refused(spark):
    with pytest.raises(ValueError, match="beyond"):
        windows.payloads(heap_spans(spark, SF), Scheme("cgpb"))
    none = heap_spans(spark, SF).limit(0)
    assert windows.payloads(none, Scheme("pcrb")).count() == 0


@pytest.mark.parametrize("cpd, prefix", [(3, 1), (4, 8), (2, 4), (6, 1)])
def test_prefix_links_equal_the_engine(spark, cpd, prefix):
    s = Scheme("pcr", cpd, prefix=prefix)
    spans = wide_spans(heap_spans(spark, SF))
    p = windows.payloads(spans, s).select("trace_id", "span_id", "br")
    alive = loss.with_drops(spans, 0.7, cpd).where("not dropped and (not carrier or pmod(hash(span_id), 6) > 0 or parent_id = 0)")
    alive = materialize(alive.join(p, ["trace_id", "span_id"]), "alive")
    want = rows_of(reconstruct.links(alive, "pcr", s))
    assert rows_of(windows.prefix_links(alive, s)) == want and len(want) > 20


def test_one_large_trace(spark, monkeypatch):
    """A trace above the bound of whole-trace work: cut by windows, no batch of rows grows with it."""
    from spanloom.operators import range_join
    from spanloom.plans import traces, tree

    n = 60_000
    spans = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("trace_id"), F.col("id").alias("span_id"), F.floor(F.col("id") / 3 + F.lit(1 / 3)).cast("long").alias("parent_id"), F.lit("a").alias("service"), F.col("id").alias("start_us"), (F.col("id") + 5).alias("end_us")
    )
    spans = spans.withColumn("parent_id", F.when(F.col("span_id") == 1, 0).otherwise(F.col("parent_id")))
    s = Scheme("pb", 3, fp=1e-4)
    want = rows_of(handlers.payloads(spans, s))
    monkeypatch.setattr(tree, "GIANT", 10_000)
    monkeypatch.setattr(tree, "_giants", set())
    seen = []
    plain = traces.map_traces
    monkeypatch.setattr(windows, "map_traces", lambda df, fn, schema, key: seen.append(df.groupBy("key").count().agg(F.max("count")).first()[0]) or plain(df, fn, schema, key=key, chunk=2000))
    got = windows.payloads(spans, s)
    assert rows_of(got) == want and seen[0] < 100
    truth = materialize(loss.with_drops(spans, 0.5, 3).join(got.select("trace_id", "span_id", "br"), ["trace_id", "span_id"]), "large")
    alive = truth.where("not dropped")
    assert rows_of(range_join.links(alive, s)) == rows_of(reconstruct.links(alive, "pb", s))
