"""The range join gives what the engine gives that holds whole traces, at rates where filters lie often."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import handlers, loss, range_join, reconstruct
from spanloom.operators.handlers import Scheme
from spanloom.session import materialize
from spanloom.sources.views import heap_spans, wide_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("cpd, fp, rate", [(3, 0.1, 0.5), (5, 0.1, 0.8), (4, 0.3, 1.0), (2, 0.5, 0.7), (7, 1e-4, 0.6), (1, 0.1, 0.5)])
def test_equals_the_engine(spark, cpd, fp, rate):
    s = Scheme("pb", cpd, fp=fp)
    spans = wide_spans(heap_spans(spark, SF))
    spans = spans.withColumns({"span_id": F.expr("-span_id"), "parent_id": F.expr("-parent_id")}) if cpd == 4 else spans  # negative ids too
    p = handlers.payloads(spans, s).select("trace_id", "span_id", "br")
    # carriers get lost too here, so that orphans have to borrow
    alive = loss.with_drops(spans, rate, cpd).where("not dropped and (not carrier or pmod(hash(span_id), 5) > 0 or parent_id = 0)")
    alive = materialize(alive.join(p, ["trace_id", "span_id"]), "alive")
    want = sorted(map(tuple, reconstruct.links(alive, "pb", s).collect()), key=repr)
    got = sorted(map(tuple, range_join.links(alive, s).collect()), key=repr)
    assert got == want, (len(want), [(g, w) for g, w in zip(got, want) if g != w][:3])
    assert len(want) > 30 or cpd == 1
    if cpd > 2 and fp >= 0.1:
        assert any(x[4] for x in want) and (cpd < 5 or any(x[5] for x in want))  # ambiguous anchors and borrowed filters occur
    if cpd == 5:
        loose = sorted(map(tuple, reconstruct.links(alive, "pb", s, chain_check=False).collect()), key=repr)
        assert loose != want  # the check of the ids above decides something


def test_empty(spark):
    none = spark.createDataFrame([], "trace_id long, span_id long, parent_id long, depth int, br binary")
    assert range_join.links(none, Scheme("pb")).count() == 0


def test_every_rule_decides_something():
    """The SQL counterparts without one of their rules give other rows, so an engine without it would be red."""
    from spanloom.queries import collisions as c
    from tests.oracle import duck, sql_rows

    db = duck("/root/testdata/sf0.01")
    rows = lambda sql: set(sql_rows(db, sql)[1])
    pb, pb2, pb1, pb0 = rows(c.pb_sql()), rows(c.windows_sql(True, False)), rows(c.windows_sql(False, False)), rows(c.windows_sql(False, True))
    assert pb2 != pb1 and pb1 != pb0 and pb2 != pb0
    alone = c.pb_sql().replace("list_has_all(b.bits, n.need)", "list_has_all(b.bits, (SELECT places FROM places z WHERE z.id = n.span_id))")
    assert alone != c.pb_sql() and rows(alone) != pb  # the ids above a candidate
    two = c.windows_sql(True, False).replace("bool_and(s.under OR f.at <= s.depth - 1 OR list_has_all(f.bits, s.up_places))", "true")
    assert two != c.windows_sql(True, False) and rows(two) != pb2  # the second hit
    free = c.threaded_sql().replace("WHERE l.depth < coalesce(s.stop, 1 << 30)", "")
    assert free != c.threaded_sql() and rows(free) != rows(c.threaded_sql())  # the stop at several candidates
