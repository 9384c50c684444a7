"""Paths of more spans than a fixed number of doubling rounds reaches."""

from spanloom.operators import cleaning, loss, structure
from spanloom.plans.tree import fold_up, with_depth
from tests.test_cleaning import SCHEMA, ids, spans

DEEP = 700


def chain(trace, n, top=0):
    return [(trace, 1, top), *[(trace, i, i - 1) for i in range(2, n + 1)]]


def test_depth_of_deep_chains(spark):
    df = spans(spark, *chain(1, DEEP), *chain(2, 257, top=9999), *chain(3, 129))
    out = {(r.trace_id, r.span_id): (r.depth, r.root_id, r.rooted) for r in with_depth(df).collect()}
    assert out == {(t, i): (i - 1, 1, t != 2) for t, n in ((1, DEEP), (2, 257), (3, 129)) for i in range(1, n + 1)}


def test_repairs_tell_a_deep_chain_from_a_cycle(spark):
    loop = [(4, 1, 0), (4, 2, 3), (4, 3, 2), (4, 4, 3), (5, 7, 7), (5, 8, 0)]
    ring = [(6, 1, 0), *[(6, i, i - 1) for i in range(11, 300)], (6, 10, 299)]
    deep = chain(1, DEEP)
    df = spans(spark, *deep, *loop, *ring, *chain(2, 257, top=9999))
    assert ids(cleaning.lenient(df)) == [(1, i) for i in range(1, DEEP + 1)]
    assert ids(cleaning.salvage(df)) == [*[(1, i) for i in range(1, DEEP + 1)], (4, 1), (5, 8), (6, 1)]
    lost = {(r.trace_id, r.span_id) for r in fold_up(df, {}).where("unsettled").collect()}
    assert lost == {(4, 2), (4, 3), (4, 4), (5, 7), *[(6, i) for i in range(10, 300)]}


def test_clip_and_checkpoints_of_a_deep_chain(spark):
    # the top ends first: its bound holds for the whole path
    rows = [(1, i, i - 1, "a", 0, 10 if i == 1 else 20) for i in range(1, DEEP + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.span_id, r.end_us) for r in structure.crisp_clip(df).collect()} == {(i, 10) for i in range(1, DEEP + 1)}
    held = {r.span_id: r.ckpt_id for r in loss.checkpoint_above(df, cpd=200).collect()}
    assert held == {i: (i - 2) // 200 * 200 + 1 for i in range(2, DEEP + 1)}


def test_giant_traces_are_folded_by_joins(spark, monkeypatch):
    """Traces above the bound give what the others give: sums, bounds, tops, children, parents' values."""
    from pyspark.sql import functions as F

    from spanloom.plans import tree

    rows = [*chain(1, 90), *chain(2, 60, top=9999), (3, 1, 0), (3, 2, 3), (3, 3, 2), (3, 4, 3), (4, 1, 0), (4, 2, 1), (4, 3, 1)]
    df = spans(spark, *rows).withColumn("start_us", F.col("span_id") % 7)
    values = {"n": (F.lit(1), "sum"), "lo": (F.col("start_us"), "min"), "hi": (F.col("start_us"), "max"), "bits": (F.expr("shiftleft(1L, cast(span_id % 60 as int))"), "or"),
              "odd": (F.col("span_id") % 11 == 0, "any"), "at": (F.col("span_id"), "first")}
    settle = lambda d: sorted(tuple(r) for r in d.where("not unsettled").collect())
    for stop in (None, F.col("span_id") % 13 == 0):
        small = settle(fold_up(df, values, stop, parents=True))
        lost = fold_up(df, values, stop, parents=True).where("unsettled").count()
        monkeypatch.setattr(tree, "GIANT", 50)
        joined = fold_up(df, values, stop, parents=True)
        assert settle(joined.select(*fold_up(df.limit(0), values, stop, parents=True).columns)) == small
        assert joined.where("unsettled").count() == lost
        monkeypatch.setattr(tree, "GIANT", 4_000_000)
        monkeypatch.setattr(tree, "_giants", set())
