"""Small trees with known defects, and folds along paths."""

from spanloom.operators import cleaning, structure
from spanloom.plans.tree import with_depth

SCHEMA = "trace_id long, span_id long, parent_id long, service string, start_us long, end_us long"


def spans(spark, *rows):
    return spark.createDataFrame([(t, s, p, "a", 0, 10) for t, s, p in rows], SCHEMA)


def ids(df):
    return sorted((r.trace_id, r.span_id) for r in df.collect())


def test_salvage_keeps_the_largest_tree_and_rejects_dangling(spark):
    df = spans(spark, (1, 1, 0), (1, 2, 1), (1, 11, 0), (1, 12, 11), (1, 13, 12), (2, 1, 0), (2, 3, 99), (3, 5, 0), (3, 6, 5), (3, 1, 0), (3, 2, 1))
    assert ids(cleaning.salvage(df)) == [(1, 11), (1, 12), (1, 13), (3, 1), (3, 2)]


def test_lenient_prunes_collapses_and_rejects(spark):
    df = spans(spark, (1, 1, 0), (1, 2, 99), (1, 3, 2), (2, 1, 0), (2, 7, 8), (2, 8, 7), (3, 1, 0), (3, 2, 1), (3, 2, 1))
    out = {(r.trace_id, r.span_id): r.flags for r in cleaning.lenient(df).collect()}
    assert out == {(1, 1): cleaning.PRUNED, (3, 1): cleaning.DEDUPED, (3, 2): cleaning.DEDUPED}


def test_conflicting_duplicate_rejects(spark):
    df = spans(spark, (1, 1, 0), (1, 2, 1)).unionByName(spark.createDataFrame([(1, 2, 1, "b", 0, 10)], SCHEMA))
    assert cleaning.lenient(df).count() == 0


def test_depth_of_a_chain(spark):
    df = spans(spark, *[(1, i, i - 1) for i in range(1, 101)])
    assert {r.span_id: r.depth for r in with_depth(df).collect()} == {i: i - 1 for i in range(1, 101)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert with_depth(df).count() == 0
    assert cleaning.violations(df).count() == 0
    assert structure.trace_shape(df).count() == 0


def test_clip_drops_what_lies_outside(spark):
    rows = [(1, 1, 0, "a", 0, 100), (1, 2, 1, "a", 50, 150), (1, 3, 2, "a", 110, 120), (1, 4, 3, "a", 60, 70), (1, 5, 1, "a", 100, 130)]
    out = {r.span_id: (r.start_us, r.end_us) for r in structure.crisp_clip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (0, 100), 2: (50, 100), 5: (100, 100)}
