"""Traces reach a worker whole, whatever the plan before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.plans.traces import CHUNK, _cut, groups, map_traces
from spanloom.plans.tree import parent_rows

THRESHOLDS = {
    "spark.sql.autoBroadcastJoinThreshold": -1,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": 10_000,
    "spark.sql.adaptive.coalescePartitions.enabled": False,
}


def counted(rows: pa.Table) -> pa.Table:
    trace = rows.column("trace_id").to_numpy()
    runs = groups(trace)
    return pa.table([np.array([trace[a] for a, _ in runs]), np.array([b - a for a, b in runs])], names=["trace_id", "n"])


def test_traces_stay_whole_behind_a_join_that_turns_out_small(spark):
    spans = spark.range(0, 12_000, 1, 8).select((F.col("id") % 300).alias("trace_id"), F.col("id").alias("span_id"), F.repeat(F.lit("x"), 50).alias("service"))
    few = spark.range(0, 300, 1, 8).select(F.col("id").alias("trace_id"), F.lit(1).alias("flag"))
    for name, value in THRESHOLDS.items():
        spark.conf.set(name, value)
    try:
        got = map_traces(spans.join(few, "trace_id"), counted, "trace_id bigint, n bigint").collect()
    finally:
        for name in THRESHOLDS:
            spark.conf.unset(name)
    assert sorted(map(tuple, got)) == [(t, 40) for t in range(300)]


def cut(sizes, chunk, rows=10):
    """The group sizes of every run that ``_cut`` gives for groups that come in batches of a few rows."""
    keys = np.repeat(np.arange(len(sizes)), sizes)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + rows])], names=["k"]) for i in range(0, len(keys), rows)]
    return [[b - a for a, b in groups(t.column("k").to_numpy())] for t in _cut(iter(batches), "k", chunk)]


def test_runs_are_whole_groups_of_about_a_chunk():
    sizes = [3, 7, 95, 1, 1, 40, 12, 250, 2]
    for chunk in (5, 20, 100, 1000):
        got = cut(sizes, chunk)
        assert [n for run in got for n in run] == sizes
        assert all(sum(run) <= max(sizes) + chunk + 10 for run in got)
    assert len(cut([66] * 3000, CHUNK, 10_000)) >= 9  # what a worker holds does not grow with its partition


def test_parents_of_one_trace_and_of_several():
    draw = np.random.default_rng(3)
    span, parent = draw.integers(-30, 30, 200), draw.integers(-40, 40, 200)
    first = {int(s): i for i, s in reversed(list(enumerate(span)))}
    want = [first.get(int(p), -1) if p else -1 for p in parent]
    assert parent_rows(np.zeros(200, np.int64), span, parent).tolist() == want
    twice = parent_rows(np.repeat([0, 1], 200), np.tile(span, 2), np.tile(parent, 2)).tolist()
    assert twice == want + [w + 200 if w >= 0 else -1 for w in want]
