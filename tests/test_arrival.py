"""Counted values and correlations against plain Python, with one value holding most rows."""

import random

import numpy as np
import pytest

from spanloom.operators import arrival

SPANS = "trace_id long, span_id long, parent_id long, service string, start_us long, end_us long"


def test_running_counts_over_ranges(spark):
    r = random.Random(1)
    values = [7] * 300 + [r.randrange(100) for _ in range(200)]
    traces = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)] + [(None, 1)], "num_spans long, hit int")
    rows = arrival.counted_values(traces, ("num_spans",)).collect()
    assert {x.value: (x.n, x.before, x.total) for x in rows} == {
        v: (values.count(v), sum(w < v for w in values), 500) for v in set(values)
    }


def test_correlations_equal_plain_ranks(spark):
    r = random.Random(2)
    rows, size, hit = [], [], []
    for t in range(120):
        n, lost = r.randrange(1, 6), r.random() < 0.4
        size.append(n + lost)
        hit.append(int(lost))
        rows += [(t, i + 1, 0 if i == 0 else 1, "s", 0, 10 * n) for i in range(n)] + [(t, 99, 77, "s", 0, 1)] * lost
    got = {x.name: x for x in arrival.correlations(spark.createDataFrame(rows, SPANS)).collect()}
    place = [sum(w < v for w in size) + (size.count(v) + 1) / 2 for v in size]
    assert got["num_spans"].spearman == pytest.approx(np.corrcoef(place, hit)[0, 1], abs=1e-6)
    assert got["num_spans"].point_biserial == pytest.approx(np.corrcoef(size, hit)[0, 1], abs=1e-6)
    assert got["num_services"].spearman is None  # it does not vary


def test_no_spans(spark):
    none = spark.createDataFrame([], SPANS)
    for op in (arrival.correlations, arrival.quantile_lift, arrival.service_rates, arrival.prefix_bytes):
        assert op(none).count() == 0
