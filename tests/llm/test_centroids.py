"""Clusters against comparing every vector with every centroid."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import centroids
from tests.oracle import duck, rows_of, sql_rows

SF = "/root/testdata/sf0.01"


def brute(ids, x, k, rounds, seed=1):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = [list(map(int, x[i])) for i in order[:k]]
    assign = lambda: [min(range(len(c)), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for v in x]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [x[i] for i in range(len(x)) if at[i] == j]
            if own:
                c[j] = [int(sum(int(v[d]) for v in own)) // len(own) for d in range(len(c[j]))]
    at = assign()
    return [(ids[i], at[i], sum((int(a) - b) ** 2 for a, b in zip(x[i], c[at[i]], strict=True))) for i in range(len(x))], c


@pytest.mark.parametrize("case", ["spread", "ties", "far"])
def test_clusters_equal_brute_force(spark, case):
    draw = np.random.default_rng(len(case))
    if case == "spread":
        x = draw.integers(-40, 40, (300, 4)) + 90 * draw.integers(0, 4, (300, 1))
    elif case == "ties":  # many equal vectors and distances, centroids that lose all vectors
        x = draw.integers(-1, 2, (200, 3))
    else:  # beyond what products of doubles hold exactly
        x = draw.integers(-centroids.LARGEST + 1, centroids.LARGEST, (120, 3))
    ids = draw.permutation(len(x)).tolist()
    ids[5] = ids[6]
    rows = [(i, [float(v) for v in one], "x", -1) for i, one in zip(ids, x, strict=True)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, cluster int").repartition(3)
    got, c = centroids.cluster(t, k=7, rounds=4, scale=1, dim=x.shape[1])
    want, c2 = brute(ids, x, 7, 4)
    assert c.tolist() == c2
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_most_distances_are_not_computed():
    draw = np.random.default_rng(4)
    x = draw.integers(-20, 20, (5000, 16)) + 400 * draw.integers(-3, 4, (5000, 1))
    c = x[:16].copy()
    m = centroids.Move(c, np.zeros(16), centroids.group_centroids(c))
    at, _, upper, lower = centroids.start(x, m)
    for _ in range(4):
        new = np.stack([x[at == j].mean(axis=0).astype(np.int64) if (at == j).any() else m.c[j] for j in range(16)])
        m = centroids.Move(new, centroids._up(((new - m.c) ** 2).sum(axis=1)), m.group)
        at, upper, lower, computed = centroids.follow(x, at, upper, lower, m)
        d2 = centroids.squared(x, new)
        assert (at == d2.argmin(axis=1)).all()
        true = np.sqrt(d2.astype(float))
        assert (upper >= true[np.arange(len(x)), at]).all()
        for g in range(m.groups):
            other = true.copy()
            other[np.arange(len(x)), at] = np.inf
            assert (lower[:, g] <= other[:, m.group == g].min(axis=1, initial=np.inf) + 1e-6).all()
    assert computed < 0.5 * len(x) * 16


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (None, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (1, [1.0, 2.0]), (7, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, c = centroids.cluster(t, k=5, rounds=2, scale=1, dim=2)
    assert Counter(r.vec_id for r in got.collect()) == {1: 2, None: 1} and len(c) == 3
    none, c = centroids.cluster(t.limit(0))
    assert none.count() == 0 and len(c) == 0
    with pytest.raises(Exception, match="not below"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], t.schema), dim=2)[0].count()


def test_query_equals_sql(spark):
    assert rows_of(centroids.op13_centroids(spark, SF)) == sql_rows(duck(SF), centroids.ORACLE)
