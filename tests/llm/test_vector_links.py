"""Links of vectors that an approximate neighbour graph loses."""

import numpy as np

from spanloom.llm import neardup_vectors


def _brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= neardup_vectors.THRESHOLD
    label = np.arange(len(x))
    while True:
        new = np.where(close, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return {i: (n - 1, c) for i, (n, c) in enumerate(zip(close.sum(1).tolist(), label.tolist(), strict=True))}
        label = new


def _got(spark, x):
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_duplicates(vectors).collect()}


def _turned(draw, x, cosine):
    """Rows at the given cosine to those of ``x``, in directions of their own."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def test_isolated_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 1700)
    draw = np.random.default_rng(11)
    base = draw.standard_normal((6000, 64))
    x = np.concatenate([base, _turned(draw, base[:400], 0.952)])
    x = x[draw.permutation(len(x))]
    want = _brute(x)
    assert sum(n for n, _ in want.values()) == 800
    assert _got(spark, x) == want


def test_tight_groups_that_link(spark, monkeypatch):
    """Ten pairs of groups: each vector is all but equal to its own group and at 0.952 of its pair's other group."""
    monkeypatch.setattr(neardup_vectors, "BLOCK", 1300)
    draw = np.random.default_rng(14)
    base = draw.standard_normal((10, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    ends = np.concatenate([base, _turned(draw, base, 0.952)])
    x = np.repeat(ends, 300, axis=0) + 1e-5 * draw.standard_normal((6000, 64))
    x = x[draw.permutation(len(x))]
    want = _brute(x)
    assert {n for n, _ in want.values()} == {599}
    assert _got(spark, x) == want
