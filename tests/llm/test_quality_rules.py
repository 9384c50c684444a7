"""Statistics and rules against plain Python, and accuracy on documents that training never saw."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality_rules as q

SF = "/root/testdata/sf0.1"


def plain(text):
    """The features of a text, one character at a time."""
    t = text or ""
    kind = [unicodedata.category(c) for c in t]
    words = re.findall(r"[^ \t\n\x0b\f\r]+", t)
    letters, digits = sum(k[0] == "L" for k in kind), sum(k == "Nd" for k in kind)
    spaces, stops, n = sum(c in " \t\n\x0b\f\r" for c in t), sum(c in ".,;:!?" for c in t), len(t)
    lines, rows = t.count("\n") + 1, t.split("\n")
    pieces = re.split(r"[ \t\n\x0b\f\r]+", t.lower())
    capitals = sum(k == "Lu" for k in kind)
    runs = len(re.findall("U{2,}", "".join("U" if k == "Lu" else "." for k in kind)))
    sentences = sum(c in ".!?" and (i + 1 == n or t[i + 1] in " \t\n\x0b\f\r") for i, c in enumerate(t))
    ends = sum(bool(r) and r[-1] in ".!?:" for r in rows)
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    w = max(1, len(words))
    return [n, len(words), (n - spaces) / w, letters / max(1, n), capitals / max(1, letters), runs / w, digits / max(1, n), (n - letters - digits - spaces - stops) / max(1, n),
            stops / w, t.count("!") / w, len(words) / max(1, sentences), len(words) / lines, ends / lines, 1 - len(set(rows)) / lines, len(set(pieces)) / w, echoes / w, max(map(len, pieces))]


TEXTS = [None, "", " ", "One two two. Two!\nOne two two. Two!\n", "ÄÖ ÜX 12 %% aa aa aa", "a" * 50_000, "word " * 20_000, "x\n\n\ny: z?\nq.", "a b a b", "日本 語。 x!! ?"]


def test_statistics_equal_plain_ones(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"chars": F.lit("x"), "score": F.lit(1)})
    got = {r.doc_id: [r[f] for f in q.FEATURES] for r in q.described(docs, [F.col("doc_id")]).collect()}
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], plain(t)), (i, list(zip(q.FEATURES, got[i], plain(t))))


def test_held_out_documents_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.op11_quality(spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, poor = (np.array([r.score for r in rows if r.quality == k]) for k in (1, 0))
    assert len(good) > 500 and len(poor) > 50
    assert (good[:, None] > poor[None]).mean() > 0.99 and np.mean([r.predicted == r.quality for r in rows]) > 0.98
    assert all((r.score >= 0.5) == r.predicted and 0 <= r.score <= 1 for r in rows)


def test_rules_are_sparse_and_compiled_as_fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = q.train(docs, labels, texts=600)
    again = q.train(docs.repartition(7), labels, texts=600)
    assert [str(r) for r in model.rules] == [str(r) for r in again.rules] and 0 < len(model.rules) < 150
    assert any(len(r.bounds) > 1 for r in model.rules) and all(len(r.bounds) <= 2 * q.DEPTH and r.weight for r in model.rules)
    some = docs.limit(300)
    x = np.array([[r[f] for f in q.FEATURES] for r in q.described(some, []).collect()])
    margin = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    got = [r.score for r in q.predict(some, model, [F.col("doc_id")]).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_lasso_reaches_its_conditions():
    draw = np.random.default_rng(2)
    r = (draw.random((400, 12)) < 0.4).astype(float)
    y = (draw.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 3] + 0.3)))).astype(float)
    w = draw.random(400) + 0.5
    out = q.fit_lasso(r, y, w, 0.02, np.zeros(13))
    slope = (w * (1 / (1 + np.exp(-(r @ out[:-1] + out[-1]))) - y) / w.sum()) @ r
    assert all(abs(g + 0.02 * np.sign(b)) < 2e-3 if b else abs(g) <= 0.022 for g, b in zip(slope, out[:-1]))
    assert out[0] > 0.5 and out[3] < -0.5 and (out[:-1] == 0).sum() >= 5


@pytest.mark.parametrize("label, low, high", [(None, 0.5, 0.5), (1, 0.9, 1.0), (0, 0.0, 0.1)])
def test_labels_of_one_kind_or_none(spark, label, low, high):
    docs = spark.createDataFrame([(i, f"text {i}.") for i in range(20)] + [(None, None), (3, "text 3.")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, label) for i in range(20)] + [(None, 1), (50, 0), (3, 7)], "doc_id long, quality int")
    model = q.train(docs, labels)
    scores = [r.score for r in q.predict(docs, model, [F.col("doc_id")]).collect()]
    assert len(scores) == 22 and all(low <= s <= high for s in scores)
    assert q.predict(docs.limit(0), model, [F.col("doc_id")]).count() == 0
    assert q.train(docs.limit(0), labels.limit(0)).rules == []
