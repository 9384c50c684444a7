"""Samples are uniform or weighted as said and merge; components are dealt as evenly as one by one."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import generate, handlers, loss, reconstruct, reservoir, scoring
from spanloom.operators.generate import Shape
from spanloom.operators.handlers import Scheme
from spanloom.session import materialize
from spanloom.sources import corpus


def drawn(spark, ids, k, seed, weight=None):
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    return rows.withColumn("priority", reservoir.priority(reservoir.keyed(F.col("id"), seed), weight))


def test_uniform(spark):
    """Every row is as likely in a sample as any other (chi-square over seeds), and so is every pair of neighbours."""
    n, k, seeds = 50, 10, 400
    rows = spark.range(n).crossJoin(spark.range(seeds).select(F.col("id").alias("seed")))
    u = reservoir.keyed(F.col("id") + F.col("seed") * 1_000_003)
    picked = reservoir.sample(rows.withColumn("priority", reservoir.priority(u)), k, ("seed",), ties=("id",)).collect()
    assert len(picked) == k * seeds
    counts = np.bincount([r.id for r in picked], minlength=n)
    mean = k * seeds / n
    assert ((counts - mean) ** 2 / (mean * (1 - k / n))).sum() < 85  # 49 degrees of freedom, p = 0.001
    sets = {}
    for r in picked:
        sets.setdefault(r.seed, set()).add(r.id)
    both = sum(i in s and i + 1 in s for s in sets.values() for i in range(n - 1))
    want = seeds * (n - 1) * k * (k - 1) / (n * (n - 1))
    assert abs(both - want) < 5 * want**0.5


def test_weights(spark):
    seeds = 1500
    rows = spark.range(10).crossJoin(spark.range(seeds).select(F.col("id").alias("seed")))
    u = reservoir.keyed(F.col("id") + F.col("seed") * 1_000_003, 7)
    weight = F.when(F.col("id") == 3, 5).when(F.col("id") == 4, 0).otherwise(1)
    picked = reservoir.sample(rows.withColumn("priority", reservoir.priority(u, weight)), 1, ("seed",), ties=("id",)).collect()
    counts = np.bincount([r.id for r in picked], minlength=10)
    assert counts[4] == 0 and abs(counts[3] - seeds * 5 / 13) < 5 * (seeds * 5 / 13) ** 0.5


def test_samples_merge(spark):
    whole = drawn(spark, range(500), 20, 3)
    want = {r.id for r in reservoir.sample(whole, 20, ties=("id",)).collect()}
    parts = [reservoir.sample(whole.where(F.col("id") % 3 == m), 20, ties=("id",)) for m in range(3)]
    left = reservoir.merged(reservoir.merged(parts[0], parts[1], 20, ties=("id",)), parts[2], 20, ties=("id",))
    right = reservoir.merged(parts[2], reservoir.merged(parts[1], parts[0], 20, ties=("id",)), 20, ties=("id",))
    assert {r.id for r in left.collect()} == {r.id for r in right.collect()} == want and len(want) == 20
    assert reservoir.sample(whole.limit(0), 5, ties=("id",)).count() == 0 and reservoir.sample(whole.limit(3), 5, ties=("id",)).count() == 3


def greedy(sizes, parts):
    load = [0] * parts
    for s in sorted(sizes, reverse=True):
        k = min(range(parts), key=load.__getitem__)
        load[k] += s
    return max(load) - min(load), load


@pytest.mark.parametrize("seed, n, parts, top", [(1, 3000, 7, 40), (2, 3000, 16, 5000), (3, 12, 5, 900), (4, 3, 8, 10), (5, 5000, 3, 1), (6, 2000, 11, 10**6)])
def test_components_are_dealt_by_classes(spark, seed, n, parts, top):
    draw = random.Random(seed)
    sizes = [int(draw.paretovariate(1.1)) if top > 100 and draw.random() < 0.5 else draw.randint(1, top) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "component long, spans long")
    got = corpus.component_parts(df, parts).collect()
    assert sorted(r.component for r in got) == list(range(n)) and all(0 <= r.part < parts for r in got)
    load = [0] * parts
    for r in got:
        load[r.part] += sizes[r.component]
    gap, want = greedy(sizes, parts)
    # a class is at most one part in 64 wide
    assert max(load) <= max(want) + max(1, max(load) / corpus.FINE) + 1


def test_ten_million_components_are_dealt_quickly():
    import time

    classes = [(k, 1_000_000 // k, 1_000_000 // k * k) for k in range(1, 3000)]
    began = time.time()
    counts = corpus.deal_counts(classes, 200)
    assert time.time() - began < 20
    load = [sum(counts[k][p] * k for k, _, _ in classes) for p in range(200)]
    assert all(sum(counts[k]) == n for k, n, _ in classes) and max(load) - min(load) <= 2


def test_traces_are_made_in_many_tasks(spark):
    """The numbers are few bytes, yet no task makes all their traces."""
    numbers = spark.range(4000).select((F.col("id") % 2000).alias("trace_id")).distinct()
    made = generate.traces_of(numbers, generate.Shape("chain", depth=1)).withColumn("part", F.spark_partition_id())
    per = made.groupBy("part").agg(F.countDistinct("trace_id").alias("n")).collect()
    assert len(per) == 8 and sum(r.n for r in per) == 2000 and max(r.n for r in per) < 400


@pytest.mark.parametrize("engine, name", [("pcrb", "pcrb"), ("cgp", "cgprb"), ("pcr", "pcr")])
def test_links_graded_where_the_trace_is(spark, engine, name):
    """The same scores as from tables of links and paths, with links that are wrong, ambiguous and missing."""
    s = Scheme(name, 3, fp=0.2, prefix=1)
    t = generate.traces(spark, 30, Shape("branch", depth=9, fanout=2, fanout_law="poisson", max_spans=300))
    truth = handlers.payloads(t, s, whole=True).withColumn("dropped", loss.dropped())
    kept = materialize(loss.with_drops(t.drop("depth")).join(handlers.payloads(t, s).select("trace_id", "span_id", "br"), ["trace_id", "span_id"]), "kept")
    links = materialize(reconstruct.links(kept.where("not dropped"), engine, s), "links")
    plain = scoring.score(links, kept)
    whole = scoring.score_whole(scoring.graded_whole(truth, engine, s)).select(*plain.columns).collect()
    assert sorted(whole) == sorted(plain.collect())
    assert all(sum(r[c] for r in whole) for c in ("misattached", "anchor_correct", "synthetic"))
    assert engine != "pcr" or all(sum(r[c] for r in whole) for c in ("ancestors_skipped", "misattached_ancestor"))


def test_made_traces_are_scored_without_a_shuffle_of_spans(spark):
    """``online_evaluation`` writes no table, and deals numbers of traces and sums of traces only."""
    from spanloom.queries import studies

    folder = session.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = studies._online(spark, "/root/testdata/sf0.001")
    assert len(df.collect()) == 2
    assert not (set(os.listdir(folder)) if os.path.isdir(folder) else set()) - there
    spans = F.count(F.lit(1)).alias("spans")
    t = generate.traces(spark, 60, Shape("branch", depth=9, fanout=2, fanout_law="poisson", max_spans=300))
    s = Scheme("pcrb", 3)
    made = scoring.graded_whole(handlers.payloads(t, s, whole=True).withColumn("dropped", loss.dropped()), "pcrb", s)
    assert made._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == 1  # the numbers
    assert made.agg(spans).first().spans == t.count()
