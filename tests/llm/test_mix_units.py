"""Rows without an id, rows that repeat one, and rows that are equal in all columns are units of their own."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import mixing
from tests.llm.test_operators import docs_of, words


def taken_of(rows):
    out = Counter()
    for r in rows:
        out[r.source] += r.size * r.copies
    return out


def test_sources_of_one_id_meet_their_targets(spark):
    many = [(None, words(5 + k % 17, k), "en", "none") for k in range(1000)]
    one = [(7, words(5 + k % 13, 3000 + k), "en", "one") for k in range(900)]
    equal = [(8, "the same six words each time", "en", "same")] * 800
    plain = [(100 + k, words(40, 9000 + k), "en", "plain") for k in range(300)]
    docs = docs_of(spark, many + one + equal + plain)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(many + one + equal + plain)
    taken, target = taken_of(rows), {r.source: r.target for r in rows}
    for source, want in target.items():
        assert abs(taken[source] - want) <= 40, (source, taken[source], want)
    assert all(r.copies <= 3 for r in rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    made = mixing.apply_mix(docs).withColumn("size", F.regexp_count("text", F.lit(mixing.WORD)))
    assert {r.source: r.n for r in made.groupBy("source").agg(F.sum("size").alias("n")).collect()} == {s: n for s, n in taken.items() if n}


def test_equal_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_BLOCK", 7)
    docs = docs_of(spark, [(None, "a b c", "en", None)] * 50 + [(1, "x y", "en", "s")] * 3)
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == {(None, 3): 50, (1, 2): 3}
    target = {r.source: r.target for r in rows}
    taken = taken_of(rows)
    assert all(abs(taken[s] - t) <= 3 for s, t in target.items())
    assert mixing.apply_mix(docs).count() == sum(r.copies for r in rows)


def test_targets_equal_the_plain_rule(spark, monkeypatch):
    """The level of the uncapped sources, whatever their number and however the ranges are cut."""
    import random

    draw = random.Random(4)
    for n, most in ((1, 10), (7, 3), (60, 10_000), (200, 50)):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 16 if n == 200 else 100_000)
        sizes = {f"s{k:04d}": draw.randint(0, most) for k in range(n)} | {None: draw.randint(1, most)}
        rows = [(s, "k" + (s or ""), w, 1, place) for place, (s, w) in enumerate(sorted(sizes.items(), key=lambda x: (x[0] is None, x[0] or "")))]
        table = spark.createDataFrame(rows, "source string, source_key string, words long, units long, place long")
        got = {r.source: r.target for r in mixing.targets_of(table).collect()}
        want = mixing.share_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
