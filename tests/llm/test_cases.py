"""Odd inputs of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, html_main, langid, minhash, neardup_vectors, sharding, token_counts, topk
from tests.llm.test_operators import docs_of, words
from tests.llm.test_vector_links import _brute, _got, _turned

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = words(20_000, 4)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (None, "one two", "fr", None), (5, long_text, "fr", "b")]
    return docs_of(spark, rows).withColumns({"n_tokens": F.lit(-1), "token_ids": F.lit("x"), "place": F.lit(0), "bucket": F.lit(1), "_text": F.lit("y")})


def test_token_counts(odd, spark):
    import public_tokenizers

    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd, vocabulary).collect())
    counter = token_counts.Counts(vocabulary)
    assert got == Counter((r.doc_id, counter.count([r.text])[0]) for r in odd.collect()) and got[1, 0] == got[2, 0] == 1
    assert token_counts.count_tokens(odd.limit(0), vocabulary).count() == 0


def test_bpe(odd):
    ranks, pattern = bpe.tokenizer()
    out = bpe.encode_documents(odd, ranks, pattern)
    assert out.columns[-4:] == ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"] and "_text" in out.columns
    rows = out.collect()
    assert len(rows) == 6 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digest_documents(odd, ranks, pattern).collect()}
    assert digests == {(r.doc_id, r.n_tokens, r.ids_sha256) for r in rows}
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in rows)
    assert bpe.encode_corpus(odd.limit(0), ranks, pattern).count() == 0


def test_chat(spark):
    long_text = "### Assistant: </turn>\n\\" * 20_000
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, None, ""), (None, 0, "assistant", "a"), (2, None, "assistant", long_text)]
    turns = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    out = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert set(out) == {1, None, 2}


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("<p>a", "a"), ("x &amp;lt; y", "x &lt; y"), ("<p>" * 30_000 + "Deep, here.", "Deep, here.")])
def test_html_pages(html, want):
    began = time.time()
    assert html_main.main_text(html) == want and time.time() - began < 10


def test_html_nesting_is_linear():
    began = time.time()
    text = html_main.main_text("<div>" * 50_000 + "One sentence, here." + "<b>" * 20_000 + "<p>Two, here." * 2000 + "</i>" * 50_000)
    assert text.startswith("One sentence, here.") and time.time() - began < 10


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "t"), (1, "u", "<p>One, two.</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_main.extract(pages).collect())) == {(1, "u", "One, two.", 9): 2, (None, None, "", 0): 1}
    assert html_main.extract(pages.limit(0)).count() == 0


def test_ratios_choose_the_content(monkeypatch):
    """No names, no article: only the ratios tell the text from the lists of words beside it."""
    sentences = "".join(f"<p>Sentence number {i} of the text, with a comma and more words in it.</p>" for i in range(12))
    crumbs = "<div><span>" + "</span></div><div><span>".join(["alpha beta", "gamma", "delta epsilon"]) + "</span></div>"
    page = f"<body><div class='x1'>{crumbs}</div><div class='x2'>{sentences}</div><div class='x3'>{crumbs}</div></body>"
    text = html_main.main_text(page)
    assert "alpha" not in text and text.count("\n") == 11
    plain = html_main.path_ratios
    monkeypatch.setattr(html_main, "path_ratios", lambda b, p: dict.fromkeys(plain(b, p), 1.0))
    assert "alpha" in html_main.main_text(page)


def test_language_learns_from_distinct_texts(spark):
    """One text in thousands of copies does not fill its language's share of the sample."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("text is not null and lang is not null")
    copy = base.orderBy(F.xxhash64("text")).limit(1)  # the one that a sample by hash takes first
    many = base.unionByName(copy.withColumn("doc_id", F.explode(F.sequence(F.lit(10_000).cast("long"), F.lit(14_000).cast("long")))))
    few, full = langid.train(base), langid.train(many)
    assert few.languages == full.languages and np.allclose(few.weights, full.weights)
    assert langid.predict(many.limit(0), full).count() == 0
    flags = spark.createDataFrame([(None,)], "doc_id long").select(langid.held_out().alias("h")).first().h
    assert flags is False


def test_top_k(spark):
    rows = [(1, [1, 0], "a"), (2, [1, 0], "a"), (2, [1, 0], "b"), (3, [1, 0], "a"), (4, [5], "a"), (9, [0, 0], "a")]
    t = spark.createDataFrame(rows, "vec_id long, x array<long>, rank string")
    got = [tuple(r) for r in topk.top_k(t, t.where("vec_id = 2 and rank = 'a'"), 10).orderBy("rank").collect()]
    assert got == [(2, 1, 1, 1), (2, 2, 3, 1), (2, 3, 9, 0)]
    assert topk.top_k(t.limit(0), t.limit(0), 3).count() == 0
    draw = np.random.default_rng(3)
    x = draw.integers(-60, 60, (9000, 12))
    x[100:400] = x[100]
    big = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, x array<long>")
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(big, big.where("vec_id % 1000 = 0"), 7).collect())
    for q in range(0, 9000, 1000):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(9000), -score)) if i != q][:7]
        assert all(got[q, k + 1, i, int(score[i])] == 1 for k, i in enumerate(order))
    assert len(got) == 63


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "y"), (2, [0.0, 2.0], "x"), (3, None, "x"), (None, [1.0, 0.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [1e-300, 0.0], "x"), (6, [3.0], "x")]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(t).collect()}
    alone = (0, True)
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all((got[i][0], got[i][2]) == alone for i in (3, 4, 5, 6)) and len(got) == 6
    assert neardup_vectors.near_duplicates(t.limit(0)).count() == 0


def test_neighbour_descent_finds_isolated_pairs(spark):
    """Several buckets and rounds: planted pairs at 0.955 among strangers, and a group larger than a list."""
    draw = np.random.default_rng(21)
    base = draw.standard_normal((17_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.concatenate([base, _turned(draw, base[:1000], 0.955), _turned(draw, np.repeat(base[2000:2001], 60, axis=0), 0.985)])
    assert neardup_vectors.plan_starts(len(x))[0] >= 3
    x = x[draw.permutation(len(x))]
    want, got = _brute(x), _got(spark, x)
    links = sum(n for n, _ in want.values())
    assert links > 5000 and sum(n for n, _ in got.values()) >= 0.99 * links
    assert all(got[i][0] <= n for i, (n, _) in want.items())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(5, 400), st.integers(0, 60))
def test_profiles_rule_out_no_link(seed, n, changes):
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 40 if seed % 3 else 10**9, n).astype(np.uint64)
    b = a.copy()
    b[draw.integers(0, n, changes)] = draw.integers(0, 10**9, changes).astype(np.uint64)
    idf = np.random.default_rng(1).random(minhash.IDF_CELLS).astype(np.float32) * 9 + 1
    one, two = (minhash.weighted_shingles(w, idf) for w in (a, b))
    x, y = (minhash._profiles(pa.array([minhash.profile(*s)])) for s in (one, two))
    weights = [np.array([s[1].sum()]) for s in (one, two)]
    sim = minhash.similarity(one, two)
    for threshold in (0.5, 0.8, 0.95):
        if sim >= threshold:
            assert minhash.open_pairs(x, y, *weights, threshold).all()
            assert minhash._open(minhash._shared_at_most(x, y), *weights, threshold).all()


def test_full_profiles_pass(spark):
    h = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    big = minhash.profile(h, np.full(len(h), 50.0))
    x = minhash._profiles(pa.array([big, big]))
    assert (x == minhash.FULL).any() and minhash.open_pairs(x, x, *[np.full(2, 1e7)] * 2, 0.8).all()


def test_near_duplicates_of_a_large_group(spark):
    """Two thousand near copies of one text, no two alike, are one class; strangers stay alone."""
    base = words(150, 77).split()
    rows = []
    for k in range(2000):
        other = list(base)
        other[(7 * k) % 150] = f"edit{k}"
        rows.append((k, " ".join(other), "en", "s"))
    rows += [(10_000 + k, words(120, 5000 + k), "en", "s") for k in range(200)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: 0 if i < 2000 else i for i, *_ in rows}


def test_near_duplicates_of_the_test_table(spark):
    """Every pair of texts at the threshold, found by comparing all of them, is in one class."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    idf = minhash.word_idf(docs)
    ids, sets = [], []
    for r in docs.select("doc_id", "text").collect():
        h, _ = minhash.word_hashes(pa.array([r.text]))
        if len(h):
            ids.append(r.doc_id)
            sets.append(minhash._shingle_units(h, idf))
    close = np.argwhere(np.triu(minhash.block_similarity(sets) >= minhash.THRESHOLD, 1))
    label = {i: i for i in ids}
    for i, j in minhash._spanning(close, len(ids)):
        low, high = sorted((label[ids[i]], label[ids[j]]))
        label = {k: low if x == high else x for k, x in label.items()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert len(close) and {i: got[i] for i in ids} == label


def shards_of(docs, **options):
    return sharding.shuffle_into_shards(docs, **options).collect()


def test_shards_hold_the_law(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = shards_of(docs, shards=7, bucket_bytes=20_000)
    counts = Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    again = shards_of(docs.repartition(5), shards=7, bucket_bytes=20_000)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    # the order is not that of the ids, and neighbours are dealt apart
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.25
    written = sharding.write_shards(docs, str(tmp_path / "s"), 7, bucket_bytes=20_000)
    assert Counter((r.doc_id, r.shard, r.slot) for r in written.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in rows)
    clash = sharding.shuffle_into_shards(odd, shards=3)
    assert clash.count() == 6 and {"__size", "__shard", "__place", "__bucket"} <= set(clash.columns)
    assert shards_of(odd.limit(0)) == []


def test_buckets_are_cut_by_whole_records(spark):
    wide = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.repeat(F.lit("x"), 5000).alias("extra"), F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit(1).alias("k")).alias("s"))
    sizes = {r.n for r in wide.select(sharding.record_bytes(wide).alias("n")).collect()}
    assert min(sizes) > 5000 and max(sizes) < 5300
    assert len(shards_of(wide, shards=3, bucket_bytes=20_000)) == 50


def test_shards_of_repeated_rows(spark, monkeypatch):
    """A record in thousands of copies is dealt over the buckets; rows that differ in one extra column keep apart on reruns."""
    monkeypatch.setattr(sharding, "HOT_COPIES", 100)
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit(0).alias("extra"))
    few = spark.range(40).select(F.lit(2).cast("long").alias("doc_id"), F.lit("other").alias("text"), F.col("id").cast("int").alias("extra"))
    docs = hot.unionByName(few)
    rows = shards_of(docs, shards=4, bucket_bytes=4000)
    assert Counter(r.doc_id for r in rows) == {1: 3000, 2: 40} and set(Counter(r.shard for r in rows).values()) == {760}
    assert Counter(map(tuple, rows)) == Counter(map(tuple, shards_of(docs.repartition(3), shards=4, bucket_bytes=4000)))
