"""Each operator against brute force, on small tables with nulls, ties, empty and repeated rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, chat, graph, html_main, langid, minhash, mixing, neardup_vectors, registry, sharding, token_counts, topk
from tests.oracle import duck, rows_of, sql_rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, lang_pred string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), -1, "x", "y") for i, t, lang, s in rows], DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    long_text = words(3000, 9)
    return docs_of(
        spark,
        [(1, None, None, None), (2, "", "en", "a"), (3, " \n ", "en", None), (4, "123 !!", "fr", "a"), (5, long_text, "en", "b"), (6, long_text, "en", "b"),
         (7, "one two", "en", "b"), (7, "one two", "en", "b"), (None, "one two", "en", "c")],
    )


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert rows_of(registry.queries()[name](spark, SF)) == sql_rows(duck(SF), registry.oracle_sql()[name])


def test_bpe_equals_library():
    import tiktoken

    ranks, pattern = bpe.tokenizer()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", "a" * 2000, "<|endoftext|>", " \n\n x'll 12é你"] + ["".join(r.choice("abe stй你1'.\n") for _ in range(200)) for _ in range(80)]
    own = bpe.Encoder(ranks, pattern)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_rows(odd_docs):
    got = {r.doc_id: r for r in bpe.digest_documents(odd_docs, *bpe.tokenizer()).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[7].decoded_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_token_counts_equal_library():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = p.path("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=path)
    lib = Tokenizer(models.Unigram([(s.id_to_piece(i), float(s.get_score(i))) for i in range(s.get_piece_size())], unk_id=0, byte_fallback=True))
    own = token_counts.Counts(token_counts.load_vocabulary(path))
    r = random.Random(5)
    texts = [" ", "  a  b ", "日本 x\n\n😀"] + ["".join(r.choice("abdeé ß\n你1.") for _ in range(200)) for _ in range(60)]
    assert own.count(texts) == [len(lib.encode(token_counts.MARK + t.replace(" ", token_counts.MARK)).ids) for t in texts]
    assert own.count([None, ""]) == [0, 0]


def test_near_duplicates_equal_brute_force(spark, odd_docs):
    rows = []
    for g in range(12):
        base = words(120, g).split()
        rows.append((100 * g + 10, " ".join(base), "en", "s"))
        for k in range(1, 5):
            other = list(base)
            other[10 * k] = f"edit{g}x{k}"
            rows.append((100 * g + 10 + k, " ".join(other), "en", "s"))
    docs = docs_of(spark, rows)
    idf = minhash.word_idf(docs)
    import pyarrow as pa

    sets = {}
    for i, t, _, _ in rows:
        h, starts = minhash.word_hashes(pa.array([t]))
        sets[i] = minhash.weighted_shingles(h, idf)
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == label
    odd = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(odd_docs).collect()}
    assert odd == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True)}
    assert minhash.drop_near_duplicates(odd_docs).count() == 7


def test_minhash_blocks_lose_no_pair(spark):
    """All pairs of different components meet in a block, whatever the sizes of the components."""
    rows = [(b, 100 * b + i, c) for b, sizes in enumerate(((9, 1), (3, 3, 2, 1), (1,) * 7, (5,))) for i, c in
            enumerate(c for c, n in enumerate(sizes) for _ in range(n))]
    dealt = minhash._dealt(spark.createDataFrame(rows, "bucket long, id long, component long"), 2).collect()
    met = {frozenset((x.id, y.id)) for x in dealt for y in dealt
           if (x.bucket, x.lo, x.hi) == (y.bucket, y.lo, y.hi) and x.asks and not y.asks and x.component != y.component}
    want = {frozenset((i, j)) for b, i, c in rows for d, j, e in rows if b == d and c != e}
    assert met == want


def test_minhash_chain_in_one_bucket(spark):
    """Documents that drift from a common start: each is near its neighbours only."""
    base, drift = words(400, 1).split(), words(400, 2).split()
    rows = [(k, " ".join(drift[: 6 * k] + base[6 * k :]), "en", "s") for k in range(40)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == dict.fromkeys(range(40), 0)


def test_block_similarity_is_weighted_jaccard():
    idf = np.random.default_rng(1).random(minhash.IDF_CELLS).astype(np.float32) + 1
    draw = np.random.default_rng(2)
    docs = [draw.integers(0, 2, size=60).astype(np.uint64) for _ in range(6)]
    units = [minhash._shingle_units(d, idf) for d in docs]
    plain = [minhash.weighted_shingles(d, idf) for d in docs]
    got = minhash.block_similarity(units)
    for i in range(6):
        for j in range(i):  # a block's diagonal is not used
            assert got[i, j] > 0 and got[i, j] == pytest.approx(minhash.similarity(plain[i], plain[j]))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_mixing(spark, odd_docs):
    docs = docs_of(spark, [(i, words(1 + i * 7 % 90, i), "en", f"s{i % 5}" if i % 7 else None) for i in range(400)])
    rows = mixing.mix(docs).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    want = mixing.share_targets(size)
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    for s, target in want.items():
        own = [r for r in rows if r.source == s]
        assert all(0 <= r.copies <= 3 and r.target == pytest.approx(target) for r in own)
        assert abs(sum(r.copies * r.size for r in own) - target) <= 90
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(odd_docs).count() == odd_docs.count()
    assert mixing.apply_mix(odd_docs).columns == odd_docs.columns


def test_language(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs, model).where(langid.held_out())
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !") == ("und", 0.0)
    assert langid.keep_recognised(odd_docs).columns == odd_docs.columns


def test_html():
    page = (
        '<body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>A &amp;amp; B</h1><p>One,\n two<p>Three.'
        '<form><input><p>Name</p></form><div class="comments"><p>Nice, really.</p></div></article><footer>x</footer><!-- open'
    )
    assert html_main.main_text(page) == "A &amp; B\nOne, two\nThree."
    assert html_main.main_text(None) == html_main.main_text("") == ""


def test_shards(spark, odd_docs):
    out = sharding.shuffle_into_shards(odd_docs, shards=4)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and out.columns[:8] != []
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r["shard"] == shard) if out.columns.count("shard") == 1 else []
        assert slots == list(range(len(slots)))
    assert sorted(sharding.fisher_yates(100, (1, 2)).tolist()) == list(range(100))


def test_top_k_and_vector_links(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((300, 16))
    base[100:140] = base[100] + 0.01 * draw.standard_normal((40, 16))
    base[5] = base[6]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(900, None), (901, [float("nan")] * 16), (902, [0.0] * 16), (903, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    got = {r.vec_id: r for r in neardup_vectors.near_duplicates(vectors).collect()}
    assert len(got) == 304 and all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))
    assert [got[i].n_links for i in range(300)] == (close.sum(1) - 1).tolist()
    x = np.floor(1024 * base).astype(np.int64)
    ints = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<long>")
    best = topk.top_k(ints, ints.where("vec_id % 100 = 0"), 5).collect()
    for q in (0, 100, 200):
        score = x @ x[q]
        want = sorted((-int(score[i]), i) for i in range(300) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(best) if r.query_id == q] == want


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert minhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shuffle_into_shards(none).count() == 0
    assert langid.predict(none, langid.train(none)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).count() == 0


def test_apply_mix_takes_what_the_mix_says(spark):
    """Every row comes out as often as ``mix`` counts it, with null ids and sources and clashing columns."""
    rows = [(None if i % 97 == 0 else i, words(3 + i % 40, i), "en", (None, "a", "b", "c")[i % 7 % 4]) for i in range(600)]
    docs = docs_of(spark, rows).withColumn("whole", F.lit(7)).withColumn("_row", F.lit("x"))
    want = Counter()
    for r in mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect():
        want[(r.doc_id, r.source)] += r.n
    made = mixing.apply_mix(docs)
    assert made.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in made.collect()) == +want
