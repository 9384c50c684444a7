"""The corpus pipeline against a plain replay of its four stages."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, langid, minhash, mixing

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_replay(spark, tmp_path):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2000").orderBy("doc_id").limit(90)
    near = docs.orderBy(F.desc("n_chars"), "doc_id").limit(6).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = docs.unionByName(near.withColumn("text", F.concat("text", F.lit(" edited"))))
    docs.unionByName(near.limit(1).withColumns({"doc_id": F.lit(2_000_000).cast("long"), "text": F.lit("12 !")})).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    model = langid.train(docs.where(~langid.held_out()))
    for i, r in list(rows.items()):
        name, score = model.predict(r.text)
        if name == langid.UNKNOWN or score < langid.MIN_SCORE:
            del rows[i]
    assert 2_000_000 not in rows

    idf = minhash.word_idf(spark.createDataFrame(list(rows.values()), docs.schema))
    sets = {}
    for i, r in rows.items():
        h, starts = minhash.word_hashes(pa.array([r.text]))
        sets[i] = minhash.weighted_shingles(h, idf)
    label = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and label[a] != label[b] and minhash.similarity(sets[a], sets[b]) >= minhash.THRESHOLD:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    kept = [r for i, r in rows.items() if label[i] == i]
    assert len(kept) < len(rows)

    ranks, pattern = bpe.tokenizer()
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for m in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect():
        ids = np.array(lib.encode_ordinary(rows[m.doc_id].text), dtype="<u4")
        text = hashlib.sha256(rows[m.doc_id].text.encode()).hexdigest()
        want[(m.doc_id, m.source, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), text)] += m.copies
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == +want
