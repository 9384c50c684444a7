"""Near-duplicate documents by improved consistent weighted sampling (ICWS).

A document is the weighted set of its shingles: ``SHINGLE`` consecutive lower-cased words (a
shorter document is one shingle). A shingle weighs its count in the document times the mean
inverse document frequency of its words. Word frequencies are counted over all documents, hashed
into ``IDF_CELLS`` cells, so the table that is broadcast has a fixed size. A cell's frequency is the
share of documents that hold one of its words. More documents of a kind leave that share as it is:
a word that fills a share p of the documents is weighed by p plus what strangers add to its cell,
about (distinct words of a document) / ``IDF_CELLS``, however large the vocabulary grows. ICWS draws
``BANDS * ROWS`` samples per document whose chance to agree is the weighted Jaccard similarity;
documents that agree in all rows of a band become candidates, and every candidate link is verified
by the weighted Jaccard similarity of the whole texts.

Equal word sequences are collapsed first (one representative). A band's bucket is never expanded
into all its pairs: each member meets the bucket's first member, and the links found join members
into components. Every pair of a bucket that lies in two components is then compared, in blocks:
the members outside the bucket's largest component meet all members, so a large settled group is
dealt out once. A pair's texts are read unless its profiles prove that it is below the threshold:
a profile sums the weights of a document's shingles in ``PROFILE`` cells, rounded up, and the sum
of two profiles' lesser cells is never less than the weight the two documents share. So no
candidate is lost, and documents with no possible partner never ship their text. The rest is
compared as pairs in small buckets and as blocks in large ones. Buckets that hold a large share of
all rows are joined by broadcast (``HOT_BUCKETS`` of them at most) and so dealt to all tasks.

Cases: null, empty and white-space texts have no shingle and are alone in their class; a row with a
null ``doc_id`` has no class and gives no row (:func:`drop_near_duplicates` keeps it, whatever its
text); an id with several texts links the near copies of each; repeated rows are one document; very
long texts are compared whole; extra columns are ignored (and kept by
:func:`drop_near_duplicates`); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.batches import ship_texts
from spanloom.llm.graph import components
from spanloom.session import materialize, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
IDF_CELLS = 1 << 20
#: Cells that leave a task and are summed together.
IDF_RANGE = 4096
SEED = 1_234_567
#: Cells of a profile, units of weight in each, and the value of a cell that is full.
PROFILE, UNIT, FULL = 256, 8.0, 65_535
#: The open pairs of a bucket with up to so many members are listed; larger buckets go block by block.
FEW = 16
#: Members of a block: profiles, texts. Rows of a profile block that are compared at a time.
PROFILES, BLOCK, STRIP = 1024, 256, 64
#: A bucket with more rows than this, and than its share of ``1 / HOT_BUCKETS`` of all rows, is joined by broadcast.
HOT_ROWS, HOT_BUCKETS = 1024, 10_000
#: So many candidate ids (8 bytes each) are broadcast to pick out their texts; more are joined by a shuffle.
IDS_SENT = 2_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and each text's first place."""
    lower = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words = pc.utf8_split_whitespace(lower)
    flat = words.flatten()
    starts = words.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(names.astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    out = hashed[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    blank = pc.equal(lower, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a blank text splits into one empty word
        keep = np.ones(len(out), dtype=bool)
        keep[starts[:-1][blank]] = False
        counts = np.diff(starts) - blank
        out = out[keep]
        starts = np.concatenate([[0], np.cumsum(counts)])
    return out, starts


def _counts(part: int, cells: bytes, n: bytes, docs: int) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([cells], pa.binary()), pa.array([n], pa.binary()), pa.array([docs], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "cells", "n", "docs"])


def word_idf(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency by word cell, over all documents (a fixed-size table)."""
    spark = ship_texts(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(IDF_CELLS, dtype=np.int64)
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                hashes, starts = word_hashes(batch.column(0).slice(at, 400))
                cells = (hashes & _U(IDF_CELLS - 1)).astype(np.int64)
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                seen = np.unique(doc << 20 | cells)
                held += np.bincount(seen & (IDF_CELLS - 1), minlength=IDF_CELLS)
                rows += len(starts) - 1
        for part in range(IDF_CELLS // IDF_RANGE):
            own = held[part * IDF_RANGE : (part + 1) * IDF_RANGE]
            at = np.flatnonzero(own)
            if len(at) or not part:
                yield _counts(part, at.astype("<u2").tobytes(), own[at].astype("<u8").tobytes(), rows if not part else 0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for part, cells, n, docs_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault(part, np.zeros(IDF_RANGE, dtype=np.int64))
                held[np.frombuffer(cells, "<u2").astype(np.int64)] += np.frombuffer(n, "<u8").astype(np.int64)
                rows[part] = rows.get(part, 0) + docs_
        for part, held in sums.items():
            yield _counts(part, b"", held.astype("<u8").tobytes(), rows[part])

    kind = "part int, cells binary, n binary, docs bigint"
    tasks = min(IDF_CELLS // IDF_RANGE, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = docs.select(text).mapInArrow(count, kind).repartition(tasks, "part").mapInArrow(merge, kind).collect()
    total = sum(r["docs"] for r in got)
    df = np.zeros(IDF_CELLS)
    for r in got:
        df[r["part"] * IDF_RANGE : (r["part"] + 1) * IDF_RANGE] = np.frombuffer(r["n"], "<u8")
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def _shingles(words: np.ndarray, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one document (sorted), their mean idf and their counts."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)
    value = idf[(words & _U(IDF_CELLS - 1)).astype(np.int64)].astype(np.float64)
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    mean = np.zeros(n)
    for j in range(k):
        h = _mix((h + words[j : j + n]) * _ODD[j % len(_ODD)])
        mean += value[j : j + n]
    h, first, times = np.unique(h, return_index=True, return_counts=True)
    return h, mean[first] / k, times


def weighted_shingles(words: np.ndarray, idf: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of one document (sorted) and their weights."""
    h, value, times = _shingles(words, idf, size)
    return h, value * times


class Sampler:
    """ICWS: per sample a Gamma(2,1) pair and a uniform shift for every shingle.

    The variates are read from three fixed tables at places that a mixed 64-bit hash of (shingle,
    sample) gives, so equal shingles see equal variates everywhere.
    """

    def __init__(self, samples: int, seed: int = SEED):
        draw = np.random.Generator(np.random.PCG64(seed))
        n = 1 << 16
        self.rate = -np.log((1 - draw.random(n)) * (1 - draw.random(n)))
        self.level = np.log(-np.log((1 - draw.random(n)) * (1 - draw.random(n))))
        self.shift = draw.random(n)
        self.salt = draw.integers(1, 1 << 63, size=(samples, 1), dtype=np.uint64) * _U(2) + _U(1)

    def sample(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The consistent samples of one weighted set, as 64-bit hashes."""
        best = np.full(len(self.salt), np.inf)
        out = np.zeros(len(self.salt), dtype=np.uint64)
        log_weight = np.log(weight)
        rows = np.arange(len(self.salt))
        for at in range(0, len(h), 4096):
            part = h[at : at + 4096]
            m = _mix((part[None, :] ^ self.salt) * _U(0x9E3779B97F4A7C15))
            rate = self.rate[(m >> _U(48)).astype(np.int64)]
            shift = self.shift[((m >> _U(32)) & _U(0xFFFF)).astype(np.int64)]
            t = np.floor(log_weight[at : at + 4096] / rate + shift)
            rank = self.level[((m >> _U(16)) & _U(0xFFFF)).astype(np.int64)] - rate * (t - shift + 1)
            j = rank.argmin(axis=1)
            least = rank[rows, j]
            better = least < best
            best[better] = least[better]
            new = _mix(part[j] + t[rows, j].astype(np.int64).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
            out[better] = new[better]
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    top = a[1].sum() + b[1].sum() - low
    return float(low / top) if top > 0 else 0.0


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, k1, k2, bands, weight, profile`` of every document that has a word.

    ``k1, k2`` identify the word sequence, ``bands`` holds the band keys.
    """
    spark = ship_texts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, sampler = shared.value, Sampler(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                hashes, starts = word_hashes(part.column(1))
                ids, k1, k2, keys, weight, folded = [], [], [], [], [], []
                doc_ids = part.column(0).to_pylist()
                for i, doc_id in enumerate(doc_ids):
                    words = hashes[starts[i] : starts[i + 1]]
                    if not len(words) or doc_id is None:
                        continue
                    place = np.arange(1, len(words) + 1, dtype=np.uint64)
                    ids.append(doc_id)
                    k1.append(int(_mix((words ^ (place * _ODD[0])) * _ODD[1]).sum().view(np.int64)))
                    k2.append(int((_mix((words + place * _ODD[2]) * _ODD[3]).sum() + _U(len(words))).view(np.int64)))
                    shingles = weighted_shingles(words, value)
                    got = sampler.sample(*shingles)
                    key = np.arange(bands, dtype=np.uint64) * _ODD[4]
                    for r in range(rows):
                        key = _mix((key ^ got[r::rows]) * _ODD[r % 4])
                    keys.append(key.view(np.int64))
                    weight.append(float(shingles[1].sum()))
                    folded.append(profile(*shingles))
                offsets = pa.array(np.arange(len(keys) + 1) * bands, pa.int32())
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(k1, pa.int64()),
                        pa.array(k2, pa.int64()),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array(weight, pa.float64()),
                        pa.array(folded, pa.binary()),
                    ],
                    names=["doc_id", "k1", "k2", "bands", "weight", "profile"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        run, "doc_id bigint, k1 bigint, k2 bigint, bands array<bigint>, weight double, profile binary"
    )


def verify(pairs: DataFrame, docs: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, sim`` of the pairs whose whole texts are similar enough."""
    spark = ship_texts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(idf)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("_id is not null")
    full = (
        pairs.join(texts.withColumnRenamed("_id", "a").withColumnRenamed("text", "text_a"), "a")
        .join(texts.withColumnRenamed("_id", "b").withColumnRenamed("text", "text_b"), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets = []
                for ids, texts_ in ((a, part.column(2)), (b, part.column(3))):
                    hashes, starts = word_hashes(texts_)
                    sets.append([weighted_shingles(hashes[starts[i] : starts[i + 1]], value) for i in range(len(ids))])
                sim = np.array([similarity(x, y) for x, y in zip(*sets, strict=True)])
                ok = np.flatnonzero(sim >= threshold) if len(sim) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64()), pa.array(sim[ok], pa.float64())],
                    names=["a", "b", "sim"],
                )

    return full.mapInArrow(run, "a bigint, b bigint, sim double")


def profile(h: np.ndarray, weight: np.ndarray) -> bytes:
    """The weights of a set summed by cell and rounded up; a cell that is too full holds ``FULL``."""
    sums = np.bincount((h >> _U(56)).astype(np.int64), weights=weight, minlength=PROFILE)
    return np.minimum(np.ceil(sums * UNIT * (1 + 1e-9)), FULL).astype("<u2").tobytes()


def _profiles(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    held = b"".join(column.to_pylist())
    return np.frombuffer(held, dtype="<u2").reshape(len(column), PROFILE) if held else np.zeros((0, PROFILE), np.uint16)


def _open(least: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of weights ``x`` and ``y`` that share ``least`` at most can reach the threshold."""
    shared = np.minimum(least, np.minimum(x, y))
    return shared * (1 + threshold) >= threshold * (x + y) * (1 - 1e-9)


def _shared_at_most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bound of the weight that the sets behind two profiles share, row by row."""
    least = np.minimum(x, y)
    return np.where((least == FULL).any(axis=1), np.inf, least.sum(axis=1, dtype=np.int64) / UNIT)


def open_pairs(x: np.ndarray, y: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the pairs that the profiles do not rule out."""
    out = np.zeros((len(x), len(y)), dtype=bool)
    for at in range(0, len(x), STRIP):
        part, w = x[at : at + STRIP], weight_x[at : at + STRIP, None]
        left = _open(np.inf, w, weight_y[None, :], threshold)
        near = np.flatnonzero(left.any(axis=0))
        if not len(near):
            continue
        sums = np.zeros((len(part), len(near)), dtype=np.uint32)
        full = np.zeros(sums.shape, dtype=bool)
        some_full = bool((part == FULL).any())
        cells = np.ascontiguousarray(y[near].T)
        for k in range(PROFILE):
            least = np.minimum(part[:, k, None], cells[k][None, :])
            sums += least
            if some_full:
                full |= least == FULL
        most = np.where(full, np.inf, sums / UNIT)
        out[at : at + STRIP, near] = left[:, near] & _open(most, w, weight_y[None, near], threshold)
    return out


def _alike(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """The pairs that their profiles do not rule out."""
    side = lambda k, w, p: profiles.select(F.col("id").alias(k), F.col("weight").alias(w), F.col("profile").alias(p))
    full = pairs.join(side("a", "weight_a", "x"), "a").join(side("b", "weight_b", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (2, 3))
            keep = pa.array(_open(_shared_at_most(_profiles(batch.column(4)), _profiles(batch.column(5))), x, y, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return full.select("a", "b", "weight_a", "weight_b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _with_bucket(rows: DataFrame, per: DataFrame, total: int) -> DataFrame:
    """``rows`` joined to the one row that ``per`` has for their bucket, hot buckets without dealing them to one task."""
    hot = F.col("n") > max(HOT_ROWS, total // HOT_BUCKETS)
    many = F.broadcast(per.where(hot))
    rest = rows.join(many.select("bucket"), "bucket", "left_anti").join(per.where(~hot), "bucket")
    return rows.join(many, "bucket").unionByName(rest)


def _dealt(members: DataFrame, block: int, total: int = 0) -> DataFrame:
    """Members dealt to blocks so that each one outside the largest component meets all others.

    ``minor`` members come in ``small`` blocks, and block ``lo`` of them meets block ``hi`` of all
    members; a member is in a block once as asker (``asks``) and once as asked.
    """
    per = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    top = per.groupBy("bucket").agg(
        F.sum("size").alias("n"), F.max(F.struct("size", F.col("component").alias("id"))).alias("top"), F.count(F.lit(1)).alias("open")
    )
    top = top.where("open > 1").select("bucket", "n", F.col("top.id").alias("largest"), (F.col("n") - F.col("top.size")).alias("outside"))
    cuts, small = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("outside") / block).cast("int")
    each = _with_bucket(members, materialize(top, "near-open", total // 2), total).withColumn("spot", F.xxhash64("id"))
    asks = each.where("component <> largest").withColumn("asks", F.lit(True))
    asks = asks.withColumn("lo", F.pmod("spot", small).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), cuts - 1)))
    asked = each.withColumn("asks", F.lit(False)).withColumn("hi", F.pmod("spot", cuts).cast("int"))
    asked = asked.withColumn("lo", F.explode(F.sequence(F.lit(0), small - 1)))
    columns = ["bucket", "id", "component", "n", "asks", "lo", "hi"]
    return asks.select(*columns).unionByName(asked.select(*columns))


def _profile_blocks(members: DataFrame, profiles: DataFrame, threshold: float, total: int) -> DataFrame:
    """``bucket, id, a, b``: members with a possible partner in another component and, in small buckets, their pairs."""
    dealt = _dealt(members, PROFILES, total).join(profiles, "id")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, component, weight = (rows.column(c).to_numpy() for c in ("id", "component", "weight"))
        asks, bucket = rows.column("asks").to_numpy(zero_copy_only=False), rows.column("bucket")[0].as_py()
        held = _profiles(rows.column("profile"))
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        close = open_pairs(held[x], held[y], weight[x], weight[y], threshold) & (component[x][:, None] != component[y][None, :])
        if rows.column("n")[0].as_py() <= FEW:
            i, j = np.nonzero(close)
            a, b = np.maximum(ids[x[i]], ids[y[j]]), np.minimum(ids[x[i]], ids[y[j]])
            return pa.table({"bucket": [bucket] * len(a), "id": a, "a": a, "b": b}, schema=found)
        near = np.unique(np.concatenate([ids[x[close.any(axis=1)]], ids[y[close.any(axis=0)]]]))
        none = [None] * len(near)
        return pa.table({"bucket": [bucket] * len(near), "id": near, "a": none, "b": none}, schema=found)

    found = pa.schema([(name, pa.int64()) for name in ("bucket", "id", "a", "b")])
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(compare, "bucket bigint, id bigint, a bigint, b bigint").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the given ids, written once."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    asked = ids.select(F.col("id").alias("doc_id"))
    asked = F.broadcast(asked) if ids.count() <= IDS_SENT else asked
    return materialize(whole.join(asked, "doc_id", "left_semi"), "near-texts")


def _shingle_units(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as units: the n-th occurrence of a shingle in a document is a unit of its own.

    The weighted Jaccard similarity is then the plain one over weighted units.
    """
    h, weight, times = _shingles(words, idf, SHINGLE)
    units, weights = [h], [weight]
    for level in range(1, int(times.max(initial=1))):
        more = times > level
        units.append(_mix(h[more] + np.full(int(more.sum()), level, dtype=np.uint64) * _ODD[3]))
        weights.append(weight[more])
    return np.concatenate(units), np.concatenate(weights)


def block_similarity(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a block, by products over their shared units."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    unit, weight = np.concatenate([h for h, _ in sets]), np.concatenate([w for _, w in sets])
    total = np.bincount(doc, weights=weight, minlength=n)
    _, place, times = np.unique(unit, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    doc, root, column = doc[keep], np.sqrt(weight[keep]), shared[place[keep]]
    order = np.argsort(column, kind="stable")
    doc, root, column = doc[order], root[order], column[order]
    low = np.zeros((n, n))
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        dense = np.zeros((n, width))
        dense[doc[a:b], column[a:b] - first] = root[a:b]
        low += dense @ dense.T
    return low / np.maximum(total[:, None] + total[None, :] - low, 1e-300)


def _spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined before."""
    root = list(range(n))
    out = []
    for i, j in pairs.tolist():
        x, y = i, j
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[x] = y
            out.append((i, j))
    return out


def _block_links(members: DataFrame, docs: DataFrame, idf, threshold: float, total: int) -> DataFrame:
    """Verified links between the components of large buckets, block by block.

    Each block compares its whole texts and returns the links that join it, fewer than its rows.
    """
    spark = ship_texts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(idf)
    dealt = _dealt(members, BLOCK, total).join(docs.withColumnRenamed("doc_id", "id"), "id")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, component = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        _, once, place = np.unique(ids, return_index=True, return_inverse=True)
        first, texts, sets = ids[once], rows.column("text").take(pa.array(once)), []
        for at in range(0, len(once), 200):
            hashes, starts = word_hashes(texts.slice(at, 200).combine_chunks())
            sets += [_shingle_units(hashes[starts[i] : starts[i + 1]], shared.value) for i in range(len(starts) - 1)]
        asker, asked = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
        asker[place[asks]] = asked[place[~asks]] = True
        of = component[once]
        sim = block_similarity(sets)
        close = (sim >= threshold) & asker[:, None] & asked[None, :] & (of[:, None] != of[None, :])
        got = _spanning(np.argwhere(close), len(first))
        a = [max(int(first[i]), int(first[j])) for i, j in got]
        b = [min(int(first[i]), int(first[j])) for i, j in got]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array([float(sim[i, j]) for i, j in got], pa.float64())})

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a bigint, b bigint, sim double")


def near_links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, representatives (``k1, k2, id``) and the components of the verified links."""
    idf = word_idf(docs)
    sig = materialize(signatures(docs, idf), "near-sig")
    reps = materialize(sig.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")), "near-reps", sig.count())
    total = reps.count()
    own = sig.join(reps, ["k1", "k2"]).where("doc_id = id").dropDuplicates(["id"])
    own = materialize(own.select("id", "bands", "weight", "profile"), "near-own", 8 * total)  # wide rows
    total *= BANDS
    keys, profiles = own.select("id", F.explode("bands").alias("bucket")), own.select("id", "weight", "profile")
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    shared = materialize(shared, "near-buckets", total // 2)
    members = materialize(_with_bucket(keys, shared, total).select("bucket", "id", "first"), "near-members", total)
    star = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    pairs = materialize(_alike(star, profiles, threshold), "near-pairs", 4 * members.count())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = materialize(verify(pairs, _texts(docs, ids), idf, threshold), "near-links")
    found = components(links, links.count())

    labelled = members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled, "near-labelled", members.count())
    near = materialize(_profile_blocks(labelled, profiles, threshold, total), "near-alike")
    pairs = near.where("a is not null").select("a", "b").distinct()
    large = near.where("a is null").select("bucket", "id").join(found, "id", "left")
    large = large.select("bucket", "id", F.coalesce("component", "id").alias("component"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    texts = _texts(docs, ids)
    more = verify(pairs, texts, idf, threshold).unionByName(_block_links(large, texts, idf, threshold, total))
    both = links.unionByName(materialize(more, "near-links"))
    return sig, reps, components(both, both.count())


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` plus ``_number``, an id for each pair of id and text, and the numbers that differ from the id.

    Rows of equal id and text become one. Of an id's other texts the least by hash has the id itself
    as its number; the rest are numbered above all ids.
    """
    own = docs.withColumn("_number", F.col("doc_id").cast("long"))
    again = own.where("_number is not null").groupBy("_number").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = materialize(again.select("_number"), "near-again")
    if not again.limit(1).count():
        return own, None
    key = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(SEED), "text"))
    once = materialize(own.join(again, "_number", "left_semi").withColumn("_key", key).dropDuplicates(["_number", "_key"]), "near-once")
    first = once.groupBy("_number").agg(F.min("_key").alias("_key"))
    rest = once.select("_number", "_key").join(first, ["_number", "_key"], "left_anti").orderBy("_number", "_key")
    top = own.agg(F.max("_number")).first()[0]
    more = materialize(rest.withColumn("_more", F.monotonically_increasing_id() + F.lit(top + 1)), "near-more")
    single = own.join(again, "_number", "left_anti").select(*docs.columns, "_number")
    apart = once.join(more, ["_number", "_key"], "left").select(*docs.columns, F.coalesce("_more", "_number").alias("_number"))
    return single.unionByName(apart), more.select(F.col("_more").alias("doc_id"), F.col("_number").alias("owner"))


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, class_id`` of rows whose ids are unique."""
    sig, reps, found = near_links(rows, threshold)
    labelled = reps.join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("class_id"))
    classes = sig.select("doc_id", "k1", "k2").join(labelled, ["k1", "k2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _by_number(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_number").alias("doc_id"), "text")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, kept``: one row per document id; the class's smallest id is kept.

    An id with several texts is in one class with the near copies of each of them.
    """
    rows, more = _numbered(docs)
    classes = _classes(_by_number(rows), threshold)
    if more is not None:
        classes = materialize(classes, "near-classes")
        links = classes.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
        joined = components(links.unionByName(more.select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))))
        own = classes.join(more.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        classes = own.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        classes = classes.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    return classes.select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class (rows with a null id stay), one row per id and text."""
    rows, _ = _numbered(docs)
    gone = _classes(_by_number(rows), threshold).where("class_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return rows.join(gone, rows["_number"] == gone["_gone"], "left_anti").select(*docs.columns)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and kept flag of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
