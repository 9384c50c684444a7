"""Language identification by hierarchical discrimination.

First the language family is predicted (one linear machine per family, one against the rest), then
one-versus-one linear support vector machines separate the languages of that family by votes, ties
by summed margins. Features are the square roots of the relative frequencies of letter 1- to
3-grams (lower-cased, words set off by one space), hashed into ``CELLS`` cells, of the whole text.

Training reads only text and non-null language of the training rows. At most ``TRAIN_ROWS``
distinct texts, equally many per language and the first by a hash of the text, are collected to
fit the machines; copies of a text count once and are combined before they are moved. Everything
else covers all rows.

Cases: a null ``doc_id`` is not held out; null texts, and texts without a letter, are ``und`` with score 0; empty tables give no rows;
a single learned language is predicted for every text with letters, and with no training row every
text is ``und``; very long texts are read whole; repeated rows each give a row; extra columns are
ignored. Exact ties go to the language first in code point order. More than
``MOST_LANGUAGES`` labels are an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from spanloom.llm.batches import ship_texts
from spanloom.session import table

CELLS = 1 << 14
TRAIN_ROWS = 2400
#: More labels than this are refused: there are not so many languages with texts, and there is a machine per pair in a family.
MOST_LANGUAGES = 400
EPOCHS = 12
PENALTY = 30.0
#: Characters of a text whose n-grams are counted at a time.
STEP = 1 << 20
UNKNOWN = "und"
#: Below this confidence the filter rejects a document.
MIN_SCORE = 0.3

# Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "rw sn sw xh zu",
}


def family_of(language: str) -> str:
    """The family of a language; a language without an entry is a family of its own."""
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"~{language}")


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, a space for every other code point."""
    table_ = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table_[c] = ord(low[0])
    return table_


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a text, or None where it has no letter."""
    if not text:
        return None
    out = np.zeros(CELLS, dtype=np.int64)
    last = np.full(2, 32, dtype=np.uint32)
    any_letter = False
    for at in range(0, len(text), STEP):
        codes = _letters()[np.frombuffer(text[at : at + STEP].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        space = codes == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= last[1] != 32
        codes = codes[keep]
        if not len(codes):
            continue
        any_letter |= bool((codes != 32).any())
        out += _grams(np.concatenate([last, codes]))
        last = np.concatenate([last, codes])[-2:]
    if last[1] != 32:
        out += _grams(np.concatenate([last, np.full(1, 32, dtype=np.uint32)]))
    return out if any_letter else None


def _grams(c: np.ndarray) -> np.ndarray:
    """Counts of the n-grams that end behind the first two code points."""
    a, b, x = c[:-2].astype(np.uint64), c[1:-1].astype(np.uint64), c[2:].astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    parts = []
    for salt, h in ((1, x), (2, b << np.uint64(21) | x), (3, (a * np.uint64(0x100000001B3)) ^ (b << np.uint64(21)) ^ x)):
        v = (h + np.uint64(salt << 50)) * mix
        parts.append(((v ^ (v >> np.uint64(31))) * mix) >> np.uint64(50))
    return np.bincount(np.concatenate(parts).astype(np.int64), minlength=CELLS)


def features(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length feature vector of n-gram counts: its cells, and their values."""
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / counts[at].sum()).astype(np.float32)


def fit_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss) by dual coordinate ascent; y is +1 or -1."""
    draw = np.random.Generator(np.random.PCG64(seed))
    w, bias = np.zeros(CELLS, dtype=np.float64), 0.0
    alpha = np.zeros(len(y))
    norm = [float(v @ v) + 1.0 for _, v in x]
    for _ in range(EPOCHS):
        moved = 0.0
        for i in draw.permutation(len(y)):
            at, value = x[i]
            margin = y[i] * (w[at] @ value + bias)
            new = min(PENALTY, max(0.0, alpha[i] + (1 - margin) / norm[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * value
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class Hierarchy:
    """Family machines and, inside each family, pairwise machines."""

    def __init__(self, languages: list[str], x: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.languages = sorted(languages)
        families = sorted({family_of(s) for s in self.languages})
        self.members = [[s for s in self.languages if family_of(s) == f] for f in families]
        own = np.array([family_of(s) for s in labels]) if len(labels) else np.zeros(0, str)
        heads = []
        self.family_heads = []
        if len(families) > 1:
            for f in families:
                self.family_heads.append(len(heads))
                heads.append(fit_svm(x, np.where(own == f, 1.0, -1.0)))
        self.pair_heads: list[list[tuple[int, int, int]]] = []
        for names in self.members:
            pairs = []
            for i in range(len(names)):
                for j in range(i + 1, len(names)):
                    rows = np.flatnonzero((labels == names[i]) | (labels == names[j]))
                    pairs.append((i, j, len(heads)))
                    heads.append(fit_svm([x[r] for r in rows], np.where(labels[rows] == names[i], 1.0, -1.0)))
            self.pair_heads.append(pairs)
        self.weights = np.array([w for w, _ in heads], dtype=np.float32).reshape(len(heads), CELLS).T.copy()
        self.bias = np.array([b for _, b in heads], dtype=np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of a whole text."""
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        at, value = features(counts)
        margin = value @ self.weights[at] + self.bias
        sure = 1.0
        f = 0
        if self.family_heads:
            own = margin[self.family_heads]
            f = int(own.argmax())
            rest = np.delete(own, f)
            sure = _logistic(float(own[f] - rest.max()))
        names = self.members[f]
        votes, sums, least = np.zeros(len(names)), np.zeros(len(names)), np.full(len(names), np.inf)
        for i, j, head in self.pair_heads[f]:
            m = float(margin[head])
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(names)), key=lambda k: (votes[k], sums[k], -k))
        if len(names) > 1:
            sure *= _logistic(2 * float(least[best]))
        return names[best], sure


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Hierarchy:
    """Fit on a bounded, equal-sized sample of each language of ``docs``."""
    ship_texts(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    labelled = labelled.withColumn("u", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("u", 0.02).alias("n")).collect()}
    if not counts:
        return Hierarchy([], [], np.zeros(0, str))
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} labels are no languages; at most {MOST_LANGUAGES} are learned")
    each = max(1, rows // len(counts))
    # a hash threshold takes about 1.3 times the texts wanted; the first by hash are kept
    span = float(1 << 63)
    bound = F.lit(0.0)
    for name, n in counts.items():
        bound = F.when(F.col("lang") == name, F.lit(min(1.0, 1.3 * each / max(1, n) + 20 / max(1, n)))).otherwise(bound)
    near = labelled.where((F.col("u") + span) / (2 * span) < bound)
    once = near.groupBy("lang", "u").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_, u, index, value = [], [], [], []
            for t, name, place in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "u")), strict=True):
                got = ngram_counts(t)
                if got is None:
                    continue
                at = np.flatnonzero(got)
                lang_.append(name)
                u.append(place)
                index.append(at.astype("<u2").tobytes())
                value.append(got[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang_, pa.string()), pa.array(u, pa.int64()), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                names=["lang", "u", "index", "value"],
            )

    found = once.mapInArrow(run, "lang string, u bigint, index binary, value binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))  # of about 1.3 * each rows
    chosen = found.withColumn("place", place).where(F.col("place") <= each).collect()
    picked = [(r["lang"], (bytes(r["index"]), bytes(r["value"]))) for r in sorted(chosen, key=lambda r: (r["lang"], r["place"]))]
    held = {name for name, _ in picked}
    x = []
    for _, (index, value) in picked:
        dense = np.zeros(CELLS, dtype=np.int64)
        dense[np.frombuffer(index, "<u2").astype(np.int64)] = np.frombuffer(value, "<u4")
        x.append(features(dense))
    return Hierarchy(sorted(held), x, np.array([name for name, _ in picked]))


def predict(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred string, lang_score double``."""
    spark = ship_texts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            got = [found.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([float(s) for _, s in got], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "lang_score"],
            )

    return docs.mapInArrow(run, StructType(list(docs.schema)).add("lang_pred", "string").add("lang_score", "double"))


def held_out():
    """Whether a document is kept out of training: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    plain = docs.select("doc_id", held_out().alias("held_out"), "text")
    shared = predict(plain, model)
    return shared.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is unknown or predicted with little confidence.

    The machines learn from the labelled rows of ``docs`` that are not held out.
    """
    model = train(docs.where(~held_out()))
    own = docs.columns
    clash = [c for c in own if c in ("lang_pred", "lang_score")]
    plain = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    kept = predict(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= MIN_SCORE))
    return kept.drop("lang_pred", "lang_score").withColumnsRenamed({f"__{c}": c for c in clash}).select(*own)
