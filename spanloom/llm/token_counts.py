"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces in a text; dynamic programming over
its characters carries the best score and the piece count of the best path. The rules are those of
the unigram tokenizer: every character may also be taken as unknown, at the lowest score less
``UNKNOWN_PENALTY``, where no single-character piece stands; among equal scores the path whose last
piece starts first wins; unknown characters count as their bytes where the vocabulary has byte
pieces (else a run of them is one token). Scores are added in double precision.

A text starts with the space mark and spaces are marks. No piece has a mark behind another
character, so words are scored on their own (checked when the vocabulary is loaded; otherwise
whole texts are), and a worker remembers the counts of words it has met, up to a bound.

The vocabulary's pieces and scores are read from a tokenizer file; none of the public ones is
trained as a unigram model, so the pieces and scores of ``piece_bpe_32k.model`` are used as one.

Cases: null text and empty text have 0 tokens; very long texts and words are counted whole;
repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import ship, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED_WORDS = 600_000
#: Characters of text whose words are counted together.
BLOCK_CHARS = 2_000_000


class Vocabulary(NamedTuple):
    """Pieces that match text, their scores, and whether bytes stand in for unknown characters."""

    pieces: dict[str, float]
    byte_fallback: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    special = [s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i) for i in range(s.get_piece_size())]
    pieces = {s.id_to_piece(i): float(s.get_score(i)) for i, out in enumerate(special) if not out}
    return Vocabulary(pieces, any(s.is_byte(i) for i in range(s.get_piece_size())))


class Counts:
    """Token counts over one vocabulary; lives as long as its Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        pieces, self.byte_fallback = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Pieces on the best path over a text whose spaces are marks already."""
        n = len(text)
        ends: list[list | None] = [None] * (n + 1)
        for last, piece in self.automaton.iter(text):
            at = ends[last + 1]
            if at is None:
                ends[last + 1] = [piece]
            else:
                at.append(piece)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # the best path ends with an unknown character
        for i in range(1, n + 1):
            best, tokens, from_unknown = None, 0, False
            single = False
            for size, value in ends[i] or ():  # the longest piece first: its start comes first
                got = score[i - size] + value
                if size == 1:
                    single = True
                if best is None or got > best:
                    best, tokens = got, count[i - size] + 1
            if not single:
                got = score[i - 1] + self.unknown
                if best is None or got > best:
                    c = text[i - 1]
                    if self.byte_fallback:
                        tokens = count[i - 1] + len(c.encode("utf-8", "surrogatepass"))
                    else:
                        tokens = count[i - 1] + (not run[i - 1])
                    best, from_unknown = got, True
            score[i], count[i], run[i] = best, tokens, from_unknown
        return count[n]

    def count(self, texts: list[str | None]) -> list[int]:
        """Token count of each text."""
        if not self.by_word:
            return [self.viterbi(MARK + t.replace(" ", MARK)) if t else 0 for t in texts]
        out: list[int] = []
        block: list[list[str]] = []
        chars = 0
        for t in texts:
            block.append(self._words(t) if t else [])
            chars += len(t or "")
            if chars >= BLOCK_CHARS:
                out += self._emit(block)
                block, chars = [], 0
        return out + self._emit(block)

    @staticmethod
    def _words(text: str) -> list[str]:
        """The words of a text, each with the marks in front of it."""
        marked = text.replace(MARK, " ")  # a mark in the text is a space to the tokenizer
        words = marked.split(" ")
        if "" in words:
            held, out = MARK, []
            for w in words[:-1]:
                if w:
                    out.append(held + w)
                    held = MARK
                else:
                    held += MARK
            out.append(held + words[-1])
            return out
        return [MARK + w for w in words]

    def _emit(self, block: list[list[str]]) -> list[int]:
        words = set().union(*block) if block else set()
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = self.viterbi(w)
        get = self.known.__getitem__
        return [sum(map(get, w)) for w in block]


_counts: dict[int, Counts] = {}


def worker_counts(shared) -> Counts:
    """The worker's counter for a broadcast vocabulary."""
    key = id(shared.value)
    if key not in _counts:
        _counts.clear()
        _counts[key] = Counts(shared.value)
        _counts[key].held = shared.value  # keeps the id taken
    return _counts[key]


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens`` of every document."""
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counts(shared)
        for batch in batches:
            n: list[int] = []
            for at in range(0, batch.num_rows, 1000):
                n += counter.count(batch.column("text").slice(at, 1000).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
