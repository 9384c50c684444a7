"""Byte-level BPE by corpus-level merge replay.

The distinct pre-tokens of a block of documents form the corpus. An inverted index maps the
rank of a mergeable token pair to the word positions where it occurs; merges are replayed in
rank order over the whole corpus at once, and each merge updates only the two neighbouring
pairs it touches. Words already replayed by a worker are kept in a bounded table, so frequent
words are replayed once per worker.

Digests are taken where the ids are made: neither decoded texts nor, for the query, ids travel
back to the JVM. Rows leave a worker in slices bounded by the characters they hold.

Cases: null text counts as empty; empty text gives no ids (hash of the empty string); texts of
any length are encoded whole; repeated rows and rows that share an id each give a row; a null id
stays null; an empty table gives no rows; extra input columns are ignored by the query and by
:func:`encode_corpus` and kept by :func:`encode_documents`, whose own columns replace those of
the same names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm.batches import ship_texts
from spanloom.session import table

#: Bytes that a worker's table of replayed words may take (estimated); beyond it the table starts anew.
REMEMBERED_BYTES = 128 << 20
#: What an entry of that table takes besides its characters and ids.
ENTRY_BYTES = 200
#: Characters of text whose new words form one replayed corpus, and which leave the worker together.
BLOCK_CHARS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Merges:
    """The merge rules of a rank table, and tables of its one- and two-byte tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.one = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.two = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32 bits) of each word, all words merged together.

        The corpus is the words joined by walls, which no pair spans. A part is known by its
        first byte's position; ``after``/``before`` link the live parts. ``index`` maps a rank to
        the positions of its pairs and is replayed lowest rank first, each rank from left to
        right. A word that is a token itself is that token. Where a merge gives its word a pair
        of a lower rank, the word's remaining positions of this rank wait for their turn.
        """
        get = self.ranks.get
        out = [b""] * len(words)
        todo = []
        for i, w in enumerate(words):
            rank = get(w)
            if rank is None:
                todo.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        if not todo:
            return out
        text = b"\0" + b"".join([words[i] + b"\0" for i in todo])
        n = len(text)
        raw = np.frombuffer(text, dtype=np.uint8)
        sizes = np.array([len(words[i]) for i in todo], dtype=np.int64)
        walls = np.concatenate([[0], np.cumsum(sizes + 1)])
        mark = np.zeros(n, dtype=np.uint8)
        mark[walls] = 1
        wall = mark.tobytes()
        token = self.one[raw]
        token[walls] = -1
        joined = np.full(n, -1, dtype=np.int64)
        joined[:-1] = self.two[(raw[:-1].astype(np.int64) << 8) | raw[1:]]
        joined[:-1][(mark[:-1] | mark[1:]) > 0] = -1
        places = np.flatnonzero(joined >= 0)
        places = places[np.argsort(joined[places], kind="stable")]
        found, first = np.unique(joined[places], return_index=True)
        index = {r: x.tolist() for r, x in zip(found.tolist(), np.split(places, first[1:]), strict=True)} if len(places) else {}
        pair, token = joined.tolist(), token.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = found.tolist()
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            here = index.pop(rank, None)
            if here is None:
                continue
            here.sort()
            held, later = -1, []
            for p in here:
                if pair[p] != rank:
                    continue
                if p < held:
                    later.append(p)
                    continue
                mid = after[p]
                end = after[p] = after[mid]
                token[p] = rank
                token[mid] = pair[mid] = -1
                left = before[p]
                r = -1
                if not wall[end]:
                    before[end] = p
                    r = get(text[p : after[end]], -1)
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            push(heap, r)
                pair[p] = r
                if not wall[left]:
                    q = pair[left] = get(text[left:end], -1)
                    if q >= 0:
                        if q in index:
                            index[q].append(left)
                        else:
                            index[q] = [left]
                            push(heap, q)
                        if q < rank:
                            r = q
                if 0 <= r < rank:
                    held = text_end(walls, p)
            if later:
                if rank in index:
                    index[rank].extend(later)
                else:
                    index[rank] = later
                    push(heap, rank)
        ids = np.array(token, dtype=np.int64)
        live = ids >= 0
        ends = np.concatenate([[0], np.cumsum(live)])[walls] * 4
        held = ids[live].astype("<u4").tobytes()
        for i, a, b in zip(todo, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = held[a:b]
        return out


def text_end(walls: np.ndarray, place: int) -> int:
    """The wall behind the word that holds ``place``."""
    return int(walls[np.searchsorted(walls, place, side="right")])


class Encoder:
    """Whole-text encoder and decoder over one rank table; lives as long as its Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges = Merges(ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def learn(self, pieces: list[list[str]]) -> None:
        """Replay the merges over the words of ``pieces`` that are not known yet."""
        words = set().union(*pieces) if pieces else set()
        if self.held > REMEMBERED_BYTES:
            self.known, self.held = {}, 0
        new = [w for w in words if w not in self.known]
        ids = self.merges.replay([w.encode() for w in new])
        self.known.update(zip(new, ids, strict=True))
        self.held += sum(map(len, new)) + sum(map(len, ids)) + ENTRY_BYTES * len(new)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append(self.find(text or ""))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                out += self._emit(block)
                block, chars = [], 0
        return out + self._emit(block)

    def _emit(self, block: list[list[str]]) -> list[bytes]:
        self.learn(block)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in block]

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[tuple[int, str], Encoder] = {}  # an encoder holds its table, so the id stays taken


def worker_encoder(shared, pattern: str) -> Encoder:
    """The worker's encoder for a broadcast rank table."""
    key = (id(shared.value), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Start and texts of runs of rows that hold about ``BLOCK_CHARS`` characters; a long text is a run of its own."""
    first, held, chars = 0, [], 0
    for at, text in enumerate(texts):
        held.append(text.as_py())
        chars += len(held[-1] or "")
        if chars >= BLOCK_CHARS:
            yield first, held
            first, held, chars = at + 1, [], 0
    if held:
        yield first, held


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` plus ``n_tokens, token_ids`` (if ``ids``), ``ids_sha256, decoded_sha256``.

    The rank table is broadcast; its size is that of a tokenizer file, never of the data.
    """
    spark = ship_texts(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ranks)
    own = {"n_tokens": "long", "token_ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    if not ids:
        del own["token_ids"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    schema = StructType([docs.schema[c] for c in kept])
    for name, kind in own.items():
        schema = schema.add(name, kind)
    sent = kept if text in kept else [*kept, text]
    place = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, pattern)
        for batch in batches:
            for at, texts in _slices(batch.column(place)):
                made = encoder.encode(texts)
                columns = [
                    pa.array([len(x) // 4 for x in made], pa.int64()),
                    *([pa.array(made, pa.binary())] if ids else []),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in made], pa.string()),
                ]
                rows = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rows, *columns], names=[*kept, *own])

    return docs.select(*sent).mapInArrow(run, schema)


def digest_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    return encode_documents(docs, ranks, pattern, keep=["doc_id"], ids=False)


def encode_corpus(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, source, n_tokens, token_ids, ids_sha256, decoded_sha256`` of every row of ``docs``."""
    return encode_documents(docs, ranks, pattern, keep=["doc_id", "source"])


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Rank table and pattern of a public tokenizer."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    return digest_documents(table(spark, sf_dir, "documents"), *tokenizer())
