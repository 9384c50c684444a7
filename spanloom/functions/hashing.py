"""MurmurHash3 (x64, 128 bits) and the bloom filters of span ids, on whole arrays at once.

Spark's own hash functions and bloom filter use another hash and another probe order, so filters that
are to be read elsewhere are made here. Arrays hold unsigned 64-bit numbers and wrap around.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64

# Multipliers and constants of MurmurHash3 x64 128.
C1, C2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
ADD1, ADD2 = U(0x52DCE729), U(0x38495AB5)
MIX1, MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
# Increment and multipliers of splitmix64.
SPLIT_ADD, SPLIT1, SPLIT2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    for factor in (MIX1, MIX2):
        x = (x ^ (x >> U(33))) * factor
    return x ^ (x >> U(33))


def _words(data: np.ndarray, first: int, end: int) -> np.ndarray:
    """Bytes ``first`` to ``end`` (at most eight) of every row as little-endian numbers."""
    out = np.zeros(len(data), dtype=U)
    for j in range(first, min(end, first + 8)):
        out |= data[:, j].astype(U) << U(8 * (j - first))
    return out


def murmur128(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the hash of every row of an ``(n, length)`` byte array."""
    n, length = data.shape
    one, two = np.full(n, seed, dtype=U), np.full(n, seed, dtype=U)
    whole = length // 16 * 16
    for at in range(0, whole, 16):
        one ^= _turn(_words(data, at, at + 8) * C1, 31) * C2
        one = (_turn(one, 27) + two) * U(5) + ADD1
        two ^= _turn(_words(data, at + 8, at + 16) * C2, 33) * C1
        two = (_turn(two, 31) + one) * U(5) + ADD2
    if length > whole + 8:
        two ^= _turn(_words(data, whole + 8, length) * C2, 33) * C1
    if length > whole:
        one ^= _turn(_words(data, whole, length) * C1, 31) * C2
    one, two = one ^ U(length), two ^ U(length)
    one = one + two
    two = two + one
    one, two = _final(one), _final(two)
    one = one + two
    return one, two + one


def murmur_of(values: list[bytes], seed: int = 0) -> list[tuple[int, int]]:
    """Both halves for byte strings of any length."""
    out: list[tuple[int, int]] = [(0, 0)] * len(values)
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        by_length.setdefault(len(v), []).append(i)
    for length, rows in by_length.items():
        data = np.frombuffer(b"".join(values[i] for i in rows), dtype=np.uint8).reshape(len(rows), length)
        for i, a, b in zip(rows, *(h.tolist() for h in murmur128(data, seed)), strict=True):
            out[i] = (a, b)
    return out


def splitmix64(x: np.ndarray) -> np.ndarray:
    """One step of splitmix64 over every number."""
    z = x.astype(U) + SPLIT_ADD
    z = (z ^ (z >> U(30))) * SPLIT1
    z = (z ^ (z >> U(27))) * SPLIT2
    return z ^ (z >> U(31))


def uniform_of(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the upper 53 bits."""
    return (x >> U(11)).astype(np.float64) / float(1 << 53)


def hex_keys(ids: np.ndarray) -> np.ndarray:
    """The 16 lower-case hex digits of every id as an ``(n, 16)`` byte array: what filters hash."""
    nibbles = (ids.astype(np.int64).view(U)[:, None] >> (U(4) * np.arange(15, -1, -1).astype(U))) & U(15)
    return np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[nibbles.astype(np.int64)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def bloom_size(n: int, p: float, prime: bool = False, byte_cap: bool = False) -> tuple[int, int]:
    """Bits and probes for ``n`` members at false-positive rate ``p``.

    Out-of-range values count as 1000 members and 0.01. ``prime`` takes the next prime number of bits;
    with ``byte_cap`` the prime before, where the next would need a byte more.
    """
    p = p if 0 < p < 1 else 0.01
    n = n if n > 0 else 1000
    m = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    if prime:
        up = next(x for x in range(m, 2 * m + 3) if _is_prime(x))
        if byte_cap and -(-up // 8) > -(-m // 8):
            up = next((x for x in range(m, 1, -1) if _is_prime(x)), 2)
        m = up
    return m, max(1, math.ceil(m / n * math.log(2)))


class Blooms:
    """Bloom filters of one size: ``m`` bits, ``k`` probes, the lowest bit of a byte first."""

    def __init__(self, m: int, k: int):
        if m < 1 or k < 1:
            raise ValueError("a filter needs bits and probes")
        self.m, self.k, self.bytes = m, k, -(-m // 8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The ``k`` bits of every key: four base hashes (of the key, and of the key and a byte 1) in turn."""
        more = np.concatenate([keys, np.ones((len(keys), 1), dtype=np.uint8)], axis=1)
        base = np.stack([*murmur128(keys), *murmur128(more)])
        out = np.empty((len(keys), self.k), dtype=np.int64)
        for i in range(self.k):
            step = base[2 + (i + i % 2) % 4 // 2]
            out[:, i] = ((base[i % 2] + U(i) * step) % U(self.m)).astype(np.int64)
        return out

    def masks(self, ids: np.ndarray) -> np.ndarray:
        """The filter of every span id alone, as an ``(n, bytes)`` array; filters join by bitwise or."""
        return self.masks_of(hex_keys(ids))

    def masks_of(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        out = np.zeros((len(keys), self.bytes), dtype=np.uint8)
        rows = np.arange(len(keys))
        for i in range(self.k):
            np.bitwise_or.at(out, (rows, at[:, i] >> 3), (1 << (at[:, i] & 7)).astype(np.uint8))
        return out

    def read(self, data: bytes | None) -> np.ndarray:
        """A filter from its bytes; one of another length is an empty filter."""
        if not data or len(data) != self.bytes:
            return np.zeros(self.bytes, dtype=np.uint8)
        return np.frombuffer(data, dtype=np.uint8)

    @staticmethod
    def holds(bits: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Whether filters hold the members behind ``masks`` (no false negatives)."""
        return ((bits & masks) == masks).all(axis=-1)

    @staticmethod
    def fill(bits: np.ndarray) -> np.ndarray:
        """Set bits of filters."""
        return np.unpackbits(np.atleast_2d(bits), axis=1).sum(axis=1)


def bloom_of_ids(ids: Column, m: int, k: int) -> Column:
    """A filter (binary) of an array of span ids: a vectorised function over Arrow batches."""

    def made(column: pa.Array) -> pa.Array:
        blooms = Blooms(m, k)
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([0 if x is None else len(x) for x in lists.to_pylist()])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), blooms.bytes), dtype=np.uint8)
        if len(flat):
            np.bitwise_or.at(out, owner, blooms.masks(flat))
        return pa.array([None if x is None else row.tobytes() for x, row in zip(lists.to_pylist(), out, strict=True)], pa.binary())

    return F.arrow_udf(made, "binary")(ids)


def bloom_holds(bits: Column, span_id: Column, m: int, k: int) -> Column:
    """Whether a filter (binary) may hold a span id; null where either is null."""

    def made(column: pa.Array, ids: pa.Array) -> pa.Array:
        blooms = Blooms(m, k)
        here = np.array([b is not None for b in column.to_pylist()]) & np.array([i is not None for i in ids.to_pylist()])
        held = np.stack([blooms.read(b) for b in column.to_pylist()]) if len(column) else np.zeros((0, blooms.bytes), np.uint8)
        keys = np.array([i or 0 for i in ids.to_pylist()], dtype=np.int64)
        return pa.array(blooms.holds(held, blooms.masks(keys)), mask=~here) if len(keys) else pa.array([], pa.bool_())

    return F.arrow_udf(made, "boolean")(bits, span_id)


def id_hex(span_id: Column) -> Column:
    """Sixteen lower-case hex digits of an id."""
    return F.lower(F.lpad(F.hex(span_id), 16, "0"))


def id_bytes(span_id: Column, length: int = 8) -> Column:
    """The first ``length`` of the eight big-endian bytes of an id."""
    return F.substring(F.unhex(id_hex(span_id)), 1, length)


def id_of_hex(text: Column) -> Column:
    """The id behind up to sixteen hex digits, its bits kept in a signed number; null for anything else."""
    ok = text.rlike("^[0-9a-fA-F]{1,16}$")
    return F.conv(F.when(ok, text), 16, -10).cast("long")


def padded_bytes(text: Column, size: int) -> Column:
    """Bytes of a hex string, filled with zeros in front or cut to the last ``size``; null if it is not hex."""
    ok = text.rlike("^([0-9a-fA-F]{2})+$")
    return F.when(ok, F.unhex(F.right(F.lpad(text, F.greatest(F.length(text), F.lit(2 * size)), F.lit("0")), F.lit(2 * size))))


def fingerprint(span_id: Column, bits: int = 16) -> Column:
    """The top bits of an id."""
    return F.shiftrightunsigned(span_id, 64 - bits)


def unsigned(span_id: Column) -> Column:
    """A key that sorts ids as unsigned numbers."""
    return span_id.bitwiseXOR(F.lit(-(1 << 63)))
