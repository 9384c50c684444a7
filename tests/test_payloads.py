"""Hashes and filters by published vectors, wire formats by round trips, payloads against a plain replay."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.functions import hashing, wire
from spanloom.operators import handlers
from spanloom.operators.handlers import Scheme

# Published vectors of MurmurHash3 x64 128 by seed.
MURMUR = {
    0: [
        ("", 0x0, 0x0),
        ("61", 0x85555565F6597889, 0xE6B53A48510E895A),
        ("6162636465666768", 0xCC8A0AB037EF8C02, 0x48890D60EB6940A1),
        ("616263646566676869", 0x0547C0CFF13C7964, 0x79B53DF5B741E033),
        ("6162636465666768696a6b6c6d6e6f70", 0xC4CA3CA3224CB723, 0x4333D695B331EB1A),
        ("6162636465666768696a6b6c6d6e6f7071", 0x7564747F88BDA657, 0xECDA499DA1110DE4),
    ],
    1: [("", 0x4610ABE56EFF5CB5, 0x51622DAA78F83583), ("616263", 0x9C88BE4E9A8A61F0, 0xCA12C88BF31B256C)],
}
# Filters after each of the ids, by members at a rate of 0.0001.
IDS = ["8ee27a115b6fa625", "98655be61af2ecc4", "926ce147adaffad4", "aabbccddeeff0011", "0000000000000000"]
FILTERS = {
    1: ["bba202", "bbbb0b", "bbbb0b", "fbfb0f", "fffb0f"],
    3: ["8080288892200102", "c1bd298892208903", "e3bda9a8b2a88d03", "f7bdf9a9b2b88d03", "f7bdf9b9b2f99d03"],
}
SCHEMA = "trace_id long, span_id long, parent_id long, service string, start_us long, end_us long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ids_of(*texts: str) -> np.ndarray:
    return np.array([signed(int(t, 16)) for t in texts], dtype=np.int64)


@pytest.mark.parametrize("seed", [0, 1])
def test_murmur(seed):
    texts = [bytes.fromhex(h) for h, _, _ in MURMUR[seed]]
    assert hashing.murmur_of(texts, seed) == [(a, b) for _, a, b in MURMUR[seed]]


@pytest.mark.parametrize("n, p, size", [(1, 1e-4, (20, 14)), (10, 1e-3, (144, 10)), (1000, 0.01, (9586, 7)), (5, 1e-4, (96, 14)), (0, 2.0, (9586, 7))])
def test_filter_size(n, p, size):
    assert hashing.bloom_size(n, p) == size


def test_prime_sizes():
    m, _ = hashing.bloom_size(5, 1e-4, prime=True)
    assert m == 97 and hashing.bloom_size(5, 1e-4, prime=True, byte_cap=True)[0] == 89


@pytest.mark.parametrize("n", FILTERS)
def test_filters_grow_by_known_steps(n):
    blooms = hashing.Blooms(*hashing.bloom_size(n, 1e-4))
    bits = np.zeros(blooms.bytes, np.uint8)
    for i, want in zip(ids_of(*IDS), FILTERS[n], strict=True):
        bits |= blooms.masks(np.array([i]))[0]
        assert bits.tobytes().hex() == want
    assert blooms.holds(bits, blooms.masks(ids_of(*IDS))).all()
    assert not blooms.read(b"\xff").any() and (blooms.read(bits.tobytes()) == bits).all()
    assert blooms.fill(bits)[0] == sum(bin(b).count("1") for b in bits)


def test_false_positives_stay_rare():
    """At 58 bits and 14 probes some probes of a key meet; a prime number of bits comes near the nominal rate."""

    def measured(prime):
        draw = np.random.default_rng(1)
        blooms = hashing.Blooms(*hashing.bloom_size(3, 1e-4, prime))
        masks = blooms.masks(draw.integers(0, 1 << 32, 3 * 4000)).reshape(4000, 3, -1)
        other = blooms.masks(draw.integers(0, 1 << 32, 10 * 4000)).reshape(4000, 10, -1)
        return blooms.holds(np.bitwise_or.reduce(masks, axis=1)[:, None, :], other).mean()

    assert measured(False) < 2e-3 and measured(True) < 5e-4


def test_filter_columns(spark):
    from pyspark.sql import functions as F

    m, k = hashing.bloom_size(3, 1e-4)
    rows = spark.createDataFrame([(1, [int(x) for x in ids_of(*IDS[:3])]), (2, []), (3, None)], "id int, ids array<long>")
    made = rows.withColumn("bits", hashing.bloom_of_ids(F.col("ids"), m, k))
    out = {r.id: r.bits and bytes(r.bits).hex() for r in made.collect()}
    assert out == {1: FILTERS[3][2], 2: "00" * 8, 3: None}
    asked = made.withColumn("has", hashing.bloom_holds(F.col("bits"), F.lit(int(ids_of(IDS[1])[0])), m, k))
    assert {r.id: r.has for r in asked.collect()} == {1: True, 2: False, 3: None}


def test_id_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ff",), ("8ee27a115b6fa625",), ("",), ("xyz",), ("11112222333344445",)], "h string")
    got = [r.i for r in rows.select(hashing.id_of_hex(F.col("h")).alias("i")).collect()]
    assert got == [255, signed(0x8EE27A115B6FA625), None, None, None]
    back = rows.select(hashing.id_hex(hashing.id_of_hex(F.col("h"))).alias("t"), hashing.padded_bytes(F.col("h"), 4).alias("b")).collect()
    assert [r.t for r in back[:2]] == ["00000000000000ff", "8ee27a115b6fa625"]
    assert [r.b and bytes(r.b).hex() for r in back] == ["000000ff", "5b6fa625", None, None, None]


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=20), st.integers(1, 64))
def test_bit_runs(values, width):
    low = [v & ((1 << width) - 1) for v in values]
    packed = wire.pack_bits(values, width)
    assert len(packed) == -(-len(values) * width // 8) and wire.unpack_bits(packed, len(values), width) == low


@given(st.integers(0, (1 << 62)))
def test_varints(n):
    assert wire.Reader(wire.varint(n)).varint() == n and wire.varint_size(n) == len(wire.varint(n))


@settings(max_examples=60)
@given(st.integers(1, 9), st.integers(0, 40), st.lists(st.tuples(st.integers(1, 400), st.integers(0, 65535), st.lists(st.integers(0, 300), max_size=3)), max_size=6), st.binary(max_size=5))
def test_breadcrumbs(cpd, depth, levels, rest):
    levels = levels[:depth]
    chain = [wire.Level(o, m if (depth - len(levels) + i) % cpd else None, e) for i, (o, m, e) in enumerate(levels)]
    b = wire.Breadcrumbs(depth, b"abcd", chain, rest)
    data = wire.pack_breadcrumbs(b)
    assert len(data) == wire.breadcrumb_size(b) and wire.read_breadcrumbs(data, cpd) == b


def test_broken_payloads():
    with pytest.raises(ValueError):
        wire.read_breadcrumbs(b"\x05", 3)
    with pytest.raises(ValueError):
        wire.read_payload(b"\x01\x02", "pcr")
    quad = wire.pack_delayed(bytes(16), 300, 0xABCD, [1, 200])
    assert wire.read_delayed(quad * 2) == [(bytes(16), 300, 0xABCD, [1, 200])] * 2
    entry = wire.hash_entry(-1, 300)
    assert wire.hash_entries(entry + entry[:5]) == [(-1, 300)]


def random_tree(n, seed):
    """Spans that start after their parent, with ids of 64 bits."""
    r = random.Random(seed)
    ids = [signed(r.getrandbits(64) | 1) for _ in range(n)]
    rows = [(1, ids[0], 0, "a", 0, 10_000)]
    for i in range(1, n):
        p = r.randrange(max(0, i - 6), i)
        start = rows[p][4] + 1 + r.randrange(9)
        rows.append((1, ids[i], ids[p], r.choice("ab"), start, start + r.randrange(200)))
    return rows


def replay(rows, s: Scheme):
    """Payload bytes of pb, pcr, pcrb and cgprb by walking every path."""
    span = {r[1]: r for r in rows}
    kids = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1] & (1 << 64) - 1)):
        kids.setdefault(r[2], []).append(r[1])
    path = lambda i: [i, *path(span[i][2])] if span[i][2] else [i]
    out = {}
    for i in span:
        up = path(i)
        depth = len(up) - 1
        if i in kids and depth % s.cpd:
            continue
        above = up[1 : 1 + (depth - 1) % s.cpd + 1] if depth else []  # up to the checkpoint above, which comes last
        blooms = hashing.Blooms(*s.filter_size)
        members = [i, *above] if s.name == "pb" else above[:-1]
        bits = np.zeros(blooms.bytes, np.uint8)
        for m in members:
            bits |= blooms.masks(np.array([m]))[0]
        parts = [bytes([wire.TYPES[s.name]]), wire.varint(depth)]
        if s.name != "pb":
            parts.append((above[-1] if above else 0).to_bytes(8, "big", signed=True)[: s.prefix])
        if s.name != "pcr":
            parts.append(bits.tobytes())
        if s.name == "cgprb":
            entry, at = b"", i
            while span[at][2]:
                p = span[at][2]
                place = kids[p].index(at) + 1
                if place == 2:
                    entry = wire.hash_entry(p, len(path(at)) - 1)
                if place > 1 or (len(path(p)) - 1) % s.cpd == 0:
                    break
                at = p
            parts.append(entry)
        out[i] = b"".join(parts)
    return out


@pytest.mark.parametrize("name", ["pb", "pcr", "pcrb", "cgprb"])
@pytest.mark.parametrize("cpd", [1, 3, 4])
def test_payloads_equal_a_replay(spark, name, cpd):
    s = Scheme(name, cpd)
    rows = random_tree(90, 7 + cpd)
    got = {r.span_id: bytes(r.br) for r in handlers.payloads(spark.createDataFrame(rows, SCHEMA), s).where("br is not null").collect()}
    assert got == replay(rows, s)


def test_payload_sizes_follow_the_bytes(spark):
    rows = random_tree(120, 3)
    for name in ("pb", "pcrb", "cgprb", "crumbs"):
        for r in handlers.payloads(spark.createDataFrame(rows, SCHEMA), Scheme(name, 3)).where("br is not null").collect():
            assert r.emit_bytes == len(r.br) + (6 if name == "crumbs" else 3)


def test_odd_traces(spark):
    """A missing parent starts anew, a cycle stands alone, settings out of range are brought into it."""
    rows = [(1, 5, 99, "a", 0, 9), (1, 6, 5, "a", 1, 8), (2, 7, 8, "a", 0, 9), (2, 8, 7, "a", 0, 9), (3, 1, 0, "a", 5, 5)]
    out = {r.span_id: (r.depth, r.calls) for r in handlers.payloads(spark.createDataFrame(rows, SCHEMA), Scheme("pcrb", 0, prefix=99)).collect()}
    assert out == {5: (0, 0), 6: (1, 1), 7: (0, 0), 8: (0, 0), 1: (0, 0)}
    assert handlers.payloads(spark.createDataFrame([], SCHEMA), Scheme("cgprb")).count() == 0
    with pytest.raises(ValueError):
        handlers.payloads(spark.createDataFrame(rows, SCHEMA), Scheme("other"))


def test_delayed_ends_go_to_the_next_start(spark):
    """Three children end after the last one starts: the first two ends wait for the next start on the owner's service."""
    rows = [(1, 1, 0, "a", 0, 50), (1, 2, 1, "b", 1, 20), (1, 3, 1, "b", 2, 30), (1, 4, 1, "b", 3, 40), (2, 9, 0, "b", 55, 60), (2, 10, 9, "a", 58, 59), (3, 1, 0, "a", 70, 80)]
    spans = spark.createDataFrame(rows, SCHEMA)
    s = Scheme("crumbs", 3)
    (quad,) = handlers.delayed_ends(spans, s).collect()
    assert (quad.span_id, quad.service, wire.read_delayed(bytes(quad.quad))[0][3]) == (1, "a", [1, 2])
    (got,) = handlers.picked_up(spans, s).collect()
    assert (got.trace_id, got.span_id, [bytes(x) for x in got.incoming]) == (2, 10, [bytes(quad.quad)])
    full = {(r.trace_id, r.span_id): r.br and bytes(r.br) for r in handlers.with_delayed_ends(spans, s).collect()}
    assert full[2, 10].endswith(bytes(quad.quad)) and not full[3, 1].endswith(bytes(quad.quad))
    assert handlers.large_pickups(spans, s, 5).count() == 1 and handlers.large_pickups(spans, s, 500).count() == 0


def test_next_starts_read_each_slice_once(spark):
    """A frame that reaches to a slice's end is summed anew for every row of it."""
    starts = spark.createDataFrame([("a", 5, 0, 1, 1), ("a", 5, 1, 1, 2), ("a", 9, 0, 2, 1)], "service string, ts long, depth int, trace_id long, span_id long")
    queued = spark.createDataFrame([("a", 5, 0, 7, 7), ("a", 9, 0, 7, 8)], starts.schema)
    got = handlers.next_start(queued, starts, slice_us=4)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    assert {(r.trace_id, r.span_id, r.next_trace, r.next_span) for r in got.collect()} == {(7, 7, 2, 1), (7, 8, None, None)}
