"""Engines at a rate where filters often lie, with SQL counterparts that hash and probe for themselves.

At this rate the engines differ from the truth and from each other, so every rule shows: which filter
covers an orphan, who lends one, how deep a candidate may lie, what is checked above it, whose filters
are pooled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.hashing import ADD1, ADD2, C1, C2, MIX1, MIX2, bloom_size
from spanloom.operators import range_join, reconstruct
from spanloom.operators.handlers import Scheme
from spanloom.queries.base import ANCHORS, KINDS, WIDE, Entry
from spanloom.session import materialize

CPD, RATE = 5, 0.1
WORD = "18446744073709551616::UHUGEINT"


def _big(x) -> str:
    return f"{int(x)}::UHUGEINT"


def _times(a: str, b) -> str:
    return f"(({a}) * {_big(b)}) % {WORD}"


def _turned(a: str, n: int) -> str:
    return f"(((({a}) << {n}) % {WORD}) | (({a}) >> {64 - n}))"


def _tail() -> int:
    """What a last byte of 1 adds to the first half of the hash."""
    one = int(C1) % (1 << 64)
    one = (one << 31 | one >> 33) % (1 << 64)
    return one * int(C2) % (1 << 64)


def places_sql(m: int, k: int) -> str:
    """``places(id, places)``: the bits of a filter of ``m`` bits that every id sets."""
    letters = lambda first: " + ".join(f"ascii(substr(h, {first + j}, 1))::UHUGEINT * {_big(1 << 8 * j)}" for j in range(8))
    steps = [
        "p0 AS (SELECT DISTINCT span_id AS id, format('{:016x}', span_id) AS h FROM spans)",
        f"p1 AS (SELECT id, {_times(letters(1), C1)} AS a, {_times(letters(9), C2)} AS b FROM p0)",
        f"p2 AS (SELECT id, {_times(_turned('a', 31), C2)} AS a, {_times(_turned('b', 33), C1)} AS b FROM p1)",
        f"p3 AS (SELECT id, ({_turned('a', 27)} * 5::UHUGEINT + {_big(ADD1)}) % {WORD} AS a, {_turned('b', 31)} AS b FROM p2)",
        f"p4 AS (SELECT id, a, ((b + a) * 5::UHUGEINT + {_big(ADD2)}) % {WORD} AS b FROM p3)",
        f"p5 AS (SELECT id, n, xor(xor(a, t), n) AS a, xor(b, n) AS b FROM p4 CROSS JOIN (VALUES ({_big(16)}, {_big(0)}), ({_big(17)}, {_big(_tail())})) x(n, t))",
        f"p6 AS (SELECT id, n, (a + b) % {WORD} AS a, b FROM p5), p7 AS (SELECT id, n, a, (a + b) % {WORD} AS b FROM p6)",
        "p8 AS (SELECT id, n, " + ", ".join(f"{_times(f'xor({x}, {x} >> 33)', MIX1)} AS {x}" for x in "ab") + " FROM p7)",
        "p9 AS (SELECT id, n, " + ", ".join(f"{_times(f'xor({x}, {x} >> 33)', MIX2)} AS {x}" for x in "ab") + " FROM p8)",
        f"pa AS (SELECT id, n, (xor(a, a >> 33) + xor(b, b >> 33)) % {WORD} AS a, xor(b, b >> 33) AS b FROM p9)",
        f"pb AS (SELECT id, n, a, (a + b) % {WORD} AS b FROM pa)",
        "pc AS (SELECT id, max(CASE WHEN n = 16 THEN a END) AS h0, max(CASE WHEN n = 16 THEN b END) AS h1, max(CASE WHEN n = 17 THEN a END) AS h2, max(CASE WHEN n = 17 THEN b END) AS h3 FROM pb GROUP BY id)",
    ]
    probes = ", ".join(f"((h{i % 2} + {i}::UHUGEINT * h{2 + (i + i % 2) % 4 // 2}) % {WORD} % {m}::UHUGEINT)::BIGINT" for i in range(k))
    return ", ".join([*steps, f"places AS (SELECT id, [{probes}] AS places FROM pc)"])


def _kinds(cpd: int) -> str:
    return KINDS.replace("% 3", f"% {cpd}")


def evidence_sql(cpd: int, m: int, k: int, whole: bool) -> str:
    """Survivors, orphans, spans above each one in its window, and every carrier's filter; ``whole``: with itself and the checkpoint."""
    member = "" if whole else f" WHERE at_depth % {cpd} <> 0"
    own = " UNION ALL SELECT trace_id, span_id, span_id FROM drops" if whole else ""
    return (
        WIDE
        + _kinds(cpd)
        + ", "
        + places_sql(m, k)
        + f""", up AS (
  SELECT d.trace_id, d.span_id, p.span_id AS here, p.depth AS at_depth, p.parent_id AS next FROM drops d JOIN drops p ON p.trace_id = d.trace_id AND p.span_id = d.parent_id
  UNION ALL SELECT u.trace_id, u.span_id, p.span_id, p.depth, p.parent_id FROM up u JOIN drops p ON p.trace_id = u.trace_id AND p.span_id = u.next WHERE u.at_depth % {cpd} <> 0
), members AS (SELECT trace_id, span_id, here AS id FROM up{member}{own}
), bits AS (SELECT d.trace_id, d.span_id, d.depth, coalesce(list_distinct(flatten(list(p.places) FILTER (p.places IS NOT NULL))), []::BIGINT[]) AS bits FROM drops d
  LEFT JOIN members x ON x.trace_id = d.trace_id AND x.span_id = d.span_id LEFT JOIN places p ON p.id = x.id WHERE d.carrier GROUP BY ALL
), alive AS (SELECT d.*, p.places FROM drops d JOIN places p ON p.id = d.span_id WHERE NOT dropped
), orphans AS (SELECT o.* FROM alive o WHERE o.parent_id <> 0 AND NOT EXISTS (SELECT 1 FROM alive p WHERE p.trace_id = o.trace_id AND p.span_id = o.parent_id)
), frag AS (SELECT trace_id, span_id AS frag_id, span_id, depth, carrier FROM orphans
  UNION ALL SELECT f.trace_id, f.frag_id, s.span_id, s.depth, s.carrier FROM frag f JOIN alive s ON s.trace_id = f.trace_id AND s.parent_id = f.span_id)"""
    )


def pb_sql(cpd: int = CPD, rate: float = RATE) -> str:
    """``pb``: the covering filter, then the deepest survivor that it holds with all that is named above it."""
    m, k = bloom_size(cpd, rate)
    return (
        evidence_sql(cpd, m, k, whole=True)
        + f""", own AS (SELECT f.trace_id, f.frag_id, f.span_id AS carrier_id FROM frag f JOIN orphans o ON o.trace_id = f.trace_id AND o.span_id = f.frag_id
  WHERE f.carrier AND f.depth <= (o.depth // {cpd} + 1) * {cpd}
  QUALIFY row_number() OVER (PARTITION BY f.trace_id, f.frag_id ORDER BY f.depth, f.span_id) = 1
), lent AS (SELECT o.trace_id, o.span_id AS frag_id, b.span_id AS carrier_id FROM orphans o JOIN bits b ON b.trace_id = o.trace_id
    AND b.depth > o.depth AND b.depth <= (o.depth // {cpd} + 1) * {cpd} AND list_has_all(b.bits, o.places)
  WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.trace_id = o.trace_id AND w.frag_id = o.span_id)
  QUALIFY row_number() OVER (PARTITION BY o.trace_id, o.span_id ORDER BY b.depth, b.span_id) = 1
), cover AS (SELECT trace_id, frag_id, carrier_id, 0::BIGINT AS via FROM own UNION ALL SELECT trace_id, frag_id, carrier_id, carrier_id FROM lent
), above AS (SELECT trace_id, span_id, depth, span_id AS id, parent_id, depth AS at FROM alive
  UNION ALL SELECT a.trace_id, a.span_id, a.depth, a.parent_id, coalesce(p.parent_id, 0), CASE WHEN p.span_id IS NULL THEN 0 ELSE a.at - 1 END FROM above a
  LEFT JOIN alive p ON p.trace_id = a.trace_id AND p.span_id = a.parent_id WHERE a.at % {cpd} <> 0 AND a.parent_id <> 0
), needs AS (SELECT a.trace_id, a.span_id, a.depth, list_distinct(flatten(list(p.places))) AS need FROM above a JOIN places p ON p.id = a.id GROUP BY ALL
), hits AS (SELECT o.trace_id, o.span_id AS orphan_id, c.via, o.depth AS o_depth, n.span_id AS anchor_id, n.depth FROM orphans o
  JOIN cover c ON c.trace_id = o.trace_id AND c.frag_id = o.span_id JOIN bits b ON b.trace_id = c.trace_id AND b.span_id = c.carrier_id
  JOIN needs n ON n.trace_id = o.trace_id AND n.depth BETWEEN (o.depth - 1) // {cpd} * {cpd} AND o.depth - 2 AND list_has_all(b.bits, n.need)
), best AS (SELECT *, count(*) OVER (PARTITION BY trace_id, orphan_id, depth) AS n FROM hits QUALIFY row_number() OVER (PARTITION BY trace_id, orphan_id ORDER BY depth DESC, anchor_id) = 1)
SELECT o.trace_id, o.span_id AS orphan_id, b.anchor_id, (o.depth - b.depth - 1)::INTEGER AS synthetic, coalesce(b.n > 1, false) AS ambiguous, coalesce(b.via, 0)::BIGINT AS via_carrier
FROM orphans o LEFT JOIN best b ON b.trace_id = o.trace_id AND b.orphan_id = o.span_id"""
    )


def windows_sql(pool: bool, lean: bool, cpd: int = CPD, rate: float = RATE, prefix: int = 4) -> str:
    """``pb2`` (``pool``), ``pb1`` and ``pb0`` (``lean``): what all filters of the window confirm."""
    m, k = bloom_size(max(1, cpd - 1), rate)
    shift = 1 << 64 - 8 * prefix
    team = "x.parent_id = y.parent_id" if pool else "x.span_id = y.span_id"
    top = f"CASE WHEN depth % {cpd} = 0 THEN depth - {cpd} ELSE depth // {cpd} * {cpd} END"
    return (
        evidence_sql(cpd, m, k, whole=False)
        + f""", own AS (SELECT trace_id, frag_id, span_id AS carrier_id, depth, false AS borrowed FROM frag WHERE carrier
  QUALIFY row_number() OVER (PARTITION BY trace_id, frag_id ORDER BY depth, span_id) = 1
), lent AS (SELECT o.trace_id, o.span_id AS frag_id, b.span_id AS carrier_id, b.depth, true FROM orphans o JOIN bits b ON b.trace_id = o.trace_id
    AND b.depth > o.depth AND b.depth <= (o.depth // {cpd} + 1) * {cpd} AND list_has_all(b.bits, o.places) JOIN places q ON q.id = o.parent_id AND list_has_all(b.bits, q.places)
  WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.trace_id = o.trace_id AND w.frag_id = o.span_id)
  QUALIFY row_number() OVER (PARTITION BY o.trace_id, o.span_id ORDER BY b.depth, b.span_id) = 1
), cover AS (SELECT * FROM own UNION ALL SELECT * FROM lent
), heads AS (SELECT c.trace_id, c.frag_id, c.carrier_id, c.borrowed, u.here // {shift} AS head, {top.replace("depth", "c.depth")} AS low
  FROM cover c JOIN up u ON u.trace_id = c.trace_id AND u.span_id = c.carrier_id AND u.at_depth % {cpd} = 0
), tops AS (SELECT h.trace_id, h.frag_id, h.carrier_id, h.borrowed, h.low, min(a.span_id) AS top_id, count(*) AS n FROM heads h
  JOIN alive a ON a.trace_id = h.trace_id AND a.depth = h.low AND a.span_id // {shift} = h.head GROUP BY ALL
), pooled AS (SELECT t.trace_id, t.frag_id, b.depth AS at, b.bits FROM tops t JOIN orphans x ON x.trace_id = t.trace_id AND x.span_id = t.frag_id
  JOIN orphans y ON y.trace_id = x.trace_id AND {team} JOIN frag f ON f.trace_id = y.trace_id AND f.frag_id = y.span_id AND f.carrier
  JOIN bits b ON b.trace_id = f.trace_id AND b.span_id = f.span_id AND {top.replace("depth", "b.depth")} = t.low
), filters AS (SELECT * FROM pooled UNION ALL SELECT t.trace_id, t.frag_id, b.depth, b.bits FROM tops t JOIN bits b ON b.trace_id = t.trace_id AND b.span_id = t.carrier_id
  WHERE NOT EXISTS (SELECT 1 FROM pooled p WHERE p.trace_id = t.trace_id AND p.frag_id = t.frag_id)
), asked AS (SELECT t.trace_id, t.frag_id, a.span_id, a.depth, a.places, a.parent_id, a.parent_id = t.top_id AS under, q.places AS up_places FROM tops t
  JOIN orphans o ON o.trace_id = t.trace_id AND o.span_id = t.frag_id JOIN alive a ON a.trace_id = t.trace_id AND a.depth > t.low AND a.depth <= o.depth - 2
    AND NOT (a.carrier AND a.depth % {cpd} <> 0) LEFT JOIN places q ON q.id = a.parent_id
), hits AS (SELECT s.trace_id, s.frag_id, s.span_id, s.depth FROM asked s JOIN filters f ON f.trace_id = s.trace_id AND f.frag_id = s.frag_id GROUP BY ALL
  HAVING bool_and(f.at <= s.depth OR list_has_all(f.bits, s.places)) AND bool_and(s.under OR f.at <= s.depth - 1 OR list_has_all(f.bits, s.up_places))
), best AS (SELECT *, count(*) OVER (PARTITION BY trace_id, frag_id, depth) AS n FROM hits QUALIFY row_number() OVER (PARTITION BY trace_id, frag_id ORDER BY depth DESC, span_id) = 1)
SELECT o.trace_id, o.span_id AS orphan_id, coalesce(b.span_id, t.top_id) AS anchor_id, (o.depth - coalesce(b.depth, t.low) - 1)::INTEGER AS synthetic,
  coalesce(CASE WHEN b.span_id IS NULL THEN t.n > 1 ELSE {"false" if lean else "b.n > 1"} END, false) AS ambiguous, coalesce(CASE WHEN t.borrowed THEN t.carrier_id END, 0)::BIGINT AS via_carrier
FROM orphans o LEFT JOIN tops t ON t.trace_id = o.trace_id AND t.frag_id = o.span_id LEFT JOIN best b ON b.trace_id = t.trace_id AND b.frag_id = t.frag_id"""
    )


def threaded_sql(cpd: int = CPD, rate: float = RATE, prefix: int = 4) -> str:
    """``pcrb``: anchored at the checkpoint that the nearest carrier names, then down while one candidate is left."""
    m, k = bloom_size(max(1, cpd - 1), rate)
    shift = 1 << 64 - 8 * prefix
    top = f"CASE WHEN b.depth % {cpd} = 0 THEN b.depth - {cpd} ELSE b.depth // {cpd} * {cpd} END"
    return (
        evidence_sql(cpd, m, k, whole=False)
        + f""", cover AS (SELECT f.trace_id, f.frag_id, o.depth AS o_depth, o.parent_id, b.span_id AS carrier_id, b.bits, {top} AS low
  FROM frag f JOIN orphans o ON o.trace_id = f.trace_id AND o.span_id = f.frag_id JOIN bits b ON b.trace_id = f.trace_id AND b.span_id = f.span_id
  WHERE f.depth <= (o.depth // {cpd} + 1) * {cpd} QUALIFY row_number() OVER (PARTITION BY f.trace_id, f.frag_id ORDER BY f.depth, f.span_id) = 1
), heads AS (SELECT c.*, u.here // {shift} AS head FROM cover c JOIN up u ON u.trace_id = c.trace_id AND u.span_id = c.carrier_id AND u.at_depth % {cpd} = 0
), tops AS (SELECT h.trace_id, h.frag_id, any_value(h.o_depth) AS o_depth, any_value(h.carrier_id) AS carrier_id, any_value(h.bits) AS bits, any_value(h.low) AS low, min(a.span_id) AS top_id, count(*) AS n
  FROM heads h JOIN alive a ON a.trace_id = h.trace_id AND a.depth = h.low AND a.span_id // {shift} = h.head GROUP BY h.trace_id, h.frag_id
), first AS (SELECT t.trace_id, t.frag_id, s.span_id, s.depth FROM tops t JOIN alive s ON s.trace_id = t.trace_id AND s.parent_id = t.top_id
  UNION ALL SELECT t.trace_id, t.frag_id, o.span_id, o.depth FROM tops t JOIN tops r ON r.trace_id = t.trace_id AND r.top_id = t.top_id AND r.frag_id <> t.frag_id
  JOIN orphans o ON o.trace_id = r.trace_id AND o.span_id = r.frag_id JOIN places q ON q.id = o.parent_id AND list_has_all(t.bits, q.places)
), down AS (SELECT f.trace_id, f.frag_id, f.span_id, f.depth FROM first f JOIN tops t ON t.trace_id = f.trace_id AND t.frag_id = f.frag_id JOIN alive s ON s.trace_id = f.trace_id AND s.span_id = f.span_id
    AND f.span_id <> f.frag_id AND f.depth <= t.o_depth - 2 AND NOT (s.carrier AND s.depth % {cpd} <> 0) AND list_has_all(t.bits, s.places)
  UNION ALL SELECT d.trace_id, d.frag_id, s.span_id, s.depth FROM down d JOIN tops t ON t.trace_id = d.trace_id AND t.frag_id = d.frag_id JOIN alive s ON s.trace_id = d.trace_id AND s.parent_id = d.span_id
    AND s.span_id <> d.frag_id AND s.depth <= t.o_depth - 2 AND NOT (s.carrier AND s.depth % {cpd} <> 0) AND list_has_all(t.bits, s.places)
), levels AS (SELECT trace_id, frag_id, depth, count(*) AS n, min(span_id) AS span_id FROM down GROUP BY ALL
), stop AS (SELECT trace_id, frag_id, min(depth) AS stop FROM levels WHERE n > 1 GROUP BY ALL
), best AS (SELECT l.trace_id, l.frag_id, l.depth, l.span_id FROM levels l LEFT JOIN stop s ON s.trace_id = l.trace_id AND s.frag_id = l.frag_id WHERE l.depth < coalesce(s.stop, 1 << 30)
  QUALIFY row_number() OVER (PARTITION BY l.trace_id, l.frag_id ORDER BY l.depth DESC) = 1)
SELECT o.trace_id, o.span_id AS orphan_id, coalesce(b.span_id, t.top_id) AS anchor_id, (o.depth - coalesce(b.depth, t.low) - 1)::INTEGER AS synthetic, coalesce(t.n > 1, false) AS ambiguous,
  coalesce(CASE WHEN c.carrier_id <> o.span_id THEN c.carrier_id END, 0)::BIGINT AS via_carrier FROM orphans o LEFT JOIN cover c ON c.trace_id = o.trace_id AND c.frag_id = o.span_id
LEFT JOIN tops t ON t.trace_id = o.trace_id AND t.frag_id = o.span_id LEFT JOIN best b ON b.trace_id = t.trace_id AND b.frag_id = t.frag_id"""
    )


def filters_sql(cpd: int, rate: float) -> str:
    """``pb`` payloads byte by byte: type, depth, and the filter of the window with the lowest bit of a byte first."""
    m, k = bloom_size(cpd, rate)
    bytes_ = " || ".join(f"format('{{:02x}}', coalesce(list_sum([1 << (p % 8) for p in b.bits if p // 8 = {j}]), 0)::BIGINT)" for j in range(-(-m // 8)))
    return evidence_sql(cpd, m, k, whole=True) + f" SELECT b.trace_id, b.span_id, '01' || format('{{:02x}}', b.depth) || {bytes_} AS br FROM bits b"


def as_links(sql: str) -> str:
    """An engine's SQL with its rows under the name ``links``, and the true anchors beside them."""
    at = sql.rindex("SELECT o.trace_id")
    return sql[:at].rstrip() + ANCHORS + ", links AS (" + sql[at:] + ")"


COLUMNS = ("trace_id", "orphan_id", "anchor_id", "synthetic", "ambiguous", "via_carrier")


def _truth(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, Scheme]:
    from spanloom.queries.recon import truth_of

    s = Scheme(name, CPD, fp=RATE)
    return truth_of(spark, sf_dir, s), s


def _engine(engine: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, s = _truth(spark, sf_dir, reconstruct.ENGINES[engine])
        return materialize(reconstruct.links(truth.where("not dropped"), engine, s), "links").select(*COLUMNS)

    return run


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, s = _truth(spark, sf_dir, "pb")
    return range_join.links(truth.where("not dropped"), s).select(*COLUMNS)


def entries() -> dict[str, Entry]:
    """All entries by name."""
    return {
        "pb_collisions": Entry(_engine("pb"), pb_sql()),
        "pb_range_join": Entry(_joined, pb_sql()),
        "pb2_collisions": Entry(_engine("pb2"), windows_sql(pool=True, lean=False)),
        "pb1_collisions": Entry(_engine("pb1"), windows_sql(pool=False, lean=False)),
        "pb0_collisions": Entry(_engine("pb0"), windows_sql(pool=False, lean=True)),
        "pcrb_collisions": Entry(_engine("pcrb"), threaded_sql()),
    }
