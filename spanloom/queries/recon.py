"""Queries of payloads, losses, reconstruction, scores and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import hashing
from spanloom.operators import (  # noqa: F401 (the ledgers add their engines)
    certificates,
    event_order,
    fanouts,
    handlers,
    ledger,
    loss,
    map_engine,
    reconstruct,
    scoring,
    structure,
    windows,
)
from spanloom.operators.handlers import Scheme
from spanloom.queries import collisions
from spanloom.queries.base import ANCHORS, DEEP, EVENTS, KINDS, START, WIDE, Entry
from spanloom.session import materialize
from spanloom.sources.views import heap_spans, wide_spans

CPD = 3
#: At this rate filters of the test tables hold no id by accident, so the truth is the answer.
RARE = 1e-9
METRICS = (
    "num_spans", "num_checkpoint_spans", "checkpoint_sum", "max_checkpoint_payload", "num_baggage_calls", "baggage_sum", "max_baggage_call",
    "num_depth_spans", "depth_overhead_sum", "amortized_by_total", "amortized_by_checkpoint", "avg_baggage_call",
)

VARINT = "(1 + (({0}) >= 128)::INT + (({0}) >= 16384)::INT)"
SEQ = """, ordered AS (SELECT *, CASE WHEN parent_id = 0 THEN 0 ELSE
  row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) END AS seq FROM spans)"""
BLOOM = "ceil(ceil(-{n} * ln({p}) / (ln(2) * ln(2))) / 8)::BIGINT"
VL, VLC = VARINT.format("depth"), VARINT.format("s.seq")
VLD = VARINT.format("t.depth + 1")

SIZES_SQL = (
    START
    + SEQ
    + f""", tree AS (
  SELECT *, 0 AS depth, 0 AS ha, 0 AS e FROM ordered WHERE parent_id = 0
  UNION ALL
  SELECT s.*, t.depth + 1, t.ha + CASE WHEN s.seq = 2 THEN 8 + {VLD} ELSE 0 END,
    CASE WHEN s.seq = 2 THEN 8 + {VLD} WHEN s.seq = 1 AND t.depth % 3 <> 0 THEN t.e ELSE 0 END
  FROM ordered s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id
), kinds AS (
  SELECT t.*, k.parent_id IS NULL OR t.depth % 3 = 0 AS carrier FROM tree t
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) k ON k.trace_id = t.trace_id AND k.parent_id = t.span_id
), sizes AS (
  SELECT trace_id, span_id, parent_id, depth, scheme, carrier AND scheme <> 'vanilla' AS emits,
    CASE WHEN scheme = 'vanilla' OR NOT carrier THEN 0 ELSE 3 + tag + {VL} + body +
      CASE scheme WHEN 'cgpb' THEN ha WHEN 'cgprb' THEN e ELSE 0 END END AS emit,
    CASE WHEN scheme = 'vanilla' OR carrier THEN 0 ELSE 2 + {VL} END AS own,
    CASE WHEN scheme = 'vanilla' OR parent_id = 0 THEN 0 ELSE 3 + {VL} + body +
      CASE WHEN scheme = 'cgpb' THEN ha WHEN scheme = 'cgprb' AND depth % 3 <> 0 THEN e ELSE 0 END END AS call
  FROM kinds CROSS JOIN (VALUES ('vanilla', 0, 0), ('pb', 1, {BLOOM.format(n=3, p=0.0001)}), ('cgpb', 2, {BLOOM.format(n=3, p=0.0001)}),
    ('pcr', 1, 4), ('pcrb', 1, 4 + {BLOOM.format(n=2, p=0.0001)}), ('cgprb', 1, 4 + {BLOOM.format(n=2, p=0.0001)})) s(scheme, tag, body)
)
SELECT trace_id, scheme, count(*) AS num_spans, count(*) FILTER (emits) AS num_checkpoint_spans, sum(emit)::BIGINT AS checkpoint_sum,
  max(emit)::BIGINT AS max_checkpoint_payload, count(*) FILTER (call > 0) AS num_baggage_calls, sum(call)::BIGINT AS baggage_sum,
  max(call)::BIGINT AS max_baggage_call, count(*) FILTER (own > 0) AS num_depth_spans, sum(own)::BIGINT AS depth_overhead_sum,
  coalesce(sum(emit)::DOUBLE / count(*), 0) AS amortized_by_total,
  CASE WHEN count(*) FILTER (emits) = 0 THEN 0::DOUBLE ELSE sum(emit)::DOUBLE / count(*) FILTER (emits) END AS amortized_by_checkpoint,
  CASE WHEN count(*) FILTER (call > 0) = 0 THEN 0::DOUBLE ELSE sum(call)::DOUBLE / count(*) FILTER (call > 0) END AS avg_baggage_call
FROM sizes GROUP BY trace_id, scheme"""
)

BREADCRUMB_SQL = (
    START
    + SEQ
    + f""", tree AS (
  SELECT *, 0 AS depth, 0 AS levels, 0 AS ords, 0 AS kept, 0 AS kept_ords FROM ordered WHERE parent_id = 0
  UNION ALL
  SELECT s.*, t.depth + 1, t.kept + 1, t.kept_ords + {VLC}, CASE WHEN (t.depth + 1) % 3 = 0 THEN 0 ELSE t.kept + 1 END,
    CASE WHEN (t.depth + 1) % 3 = 0 THEN 0 ELSE t.kept_ords + {VLC} END
  FROM ordered s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id
), kinds AS (
  SELECT t.*, k.parent_id IS NULL OR t.depth % 3 = 0 AS carrier FROM tree t
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) k ON k.trace_id = t.trace_id AND k.parent_id = t.span_id
)
SELECT trace_id, span_id,
  (CASE WHEN carrier THEN 6 + {VL} + 1 + ords + 4 + 2 * greatest(levels - 1, 0) + levels ELSE 0 END)::BIGINT AS emit_bytes,
  (CASE WHEN parent_id = 0 THEN 0 ELSE 3 + {VL} + 1 + kept_ords + 4 + 2 * greatest(kept - 1, 0) + kept END)::BIGINT AS baggage_bytes,
  (CASE WHEN carrier THEN 0 ELSE 3 + {VL} + {VARINT.format("seq")} END)::BIGINT AS order_bytes
FROM kinds"""
)

CHECKPOINTS = """, up AS (
  SELECT d.trace_id, d.span_id, p.span_id AS here, p.depth AS at_depth, p.parent_id AS next
  FROM drops d JOIN drops p ON p.trace_id = d.trace_id AND p.span_id = d.parent_id
  UNION ALL
  SELECT u.trace_id, u.span_id, p.span_id, p.depth, p.parent_id
  FROM up u JOIN drops p ON p.trace_id = u.trace_id AND p.span_id = u.next WHERE u.at_depth % 3 <> 0
), ckpts AS (SELECT trace_id, span_id, here AS ckpt_id FROM up WHERE at_depth % 3 = 0)"""
#: Anchors by the prefix of the checkpoint that the nearest carrier names; ``{shift}`` cuts an id to its prefix.
PREFIX = (
    CHECKPOINTS
    + """, alive AS (SELECT * FROM drops WHERE NOT dropped
), orphans AS (SELECT o.* FROM alive o WHERE o.parent_id <> 0 AND NOT EXISTS (SELECT 1 FROM alive p WHERE p.trace_id = o.trace_id AND p.span_id = o.parent_id)
), down AS (
  SELECT trace_id, span_id AS orphan_id, depth AS o_depth, span_id AS here, depth, carrier FROM orphans
  UNION ALL
  SELECT w.trace_id, w.orphan_id, w.o_depth, s.span_id, s.depth, s.carrier FROM down w JOIN alive s ON s.trace_id = w.trace_id AND s.parent_id = w.here
  WHERE NOT w.carrier AND s.depth <= (w.o_depth // 3 + 1) * 3
), near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, orphan_id ORDER BY depth, here) AS place FROM down WHERE carrier) WHERE place = 1
), named AS (
  SELECT n.trace_id, n.orphan_id, n.o_depth, n.here, CASE WHEN n.depth % 3 = 0 THEN n.depth - 3 ELSE n.depth // 3 * 3 END AS top, c.ckpt_id // {shift} AS head
  FROM near n JOIN ckpts c ON c.trace_id = n.trace_id AND c.span_id = n.here
), hits AS (
  SELECT n.trace_id, n.orphan_id, any_value(n.o_depth) AS o_depth, any_value(n.here) AS here, min(a.span_id) AS anchor_id, count(*) AS n, any_value(n.top) AS top
  FROM named n JOIN alive a ON a.trace_id = n.trace_id AND a.depth = n.top AND a.span_id // {shift} = n.head GROUP BY n.trace_id, n.orphan_id
), links AS (
  SELECT o.trace_id, o.span_id AS orphan_id, h.anchor_id, (h.o_depth - h.top - 1)::INTEGER AS synthetic, coalesce(h.n > 1, false) AS ambiguous,
    coalesce(CASE WHEN r.here <> o.span_id THEN r.here END, 0)::BIGINT AS via_carrier
  FROM orphans o LEFT JOIN hits h ON h.trace_id = o.trace_id AND h.orphan_id = o.span_id LEFT JOIN near r ON r.trace_id = o.trace_id AND r.orphan_id = o.span_id
)"""
)
GRADED = """, paths AS (
  SELECT d.trace_id, d.span_id, d.parent_id AS a, 1 AS distance FROM drops d WHERE d.parent_id <> 0
  UNION ALL SELECT p.trace_id, p.span_id, d.parent_id, p.distance + 1 FROM paths p JOIN drops d ON d.trace_id = p.trace_id AND d.span_id = p.a WHERE d.parent_id <> 0
), graded AS (
  SELECT b.trace_id, b.orphan_id, b.anchor_id, b.synthetic, b.ambiguous, b.via_carrier, t.anchor_id AS true_anchor, t.gap,
    (SELECT p.distance FROM paths p WHERE p.trace_id = b.trace_id AND p.span_id = b.orphan_id AND p.a = b.anchor_id) AS anchor_at
  FROM links b JOIN anchors t ON t.trace_id = b.trace_id AND t.span_id = b.orphan_id
), skips AS (
  SELECT g.trace_id, g.orphan_id, count(*) AS skipped FROM graded g JOIN paths p ON p.trace_id = g.trace_id AND p.span_id = g.orphan_id AND p.distance < g.anchor_at
  JOIN drops d ON d.trace_id = p.trace_id AND d.span_id = p.a AND NOT d.dropped GROUP BY ALL
)"""
SCORE_SQL = """ SELECT d.trace_id, any_value(d.spans) AS spans, any_value(d.gone)::BIGINT AS dropped, count(g.orphan_id) AS orphans,
  count(g.anchor_id) AS reconnected, count(g.orphan_id) - count(g.anchor_id) AS unanchored,
  count(*) FILTER (g.anchor_id = g.true_anchor) AS anchor_correct, count(*) FILTER (g.anchor_at IS NOT NULL) AS anchor_ancestor,
  count(*) FILTER (g.anchor_id = g.true_anchor AND g.synthetic = g.gap) AS gap_correct,
  count(*) FILTER (g.anchor_id <> g.true_anchor) AS misattached, count(*) FILTER (g.anchor_id <> g.true_anchor AND g.anchor_at IS NOT NULL) AS misattached_ancestor,
  count(*) FILTER (g.anchor_id IS NOT NULL AND g.ambiguous) AS ambiguous, count(*) FILTER (g.ambiguous AND g.anchor_id <> g.true_anchor) AS ambiguous_bad,
  count(*) FILTER (g.anchor_id IS NOT NULL AND g.via_carrier <> 0) AS borrowed, coalesce(sum(g.synthetic), 0)::BIGINT AS synthetic,
  coalesce(sum(s.skipped), 0)::BIGINT AS ancestors_skipped
FROM (SELECT trace_id, count(*) AS spans, count(*) FILTER (dropped) AS gone FROM drops GROUP BY trace_id) d
LEFT JOIN graded g ON g.trace_id = d.trace_id LEFT JOIN skips s ON s.trace_id = g.trace_id AND s.orphan_id = g.orphan_id GROUP BY d.trace_id"""

SUMMED = (
    "spans", "dropped", "orphans", "reconnected", "unanchored", "anchor_correct", "anchor_ancestor", "gap_correct", "misattached", "misattached_ancestor",
    "ambiguous", "ambiguous_bad", "borrowed", "synthetic", "ancestors_skipped",
)
TOTALS_SQL = (
    " SELECT count(*) AS traces, "
    + ", ".join(f"sum({c})::BIGINT AS {c}" for c in SUMMED)
    + """, round(100.0::DOUBLE * sum(reconnected) / sum(orphans), 6) AS reconnected_pct, round(100.0::DOUBLE * sum(anchor_correct) / sum(reconnected), 6) AS exact_pct,
  round(100.0::DOUBLE * sum(misattached_ancestor) / sum(reconnected), 6) AS benign_pct,
  round(100.0::DOUBLE * (sum(misattached) - sum(misattached_ancestor)) / sum(reconnected), 6) AS wrong_pct,
  round(100.0::DOUBLE * avg((misattached = 0)::INT), 6) AS clean_trace_pct FROM s"""
)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_spans(heap_spans(spark, sf_dir))


def truth_of(spark: SparkSession, sf_dir: str, scheme: Scheme) -> DataFrame:
    """The whole trace table with depth, carrier, dropped and payloads, written once."""
    spans = wide(spark, sf_dir)
    d = loss.with_drops(spans, cpd=scheme.cpd)
    p = handlers.payloads(spans, scheme).select("trace_id", "span_id", "br")
    return materialize(d.join(p, ["trace_id", "span_id"]), "recon-truth")


def rebuilt(spark: SparkSession, sf_dir: str, engine: str, scheme: Scheme, **options) -> tuple[DataFrame, DataFrame]:
    """``truth`` and ``links`` of an engine."""
    truth = truth_of(spark, sf_dir, Scheme(**{**scheme.__dict__, "name": reconstruct.ENGINES[engine]}))
    return truth, materialize(reconstruct.links(truth.where("not dropped"), engine, scheme, **options), "recon-links")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = heap_spans(spark, sf_dir)
    out = None
    for name in ("vanilla", "pb", "cgpb", "pcr", "pcrb", "cgprb"):
        part = handlers.trace_metrics(handlers.payloads(spans, Scheme(name, CPD))).select("trace_id", F.lit(name).alias("scheme"), *METRICS)
        out = part if out is None else out.unionByName(part)
    return out


def _window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of all schemes that stay in their window, from payloads made window by window."""
    spans = heap_spans(spark, sf_dir)
    out = None
    for name in windows.SCHEMES:
        part = handlers.trace_metrics(windows.payloads(spans, Scheme(name, CPD))).select("trace_id", F.lit(name).alias("scheme"), *METRICS)
        out = part if out is None else out.unionByName(part)
    return out


def _prefix_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scheme("pcr", CPD, prefix=1)
    alive = truth_of(spark, sf_dir, s).where("not dropped")
    return windows.prefix_links(alive, s).select("trace_id", "orphan_id", "anchor_id", "synthetic", "ambiguous", "via_carrier")


def _links(engine: str, columns: tuple[str, ...], options: dict | None = None, **settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rebuilt(spark, sf_dir, engine, Scheme(cpd=CPD, **settings), **(options or {}))[1].select(*columns)

    return run


def _true_links(engine: str, **options) -> Entry:
    """An engine whose filters make no mistake: its links are the truth."""
    return Entry(
        _links(engine, ("trace_id", "orphan_id", "anchor_id", "synthetic"), options, fp=RARE, prime=True),
        WIDE + KINDS + ANCHORS + " SELECT trace_id, span_id AS orphan_id, anchor_id, gap::INTEGER AS synthetic FROM anchors",
    )


def _scored(engine: str, measure, **settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, b = rebuilt(spark, sf_dir, engine, Scheme(cpd=CPD, **settings))
        return measure(b, truth)

    return run


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scheme("crumbs", CPD)
    spans = materialize(wide(spark, sf_dir), "wide")  # read by every step below
    p = handlers.with_delayed_ends(spans, s).select("trace_id", "span_id", "br")
    order = structure.sibling_ordinals(spans).withColumnRenamed("seq", "ordinal")
    d = loss.with_drops(spans).join(p, ["trace_id", "span_id"]).join(order, ["trace_id", "span_id"])
    return reconstruct.breadcrumb_trees(d, s).select("trace_id", "solved", "nodes", "known", "survivors", "ambiguous", "no_place", "embeds", "exact")


def _tree_identity(fp: float, engine: str, **settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Scheme("cgprb", CPD, fp=fp, **settings)
        truth = truth_of(spark, sf_dir, s)
        return scoring.tree_identity(materialize(fanouts.trees(truth.where("not dropped"), s, engine), "trees"), truth)

    return run


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scheme("crumbs", CPD)
    # ends can be told only where children end before their parents
    spans = materialize(wide_spans(structure.clip(heap_spans(spark, sf_dir))), "nested")
    p = handlers.payloads(spans, s).select("trace_id", "span_id", "br")
    quads = handlers.delayed_ends(spans, s).select("trace_id", "span_id", "quad")
    ends = structure.ordered_events(spans).where("kind = 1").select("trace_id", "span_id", F.col("pos").alias("end_pos"))
    order = structure.sibling_ordinals(spans).withColumnRenamed("seq", "ordinal")
    d = loss.with_drops(spans)
    for part in (p, ends, order):
        d = d.join(part, ["trace_id", "span_id"])
    return event_order.orders(d.join(quads, ["trace_id", "span_id"], "left"), s)


def _certificates(engine: str, cpd: int, fp: float):
    """Every cluster that an engine solved, judged by itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Scheme("pcrb", cpd, fp=fp)
        dump = materialize(certificates.clusters(truth_of(spark, sf_dir, s).where("not dropped"), engine, s), "clusters")
        return certificates.certify(dump)

    return run


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breadcrumb_outcomes(_trees(spark, sf_dir))


def _sound(measure):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        truth, b = rebuilt(spark, sf_dir, "pcrb", Scheme("pcrb", CPD))
        return measure(truth.where("not dropped"), b)

    return run


def _planted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checker says of true links with one fault in seven traces of eight, by trace id."""
    truth, b = rebuilt(spark, sf_dir, "pcrb", Scheme("pcrb", CPD, fp=RARE, prime=True))
    first = materialize(b.groupBy("trace_id").agg(F.min("orphan_id").alias("orphan_id")), "firsts").withColumn("fault", F.col("trace_id") % 8)
    rows = b.join(first, ["trace_id", "orphan_id"], "left").na.fill(0, ["fault"])
    is_ = lambda k: F.col("fault") == k
    gap = F.when(is_(1), F.col("synthetic") + 1).when(is_(5), F.lit(0)).otherwise(F.col("synthetic"))
    copies = F.explode(F.when(is_(3), F.array(F.lit(0), F.lit(1))).when(is_(4), F.array().cast("array<int>")).otherwise(F.array(F.lit(0))))
    links = rows.withColumn("synthetic", gap).withColumn("anchor_id", F.when(is_(2), F.lit(5)).otherwise(F.col("anchor_id"))).select(*b.columns, copies).drop("col")
    alive = truth.where("not dropped").join(first.withColumnRenamed("orphan_id", "span_id"), ["trace_id", "span_id"], "left").na.fill(0, ["fault"])
    twice = F.explode(F.when(is_(7), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    alive = alive.withColumn("depth", F.col("depth") + is_(6).cast("int")).select(*truth.columns, twice).drop("col")
    return scoring.violations(alive, links)


PLANTED = """, o AS (SELECT trace_id, min(span_id) AS span_id, trace_id % 8 AS fault FROM anchors GROUP BY trace_id)
SELECT trace_id, kind, span_id FROM o JOIN (VALUES (1, 'depth-arith'), (2, 'dangling'), (3, 'dup-link'), (4, 'disposition'), (5, 'spacing'), (5, 'depth-arith'), (6, 'depth-arith'), (7, 'dup-span')) f(f, kind) ON f.f = o.fault
UNION ALL SELECT d.trace_id, 'edge-depth', d.span_id FROM o JOIN drops d ON d.trace_id = o.trace_id AND d.parent_id = o.span_id WHERE o.fault = 6 AND NOT d.dropped
UNION ALL SELECT a.trace_id, 'depth-arith', a.span_id FROM o JOIN anchors a ON a.trace_id = o.trace_id AND a.anchor_id = o.span_id WHERE o.fault = 6"""


def _planted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replay of the payloads says of true links of which one in every trace was moved.

    In even traces to the root, in odd ones to another checkpoint of the window's level.
    """
    s = Scheme("pcr", CPD)
    truth, b = rebuilt(spark, sf_dir, "pcr", s)
    alive = truth.where("not dropped")
    first = b.where("anchor_id is not null").groupBy("trace_id").agg(F.min("orphan_id").alias("orphan_id"))
    at = alive.select("trace_id", F.col("span_id").alias("anchor_id"), F.col("depth").alias("level"))
    picked = b.join(first, ["trace_id", "orphan_id"]).join(at, ["trace_id", "anchor_id"])
    beside = alive.select("trace_id", "span_id", F.col("depth").alias("level"))
    other = picked.join(beside, ["trace_id", "level"]).where("span_id <> anchor_id").groupBy("trace_id", "orphan_id").agg(F.min("span_id").alias("other"))
    roots = alive.where("parent_id = 0").select("trace_id", F.col("span_id").alias("root_id"))
    moved = F.when(F.col("trace_id") % 2 == 0, F.col("root_id")).otherwise(F.coalesce("other", "anchor_id"))
    links = picked.join(other, ["trace_id", "orphan_id"], "left").join(roots, "trace_id").withColumn("anchor_id", moved).select(*b.columns)
    rest = b.join(first, ["trace_id", "orphan_id"], "left_anti")
    return scoring.evidence(alive, rest.unionByName(links), s)


MOVED = """, o AS (SELECT trace_id, min(orphan_id) AS orphan_id FROM links WHERE anchor_id IS NOT NULL GROUP BY trace_id
), m AS (SELECT l.trace_id, l.orphan_id, l.anchor_id, n.top FROM o JOIN links l ON l.trace_id = o.trace_id AND l.orphan_id = o.orphan_id JOIN named n ON n.trace_id = l.trace_id AND n.orphan_id = l.orphan_id)
SELECT trace_id, 'window' AS kind, orphan_id AS span_id FROM m WHERE trace_id % 2 = 0 AND top > 0
UNION ALL SELECT trace_id, 'prefix', orphan_id FROM m WHERE trace_id % 2 <> 0 AND EXISTS (SELECT 1 FROM alive a WHERE a.trace_id = m.trace_id AND a.depth = m.top AND a.span_id <> m.anchor_id)"""


def _parents_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per trace: how often a fragment's anchor is right, and the anchor's own place of the anchor's fragment too."""
    s = Scheme("pcr", CPD, prefix=1)
    truth, b = rebuilt(spark, sf_dir, "pcr", s)
    return scoring.two_steps(b, truth)


TWO_STEPS = """, f AS (SELECT trace_id, span_id, span_id AS frag_id FROM alive a WHERE parent_id = 0 OR NOT EXISTS (SELECT 1 FROM alive p WHERE p.trace_id = a.trace_id AND p.span_id = a.parent_id)
  UNION ALL SELECT s.trace_id, s.span_id, f.frag_id FROM f JOIN alive s ON s.trace_id = f.trace_id AND s.parent_id = f.span_id
), g AS (SELECT l.trace_id, l.anchor_id IS NOT NULL AND l.anchor_id = t.anchor_id AS own, up.anchor_id IS NOT DISTINCT FROM ut.anchor_id AS above, f.frag_id = 0 OR up.orphan_id IS NULL AS top, l.anchor_id IS NOT NULL AS placed
  FROM links l JOIN anchors t ON t.trace_id = l.trace_id AND t.span_id = l.orphan_id LEFT JOIN f ON f.trace_id = l.trace_id AND f.span_id = l.anchor_id
  LEFT JOIN links up ON up.trace_id = f.trace_id AND up.orphan_id = f.frag_id LEFT JOIN anchors ut ON ut.trace_id = up.trace_id AND ut.span_id = up.orphan_id)
SELECT trace_id, count(*) FILTER (placed) AS placed, count(*) FILTER (placed AND top) AS on_the_root, count(*) FILTER (placed AND own AND (top OR above)) AS both_right,
  count(*) FILTER (placed AND own AND NOT top AND NOT above) AS parent_right, count(*) FILTER (placed AND NOT own AND NOT top AND above) AS grandparent_right,
  count(*) FILTER (placed AND NOT own AND (top OR NOT above)) AS none_right FROM g GROUP BY trace_id"""


NO_ROWS = "SELECT 0::BIGINT AS trace_id, '' AS kind, 0::BIGINT AS span_id WHERE false"


def entries() -> dict[str, Entry]:
    """All entries by name."""
    crumbs = Scheme("crumbs", CPD)
    return {
        "payload_sizes": Entry(_sizes, SIZES_SQL),
        "breadcrumb_sizes": Entry(
            lambda spark, sf_dir: handlers.payloads(heap_spans(spark, sf_dir), Scheme("crumbs", CPD, topology_only=True, emit_order=True)).select(
                "trace_id", "span_id", "emit_bytes", "baggage_bytes", "order_bytes"
            ),
            BREADCRUMB_SQL,
        ),
        "pcr_payloads": Entry(
            lambda spark, sf_dir: handlers.payloads(wide(spark, sf_dir), Scheme("pcr", CPD))
            .where("br is not null")
            .select("trace_id", "span_id", F.lower(F.hex("br")).alias("br")),
            WIDE
            + KINDS
            + CHECKPOINTS
            + """ SELECT d.trace_id, d.span_id, '04' || format('{:02x}', d.depth) || substr(format('{:016x}', coalesce(c.ckpt_id, 0)), 1, 8) AS br
FROM drops d LEFT JOIN ckpts c ON c.trace_id = d.trace_id AND c.span_id = d.span_id WHERE d.carrier""",
        ),
        "window_payloads": Entry(
            lambda spark, sf_dir: windows.payloads(wide(spark, sf_dir), Scheme("pcr", CPD))
            .where("br is not null")
            .select("trace_id", "span_id", F.lower(F.hex("br")).alias("br")),
            WIDE
            + KINDS
            + CHECKPOINTS
            + """ SELECT d.trace_id, d.span_id, '04' || format('{:02x}', d.depth) || substr(format('{:016x}', coalesce(c.ckpt_id, 0)), 1, 8) AS br
FROM drops d LEFT JOIN ckpts c ON c.trace_id = d.trace_id AND c.span_id = d.span_id WHERE d.carrier""",
        ),
        "window_sizes": Entry(_window_sizes, f"SELECT * FROM ({SIZES_SQL}) WHERE scheme <> 'cgpb'"),
        "prefix_joins": Entry(_prefix_joins, WIDE + KINDS + PREFIX.format(shift=1 << 56) + " SELECT * FROM links"),
        "window_filters": Entry(
            lambda spark, sf_dir: handlers.payloads(wide(spark, sf_dir), Scheme("pb", CPD)).where("br is not null").select(
                "trace_id", "span_id", F.lower(F.hex("br")).alias("br")
            ),
            collisions.filters_sql(CPD, Scheme.fp),
        ),
        "large_baggage": Entry(
            lambda spark, sf_dir: handlers.large_baggage(handlers.payloads(heap_spans(spark, sf_dir), Scheme("cgpb", CPD)), 40),
            SIZES_SQL[: SIZES_SQL.rindex("\nSELECT")] + "\nSELECT trace_id, span_id, depth, call::BIGINT AS baggage_bytes FROM sizes WHERE scheme = 'cgpb' AND call > 40",
        ),
        "end_lists": Entry(
            lambda spark, sf_dir: structure.end_lists(heap_spans(spark, sf_dir)).select("trace_id", "span_id", F.array_join("ends", ",").alias("ends")),
            START
            + DEEP
            + SEQ.replace("FROM spans", "FROM deep")
            + EVENTS
            + """, own AS (SELECT p.*, o.seq, count(*) FILTER (p.kind = 0) OVER (PARTITION BY p.trace_id, p.parent_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g
  FROM pos p JOIN ordered o ON o.trace_id = p.trace_id AND o.span_id = p.span_id WHERE p.parent_id <> 0
), ends AS (SELECT trace_id, parent_id, g, string_agg(seq::VARCHAR, ',' ORDER BY pos) AS ends FROM own WHERE kind = 1 GROUP BY ALL)
SELECT s.trace_id, s.span_id, e.ends FROM own s JOIN ends e ON e.trace_id = s.trace_id AND e.parent_id = s.parent_id AND e.g + 1 = s.g WHERE s.kind = 0""",
        ),
        "delayed_ends": Entry(
            lambda spark, sf_dir: handlers.delayed_ends(heap_spans(spark, sf_dir), crumbs).select(
                "trace_id", "span_id", "service", "ts", F.octet_length("quad").alias("bytes")
            ),
            START + DEEP + EVENTS + DELAYED_SQL + " SELECT trace_id, span_id, service, ts, (20 + n)::INTEGER AS bytes FROM delayed",
        ),
        "delayed_pickups": Entry(
            lambda spark, sf_dir: handlers.next_start(
                handlers.delayed_ends(heap_spans(spark, sf_dir), crumbs), handlers._starts(heap_spans(spark, sf_dir))
            ).select("trace_id", "span_id", "service", "ts", "next_trace", "next_span"),
            START
            + DEEP
            + EVENTS
            + DELAYED_SQL
            + """, all_events AS (SELECT service, ts, 0 AS kind, depth AS turn, trace_id, span_id, trace_id AS t, span_id AS s FROM e WHERE kind = 0 UNION ALL
  SELECT service, ts, 1, -depth, trace_id, span_id, NULL, NULL FROM delayed
), w AS (SELECT *, first_value(t IGNORE NULLS) OVER f AS next_trace, first_value(s IGNORE NULLS) OVER f AS next_span FROM all_events
  WINDOW f AS (PARTITION BY service ORDER BY ts, kind, turn, trace_id, span_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT trace_id, span_id, service, ts, next_trace, next_span FROM w WHERE kind = 1""",
        ),
        "pcr_links": Entry(
            _links("pcr", ("trace_id", "orphan_id", "anchor_id", "synthetic", "ambiguous", "via_carrier"), name="pcr", prefix=1),
            WIDE + KINDS + PREFIX.format(shift=1 << 56) + " SELECT * FROM links",
        ),
        "pcr_scores": Entry(
            _scored("pcr", scoring.score, name="pcr", prefix=4), WIDE + KINDS + ANCHORS + PREFIX.format(shift=1 << 32) + GRADED + SCORE_SQL
        ),
        "pcr_totals": Entry(
            _scored("pcr", lambda b, t: scoring.totals(scoring.score(b, t)), name="pcr", prefix=1),
            WIDE + KINDS + ANCHORS + PREFIX.format(shift=1 << 56) + GRADED + ", s AS (" + SCORE_SQL + ")" + TOTALS_SQL,
        ),
        "pcr_lost_spans": Entry(
            _scored("pcr", scoring.lost_spans, name="pcr", prefix=4),
            WIDE
            + KINDS
            + ANCHORS
            + PREFIX.format(shift=1 << 32)
            + GRADED
            + """, f AS (SELECT trace_id, span_id, span_id AS frag_id FROM orphans
  UNION ALL SELECT a.trace_id, a.span_id, f.frag_id FROM alive a JOIN f ON f.trace_id = a.trace_id AND f.span_id = a.parent_id
), z AS (SELECT trace_id, frag_id, count(*) AS n FROM f GROUP BY ALL
), g AS (SELECT g.trace_id, g.orphan_id, g.anchor_id, coalesce(s.skipped, 0) AS skipped, z.n FROM graded g JOIN z ON z.trace_id = g.trace_id AND z.frag_id = g.orphan_id
  LEFT JOIN skips s ON s.trace_id = g.trace_id AND s.orphan_id = g.orphan_id)
SELECT trace_id, count(*) FILTER (anchor_id IS NULL) AS fragments_lost, coalesce(sum(CASE WHEN anchor_id IS NULL THEN n END), 0)::BIGINT AS spans_lost,
  count(*) FILTER (skipped > 0) AS fragments_past, coalesce(sum(CASE WHEN skipped > 0 THEN n END), 0)::BIGINT AS spans_in_skipped FROM g GROUP BY trace_id""",
        ),
        "pb_links": _true_links("pb", siblings=True),
        "pb_bottom_up": _true_links("pb", bottom_up=True, siblings=True),
        "cgprb_links": _true_links("cgprb"),
        "cgprb_topology": Entry(_scored("cgprb", lambda b, t: scoring.topology_totals(scoring.topology(b, t)), name="cgprb", fp=1e-2)),
        "pb_scores": Entry(_scored("pb", scoring.score, name="pb", fp=1e-2), collisions.as_links(collisions.pb_sql(CPD, 1e-2)) + GRADED + SCORE_SQL),
        "pb_lying_totals": Entry(
            _scored("pb", lambda b, t: scoring.totals(scoring.score(b, t)), name="pb", fp=1e-1),
            collisions.as_links(collisions.pb_sql(CPD, 1e-1)) + GRADED + ", s AS (" + SCORE_SQL + ")" + TOTALS_SQL,
        ),
        "pb2_lying_totals": Entry(
            _scored("pb2", lambda b, t: scoring.totals(scoring.score(b, t)), name="pcrb", fp=1e-1),
            collisions.as_links(collisions.windows_sql(True, False, CPD, 1e-1)) + GRADED + ", s AS (" + SCORE_SQL + ")" + TOTALS_SQL,
        ),
        "pcrb_lying_totals": Entry(
            _scored("pcrb", lambda b, t: scoring.totals(scoring.score(b, t)), name="pcrb", fp=1e-1),
            collisions.as_links(collisions.threaded_sql(CPD, 1e-1)) + GRADED + ", s AS (" + SCORE_SQL + ")" + TOTALS_SQL,
        ),
        "pcrb_links": _true_links("pcrb"),
        "pb2_links": _true_links("pb2"),
        "pb1_links": _true_links("pb1"),
        "pb0_links": _true_links("pb0"),
        "cgp_links": _true_links("cgp"),
        "ledger_links": _true_links("ledger"),
        "map_links": _true_links("map"),
        "map_scores": Entry(_scored("map", scoring.score, name="pcrb", fp=1e-2)),
        "map_certificates": Entry(_certificates("map", 5, 1e-1)),
        "ledger_certificates": Entry(_certificates("ledger", 5, 1e-1)),
        "map_open_ends": Entry(_scored("map", scoring.open_ends, name="pcrb", fp=RARE), WIDE + KINDS + ANCHORS + OPEN_ENDS),
        "ledger_scores": Entry(_scored("ledger", scoring.score, name="pcrb", fp=1e-2)),
        "ledger_open_ends": Entry(
            _scored("ledger", scoring.open_ends, name="pcrb", fp=RARE),
            WIDE + KINDS + ANCHORS + OPEN_ENDS,
        ),
        "topology_scores": Entry(
            _scored("cgp", lambda b, t: scoring.topology(b, t).drop("misrouted", "strict_correct"), name="cgprb", fp=RARE),
            WIDE
            + KINDS
            + ANCHORS
            + """, g AS (SELECT a.trace_id, d.parent_id, count(*) AS n FROM anchors a JOIN drops d ON d.trace_id = a.trace_id AND d.span_id = a.span_id GROUP BY ALL)
SELECT trace_id, sum(n * (n - 1) // 2)::BIGINT AS true_pairs, sum(n * (n - 1) // 2)::BIGINT AS recall_pairs, sum(n * (n - 1) // 2)::BIGINT AS recon_pairs,
  sum(n * (n - 1) // 2)::BIGINT AS precision_pairs, max(n) > 1 AS has_fanout, true AS conn_correct, true AS topo_correct FROM g GROUP BY trace_id""",
        ),
        "topology_totals": Entry(_scored("cgp", lambda b, t: scoring.topology_totals(scoring.topology(b, t)), name="cgprb", fp=1e-2)),
        "edge_identity": Entry(
            _scored("cgp", lambda b, t: scoring.edge_identity(scoring.recon_edges(b, t), t), name="cgprb", fp=RARE),
            WIDE
            + KINDS
            + ANCHORS
            + """, lost AS (SELECT a.trace_id, d.parent_id AS id, min(a.gap) AS gap FROM anchors a JOIN drops d ON d.trace_id = a.trace_id AND d.span_id = a.span_id GROUP BY ALL
), l AS (SELECT trace_id, count(*) AS named, count(*) FILTER (gap = 1) AS exact FROM lost GROUP BY trace_id
), s AS (SELECT trace_id, count(*) FILTER (NOT dropped AND parent_id <> 0) AS surv FROM drops GROUP BY trace_id)
SELECT s.trace_id, surv + coalesce(named, 0) AS real_nodes, surv + coalesce(exact, 0) AS edge_exact, coalesce(named - exact, 0) AS edge_anon_ok, 0::BIGINT AS edge_wrong,
  surv AS surv_nodes, surv AS surv_exact, coalesce(named, 0) AS named_nodes, coalesce(exact, 0) AS named_exact FROM s LEFT JOIN l ON l.trace_id = s.trace_id""",
        ),
        "edge_depths": Entry(
            _scored("cgp", lambda b, t: scoring.edge_depths(scoring.recon_edges(b, t), t), name="cgprb", fp=RARE),
            WIDE
            + KINDS
            + ANCHORS
            + """, lost AS (SELECT a.trace_id, d.parent_id AS id, min(a.gap) AS gap, any_value(d.depth) - 1 AS depth FROM anchors a
  JOIN drops d ON d.trace_id = a.trace_id AND d.span_id = a.span_id GROUP BY ALL
), v AS (SELECT depth, 'exact' AS verdict, false AS lost FROM drops WHERE NOT dropped AND parent_id <> 0
  UNION ALL SELECT depth, CASE WHEN gap = 1 THEN 'exact' ELSE 'anon' END, true FROM lost)
SELECT depth, verdict, count(*) AS edges, count(*) FILTER (lost) AS of_lost_nodes FROM v GROUP BY ALL""",
        ),
        "identity_totals": Entry(_scored("cgp", lambda b, t: scoring.identity_totals(scoring.strict_identity(b, t)), name="cgprb", fp=1e-2)),
        "wrong_edges": Entry(
            _scored("pb", scoring.wrong_edges, name="pb", fp=1e-1),
            collisions.as_links(collisions.pb_sql(CPD, 1e-1))
            + GRADED
            + """, whole AS (SELECT trace_id, span_id, a FROM paths UNION ALL SELECT trace_id, span_id, span_id FROM drops
), bad AS (SELECT trace_id, orphan_id, anchor_id, true_anchor FROM graded WHERE anchor_id IS NOT NULL AND anchor_at IS NULL)
SELECT b.trace_id, b.orphan_id, b.anchor_id, b.true_anchor, max(d.depth) AS divergence_depth FROM bad b JOIN whole x ON x.trace_id = b.trace_id AND x.span_id = b.orphan_id
JOIN whole y ON y.trace_id = b.trace_id AND y.span_id = b.anchor_id AND y.a = x.a JOIN drops d ON d.trace_id = b.trace_id AND d.span_id = x.a GROUP BY ALL""",
        ),
        "open_ends": Entry(
            _scored("pb2", scoring.open_ends, name="pcrb", fp=RARE),
            WIDE + KINDS + ANCHORS + OPEN_ENDS,
        ),
        "fragments": Entry(
            lambda spark, sf_dir: loss.fragments(loss.with_drops(heap_spans(spark, sf_dir))),
            START
            + KINDS
            + """, alive AS (SELECT * FROM drops WHERE NOT dropped
), f AS (SELECT a.trace_id, a.span_id, a.span_id AS frag_id, a.depth, a.carrier FROM alive a
  WHERE NOT EXISTS (SELECT 1 FROM alive p WHERE p.trace_id = a.trace_id AND p.span_id = a.parent_id)
  UNION ALL SELECT s.trace_id, s.span_id, f.frag_id, s.depth, s.carrier FROM alive s JOIN f ON f.trace_id = s.trace_id AND f.span_id = s.parent_id)
SELECT trace_id, frag_id, count(*) AS spans, count(*) FILTER (carrier) AS carriers, min(CASE WHEN carrier THEN depth END) AS carrier_depth FROM f GROUP BY ALL""",
        ),
        "lost_parents": Entry(
            lambda spark, sf_dir: loss.lost_parents(loss.with_drops(heap_spans(spark, sf_dir))),
            START
            + KINDS
            + """ SELECT o.trace_id, o.parent_id AS lost_id, count(*) AS orphans, (any_value(o.depth) - 1)::INTEGER AS depth
FROM drops o JOIN drops p ON p.trace_id = o.trace_id AND p.span_id = o.parent_id WHERE NOT o.dropped AND p.dropped GROUP BY ALL""",
        ),
        "recon_violations": Entry(_sound(scoring.violations), NO_ROWS),
        "recon_evidence": Entry(_sound(lambda s, b: scoring.evidence(s, b, Scheme("pcrb", CPD))), NO_ROWS),
        "planted_violations": Entry(_planted_violations, WIDE + KINDS + ANCHORS + PLANTED),
        "planted_evidence": Entry(_planted_evidence, WIDE + KINDS + PREFIX.format(shift=1 << 32) + MOVED),
        "two_step_edges": Entry(_parents_above, WIDE + KINDS + ANCHORS + PREFIX.format(shift=1 << 56) + TWO_STEPS),
        "fault_audit": Entry(_scored("pcrb", scoring.audit, name="pcrb")),
        "breadcrumb_trees": Entry(
            _trees,
            WIDE
            + KINDS
            + """ SELECT trace_id, true AS solved, count(*)::INTEGER AS nodes, (count(*) FILTER (NOT dropped))::INTEGER AS known,
  (count(*) FILTER (NOT dropped))::INTEGER AS survivors, 0::INTEGER AS ambiguous, 0::INTEGER AS no_place, true AS embeds, true AS exact FROM drops GROUP BY trace_id""",
        ),
        "breadcrumb_orders": Entry(
            lambda spark, sf_dir: _orders(spark, sf_dir).select("trace_id", "solved", "rejected", "parents", "end_order_ok", "order_ok", "critical_path_ok"),
            START
            + """, clip AS (SELECT trace_id, span_id, parent_id, start_us, end_us FROM spans WHERE parent_id = 0
  UNION ALL SELECT s.trace_id, s.span_id, s.parent_id, greatest(s.start_us, c.start_us), least(s.end_us, c.end_us)
  FROM spans s JOIN clip c ON s.trace_id = c.trace_id AND s.parent_id = c.span_id WHERE s.end_us >= c.start_us AND s.start_us <= c.end_us
), k AS (SELECT trace_id, parent_id, count(*) AS n FROM clip GROUP BY ALL)
SELECT trace_id, true AS solved, false AS rejected, (count(*) FILTER (n > 1))::INTEGER AS parents, (count(*) FILTER (n > 1))::INTEGER AS end_order_ok,
  true AS order_ok, true AS critical_path_ok FROM k GROUP BY trace_id""",
        ),
        "breadcrumb_outcomes": Entry(
            _outcomes,
            START
            + """ SELECT count(DISTINCT trace_id) AS traces, 0::BIGINT AS unsolvable, 0::BIGINT AS wrong, count(DISTINCT trace_id) AS correct, count(DISTINCT trace_id) AS exact,
  100.0::DOUBLE AS coverage_pct FROM spans""",
        ),
        "tree_identity": Entry(_tree_identity(RARE, "cgp2", prime=True), None),
        "tree_identity_greedy": Entry(_tree_identity(1e-2, "cgp1")),
        "connectivity_ceilings": Entry(
            _scored("pb", scoring.connectivity_ceilings, name="pb", fp=1e-1),
            collisions.as_links(collisions.pb_sql(CPD, 1e-1))
            + GRADED
            + """, r AS (SELECT g.*, d.parent_id AS lost_id, g.anchor_id = g.true_anchor AS fits FROM graded g JOIN drops d ON d.trace_id = g.trace_id AND d.span_id = g.orphan_id WHERE g.anchor_id IS NOT NULL
), w AS (SELECT *, count(*) OVER (PARTITION BY trace_id, lost_id) AS n, bool_or(fits) OVER (PARTITION BY trace_id, lost_id) AS any_right FROM r
), branch AS (SELECT trace_id, parent_id AS a FROM drops WHERE parent_id <> 0 GROUP BY ALL HAVING count(*) > 1
), fans AS (SELECT w.trace_id, w.orphan_id, p.a, w.fits FROM w JOIN paths p ON p.trace_id = w.trace_id AND p.span_id = w.orphan_id AND p.distance <= w.gap JOIN branch b ON b.trace_id = p.trace_id AND b.a = p.a
), state AS (SELECT f.trace_id, f.orphan_id, bool_or(EXISTS (SELECT 1 FROM fans o WHERE o.trace_id = f.trace_id AND o.a = f.a AND o.fits)) AS rescue FROM fans f WHERE NOT f.fits GROUP BY ALL)
SELECT count(*) AS wrong, count(*) FILTER (n = 1) AS only_child, count(*) FILTER (n > 1 AND any_right) AS sibling_right, count(*) FILTER (n > 1 AND NOT any_right) AS siblings_wrong,
  count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (rescue) AS rescuable, count(*) FILTER (NOT rescue) AS fanout_without_right, count(*) FILTER (rescue IS NULL) AS no_fanout
FROM w LEFT JOIN state s ON s.trace_id = w.trace_id AND s.orphan_id = w.orphan_id WHERE NOT w.fits""",
        ),
        "seeded_interior_drops": Entry(lambda spark, sf_dir: loss.seeded_interior_drops(wide(spark, sf_dir), 0.5)),
    }


def fixed_entries() -> dict[str, Entry]:
    """A table over stated settings: it reads no table, so it is not registered; tests compare it with SQL."""
    return {
        "filter_sizes": Entry(
            lambda spark, sf_dir: spark.createDataFrame(
                [(n, p, *hashing.bloom_size(n, p)) for n in (-1, 0, 1, 2, 3, 5, 10, 1000) for p in (0.0, 1e-6, 1e-4, 0.001, 0.01, 0.5, 1.0)], "n int, p double, m int, k int"
            ),
            """WITH g AS (SELECT n::INTEGER AS n, p::DOUBLE AS p, CASE WHEN n > 0 THEN n ELSE 1000 END AS c, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.01 END AS q
  FROM (VALUES (-1), (0), (1), (2), (3), (5), (10), (1000)) a(n) CROSS JOIN (VALUES (0.0), (1e-6), (1e-4), (0.001), (0.01), (0.5), (1.0)) b(p)
), m AS (SELECT *, greatest(1, ceil(-c * ln(q) / (ln(2) * ln(2))))::INTEGER AS m FROM g)
SELECT n, p, m, greatest(1, ceil(m / c * ln(2)))::INTEGER AS k FROM m""",
        ),
    }


OPEN_ENDS = """, ends AS (SELECT d.trace_id, d.span_id FROM drops d WHERE NOT d.dropped AND NOT d.carrier
  AND NOT EXISTS (SELECT 1 FROM drops k WHERE k.trace_id = d.trace_id AND k.parent_id = d.span_id AND NOT k.dropped))
SELECT e.trace_id, count(*) AS open_ends, count(*) FILTER (EXISTS (SELECT 1 FROM anchors a WHERE a.trace_id = e.trace_id AND a.anchor_id = e.span_id)) AS open_ends_matched
FROM ends e GROUP BY e.trace_id"""
DELAYED_SQL = """, span_pos AS (SELECT trace_id, span_id, any_value(service) AS service, any_value(depth) AS depth, max(CASE WHEN kind = 1 THEN ts END) AS ts,
    max(CASE WHEN kind = 1 THEN pos END) AS end_pos FROM pos GROUP BY ALL
), kids AS (SELECT s.trace_id, s.parent_id, s.kind, s.pos, max(CASE WHEN s.kind = 0 THEN s.pos END) OVER (PARTITION BY s.trace_id, s.parent_id) AS last_start
  FROM pos s WHERE s.parent_id <> 0
), early AS (SELECT k.trace_id, k.parent_id, k.pos, max(CASE WHEN k.kind = 0 AND k.pos < p.end_pos THEN k.pos END) OVER (PARTITION BY k.trace_id, k.parent_id) AS seen,
    k.kind, p.end_pos FROM kids k JOIN span_pos p ON p.trace_id = k.trace_id AND p.span_id = k.parent_id
), rest AS (SELECT trace_id, parent_id AS span_id, count(*) - 1 AS n FROM early WHERE kind = 1 AND pos < end_pos AND pos > coalesce(seen, 0) GROUP BY ALL
), delayed AS (SELECT p.trace_id, p.span_id, p.service, p.depth, p.ts, r.n FROM rest r JOIN span_pos p ON p.trace_id = r.trace_id AND p.span_id = r.span_id WHERE r.n > 0)"""
