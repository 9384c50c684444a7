"""Registry of the trace-analytics queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import payload
from spanloom.operators import arrival, cleaning, loss, structure
from spanloom.plans.tree import with_depth
from spanloom.queries import collisions, ingest, recon, streams, studies
from spanloom.queries.base import ANCHORS, DEEP, KINDS, START, Entry
from spanloom.sources.views import DIRTY_SQL, dirty_spans, heap_spans

FLAGSHIP = "nearest_survivor"


def _heap(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(heap_spans(spark, sf_dir))


def _dirty(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(dirty_spans(spark, sf_dir))


def _bytes_sql() -> str:
    size = "ceil(ceil(-{n} * ln(0.01) / (ln(2) * ln(2))) / 8)::BIGINT"
    varint = "(1 + ({0} >= 128)::INT + ({0} >= 16384)::INT)"
    return (
        START
        + KINDS
        + f""", each AS (
  SELECT k.*, s.scheme, s.size, s.scheme <> 'vanilla' AS has, {varint.format("(CASE WHEN s.scheme = 'pb' THEN depth % 3 ELSE depth END)")} AS level,
    {varint.format("depth")} AS own FROM kinds k
  CROSS JOIN (VALUES ('vanilla', 0), ('pb', {size.format(n=3)}), ('pcr', 4), ('pcrb', 4 + {size.format(n=2)})) s(scheme, size)
)
SELECT trace_id, scheme, count(*) AS num_spans, count(*) FILTER (carrier) AS num_carriers,
  sum(CASE WHEN has AND carrier THEN 4 + level + size ELSE 0 END)::BIGINT AS payload_bytes,
  sum(CASE WHEN has AND NOT carrier THEN 2 + own ELSE 0 END)::BIGINT AS depth_bytes,
  sum(CASE WHEN has AND parent_id <> 0 THEN 3 + level + size ELSE 0 END)::BIGINT AS baggage_bytes,
  max(CASE WHEN has AND carrier THEN 4 + level + size ELSE 0 END)::BIGINT AS max_payload,
  sum(CASE WHEN has AND carrier THEN 4 + level + size ELSE 0 END)::DOUBLE / count(*) AS amortized_by_total
FROM each GROUP BY trace_id, scheme"""
    )


BAD = """, rules AS (
  SELECT d.trace_id, count(*) AS spans, count(*) - count(DISTINCT d.span_id) AS duplicates,
    count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS dangling, count(*) FILTER (d.parent_id = 0) AS roots
  FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id
  GROUP BY d.trace_id
)"""


PROPERTIES = """, props AS (
  SELECT d.trace_id, count(*) AS num_spans, max(end_us) - min(start_us) AS duration_us, count(DISTINCT service) AS num_services,
    max(CASE WHEN d.parent_id <> 0 AND k.span_id IS NULL THEN 1 ELSE 0 END) AS hit
  FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id
  GROUP BY d.trace_id
), long AS (
  SELECT trace_id, hit, 'num_spans' AS name, num_spans::DOUBLE AS value FROM props UNION ALL
  SELECT trace_id, hit, 'duration_us', duration_us::DOUBLE FROM props UNION ALL
  SELECT trace_id, hit, 'num_services', num_services::DOUBLE FROM props
)"""


def entries() -> dict[str, Entry]:
    """All entries by name."""
    heap, dirty = _heap, _dirty
    return {
        "span_depths": Entry(
            heap(lambda s: with_depth(s).select("trace_id", "span_id", "depth", "root_id")),
            START + DEEP + " SELECT trace_id, span_id, depth, root_id FROM deep",
        ),
        "trace_shape": Entry(
            heap(structure.trace_shape),
            START
            + DEEP
            + """ SELECT d.trace_id, count(*) AS num_spans, count(DISTINCT service) AS num_services, min(start_us) AS start_us,
  max(end_us) AS end_us, max(end_us) - min(start_us) AS wall_us, count(*) FILTER (end_us <= start_us) AS zero_runtime,
  max(depth)::BIGINT AS max_depth, count(*) FILTER (parent_id = 0) AS roots, 0::BIGINT AS unreachable,
  coalesce(any_value(f.n), 0)::BIGINT AS max_fanout
FROM deep d LEFT JOIN (SELECT trace_id, max(n) AS n FROM (SELECT trace_id, parent_id, count(*) AS n FROM spans WHERE parent_id <> 0
  GROUP BY ALL) GROUP BY trace_id) f ON f.trace_id = d.trace_id GROUP BY d.trace_id""",
        ),
        "max_concurrency": Entry(
            heap(structure.max_concurrency),
            START
            + """, steps AS (SELECT trace_id, start_us AS t, 1 AS d FROM spans UNION ALL
  SELECT trace_id, greatest(start_us, end_us), -1 FROM spans
), run AS (SELECT trace_id, sum(d) OVER (PARTITION BY trace_id ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS n FROM steps)
SELECT trace_id, max(n)::BIGINT AS max_concurrent FROM run GROUP BY trace_id""",
        ),
        "service_totals": Entry(
            dirty(structure.service_totals),
            f"WITH {DIRTY_SQL}"
            + """ SELECT d.service, count(*) AS total_spans, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS dangling_spans,
  count(DISTINCT d.trace_id) AS total_traces
FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id
GROUP BY d.service""",
        ),
        "event_order": Entry(
            heap(structure.ordered_events),
            START
            + DEEP
            + """, e AS (SELECT trace_id, span_id, depth, 0 AS kind, start_us AS ts FROM deep UNION ALL
  SELECT trace_id, span_id, depth, 1, end_us FROM deep)
SELECT trace_id, span_id, kind, ts, row_number() OVER (PARTITION BY trace_id
  ORDER BY ts, kind, CASE WHEN kind = 0 THEN depth ELSE -depth END, span_id)::INTEGER AS pos FROM e""",
        ),
        "sibling_ordinals": Entry(
            heap(structure.sibling_ordinals),
            START
            + """ SELECT trace_id, span_id, (CASE WHEN parent_id = 0 THEN 0 ELSE
  row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) END)::INTEGER AS seq FROM spans""",
        ),
        "crisp_clip": Entry(
            heap(structure.crisp_clip),
            START
            + """, clip AS (SELECT trace_id, span_id, parent_id, start_us, end_us FROM spans WHERE parent_id = 0
  UNION ALL SELECT s.trace_id, s.span_id, s.parent_id, greatest(s.start_us, c.start_us), least(s.end_us, c.end_us)
  FROM spans s JOIN clip c ON s.trace_id = c.trace_id AND s.parent_id = c.span_id WHERE s.end_us >= c.start_us AND s.start_us <= c.end_us)
SELECT * FROM clip""",
        ),
        "leaf_residues": Entry(
            heap(structure.leaf_residues),
            START
            + DEEP
            + """, kids AS (SELECT trace_id, parent_id, count(*) AS n FROM spans WHERE parent_id <> 0 GROUP BY ALL)
SELECT c.cpd, (depth % c.cpd)::INTEGER AS residue, count(*) FILTER (n IS NULL) AS leaves, count(*) FILTER (n > 1) AS branches
FROM deep d LEFT JOIN kids k ON k.trace_id = d.trace_id AND k.parent_id = d.span_id
CROSS JOIN (VALUES (2), (3), (4), (5), (6)) c(cpd) GROUP BY ALL""",
        ),
        "fanout_widths": Entry(
            dirty(structure.fanout_widths),
            f"WITH {DIRTY_SQL}"
            + """, kids AS (SELECT trace_id, parent_id, count(*) AS width FROM dirty WHERE parent_id <> 0 GROUP BY ALL)
SELECT width, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM kids GROUP BY width""",
        ),
        "top_services": Entry(
            heap(structure.top_services),
            START
            + """, n AS (SELECT trace_id, service, count(*) AS spans FROM spans GROUP BY ALL), r AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY spans DESC, service)::INTEGER AS place FROM n)
SELECT * FROM r WHERE place <= 3""",
        ),
        "time_components": Entry(
            heap(lambda s: structure.time_components(s.withColumn("end_us", F.col("start_us") + (F.col("end_us") - F.col("start_us")) / 1000).withColumn("end_us", F.col("end_us").cast("long")).withColumn("trace_id", F.col("trace_id") * 1000 + F.col("span_id")))),
            START
            + """, t AS (SELECT trace_id * 1000 + span_id AS id, min(start_us) AS lo, max(start_us + ((end_us - start_us) // 1000)) AS hi
  FROM spans GROUP BY ALL), m AS (SELECT *, max(hi) OVER (ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t
), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, id ROWS UNBOUNDED PRECEDING)::BIGINT AS component FROM m)
SELECT component, count(*) AS traces, min(lo) AS start_us, max(hi) AS end_us FROM c GROUP BY component""",
        ),
        "event_density": Entry(
            heap(structure.density),
            START
            + """ SELECT (ts // 86400000000)::BIGINT AS bucket, count(*) AS events FROM (SELECT start_us AS ts FROM spans UNION ALL SELECT end_us FROM spans)
GROUP BY ALL""",
        ),
        "trace_size_percentiles": Entry(
            heap(lambda s: structure.index_percentiles(s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")), "n")),
            START
            + """, n AS (SELECT count(*) AS n FROM spans GROUP BY trace_id), l AS (SELECT list(n ORDER BY n) AS l FROM n)
SELECT p, l[1 + floor(p * (len(l) - 1))::BIGINT] AS value FROM l CROSS JOIN (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) x(p)""",
        ),
        "arrival_correlations": Entry(
            dirty(arrival.correlations),
            f"WITH {DIRTY_SQL}"
            + PROPERTIES
            + """, r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2 AS place FROM long)
SELECT name, count(*) AS traces,
  CASE WHEN count(*) >= 100 AND var_pop(hit) > 0 AND var_pop(value) > 0 THEN round(corr(place, hit), 6) END AS spearman,
  CASE WHEN count(*) >= 100 AND var_pop(hit) > 0 AND var_pop(value) > 0 THEN round(corr(value, hit), 6) END AS point_biserial
FROM r GROUP BY name""",
        ),
        "quantile_lift": Entry(
            dirty(arrival.quantile_lift),
            f"WITH {DIRTY_SQL}"
            + PROPERTIES
            + """, l AS (SELECT name, list(value ORDER BY value) AS l, count(*) AS n FROM long GROUP BY name
), spots AS (SELECT name, l, n, i * (n - 1) // 20 AS lo, i * (n - 1) % 20 AS rest FROM l CROSS JOIN range(21) s(i)
), e AS (SELECT DISTINCT name, l[lo + 1] + (l[least(lo + 1, n - 1) + 1] - l[lo + 1]) * rest::DOUBLE / 20::DOUBLE AS edge FROM spots
), m AS (SELECT name, count(*) AS edges FROM e GROUP BY name
), b AS (SELECT x.trace_id, x.name, any_value(x.value) AS value, any_value(x.hit) AS hit, count(e.edge) - 1 AS reached
  FROM long x LEFT JOIN e ON e.name = x.name AND e.edge <= x.value GROUP BY ALL
), g AS (SELECT b.*, greatest(0, least(reached, edges - 2))::INTEGER AS bin FROM b JOIN m ON m.name = b.name)
SELECT name, bin, count(*) AS traces, sum(hit)::BIGINT AS hits, sum(hit)::DOUBLE / count(*) AS rate, median(value) AS centre
FROM g GROUP BY name, bin HAVING count(*) >= 10""",
        ),
        "service_rates": Entry(
            dirty(arrival.service_rates),
            f"WITH {DIRTY_SQL}"
            + """ SELECT d.service, count(*) AS total_spans, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS dangling_spans,
  (count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL))::DOUBLE / count(*) AS rate
FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id
GROUP BY d.service HAVING count(*) >= 100 ORDER BY rate DESC, d.service LIMIT 30""",
        ),
        "prefix_bytes": Entry(
            heap(arrival.prefix_bytes),
            START
            + DEEP
            + """, w AS (SELECT trace_id, (((trace_id % 100003) * 7919 + (span_id % 100003) * 104729 + 42 * 1299709) * 48271) % 2147483647 AS wire
  FROM deep WHERE depth % 3 = 0
), x AS (SELECT trace_id, xor(wire, lag(wire) OVER (PARTITION BY trace_id ORDER BY wire)) AS x FROM w)
SELECT trace_id, count(*) AS checkpoints, (coalesce(max(CASE WHEN x = 0 THEN 4 ELSE (32 - length(bin(x))) // 8 END), 0) + 1)::INTEGER AS needed_bytes
FROM x GROUP BY trace_id""",
        ),
        "violations": Entry(
            dirty(cleaning.violations),
            f"WITH {DIRTY_SQL}" + BAD + " SELECT *, duplicates = 0 AND dangling = 0 AND roots = 1 AS clean FROM rules",
        ),
        "violation_patterns": Entry(
            dirty(cleaning.violation_patterns),
            f"WITH {DIRTY_SQL}"
            + BAD
            + """ SELECT concat_ws('+', CASE WHEN duplicates > 0 THEN 'duplicate' END, CASE WHEN dangling > 0 THEN 'dangling' END,
  CASE WHEN roots = 0 THEN 'rootless' END, CASE WHEN roots > 1 THEN 'multiroot' END) AS pattern, count(*) AS traces
FROM rules GROUP BY ALL""",
        ),
        "salvage": Entry(
            dirty(cleaning.salvage),
            f"WITH RECURSIVE {DIRTY_SQL}"
            + BAD
            + """, ok AS (SELECT d.* FROM dirty d JOIN rules r ON r.trace_id = d.trace_id WHERE duplicates = 0 AND dangling = 0 AND roots > 0
), tree AS (SELECT *, span_id AS root_id FROM ok WHERE parent_id = 0
  UNION ALL SELECT s.*, t.root_id FROM ok s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id
), sizes AS (SELECT trace_id, root_id, count(*) AS n FROM tree GROUP BY ALL
), best AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, root_id) AS place FROM sizes)
SELECT t.trace_id, span_id, parent_id, service, start_us, end_us FROM tree t JOIN best b
ON b.trace_id = t.trace_id AND b.root_id = t.root_id WHERE place = 1""",
        ),
        "lenient_repair": Entry(
            dirty(cleaning.lenient),
            f"WITH RECURSIVE {DIRTY_SQL}, norm AS (SELECT * FROM dirty)"
            + ingest.LENIENT
            + " SELECT trace_id, span_id, parent_id, service, start_us, end_us, flags FROM kept",
        ),
        "nested_drops": Entry(
            heap(loss.nested_drops),
            START
            + KINDS
            + """ SELECT r.rate, count(*) AS spans, count(*) FILTER (NOT k.carrier AND (r.rate >= 1 OR k.u < r.rate)) AS dropped,
  count(*) FILTER (NOT (NOT k.carrier AND (r.rate >= 1 OR k.u < r.rate)) AND coalesce(NOT p.carrier AND (r.rate >= 1 OR p.u < r.rate), false)) AS orphans
FROM kinds k LEFT JOIN kinds p ON p.trace_id = k.trace_id AND p.span_id = k.parent_id
CROSS JOIN (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) r(rate) GROUP BY r.rate""",
        ),
        FLAGSHIP: Entry(
            heap(loss.nearest_survivor), START + KINDS + ANCHORS + " SELECT trace_id, span_id, depth, anchor_id, gap FROM anchors"
        ),
        "checkpoint_above": Entry(
            heap(loss.checkpoint_above),
            START
            + DEEP
            + """, up AS (SELECT d.trace_id, d.span_id, d.depth, p.span_id AS here, p.depth AS at_depth, p.parent_id AS next
  FROM deep d JOIN deep p ON p.trace_id = d.trace_id AND p.span_id = d.parent_id
  UNION ALL SELECT u.trace_id, u.span_id, u.depth, p.span_id, p.depth, p.parent_id
  FROM up u JOIN deep p ON p.trace_id = u.trace_id AND p.span_id = u.next WHERE u.at_depth % 3 <> 0)
SELECT trace_id, span_id, depth, here AS ckpt_id FROM up WHERE at_depth % 3 = 0""",
        ),
        "checkpoint_reconstruction": Entry(
            heap(loss.reconstruct_by_checkpoint),
            START
            + KINDS
            + ANCHORS
            + recon.PREFIX.format(shift=1)
            + """ SELECT b.trace_id, count(*) AS orphans, count(b.anchor_id) AS reconnected, count(*) FILTER (b.anchor_id = a.anchor_id) AS anchor_correct
FROM links b JOIN anchors a ON a.trace_id = b.trace_id AND a.span_id = b.orphan_id GROUP BY b.trace_id""",
        ),
        "scheme_bytes": Entry(heap(payload.scheme_bytes), _bytes_sql()),
    }


def all_entries() -> dict[str, Entry]:
    """The entries of all families by name."""
    found = entries()
    for family in (recon, collisions, ingest, studies, streams):
        found |= family.entries()
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {name: e.run for name, e in all_entries().items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: e.sql for name, e in all_entries().items() if e.sql}
