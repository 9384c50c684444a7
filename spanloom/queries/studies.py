"""Queries of corpus studies and of synthetic traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import generate, handlers, loss, reservoir, scoring, structure, studies
from spanloom.operators.generate import Shape
from spanloom.operators.handlers import Scheme
from spanloom.plans.tree import with_depth
from spanloom.queries import ingest, recon
from spanloom.queries.base import ANCHORS, DEEP, KINDS, START, WIDE, Entry
from spanloom.sources import jaeger
from spanloom.sources.views import DIRTY_SQL, chain_spans, dirty_spans, heap_spans, wide_spans


def heap(op: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: op(heap_spans(spark, sf_dir))


def dirty(op: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: op(dirty_spans(spark, sf_dir))


def wide(op: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: op(wide_spans(heap_spans(spark, sf_dir)))


def joined_refs(spans: DataFrame) -> DataFrame:
    """Parent references of ``spans``: every fifth span names a second parent, some of those one that is missing."""
    first = spans.where("parent_id <> 0").select("trace_id", "span_id", F.lit(0).alias("place"), "parent_id")
    other = F.when(F.col("span_id") % 35 == 0, F.lit(900_000)).otherwise(F.floor(F.col("span_id") / 3)).cast("long")
    second = spans.where("span_id % 5 = 0").select("trace_id", "span_id", F.lit(1).alias("place"), other.alias("parent_id"))
    return first.unionByName(second)


def _joins(op=lambda j: j):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = heap_spans(spark, sf_dir)
        return op(studies.multi_parents(joined_refs(spans), spans))

    return run


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = dirty_spans(spark, sf_dir)
    refs = spans.where("parent_id <> 0").select("trace_id", "span_id", F.lit(0).alias("place"), "parent_id").distinct()
    return studies.multi_roots(spans.select("trace_id", "span_id").distinct(), refs)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.violation_counts(ingest._flags(spark, sf_dir))


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = heap_spans(spark, sf_dir)
    days = [studies.sizes_by_distance(spans.where(f"trace_id % 2 = {k}"), ("pcr", "pcrb"), (3,)).drop("deviation") for k in (0, 1)]
    return studies.pooled(days, ["mode", "cpd"], "traces", ["mean"])


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the observed traces: a synthetic one is made for each."""
    return heap_spans(spark, sf_dir).select("trace_id").distinct()


def _generated(shape: str, **settings):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = generate.traces_of(_numbers(spark, sf_dir), Shape(shape, **settings))
        return t.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.max("depth").cast("long").alias("max_depth"), (F.max("end_us") - F.min("start_us") + 1).alias("ticks"))

    return run


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for law in ("zipf", "poisson", "geometric", "measured"):
        t = generate.traces_of(_numbers(spark, sf_dir), Shape("branch", depth=8, fanout=2, fanout_law=law, depth_law="zipf"))
        part = t.agg(F.lit(law).alias("law"), F.count(F.lit(1)).alias("spans"), F.max("depth").alias("max_depth"))
        out = part if out is None else out.unionByName(part)
    return out


def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made, sized, thinned out, rebuilt by two schemes and scored in one go, trace by trace: no span is shuffled or written."""
    t = generate.traces_of(_numbers(spark, sf_dir), Shape("branch", depth=9, fanout=2, fanout_law="poisson", max_spans=300))
    out = None
    for engine in ("pcrb", "cgp"):
        s = Scheme("pcrb" if engine == "pcrb" else "cgprb", 3)
        truth = handlers.payloads(t, s, whole=True).withColumn("dropped", loss.dropped())
        scores = scoring.score_whole(scoring.graded_whole(truth, engine, s))
        part = scoring.totals(scores).select(F.lit(engine).alias("engine"), "traces", "spans", "dropped", "orphans", "reconnected", "anchor_correct", "wrong_pct")
        out = part if out is None else out.unionByName(part)
    return out


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.complete_trees(spark, [(2, 1), (2, 2), (3, 3), (4, 2)])


def _tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = ingest._folder(spark, "trees")
    jaeger.to_documents(ingest.in_ns(_complete(spark, sf_dir))).write.json(path)
    return jaeger.load(spark, path, lines=True).groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.max("depth").alias("max_depth"))


def _severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = studies.protected_drops(heap_spans(spark, sf_dir), 0.5, 3, loss.uniform())
    return d.groupBy("prio").agg(F.count(F.lit(1)).alias("spans"), F.count(F.when(F.col("dropped"), 1)).alias("dropped"))


PATHS = """, high AS (SELECT d.*, k.parent_id IS NULL OR d.depth % 3 = 0 AS high FROM deep d
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) k ON k.trace_id = d.trace_id AND k.parent_id = d.span_id
), up AS (
  SELECT h.trace_id, h.span_id, p.span_id AS here, p.parent_id AS next, p.high, 1 AS distance FROM high h JOIN high p ON p.trace_id = h.trace_id AND p.span_id = h.parent_id WHERE h.high
  UNION ALL SELECT u.trace_id, u.span_id, p.span_id, p.parent_id, p.high, u.distance + 1 FROM up u JOIN high p ON p.trace_id = u.trace_id AND p.span_id = u.next WHERE NOT u.high
), paths AS (SELECT trace_id, span_id, list(here ORDER BY distance DESC) AS path FROM up GROUP BY ALL)"""
TEXT_BYTES = "CASE WHEN {0} = 0 THEN 0 ELSE ceil((ceil(ceil(-{0} * ln(0.01) / (ln(2) * ln(2))) / 8) + 25) * 4 / 3) END"
JOINS = """, refs AS (SELECT trace_id, span_id, 0 AS place, parent_id FROM spans WHERE parent_id <> 0 UNION ALL
  SELECT trace_id, span_id, 1, CASE WHEN span_id % 35 = 0 THEN 900000 ELSE span_id // 3 END FROM spans WHERE span_id % 5 = 0
), per AS (SELECT r.trace_id, r.span_id, count(*) AS refs, count(k.span_id) AS present, string_agg(coalesce(k.service, '?'), '|' ORDER BY coalesce(k.service, '?')) AS parent_services,
    max(CASE WHEN place = 0 THEN r.parent_id END) AS a, max(CASE WHEN place = 1 THEN r.parent_id END) AS b
  FROM refs r LEFT JOIN spans k ON k.trace_id = r.trace_id AND k.span_id = r.parent_id GROUP BY ALL
), many AS (SELECT p.*, s.service FROM per p JOIN spans s ON s.trace_id = p.trace_id AND s.span_id = p.span_id WHERE refs > 1
), anc AS (SELECT trace_id, span_id, parent_id AS x, 1 AS d FROM spans WHERE parent_id <> 0
  UNION ALL SELECT a.trace_id, a.span_id, s.parent_id, a.d + 1 FROM anc a JOIN spans s ON s.trace_id = a.trace_id AND s.span_id = a.x WHERE s.parent_id <> 0
), below AS (SELECT trace_id, x AS span_id, count(*) AS below, count(*) FILTER (d = 1) AS children FROM anc GROUP BY ALL
), sa AS (SELECT trace_id, span_id, a AS x, 0 AS d FROM many UNION ALL SELECT m.trace_id, m.span_id, anc.x, anc.d FROM many m JOIN anc ON anc.trace_id = m.trace_id AND anc.span_id = m.a
), sb AS (SELECT trace_id, span_id, b AS x, 0 AS d FROM many UNION ALL SELECT m.trace_id, m.span_id, anc.x, anc.d FROM many m JOIN anc ON anc.trace_id = m.trace_id AND anc.span_id = m.b
), met AS (SELECT sa.trace_id, sa.span_id, sa.x, sa.d AS da, sb.d AS db, row_number() OVER (PARTITION BY sa.trace_id, sa.span_id ORDER BY sb.d) AS place
  FROM sa JOIN sb ON sb.trace_id = sa.trace_id AND sb.span_id = sa.span_id AND sb.x = sa.x
), joins AS (SELECT m.trace_id, m.span_id, m.service, refs, present, CASE WHEN present = refs THEN 'all' WHEN present = 0 THEN 'none' ELSE 'some' END AS parents, parent_services,
    coalesce(children, 0) AS children, coalesce(below, 0) AS below, l.x AS lca_id, l.da AS dist_a, l.db AS dist_b, s.service AS lca_service
  FROM many m LEFT JOIN below b ON b.trace_id = m.trace_id AND b.span_id = m.span_id
  LEFT JOIN met l ON l.trace_id = m.trace_id AND l.span_id = m.span_id AND l.place = 1 LEFT JOIN spans s ON s.trace_id = m.trace_id AND s.span_id = l.x)"""
PREFIX = """, marks AS (SELECT * FROM deep WHERE depth % 3 = 0{leaves}
), x AS (SELECT trace_id, depth, xor(span_id, lag(span_id) OVER (PARTITION BY trace_id{group} ORDER BY span_id)) AS x FROM marks
), g AS (SELECT trace_id{group}, count(*) AS n, coalesce(max(CASE WHEN x = 0 THEN 8 ELSE (64 - length(bin(x))) // 8 END) + 1, 0)::INTEGER AS need FROM x GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY need DESC, n DESC) AS place, sum(n) OVER (PARTITION BY trace_id) AS total FROM g
), needs AS (SELECT trace_id, total::BIGINT AS checkpoints, need AS needed_bytes, n AS forcing FROM r WHERE place = 1)"""
CHAIN = (
    "WITH RECURSIVE heap AS (SELECT user_id::BIGINT AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS r, event_type AS service,"
    " epoch_us(ts)::BIGINT AS start_us, (epoch_us(ts) + floor(value * 36000000000)::BIGINT)::BIGINT AS end_us FROM events WHERE user_id IS NOT NULL)"
    ", spans AS (SELECT u % 10 AS trace_id, row_number() OVER (PARTITION BY u % 10 ORDER BY start_us, u, r)::BIGINT AS span_id,"
    " (row_number() OVER (PARTITION BY u % 10 ORDER BY start_us, u, r) - 1)::BIGINT AS parent_id, service, start_us, end_us FROM heap)"
)


def _weighted(spans: DataFrame) -> DataFrame:
    """Traces drawn by their number of spans: two halves sampled on their own, then merged."""
    per = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_spans"))
    per = per.withColumn("priority", reservoir.priority(reservoir.keyed(F.col("trace_id")), F.col("num_spans")))
    halves = [reservoir.sample(per.where(F.col("trace_id") % 2 == k), 25, ties=("trace_id",)) for k in (0, 1)]
    return reservoir.merged(*halves, 25, ties=("trace_id",)).withColumn("priority", F.round("priority", 9))


def _by_service(spans: DataFrame) -> DataFrame:
    """Twenty spans of every service."""
    rows = spans.withColumn("priority", reservoir.priority(reservoir.keyed(F.col("trace_id") * 100_003 + F.col("span_id"))))
    return reservoir.sample(rows, 20, ("service",), ties=("trace_id", "span_id")).select("service", "trace_id", "span_id")


def entries() -> dict[str, Entry]:
    """All entries by name."""
    joins = START + JOINS
    return {
        "chain_depths": Entry(
            lambda spark, sf_dir: with_depth(chain_spans(spark, sf_dir)).select("trace_id", "span_id", "depth", "root_id"),
            CHAIN + " SELECT trace_id, span_id, (span_id - 1)::INTEGER AS depth, 1::BIGINT AS root_id FROM spans",
        ),
        "chain_clip": Entry(
            lambda spark, sf_dir: structure.crisp_clip(chain_spans(spark, sf_dir)),
            CHAIN
            + """, clip AS (SELECT trace_id, span_id, parent_id, start_us, end_us FROM spans WHERE parent_id = 0
  UNION ALL SELECT s.trace_id, s.span_id, s.parent_id, greatest(s.start_us, c.start_us), least(s.end_us, c.end_us)
  FROM spans s JOIN clip c ON s.trace_id = c.trace_id AND s.parent_id = c.span_id WHERE s.end_us >= c.start_us AND s.start_us <= c.end_us) SELECT * FROM clip""",
        ),
        "collision_grid": Entry(
            wide(studies.collision_grid),
            WIDE
            + DEEP
            + """, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) AS seq FROM deep
), g AS (SELECT trace_id, c.cpd, depth, seq, p.n AS parent_bytes, q.n AS own_bytes, CASE WHEN p.n = 0 THEN 0 ELSE parent_id >> (64 - 8 * p.n) END AS pk,
    CASE WHEN q.n = 0 THEN 0 ELSE span_id >> (64 - 8 * q.n) END AS ok, count(*) AS n
  FROM o CROSS JOIN (VALUES (3), (6)) c(cpd) CROSS JOIN (VALUES (0), (1), (2)) p(n) CROSS JOIN (VALUES (0), (1), (2)) q(n) WHERE depth % c.cpd <> 0 GROUP BY ALL)
SELECT cpd, parent_bytes, own_bytes, sum(n)::BIGINT AS spans, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS collided FROM g GROUP BY ALL""",
        ),
        "prefix_needs": Entry(wide(studies.prefix_needs), WIDE + DEEP + PREFIX.format(leaves="", group="") + " SELECT * FROM needs"),
        "prefix_needs_by_depth": Entry(
            wide(lambda s: studies.prefix_needs(s, per_depth=True, leaves=False)),
            WIDE + DEEP + PREFIX.format(leaves=" AND EXISTS (SELECT 1 FROM spans k WHERE k.trace_id = deep.trace_id AND k.parent_id = deep.span_id)", group=", depth") + " SELECT * FROM needs",
        ),
        "prefix_histogram": Entry(
            wide(lambda s: studies.prefix_histogram(studies.prefix_needs(s, per_depth=True))),
            WIDE + DEEP + PREFIX.format(leaves="", group=", depth") + " SELECT needed_bytes, count(*) AS traces, max(forcing) AS largest_forcing FROM needs GROUP BY needed_bytes",
        ),
        "residue_summary": Entry(
            heap(studies.residue_summary),
            START
            + DEEP
            + """, k AS (SELECT trace_id, parent_id, count(*) AS n FROM spans WHERE parent_id <> 0 GROUP BY ALL
), s AS (SELECT c.cpd, count(*) FILTER (n IS NULL) AS leaves, sum(CASE WHEN n IS NULL THEN depth % c.cpd END) AS total,
    count(*) FILTER (n > 1 AND depth % c.cpd = 0) AS branch_at, count(*) FILTER (n > 1 AND depth % c.cpd <> 0) AS branch_inner
  FROM deep d LEFT JOIN k ON k.trace_id = d.trace_id AND k.parent_id = d.span_id CROSS JOIN (VALUES (2), (3), (4), (5), (6)) c(cpd) GROUP BY c.cpd)
SELECT cpd, leaves, round(total::DOUBLE / leaves, 9) AS mean_residue, round(total::DOUBLE / leaves / (cpd - 1), 9) AS fill, branch_at, branch_inner,
  round(100.0::DOUBLE * branch_inner / (branch_at + branch_inner), 9) AS exposed_pct FROM s""",
        ),
        "trace_widths": Entry(
            dirty(studies.trace_widths),
            f"WITH {DIRTY_SQL}"
            + """, k AS (SELECT trace_id, parent_id, count(*) AS width FROM dirty WHERE parent_id <> 0 GROUP BY ALL) SELECT trace_id, width, count(*) AS spans FROM k GROUP BY ALL""",
        ),
        "fanout_percentiles": Entry(
            dirty(studies.fanout_percentiles),
            f"WITH {DIRTY_SQL}"
            + """, k AS (SELECT trace_id, parent_id, count(*) AS width FROM dirty WHERE parent_id <> 0 GROUP BY ALL), m AS (SELECT max(width) AS n FROM k GROUP BY trace_id
), l AS (SELECT list(n ORDER BY n) AS l FROM m)
SELECT p, l[1 + floor(p * (len(l) - 1))::BIGINT] AS value FROM l
CROSS JOIN (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) x(p)""",
        ),
        "branch_summary": Entry(
            heap(studies.branch_summary),
            START
            + DEEP
            + """, k AS (SELECT trace_id, parent_id, count(*) AS n FROM spans WHERE parent_id <> 0 GROUP BY ALL
), b AS (SELECT d.depth, k.n FROM deep d JOIN k ON k.trace_id = d.trace_id AND k.parent_id = d.span_id WHERE k.n > 1
), l AS (SELECT list(depth ORDER BY depth) AS ds, list(n ORDER BY n) AS ns, count(*) AS c, avg(n) AS m, max(depth) AS dm, max(n) AS nm FROM b)
SELECT (SELECT round(avg(depth), 9) FROM deep) AS mean_depth, c AS branches, round(m, 9) AS mean_fanout, dm AS depth_max, nm AS fanout_max,
  ds[1 + floor(0.5 * (c - 1))::BIGINT] AS depth_p50, ds[1 + floor(0.9 * (c - 1))::BIGINT] AS depth_p90, ns[1 + floor(0.9 * (c - 1))::BIGINT] AS fanout_p90 FROM l""",
        ),
        "duration_stats": Entry(
            heap(studies.duration_stats),
            START
            + """ SELECT trace_id, min(end_us - start_us) AS min_us, max(end_us - start_us) AS max_us, avg(end_us - start_us) AS mean_us,
  count(*) FILTER (end_us <= start_us) AS zero_runtime FROM spans GROUP BY trace_id""",
        ),
        "trace_report": Entry(
            heap(lambda s: studies.trace_report(s).select("trace_id", "num_spans", "max_depth", "min_us", "max_us", "top_services")),
            START
            + DEEP
            + """, n AS (SELECT trace_id, service, count(*) AS c FROM spans GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY c DESC, service) AS place FROM n
), t AS (SELECT trace_id, string_agg(service || ':' || c, ',' ORDER BY place) AS top FROM r WHERE place <= 3 GROUP BY trace_id)
SELECT d.trace_id, count(*) AS num_spans, max(depth)::BIGINT AS max_depth, min(end_us - start_us) AS min_us, max(end_us - start_us) AS max_us, any_value(top) AS top_services
FROM deep d JOIN t ON t.trace_id = d.trace_id GROUP BY d.trace_id""",
        ),
        "multi_parents": Entry(_joins(), joins + " SELECT * FROM joins"),
        "multi_parent_summary": Entry(
            _joins(studies.multi_parent_summary),
            joins
            + """ SELECT count(*) AS joins, count(*) FILTER (children = 0) AS leaves, count(*) FILTER (parents = 'all') AS all_present, count(*) FILTER (parents = 'some') AS some_missing,
  count(*) FILTER (parents = 'none') AS all_missing, sum(refs)::BIGINT AS refs, sum(present)::BIGINT AS refs_present,
  count(*) FILTER (lca_id IS NOT NULL AND lca_service = service) AS lca_same_service, count(*) FILTER (lca_id IS NOT NULL AND lca_service IS DISTINCT FROM service) AS lca_cross_service,
  count(*) FILTER (lca_id IS NULL) AS lca_not_found, count(*) FILTER (dist_a = 1 AND dist_b = 1) AS diamonds, max(below) AS largest_below FROM joins""",
        ),
        "branch_lengths": Entry(
            _joins(studies.branch_lengths),
            joins + " SELECT least(dist_a, dist_b) AS shorter, greatest(dist_a, dist_b) AS longer, count(*) AS joins FROM joins WHERE lca_id IS NOT NULL GROUP BY ALL",
        ),
        "service_edges": Entry(
            _joins(studies.service_edges), joins + " SELECT lca_service || ' -> ' || service AS edge, count(*) AS joins FROM joins WHERE lca_service <> service GROUP BY ALL"
        ),
        "multi_roots": Entry(
            _roots,
            f"WITH RECURSIVE {DIRTY_SQL}"
            + """, s AS (SELECT DISTINCT trace_id, span_id, parent_id FROM dirty
), ids AS (SELECT DISTINCT trace_id, span_id FROM s
), edges AS (SELECT s.trace_id, s.span_id AS a, s.parent_id AS b FROM s JOIN ids k ON k.trace_id = s.trace_id AND k.span_id = s.parent_id
), both AS (SELECT * FROM edges UNION SELECT trace_id, b, a FROM edges
), reach AS (SELECT trace_id, span_id AS a, span_id AS b FROM ids UNION SELECT r.trace_id, r.a, x.b FROM reach r JOIN both x ON x.trace_id = r.trace_id AND x.a = r.b
), label AS (SELECT trace_id, a AS span_id, min(b) AS part FROM reach GROUP BY ALL
), p AS (SELECT l.trace_id, l.part, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM edges e WHERE e.trace_id = l.trace_id AND e.a = l.span_id)) AS roots FROM label l GROUP BY ALL)
SELECT trace_id, sum(roots)::BIGINT AS roots, count(*) AS parts, max(n) AS largest, max(roots) <= 1 AS apart FROM p GROUP BY trace_id HAVING sum(roots) > 1""".replace(
                "both AS", "two_way AS"
            ).replace("JOIN both x", "JOIN two_way x"),
        ),
        "violation_counts": Entry(
            _broken,
            f"WITH {DIRTY_SQL}"
            + """, f AS (SELECT d.trace_id, count(*) FILTER (d.parent_id = 0) AS roots, bool_or(d.parent_id <> 0 AND k.span_id IS NULL) AS dangling, count(*) > count(DISTINCT d.span_id) AS dup
  FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.trace_id)
SELECT ((roots > 1)::INT + dangling::INT + (roots = 0)::INT + dup::INT) AS broken, count(*) AS traces FROM f GROUP BY ALL""",
        ),
        "ancestry_text": Entry(
            heap(lambda s: studies.ancestry_text(studies.ancestry_paths(s, 3))),
            START
            + DEEP
            + PATHS
            + """ SELECT h.trace_id, h.span_id, coalesce(array_to_string(list_transform(p.path, lambda x: format('{:016x}', x)), ','), '') AS ancestry
FROM high h LEFT JOIN paths p ON p.trace_id = h.trace_id AND p.span_id = h.span_id WHERE h.high""",
        ),
        "ancestry_filters": Entry(heap(lambda s: studies.ancestry_filters(studies.ancestry_paths(s, 3), 3))),
        "priorities": Entry(
            _severity,
            START
            + KINDS
            + """ SELECT CASE WHEN carrier THEN 'high' ELSE 'low' END AS prio, count(*) AS spans, count(*) FILTER (dropped) AS dropped FROM drops GROUP BY ALL""",
        ),
        "branch_entries": Entry(
            heap(lambda s: studies.branch_entries(s, 3)),
            START
            + DEEP
            + PATHS
            + """, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) AS seq FROM high
), down AS (SELECT trace_id, span_id AS here, parent_id AS fan, high FROM o WHERE parent_id <> 0 AND seq = 2
  UNION ALL SELECT w.trace_id, o.span_id, w.fan, o.high FROM down w JOIN o ON o.trace_id = w.trace_id AND o.parent_id = w.here AND o.seq = 1 WHERE NOT w.high)
SELECT w.trace_id, w.here AS span_id, w.fan AS parent_id, h.depth::BIGINT AS depth FROM down w JOIN high h ON h.trace_id = w.trace_id AND h.span_id = w.fan WHERE w.high""",
        ),
        "ancestry_sizes": Entry(
            heap(lambda s: studies.ancestry_sizes(s, 3, "bloom").select("trace_id", "bloom_size", "mode_size", "total_nodes", "total_ancestry_size")),
            START
            + DEEP
            + PATHS
            + f""", z AS (SELECT h.trace_id, ({TEXT_BYTES.format("coalesce(len(p.path), 0)")})::BIGINT AS b FROM high h
  LEFT JOIN paths p ON p.trace_id = h.trace_id AND p.span_id = h.span_id WHERE h.high
), t AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id)
SELECT z.trace_id, sum(b)::BIGINT AS bloom_size, 6 * count(*) AS mode_size, any_value(t.n) AS total_nodes, sum(b)::BIGINT + 6 * count(*) AS total_ancestry_size
FROM z JOIN t ON t.trace_id = z.trace_id GROUP BY z.trace_id""",
        ),
        "hybrid_sizes": Entry(
            heap(lambda s: studies.ancestry_sizes(s, 3)),
            START
            + DEEP
            + PATHS
            + f""", o AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY start_us, span_id) AS seq FROM high
), down AS (SELECT trace_id, span_id AS here, parent_id AS fan, high FROM o WHERE parent_id <> 0 AND seq = 2
  UNION ALL SELECT w.trace_id, o.span_id, w.fan, o.high FROM down w JOIN o ON o.trace_id = w.trace_id AND o.parent_id = w.here AND o.seq = 1 WHERE NOT w.high
), ent AS (SELECT w.trace_id, w.here AS span_id, sum(17 + length(h.depth::VARCHAR)) + count(*) - 1 AS hash FROM down w
  JOIN high h ON h.trace_id = w.trace_id AND h.span_id = w.fan WHERE w.high GROUP BY ALL
), z AS (SELECT h.trace_id, ({TEXT_BYTES.format("coalesce(len(p.path), 0)")})::BIGINT AS b, coalesce(e.hash, 0) AS hash FROM high h
  LEFT JOIN paths p ON p.trace_id = h.trace_id AND p.span_id = h.span_id LEFT JOIN ent e ON e.trace_id = h.trace_id AND e.span_id = h.span_id WHERE h.high
), t AS (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id
), q AS (SELECT z.trace_id, sum(b)::BIGINT AS bloom_size, sum(hash)::BIGINT AS hash_size, 6 * count(*) AS mode_size, any_value(t.n) AS total_nodes FROM z
  JOIN t ON t.trace_id = z.trace_id GROUP BY z.trace_id)
SELECT *, bloom_size + hash_size + mode_size AS total_ancestry_size, (bloom_size + hash_size + mode_size)::DOUBLE / total_nodes AS avg_ancestry_size_per_span FROM q""",
        ),
        "ancestry_reconnection": Entry(
            heap(lambda s: studies.reconnected_by_ancestry(s, 0.5, 3, loss.uniform()).where("anchor_id is not null").select("trace_id", "orphan_id", "anchor_id", "synthetic")),
            START
            + KINDS
            + ANCHORS
            + PATHS.replace("high AS (SELECT d.*, k.parent_id IS NULL OR d.depth % 3 = 0 AS high", "high AS (SELECT d.*, k.parent_id IS NULL OR d.depth % 3 = 0 AS high")
            + """, alive AS (SELECT * FROM drops WHERE NOT dropped
), f AS (SELECT a.trace_id, a.span_id, a.span_id AS frag_id, a.depth, a.carrier FROM alive a WHERE NOT EXISTS (SELECT 1 FROM alive p WHERE p.trace_id = a.trace_id AND p.span_id = a.parent_id)
  UNION ALL SELECT s.trace_id, s.span_id, f.frag_id, s.depth, s.carrier FROM alive s JOIN f ON f.trace_id = s.trace_id AND f.span_id = s.parent_id
), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, frag_id ORDER BY depth, span_id) AS place FROM f WHERE carrier) WHERE place = 1
), hits AS (SELECT n.trace_id, n.frag_id, r.depth AS frag_depth, a.span_id AS anchor_id, a.depth, row_number() OVER (PARTITION BY n.trace_id, n.frag_id ORDER BY a.depth DESC) AS place
  FROM near n JOIN drops r ON r.trace_id = n.trace_id AND r.span_id = n.frag_id AND r.parent_id <> 0
  JOIN up u ON u.trace_id = n.trace_id AND u.span_id = n.span_id JOIN alive a ON a.trace_id = u.trace_id AND a.span_id = u.here AND a.depth < r.depth)
SELECT trace_id, frag_id AS orphan_id, anchor_id, (frag_depth - depth - 1)::INTEGER AS synthetic FROM hits WHERE place = 1""",
        ),
        "select_first": Entry(
            heap(lambda s: studies.select_traces(s, first=20).select("trace_id", "span_id")),
            START + " SELECT trace_id, span_id FROM spans WHERE trace_id IN (SELECT DISTINCT trace_id FROM spans ORDER BY trace_id LIMIT 20)",
        ),
        "select_only": Entry(
            heap(lambda s: studies.select_traces(s, only=[3, 5, 8]).select("trace_id", "span_id")), START + " SELECT trace_id, span_id FROM spans WHERE trace_id IN (3, 5, 8)"
        ),
        "select_sample": Entry(
            heap(lambda s: studies.select_traces(s, sample=25).select("trace_id").distinct()),
            START
            + f""", u AS (SELECT trace_id, {reservoir.keyed_sql("trace_id")} AS u FROM (SELECT DISTINCT trace_id FROM spans))
SELECT trace_id FROM u ORDER BY -ln(u), trace_id LIMIT 25""",
        ),
        "select_weighted": Entry(
            heap(_weighted),
            START
            + f""", u AS (SELECT trace_id, n, -ln({reservoir.keyed_sql("trace_id")}) / n AS p FROM (SELECT trace_id, count(*) AS n FROM spans GROUP BY trace_id))
SELECT trace_id, n AS num_spans, round(p, 9) AS priority FROM u ORDER BY p, trace_id LIMIT 25""",
        ),
        "sample_by_service": Entry(
            heap(_by_service),
            START
            + f""", u AS (SELECT service, trace_id, span_id, -ln({reservoir.keyed_sql("trace_id * 100003 + span_id")}) AS p FROM spans)
SELECT service, trace_id, span_id FROM u QUALIFY row_number() OVER (PARTITION BY service ORDER BY p, trace_id, span_id) <= 20""",
        ),
        "sizes_by_distance": Entry(
            heap(lambda s: studies.sizes_by_distance(s, ("pcr",), (2, 3, 5))),
            START
            + DEEP
            + """, k AS (SELECT d.trace_id, c.cpd, x.parent_id IS NULL OR d.depth % c.cpd = 0 AS carrier FROM deep d
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) x ON x.trace_id = d.trace_id AND x.parent_id = d.span_id CROSS JOIN (VALUES (2), (3), (5)) c(cpd)
), m AS (SELECT cpd, trace_id, 9 * count(*) FILTER (carrier)::DOUBLE / count(*) AS a FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT 'pcr' AS mode, cpd, count(*) AS traces, round(avg(a), 9) AS mean, round(stddev(a), 9) AS deviation FROM m GROUP BY cpd""",
        ),
        "pooled_sizes": Entry(
            _pooled,
            START
            + DEEP
            + """, k AS (SELECT d.trace_id, x.parent_id IS NULL OR d.depth % 3 = 0 AS carrier FROM deep d
  LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) x ON x.trace_id = d.trace_id AND x.parent_id = d.span_id
), m AS (SELECT s.mode, trace_id, s.size * count(*) FILTER (carrier)::DOUBLE / count(*) AS a FROM k
  CROSS JOIN (VALUES ('pcr', 9), ('pcrb', 9 + ceil(ceil(-2 * ln(0.0001) / (ln(2) * ln(2))) / 8)::BIGINT)) s(mode, size) GROUP BY s.mode, s.size, trace_id HAVING count(*) > 1
), d AS (SELECT mode, trace_id % 2 AS day, count(*) AS n, round(avg(a), 9) AS a FROM m GROUP BY ALL)
SELECT mode, 3 AS cpd, sum(n)::BIGINT AS traces, round(sum(a * n) / sum(n), 9) AS mean FROM d GROUP BY mode""",
        ),
        "log_correlations": Entry(
            dirty(studies.log_correlations),
            f"WITH {DIRTY_SQL}"
            + """, p AS (SELECT trace_id, count(*)::DOUBLE AS num_spans, (max(end_us) - min(start_us))::DOUBLE AS duration_us, count(DISTINCT service)::DOUBLE AS num_services FROM dirty GROUP BY trace_id
), l AS (SELECT 'num_spans' AS a, 'duration_us' AS b, num_spans AS x, duration_us AS y FROM p UNION ALL SELECT 'num_spans', 'num_services', num_spans, num_services FROM p
  UNION ALL SELECT 'duration_us', 'num_services', duration_us, num_services FROM p)
SELECT a, b, count(*) AS traces, CASE WHEN var_pop(log10(x)) > 0 AND var_pop(log10(y)) > 0 THEN round(corr(log10(x), log10(y)), 6) END AS r FROM l WHERE x > 0 AND y > 0 GROUP BY a, b""",
        ),
        "pooled_rate": Entry(
            dirty(studies.pooled_rate),
            f"WITH {DIRTY_SQL}"
            + """, t AS (SELECT d.service, count(*) AS n, count(*) FILTER (d.parent_id <> 0 AND k.span_id IS NULL) AS g
  FROM dirty d LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM dirty) k ON k.trace_id = d.trace_id AND k.span_id = d.parent_id GROUP BY d.service HAVING count(*) >= 100)
SELECT count(*) AS services, sum(n)::BIGINT AS spans, sum(g)::BIGINT AS dangling, sum(g)::DOUBLE / sum(n) AS rate FROM t""",
        ),
        "density_percentiles": Entry(
            heap(studies.density_percentiles),
            START
            + """, b AS (SELECT count(*) AS n FROM (SELECT start_us AS ts FROM spans UNION ALL SELECT end_us FROM spans) GROUP BY ts // 86400000000
), l AS (SELECT list(n ORDER BY n) AS l FROM b)
SELECT p, l[1 + least(floor(p * len(l))::BIGINT, len(l) - 1)] AS value FROM l CROSS JOIN (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) x(p)""",
        ),
        "component_gaps": Entry(
            lambda spark, sf_dir: structure.component_gaps(ingest._short(spark, sf_dir).withColumnsRenamed({"start_ns": "start_us", "end_ns": "end_us"})),
            START
            + """, t AS (SELECT trace_id * 1000000 + span_id AS id, start_us * 1000 AS lo, (start_us + (end_us - start_us) // 1000) * 1000 AS hi FROM spans
), m AS (SELECT *, max(hi) OVER (ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t
), c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, id ROWS UNBOUNDED PRECEDING) AS component FROM m
), g AS (SELECT component, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM c GROUP BY component
), d AS (SELECT n, lead(lo) OVER (ORDER BY component) - hi AS gap FROM g
), l AS (SELECT count(*) AS components, max(n) AS largest, min(gap) AS gap_min, max(gap) AS gap_max, list(gap ORDER BY gap) FILTER (gap IS NOT NULL) AS gaps FROM d)
SELECT components, largest, gap_min, gap_max, gaps[1 + floor(0.5 * (len(gaps) - 1))::BIGINT] AS gap_median FROM l""",
        ),
        "generated_chain": Entry(_generated("chain", depth=7), START + " SELECT DISTINCT trace_id, 8::BIGINT AS spans, 7::BIGINT AS max_depth, 16::BIGINT AS ticks FROM spans"),
        "generated_star": Entry(_generated("star", depth=3, fanout=5), START + " SELECT DISTINCT trace_id, 6::BIGINT AS spans, 1::BIGINT AS max_depth, 12::BIGINT AS ticks FROM spans"),
        "generated_kary": Entry(_generated("kary", depth=4, fanout=3), START + " SELECT DISTINCT trace_id, 121::BIGINT AS spans, 4::BIGINT AS max_depth, 242::BIGINT AS ticks FROM spans"),
        "generated_skewed": Entry(_generated("skewed", depth=6, fanout=3)),
        "generated_spine": Entry(_generated("spine", depth=20, fanout=2, fanout_law="geometric", max_spans=300)),
        "generated_deepwide": Entry(_generated("deepwide", depth=12, fanout=4, max_spans=400)),
        "generated_slab": Entry(_generated("slab", depth=10, fanout=3, max_spans=300, spindle=5, concurrency=0.5)),
        "generated_laws": Entry(_laws),
        "online_evaluation": Entry(_online),
    }


def fixed_entries() -> dict[str, Entry]:
    """Closed forms over stated settings: they read no table, so they are not registered; tests compare them with SQL."""
    return {
        "complete_trees": Entry(
            _complete,
            """WITH RECURSIVE grid(t, depth, width) AS (VALUES (0, 2, 1), (1, 2, 2), (2, 3, 3), (3, 4, 2)
), took AS (SELECT t, depth, width, 0 AS h, 500::BIGINT AS l FROM grid UNION ALL SELECT t, depth, width, h + 1, width * (l + 1000) FROM took WHERE h < depth
), nodes AS (
  SELECT g.t, g.depth AS total, g.width, 0 AS d, 0::BIGINT AS i, 1798570615451777::BIGINT AS s FROM grid g
  UNION ALL
  SELECT n.t, n.total, n.width, n.d + 1, n.i * n.width + k.k, n.s + k.k * (tk.l + 1000) FROM nodes n JOIN took tk ON tk.t = n.t AND tk.h = n.total - n.d - 1
  JOIN range(3) k(k) ON k.k < n.width WHERE n.d < n.total
), b AS (SELECT n.*, CASE WHEN n.width = 1 THEN n.d ELSE (n.width ** n.d - 1) / (n.width - 1) END::BIGINT AS before,
    CASE WHEN n.d = 0 THEN 0 WHEN n.width = 1 THEN n.d - 1 ELSE (n.width ** (n.d - 1) - 1) / (n.width - 1) END::BIGINT AS above FROM nodes n)
SELECT b.t::BIGINT AS trace_id, b.before + i + 1 AS span_id, (CASE WHEN d = 0 THEN 0 ELSE above + i // b.width + 1 END)::BIGINT AS parent_id,
  'Service' || (b.before + i + 1) AS service, s AS start_us, s + tk.l AS end_us, d AS depth FROM b JOIN took tk ON tk.t = b.t AND tk.h = b.total - b.d""",
        ),
        "tree_documents": Entry(
            _tree_documents, "SELECT * FROM (VALUES (0::BIGINT, 3::BIGINT, 2), (1, 7, 2), (2, 40, 3), (3, 31, 4)) v(trace_id, spans, max_depth)"
        ),
        "tree_grid": Entry(
            lambda spark, sf_dir: generate.tree_grid(spark),
            """SELECT d::INTEGER AS depth, w::INTEGER AS width, (CASE WHEN w = 1 THEN d + 1 ELSE (w::HUGEINT ** (d + 1) - 1) / (w - 1) END)::BIGINT AS nodes,
  20 * (CASE WHEN w = 1 THEN d + 1 ELSE (w::HUGEINT ** (d + 1) - 1) / (w - 1) END)::BIGINT AS total FROM range(2, 11) a(d) CROSS JOIN range(1, 21) b(w)""",
        ),
        "closed_sizes": Entry(
            lambda spark, sf_dir: generate.closed_sizes(spark, range(2, 7), range(1, 11), 3).drop("avg_ancestry_size_per_span"),
            f"""WITH g AS (SELECT d::INTEGER AS depth, w::INTEGER AS width FROM range(2, 7) a(d) CROSS JOIN range(1, 11) b(w)
), l AS (SELECT g.*, x.x::INTEGER AS d, (g.width ** x.x)::BIGINT AS n FROM g JOIN range(7) x(x) ON x.x <= g.depth
), m AS (SELECT *, d - coalesce(lag(d) OVER (PARTITION BY depth, width ORDER BY d), 0) AS path FROM l WHERE d = 0 OR d = depth OR d % 3 = 0
), t AS (SELECT depth, width, sum(n)::BIGINT AS total_nodes FROM l GROUP BY ALL)
SELECT m.depth, m.width, any_value(t.total_nodes) AS total_nodes, sum(n * ({TEXT_BYTES.format("path")}))::BIGINT AS bloom_size,
  sum(CASE WHEN m.width > 1 THEN n * path * 15 ELSE 0 END)::BIGINT AS hash_size, (6 * sum(n))::BIGINT AS mode_size,
  (sum(n * ({TEXT_BYTES.format("path")})) + sum(CASE WHEN m.width > 1 THEN n * path * 15 ELSE 0 END) + 6 * sum(n))::BIGINT AS total_ancestry_size
FROM m JOIN t ON t.depth = m.depth AND t.width = m.width GROUP BY m.depth, m.width""",
        ),
        "truss_sizes": Entry(
            lambda spark, sf_dir: generate.truss_sizes(spark, (1, 2, 3, 4, 6, 8, 12), (1, 2, 3, 4, 6, 8, 12)),
            """WITH v AS (SELECT unnest([1, 2, 3, 4, 6, 8, 12])::INTEGER AS n)
SELECT s.n AS waves, w.n AS width, ((s.n - 1) * (w.n * (8 + 12 * w.n) + 12 * w.n))::DOUBLE / (s.n * w.n) AS mean_bytes FROM v s CROSS JOIN v w""",
        ),
    }
