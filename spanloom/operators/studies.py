"""Studies over whole corpora: id collisions, several parents and roots, priorities, selections, pooled figures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import hashing, tags
from spanloom.operators import handlers, reservoir, structure
from spanloom.operators.arrival import trace_properties
from spanloom.operators.handlers import Scheme
from spanloom.plans.traces import groups, map_traces
from spanloom.plans.tree import ancestors, fold_up, longest, parent_rows, walk_up, with_depth, with_tree
from spanloom.session import materialize

MODE_BYTES = 6  # of the tag that names the ancestry mode


def collision_grid(spans: DataFrame, cpds: tuple[int, ...] = (3, 6), parent_max: int = 2, own_max: int = 2) -> DataFrame:
    """Per checkpoint distance and prefix widths: spans off checkpoints, and those that depth, ordinal and prefixes do not tell apart."""
    deep = with_depth(spans).join(structure.sibling_ordinals(spans), ["trace_id", "span_id"])
    both = deep.withColumn("cpd", F.explode(F.array(*map(F.lit, cpds)))).where("depth % cpd <> 0")
    head = lambda c, n: F.when(n == 0, F.lit("")).otherwise(F.substring(hashing.id_hex(F.col(c)), F.lit(1), 2 * n))
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p in range(parent_max + 1) for o in range(own_max + 1)]))
    grid = both.select("trace_id", "cpd", "depth", "seq", "parent_id", "span_id", cells.alias("g"))
    key = [head("parent_id", F.col("g.p")).alias("pk"), head("span_id", F.col("g.o")).alias("ok")]
    per = grid.groupBy("trace_id", "cpd", "depth", "seq", F.col("g.p").alias("parent_bytes"), F.col("g.o").alias("own_bytes"), *key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cpd", "parent_bytes", "own_bytes").agg(
        F.sum("n").alias("spans"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("collided")
    )


def prefix_needs(spans: DataFrame, cpd: int = 3, per_depth: bool = False, leaves: bool = True) -> DataFrame:
    """Per trace: checkpoints, the bytes of id prefix that tell them apart, and the size of the group that forces it.

    ``per_depth``: checkpoints of different depths need not be told apart; ``leaves=False``: those without children do not count.
    """
    marks = with_tree(spans).where(F.col("depth") % cpd == 0)
    marks = marks if leaves else marks.where("children > 0")
    group = ["trace_id", "depth"] if per_depth else ["trace_id"]
    before = F.lag("span_id").over(Window.partitionBy(*group).orderBy(hashing.unsigned(F.col("span_id"))))
    x = marks.withColumn("x", F.col("span_id").bitwiseXOR(before))
    common = F.when(F.col("x") == 0, F.lit(8)).otherwise(F.floor((64 - F.length(F.bin("x"))) / 8))
    per = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(common) + 1, F.lit(0)).cast("int").alias("need"))
    force = F.max(F.struct("need", "n"))
    out = per.groupBy("trace_id").agg(F.sum("n").alias("checkpoints"), force.alias("f"))
    return out.select("trace_id", "checkpoints", F.col("f.need").alias("needed_bytes"), F.col("f.n").alias("forcing"))


def prefix_histogram(needs: DataFrame) -> DataFrame:
    """Traces by needed bytes, with the largest forcing group."""
    return needs.groupBy("needed_bytes").agg(F.count(F.lit(1)).alias("traces"), F.max("forcing").alias("largest_forcing"))


def residue_summary(spans: DataFrame, low: int = 2, high: int = 6) -> DataFrame:
    """Per checkpoint distance: leaves, their mean depth past a checkpoint, how full the last window is, branches on and off checkpoints."""
    each = with_tree(spans).withColumn("cpd", F.explode(F.sequence(F.lit(low), F.lit(high))))
    residue, leaf, branch = F.col("depth") % F.col("cpd"), F.col("children") == 0, F.col("children") > 1
    sums = each.groupBy("cpd").agg(
        F.count(F.when(leaf, 1)).alias("leaves"),
        F.sum(F.when(leaf, residue)).cast("long").alias("total"),
        F.count(F.when(branch & (residue == 0), 1)).alias("branch_at"),
        F.count(F.when(branch & (residue != 0), 1)).alias("branch_inner"),
    )
    mean = F.try_divide(F.col("total"), F.col("leaves"))
    exposed = F.try_divide(100 * F.col("branch_inner"), F.col("branch_at") + F.col("branch_inner"))
    return sums.select("cpd", "leaves", F.round(mean, 9).alias("mean_residue"), F.round(mean / (F.col("cpd") - 1), 9).alias("fill"), "branch_at", "branch_inner", F.round(exposed, 9).alias("exposed_pct"))


def trace_widths(spans: DataFrame) -> DataFrame:
    """Per trace: how many spans have how many children."""
    kids = spans.where("parent_id <> 0").groupBy("trace_id", "parent_id").agg(F.count(F.lit(1)).alias("width"))
    return kids.groupBy("trace_id", "width").agg(F.count(F.lit(1)).alias("spans"))


def fanout_percentiles(spans: DataFrame) -> DataFrame:
    """Percentiles (index rule) over traces of the largest fan-out."""
    widest = trace_widths(spans).groupBy("trace_id").agg(F.max("width").alias("n"))
    return structure.index_percentiles(widest, "n", (0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0))


def branch_summary(spans: DataFrame) -> DataFrame:
    """One row: mean depth, and where branching lives (depths and fan-outs of spans with several children, index rule)."""
    deep = materialize(with_tree(spans).select("depth", "children"), "branches")
    points = deep.where("children > 1")
    pick = lambda c, p, name: structure.index_percentiles(points, c, (p,)).select(F.col("value").alias(name))
    out = deep.agg(F.round(F.avg("depth"), 9).alias("mean_depth")).crossJoin(F.broadcast(points.agg(F.count(F.lit(1)).alias("branches"), F.round(F.avg("children"), 9).alias("mean_fanout"), F.max("depth").alias("depth_max"), F.max("children").alias("fanout_max"))))
    for part in (pick("depth", 0.5, "depth_p50"), pick("depth", 0.9, "depth_p90"), pick("children", 0.9, "fanout_p90")):
        out = out.join(F.broadcast(part), F.lit(True), "left")
    return out


def duration_stats(spans: DataFrame) -> DataFrame:
    """Per trace: least, greatest and mean duration of its spans, and how many took no time."""
    took = F.col("end_us") - F.col("start_us")
    return spans.groupBy("trace_id").agg(
        F.min(took).alias("min_us"), F.max(took).alias("max_us"), F.avg(took).alias("mean_us"), F.count(F.when(took <= 0, 1)).alias("zero_runtime")
    )


def trace_report(spans: DataFrame, k: int = 3) -> DataFrame:
    """Per trace in one row: shape, durations and the most frequent services (``name:count``, ties by name)."""
    top = structure.top_services(spans, k).groupBy("trace_id")
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", "service", "spans"))), lambda x: F.concat_ws(":", x["service"], x["spans"]))
    per = structure.trace_shape(spans).join(duration_stats(spans).drop("zero_runtime"), "trace_id")
    return per.join(top.agg(F.array_join(named, ",").alias("top_services")), "trace_id")


# ---- several parents, several roots ----


def multi_parents(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with several parent references: how many are there, what hangs below, and where the first two meet.

    ``refs`` has ``trace_id, span_id, place, parent_id`` (``place`` from 0); ``spans`` has services, its
    ``parent_id`` the first reference. ``lca_id`` is the lowest known span above or at both, ``dist_a`` and
    ``dist_b`` the steps to it; null if they do not meet.
    """
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("parent_service"))
    rows = refs.join(known, ["trace_id", "parent_id"], "left")
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("parent_id")))
    services = F.array_join(F.array_sort(F.collect_list(F.coalesce("parent_service", F.lit("?")))), "|")
    per = rows.groupBy("trace_id", "span_id").agg(
        F.count(F.lit(1)).alias("refs"), F.count("parent_service").alias("present"), services.alias("parent_services"), at(0).alias("a"), at(1).alias("b")
    )
    many = materialize(per.where("refs > 1").join(spans.select("trace_id", "span_id", "service"), ["trace_id", "span_id"]), "joins")
    paths = materialize(ancestors(spans), "paths")
    below = paths.groupBy("trace_id", F.col("ancestor_id").alias("span_id")).agg(F.count(F.lit(1)).alias("below"), F.count(F.when(F.col("distance") == 1, 1)).alias("children"))
    side = lambda c: (
        many.select("trace_id", "span_id", F.col(c).alias("from"))
        .join(paths.withColumnRenamed("span_id", "from"), ["trace_id", "from"])
        .select("trace_id", "span_id", "ancestor_id", "distance")
        .unionByName(many.select("trace_id", "span_id", F.col(c).alias("ancestor_id"), F.lit(0).alias("distance")))
    )
    met = side("a").withColumnRenamed("distance", "da").join(side("b").withColumnRenamed("distance", "db"), ["trace_id", "span_id", "ancestor_id"])
    first = met.groupBy("trace_id", "span_id").agg(F.min(F.struct("db", "da", "ancestor_id")).alias("m"))
    lca = first.select("trace_id", "span_id", F.col("m.ancestor_id").alias("lca_id"), F.col("m.da").alias("dist_a"), F.col("m.db").alias("dist_b"))
    owner = spans.select("trace_id", F.col("span_id").alias("lca_id"), F.col("service").alias("lca_service"))
    out = many.join(below, ["trace_id", "span_id"], "left").join(lca, ["trace_id", "span_id"], "left").join(owner, ["trace_id", "lca_id"], "left")
    kind = F.when(F.col("present") == F.col("refs"), "all").when(F.col("present") == 0, "none").otherwise("some")
    return out.select(
        "trace_id", "span_id", "service", "refs", "present", kind.alias("parents"), "parent_services", F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("below", F.lit(0)).alias("below"), "lca_id", "dist_a", "dist_b", "lca_service",
    )


def multi_parent_summary(joins: DataFrame) -> DataFrame:
    """One row of :func:`multi_parents`: leaves, kinds, references that resolve, services of the meeting points, diamonds."""
    n = lambda c: F.count(F.when(c, 1))
    met = F.col("lca_id").isNotNull()
    return joins.agg(
        F.count(F.lit(1)).alias("joins"), n(F.col("children") == 0).alias("leaves"), n(F.col("parents") == "all").alias("all_present"), n(F.col("parents") == "some").alias("some_missing"),
        n(F.col("parents") == "none").alias("all_missing"), F.sum("refs").alias("refs"), F.sum("present").alias("refs_present"),
        n(met & F.col("lca_service").eqNullSafe(F.col("service"))).alias("lca_same_service"), n(met & ~F.col("lca_service").eqNullSafe(F.col("service"))).alias("lca_cross_service"),
        n(~met).alias("lca_not_found"), n((F.col("dist_a") == 1) & (F.col("dist_b") == 1)).alias("diamonds"), F.max("below").alias("largest_below"),
    )


def branch_lengths(joins: DataFrame) -> DataFrame:
    """How often the two paths from the meeting point have which lengths (the shorter first)."""
    return joins.where("lca_id is not null").groupBy(F.least("dist_a", "dist_b").alias("shorter"), F.greatest("dist_a", "dist_b").alias("longer")).agg(F.count(F.lit(1)).alias("joins"))


def service_edges(joins: DataFrame) -> DataFrame:
    """How often a fan-out in one service meets again in another."""
    return joins.where("lca_service <> service").groupBy(F.concat_ws(" -> ", "lca_service", "service").alias("edge")).agg(F.count(F.lit(1)).alias("joins"))


def labelled_parts(spans: DataFrame, refs: DataFrame) -> DataFrame:
    """``trace_id, span_id, part``: spans that hang together by references in any direction share the smallest id (unsigned)."""
    edges = refs.groupBy("trace_id", "span_id").agg(F.collect_set("parent_id").alias("parents"))
    rows = spans.select("trace_id", "span_id").distinct().join(edges, ["trace_id", "span_id"], "left")

    def run(rows: pa.Table) -> pa.Table:
        trace, span = (rows.column(c).to_numpy() for c in ("trace_id", "span_id"))
        parents = rows.column("parents").to_pylist()
        label = np.zeros(len(span), dtype=np.int64)
        for a, b in groups(trace):
            at = {int(s): i for i, s in enumerate(span[a:b])}
            root = list(range(b - a))

            def find(i: int) -> int:
                while root[i] != i:  # noqa: B023
                    root[i] = i = root[root[i]]  # noqa: B023
                return i

            for i in range(b - a):
                for p in parents[a + i] or ():
                    j = at.get(p)
                    if j is not None:
                        x, y = find(i), find(j)
                        # the smaller id, as an unsigned number, stays
                        x, y = (x, y) if int(span[a + x]) & (1 << 64) - 1 <= int(span[a + y]) & (1 << 64) - 1 else (y, x)
                        root[y] = x
            label[a:b] = [span[a + find(i)] for i in range(b - a)]
        return pa.table([trace, span, label], names=["trace_id", "span_id", "part"])

    return map_traces(rows, run, "trace_id bigint, span_id bigint, part bigint")


def multi_roots(spans: DataFrame, refs: DataFrame) -> DataFrame:
    """Per trace with several roots (spans without a known parent): roots, parts, the largest part, and whether each root has its own."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    linked = refs.join(known, ["trace_id", "parent_id"], "left_semi").select("trace_id", "span_id").distinct().withColumn("has", F.lit(1))
    rows = labelled_parts(spans, refs).join(linked, ["trace_id", "span_id"], "left")
    per = rows.groupBy("trace_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("has").isNull(), 1)).alias("roots"))
    out = per.groupBy("trace_id").agg(
        F.sum("roots").alias("roots"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"), (F.max("roots") <= 1).alias("apart")
    )
    return out.where("roots > 1")


def violation_counts(flags: DataFrame) -> DataFrame:
    """How many traces break how many rules."""
    n = sum((F.col(c).cast("int") for c in ("multi_root", "dangling", "multi_parent", "rootless", "duplicate")), F.lit(0))
    return flags.groupBy(n.alias("broken")).agg(F.count(F.lit(1)).alias("traces"))


# ---- priorities and ancestry records ----


def with_priority(spans: DataFrame, distance: int) -> DataFrame:
    """``spans`` plus depth, children and ``prio``: high for roots, leaves and every ``distance``-th level (0: none), else low."""
    deep = with_tree(spans)
    level = (F.col("depth") % distance == 0) if distance > 0 else F.lit(False)
    high = (F.col("parent_id") == 0) | (F.col("children") == 0) | level
    return deep.withColumn("prio", F.when(high, "high").otherwise("low"))


def ancestry_paths(spans: DataFrame, distance: int) -> DataFrame:
    """``trace_id, span_id, prio, path``: for high-priority spans the ids from the last one above down to the parent."""
    p = with_priority(spans, distance)
    high = F.col("prio") == "high"
    held = fold_up(p, {"_top": (F.col("span_id"), "first"), "_at": (F.col("depth"), "first")}, stop=high, parents=True, sized=True)
    asked = materialize(held.where(high).select("trace_id", "span_id", "prio", (F.col("depth") - F.col("p__at")).alias("steps")), "asked")
    most = asked.agg(F.max("steps")).first()[0] or 1
    paths = ancestors(spans, within=most).join(asked.select("trace_id", "span_id", "steps"), ["trace_id", "span_id"]).where("distance <= steps")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor_id")), asc=False), lambda x: x["ancestor_id"])
    path = paths.groupBy("trace_id", "span_id").agg(ids.alias("path"))
    return asked.join(path, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "prio", F.coalesce("path", F.array().cast("array<bigint>")).alias("path"))


def ancestry_text(paths: DataFrame) -> DataFrame:
    """The paths as text: hex ids with commas."""
    return paths.select("trace_id", "span_id", F.array_join(F.transform("path", hashing.id_hex), ",").alias("ancestry"))


def ancestry_filters(paths: DataFrame, members: int, p: float = 0.01) -> DataFrame:
    """The paths as filters of one size, in base64."""
    m, k = hashing.bloom_size(members, p)
    return paths.select("trace_id", "span_id", F.base64(hashing.bloom_of_ids(F.col("path"), m, k)).alias("ancestry"))


def branch_entries(spans: DataFrame, distance: int) -> DataFrame:
    """``trace_id, span_id, parent_id, depth``: for every span with several children, the high-priority span that records it.

    It is the first one reached from the second child by start along first children.
    """
    p = with_priority(spans, distance).select("trace_id", "span_id", "parent_id", "start_us", "depth", (F.col("prio") == "high").alias("high"))

    def run(rows: pa.Table) -> pa.Table:
        trace, span, parent, start, depth = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "parent_id", "start_us", "depth"))
        high = rows.column("high").to_numpy(zero_copy_only=False)
        up = parent_rows(trace, span, parent)
        seq = handlers.sibling_order(trace, span, up, start)
        first = np.full(len(span), -1)
        one, two = np.flatnonzero(seq == 1), np.flatnonzero(seq == 2)
        first[up[one]] = one
        top, _ = walk_up(np.where(high, -1, first), longest(trace), [])
        at = top[two]
        return pa.table([trace[two], span[at], span[up[two]], depth[up[two]].astype(np.int64)], names=["trace_id", "span_id", "parent_id", "depth"])

    return map_traces(p, run, "trace_id bigint, span_id bigint, parent_id bigint, depth bigint")


def ancestry_sizes(spans: DataFrame, distance: int, mode: str = "hybrid", id_chars: int = 16, p: float = 0.01) -> DataFrame:
    """Per trace: characters of filters, hash arrays (``id:depth`` with commas) and mode tags of its high-priority spans."""
    paths = ancestry_paths(spans, distance).select("trace_id", "span_id", F.size("path").alias("n"))
    most = paths.agg(F.max("n")).first()[0] or 0
    sizes = F.element_at(F.array(*[F.lit(tags.filter_text_bytes(n, p)) for n in range(most + 1)]), F.col("n") + 1)
    bloom = sizes if mode in ("bloom", "hybrid") else F.lit(0)
    rows = paths.withColumn("bloom", bloom)
    if mode == "hybrid":
        entry = F.lit(id_chars + 1) + F.length(F.col("depth").cast("string"))
        held = branch_entries(spans, distance).groupBy("trace_id", "span_id").agg((F.sum(entry) + F.count(F.lit(1)) - 1).alias("hash"))
        rows = rows.join(held, ["trace_id", "span_id"], "left")
    else:
        rows = rows.withColumn("hash", F.lit(0).cast("long"))
    total = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total_nodes"))
    per = rows.groupBy("trace_id").agg(
        F.sum("bloom").cast("long").alias("bloom_size"), F.coalesce(F.sum("hash"), F.lit(0)).cast("long").alias("hash_size"), (MODE_BYTES * F.count(F.lit(1))).alias("mode_size")
    )
    out = per.join(total, "trace_id").withColumn("total_ancestry_size", F.col("bloom_size") + F.col("hash_size") + F.col("mode_size"))
    return out.withColumn("avg_ancestry_size_per_span", F.col("total_ancestry_size") / F.col("total_nodes"))


def protected_drops(spans: DataFrame, rate: float, distance: int, draw: Column) -> DataFrame:
    """``spans`` with priority and ``dropped``: only low-priority spans whose ``draw`` lies below the rate are lost."""
    return with_priority(spans, distance).withColumn("dropped", (F.col("prio") == "low") & (F.lit(rate >= 1) | (draw < rate)))


def reconnected_by_ancestry(spans: DataFrame, rate: float, distance: int, draw: Column) -> DataFrame:
    """Orphans put back by the path that the nearest carrier at or below them wrote: its last surviving id above the orphan.

    Confidence is 1 for a path of ids. Orphans whose fragment has no carrier keep a null anchor.
    """
    d = materialize(protected_drops(spans, rate, distance, draw), "protected")
    alive = d.where("not dropped")
    parts = fold_up(alive, {}, sized=True).select("trace_id", "span_id", "depth", "prio", F.col("top_id").alias("frag_id"), "parent_id")
    roots = parts.where("span_id = frag_id and parent_id <> 0").select("trace_id", "frag_id", F.col("depth").alias("frag_depth"))
    carriers = parts.where("prio = 'high'").groupBy("trace_id", "frag_id").agg(F.min(F.struct("depth", "span_id")).alias("c"))
    named = roots.join(carriers, ["trace_id", "frag_id"], "left").select("trace_id", "frag_id", "frag_depth", F.col("c.span_id").alias("span_id"))
    paths = ancestry_paths(spans, distance).select("trace_id", "span_id", F.posexplode("path").alias("pos", "anchor_id"))
    left = alive.select("trace_id", F.col("span_id").alias("anchor_id"), F.col("depth").alias("anchor_depth"))
    hits = named.join(paths, ["trace_id", "span_id"]).join(left, ["trace_id", "anchor_id"]).where("anchor_depth < frag_depth")
    best = hits.groupBy("trace_id", "frag_id").agg(F.max(F.struct("anchor_depth", "anchor_id")).alias("b"))
    out = named.join(best, ["trace_id", "frag_id"], "left")
    synthetic = (F.col("frag_depth") - F.col("b.anchor_depth") - 1).cast("int")
    return out.select("trace_id", F.col("frag_id").alias("orphan_id"), F.col("b.anchor_id").alias("anchor_id"), synthetic.alias("synthetic"), F.when(F.col("b").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


# ---- selections and pooled figures ----


def select_traces(spans: DataFrame, first: int | None = None, sample: int | None = None, seed: int = 42, only: list[int] | None = None) -> DataFrame:
    """Spans of some traces: the first by id (unsigned), a seeded sample, or a list."""
    ids = spans.select("trace_id").distinct()
    if only is not None:
        return spans.where(F.col("trace_id").isin(only))
    if sample is not None:
        drawn = ids.withColumn("priority", reservoir.priority(reservoir.keyed(F.col("trace_id"), seed)))
        ids = reservoir.sample(drawn, sample, ties=("trace_id",)).select("trace_id")
    if first is not None:
        ids = ids.orderBy(hashing.unsigned(F.col("trace_id"))).limit(first)
    return spans.join(ids, "trace_id", "left_semi")


def sizes_by_distance(spans: DataFrame, names: tuple[str, ...], cpds: tuple[int, ...]) -> DataFrame:
    """Per scheme and checkpoint distance over traces of several spans: mean and deviation of payload bytes per span."""
    out = None
    for name in names:
        for cpd in cpds:
            m = handlers.trace_metrics(handlers.payloads(spans, Scheme(name, cpd))).where("num_spans > 1")
            part = m.agg(F.count(F.lit(1)).alias("traces"), F.round(F.avg("amortized_by_total"), 9).alias("mean"), F.round(F.stddev("amortized_by_total"), 9).alias("deviation"))
            part = part.select(F.lit(name).alias("mode"), F.lit(cpd).alias("cpd"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def pooled(parts: list[DataFrame], keys: list[str], weight: str, values: list[str]) -> DataFrame:
    """Tables of several days as one: means weighted by ``weight``, which adds up."""
    both = parts[0]
    for more in parts[1:]:
        both = both.unionByName(more)
    mean = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)), 9)
    return both.groupBy(*keys).agg(F.sum(weight).alias(weight), *[mean(c).alias(c) for c in values])


def log_correlations(spans: DataFrame) -> DataFrame:
    """Pearson correlation of the logarithms of every two trace properties, over traces where both are positive."""
    t = materialize(trace_properties(spans), "properties")
    names = ["num_spans", "duration_us", "num_services"]
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            rows = t.where((F.col(a) > 0) & (F.col(b) > 0))
            x, y = F.log10(F.col(a).cast("double")), F.log10(F.col(b).cast("double"))
            part = rows.agg(F.count(F.lit(1)).alias("traces"), F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 6).alias("r"))
            part = part.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def pooled_rate(spans: DataFrame, least: int = 100) -> DataFrame:
    """One row: services of at least ``least`` spans, their spans and dangling ones, and the rate over all of them."""
    t = structure.service_totals(spans).where(F.col("total_spans") >= least)
    return t.agg(F.count(F.lit(1)).alias("services"), F.sum("total_spans").alias("spans"), F.sum("dangling_spans").alias("dangling"), F.try_divide(F.sum("dangling_spans"), F.sum("total_spans")).alias("rate"))


def density_percentiles(spans: DataFrame, window_us: int = 86_400_000_000) -> DataFrame:
    """Percentiles of events per window, at index int(p * n)."""
    return structure.index_percentiles(structure.density(spans, window_us), "events", (0.5, 0.9, 0.99), rule="share")
