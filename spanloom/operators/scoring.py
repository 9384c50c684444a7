"""Rebuilt trees against the truth, and independent checks of a reconstruction.

``truth`` is the whole trace table with ``depth`` and ``dropped``; ``links`` is what
:func:`spanloom.operators.reconstruct.links` gives. Everything is joins on (trace, span) and sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import hashing, wire
from spanloom.operators.handlers import Scheme
from spanloom.operators.reconstruct import ENGINES, LINKS, RUN, places
from spanloom.plans.traces import map_whole
from spanloom.plans.tree import ancestors, fold_up, longest, parent_rows

KEY = ["trace_id", "orphan_id"]


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


def fragment_roots(truth: DataFrame) -> DataFrame:
    """``truth``'s survivors plus ``frag_id``, the root of their fragment."""
    alive = truth.where("not dropped")
    return fold_up(alive, {}, sized=True).withColumnRenamed("top_id", "frag_id").drop("top_parent", "unsettled", "children")


def graded(links: DataFrame, truth: DataFrame, lost_fragments: bool = False) -> DataFrame:
    """``links`` plus the true nearest surviving ancestor, the true gap, and whether the anchor is an ancestor at all.

    With ``lost_fragments`` the spans of fragments without an anchor count as lost too, and ``skipped``
    counts the kept ancestors strictly between orphan and anchor.
    """
    paths = ancestors(truth)
    state = truth.select("trace_id", F.col("span_id").alias("ancestor_id"), "dropped")
    if lost_fragments:
        gone = links.where("anchor_id is null").select("trace_id", F.col("orphan_id").alias("frag_id"), F.lit(True).alias("gone"))
        frags = fragment_roots(truth).join(gone, ["trace_id", "frag_id"]).select("trace_id", F.col("span_id").alias("ancestor_id"), "gone")
        state = state.join(frags, ["trace_id", "ancestor_id"], "left").withColumn("dropped", F.col("dropped") | F.coalesce("gone", F.lit(False)))
    state = state.select("trace_id", "ancestor_id", (~F.col("dropped")).alias("kept"))
    own = links.withColumnRenamed("orphan_id", "span_id")
    rows = own.select("trace_id", "span_id", "anchor_id").join(paths, ["trace_id", "span_id"]).join(state, ["trace_id", "ancestor_id"])
    at = F.max(F.when(F.col("ancestor_id") == F.col("anchor_id"), F.col("distance")))
    found = rows.groupBy("trace_id", "span_id").agg(
        F.min(F.when(F.col("kept"), F.struct("distance", "ancestor_id"))).alias("near"),
        at.alias("anchor_at"),
        F.sort_array(F.collect_list(F.when(F.col("kept"), F.col("distance")))).alias("kept_at"),
    )
    out = own.join(found, ["trace_id", "span_id"], "left").withColumnRenamed("span_id", "orphan_id")
    skipped = F.size(F.filter("kept_at", lambda d: d < F.col("anchor_at")))
    return out.select(
        *links.columns,
        F.coalesce(F.col("near.ancestor_id"), F.lit(0)).alias("true_anchor"),
        F.coalesce(F.col("near.distance") - 1, F.lit(0)).alias("true_gap"),
        F.col("anchor_at").isNotNull().alias("is_ancestor"),
        F.when(F.col("anchor_at").isNull(), 0).otherwise(skipped).alias("skipped"),
    )


def score(links: DataFrame, truth: DataFrame, lost_fragments: bool = False) -> DataFrame:
    """Per trace: how many orphans were reattached, rightly, to an ancestor, with the right gap, and by ambiguous evidence."""
    sums = graded(links, truth, lost_fragments).groupBy("trace_id").agg(*_sums())
    spans = truth.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), _count(F.col("dropped")).alias("dropped"))
    return spans.join(sums, "trace_id", "left").na.fill(0)


def _sums() -> list[Column]:
    """What :func:`score` counts of graded links; rows without an orphan count for nothing."""
    placed, right = F.col("anchor_id").isNotNull(), F.col("anchor_id") == F.col("true_anchor")
    return [
        F.count("orphan_id").alias("orphans"),
        _count(placed).alias("reconnected"),
        _count(F.col("orphan_id").isNotNull() & ~placed).alias("unanchored"),
        _count(right).alias("anchor_correct"),
        _count(placed & F.col("is_ancestor")).alias("anchor_ancestor"),
        _count(right & (F.col("synthetic") == F.col("true_gap"))).alias("gap_correct"),
        _count(placed & ~right).alias("misattached"),
        _count(placed & ~right & F.col("is_ancestor")).alias("misattached_ancestor"),
        _count(placed & F.col("ambiguous")).alias("ambiguous"),
        _count(placed & F.col("ambiguous") & ~right).alias("ambiguous_bad"),
        _count(placed & (F.col("via_carrier") != 0)).alias("borrowed"),
        F.coalesce(F.sum("synthetic"), F.lit(0)).cast("long").alias("synthetic"),
        F.coalesce(F.sum(F.when(placed, F.col("skipped"))), F.lit(0)).cast("long").alias("ancestors_skipped"),
    ]


WHOLE = LINKS + ", dropped boolean, true_anchor bigint, true_gap int, is_ancestor boolean, skipped int"


def graded_whole(truth: DataFrame, engine: str, scheme: Scheme) -> DataFrame:
    """A row per span of ``truth``, which comes trace by trace (see :func:`map_whole`): its link by ``engine``, graded.

    An orphan has the columns of :func:`graded`; of other spans nothing but ``trace_id`` and ``dropped`` counts. Links are
    made and graded where the trace is, so neither they nor the paths above them are shuffled or written.
    """
    s = Scheme(**{**scheme.__dict__, "name": ENGINES[engine]}).settled()
    own = RUN[engine]
    names = [c.split()[0] for c in LINKS.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        trace, span, parent = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "parent_id"))
        dropped = rows.column("dropped").to_numpy()
        found = places(rows.filter(pa.array(~dropped)), own, s)
        at = {k: i for i, k in enumerate(zip(found.column("trace_id").to_pylist(), found.column("orphan_id").to_pylist(), strict=True))}
        link = np.array([at.get(k, -1) for k in zip(trace.tolist(), span.tolist(), strict=True)], dtype=np.int64)
        of = found.take(pa.array(link, mask=link < 0))
        anchored = of.column("anchor_id").is_valid().to_numpy()
        anchor = of.column("anchor_id").fill_null(0).to_numpy()
        near, gap, anchor_at, kept_so_far, skipped = (np.zeros(len(span), dtype=np.int64) for _ in range(5))
        up = parent_rows(trace, span, parent)
        live = np.flatnonzero((link >= 0) & (up >= 0))
        above = up[live]
        for distance in range(1, longest(trace) + 1):
            if not len(live):
                break
            kept = ~dropped[above]
            first = live[kept & (kept_so_far[live] == 0)]
            near[first], gap[first] = span[above[kept & (kept_so_far[live] == 0)]], distance - 1
            hit = live[anchored[live] & (span[above] == anchor[live])]
            anchor_at[hit], skipped[hit] = distance, kept_so_far[hit]
            kept_so_far[live] += kept
            on = (up[above] >= 0) & (up[above] != live)
            live, above = live[on], up[above[on]]
        columns = [rows.column("trace_id"), *[of.column(c) for c in names[1:]], dropped, near, gap.astype(np.int32), anchor_at > 0, skipped.astype(np.int32)]
        return pa.table(columns, names=[c.split()[0] for c in WHOLE.split(", ")])

    return map_whole(truth.select("trace_id", "span_id", "parent_id", "depth", "dropped", "br"), run, WHOLE)


def score_whole(rows: DataFrame) -> DataFrame:
    """:func:`score` of what :func:`graded_whole` gives."""
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), _count(F.col("dropped")).alias("dropped"), *_sums())


def lost_spans(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Per trace: fragments without an anchor and their spans, fragments that skip an ancestor and their spans."""
    g = graded(links, truth, lost_fragments=True).select("trace_id", F.col("orphan_id").alias("frag_id"), "anchor_id", "skipped")
    sizes = fragment_roots(truth).groupBy("trace_id", "frag_id").agg(F.count(F.lit(1)).alias("n"))
    both = g.join(sizes, ["trace_id", "frag_id"])
    gone, past = F.col("anchor_id").isNull(), F.col("skipped") > 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return both.groupBy("trace_id").agg(
        _count(gone).alias("fragments_lost"), total(gone).alias("spans_lost"), _count(past).alias("fragments_past"), total(past).alias("spans_in_skipped")
    )


def open_ends(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Per trace: survivors without payload and without a surviving child, which lost all children, and those that got an orphan."""
    alive = truth.where("not dropped")
    kids = alive.select("trace_id", F.col("parent_id").alias("span_id")).distinct().withColumn("has", F.lit(True))
    hit = links.where("anchor_id is not null").select("trace_id", F.col("anchor_id").alias("span_id")).distinct().withColumn("got", F.lit(True))
    ends = alive.where("not carrier").join(kids, ["trace_id", "span_id"], "left").where("has is null").join(hit, ["trace_id", "span_id"], "left")
    return ends.groupBy("trace_id").agg(F.count(F.lit(1)).alias("open_ends"), F.count("got").alias("open_ends_matched"))


def totals(scores: DataFrame) -> DataFrame:
    """Sums over all traces and the shares that reports quote, in percent."""
    names = [c for c in scores.columns if c != "trace_id"]
    share = lambda a, b: F.coalesce(F.round(F.try_divide(100 * F.sum(a), F.sum(b)), 6), F.lit(0.0))
    return scores.agg(
        F.count(F.lit(1)).alias("traces"),
        *[F.sum(c).alias(c) for c in names],
        share("reconnected", "orphans").alias("reconnected_pct"),
        share("anchor_correct", "reconnected").alias("exact_pct"),
        share("misattached_ancestor", "reconnected").alias("benign_pct"),
        F.coalesce(F.round(F.try_divide(100 * (F.sum("misattached") - F.sum("misattached_ancestor")), F.sum("reconnected")), 6), F.lit(0.0)).alias("wrong_pct"),
        F.round(100 * F.avg((F.col("misattached") == 0).cast("int")), 6).alias("clean_trace_pct"),
    )


def topology(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Per trace: siblings under lost parents that were rebuilt as siblings, connectivity, and both.

    ``conn_correct``: every orphan at its true nearest survivor. ``topo_correct``: that, and the sibling
    groups are the true ones under the true identity. ``strict_correct``: also lone orphans of a lost
    branching parent are under its identity.
    """
    branch = truth.where("parent_id <> 0").groupBy("trace_id", F.col("parent_id").alias("true_parent")).agg(F.count(F.lit(1)).alias("true_kids"))
    parents = truth.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("parent_id").alias("true_parent"))
    rows = graded(links, truth).join(parents, KEY).join(branch, ["trace_id", "true_parent"], "left")
    pairs = lambda n: (n * (n - 1) / 2).cast("long")
    by_truth = rows.groupBy("trace_id", "true_parent").agg(F.count(F.lit(1)).alias("n"), _count(F.col("fanout") == F.col("true_parent")).alias("hit"))
    true_side = by_truth.groupBy("trace_id").agg(
        F.sum(pairs(F.col("n"))).alias("true_pairs"), F.sum(pairs(F.col("hit"))).alias("recall_pairs"), F.max((F.col("n") > 1).cast("int")).alias("has_fanout")
    )
    by_recon = rows.where("fanout <> 0").groupBy("trace_id", "fanout").agg(F.count(F.lit(1)).alias("n"), _count(F.col("fanout") == F.col("true_parent")).alias("hit"))
    recon_side = by_recon.groupBy("trace_id").agg(F.sum(pairs(F.col("n"))).alias("recon_pairs"), F.sum(pairs(F.col("hit"))).alias("precision_pairs"))
    lone = (F.col("true_kids") > 1) & (F.col("fanout") != F.col("true_parent"))
    conn = rows.groupBy("trace_id").agg(
        F.min(F.coalesce(F.col("anchor_id") == F.col("true_anchor"), F.lit(False)).cast("int")).alias("conn"), _count(lone).alias("misrouted")
    )
    out = conn.join(true_side, "trace_id").join(recon_side, "trace_id", "left").na.fill(0)
    same = (F.col("true_pairs") == F.col("recall_pairs")) & (F.col("recon_pairs") == F.col("precision_pairs"))
    return out.select(
        "trace_id",
        *[F.col(c).cast("long").alias(c) for c in ("true_pairs", "recall_pairs", "recon_pairs", "precision_pairs", "misrouted")],
        (F.col("has_fanout") == 1).alias("has_fanout"),
        (F.col("conn") == 1).alias("conn_correct"),
        ((F.col("conn") == 1) & same).alias("topo_correct"),
        ((F.col("conn") == 1) & same & (F.col("misrouted") == 0)).alias("strict_correct"),
    )


def topology_totals(t: DataFrame) -> DataFrame:
    """Traces that are right in connectivity, topology and strictly, and pair recall and precision, in percent."""
    pct = lambda c: F.round(100 * F.avg(F.col(c).cast("int")), 6)
    ratio = lambda a, b: F.coalesce(F.round(F.try_divide(100 * F.sum(a), F.sum(b)), 6), F.lit(100.0))
    return t.agg(
        F.count(F.lit(1)).alias("traces"), F.sum(F.col("has_fanout").cast("long")).alias("with_fanout"), pct("conn_correct").alias("conn_pct"),
        pct("topo_correct").alias("topo_pct"), pct("strict_correct").alias("strict_pct"),
        ratio("recall_pairs", "true_pairs").alias("recall_pct"), ratio("precision_pairs", "recon_pairs").alias("precision_pct"),
    )


def recon_edges(links: DataFrame, truth: DataFrame) -> DataFrame:
    """``trace_id, node_id, parent_id, is_anon``: the edges of the rebuilt tree with an identity.

    A survivor keeps its real parent. An orphan hangs on its lost parent, whose id it names (exact); if no
    link was built it has no edge. The lost parent hangs on the anchor where nothing lies between,
    else on an anonymous span.
    """
    alive = truth.where("not dropped")
    ids = alive.select("trace_id", F.col("span_id").alias("parent_id"))
    real = alive.join(ids, ["trace_id", "parent_id"], "left_semi").select("trace_id", F.col("span_id").alias("node_id"), "parent_id", F.lit(False).alias("is_anon"))
    up = alive.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("parent_id").alias("named"))
    placed = links.where("anchor_id is not null").join(up, KEY)
    named = placed.select("trace_id", F.col("orphan_id").alias("node_id"), F.col("named").alias("parent_id"), F.lit(False).alias("is_anon"))
    # of several orphans with one lost parent the deepest anchor counts, then the smallest id
    best = F.max_by(F.struct("anchor_id", "synthetic"), F.struct((-F.col("synthetic")).alias("s"), (-F.col("anchor_id")).alias("a")))
    upper = placed.groupBy("trace_id", F.col("named").alias("node_id")).agg(best.alias("b"))
    upper = upper.select("trace_id", "node_id", F.when(F.col("b.synthetic") == 1, F.col("b.anchor_id")).alias("parent_id"), (F.col("b.synthetic") > 1).alias("is_anon"))
    return real.unionByName(named).unionByName(upper)


def edge_verdicts(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Every edge with the node's depth, whether the node was lost, and the verdict: exact, anon (lost, without identity) or wrong."""
    own = truth.select("trace_id", F.col("span_id").alias("node_id"), F.col("parent_id").alias("true_parent"), F.col("dropped").alias("lost"), "depth")
    up = truth.select("trace_id", F.col("span_id").alias("true_parent"), F.col("dropped").alias("parent_lost"))
    rows = edges.join(own, ["trace_id", "node_id"]).join(up, ["trace_id", "true_parent"], "left")
    exact = ~F.col("is_anon") & F.coalesce(F.col("parent_id") == F.col("true_parent"), F.lit(False))
    fine = F.col("is_anon") & F.coalesce("parent_lost", F.lit(False))
    verdict = F.when(exact, "exact").when(fine, "anon").otherwise("wrong")
    return rows.select("trace_id", "node_id", "parent_id", "true_parent", "depth", "lost", verdict.alias("verdict"))


def edge_depths(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges by depth of their node and verdict."""
    return edge_verdicts(edges, truth).groupBy("depth", "verdict").agg(F.count(F.lit(1)).alias("edges"), _count(F.col("lost")).alias("of_lost_nodes"))


def edge_identity(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Per trace: nodes with an edge, exact parents, anonymous parents where the true one was lost, wrong ones."""
    rows = edge_verdicts(edges, truth)
    exact = F.col("verdict") == "exact"
    return rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("real_nodes"),
        _count(exact).alias("edge_exact"),
        _count(F.col("verdict") == "anon").alias("edge_anon_ok"),
        _count(F.col("verdict") == "wrong").alias("edge_wrong"),
        _count(~F.col("lost")).alias("surv_nodes"),
        _count(~F.col("lost") & exact).alias("surv_exact"),
        _count(F.col("lost")).alias("named_nodes"),
        _count(F.col("lost") & exact).alias("named_exact"),
    )


def strict_identity(links: DataFrame, truth: DataFrame) -> DataFrame:
    """:func:`edge_identity` with every orphan off its true nearest survivor counted as a wrong edge too."""
    edges = edge_identity(recon_edges(links, truth), truth)
    off = graded(links, truth).where("anchor_id is not null and anchor_id <> true_anchor").groupBy("trace_id").agg(F.count(F.lit(1)).alias("off"))
    out = edges.join(off, "trace_id", "left").withColumn("edge_wrong", F.col("edge_wrong") + F.coalesce("off", F.lit(0)))
    return out.drop("off").withColumn("clean", F.col("edge_wrong") == 0)


def identity_totals(per: DataFrame) -> DataFrame:
    """Clean traces among those with an edge, and among all traces that were tried."""
    filled = F.col("real_nodes") > 0
    return per.agg(
        F.count(F.lit(1)).alias("traces"), _count(filled).alias("feasible"), _count(filled & F.col("clean")).alias("clean"),
        F.round(100 * F.try_divide(_count(filled & F.col("clean")), _count(filled)), 6).alias("clean_pct"),
        F.sum("edge_exact").alias("edge_exact"), F.sum("edge_anon_ok").alias("edge_anon_ok"), F.sum("edge_wrong").alias("edge_wrong"),
    )


def wrong_edges(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Links to a span that is no ancestor: where the wrong anchor's path and the orphan's leave each other."""
    bad = graded(links, truth).where("anchor_id is not null and not is_ancestor").select(*KEY, "anchor_id", "true_anchor")
    depth = truth.select("trace_id", F.col("span_id").alias("ancestor_id"), "depth")
    paths = ancestors(truth).select("trace_id", "span_id", "ancestor_id")
    selves = truth.select("trace_id", "span_id", F.col("span_id").alias("ancestor_id"))
    paths = paths.unionByName(selves)
    one = bad.join(paths.withColumnRenamed("span_id", "orphan_id"), KEY)
    two = bad.select(*KEY, "anchor_id").join(paths.withColumnRenamed("span_id", "anchor_id"), ["trace_id", "anchor_id"])
    met = one.join(two.select(*KEY, "ancestor_id"), [*KEY, "ancestor_id"]).join(depth, ["trace_id", "ancestor_id"])
    last = met.groupBy(*KEY).agg(F.max("depth").alias("divergence_depth"))
    return bad.join(last, KEY, "left")


def tree_identity(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """:func:`edge_identity` for whole rebuilt trees, whose nodes without identity are no sources."""
    named = edges.where("not is_anon").select("trace_id", "node_id", F.when(~F.col("parent_anon"), F.col("parent_id")).alias("parent_id"), F.col("parent_anon").alias("is_anon"))
    return edge_identity(named, truth)


def connectivity_ceilings(links: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: wrong links of only children, of siblings of which one is right or none, and how many lie below a right branch.

    ``rescuable``: a lost branching span between the orphan and its true anchor also has an orphan below
    it that is placed rightly.
    """
    up = truth.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("parent_id").alias("lost_id"))
    g = graded(links.where("anchor_id is not null"), truth).join(up, KEY).withColumn("right", F.col("anchor_id") == F.col("true_anchor"))
    per = g.groupBy("trace_id", "lost_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("right")).alias("any_right"))
    both = g.join(per, ["trace_id", "lost_id"])
    branch = truth.where("parent_id <> 0").groupBy("trace_id", F.col("parent_id").alias("ancestor_id")).agg(F.count(F.lit(1)).alias("kids")).where("kids > 1")
    gap = ancestors(truth).withColumnRenamed("span_id", "orphan_id").join(both.select(*KEY, "true_gap", "right"), KEY).where("distance <= true_gap")
    fans = gap.join(branch, ["trace_id", "ancestor_id"])
    good = fans.where("right").select("trace_id", "ancestor_id").distinct().withColumn("good", F.lit(True))
    state = fans.where("not right").join(good, ["trace_id", "ancestor_id"], "left").groupBy(*KEY).agg(F.max(F.coalesce("good", F.lit(False))).alias("rescue"))
    wrong = both.where("not right").join(state, KEY, "left")
    return wrong.agg(
        F.count(F.lit(1)).alias("wrong"), _count(F.col("n") == 1).alias("only_child"), _count((F.col("n") > 1) & F.col("any_right")).alias("sibling_right"),
        _count((F.col("n") > 1) & ~F.col("any_right")).alias("siblings_wrong"), _count(F.col("ambiguous")).alias("ambiguous"), _count(F.col("rescue")).alias("rescuable"),
        _count(~F.col("rescue")).alias("fanout_without_right"), _count(F.col("rescue").isNull()).alias("no_fanout"),
    )


def breadcrumb_outcomes(trees: DataFrame) -> DataFrame:
    """One row: traces by outcome of their breadcrumbs, and the share of survivors that the trees know."""
    wrong = F.col("solved") & ~F.col("embeds")
    return trees.agg(
        F.count(F.lit(1)).alias("traces"), _count(~F.col("solved")).alias("unsolvable"), _count(wrong).alias("wrong"), _count(F.col("embeds")).alias("correct"),
        _count(F.col("exact")).alias("exact"), F.round(F.try_divide(100 * F.sum("known"), F.sum("survivors")), 6).alias("coverage_pct"),
    )


def two_steps(links: DataFrame, truth: DataFrame) -> DataFrame:
    """Per trace, links by what is right of two steps up: the anchor, and the anchor of the fragment that it lies in.

    ``on_the_root`` are links into the root's fragment, which has no second step; for them the first one counts alone.
    """
    frag = fragment_roots(truth).select("trace_id", F.col("span_id").alias("anchor_id"), "frag_id")
    right = graded(links, truth).select(*KEY, "anchor_id", F.coalesce(F.col("anchor_id") == F.col("true_anchor"), F.lit(False)).alias("own"))
    above = right.select("trace_id", F.col("orphan_id").alias("frag_id"), F.col("own").alias("above"))
    rows = right.join(frag, ["trace_id", "anchor_id"], "left").join(above, ["trace_id", "frag_id"], "left")
    placed, own, up = F.col("anchor_id").isNotNull(), F.col("own"), F.col("above")
    on_top = up.isNull()
    return rows.groupBy("trace_id").agg(
        _count(placed).alias("placed"),
        _count(placed & on_top).alias("on_the_root"),
        _count(placed & own & (on_top | up)).alias("both_right"),
        _count(placed & own & ~on_top & ~up).alias("parent_right"),
        _count(placed & ~own & ~on_top & up).alias("grandparent_right"),
        _count(placed & ~own & (on_top | ~up)).alias("none_right"),
    )


# ---- independent checks ----


def violations(survivors: DataFrame, links: DataFrame) -> DataFrame:
    """``trace_id, kind, span_id`` of every broken rule of a reconstruction; none if it is sound.

    Rules: no span and no link twice, real edges one level apart, every fragment's root is the trace's
    root, linked or given up, links between existing spans, depths that add up, at least one
    lost span in between, and no ring of links.
    """
    say = lambda df, kind, id_: df.select("trace_id", F.lit(kind).alias("kind"), F.col(id_).alias("span_id"))
    many = lambda df, c: df.groupBy("trace_id", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = survivors.select("trace_id", F.col("span_id").alias("parent_id"), F.col("depth").alias("up_depth")).dropDuplicates(["trace_id", "parent_id"])
    linked = survivors.join(at, ["trace_id", "parent_id"], "left")
    placed = links.where("anchor_id is not null")
    roots = linked.where("up_depth is null").select("trace_id", F.col("span_id").alias("orphan_id"), "parent_id")
    state = roots.join(links.select(*KEY, F.lit(1).alias("has")).dropDuplicates(KEY), KEY, "left")
    wrong = state.where((F.col("parent_id") == 0).cast("int") + F.coalesce("has", F.lit(0)) != 1)
    own = survivors.select("trace_id", F.col("span_id").alias("orphan_id"), F.col("depth").alias("own_depth")).dropDuplicates(KEY)
    anchors = at.select("trace_id", F.col("parent_id").alias("anchor_id"), F.col("up_depth").alias("anchor_depth"))
    both = placed.join(own, KEY, "left").join(anchors, ["trace_id", "anchor_id"], "left")
    known = both.where("own_depth is not null and anchor_depth is not null")
    # every span with what it hangs on now: a ring shows as a path without an end
    moved = placed.groupBy("trace_id", F.col("orphan_id").alias("span_id")).agg(F.min("anchor_id").alias("moved"))
    tree = survivors.dropDuplicates(["trace_id", "span_id"]).join(moved, ["trace_id", "span_id"], "left")
    tree = tree.select("trace_id", "span_id", F.coalesce("moved", "parent_id").alias("parent_id"))
    found = [
        say(many(survivors, "span_id"), "dup-span", "span_id"),
        say(many(links, "orphan_id"), "dup-link", "orphan_id"),
        say(linked.where("up_depth <> depth - 1"), "edge-depth", "span_id"),
        say(wrong, "disposition", "orphan_id"),
        say(both.where("own_depth is null or anchor_depth is null"), "dangling", "orphan_id"),
        say(known.where("own_depth <> anchor_depth + 1 + synthetic"), "depth-arith", "orphan_id"),
        say(known.where("synthetic < 1"), "spacing", "orphan_id"),
        say(fold_up(tree, {}, sized=True).where("unsettled"), "cycle", "span_id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def evidence(survivors: DataFrame, links: DataFrame, scheme: Scheme) -> DataFrame:
    """``trace_id, kind, span_id`` of links that their own payload speaks against: prefix, window, filter.

    Read anew from the carrier's bytes: the anchor lies in the carrier's window, the window's top has the
    payload's prefix or lies above the anchor, and the filter holds a threaded anchor.
    """
    s = scheme.settled()
    m, k = s.filter_size
    size = -(-m // 8)
    carrier = survivors.where("br is not null").select("trace_id", F.col("span_id").alias("carrier_id"), F.col("depth").alias("at"), "br")
    anchors = survivors.select("trace_id", F.col("span_id").alias("anchor_id"), F.col("depth").alias("anchor_depth"))
    rows = links.where("anchor_id is not null").withColumn("carrier_id", F.when(F.col("via_carrier") != 0, F.col("via_carrier")).otherwise(F.col("orphan_id")))
    rows = rows.join(carrier, ["trace_id", "carrier_id"]).join(anchors, ["trace_id", "anchor_id"])
    width = F.lit(1)
    for i in range(1, 4):
        width = width + (F.col("at") >= 1 << 7 * i).cast("int")
    head = F.substring(F.col("br"), F.lit(2) + width, F.lit(s.prefix))
    bits = F.substring(F.col("br"), F.lit(2 + s.prefix) + width, F.lit(size))
    top = F.when(F.col("at") % s.cpd == 0, F.col("at") - s.cpd).otherwise(F.floor(F.col("at") / s.cpd) * s.cpd)
    rows = rows.withColumns({"head": head, "bits": bits, "top": top, "type": F.substring(F.col("br"), 1, 1)})
    on_top = F.col("anchor_depth") == F.col("top")
    bad_prefix = on_top & (hashing.id_bytes(F.col("anchor_id"), s.prefix) != F.col("head"))
    outside = (F.col("anchor_depth") < F.col("top")) | (F.col("anchor_depth") >= F.col("at"))
    kinds = [("type", F.hex("type") != f"{wire.TYPES[s.name]:02X}"), ("prefix", bad_prefix), ("window", outside)]
    if s.name != "pcr":
        kinds.append(("bloom", ~on_top & ~hashing.bloom_holds(F.col("bits"), F.col("anchor_id"), m, k)))
    out = None
    for kind, broken in kinds:
        part = rows.where(broken).select("trace_id", F.lit(kind).alias("kind"), F.col("orphan_id").alias("span_id"))
        out = part if out is None else out.unionByName(part)
    return out


def with_faults(links: DataFrame, truth: DataFrame, every: int = 7) -> DataFrame:
    """``links`` with one planted fault in about every ``every``-th trace, and its ``fault`` kind (else null).

    ``root``: the anchor becomes the trace's root; ``sibling``: a survivor of the anchor's depth that is
    no ancestor; ``gap``: one lost span too many; ``lost``: no anchor; ``twice``: the link is doubled.
    """
    kinds = ("root", "sibling", "gap", "lost", "twice")
    first = links.where("anchor_id is not null").groupBy("trace_id").agg(F.min("orphan_id").alias("orphan_id"))
    pick = first.where(F.pmod("trace_id", F.lit(every)) == 0).withColumn("fault", F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(F.floor(F.col("trace_id") / every), F.lit(len(kinds))) + 1).cast("int")))
    roots = truth.where("parent_id = 0").groupBy("trace_id").agg(F.min("span_id").alias("root_id"))
    alive = truth.where("not dropped").select("trace_id", F.col("span_id").alias("other"), F.col("depth").alias("d"))
    at = truth.select("trace_id", F.col("span_id").alias("anchor_id"), F.col("depth").alias("d"))
    paths = ancestors(truth).select("trace_id", F.col("span_id").alias("orphan_id"), F.col("ancestor_id").alias("other"))
    beside = links.join(pick, KEY).where("fault = 'sibling'").join(at, ["trace_id", "anchor_id"]).join(alive, ["trace_id", "d"])
    beside = beside.join(paths, [*KEY, "other"], "left_anti").groupBy(*KEY).agg(F.min("other").alias("beside"))
    rows = links.join(pick, KEY, "left").join(roots, "trace_id", "left").join(beside, KEY, "left")
    rows = rows.withColumn("fault", F.when((F.col("fault") == "sibling") & F.col("beside").isNull(), None).otherwise(F.col("fault")))
    is_ = lambda k: F.coalesce(F.col("fault") == k, F.lit(False))
    moved = F.when(is_("root"), F.col("root_id")).when(is_("sibling"), F.col("beside")).when(is_("lost"), F.lit(None)).otherwise(F.col("anchor_id"))
    gap = F.when(is_("gap"), F.col("synthetic") + 1).when(is_("lost"), F.lit(None)).otherwise(F.col("synthetic"))
    copies = F.explode(F.when(is_("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.withColumn("anchor_id", moved).withColumn("synthetic", gap).withColumn("copy", copies)
    return out.select(*links.columns, "fault")


def audit(links: DataFrame, truth: DataFrame, every: int = 7) -> DataFrame:
    """Per kind of planted fault: how many were planted and how many the scores and checks saw."""
    bad = with_faults(links, truth, every)
    planted = bad.where("fault is not null").select(*KEY, "fault").distinct()
    before = graded(links, truth).select(*KEY, (F.col("anchor_id") == F.col("true_anchor")).alias("was"), (F.col("synthetic") == F.col("true_gap")).alias("gap_was"),
                                           F.col("anchor_id").alias("old"))
    after = graded(bad.drop("fault").dropDuplicates(KEY), truth).select(*KEY, (F.col("anchor_id") == F.col("true_anchor")).alias("now"), F.col("synthetic"), "true_gap", "anchor_id", "is_ancestor")
    twice = bad.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = planted.join(before, KEY).join(after, KEY).join(twice, KEY)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    seen = (
        F.when(F.col("fault") == "twice", F.col("n") > 1)
        .when(F.col("fault") == "lost", F.col("anchor_id").isNull())
        .when(F.col("fault") == "gap", no(F.col("synthetic") == F.col("true_gap")) | ~F.col("was"))
        .when(F.col("fault") == "sibling", ~F.col("is_ancestor"))
        .otherwise(no(F.col("now")) | (F.col("old") == F.col("anchor_id")))
    )
    return rows.groupBy("fault").agg(F.count(F.lit(1)).alias("planted"), _count(seen).alias("seen"))
