"""Span loss, its ground truth, and reconstruction from truncated checkpoint ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import hashing
from spanloom.plans.traces import map_traces
from spanloom.plans.tree import fold_up, with_depth, with_tree
from spanloom.session import materialize

CPD, RATE, SEED = 3, 0.5, 42
GRAIN = 10_000


def uniform_mix(seed: int = SEED, span: Column | None = None) -> Column:
    """31 mixed bits of a span's ids."""
    span = F.col("span_id") if span is None else span
    mixed = (F.col("trace_id") % 100_003) * 7_919 + (span % 100_003) * 104_729 + seed * 1_299_709
    return (mixed * 48_271) % 2_147_483_647


def uniform(seed: int = SEED) -> Column:
    """A span's own uniform number; every rate is a threshold on it, so drops nest across rates."""
    return (uniform_mix(seed) % GRAIN) / GRAIN


def with_kind(spans: DataFrame, cpd: int = CPD) -> DataFrame:
    """``spans`` plus depth, ``leaf`` and ``carrier`` (a checkpoint or a leaf persists a payload)."""
    leaf = F.col("children") == 0
    return with_tree(spans).withColumn("leaf", leaf).withColumn("carrier", leaf | (F.col("depth") % cpd == 0)).drop("children")


def dropped(rate: float = RATE, seed: int = SEED) -> Column:
    """Whether a span is lost, by its ``carrier``: only spans without a payload can be."""
    return ~F.col("carrier") & (F.lit(rate >= 1.0) | (uniform(seed) < rate))


def with_drops(spans: DataFrame, rate: float = RATE, cpd: int = CPD, seed: int = SEED) -> DataFrame:
    """``with_kind`` plus ``dropped``: only spans without a payload can be lost."""
    return with_kind(spans, cpd).withColumn("dropped", dropped(rate, seed))


def nested_drops(spans: DataFrame, rates: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95, 1.0), cpd: int = CPD) -> DataFrame:
    """Dropped and orphaned spans per rate, all from one draw."""
    kinds = with_kind(spans, cpd).withColumn("u", uniform())
    up = kinds.select("trace_id", F.col("span_id").alias("parent_id"), F.col("carrier").alias("p_carrier"), F.col("u").alias("p_u"))
    both = kinds.join(up, ["trace_id", "parent_id"], "left").withColumn("rate", F.explode(F.array(*[F.lit(r) for r in rates])))
    lost = lambda carrier, u: ~carrier & ((F.col("rate") >= 1.0) | (u < F.col("rate")))
    own = lost(F.col("carrier"), F.col("u"))
    above = F.coalesce(lost(F.col("p_carrier"), F.col("p_u")), F.lit(False))
    return both.groupBy("rate").agg(
        F.count(F.lit(1)).alias("spans"), F.count(F.when(own, 1)).alias("dropped"), F.count(F.when(~own & above, 1)).alias("orphans")
    )


def nearest_survivor(spans: DataFrame, rate: float = RATE, cpd: int = CPD) -> DataFrame:
    """Every orphan's true anchor: its nearest ancestor that was not lost, and the gap between."""
    return true_anchors(with_drops(spans, rate, cpd))


def true_anchors(d: DataFrame) -> DataFrame:
    """``trace_id, span_id, depth, anchor_id, gap`` of the survivors whose parent was dropped."""
    # fold over lost spans only: a survivor stops the walk, so a parent that survived is its own top
    walked = fold_up(d, {"anchor": (F.col("span_id"), "first"), "at": (F.col("depth"), "first")}, stop=~F.col("dropped"), parents=True, sized=True)
    orphans = walked.where("not dropped and parent_id <> 0 and p_anchor <> parent_id")
    return orphans.select("trace_id", "span_id", "depth", F.col("p_anchor").alias("anchor_id"), (F.col("depth") - F.col("p_at") - 1).alias("gap"))


def fragments(d: DataFrame) -> DataFrame:
    """Per connected part of the survivors (``frag_id``, its root): spans, carriers and the depth of the shallowest one."""
    parts = fold_up(d.where("not dropped"), {}, sized=True)
    depth = F.min(F.when(F.col("carrier"), F.col("depth"))).alias("carrier_depth")
    return parts.groupBy("trace_id", F.col("top_id").alias("frag_id")).agg(F.count(F.lit(1)).alias("spans"), F.count(F.when(F.col("carrier"), 1)).alias("carriers"), depth)


def lost_parents(d: DataFrame) -> DataFrame:
    """Dropped spans that orphans name as their parent, with how many do: one node each in a rebuilt tree."""
    gone = d.where("dropped").select("trace_id", F.col("span_id").alias("parent_id"))
    orphans = d.where("not dropped").join(gone, ["trace_id", "parent_id"])
    return orphans.groupBy("trace_id", F.col("parent_id").alias("lost_id")).agg(F.count(F.lit(1)).alias("orphans"), (F.first("depth") - 1).cast("int").alias("depth"))


def seeded_interior_drops(spans: DataFrame, rate: float, cpd: int = CPD, seed: int = SEED) -> DataFrame:
    """``trace_id, span_id`` of dropped spans that are no root, leaf or checkpoint.

    Each trace draws from its own stream: a seeded step per trace, then one number per such span in the
    order of ids as unsigned numbers.
    """
    kinds = with_kind(spans, cpd).where("not carrier and parent_id <> 0").select("trace_id", "span_id")

    def run(rows: pa.Table) -> pa.Table:
        trace, span = (rows.column(c).to_numpy() for c in ("trace_id", "span_id"))
        at = np.lexsort((span.view(np.uint64), trace))
        trace, span = trace[at], span[at]
        first = np.concatenate([[True], trace[1:] != trace[:-1]]) if len(at) else np.zeros(0, bool)
        index = np.arange(len(at))
        place = index - np.maximum.accumulate(np.where(first, index, 0)) if len(at) else index
        state = hashing.splitmix64(trace.view(np.uint64) ^ np.uint64(seed)) + place.astype(np.uint64) * hashing.SPLIT_ADD
        gone = hashing.uniform_of(hashing.splitmix64(state)) < rate
        return pa.table([trace[gone], span[gone]], names=["trace_id", "span_id"])

    return map_traces(kinds, run, "trace_id bigint, span_id bigint")


def checkpoint_above(spans: DataFrame, cpd: int = CPD) -> DataFrame:
    """Nearest checkpoint strictly above every span (none for roots)."""
    deep = spans if "depth" in spans.columns else with_depth(spans)
    held = fold_up(deep, {"ckpt_id": (F.col("span_id"), "first")}, stop=F.col("depth") % cpd == 0, parents=True, sized=True)
    return held.where("p_ckpt_id is not null").select("trace_id", "span_id", "depth", F.col("p_ckpt_id").alias("ckpt_id"))


def reconstruct_by_checkpoint(spans: DataFrame, rate: float = RATE, cpd: int = CPD) -> DataFrame:
    """Anchors from checkpoint ids alone, scored against the true anchors.

    A fragment's root looks for the nearest carrier below it (or itself) through surviving edges in
    its checkpoint band, takes the checkpoint that the carrier names, and is attached to it.
    """
    d = materialize(with_drops(spans, rate, cpd), "drops")
    truth = true_anchors(d)
    alive = d.where("not dropped")
    # walk up surviving edges as far as the band reaches: its top level hangs on the checkpoint itself
    up = alive.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("p_alive"))
    linked = alive.join(up, ["trace_id", "parent_id"], "left")
    frag = fold_up(linked, {}, stop=F.col("p_alive").isNull() | (F.col("depth") % cpd == 1), sized=True)
    carriers = frag.where("carrier").groupBy("trace_id", F.col("top_id").alias("span_id"))
    borrowed = carriers.agg(F.min(F.struct("depth", F.col("span_id").alias("id"))).alias("best")).select(
        "trace_id", "span_id", F.col("best.id").alias("carrier_id")
    )
    own = F.when(F.col("carrier"), F.col("span_id"))
    named = truth.join(d.select("trace_id", "span_id", "carrier"), ["trace_id", "span_id"]).join(borrowed, ["trace_id", "span_id"], "left")
    named = named.withColumn("carrier_id", F.coalesce(own, F.col("carrier_id")))
    ckpt = checkpoint_above(d, cpd).select("trace_id", F.col("span_id").alias("carrier_id"), "ckpt_id")
    placed = named.join(ckpt, ["trace_id", "carrier_id"], "left")
    return placed.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("orphans"),
        F.count("ckpt_id").alias("reconnected"),
        F.count(F.when(F.col("ckpt_id") == F.col("anchor_id"), 1)).alias("anchor_correct"),
    )
