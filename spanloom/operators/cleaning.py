"""Data-quality rules of span trees and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.tree import fold_up
from spanloom.session import materialize

PRUNED, DEDUPED = 1, 2


def violations(spans: DataFrame) -> DataFrame:
    """Per trace and rule, how often it is broken (independent of one another)."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    marked = spans.join(known, ["trace_id", "parent_id"], "left")
    per = marked.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        (F.count(F.lit(1)) - F.countDistinct("span_id")).alias("duplicates"),
        F.count(F.when((F.col("parent_id") != 0) & F.col("known").isNull(), 1)).alias("dangling"),
        F.count(F.when(F.col("parent_id") == 0, 1)).alias("roots"),
    )
    return per.withColumn("clean", (F.col("duplicates") == 0) & (F.col("dangling") == 0) & (F.col("roots") == 1))


def violation_patterns(spans: DataFrame) -> DataFrame:
    """How many traces break which set of rules."""
    v = violations(spans)
    flags = F.concat_ws(
        "+",
        F.when(F.col("duplicates") > 0, F.lit("duplicate")),
        F.when(F.col("dangling") > 0, F.lit("dangling")),
        F.when(F.col("roots") == 0, F.lit("rootless")),
        F.when(F.col("roots") > 1, F.lit("multiroot")),
    )
    return v.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("traces"))


def salvage(spans: DataFrame) -> DataFrame:
    """Strict repair: traces without duplicates and dangling parents; of several trees the largest.

    Equal trees: the lowest root id (as an unsigned number) stays.
    """
    ok = violations(spans).where("duplicates = 0 and dangling = 0 and roots > 0").select("trace_id")
    kept = spans.join(ok, "trace_id", "left_semi")
    rooted = materialize(fold_up(kept, {}).where("top_parent = 0 and not unsettled").select(*spans.columns, "top_id"), "salvage")
    sizes = rooted.groupBy("trace_id", "top_id").agg(F.count(F.lit(1)).alias("n"))
    unsigned = F.col("top_id").bitwiseXOR(F.lit(-(1 << 63)))
    best = sizes.groupBy("trace_id").agg(F.min_by("top_id", F.struct((-F.col("n")).alias("n"), unsigned.alias("u"))).alias("top_id"))
    return rooted.join(best, ["trace_id", "top_id"], "left_semi").select(*spans.columns)


def lenient(spans: DataFrame) -> DataFrame:
    """Lenient repair: equal duplicates collapse, conflicting ones and cycles reject the trace, the
    rest is pruned to what a root reaches; ``flags`` says what was repaired."""
    once = spans.groupBy(*spans.columns).agg(F.count(F.lit(1)).alias("copies"))
    per = once.groupBy("trace_id").agg(
        (F.count(F.lit(1)) > F.countDistinct("span_id")).alias("conflict"), (F.max("copies") > 1).alias("deduped")
    )
    whole = once.join(per.where(~F.col("conflict")).select("trace_id", "deduped"), "trace_id")
    found = materialize(fold_up(whole, {}).select(*spans.columns, "deduped", "top_parent", "unsettled"), "repair")
    looped = found.where("unsettled").select("trace_id").distinct()
    kept = found.join(looped, "trace_id", "left_anti")
    pruned = kept.groupBy("trace_id").agg(F.max((F.col("top_parent") != 0).cast("int")).alias("pruned"))
    return (
        kept.where("top_parent = 0")
        .join(pruned, "trace_id")
        .select(*spans.columns, (F.col("pruned") * PRUNED + F.col("deduped").cast("int") * DEDUPED).alias("flags"))
    )
