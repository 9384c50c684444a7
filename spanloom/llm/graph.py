"""Connected components of a link table, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import discard, materialize

MAX_ROUNDS = 60


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that has a link.

    ``links`` has columns ``a, b`` and, where it is known, at most ``rows`` rows. Each round takes the least label among the neighbours and then
    jumps to that label's own label, so long chains halve; hot ids are aggregated before the
    shuffle and skewed joins are left to the planner. Nothing is collected but a count of changes.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = materialize(both, "links") if rows is None else materialize(both, "links", 2 * rows)
    rows = both.count()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id")
    held = materialize(labels, "labels", rows)
    labels = held
    for _ in range(MAX_ROUNDS):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        )
        step = labels.join(near, "id", "left").select(
            "id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid")
        )
        jump = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        new = step.join(jump, "mid", "left").select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        new = materialize(new, "labels", rows)
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        discard(held)  # this round's labels replace it
        held = new
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
