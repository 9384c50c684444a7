"""Samples of fixed size as mergeable summaries: the rows with the smallest keyed priorities.

A row's priority follows from its key and a seed alone, ``-ln(u) / weight``: the ``k`` smallest are a sample
without replacement in which a row's chance grows with its weight. Every task keeps its own ``k`` best and
only those are moved; samples of parts merge into the sample of the whole by the same rule, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME = 2_147_483_647
BUCKETS = 256


def keyed(key: Column, seed: int = 42) -> Column:
    """A number in (0, 1) from a whole number: rounds of a square map modulo a prime, so that SQL can say the same."""
    x = F.pmod(key, F.lit(PRIME).cast("long"))
    x = F.pmod(x * 48_271 + seed * 69_621 + 11, F.lit(PRIME).cast("long"))
    for c in (16_807, 39_373, 742_938_285):
        x = F.pmod(x * x + x * 48_271 + c, F.lit(PRIME).cast("long"))
    return (x + 0.5) / float(PRIME)


def keyed_sql(key: str, seed: int = 42) -> str:
    """:func:`keyed` for numbers from 0 on."""
    x = f"((({key}) % {PRIME}) * 48271 + {seed * 69_621 + 11}) % {PRIME}"
    for c in (16_807, 39_373, 742_938_285):
        x = f"(SELECT (x * x + x * 48271 + {c}) % {PRIME} FROM (SELECT {x} AS x))"
    return f"({x} + 0.5::DOUBLE) / {PRIME}::DOUBLE"


def priority(u: Column, weight: Column | None = None) -> Column:
    """Null, so out of any sample, where the weight is not above 0."""
    return -F.ln(u) if weight is None else F.when(weight > 0, -F.ln(u) / weight)


def sample(rows: DataFrame, k: int, by: tuple[str, ...] = (), rank: str = "priority", ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` rows of the smallest ``rank`` (of each group of ``by``), equal ones in the order of ``ties``."""
    rows = rows.where(F.col(rank).isNotNull())
    order = [F.col(rank), *[F.col(t) for t in ties]]

    def best(df: DataFrame, keys: list[str]) -> DataFrame:
        window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= k).drop("_place")

    # a group's rows lie in many buckets: each gives its k best, and those meet
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(rank, *ties), F.lit(BUCKETS)))
    return best(best(dealt, [*by, "_bucket"]).drop("_bucket"), list(by))


def merged(a: DataFrame, b: DataFrame, k: int, by: tuple[str, ...] = (), rank: str = "priority", ties: tuple[str, ...] = ()) -> DataFrame:
    """The sample of two tables together from their samples."""
    return sample(a.unionByName(b), k, by, rank, ties)
