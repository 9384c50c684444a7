"""Mixing sources to target weights by entropy balancing.

Every word of a document is a unit of base mass, taken zero to ``MAX_COPIES`` times with mean one
(a binomial base measure). Tilting it exponentially by its source's multiplier gives a document
the rate ``MAX_COPIES * e^l / (MAX_COPIES - 1 + e^l)``; the multipliers solve the convex dual of
"the expected words of a source equal its target". The dual has one term per source, so the
documents are summed up once and the Newton steps run on the table of sources, where each source's
row lies; the targets' water level comes from repeated sums over that table. Rates are then rounded
into whole copies: every document gets the rate's integer part, and one copy more goes to the
documents that come first in a seeded hash order until their words fill the source's rest; single
documents that fit the remaining gap best are then added or removed.

Memory: the driver holds a few sums, whatever the number of sources; no task holds a source,
because the hash order is cut into slices and only the one slice in which a source's rest ends is
ordered document by document. The number of slices follows the number of documents. Up to
``BROADCAST_SOURCES`` sources are broadcast to the documents; of more, those with a large share of the
rows are (``HOT_SOURCES`` at most), the rest are joined by a shuffle.

A row is a unit, whatever its id: its hash is made from all its columns, and rows that are equal in all of
them are counted first (combined before they are moved) and numbered, each number with a hash of its own.

Cases: null text has size 0; a null source is a source of its own, last in order; null ids and ids that repeat
are units like others; equal rows cannot be told apart, so reruns agree although any of them may be the
one that is taken; empty tables give no rows; documents of size 0 take nothing; extra columns only tell
rows apart. Equal hashes are ordered by document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.sharding import _hashes
from spanloom.session import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
BROADCAST_SOURCES, HOT_SOURCES = 100_000, 10_000
BROADCAST_UNITS = 1_000_000
#: Slices of the hash order: at least so many, more where a slice would hold this many units.
HASH_SLICES, SLICE_UNITS = 4096, 100_000
SEED = 20_011
#: Equal rows are numbered in blocks of so many, each block a row that can be dealt anew.
EQUAL_BLOCK = 10_000
NEWTON_STEPS = 60
SOLVED = 1e-9
GAP_STEPS = 3


def share_targets(sizes: dict[str | None, int], weights=WEIGHTS, cap: float = MAX_COPIES) -> dict[str | None, float]:
    """Words that each source is to give: weights over the ordered sources, capped and reshared.

    The rule in plain form, for a table of sources that fits the driver; :func:`targets_of` applies it to any.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    target: dict[str | None, float] = {}
    free = set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


def sources_of(base: DataFrame) -> DataFrame:
    """``source, source_key, words, units, place``: sources numbered from 0 by code point, null last."""
    sums = base.groupBy("source", "source_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("units"))
    sums = materialize(sums, "mix-sources")
    parts = max(1, -(-sums.count() // BROADCAST_SOURCES))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sums.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "mix-order", parts * BROADCAST_SOURCES)
    offset, upto = F.lit(0).cast("long"), 0
    for r in sorted(dealt.groupBy("part").count().collect()):  # one row per BROADCAST_SOURCES sources
        offset = F.when(F.col("part") == r["part"], F.lit(upto).cast("long")).otherwise(offset)
        upto += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offset
    return dealt.withColumn("place", place).drop("part")


def targets_of(sources: DataFrame, weights=WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """``sources`` plus ``target``: the words that each one is to give."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    most = F.lit(float(cap)) * F.col("words")
    rows = sources.withColumn("weight", weight).withColumn("_most", most).withColumn("_ratio", most / F.col("weight"))
    parts = max(1, -(-rows.count() // BROADCAST_SOURCES))
    dealt = materialize(rows.repartitionByRange(parts, "_ratio", "place").withColumn("part", F.spark_partition_id()), "mix-weights")
    sums = sorted(dealt.groupBy("part").agg(F.sum("_most").alias("most"), F.sum("weight").alias("weight"), F.sum("words").alias("words")).collect())  # one row per BROADCAST_SOURCES sources
    total, open_ = float(sum(r["words"] for r in sums)), sum(r["weight"] for r in sums)
    # sources are capped in the order of their ratios, up to the first one that the level of the rest does not reach
    capped, still, done = F.lit(0.0), F.lit(0.0), 0.0
    for r in sums:
        here = F.col("part") == r["part"]
        capped, still = F.when(here, F.lit(done)).otherwise(capped), F.when(here, F.lit(open_)).otherwise(still)
        done, open_ = done + r["most"], open_ - r["weight"]
    before = Window.partitionBy("part").orderBy("_ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.lit(total) - capped - sum_before("_most")) / (still - sum_before("weight"))
    levels = dealt.withColumn("_level", level).where(F.col("_ratio") >= F.col("_level"))
    found = levels.agg(F.min_by("_level", F.struct("_ratio", "place"))).first()[0]
    target = F.least(F.col("_most"), F.col("weight") * F.lit(float(found or 0.0)))
    return dealt.withColumn("target", target).drop("weight", "_most", "_ratio", "part")


def solve_rates(targets: DataFrame, copies: int = MAX_COPIES) -> DataFrame:
    """``targets`` plus ``rate``: the tilted rate of each source's documents, by Newton steps on the dual.

    A source at its bound has no finite multiplier; its rate is the bound. A source that does not settle is an error.
    """
    rate_of = lambda x: copies * F.exp(x) / (copies - 1 + F.exp(x))
    want = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    rows = targets.withColumn("want", want)
    bound = (F.col("want") >= copies * (1 - 1e-12)) | (F.col("want") <= 0)

    def step(x: Column, _) -> Column:
        gap, slope = F.col("want") - rate_of(x), rate_of(x) * (1 - rate_of(x) / copies)
        return F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / slope))))

    tilt = F.when(~bound, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step))
    rows = materialize(rows.withColumn("tilt", tilt), "mix-rates")
    off = rows.agg(F.max(F.when(~bound, F.abs(rate_of(F.col("tilt")) - F.col("want")) / F.col("want")))).first()[0]
    if off is not None and off > SOLVED:
        raise RuntimeError(f"the mix did not settle: a rate is off by a share of {off}")
    edge = F.when((F.col("want") > 0) & (F.col("words") > 0), F.lit(float(copies))).otherwise(F.lit(0.0))
    return rows.withColumn("rate", F.when(bound, edge).otherwise(F.round(rate_of(F.col("tilt")), 9))).drop("want", "tilt")


def _with_source(rows: DataFrame, per: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` joined to the one row that ``per`` has for their source; a third of all rows may be one source's."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per), "source_key")
    total = sources.agg(F.sum("units")).first()[0]
    hot = F.broadcast(sources.where(F.col("units") > total // HOT_SOURCES).select("source_key"))
    many = rows.join(F.broadcast(per.join(hot, "source_key", "left_semi")), "source_key")
    return many.unionByName(rows.join(hot, "source_key", "left_anti").join(per, "source_key"))


def round_copies(base: DataFrame, sources: DataFrame, copies: int = MAX_COPIES) -> DataFrame:
    """``base`` plus whole ``copies`` per row; the words of a source come near its target."""
    # the words that the extra copies are to add; the slices up to the cut take all of theirs
    slices = base.groupBy("source_key", "slice").agg(F.sum("size").alias("words"))
    whole = F.least(F.lit(copies), F.floor(F.col("rate") + 1e-12)).cast("int")
    want = sources.withColumn("whole", whole).select(
        "source_key", "whole", "target", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("words")).alias("rest")
    )
    run = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        slices.withColumn("upto", F.sum("words").over(run))
        .join(want, "source_key")
        .where(F.col("upto") <= F.col("rest"))
        .groupBy("source_key")
        .agg(F.max("slice").alias("last_full"), F.max("upto").alias("filled"))
    )
    plan = want.join(cut, "source_key", "left").select(
        "source_key",
        "whole",
        "target",
        F.coalesce("last_full", F.lit(-1)).alias("last_full"),
        (F.col("rest") - F.coalesce("filled", F.lit(0))).alias("open_words"),
    )
    first_open = (
        slices.join(plan, "source_key").where(F.col("slice") > F.col("last_full")).groupBy("source_key").agg(F.min("slice").alias("edge"))
    )
    n = sources.count()
    plan = materialize(plan.join(first_open, "source_key", "left"), "mix-plan", n)
    rows = _with_source(base, plan, sources)
    inside = Window.partitionBy("source_key").orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        rows.where(F.col("slice") == F.col("edge"))
        .withColumn("upto", F.sum("size").over(inside))
        .select("row", (F.col("upto") - F.col("size") / 2 <= F.col("open_words")).alias("at_edge"))
    )
    drawn = rows.join(edge, "row", "left").withColumn(
        "extra",
        ((F.col("slice") <= F.col("last_full")) | F.coalesce("at_edge", F.lit(False))).cast("int")
        * (F.col("whole") < copies).cast("int"),
    )
    drawn = materialize(drawn.select("row", "one", "two", "n", "doc_id", "source", "source_key", "size", "u", "whole", "target", "extra", "slice", "last_full"), "mix-drawn")
    turned = None
    for _ in range(GAP_STEPS):
        now = drawn if turned is None else _turn(drawn, turned)
        gaps = now.groupBy("source_key").agg((F.first("target") - F.sum(F.col("size") * (F.col("whole") + F.col("extra")))).alias("gap"))
        fits = (
            _with_source(now, gaps, sources)
            .where(((F.col("gap") > 0) & (F.col("extra") == 0) & (F.col("whole") < copies)) | ((F.col("gap") < 0) & (F.col("extra") == 1)))
            .withColumn("off", F.abs(F.col("size") - F.abs("gap")))
            .where(F.col("off") < F.abs("gap"))
            .groupBy("source_key")
            .agg(F.min(F.struct("off", "u", "doc_id", "row")).alias("best"))
            .select("source_key", F.col("best.row").alias("row"))
        )
        more = materialize(fits, "mix-gap", n)
        turned = more if turned is None else turned.unionByName(more)
    return _turn(drawn, turned).withColumn("copies", F.col("whole") + F.col("extra"))


def _turn(drawn: DataFrame, turned: DataFrame) -> DataFrame:
    """Turn the extra copy of the listed rows over (twice is back again)."""
    times = turned.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(times, "row", "left").withColumn("extra", (F.col("extra") + F.coalesce("times", F.lit(0))) % 2).drop("times")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Every row ``count`` times, numbered from 1; a row that comes very often is dealt over many tasks."""
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / EQUAL_BLOCK).cast("int"))))
    if rows.where(F.col(count) > EQUAL_BLOCK).limit(1).count():
        blocks = blocks.repartition(F.xxhash64("one", "two", "_block"))
    first = F.col("_block").cast("long") * EQUAL_BLOCK
    upto = F.least(F.col(count), first + EQUAL_BLOCK)
    return blocks.withColumn(name, F.explode(F.sequence(first + 1, upto))).drop("_block")


def _slice(slices: int) -> Column:
    return F.pmod(F.col("u"), F.lit(slices)).cast("int")


def _by_rule(copies: int) -> Column:
    """Copies that the plan of a source gives by the slice alone, before the edge and the last turns."""
    return F.col("whole") + ((F.col("slice") <= F.col("last_full")) & (F.col("whole") < copies)).cast("int")


def _units(docs: DataFrame, weights, copies: int) -> tuple[DataFrame, DataFrame, int]:
    """Every row as a unit with its copies (``one, two``: its hashes, ``n``: how many rows are equal to it), the sources' targets and rates, slices."""
    one, two = _hashes(docs, SEED)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(one.alias("one"), two.alias("two"), "doc_id", "source", _source_key().alias("source_key"), size.alias("size"))
    same = [F.first(c).alias(c) for c in ("doc_id", "source", "source_key", "size")]
    once = materialize(sized.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), *same), "mix-sizes")
    rows = once.agg(F.sum("n")).first()[0] or 0
    slices = max(HASH_SLICES, rows // SLICE_UNITS)
    each = _numbered(once, "n", "i").withColumn("u", F.when(F.col("i") == 1, F.col("one")).otherwise(F.xxhash64("one", "two", "i")))
    base = materialize(each.withColumn("slice", _slice(slices)).withColumn("row", F.monotonically_increasing_id()), "mix-units")
    sources = solve_rates(targets_of(sources_of(base), weights, copies), copies)
    return round_copies(base, sources, copies), sources, slices


def mix(docs: DataFrame, weights=WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies``: one row per row of ``docs``."""
    units, sources, _ = _units(docs, weights, copies)
    per = sources.select("source_key", F.col("words").alias("source_size"), F.col("target").alias("_target"), "rate")
    both = _with_source(units.select("doc_id", "source", "source_key", "size", F.col("copies").cast("int").alias("copies")), per, sources)
    return both.select("doc_id", "source", "size", "source_size", F.col("_target").alias("target"), "rate", "copies")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def apply_mix(docs: DataFrame, weights=WEIGHTS, copies: int = MAX_COPIES) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, columns unchanged.

    Texts are not dealt out: the plan of a source gives a row's copies from its hash, and only the
    units of the edge slices and of the last turns, a small share, are looked up. Of rows that are equal in
    all columns one is kept and repeated.
    """
    units, sources, slices = _units(docs, weights, copies)
    names = ["one", "two", "n", "source_key", "slice", "whole", "last_full", "copies"]
    units = materialize(units.select(*names), "mix-copies")
    plan = units.groupBy("source_key").agg(F.first("whole").alias("whole"), F.first("last_full").alias("last_full"))
    key = ["_one", "_two"]
    own = F.col("one").alias("_one"), F.col("two").alias("_two")
    odd = units.where((F.col("n") == 1) & (F.col("copies") != _by_rule(copies))).select(*own, F.col("copies").cast("int").alias("_copies"))
    equal = units.where("n > 1").groupBy(*own).agg(F.sum("copies").cast("long").alias("_total"))
    odd, equal = materialize(odd, "mix-odd"), materialize(equal, "mix-equal")
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST_UNITS else df
    one, two = _hashes(docs, SEED)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _source_key().alias("source_key"), one.alias("_one"), two.alias("_two"))
    repeats = equal.count()
    single = rows.join(few(equal.select(*key), repeats), key, "left_anti") if repeats else rows
    single = _with_source(single.withColumn("slice", F.pmod("_one", F.lit(slices)).cast("int")), plan, sources)
    single = single.join(few(odd, odd.count()), key, "left")
    taken = single.withColumn("_copies", F.coalesce("_copies", _by_rule(copies))).where("_copies > 0")
    out = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
    if repeats:
        held = rows.join(few(equal.where("_total > 0"), repeats), key).groupBy(*key).agg(F.first("_row").alias("_row"), F.first("_total").alias("_total"))
        held = held.withColumnsRenamed({"_one": "one", "_two": "two"})
        out = out.unionByName(_numbered(held, "_total", "_copy").select("_row.*"))
    return out


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets that the mix of all ``documents`` goes by, before rates are rounded."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.round(F.least(F.col("target") / F.col("source_size"), F.lit(3.0)), 6).alias("rate"))


TARGETS = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source
), w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * words / weight, source NULLS LAST) AS place FROM w
), u AS (SELECT *, coalesce(sum(3 * words) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(words) OVER () AS total FROM o
), l AS (SELECT min(place) AS place FROM u WHERE 3.0::DOUBLE * words / weight >= (total - capped)::DOUBLE / open
), level AS (SELECT (total - capped)::DOUBLE / open AS level FROM u JOIN l ON l.place = u.place
), t AS (SELECT source, words, least(3.0::DOUBLE * words, weight * level) AS target FROM w CROSS JOIN level)
SELECT z.doc_id, z.size::BIGINT AS size, t.words AS source_size, round(t.target, 6) AS target, round(least(t.target / t.words, 3), 6) AS rate
FROM sized z JOIN t ON t.source IS NOT DISTINCT FROM z.source
"""
