"""Folds along the paths of span trees.

Traces are shuffled once and folded many at a time by pointer doubling on arrays: each round replaces
a span's pointer by its pointer's pointer and combines what was folded over the skipped stretch, so a
path of length d takes log2(d) rounds. A path that has gone further than its trace has spans runs into
a cycle and is not followed on. Traces of more than ``GIANT`` spans, which would not fit a worker, are
folded by the same rounds as equi-joins, whose state is written to the shared folder.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.plans.traces import map_traces
from spanloom.session import discard, materialize

#: Spans of a trace that one worker folds.
GIANT = 4_000_000


def by_trace(df: DataFrame) -> DataFrame:
    """``df`` dealt out by trace."""
    return df.repartition("trace_id")


def parent_rows(trace: np.ndarray, span: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For each row the row of its parent in the same trace, -1 for none; rows are sorted by trace.

    Of several rows with the parent's id the first counts.
    """
    n = len(trace)
    if n and trace[0] == trace[-1]:  # one trace, maybe a giant: in less memory
        order = np.argsort(span, kind="stable")
        at = np.minimum(np.searchsorted(span, parent, sorter=order), n - 1)
        return np.where((parent != 0) & (span[order[at]] == parent), order[at], -1)
    ids, place = np.unique(np.concatenate([span, parent]), return_inverse=True)
    seq = np.concatenate([[0], np.cumsum(trace[1:] != trace[:-1])]) if n else np.zeros(0, np.int64)
    own, want = seq * len(ids) + place[:n], seq * len(ids) + place[n:]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], want), max(0, n - 1))
    found = (parent != 0) & (own[order][at] == want) if n else np.zeros(0, bool)
    return np.where(found, order[at] if n else at, -1)


def longest(trace: np.ndarray) -> int:
    """Rows of the largest trace."""
    edges = np.flatnonzero(trace[1:] != trace[:-1]) + 1 if len(trace) else np.zeros(0, np.int64)
    return int(np.diff(np.concatenate([[0], edges, [len(trace)]])).max(initial=0))


class Folded:
    """A column with its nulls, as a fold sees it."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, how: str):
        self.how, self.kind = how, column.type
        self.ok = ~column.is_null().to_numpy(zero_copy_only=False) if column.null_count else np.ones(len(column), dtype=bool)
        self.source = column
        if how == "first":
            self.value = np.arange(len(column))
        else:
            filled = pc.fill_null(column, False if pa.types.is_boolean(column.type) else 0)
            self.value = filled.to_numpy(zero_copy_only=False).copy() if isinstance(filled, pa.Array) else filled.to_numpy().copy()

    def step(self, rows: np.ndarray, up: np.ndarray) -> None:
        """Combine ``rows`` with what their pointers ``up`` hold."""
        a, b, ok, ok_b = self.value[rows], self.value[up], self.ok[rows], self.ok[up]
        if self.how == "sum":
            self.value[rows] = a + np.where(ok_b, b, 0)
        elif self.how == "any":
            self.value[rows] = a | (b & ok_b)
        elif self.how == "or":
            self.value[rows] = a | np.where(ok_b, b, 0)
        else:
            both = np.maximum(a, b) if self.how == "max" else np.minimum(a, b) if self.how == "min" else b
            self.value[rows] = np.where(ok & ok_b, both, np.where(ok_b, b, a))
            self.ok[rows] = ok | ok_b

    def array(self, rows: np.ndarray | None = None) -> pa.Array:
        """The folded column, or what it holds at ``rows`` (null at -1)."""
        value, ok = (self.value, self.ok) if rows is None else (self.value[rows], self.ok[rows] & (rows >= 0))
        if self.how == "first":
            return pc.take(self.source, pa.array(np.where(ok, value, 0), mask=~ok)).cast(self.kind)
        return pa.array(value, mask=~ok).cast(self.kind)


def walk_up(up: np.ndarray, most: int, columns: list[Folded]) -> tuple[np.ndarray, np.ndarray]:
    """Fold ``columns`` along the pointers; the top row of every row, and the rows whose path runs into a cycle."""
    pointer, top = up.copy(), np.arange(len(up))
    for done in itertools.count():
        live = np.flatnonzero(pointer >= 0)
        if not len(live) or 1 << max(0, done - 1) > max(1, most):
            break
        at = pointer[live]
        for c in columns:
            c.step(live, at)
        top[live], pointer[live] = top[at], pointer[at]
    lost = pointer >= 0
    return np.where(lost, np.arange(len(up)), top), lost


def _by_arrow(start: DataFrame, how: dict[str, str], parents: bool, carried: list[str]) -> DataFrame:
    fields = [start.schema[c] for c in carried] + [start.schema[c] for c in how]
    schema = StructType([*fields, *([_renamed(start.schema[c], f"p_{c}") for c in how] if parents else [])])
    schema = schema.add("top_id", "long").add("top_parent", "long").add("unsettled", "boolean").add("children", "long")

    def run(rows: pa.Table) -> pa.Table:
        trace, span, to, parent = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "_to", "parent_id"))
        up = parent_rows(trace, span, to)
        real = parent_rows(trace, span, parent)
        folded = [Folded(rows.column(c).combine_chunks(), h) for c, h in how.items()]
        top, lost = walk_up(up, longest(trace), folded)
        out = [rows.column(c) for c in carried] + [c.array() for c in folded] + ([c.array(real) for c in folded] if parents else [])
        out += [pa.array(span[top]), pa.array(np.where(lost, parent, to[top])), pa.array(lost)]
        out.append(pa.array(np.bincount(real[real >= 0], minlength=len(span))))
        return pa.table(out, names=schema.names)

    return map_traces(start, run, schema)


def _renamed(field, name: str):
    return type(field)(name, field.dataType, True)


def _by_joins(start: DataFrame, how: dict[str, str], parents: bool, carried: list[str]) -> DataFrame:
    """The rounds as equi-joins: no trace is held whole."""
    join = {
        "sum": lambda a, b: a + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "any": lambda a, b: a | F.coalesce(b, F.lit(False)),
        "or": lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))),
        "first": lambda a, b: F.coalesce(b, a),
    }
    kids = start.where("parent_id <> 0").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count(F.lit(1)).alias("children"))
    start = start.join(kids, ["trace_id", "span_id"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    start = start.withColumns({"top_id": F.col("span_id"), "top_parent": F.col("_to")})
    folded = [*how, "_to", "top_id", "top_parent"]
    state = materialize(start, "fold")
    for done in itertools.count(1):
        other = state.select("trace_id", F.col("span_id").alias("_to"), *[F.col(c).alias(f"_up_{c}") for c in folded])
        both = state.join(other, ["trace_id", "_to"], "left")
        found = F.col("_up__to").isNotNull()
        new = {n: join[h](F.col(n), F.col(f"_up_{n}")) for n, h in how.items()}
        new |= {
            "top_id": F.when(found, F.col("_up_top_id")).otherwise(F.col("top_id")),
            "top_parent": F.when(found, F.col("_up_top_parent")).otherwise(F.col("top_parent")),
            "_to": F.when(found, F.col("_up__to")).otherwise(F.lit(0)),
        }
        before, state = state, materialize(both.withColumns(new).drop(*[f"_up_{c}" for c in folded]), "fold")
        discard(before)
        counts = state.groupBy("trace_id").agg(F.countDistinct("span_id").alias("n"), F.max(F.col("_to") != 0).alias("open"))
        largest = counts.where("open").agg(F.max("n")).first()[0]
        # 2**done steps up; a path past a missing parent settles one round later
        if largest is None or 1 << (done - 1) >= largest:
            break
    lost = F.col("_to") != 0
    tops = {"top_id": F.when(lost, F.col("span_id")).otherwise(F.col("top_id")), "top_parent": F.when(lost, F.col("parent_id")).otherwise(F.col("top_parent"))}
    state = state.withColumns(tops | {"unsettled": lost})
    if parents:
        held = state.select("trace_id", F.col("span_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in how])
        state = state.join(held, ["trace_id", "parent_id"], "left")
    return state.select(*carried, *how, *([f"p_{c}" for c in how] if parents else []), "top_id", "top_parent", "unsettled", "children")


#: Applications that have met a giant trace: from then on every fold looks for them.
_giants: set[str] = set()


def _seen_giants(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext.applicationId in _giants


def fold_up(
    spans: DataFrame, values: dict[str, tuple[Column, str]], stop: Column | None = None, parents: bool = False, sized: bool = False
) -> DataFrame:
    """``spans`` plus, per name in ``values``, the fold of a column over self and ancestors.

    ``values`` maps a name to (column, how), how being sum, max, min, any, or (bits) or first (the
    value at the top of the path). ``stop`` marks spans whose parent is not followed. With ``parents``
    there is also ``p_<name>``, what the fold holds at the span's parent (null for none). ``top_id`` is
    the last span reached and ``top_parent`` the parent id it names (0: a root; else missing);
    ``children`` counts the spans that name this one as their parent. ``unsettled`` marks the spans
    whose path runs into a cycle: they are their own top, and their folds mean nothing. ``sized`` says
    that the traces come out of an earlier fold, which has looked for giants.
    """
    next_id = F.col("parent_id") if stop is None else F.when(stop, F.lit(0)).otherwise(F.col("parent_id"))
    carried = [c for c in spans.columns if c not in values and c not in ("top_id", "top_parent", "unsettled", "children")]
    start = spans.withColumns({n: c for n, (c, _) in values.items()} | {"_to": next_id.cast("long")}).select(*carried, *values, "_to")
    how = {n: h for n, (_, h) in values.items()}
    if sized and not _seen_giants(spans):
        return _by_arrow(start, how, parents, carried)
    sizes = spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= GIANT:
        return _by_arrow(start, how, parents, carried)
    _giants.add(spans.sparkSession.sparkContext.applicationId)
    giants = F.broadcast(materialize(sizes.where(F.col("n") > GIANT).select("trace_id"), "giants"))  # a row per GIANT spans at most
    small = _by_arrow(start.join(giants, "trace_id", "left_anti").select(*start.columns), how, parents, carried)
    return small.unionByName(_by_joins(start.join(giants, "trace_id", "left_semi").select(*start.columns), how, parents, carried))


def with_depth(spans: DataFrame, sized: bool = False) -> DataFrame:
    """``spans`` plus ``depth`` (0 at the top), ``root_id`` and ``rooted`` (the path ends at a root).

    Spans whose path runs into a cycle have depth 0.
    """
    return with_tree(spans, sized).drop("children")


def with_tree(spans: DataFrame, sized: bool = False) -> DataFrame:
    """:func:`with_depth` plus ``children``."""
    out = fold_up(spans, {"_n": (F.lit(1), "sum")}, sized=sized)
    own = [c for c in spans.columns if c not in ("depth", "root_id", "rooted", "children")]
    return out.select(
        *own,
        F.when(F.col("unsettled"), 0).otherwise(F.col("_n") - 1).alias("depth"),
        F.col("top_id").alias("root_id"),
        ((F.col("top_parent") == 0) & ~F.col("unsettled")).alias("rooted"),
        "children",
    )


def ancestors(spans: DataFrame, stop: Column | None = None, within: int | None = None) -> DataFrame:
    """``trace_id, span_id, ancestor_id, distance``: every span with each span above it (``distance`` from 1).

    ``stop`` marks spans whose parent is not followed; ``within`` bounds the distance. One row per span
    and level: what a query about paths reads, never more than it asks for. Paths end at a cycle's first repeat.
    """
    next_id = F.col("parent_id") if stop is None else F.when(stop, F.lit(0)).otherwise(F.col("parent_id"))
    start = spans.select("trace_id", "span_id", next_id.cast("long").alias("_to"))

    def run(rows: pa.Table) -> pa.Table:
        trace, span, to = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "_to"))
        up = parent_rows(trace, span, to)
        most = min(longest(trace), within or len(span))
        live, at = np.flatnonzero(up >= 0), up[up >= 0]
        out = []
        for distance in range(1, most + 1):
            if not len(live):
                break
            out.append((live, at, np.full(len(live), distance, dtype=np.int32)))
            on = (up[at] >= 0) & (up[at] != live)
            live, at = live[on], up[at[on]]
        low, high, far = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.int64) for k in range(3))
        return pa.table([trace[low], span[low], span[high], far.astype(np.int32)], names=["trace_id", "span_id", "ancestor_id", "distance"])

    return map_traces(start, run, "trace_id bigint, span_id bigint, ancestor_id bigint, distance int")
