"""What each span carries and persists under a propagation scheme: sizes and the payload bytes.

Schemes: ``vanilla`` (nothing), ``pb`` (filter of the window's ids), ``cgpb`` (``pb`` and every branch
above), ``pcr`` (prefix of the checkpoint above), ``pcrb`` (both, the filter without own ids), ``cgprb``
(``pcrb`` and the branch that this span witnesses in its window), ``crumbs`` (breadcrumbs of start
ordinals, parent fingerprints and end order). A span whose depth is a multiple of ``cpd`` is a
checkpoint; checkpoints and leaves persist a payload, all others their depth. A span without a
known parent starts anew at depth 0.

State is not replayed event by event where a path fold gives it: windows are folds that stop at
checkpoints, filters fold by bitwise or, the witnessed branch is the top of a walk along first children.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import wire
from spanloom.functions.hashing import Blooms, bloom_size
from spanloom.plans.traces import map_traces, map_whole
from spanloom.plans.tree import Folded, longest, parent_rows, walk_up
from spanloom.session import materialize

SCHEMES = ("vanilla", "pb", "cgpb", "pcr", "pcrb", "cgprb", "crumbs")
PAYLOAD = (
    "trace_id bigint, span_id bigint, parent_id bigint, depth int, leaf boolean, carrier boolean, calls int, "
    "emit_bytes bigint, depth_bytes bigint, order_bytes bigint, baggage_bytes bigint, br binary"
)
DELAYED = "trace_id bigint, span_id bigint, service string, ts bigint, depth int, quad binary"


@dataclass(frozen=True)
class Scheme:
    """A scheme and its settings; out-of-range settings are brought into range."""

    name: str = "pcrb"
    cpd: int = 3
    fp: float = 1e-4
    prefix: int = 4
    #: pb and cgpb: absolute depths (else depths in the window, and no depth attribute).
    emit_depth: bool = True
    mark_bits: int = 16
    anchor_bytes: int = 4
    topology_only: bool = False
    emit_order: bool = False
    omit_ordinal: bool = False
    #: Filters of a prime number of bits, which probe evenly; ``byte_cap``: without a byte more.
    prime: bool = False
    byte_cap: bool = False

    def settled(self) -> Scheme:
        if self.name not in SCHEMES:
            raise ValueError(f"unknown scheme {self.name}")
        return Scheme(**{**self.__dict__, "cpd": max(1, self.cpd), "prefix": min(8, max(1, self.prefix))})

    @property
    def filter_size(self) -> tuple[int, int]:
        """Bits and probes of a filter: a whole window for pb and cgpb, the levels between checkpoints else."""
        return bloom_size(self.cpd if self.name in ("pb", "cgpb") else max(1, self.cpd - 1), self.fp, self.prime, self.byte_cap)


class Trees:
    """Parents, depths, leaves and checkpoints of a run of whole traces, or of parts whose ``at_depth`` and ``is_leaf`` are known."""

    def __init__(self, rows: pa.Table, cpd: int):
        self.trace, self.span, self.parent = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "parent_id"))
        n = len(self.span)
        self.up = parent_rows(self.trace, self.span, self.parent)
        self.most = longest(self.trace)
        steps = Folded(pa.array(np.ones(n, dtype=np.int64)), "sum")
        _, lost = walk_up(self.up, self.most, [steps])
        self.up = np.where(lost, -1, self.up)  # a cycle has no top: its spans stand alone
        self.depth = np.where(lost, 0, steps.value - 1)
        self.leaf = np.bincount(self.up[self.up >= 0], minlength=n) == 0
        if "at_depth" in rows.column_names:
            self.depth = rows.column("at_depth").to_numpy().astype(np.int64)
            self.leaf = rows.column("is_leaf").to_numpy(zero_copy_only=False)
        self.ckpt = self.depth % cpd == 0

    def at_up(self, value: np.ndarray, none) -> np.ndarray:
        """The value at the parent, ``none`` where there is none."""
        up = self.up
        return np.where((up >= 0).reshape(-1, *[1] * (value.ndim - 1)), value[up], none) if len(value) else value

    def window(self) -> np.ndarray:
        """The checkpoint at or above every span."""
        top, _ = walk_up(np.where(self.ckpt, -1, self.up), self.most, [])
        return top

    def or_up(self, masks: np.ndarray) -> np.ndarray:
        """Bitwise or of the masks of self and all spans above up to the window's checkpoint."""
        pointer, out = np.where(self.ckpt, -1, self.up), masks.copy()
        while True:
            live = np.flatnonzero(pointer >= 0)
            if not len(live):
                return out
            at = pointer[live]
            out[live] |= out[at]
            pointer[live] = pointer[at]


def _varints(n: np.ndarray) -> np.ndarray:
    """Bytes of a varint of every number."""
    return 1 + sum((n >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))


def sibling_order(trace: np.ndarray, span: np.ndarray, up: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A child's place among its parent's children by start time, then id; 0 without a parent."""
    unsigned = span.view(np.uint64)
    kids = np.flatnonzero(up >= 0)
    order = kids[np.lexsort((unsigned[kids], start[kids], up[kids]))]
    out = np.zeros(len(span), dtype=np.int64)
    for_parent = up[order]
    first = np.concatenate([[True], for_parent[1:] != for_parent[:-1]]) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order))
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0)) + 1
    return out


def _simple(rows: pa.Table, s: Scheme) -> pa.Table:
    """All schemes but the breadcrumbs."""
    t = Trees(rows, s.cpd)
    n = len(t.span)
    absolute = s.emit_depth or s.name in ("pcr", "pcrb", "cgprb")
    level = t.depth if absolute else t.depth % s.cpd
    has_up = t.up >= 0
    carrier = t.leaf | t.ckpt
    body, extra, extra_down = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    bits = entries = None
    prefix = None
    if s.name in ("pb", "cgpb", "pcrb", "cgprb"):
        blooms = Blooms(*s.filter_size)
        own = blooms.masks(t.span)
        if s.name in ("pb", "cgpb"):
            down = t.or_up(own)
            bits = np.where(t.ckpt[:, None], t.at_up(down, 0).astype(np.uint8) | own, down)
        else:
            down = t.or_up(np.where(t.ckpt[:, None], 0, own).astype(np.uint8))
            bits = t.at_up(down, 0).astype(np.uint8)
        body += blooms.bytes
    if s.name in ("pcr", "pcrb", "cgprb"):
        above = t.at_up(t.window(), -1)
        prefix = np.where(above >= 0, t.span[above], 0)
        body += s.prefix
    if s.name in ("cgpb", "cgprb"):
        seq = sibling_order(t.trace, t.span, t.up, rows.column("start_us").to_numpy())
        entry = np.where(seq == 2, 8 + _varints(level), 0)
        if s.name == "cgpb":  # every branch above, never reset
            sums = Folded(pa.array(entry), "sum")
            walk_up(t.up, t.most, [sums])
            extra = extra_down = sums.value
        else:  # the branch reached through first children inside the window
            inside = (seq == 1) & ~t.at_up(t.ckpt, True)
            top, _ = walk_up(np.where(inside, t.up, -1), t.most, [])
            entries = np.where(seq[top] == 2, top, -1)
            extra = np.where(entries >= 0, entry[top], 0)
            extra_down = np.where(t.ckpt, 0, extra)
    if s.name == "vanilla":
        emit = depth_bytes = baggage = np.zeros(n, dtype=np.int64)
        carrier = np.zeros(n, dtype=bool)
    else:
        emit = np.where(carrier, wire.NAME_BYTES + wire.TYPE_BYTES[s.name] + _varints(level) + body + extra, 0)
        depth_bytes = np.where(~carrier & absolute, wire.DEPTH_NAME_BYTES + _varints(t.depth), 0)
        baggage = np.where(has_up, wire.BAGGAGE_NAME_BYTES + _varints(level) + body + extra_down, 0)
    br: list[bytes | None] = [None] * n
    if s.name in ("pb", "pcr", "pcrb", "cgprb"):
        head = bytes([wire.TYPES[s.name]])
        for i in np.flatnonzero(carrier).tolist():
            parts = [head, wire.varint(int(level[i]))]
            if prefix is not None:
                parts.append(int(prefix[i]).to_bytes(8, "big", signed=True)[: s.prefix])
            if bits is not None:
                parts.append(bits[i].tobytes())
            if entries is not None and entries[i] >= 0:
                k = entries[i]
                parts.append(wire.hash_entry(int(t.parent[k]), int(t.depth[k])))
            br[i] = b"".join(parts)
    return _table(t, carrier, has_up & (s.name != "vanilla"), emit, depth_bytes, np.zeros(n, dtype=np.int64), baggage, br)


def _table(t: Trees, carrier, calls, emit, depth_bytes, order_bytes, baggage, br) -> pa.Table:
    columns = [t.trace, t.span, t.parent, t.depth.astype(np.int32), t.leaf, carrier, calls.astype(np.int32)]
    columns += [emit.astype(np.int64), depth_bytes.astype(np.int64), order_bytes.astype(np.int64), baggage.astype(np.int64)]
    names = [c.split()[0] for c in PAYLOAD.split(", ")]
    return pa.table([*map(pa.array, columns), pa.array(br, pa.binary())], names=names)


def event_order(t: Trees, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and kinds (0 start, 1 end) of all events in the canonical order, trace by trace."""
    row = np.concatenate([np.arange(len(t.span))] * 2)
    kind = np.repeat([0, 1], len(t.span))
    turn = np.where(kind == 0, t.depth[row], -t.depth[row])
    at = np.lexsort((t.span.view(np.uint64)[row], turn, kind, np.concatenate([start, end]), t.trace[row]))
    return row[at], kind[at]


def _breadcrumbs(rows: pa.Table, s: Scheme, queued: dict[int, bytes] | None = None) -> tuple[pa.Table, list[tuple]]:
    """The structural scheme; ``queued`` gives the delayed ends that a row's start picks up."""
    t = Trees(rows, s.cpd)
    n = len(t.span)
    start, end = (rows.column(c).to_numpy() for c in ("start_us", "end_us"))
    services = rows.column("service").to_pylist()
    chains: list[list[wire.Level]] = [[] for _ in range(n)]
    payload: list[wire.Breadcrumbs | None] = [None] * n
    anchors, carried = [bytes(8)] * n, [b""] * n
    starts, open_ends, ordinal = [0] * n, [[] for _ in range(n)], [0] * n
    baggage, order_bytes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    delayed = []
    up, depth, ckpt = t.up.tolist(), t.depth.tolist(), t.ckpt.tolist()
    for i, kind in zip(*(x.tolist() for x in event_order(t, start, end)), strict=True):
        p = up[i]
        span_id = int(t.span[i]) & (1 << 64) - 1
        if kind == 0:
            held, chain, anchor = (queued or {}).get(i, b""), [], bytes(8)
            if p >= 0:
                starts[p] += 1
                ordinal[i] = starts[p]
                mark = None if ckpt[p] else (int(t.parent[i]) & (1 << 64) - 1) >> 64 - s.mark_bits
                chain = [*chains[p], wire.Level(ordinal[i], mark, [] if s.topology_only else open_ends[p])]
                open_ends[p] = []
                anchor, held = anchors[p], carried[p] + held if ordinal[i] == 1 else b""
            crumbs = wire.Breadcrumbs(depth[i], anchor[: s.anchor_bytes], chain, held)
            if ckpt[i] or t.leaf[i]:
                payload[i] = crumbs
            if ckpt[i]:  # below a checkpoint everything starts anew
                anchor, chain, held = span_id.to_bytes(8, "big"), [], b""
                crumbs = wire.Breadcrumbs(depth[i], anchor[: s.anchor_bytes], chain, held)
            chains[i], anchors[i], carried[i] = chain, anchor, held
            if p >= 0:
                baggage[i] = wire.BAGGAGE_NAME_BYTES + wire.breadcrumb_size(crumbs, s.mark_bits)
            continue
        if s.topology_only:
            continue
        if p >= 0:
            open_ends[p].append(ordinal[i])
        rest, open_ends[i] = open_ends[i][:-1], []  # the last end is implied
        if rest:
            quad = wire.pack_delayed(int(t.trace[i]).to_bytes(16, "big", signed=True) if t.trace[i] >= 0 else bytes(8) + int(t.trace[i]).to_bytes(8, "big", signed=True),
                                     depth[i], span_id >> 64 - s.mark_bits, rest, s.mark_bits)
            delayed.append((int(t.trace[i]), int(t.span[i]), services[i], int(end[i]), depth[i], quad))
    carrier = t.leaf | t.ckpt
    emit = np.array([0 if b is None else wire.NAME_BYTES + wire.TYPE_BYTES["crumbs"] + wire.breadcrumb_size(b, s.mark_bits) for b in payload], dtype=np.int64)
    if s.emit_order:
        own = _varints(np.array(ordinal)) if not s.omit_ordinal else 0
        order_bytes = np.where(~carrier, wire.ORDER_NAME_BYTES + _varints(t.depth) + own, 0)
    br = [None if b is None else wire.pack_breadcrumbs(b, s.mark_bits) for b in payload]
    return _table(t, carrier, t.up >= 0, emit, np.zeros(n, dtype=np.int64), order_bytes, baggage, br), delayed


def payloads(spans: DataFrame, scheme: Scheme = Scheme(), whole: bool = False) -> DataFrame:
    """Per span: depth, leaf, carrier, calls (1 if the parent handed something down), byte counts and the payload ``br``.

    Breadcrumbs come without delayed ends of other traces (:func:`with_delayed_ends` adds them). ``whole``: the rows come trace by trace.
    """
    s = scheme.settled()
    run = (lambda rows: _breadcrumbs(rows, s)[0]) if s.name == "crumbs" else (lambda rows: _simple(rows, s))
    return (map_whole if whole else map_traces)(spans.select("trace_id", "span_id", "parent_id", "service", "start_us", "end_us"), run, PAYLOAD)


def delayed_ends(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """Ends that no later child carried, as the owner's service queues them when the owner ends."""
    s = scheme.settled()
    names = [c.split()[0] for c in DELAYED.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        found = _breadcrumbs(rows, s)[1]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True) if found else [()] * 6, kinds, strict=True)], names=names)

    return map_traces(spans.select("trace_id", "span_id", "parent_id", "service", "start_us", "end_us"), run, DELAYED)


def next_start(queued: DataFrame, starts: DataFrame, slice_us: int = 3_600_000_000) -> DataFrame:
    """As-of join forward: for every queued row the next start on its service (``next_trace, next_span``).

    Both have ``service, ts, trace_id, span_id``; at equal times starts come before ends. A service's
    time is cut into slices, so no service is one task: a slice answers from its own starts, else from
    the first start of the next slice that has one (one row per service and slice).
    """
    cut = lambda df: df.withColumn("slice", F.floor(F.col("ts") / slice_us).cast("long"))
    key = F.struct("ts", "depth", "trace_id", "span_id")
    begin = cut(starts).withColumn("kind", F.lit(0)).select("service", "slice", "ts", "depth", "trace_id", "span_id", "kind")
    ends = cut(queued).withColumn("kind", F.lit(1)).withColumn("turn", -F.col("depth"))
    own = ["quad"] if "quad" in queued.columns else []  # what is queued goes along
    both = begin.withColumn("turn", F.col("depth")).unionByName(
        ends.select("service", "slice", "ts", "depth", "trace_id", "span_id", "kind", "turn", *own), allowMissingColumns=True
    )
    # looked at backwards: a frame that grows row by row is linear, one that shrinks is summed anew for every row
    order = [F.desc(c) for c in ("ts", "kind", "turn", "trace_id", "span_id")]
    after = Window.partitionBy("service", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("kind") == 0, key), ignorenulls=True).over(after)
    found = both.withColumn("inside", inside).where("kind = 1")
    per = begin.groupBy("service", "slice").agg(F.min(key).alias("first"))
    slices = per.unionByName(found.select("service", "slice").distinct(), allowMissingColumns=True).groupBy("service", "slice").agg(F.min("first").alias("first"))
    later = Window.partitionBy("service").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("later", F.last("first", ignorenulls=True).over(later)).select("service", "slice", "later")
    out = found.join(slices, ["service", "slice"]).withColumn("next", F.coalesce("inside", "later"))
    found = [F.col("next.trace_id").alias("next_trace"), F.col("next.span_id").alias("next_span")]
    return out.select("service", "trace_id", "span_id", "ts", *found, *(["depth", "quad"] if own else []))


def _starts(spans: DataFrame) -> DataFrame:
    from spanloom.plans.tree import with_depth

    return with_depth(spans).select("service", F.col("start_us").alias("ts"), "depth", "trace_id", "span_id")


def picked_up(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """``trace_id, span_id, incoming``: delayed ends, oldest first, that a span's start takes from its service's queue."""
    queued = materialize(delayed_ends(spans, scheme), "delayed")  # read for its slices too
    both = next_start(queued, _starts(spans)).where("next_span is not null")
    held = F.array_sort(F.collect_list(F.struct("ts", (-F.col("depth")).alias("turn"), "trace_id", "span_id", "quad")))
    per = both.groupBy(F.col("next_trace").alias("t"), F.col("next_span").alias("s")).agg(held.alias("held"))
    return per.select(F.col("t").alias("trace_id"), F.col("s").alias("span_id"), F.col("held.quad").alias("incoming"))


def with_delayed_ends(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """:func:`payloads` of breadcrumbs with the delayed ends that starts pick up from their service's queue."""
    s = scheme.settled()
    rows = spans.join(picked_up(spans, scheme), ["trace_id", "span_id"], "left")

    def run(rows: pa.Table) -> pa.Table:
        queued = {i: b"".join(x) for i, x in enumerate(rows.column("incoming").to_pylist()) if x}
        return _breadcrumbs(rows, s, queued)[0]

    return map_traces(rows.select("trace_id", "span_id", "parent_id", "service", "start_us", "end_us", "incoming"), run, PAYLOAD)


def large_pickups(spans: DataFrame, scheme: Scheme, threshold: int) -> DataFrame:
    """Starts that take more than ``threshold`` bytes of delayed ends, with their service."""
    size = F.aggregate("incoming", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    big = picked_up(spans, scheme).select("trace_id", "span_id", size.alias("incoming_bytes")).where(F.col("incoming_bytes") > threshold)
    return big.join(spans.select("trace_id", "span_id", "service"), ["trace_id", "span_id"])


def trace_metrics(p: DataFrame) -> DataFrame:
    """Per trace: spans, emitted payloads, calls, their bytes and the ratios of them (0 where nothing is counted)."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    count = lambda c: F.count(F.when(c, 1))
    sums = p.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("num_spans"),
        count(F.col("emit_bytes") > 0).alias("num_checkpoint_spans"),
        F.sum("emit_bytes").alias("checkpoint_sum"),
        F.max("emit_bytes").alias("max_checkpoint_payload"),
        F.sum("calls").alias("num_baggage_calls"),
        F.sum("baggage_bytes").alias("baggage_sum"),
        F.max("baggage_bytes").alias("max_baggage_call"),
        count(F.col("depth_bytes") > 0).alias("num_depth_spans"),
        F.sum("depth_bytes").alias("depth_overhead_sum"),
        count(F.col("order_bytes") > 0).alias("num_order_spans"),
        F.sum("order_bytes").alias("order_overhead_sum"),
    )
    return sums.withColumns(
        {
            "amortized_by_total": ratio("checkpoint_sum", "num_spans"),
            "amortized_by_checkpoint": ratio("checkpoint_sum", "num_checkpoint_spans"),
            "avg_baggage_call": ratio("baggage_sum", "num_baggage_calls"),
        }
    )


def large_baggage(p: DataFrame, threshold: int) -> DataFrame:
    """Calls that hand down more than ``threshold`` bytes."""
    return p.where(F.col("baggage_bytes") > threshold).select("trace_id", "span_id", "depth", "baggage_bytes")


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned varint: seven bits a byte."""
    out = F.lit(1)
    for k in range(1, 9):
        out = out + (n >= (1 << (7 * k))).cast("int")
    return out
