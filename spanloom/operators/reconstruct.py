"""Trees rebuilt from the spans that survived and the payloads they persisted.

A fragment is a connected part of the survivors; its root's parent was lost (an orphan). Every engine
attaches orphans to surviving ancestors: ``pb`` by filters, ``pcr`` by the prefix of the checkpoint
above, ``pcrb`` by both (anchored at the checkpoint, then threaded down level by level where one
candidate is left), ``pb2`` by all filters of the window and of the fragments that share the lost
parent (deepest admissible ancestor), ``pb1`` and ``pb0`` without those of the siblings, the latter
looking no further than the first hit. Traces are independent: they are shuffled once and rebuilt
many at a time, each in memory proportional to its own spans.

Equal choices are settled by the smallest id as an unsigned number.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions import wire
from spanloom.functions.hashing import Blooms
from spanloom.operators.handlers import Scheme
from spanloom.plans.traces import groups, map_traces

ENGINES = {"pb": "pb", "pcr": "pcr", "pcrb": "pcrb", "pb2": "pcrb", "pb1": "pcrb", "pb0": "pcrb", "cgp": "cgprb", "ledger": "pcrb", "map": "pcrb", "cgprb": "cgprb"}
LINKS = "trace_id bigint, orphan_id bigint, anchor_id bigint, synthetic int, ambiguous boolean, via_carrier bigint, fanout bigint"


@dataclass
class Payload:
    """What a carrier says: its checkpoint's prefix, its filter and the branches it witnesses."""

    prefix: bytes
    bits: int
    entries: list[tuple[int, int]] = field(default_factory=list)


class Span:
    """A survivor."""

    __slots__ = ("id", "key", "parent", "depth", "payload", "leaf", "kids")

    def __init__(self, id_: int, parent: int, depth: int, payload: Payload | None, cpd: int):
        self.id, self.parent, self.depth, self.payload = id_, parent, depth, payload
        self.key = id_ & (1 << 64) - 1
        #: A payload away from checkpoint depths proves a leaf.
        self.leaf = payload is not None and depth % cpd != 0
        self.kids: list[Span] = []


@dataclass
class Link:
    """An orphan's new place."""

    orphan: Span
    anchor: Span | None
    ambiguous: bool = False
    via: int = 0
    fanout: int = 0


class Fragments:
    """The survivors of one trace and what they hang together by."""

    def __init__(self, spans: list[Span], masks: dict[int, int], cpd: int, prefix: int, probes: int = 1 << 30):
        self.spans = sorted(spans, key=lambda s: (s.depth, s.key))
        #: ``probes``: the bits of a filter that an id sets at most.
        self.masks, self.cpd, self.prefix, self.probes = masks, cpd, prefix, probes
        self.by_id = {s.id: s for s in self.spans}
        self.by_depth: dict[int, list[Span]] = defaultdict(list)
        self.orphans: list[Span] = []
        self.heads: dict[int, dict[bytes, list[Span]]] = {}
        for s in self.spans:
            self.by_depth[s.depth].append(s)
            if s.parent in self.by_id:
                self.by_id[s.parent].kids.append(s)
            elif s.parent:
                self.orphans.append(s)

    def holds(self, bits: int, id_: int) -> bool:
        """Whether a filter may hold an id."""
        mask = self.masks[id_]
        return bits & mask == mask

    def band(self, s: Span) -> int:
        """The first checkpoint level below a span."""
        return (s.depth // self.cpd + 1) * self.cpd

    def window_top(self, depth: int) -> int:
        """The checkpoint level that a payload at ``depth`` names; negative above the root."""
        return depth - self.cpd if depth % self.cpd == 0 else depth // self.cpd * self.cpd

    def below(self, root: Span) -> Iterator[Span]:
        """The spans of a fragment, level by level."""
        level = [root]
        while level:
            yield from level
            level = [k for s in level for k in s.kids]

    def nearest_carrier(self, root: Span) -> Span | None:
        """The nearest carrier at or below a span on surviving edges, inside its band."""
        level, band = [root], self.band(root)
        while level:
            for s in level:
                if s.payload:
                    return s
            level = sorted((k for s in level for k in s.kids if k.depth <= band), key=lambda s: s.key)
        return None

    def checkpoint(self, carrier: Span) -> tuple[Span | None, bool]:
        """The surviving checkpoint that a carrier names, and whether another one has the same prefix."""
        top = self.window_top(carrier.depth)
        if top < 0:
            return None, False
        if top not in self.heads:
            self.heads[top] = heads = defaultdict(list)
            for s in self.by_depth[top]:
                heads[s.key.to_bytes(8, "big")[: self.prefix]].append(s)
        hits = self.heads[top].get(carrier.payload.prefix, ())
        return (hits[0] if hits else None), len(hits) > 1


def by_filter(f: Fragments, bottom_up: bool = False, chain_check: bool = True, siblings: bool = False) -> list[Link]:
    """``pb``: the deepest survivor at least two levels up that the orphan's filter holds.

    ``siblings``: only those under which all bits of the filter can have been set; of several at that level, those that the
    filters of the fragments with the same lost parent hold too, and of these the one that is held by accident least likely.
    """
    carriers = [s for s in f.spans if s.payload]
    teams: dict[int, list[Span]] = defaultdict(list)
    for o in f.orphans:
        teams[o.parent].append(o)
    placed: dict[int, list[Span]] = defaultdict(list)
    out = []
    for o in sorted(f.orphans, key=lambda s: (-s.depth, s.key)) if bottom_up else f.orphans:
        bits, via = _covering(f, o, carriers, placed)
        low = (o.depth - 1) // f.cpd * f.cpd
        link = Link(o, None)
        for depth in range(o.depth - 2, low - 1, -1) if bits is not None else ():
            hits = [s for s in f.by_depth[depth] if f.holds(bits, s.id) and (not chain_check or _chain(f, bits, s, low))]
            if siblings and hits and not via:
                left = {s.id: _unset(f, f.nearest_carrier(o), o, s, low) for s in hits}
                hits = [s for s in hits if left[s.id] is not None]
            if hits:
                if siblings and len(hits) > 1:
                    near = [f.nearest_carrier(q) for q in teams[o.parent] if q is not o]
                    hits = [s for s in hits if all(f.holds(c.payload.bits, s.id) for c in near if c)] or hits
                    if not via:
                        least = min(left[s.id] for s in hits)
                        hits = [s for s in hits if left[s.id] == least]
                link = Link(o, hits[0], len(hits) > 1, via)
                if bottom_up:
                    placed[hits[0].id].append(o)
                break
        out.append(link)
    return out


def _covering(f: Fragments, o: Span, carriers: list[Span], placed: dict[int, list[Span]]) -> tuple[int | None, int]:
    """A filter that covers the gap above an orphan, and the carrier it was borrowed from by a guess."""
    if o.payload:
        return o.payload.bits, 0
    band = f.band(o)
    level = [(k, False) for k in o.kids] + [(k, True) for k in placed.get(o.id, ())]
    while level:
        below = []
        for s, guessed in sorted(level, key=lambda x: (x[1], x[0].key)):
            if s.depth > band:
                continue
            if s.payload is None:
                below += [(k, guessed) for k in s.kids] + [(k, True) for k in placed.get(s.id, ())]
            elif not guessed:
                return s.payload.bits, 0
            elif f.holds(s.payload.bits, o.id):
                return s.payload.bits, s.id
        level = below
    for s in carriers:  # shallowest first
        if o.depth < s.depth <= band and f.holds(s.payload.bits, o.id):
            return s.payload.bits, s.id
    return None, 0


def _chain(f: Fragments, bits: int, s: Span, low: int) -> bool:
    """Whether every ancestor of a candidate that can be named is in the filter, up to the window's top."""
    while s.depth > low and s.parent:
        if not f.holds(bits, s.parent):
            return False
        if s.parent not in f.by_id:
            return True
        s = f.by_id[s.parent]
    return True


def _named(f: Fragments, s: Span, top: int) -> tuple[int, int]:
    """The bits of a span and of all that can be named above it down from level ``top``, and how many there have no name."""
    bits = f.masks[s.id]
    while s.depth > top and s.parent:
        bits |= f.masks[s.parent]
        if s.parent not in f.by_id:
            return bits, s.depth - 1 - top
        s = f.by_id[s.parent]
    return bits, 0


def _unset(f: Fragments, carrier: Span, o: Span, anchor: Span, low: int) -> tuple[int, int] | None:
    """What speaks against an anchor: the filter's bits that nothing named on the path sets, and how few bits the anchor itself needs.

    None where the lost spans without a name cannot have set them all. A filter is no more than the bits of its path, and an
    id of few bits (its probes may fall together) is soon held by accident.
    """
    below, _ = _named(f, carrier, o.depth)
    above, lost = _named(f, anchor, low)
    left = (carrier.payload.bits & ~(below | above | f.masks[o.parent])).bit_count()
    if left > (lost + o.depth - anchor.depth - 2) * f.probes:
        return None
    return left, -above.bit_count()


def by_prefix(f: Fragments) -> list[Link]:
    """``pcr``: the checkpoint that the orphan's nearest carrier names."""
    out = []
    for o in f.orphans:
        carrier = f.nearest_carrier(o)
        anchor, ambiguous = f.checkpoint(carrier) if carrier else (None, False)
        out.append(Link(o, anchor, ambiguous, carrier.id if carrier and carrier is not o else 0))
    return out


def by_both(f: Fragments, stop_on_gap: bool = False) -> list[Link]:
    """``pcrb``: anchored like ``pcr``, then threaded down through what the filter holds.

    Candidates are the anchor's surviving descendants and the other fragments of the window whose lost
    parent the filter holds; a span that it does not hold cuts off all below. The levels are walked
    downwards: one candidate is taken, none is passed (or ends the walk), several end it.
    """
    out = by_prefix(f)
    roots: dict[int, list[Span]] = defaultdict(list)
    for b in out:
        if b.anchor:
            roots[b.anchor.id].append(b.orphan)
    for b in out:
        last = b.orphan.depth - 2
        if not b.anchor or last <= b.anchor.depth:
            continue
        bits = (f.by_id[b.via] if b.via else b.orphan).payload.bits
        levels: dict[int, list[Span]] = defaultdict(list)
        todo = [*b.anchor.kids, *(r for r in roots[b.anchor.id] if r is not b.orphan and f.holds(bits, r.parent))]
        while todo:
            s = todo.pop()
            if s is b.orphan or s.depth > last or s.leaf or not f.holds(bits, s.id):
                continue
            levels[s.depth].append(s)
            todo += s.kids
        at = b.anchor
        for depth in range(b.anchor.depth + 1, last + 1):
            if len(levels[depth]) > 1 or (stop_on_gap and not levels[depth]):
                break
            at = levels[depth][0] if levels[depth] else at
        b.anchor = at
    return out


@dataclass
class Part:
    """A fragment with the evidence for its place."""

    root: Span
    spans: list[Span]
    carrier: Span | None
    borrowed: bool = False
    top: Span | None = None
    ambiguous: bool = False


def parts_of(f: Fragments) -> list[Part]:
    """Fragments with their shallowest carrier; one without borrows the shallowest that holds its root and its lost parent."""
    out = []
    carriers = [s for s in f.spans if s.payload]
    for root in (s for s in f.spans if s.parent not in f.by_id):
        spans = list(f.below(root))
        own = min((s for s in spans if s.payload), key=lambda s: (s.depth, s.key), default=None)
        part = Part(root, spans, own)
        if own is None:
            band = f.band(root)
            for c in carriers:
                if root.depth < c.depth <= band and f.holds(c.payload.bits, root.id) and (not root.parent or f.holds(c.payload.bits, root.parent)):
                    part.carrier, part.borrowed = c, True
                    break
        if part.carrier:
            part.top, part.ambiguous = f.checkpoint(part.carrier)
        out.append(part)
    return out


def fanouts_of(f: Fragments) -> dict[int, tuple[int, Span]]:
    """Lost branching spans that hash arrays name: depth, and the shallowest witness."""
    out: dict[int, tuple[int, Span]] = {}
    for s in f.spans:
        for parent, depth in s.payload.entries if s.payload else ():
            if parent not in f.by_id and (parent not in out or s.depth < out[parent][1].depth):
                out[parent] = (depth - 1, s)
    return out


def by_windows(f: Fragments, pool: bool = True, lean: bool = False) -> list[Link]:
    """``pb2`` (``pool``), ``pb1`` and ``pb0`` (``lean``): the deepest survivor that all filters of the window hold.

    With nothing but "one place per fragment" to satisfy, the best total of depths is the best depth of each.
    """
    parts = parts_of(f)
    siblings: dict[int, list[Part]] = defaultdict(list)
    for p in parts:
        if p.root.parent and p.root.parent not in f.by_id:
            siblings[p.root.parent].append(p)
    fanouts = fanouts_of(f)
    out = []
    for p in parts:
        if not p.root.parent:
            continue
        if p.top is None:
            out.append(Link(p.root, None))
            continue
        low = p.top.depth
        team = siblings[p.root.parent] if pool else [p]
        filters = [(s.depth, s.payload.bits) for q in team for s in q.spans if s.payload and f.window_top(s.depth) == low]
        filters = filters or [(p.carrier.depth, p.carrier.payload.bits)]
        agreed = lambda id_, depth: all(f.holds(bits, id_) for at, bits in filters if at > depth)  # noqa: B023, E731
        anchor, ambiguous = p.top, p.ambiguous
        for depth in range(p.root.depth - 2, low, -1):
            hits = []
            for s in f.by_depth[depth]:
                if not s.leaf and agreed(s.id, depth) and (s.parent == p.top.id or agreed(s.parent, depth - 1)):
                    hits.append(s)
                    if lean:
                        break
            if hits:
                anchor, ambiguous = hits[0], len(hits) > 1
                break
        named = p.root.parent if p.root.parent in fanouts or len(siblings[p.root.parent]) > 1 else 0
        out.append(Link(p.root, anchor, ambiguous, p.carrier.id if p.borrowed else 0, named))
    return out


RUN = {
    "pb": by_filter,
    "pcr": by_prefix,
    "pcrb": by_both,
    "pb2": by_windows,
    "pb1": lambda f: by_windows(f, pool=False),
    "pb0": lambda f: by_windows(f, pool=False, lean=True),
    "cgp": by_windows,
}


def _survivors(rows: pa.Table, s: Scheme) -> Iterator[tuple[int, Fragments]]:
    """The survivors of each trace of a run, decoded."""
    trace, span, parent, depth = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "parent_id", "depth"))
    masks = {0: 0}
    size = 0
    if s.name in ("pb", "pcrb", "cgprb"):
        blooms = Blooms(*s.filter_size)
        size = blooms.bytes
        ids = np.unique(np.concatenate([span, parent]))
        held = blooms.masks(ids).tobytes()
        masks |= {i: int.from_bytes(held[k * size : (k + 1) * size], "little") for k, i in enumerate(ids.tolist())}
    br = rows.column("br").to_pylist()
    runs = groups(trace)
    trace, span, parent, depth = (x.tolist() for x in (trace, span, parent, depth))
    for a, b in runs:
        spans = []
        for i in range(a, b):
            payload = None
            if br[i] is not None:
                _, head, bits, entries = wire.read_payload(br[i], s.name, s.prefix, size)
                payload = Payload(head, int.from_bytes(bits, "little"), entries)
                for e, _ in entries:
                    if e not in masks:
                        masks[e] = int.from_bytes(blooms.masks(np.array([e]))[0].tobytes(), "little")
            spans.append(Span(span[i], parent[i], depth[i], payload, s.cpd))
        yield trace[a], Fragments(spans, masks, s.cpd, s.prefix, s.filter_size[1])


def places(rows: pa.Table, engine: Callable[..., list[Link]], s: Scheme, **options) -> pa.Table:
    """``LINKS`` of a run of whole traces' survivors; ``engine`` is one of ``RUN`` (a worker knows only those of this module), ``s`` its own scheme."""
    names = [c.split()[0] for c in LINKS.split(", ")]
    out = []
    for trace, f in _survivors(rows, s):
        for b in engine(f, **options):
            lost = b.orphan.depth - b.anchor.depth - 1 if b.anchor else None
            out.append((trace, b.orphan.id, b.anchor.id if b.anchor else None, lost, b.ambiguous, b.via, b.fanout))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)


def links(survivors: DataFrame, engine: str, scheme: Scheme, **options) -> DataFrame:
    """Every orphan's place: ``anchor_id`` null where no evidence gives one, ``synthetic`` spans lost in between.

    ``survivors`` has ``trace_id, span_id, parent_id, depth, br`` (null ``br`` for spans that persisted
    only their depth). ``fanout`` is the lost parent that the orphan shares with others, 0 for none.
    """
    s = Scheme(**{**scheme.__dict__, "name": ENGINES[engine]}).settled()
    own = RUN[engine]
    return map_traces(survivors.select("trace_id", "span_id", "parent_id", "depth", "br"), lambda rows: places(rows, own, s, **options), LINKS)


TIMINGS = "trace_id bigint, survivors int, orphans int, reconnected int, recon_ns bigint"


def timings(survivors: DataFrame, engine: str, scheme: Scheme) -> DataFrame:
    """Per trace: survivors, orphans, those with a place, and the nanoseconds that the engine took (decoding left out)."""
    s = Scheme(**{**scheme.__dict__, "name": ENGINES[engine]}).settled()
    names = [c.split()[0] for c in TIMINGS.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for trace, f in _survivors(rows, s):
            began = time.perf_counter_ns()
            found = RUN[engine](f)
            out.append((trace, len(f.spans), len(found), sum(b.anchor is not None for b in found), time.perf_counter_ns() - began))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=names)

    return map_traces(survivors.select("trace_id", "span_id", "parent_id", "depth", "br"), run, TIMINGS)


# ---- breadcrumbs ----


class Node:
    """A place in a tree rebuilt from breadcrumbs."""

    __slots__ = ("ordinal", "id", "mark", "bits", "root", "ends", "kids")

    def __init__(self, ordinal: int):
        self.ordinal, self.id, self.mark, self.bits, self.root, self.ends, self.kids = ordinal, None, None, 0, False, [], {}


class Conflict(Exception):
    """Payloads that cannot all be true, or cannot be told apart."""


def skeleton(payloads: list[tuple[int, bytes]], s: Scheme) -> Node:
    """The tree that the breadcrumbs of one trace draw; windows meet at their checkpoints."""
    cut = 64 - 8 * s.anchor_bytes
    read = [(id_, wire.read_breadcrumbs(br, s.cpd, s.mark_bits, s.anchor_bytes)) for id_, br in payloads]
    windows: dict[int, Node] = {}
    owner: dict[int, int] = {}

    def window(mark: int) -> Node:
        if mark not in windows:
            windows[mark] = node = Node(0)
            node.mark, node.bits, node.root = mark, 8 * s.anchor_bytes, True
        return windows[mark]

    top = None
    for id_, b in read:
        if b.depth % s.cpd == 0 and owner.setdefault((id_ & (1 << 64) - 1) >> cut, id_) != id_:
            raise Conflict("two checkpoints share an anchor")
    for id_, b in read:
        own = window((id_ & (1 << 64) - 1) >> cut) if b.depth % s.cpd == 0 else None
        at = own if b.depth == 0 else window(int.from_bytes(b.anchor, "big"))
        if b.depth == 0:
            top = own
        for k, level in enumerate(b.chain):
            if level.mark is not None and not at.root:
                if at.bits and at.mark != level.mark:
                    raise Conflict("fingerprints differ")
                at.mark, at.bits = level.mark, s.mark_bits
            child = own if own is not None and k == len(b.chain) - 1 else None
            held = at.kids.get(level.ordinal)
            if child is not None and held is not None and held is not child:
                raise Conflict("an ordinal is taken")
            child = held or child or Node(level.ordinal)
            child.ordinal = level.ordinal
            child.ends = level.ends or child.ends
            at.kids[level.ordinal] = child
            at = child
        if at.id not in (None, id_):
            raise Conflict("two spans in one place")
        at.id = id_
    if top is None:
        raise Conflict("no root")
    return top


def _nodes(top: Node) -> Iterator[tuple[Node, Node | None, int]]:
    todo = [(top, None, 0)]
    while todo:
        node, above, depth = todo.pop()
        yield node, above, depth
        todo += [(k, node, depth + 1) for k in node.kids.values()]


def _mark(node: Node, width: int) -> int | None:
    if not node.bits:
        return None
    return node.mark >> max(0, node.bits - width) if node.root else node.mark


def identify(top: Node, survivors: list[tuple[int, int, int, int]], s: Scheme) -> dict[str, int]:
    """Put surviving spans (``id, parent, ordinal, depth``) into the tree: by their edges, severed ones by fingerprints."""
    known = {n.id for n, _, _ in _nodes(top) if n.id is not None}
    kids: dict[int, dict[int, int]] = defaultdict(dict)
    for id_, parent, ordinal, _ in survivors:
        if parent:
            kids[parent][ordinal] = id_
    count = {"identified": 0, "placed": 0, "ambiguous": 0, "no_place": 0}
    todo, seen = [top], set()
    while todo:
        node = todo.pop()
        if node.id is None or id(node) in seen:
            continue
        seen.add(id(node))
        for ordinal, id_ in kids.get(node.id, {}).items():
            child = node.kids.get(ordinal)
            if child is None:
                continue
            if child.id is None:
                child.id = id_
                count["identified"] += 1
            known.add(id_)
            todo.append(child)
    free: dict[tuple, list[Node]] = defaultdict(list)
    for node, above, depth in _nodes(top):
        if node.id is None and above is not None:
            own, up = _mark(node, s.mark_bits), _mark(above, s.mark_bits)
            if own is not None and up is not None:
                free[(depth, 0 if s.omit_ordinal else node.ordinal, own, up)].append(node)
    cut = 64 - s.mark_bits
    for id_, parent, ordinal, depth in survivors:
        if id_ in known:
            continue
        key = (depth, 0 if s.omit_ordinal else ordinal, (id_ & (1 << 64) - 1) >> cut, (parent & (1 << 64) - 1) >> cut)
        places = free.get(key, [])
        if len(places) == 1:
            places[0].id = id_
        count["placed" if len(places) == 1 else "ambiguous" if places else "no_place"] += 1
    return count


def embeds(top: Node, root: int, kids: dict[int, dict[int, int]], exact: bool = False) -> bool:
    """Whether a rebuilt tree lies inside the true one (``exact``: is it), with every fingerprint and id right."""
    todo = [(top, root)]
    while todo:
        node, true = todo.pop()
        if node.id not in (None, true) or (node.bits and node.mark != (true & (1 << 64) - 1) >> 64 - node.bits):
            return False
        own = kids.get(true, {})
        if exact and len(own) != len(node.kids):
            return False
        for ordinal, child in node.kids.items():
            if ordinal not in own:
                return False
            todo.append((child, own[ordinal]))
    return True


TREES = (
    "trace_id bigint, solved boolean, reason string, nodes int, known int, survivors int, identified int, placed int, "
    "ambiguous int, no_place int, embeds boolean, exact boolean"
)


def breadcrumb_trees(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """Per trace, the tree rebuilt from breadcrumbs after losses, and whether it lies in the true one.

    ``spans`` has ``trace_id, span_id, parent_id, depth, ordinal, dropped, br``.
    """
    s = scheme.settled()
    names = [c.split()[0] for c in TREES.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        trace = rows.column("trace_id").to_numpy()
        columns = [rows.column(c).to_pylist() for c in ("span_id", "parent_id", "ordinal", "depth", "dropped", "br")]
        out = []
        for a, b in groups(trace):
            own = list(zip(*(c[a:b] for c in columns), strict=True))
            alive = [x for x in own if not x[4]]
            head = (int(trace[a]),)
            try:
                top = skeleton([(x[0], x[5]) for x in alive if x[5] is not None], s)
            except (Conflict, ValueError) as e:
                out.append((*head, False, str(e), 0, 0, len(alive), 0, 0, 0, 0, False, False))
                continue
            count = identify(top, [x[:4] for x in alive], s)
            kids: dict[int, dict[int, int]] = defaultdict(dict)
            root = 0
            for id_, parent, ordinal, *_ in own:
                if parent:
                    kids[parent][ordinal] = id_
                else:
                    root = id_
            nodes = list(_nodes(top))
            known = sum(n.id is not None for n, _, _ in nodes)
            out.append((*head, True, None, len(nodes), known, len(alive), *count.values(), embeds(top, root, kids), embeds(top, root, kids, exact=True)))
        kinds = [pa.int64(), pa.bool_(), pa.string(), *[pa.int32()] * 7, pa.bool_(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 12, kinds, strict=True)], names=names)

    return map_traces(spans.select("trace_id", "span_id", "parent_id", "ordinal", "depth", "dropped", "br"), run, TREES)
