"""Whole trees rebuilt with the lost branching spans that survivors witness.

A fragment hangs on one surviving ancestor of its window; every lost branching span that a hash array
names must end up with two children at least: the fragments that name it as their parent, and those
routed through it. Each fragment takes its deepest ancestor unless a branching span would stay short;
then the fragments that can be routed through it are tried together, and the placement with the largest
sum of depths that satisfies all of them is taken (``cgp2``). ``cgp1`` takes the deepest ancestor
regardless, ``cgp0`` and ``pb`` forms of it without branching spans are in ``reconstruct``.

The tree names what evidence names: survivors, lost parents of fragments, witnessed branching spans.
The rest of a gap is filled with spans without identity.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.operators.exact import Program, solve
from spanloom.operators.handlers import Scheme
from spanloom.operators.reconstruct import Fragments, Part, Span, _survivors, fanouts_of, parts_of
from spanloom.plans.traces import map_traces

EDGES = "trace_id bigint, node_id bigint, parent_id bigint, is_anon boolean, parent_anon boolean, is_fanout boolean"


@dataclass
class Choice:
    """A fragment with the ancestors it may hang on, the deepest first, and the branching spans on its path by depth."""

    part: Part
    anchors: list[Span]
    fans: dict[int, int] = field(default_factory=dict)
    at: int = 0

    @property
    def anchor(self) -> Span:
        return self.anchors[self.at]


def choices_of(f: Fragments, fans: dict[int, tuple[int, Span]], pool: bool) -> list[Choice]:
    """All admissible ancestors of every fragment with a window, confirmed by all filters of the window."""
    parts = parts_of(f)
    siblings: dict[int, list[Part]] = defaultdict(list)
    for p in parts:
        if p.root.parent and p.root.parent not in f.by_id:
            siblings[p.root.parent].append(p)
    by_depth: dict[int, list[int]] = defaultdict(list)
    for id_, (depth, _) in sorted(fans.items(), key=lambda x: x[0] & (1 << 64) - 1):
        by_depth[depth].append(id_)
    out = []
    for p in parts:
        if not p.root.parent or p.top is None:
            continue
        low = p.top.depth
        team = siblings[p.root.parent] if pool else [p]
        filters = [(s.depth, s.payload.bits) for q in team for s in q.spans if s.payload and f.window_top(s.depth) == low]
        filters = filters or [(p.carrier.depth, p.carrier.payload.bits)]
        agreed = lambda id_, depth: all(f.holds(bits, id_) for at, bits in filters if at > depth)  # noqa: B023, E731
        anchors, path = [], {}
        for depth in range(p.root.depth - 2, low, -1):
            anchors += [s for s in f.by_depth[depth] if not s.leaf and agreed(s.id, depth) and (s.parent == p.top.id or agreed(s.parent, depth - 1))]
            for id_ in by_depth[depth]:
                if agreed(id_, depth):
                    path[depth] = id_
        out.append(Choice(p, [*anchors, p.top], path))
    return out


def windows_of(f: Fragments, fans: dict[int, tuple[int, Span]], choices: list[Choice]) -> dict[int, int]:
    """The window's checkpoint of each branching span: its witness's, else that of a fragment that names it."""
    out = {c.part.root.parent: c.part.top.id for c in choices if c.part.root.parent in fans}
    for id_, (_, witness) in fans.items():
        top, _ = f.checkpoint(witness)
        if top is not None:
            out[id_] = top.id
    return out


def satisfy(choices: list[Choice], fans: dict[int, tuple[int, Span]], windows: dict[int, int]) -> None:
    """Move fragments to shallower ancestors where a branching span would have less than two children, at the least cost."""
    named: dict[int, int] = defaultdict(int)
    for c in choices:
        named[c.part.root.parent] += 1
    routes = {m: [c for c in choices if c.part.top.id == windows.get(m) and m in c.fans.values()] for m in fans if m in windows}
    need = {m: min(2 - named[m], len(cs)) for m, cs in routes.items() if named[m] < 2 and cs}

    def passing(m: int, depth: int) -> bool:
        return depth < fans[m][0]

    short = [m for m, n in need.items() if n > sum(passing(m, c.anchor.depth) for c in routes[m])]
    if not short:
        return
    # only fragments that touch a short span, or one they share it with, can have to move
    group, grown = set(short), True
    while grown:
        more = {m for m in need if m not in group and any(c in routes[k] for k in group for c in routes[m])}
        grown = bool(more)
        group |= more
    free = [c for c in choices if any(c in routes[m] for m in group)]
    p = Program()
    picks: dict[int, tuple[Choice, int]] = {}
    through: dict[int, list[int]] = {m: [] for m in group}
    for c in free:
        seen, own = set(), []
        for k, anchor in enumerate(c.anchors):
            passed = frozenset(m for m in group if c in routes[m] and passing(m, anchor.depth))
            if passed in seen:
                continue  # a deeper ancestor passes the same spans
            seen.add(passed)
            v = p.var(anchor.depth - c.anchors[0].depth)
            picks[v] = c, k
            own.append(v)
            for m in passed:
                through[m].append(v)
        p.group(own)
        p.one_of(own)
    for m in group:
        p.at_least([(1, v) for v in through[m]], need[m])
    found = solve(p)
    if found is not None:  # else some spans cannot all have two children, and every fragment stays where it is
        for v in found.true:
            c, k = picks[v]
            c.at = k


def rebuild(f: Fragments, engine: str = "cgp2") -> tuple[dict[int, int], set[int], set[int]]:
    """Parent of every node, the nodes without identity (numbered from 1, past ids in use), the branching spans."""
    fans = fanouts_of(f)
    choices = choices_of(f, fans, pool=engine == "cgp2")
    windows = windows_of(f, fans, choices)
    if engine == "cgp2":
        satisfy(choices, fans, windows)
    parent = {s.id: s.parent for s in f.spans if s.parent in f.by_id}
    used = set(f.by_id) | set(fans) | {c.part.root.parent for c in choices}
    anon: set[int] = set()
    fresh = iter(i for i in range(1, 1 << 62) if i not in used)
    for c in sorted(choices, key=lambda c: c.part.root.key):
        at, root = c.part.root.id, c.part.root
        for depth in range(root.depth - 1, c.anchor.depth, -1):
            if at in parent:
                break
            fan = c.fans.get(depth)
            if depth == root.depth - 1:
                node = root.parent
            elif fan is not None and windows.get(fan) == c.part.top.id:
                node = fan
            else:
                node = next(fresh)
                anon.add(node)
            parent[at] = node
            at = node
        parent.setdefault(at, c.anchor.id)
    return parent, anon, set(fans)


def trees(survivors: DataFrame, scheme: Scheme, engine: str = "cgp2") -> DataFrame:
    """The edges of whole rebuilt trees; ``is_anon`` and ``parent_anon`` mark ends without identity."""
    s = Scheme(**{**scheme.__dict__, "name": "cgprb"}).settled()
    names = [c.split()[0] for c in EDGES.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for trace, f in _survivors(rows, s):
            parent, anon, fans = rebuild(f, engine)
            out += [(trace, node, up, node in anon, up in anon, node in fans) for node, up in parent.items()]
        kinds = [pa.int64()] * 3 + [pa.bool_()] * 3
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)

    return map_traces(survivors.select("trace_id", "span_id", "parent_id", "depth", "br"), run, EDGES)
