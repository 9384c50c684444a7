"""The order of events in trees rebuilt from breadcrumbs: ends, critical paths, times of lost spans.

A child's breadcrumb tells which siblings ended since the one before it started; ends after the last
start travel apart, with depth and fingerprint of their owner. Together they give the order in which a
span's children ended, but for the last end, which is implied. A delayed end goes to the one span of
its depth and fingerprint whose children include it and have not ended yet; more than one is a
conflict, and the trace's order is given up rather than guessed.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.functions import wire
from spanloom.operators.handlers import Scheme
from spanloom.operators.reconstruct import Conflict, Node, _mark, _nodes, identify, skeleton
from spanloom.plans.traces import groups, map_traces

ORDERS = "trace_id bigint, solved boolean, rejected boolean, parents int, end_order_ok int, order_ok boolean, critical_path_ok boolean, times_ok boolean"


def end_order(node: Node, delayed: list[int]) -> list[int]:
    """Ordinals of a node's children in the order they ended."""
    kids = sorted(node.kids)
    order = [e for k in kids for e in node.kids[k].ends] + delayed
    return order + [k for k in kids if k not in set(order)][:1]


def merged(node: Node, delayed: list[int]) -> list[tuple[int, bool]]:
    """Starts and ends (True) of a node's children in one order."""
    kids, out, gone = sorted(node.kids), [], set()
    for k in kids:
        out += [(e, True) for e in node.kids[k].ends] + [(k, False)]
        gone.update(node.kids[k].ends)
    out += [(e, True) for e in delayed]
    gone.update(delayed)
    return out + [(k, True) for k in kids if k not in gone][:1]


def owner_of(quad: tuple[bytes, int, int, list[int]], nodes: list[tuple[Node, int]], mark_bits: int) -> list[Node]:
    """The nodes that a run of delayed ends can belong to."""
    _, depth, mark, ends = quad
    out = []
    for node, at in nodes:
        own = (node.id & (1 << 64) - 1) >> 64 - mark_bits if node.id is not None else _mark(node, mark_bits)
        if at != depth or not node.kids or own != mark:
            continue
        seen = {e for k in node.kids.values() for e in k.ends}
        if all(e in node.kids and e not in seen for e in ends):
            out.append(node)
    return out


def spread_times(top: Node, delayed: dict[int, list[int]], times: dict[int, list[int]], step: int = 1) -> None:
    """Times for lost spans, from the leaves up: events of siblings at least ``step`` apart in their order, parents around children.

    ``times`` maps a node (by ``id()``) to its start and end; those of survivors stay as they are.
    """
    for node in reversed([n for n, _, _ in _nodes(top)]):
        if not node.kids:
            continue
        events = merged(node, delayed.get(id(node), []))
        get = lambda e: times[id(node.kids[e[0]])][e[1]]  # noqa: B023, E731
        for before, e in zip(events, events[1:], strict=False):
            if node.kids[e[0]].id is None and get(e) < get(before) + step:
                times[id(node.kids[e[0]])][e[1]] = get(before) + step
        for e, after in reversed(list(zip(events, events[1:], strict=False))):
            if node.kids[e[0]].id is None and get(e) > get(after) - step:
                times[id(node.kids[e[0]])][e[1]] = get(after) - step
        if node.id is None:
            own = [times[id(k)] for k in node.kids.values()]
            times[id(node)] = [min(t[0] for t in own), max(t[1] for t in own)]


def orders(spans: DataFrame, scheme: Scheme) -> DataFrame:
    """Per trace: parents of several children, those whose children's ends are in the true order, and the path of last ends.

    ``spans`` has ``trace_id, span_id, parent_id, ordinal, depth, dropped, br, quad, start_us, end_us, end_pos``:
    ``quad`` the delayed ends that a span queued, ``end_pos`` the place of its end among the trace's events.
    ``times_ok``: after filling in times no lost span reaches outside its parent's children's order.
    """
    s = scheme.settled()
    names = [c.split()[0] for c in ORDERS.split(", ")]
    columns = ["span_id", "parent_id", "ordinal", "depth", "dropped", "br", "quad", "start_us", "end_us", "end_pos"]

    def run(rows: pa.Table) -> pa.Table:
        trace = rows.column("trace_id").to_numpy()
        held = [rows.column(c).to_pylist() for c in columns]
        out = []
        for a, b in groups(trace):
            own = list(zip(*(c[a:b] for c in held), strict=True))
            out.append((int(trace[a]), *_order_of(own, s)))
        kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names=names)

    return map_traces(spans.select("trace_id", *columns), run, ORDERS)


def _order_of(own: list[tuple], s: Scheme) -> tuple:
    alive = [x for x in own if not x[4]]
    try:
        top = skeleton([(x[0], x[5]) for x in alive if x[5] is not None], s)
    except (Conflict, ValueError):
        return False, False, 0, 0, False, False, False
    identify(top, [x[:4] for x in alive], s)
    kids: dict[int, dict[int, int]] = defaultdict(dict)
    root = 0
    for id_, parent, ordinal, *_ in own:
        if parent:
            kids[parent][ordinal] = id_
        else:
            root = id_
    end_at = {x[0]: x[9] for x in own}
    clock = {x[0]: [x[7], x[8]] for x in own}
    # the true span behind every node
    true, todo, nodes = {id(top): root}, [top], []
    depths = {id(n): d for n, _, d in _nodes(top)}
    while todo:
        n = todo.pop()
        nodes.append((n, depths[id(n)]))
        for ordinal, k in n.kids.items():
            true[id(k)] = kids.get(true[id(n)], {}).get(ordinal, 0)
            todo.append(k)
    delayed: dict[int, list[int]] = defaultdict(list)
    for x in own:
        for quad in wire.read_delayed(x[6], s.mark_bits) if x[6] else ():
            found = owner_of(quad, nodes, s.mark_bits)
            if len(found) > 1:
                return True, True, 0, 0, False, False, False
            if found:
                delayed[id(found[0])] += quad[3]
    parents = right = 0
    for n, _ in nodes:
        if len(n.kids) > 1:
            parents += 1
            want = sorted(n.kids, key=lambda o: end_at.get(true[id(n.kids[o])], 0))  # noqa: B023
            right += end_order(n, delayed[id(n)]) == want
    path, want, n, t = [], [], top, root
    while True:
        path.append(true[id(n)])
        if not n.kids:
            break
        n = n.kids[end_order(n, delayed[id(n)])[-1]]
    while True:
        want.append(t)
        below = kids.get(t)
        if not below:
            break
        t = max(below.values(), key=lambda i: end_at[i])
    times = {id(n): list(clock[n.id]) if n.id is not None else [0, 0] for n, _ in nodes}
    for n, _ in nodes:
        if n.id is None:  # seeds: what is known around a lost span
            times[id(n)] = [min(v) if v else 0 for v in ([times[id(k)][0] for k in n.kids.values()], [times[id(k)][1] for k in n.kids.values()])]
    spread_times(top, delayed, times)
    covered = all(times[id(n)][0] <= min(times[id(k)][0] for k in n.kids.values()) for n, _ in nodes if n.id is None and n.kids)
    return True, False, parents, right, parents == right, path == want, covered
