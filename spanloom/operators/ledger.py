"""Threading of all fragments of a trace at once, on one ledger of levels.

Every fragment with an anchor owns a chain: the levels between its checkpoint and its root. A level has
one occupant, is reserved for a lost parent, or is open; the level above the root is always reserved for
the root's own lost parent. Rules are applied until nothing moves. Collapse: an open level with one
viable claimant takes it. Binding: a fragment without a carrier is put on the chains of one window whose
filters hold its root and its lost parent, with as much of it as hangs together uniquely. Coverage: a
survivor that lost all its children is written wherever it may stand. What is left without a place is
then placed together with everything that may move for it, window by window, as a program of yes-or-no
choices that :mod:`exact` solves to the optimum: as many as possible stand, and what was placed stays placed.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from spanloom.operators.exact import Program, Solution, solve
from spanloom.operators.reconstruct import RUN, Fragments, Link, Span, _chain, by_prefix


class Chain:
    """The levels between an anchor and a fragment's root."""

    __slots__ = ("root", "anchor", "bits", "claims", "at", "why", "held", "guests", "link")

    def __init__(self, link: Link, bits: int):
        self.link, self.root, self.anchor, self.bits = link, link.orphan, link.anchor, bits
        self.claims: dict[int, list[Span]] = defaultdict(list)
        self.at: dict[int, Span] = {}
        self.why: dict[int, str] = {}
        #: Reserved levels with the orphan that needs them; None for the chain's own lost parent.
        self.held: dict[int, Span | None] = {link.orphan.depth - 1: None}
        self.guests: list[tuple[Span, list[Span]]] = []

    def inside(self, depth: int) -> bool:
        return self.anchor.depth < depth < self.root.depth

    def free(self, depth: int) -> bool:
        return self.inside(depth) and depth not in self.at and depth not in self.held

    def clear(self, depth: int) -> None:
        self.at.pop(depth, None)
        self.why.pop(depth, None)


@dataclass
class Option:
    """A place for an item: spans on a chain's levels, the level above that has to be free for a lost parent, ids it explains."""

    chain: Chain
    spans: list[Span]
    above: int | None
    gain: int

    def levels(self) -> list[int]:
        return [s.depth for s in self.spans] + ([] if self.above is None else [self.above])


@dataclass
class Item:
    """What wants a place: ``kind`` is orphan, moved (an orphan that has one), end or thread (an open level)."""

    span: Span
    kind: str
    options: list[Option]


@dataclass
class Stakes:
    """What counts, each more than all of the next: moved orphans placed, demands placed, ends covered, ids explained, early options."""

    moved: int
    demand: int
    cover: int
    unit: int

    @classmethod
    def of(cls, items: list[Item], occupied: int, soles: int) -> Stakes:
        unit = 1 + sum(len(i.options) for i in items)
        cover = unit * (1 + occupied + sum(max((o.gain for o in i.options), default=0) for i in items))
        demand = cover * (1 + soles + len(items))
        return cls(demand * (1 + len(items)), demand, cover, unit)

    def worth(self, item: Item, o: Option, place: int) -> int:
        base = {"thread": 0, "moved": self.moved + self.cover}.get(item.kind, self.demand + self.cover)
        return base + o.gain * self.unit - place


@dataclass
class Problem:
    """A joint placement as a program, and which variable is which option of which item."""

    program: Program
    choice: dict[int, tuple[int, Option]]


class Ledger:
    """All chains of a trace and the moves on them."""

    def __init__(self, f: Fragments):
        self.f = f
        links = by_prefix(f)
        self.loose = [b.orphan for b in links if b.anchor is None]
        self.chains = [Chain(b, (f.by_id[b.via] if b.via else b.orphan).payload.bits) for b in links if b.anchor]
        self.windows: dict[int, list[Chain]] = defaultdict(list)
        for c in self.chains:
            self.windows[c.anchor.id].append(c)
        self.pool: dict[int, dict[int, list[Span]]] = defaultdict(lambda: defaultdict(list))
        self.placed: dict[int, list[tuple[Chain, list[Span]]]] = {}
        self.ends = [s for s in f.spans if s.payload is None and not s.kids]
        for c in self.chains:
            self._claim(c)

    # ---- evidence ----

    def _claim(self, c: Chain) -> None:
        last = c.root.depth - 2
        todo = list(c.anchor.kids)
        todo += [d.root for d in self.windows[c.anchor.id] if d is not c and self.holds(c, d.root.parent)]
        while todo and last > c.anchor.depth:
            s = todo.pop()
            if s is not c.root and s.depth <= last and not s.leaf and self.holds(c, s.id):
                c.claims[s.depth].append(s)
                todo += s.kids

    def holds(self, c: Chain, id_: int) -> bool:
        return self.f.holds(c.bits, id_)

    def fits_path(self, c: Chain, s: Span) -> bool:
        """The filter holds the span and all that can be named above it."""
        return self.holds(c, s.id) and _chain(self.f, c.bits, s, c.anchor.depth + 1)

    def may_stand(self, c: Chain, s: Span) -> bool:
        return s is not c.root and not s.leaf and c.anchor.depth < s.depth < c.root.depth - 1 and self.fits_path(c, s)

    def way_down(self, r: Span, c: Chain, ok) -> list[Span] | None:
        """An orphan's root with the spans below it that the filter singles out, where ``ok`` lets them stand."""
        last = c.root.depth - 2
        if r is c.root or r.depth > last or not ok(r.depth - 1) or not ok(r.depth) or not (self.holds(c, r.parent) and self.holds(c, r.id)):
            return None
        path = [r]
        while True:
            below = [k for k in path[-1].kids if k.depth <= last and ok(k.depth) and self.holds(c, k.id)]
            if len(below) != 1:
                return path
            path.append(below[0])

    # ---- moves ----

    def put(self, c: Chain, s: Span, why: str) -> bool:
        if not c.free(s.depth):
            return False
        c.at[s.depth], c.why[s.depth] = s, why
        return True

    def settle(self, r: Span, fits: list[tuple[Chain, list[Span]]]) -> None:
        """Write an orphan on chains of one window; all its spans become claimants there."""
        pool = self.pool[fits[0][0].anchor.id]
        for c, path in fits:
            c.held[r.depth - 1] = r
            for s in path:
                self.put(c, s, "B")
            c.guests.append((r, path))
        known = {s.id for c, path in fits for s in path}
        for s in self.f.below(r):
            pool[s.depth].append(s)
            known.add(s.id)
        self.placed[r.id] = fits

    def unsettle(self, r: Span) -> list[tuple[Chain, list[Span]]]:
        """Take an orphan out of the ledger again."""
        own = {s.id for s in self.f.below(r)}
        fits = self.placed.pop(r.id)
        for c in self.chains:
            for depth in [d for d, s in c.at.items() if s.id in own]:
                c.clear(depth)
            c.guests = [g for g in c.guests if g[0] is not r]
            for depth in [d for d, owner in c.held.items() if owner is r]:
                other = next((g[0] for g in c.guests if g[0].depth == r.depth), None)
                if other is None:
                    del c.held[depth]
                else:
                    c.held[depth] = other
        for c, _ in fits:
            for depth, spans in self.pool[c.anchor.id].items():
                self.pool[c.anchor.id][depth] = [s for s in spans if s.id not in own]
        return fits

    def collapse(self) -> bool:
        """A level that one claimant only can take is taken."""
        moved = False
        for c in self.chains:
            pool = self.pool[c.anchor.id]
            for depth in range(c.anchor.depth + 1, c.root.depth):
                if not c.free(depth):
                    continue
                near = c.claims.get(depth, [])
                viable = []
                for s in [*near, *(s for s in pool.get(depth, ()) if s not in near)]:
                    root_fits = s.id not in self.placed or c.free(depth - 1) or depth - 1 in c.held
                    if not s.leaf and s is not c.root and root_fits and self.fits_path(c, s):
                        viable.append(s)
                if len(viable) == 1:
                    (s,) = viable
                    if s.id in self.placed:
                        c.held.setdefault(depth - 1, s)
                    moved |= self.put(c, s, "A")
        return moved

    def bind(self, wide: bool) -> bool:
        """Orphans whose fits lie in one window are put there; of several windows the one with most fits, then most spans."""
        moved, again = False, True
        while again:
            again = False
            for r in self.loose:
                if r.id in self.placed:
                    continue
                fits: dict[int, list[tuple[Chain, list[Span]]]] = defaultdict(list)
                for c in self.chains:
                    path = self.way_down(r, c, lambda d, c=c: c.free(d) and (wide or not c.claims.get(d)))
                    if path:
                        fits[c.anchor.id].append((c, path))
                if fits:
                    best = max(fits, key=lambda w: (len(fits[w]), sum(len(p) for _, p in fits[w]), -(w & (1 << 64) - 1)))
                    self.settle(r, fits[best])
                    moved = again = True
        return moved

    def cover(self) -> bool:
        """Survivors that lost all children are written on every chain where they may stand."""
        moved = False
        for e in self.ends:
            for c in self.chains:
                if c.free(e.depth) and (e in c.claims.get(e.depth, ()) or e in self.pool[c.anchor.id].get(e.depth, ())) and self.fits_path(c, e):
                    moved |= self.put(c, e, "C")
        return moved

    def standing(self, s: Span) -> int:
        return sum(c.at.get(s.depth) is s for c in self.chains)

    def guest_of(self, s: Span) -> Span | None:
        """The placed orphan that a span belongs to."""
        while s.parent in self.f.by_id:
            s = self.f.by_id[s.parent]
        return s if s.id in self.placed else None

    # ---- joint placement ----

    def ways(self, r: Span, chains: list[Chain] | None = None) -> list[tuple[Chain, list[Span]]]:
        """The chains that an orphan's evidence allows, whatever stands there, with the spans that would."""
        found = [(c, self.way_down(r, c, lambda d: True)) for c in (self.chains if chains is None else chains) if r.depth > c.anchor.depth + 1]
        return [(c, p) for c, p in found if p]

    def orphan_item(self, r: Span, kind: str, chains: list[Chain] | None = None) -> Item:
        return Item(r, kind, [Option(c, p, r.depth - 1, len(p) + 1) for c, p in self.ways(r, chains)])

    def end_item(self, e: Span, chains: list[Chain] | None = None) -> Item:
        return Item(e, "end", [Option(c, [e], None, 1) for c in (self.chains if chains is None else chains) if self.may_stand(c, e)])

    def occupancy(self, c: Chain, depth: int, moving: set[int]) -> tuple[bool, Span | None, bool, bool]:
        """Of a level: closed to spans; its occupant, whether that stays, and whether it is an end's only place."""
        closed = depth in c.held and (c.held[depth] is None or c.held[depth].id not in moving)
        s = c.at.get(depth)
        if s is None:
            return closed, None, False, False
        if c.why[depth] == "B":
            guest = self.guest_of(s)
            return closed, s, guest is None or guest.id not in moving, False
        return closed, s, False, self.sole(c, depth)

    def sole(self, c: Chain, depth: int) -> bool:
        """Whether a level is the only place of a survivor that lost all its children."""
        s = c.at[depth]
        return c.why[depth] in "CD" and s.payload is None and not s.kids and self.standing(s) <= 1

    def problem(self, items: list[Item]) -> Problem:
        """The joint placement of items as a program: what stands where, who needs which level free, what is displaced."""
        moving = {i.span.id for i in items if i.kind == "moved"}
        levels = {(id(o.chain), d): (o.chain, d) for i in items for o in i.options for d in o.levels()}
        state = {k: self.occupancy(c, d, moving) for k, (c, d) in levels.items()}
        stakes = Stakes.of(items, sum(s[1] is not None for s in state.values()), sum(s[3] for s in state.values()))
        p = Program()
        shown: dict[tuple[tuple[int, int], int], int] = {}
        parent: dict[tuple[int, int], int] = {}
        choice: dict[int, tuple[int, Option]] = {}
        options: list[list[int]] = []
        needs: dict[int, list[int]] = {}
        needed_by: dict[int, list[int]] = defaultdict(list)
        for n, item in enumerate(items):
            own = []
            for place, o in enumerate(item.options):
                cells = [((id(o.chain), s.depth), s) for s in o.spans]
                above = (id(o.chain), o.above) if o.above is not None else None
                if any(state[k][0] or (state[k][2] and state[k][1] is not s) for k, s in cells) or (above and state[above][2]):
                    continue
                x = p.var(stakes.worth(item, o, place))
                needs[x] = []
                for k, s in cells:
                    if (k, s.id) not in shown:
                        shown[k, s.id] = p.var()
                    needs[x].append(shown[k, s.id])
                if above:
                    if above not in parent:
                        parent[above] = p.var()
                    needs[x].append(parent[above])
                for v in needs[x]:
                    needed_by[v].append(x)
                own.append(x)
                choice[x] = n, o
            options.append(own)
        first = {(xs[0], v): xs for v, wanted in needed_by.items() for xs in self._rivals(wanted, choice)}
        for own in options:
            for x in own:
                for v in needs[x]:
                    if (x, v) in first:
                        p.covers(v, first[x, v])
            p.group(own)
        by_level: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for (k, id_), v in shown.items():
            by_level[k].append((id_, v))
        for k, (_, there, _, sole) in state.items():
            lost = [parent[k]] if k in parent else []
            p.at_most_one([v for _, v in by_level[k]] + lost)
            away = [v for id_, v in by_level[k] if there is not None and id_ != there.id] + (lost if there is not None else [])
            if away:
                y = p.var(-(stakes.cover if sole else stakes.unit))
                p.covers(y, away)
        self._alike(items, options, choice, p)
        return Problem(p, choice)

    @staticmethod
    def _rivals(wanted: list[int], choice: dict[int, tuple[int, Option]]) -> list[list[int]]:
        """Options dealt into sets of which at most one holds: of one item, or with different needs of one level."""

        def rivals(a: int, b: int) -> bool:
            (m, o), (n, q) = choice[a], choice[b]
            if m == n:
                return True
            if o.chain is not q.chain:
                return False
            there = {s.depth: s.id for s in o.spans} | ({} if o.above is None else {o.above: None})
            also = {s.depth: s.id for s in q.spans} | ({} if q.above is None else {q.above: None})
            return any(there[d] != also[d] for d in there.keys() & also.keys())

        out: list[list[int]] = []
        for x in wanted:
            held = next((xs for xs in out if all(rivals(x, y) for y in xs)), None)
            if held is None:
                out.append([x])
            else:
                held.append(x)
        return out

    @staticmethod
    def _alike(items: list[Item], options: list[list[int]], choice: dict[int, tuple[int, Option]], p: Program) -> None:
        """Orphans with the same places are told apart by order only: the first takes the earlier place."""
        shared: dict[int, int] = defaultdict(int)
        for i in items:
            for id_ in {s.id for o in i.options for s in o.spans}:
                shared[id_] += 1
        classes: dict[tuple, list[int]] = defaultdict(list)
        for n, item in enumerate(items):
            if item.kind == "orphan" and options[n] and all(shared[s.id] == 1 for o in item.options for s in o.spans):
                classes[tuple((id(choice[x][1].chain), tuple(choice[x][1].levels()), choice[x][1].gain) for x in options[n])].append(n)
        for members in classes.values():
            for a, b in zip(members[:-1], members[1:], strict=True):
                for k, x in enumerate(options[b]):
                    p.one_of([-x, *options[a][: k + 1]])

    def solve(self, items: list[Item]) -> tuple[dict[int, Option], Solution]:
        """The best placement by place in ``items`` (left out items are missing), and what the search says of it."""
        items.sort(key=lambda i: (i.kind == "thread", len(i.options), i.span.key))
        problem = self.problem(items)
        found = solve(problem.program)
        return {n: o for v, (n, o) in problem.choice.items() if v in found.true}, found

    def apply(self, items: list[Item], chosen: dict[int, Option]) -> bool:
        """Write a placement; whether it changed the ledger."""
        before = self.picture()
        for n, item in enumerate(items):
            if item.kind == "moved" and n in chosen:
                self.unsettle(item.span)
            elif item.kind == "end":
                for c in self.chains:
                    if c.at.get(item.span.depth) is item.span and c.why[item.span.depth] in "CD":
                        c.clear(item.span.depth)
        for o in chosen.values():
            for depth in o.levels():
                if o.chain.why.get(depth) in ("A", "C", "D", "T"):
                    o.chain.clear(depth)
        for kinds, why in ((("orphan", "moved"), "B"), (("thread",), "T"), (("end",), "D")):
            for n, o in chosen.items():
                if items[n].kind not in kinds:
                    continue
                if why == "B":
                    self.settle(items[n].span, [(o.chain, o.spans)])
                    continue
                for s in o.spans:
                    if s.id in self.placed and (o.chain.free(s.depth - 1) or s.depth - 1 in o.chain.held):
                        o.chain.held.setdefault(s.depth - 1, s)
                    self.put(o.chain, s, why)
        return before != self.picture()

    def picture(self) -> tuple:
        """What stands and is reserved where."""
        return tuple(
            (tuple(sorted((d, s.id, c.why[d]) for d, s in c.at.items())), tuple(sorted((d, o.id if o else 0) for d, o in c.held.items()))) for c in self.chains
        )

    def rearrange(self, chains: list[Chain]) -> bool:
        """Place more of what has no place in one window, with everything that may move there moving; whether more stand then."""
        open_ = [self.orphan_item(r, "orphan", chains) for r in self.loose if r.id not in self.placed]
        open_ = [i for i in open_ + [self.end_item(e, chains) for e in self.ends if not self.standing(e)] if i.options]
        if not open_:
            return False
        guests = {r.id: r for c in chains for r, _ in c.guests}
        written = {c.at[d].id: c.at[d] for c in chains for d in c.at if c.why[d] in "CD" and c.at[d].payload is None and not c.at[d].kids}
        held = [self.orphan_item(r, "moved", chains) for r in guests.values()] + [self.end_item(e, chains) for e in written.values()]
        items = open_ + [i for i in held if i.options]
        standing = len(items) - len(open_)
        chosen, _ = self.solve(items)
        return len(chosen) > standing and self.apply(items, chosen)

    def run(self) -> None:
        """The rules to their fixpoint, then joint placements as long as they place more."""
        while True:
            moved = self.collapse()
            moved |= self.bind(wide=False)
            moved |= self.cover()
            if moved or self.bind(wide=True):
                continue
            if all(r.id in self.placed for r in self.loose) and all(map(self.standing, self.ends)):
                return
            if not any([self.rearrange(chains) for _, chains in sorted(self.windows.items())]):
                return

    def links(self) -> list[Link]:
        """Every fragment under the deepest occupant above it; orphans on the chain that took most of them."""
        out = []
        for c in self.chains:
            top = next((c.at[d] for d in range(c.root.depth - 1, c.anchor.depth, -1) if d in c.at), c.anchor)
            out.append(Link(c.root, top, c.link.ambiguous, c.link.via))
        for r in self.loose:
            if r.id not in self.placed:
                out.append(Link(r, None))
                continue
            c, _ = max(self.placed[r.id], key=lambda x: len(x[1]))
            top = next((c.at[d] for d in range(r.depth - 1, c.anchor.depth, -1) if d in c.at and c.at[d] is not r), c.anchor)
            out.append(Link(r, top))
        return out


def by_ledger(f: Fragments) -> list[Link]:
    """``ledger``: the chains of all fragments threaded together."""
    ledger = Ledger(f)
    ledger.run()
    return ledger.links()


RUN["ledger"] = by_ledger
