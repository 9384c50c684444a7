"""Placements of clusters as a table, and independent certificates of what the engines made of them.

A cluster is dumped as one row: its program as text (weights, rows, groups) and the variables that the
engine set. The rows are dealt over all tasks, whatever trace they come from; each one is then judged
by itself: the claim is held against the rows, bounded from above by a Lagrangian relaxation, and solved
again, with a proof that is replayed. ``gap`` is what the claim may lack at most.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.exact import Program, relax, solve, verified
from spanloom.operators.handlers import Scheme
from spanloom.operators.ledger import Ledger
from spanloom.operators.map_engine import MapLedger
from spanloom.operators.reconstruct import ENGINES, _survivors
from spanloom.plans.traces import map_traces
from spanloom.session import ship

DUMP = "trace_id bigint, cluster int, items int, options int, program string, claim string, capped boolean"
CERTIFICATES = "trace_id bigint, cluster int, items int, options int, allowed boolean, score string, bound string, gap string, best boolean, checked boolean, capped boolean"


def text_of(p: Program) -> str:
    """A program as one line of JSON."""
    return json.dumps({"weights": p.weights[1:], "rows": p.rows, "groups": p.groups}, separators=(",", ":"))


def program_of(text: str) -> Program:
    """The program of :func:`text_of`."""
    held = json.loads(text)
    return Program([0, *held["weights"]], [([tuple(t) for t in terms], least) for terms, least in held["rows"]], [(r, g) for r, g in held["groups"]])


class _Recorded:
    """Keeps every joint placement that a ledger solves."""

    def __init__(self, ledger: Ledger):
        self.lines: list[tuple] = []
        self.plain = ledger.solve
        ledger.solve = self.solve

    def solve(self, items):
        chosen, found = self.plain(items)
        self.lines.append((len(items), sum(len(i.options) for i in items), found))
        return chosen, found


def clusters(survivors: DataFrame, engine: str, scheme: Scheme) -> DataFrame:
    """``DUMP``: every cluster that ``ledger`` or ``map`` solved, in the order of solving, with what it made of it."""
    s = Scheme(**{**scheme.__dict__, "name": ENGINES[engine]}).settled()
    names = [c.split()[0] for c in DUMP.split(", ")]
    kind = {"ledger": Ledger, "map": MapLedger}[engine]

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for trace, f in _survivors(rows, s):
            book = kind(f)
            programs: list[Program] = []
            plain = book.problem
            book.problem = lambda items, plain=plain, programs=programs: programs.append(plain(items)) or programs[-1]
            kept = _Recorded(book)
            book.run()
            for n, ((items, options, found), held) in enumerate(zip(kept.lines, programs, strict=True)):
                claim = json.dumps(sorted(found.true), separators=(",", ":"))
                out.append((trace, n, items, options, text_of(held.program), claim, not found.proved))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

    return map_traces(survivors.select("trace_id", "span_id", "parent_id", "depth", "br"), run, DUMP)


def certify(dump: DataFrame) -> DataFrame:
    """``CERTIFICATES`` of dumped clusters: ``best`` if nothing better exists, ``checked`` if a replayed proof says so."""
    ship(dump.sparkSession)
    names = [c.split()[0] for c in CERTIFICATES.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                p, true = program_of(r["program"]), set(json.loads(r["claim"]))
                score = p.value(true)
                found = solve(p)
                bound = found.value if found.proved else relax(p, score)[1]  # a proven value is the least bound there is
                line = (p.allows(true), str(score), str(bound), str(bound - score), found.proved and found.value == score, verified(p, found), r["capped"])
                out.append((r["trace_id"], r["cluster"], r["items"], r["options"], *line))
            kinds = [pa.int64(), *[pa.int32()] * 3, pa.bool_(), *[pa.string()] * 3, *[pa.bool_()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 11, kinds, strict=True)], names=names)

    dealt = dump.repartition(F.xxhash64("trace_id", "cluster"))  # a giant trace's clusters are many tasks' work
    return dealt.mapInArrow(run, CERTIFICATES)
