"""What a Python worker holds while its partition grows: bounded by a run of whole groups, in the step that each query hands to it."""

import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import handlers, reconstruct, windows
from spanloom.operators.handlers import Scheme
from spanloom.plans import tree
from spanloom.plans.traces import CHUNK, _cut
from spanloom.queries import collisions, recon

SPANS = 66


def heaps(n: int) -> pa.Table:
    """``n`` heap-shaped traces with wide ids."""
    draw = np.random.default_rng(11)
    ids = draw.integers(1, 1 << 62, n * SPANS)
    at = np.tile(np.arange(SPANS), n)
    parent = np.where(at == 0, 0, ids[np.arange(n * SPANS) - at + (at - 1) // 2])
    return pa.table({"trace_id": np.repeat(np.arange(n), SPANS), "span_id": ids, "parent_id": parent, "start_us": draw.integers(0, 1 << 40, n * SPANS)})


def survivors(n: int, s: Scheme) -> pa.Table:
    """What :func:`reconstruct.links` reads, half of the spans without a payload lost."""
    rows = handlers._simple(heaps(n), s)
    lost = ~rows.column("carrier").to_numpy() & (np.random.default_rng(5).random(len(rows)) < 0.5)
    return rows.filter(pa.array(~lost)).select(["trace_id", "span_id", "parent_id", "depth", "br"])


def handed(monkeypatch, module, call):
    """The function that ``call`` hands to the workers, and its key."""
    got = []
    monkeypatch.setattr(module, "map_traces", lambda df, fn, schema, key="trace_id": got.append((fn, key)))
    call(MagicMock())
    return got[0]


def peak(run, rows: pa.Table, key: str) -> int:
    """Most bytes that Python and numpy hold over a partition of ``rows``, which come in Spark's batches."""
    tracemalloc.start()
    for part in _cut(iter(rows.combine_chunks().to_batches(max_chunksize=10_000)), key, CHUNK):
        run(part.combine_chunks())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def grows(run, rows_of, key: str) -> float:
    """The worker's peak over a partition of about 75,000 rows as a multiple of that over 25,000."""
    few, many = rows_of(450), rows_of(1350)
    assert len(few) > 20_000
    return peak(run, many, key) / peak(run, few, key)


ENGINES = {
    "ledger_links": ("ledger", Scheme(cpd=recon.CPD, fp=recon.RARE, prime=True)),
    "cgprb_topology": ("cgprb", Scheme(cpd=recon.CPD, fp=1e-2)),
    "topology_totals": ("cgp", Scheme(cpd=recon.CPD, fp=1e-2)),
    "pb2_collisions": ("pb2", Scheme(cpd=collisions.CPD, fp=collisions.RATE)),
    "recon_evidence": ("pcrb", Scheme(cpd=recon.CPD)),
}


@pytest.mark.parametrize("query", ENGINES)
def test_an_engine_holds_no_more_of_a_larger_partition(monkeypatch, spark, query):
    engine, s = ENGINES[query]
    run, key = handed(monkeypatch, reconstruct, lambda df: reconstruct.links(df, engine, s))
    named = Scheme(**{**s.__dict__, "name": reconstruct.ENGINES[engine]}).settled()
    assert grows(run, lambda n: survivors(n, named), key) < 1.5


def windowed_heaps(n: int, cpd: int) -> pa.Table:
    """What :func:`windows.payloads` hands to the workers: the rows of every window together, non-root checkpoints in two."""
    rows = heaps(n)
    trace, span, parent, start = (rows.column(c).to_numpy() for c in ("trace_id", "span_id", "parent_id", "start_us"))
    at = np.tile(np.arange(1, SPANS + 1), n)
    depth = np.floor(np.log2(at)).astype(np.int64)
    top = np.arange(n * SPANS) - at + (at >> np.where(depth > 0, (depth - 1) % cpd + 1, 0))
    own, head = np.flatnonzero(depth > 0), np.flatnonzero(depth % cpd == 0)
    row, window = np.concatenate([head, own]), np.concatenate([head, top[own]])
    by = np.argsort(window, kind="stable")
    row, window, is_head = row[by], window[by], (np.arange(len(row)) < len(head))[by]
    return pa.table({
        "key": window, "trace_id": trace[row], "window": span[window], "head": is_head, "span_id": span[row], "parent_id": parent[row],
        "start_us": start[row], "depth": depth[row].astype(np.int32), "is_leaf": 2 * at[row] > SPANS,
    })


@pytest.mark.parametrize("scheme", ("pcr", "cgprb"))
def test_windows_hold_no_more_of_a_larger_partition(monkeypatch, spark, scheme):
    s = Scheme(scheme, recon.CPD)
    for name in ("with_tree", "materialize", "windowed"):
        monkeypatch.setattr(windows, name, lambda df, *_: df)
    run, key = handed(monkeypatch, windows, lambda df: windows.payloads(df, s))
    assert grows(run, lambda n: windowed_heaps(n, s.cpd), key) < 1.5


def test_paths_hold_no_more_of_a_larger_partition(monkeypatch, spark):
    run, key = handed(monkeypatch, tree, tree.ancestors)
    assert grows(run, lambda n: heaps(n).rename_columns(["trace_id", "span_id", "_to", "start_us"]), key) < 1.5
