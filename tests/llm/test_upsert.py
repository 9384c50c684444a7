"""The merged files against a plain replay of the contract."""

from __future__ import annotations

import bisect
import glob
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.llm import upsert

SF = "/root/testdata/sf0.01"
COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def crc(x):
    return zlib.crc32(str(x).encode())


def replay(clients, changes, files=1500):
    """Rows of every file after the merge, and whether it was rewritten."""
    m = 1 + len(clients) // files
    rows = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[i : i + m] for i in range(0, len(rows), m)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    low = lambda x: -math.inf if x is None else x
    for c in changes:
        if c["client_id"] is not None:
            key = (low(c["seq"]), low(c["change_id"]))
            if c["client_id"] not in best or key > best[c["client_id"]][0]:
                best[c["client_id"]] = key, c
    todo = [{} for _ in files]
    for id_, (_, c) in best.items():
        todo[max(0, bisect.bisect_right(firsts, id_) - 1)][id_] = c
    out = []
    for first, old, winners in zip(firsts, files, todo, strict=True):
        h = crc(first) % 10
        new = [dict(r) for r in old]
        if h <= 7:
            for id_, c in sorted(winners.items()):
                there = [r for r in new if r["client_id"] == id_]
                if c["op"] == "D" or (c["change_id"] is not None and crc(c["change_id"]) % 8 < h):
                    new = [r for r in new if r["client_id"] != id_]
                    continue
                if not there:
                    there = [dict.fromkeys(COLUMNS)]
                    there[0]["client_id"] = id_
                    new += there
                for r in there:
                    r.update({k: c[k] for k in ("source", "segment", "city", "balance")})
            new.sort(key=lambda r: r["client_id"])
        if new == old:
            out.append((old, False))
            continue
        n = -(-len(new) // m)
        at = 0
        for i in range(n):
            size = len(new) // n + (i < len(new) % n)
            out.append((new[at : at + size], True))
            at += size
    merged = []
    for rows, rewritten in out:
        if merged and rewritten and merged[-1][1] and len(merged[-1][0]) + len(rows) <= m:
            merged[-1] = merged[-1][0] + rows, True
        else:
            merged.append((rows, rewritten))
    return merged


def digest(rows, rewritten):
    cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows if r["balance"] is not None)
    crcs = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows)
    ids = hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest()
    return rows[0]["client_id"], len(rows), cents, crcs, ids, ",".join(COLUMNS), rewritten


def check(spark, sf):
    clients = pq.read_table(f"{sf}/clients.parquet").to_pylist()
    changes = pq.read_table(f"{sf}/client_changes.parquet").to_pylist()
    rows = upsert.op12_upsert(spark, sf).collect()
    got = Counter((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in rows)
    want = replay(clients, changes)
    assert got == Counter(digest(*x) for x in want)
    if rows:
        folder = rows[0].path.rsplit("/", 1)[0]
        assert sorted(glob.glob(f"{folder}/*.parquet")) == sorted(r.path for r in rows)
        by_path = {r.path: r for r in rows}
        held = {r["client_id"]: r for x, _ in want for r in x}
        for p, r in by_path.items():
            own = pq.ParquetFile(p).read().to_pylist()
            assert len(own) == r.n_rows and all(held[x["client_id"]] == x for x in own)
    return rows, want


def test_query_equals_replay(spark):
    rows, want = check(spark, SF)
    assert any(r.rewritten for r in rows) and not all(r.rewritten for r in rows)


@pytest.fixture
def made(tmp_path):
    """Tables of other shapes: many new ids behind the last file, files that lose all rows, nulls everywhere."""

    def write(clients, changes):
        source = pq.read_table(f"{SF}/clients.parquet").schema
        pq.write_table(pa.Table.from_pylist(clients, source), f"{tmp_path}/clients.parquet")
        pq.write_table(pa.Table.from_pylist(changes, pq.read_table(f"{SF}/client_changes.parquet").schema), f"{tmp_path}/client_changes.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("seed", [0, 1])
def test_new_ids_deletions_and_nulls(spark, made, monkeypatch, seed):
    monkeypatch.setattr(upsert, "SLICE", 7)
    monkeypatch.setattr(upsert, "FILES", 40)
    draw = np.random.default_rng(seed)
    base = pq.read_table(f"{SF}/clients.parquet").to_pylist()[:400]
    clients = [{**r, "balance": None if i % 9 == 0 else r["balance"], "city": None if i % 5 == 0 else r["city"]} for i, r in enumerate(base)]
    changes = []
    for i in range(900):
        wipe = 150 <= i < 320
        id_ = i if wipe else int(draw.integers(-30, 420)) if i % 3 else int(draw.integers(5000, 5400))
        changes.append({"change_id": None if i % 50 == 0 else i, "client_id": None if i % 97 == 0 else id_, "seq": 99 if wipe else None if i % 31 == 0 else int(draw.integers(0, 4)), "op": None if i % 41 == 0 else "D" if wipe or i % 7 == 0 else "U",
                        "source": None if i % 11 == 0 else "web", "segment": "x", "city": None, "balance": None if i % 6 == 0 else float(i)})
    # a change that sets what is there already rewrites nothing
    changes += [{"change_id": 10_000 + i, "client_id": r["client_id"], "seq": 100, "op": "U", **{k: r[k] for k in ("source", "segment", "city", "balance")}} for i, r in enumerate(clients[330:400])]

    sf = made(clients, changes)
    rows = upsert.op12_upsert(spark, sf).collect()
    want = replay(clients, changes, 40)
    got = Counter((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in rows)
    assert got == Counter(digest(*x) for x in want)
    assert max(len(x) for x, _ in want) == 1 + len(clients) // 40


def test_no_rows_and_no_changes(spark, made):
    clients = pq.read_table(f"{SF}/clients.parquet").to_pylist()[:60]
    assert check(spark, made([], [{"change_id": 1, "client_id": 5, "seq": 1, "op": "U"}]))[0] == []
    rows, _ = check(spark, made(clients, []))
    assert rows and not any(r.rewritten for r in rows)


def test_rows_that_repeat_a_key_stay_together(spark, tmp_path):
    rows = [(i // 3, f"v{i}", float(i)) for i in range(30)]
    t = spark.createDataFrame(rows, "k long, v string, w double")
    path = str(tmp_path / "t")
    files = upsert.write_sorted(t, path, "k", 12)
    assert [(f[1], f[2]) for f in files] == [(0, 12), (4, 12), (8, 6)]
    from pyspark.sql import functions as F

    changes = spark.createDataFrame([(5, 1, "new"), (5, 2, "newer"), (9, 1, None), (4, 1, "gone")], "k long, n long, v string")
    found = upsert.upsert(files, path, changes, "k", ["n"], ["v"], 12, F.lit(False), F.col("v") == "gone")
    left = spark.read.parquet(*[r.path for r in found.collect()])
    want = Counter((k, "newer" if k == 5 else None if k == 9 else v, w) for k, v, w in rows if k != 4)
    assert Counter(map(tuple, left.collect())) == want
    assert upsert.cut_sizes(10, 4) == [4, 3, 3] and upsert.cut_sizes(1, 5) == [1]
