"""What the query modules share: the entry type and common table expressions of the SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from spanloom.sources.views import HEAP_SQL, WIDE_SQL


class Entry(NamedTuple):
    """A query and, where SQL can express it, its DuckDB counterpart."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


START = f"WITH RECURSIVE {HEAP_SQL}"
WIDE = f"WITH RECURSIVE {WIDE_SQL}"
DEEP = """, deep AS (
  SELECT *, 0 AS depth, span_id AS root_id FROM spans WHERE parent_id = 0
  UNION ALL
  SELECT s.*, d.depth + 1, d.root_id FROM spans s JOIN deep d ON s.trace_id = d.trace_id AND s.parent_id = d.span_id
)"""
KINDS = (
    DEEP
    + """, kinds AS (
  SELECT d.*, k.parent_id IS NULL AS leaf, k.parent_id IS NULL OR d.depth % 3 = 0 AS carrier,
    ((((d.trace_id % 100003) * 7919 + (d.span_id % 100003) * 104729 + 42 * 1299709) * 48271) % 2147483647 % 10000) / 10000 AS u
  FROM deep d LEFT JOIN (SELECT DISTINCT trace_id, parent_id FROM spans) k ON k.trace_id = d.trace_id AND k.parent_id = d.span_id
), drops AS (SELECT *, NOT carrier AND u < 0.5 AS dropped FROM kinds)"""
)
ANCHORS = """, walk AS (
  SELECT o.trace_id, o.span_id, o.depth, p.span_id AS here, p.dropped AS lost, p.parent_id AS up, p.depth AS at_depth
  FROM drops o JOIN drops p ON p.trace_id = o.trace_id AND p.span_id = o.parent_id
  WHERE NOT o.dropped AND p.dropped
  UNION ALL
  SELECT w.trace_id, w.span_id, w.depth, p.span_id, p.dropped, p.parent_id, p.depth
  FROM walk w JOIN drops p ON p.trace_id = w.trace_id AND p.span_id = w.up WHERE w.lost
), anchors AS (
  SELECT trace_id, span_id, depth, here AS anchor_id, depth - at_depth - 1 AS gap FROM walk WHERE NOT lost
)"""
EVENTS = """, e AS (SELECT trace_id, span_id, parent_id, service, depth, 0 AS kind, start_us AS ts FROM deep UNION ALL
  SELECT trace_id, span_id, parent_id, service, depth, 1, end_us FROM deep
), pos AS (SELECT *, row_number() OVER (PARTITION BY trace_id
  ORDER BY ts, kind, CASE WHEN kind = 0 THEN depth ELSE -depth END, span_id) AS pos FROM e)"""
