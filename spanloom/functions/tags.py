"""Tags of spans (a map, or a list of key and value) and the bytes that they and ancestry records take."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BAGGAGE = "__bag."
# What a serialised filter takes besides its bits, before base64.
FILTER_HEADER = 25


def tag_map(tags: Column) -> Column:
    """A list of ``key, value`` as a map; of a repeated key the first counts."""
    named = F.filter(tags, lambda t: t["key"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda t: t["key"]))
    first = lambda k: F.element_at(F.filter(named, lambda t: t["key"] == k), 1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, first))


def get_tag(tags: Column, key: str) -> Column:
    """The value of a tag; null if there is none."""
    return F.try_element_at(tags, F.lit(key))


def has_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def without_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != key)


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """The tags with one of them set, whether it was there or not."""
    return F.map_concat(without_tag(tags, key), F.create_map(F.lit(key), value.cast("string")))


def baggage_of(tags: Column) -> Column:
    """What travels with a call: tags under the baggage prefix, without it."""
    own = F.map_filter(tags, lambda k, _: F.startswith(k, F.lit(BAGGAGE)))
    return F.transform_keys(own, lambda k, _: F.substr(k, F.lit(len(BAGGAGE) + 1)))


def tag_bytes(tags: Column) -> Column:
    """UTF-8 bytes of all keys and values."""
    size = lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0))
    return F.coalesce(F.aggregate(F.map_entries(tags), F.lit(0), size), F.lit(0))


def display_name(*names: Column) -> Column:
    """The first name that is there and not empty, else an empty one."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit(""))


def base64_bytes(n: Column) -> Column:
    """Characters of ``n`` bytes in base64."""
    return (F.ceil(n / 3) * 4).cast("long")


def filter_text_bytes(members: int, p: float = 0.01) -> int:
    """Characters of a serialised filter of ``members`` at rate ``p`` in base64: its bytes and a header; none for no member."""
    if members <= 0:
        return 0
    bits = math.ceil(-members * math.log(p) / math.log(2) ** 2)
    return math.ceil((-(-bits // 8) + FILTER_HEADER) * 4 / 3)
