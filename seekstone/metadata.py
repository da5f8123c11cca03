"""Metadata as ``map<string,string>`` of canonical JSON scalars, so that equality of values is equality of text.

Numbers that are equal have the same text (``1``, ``1.0`` and ``true`` are ``1``); text is quoted, so ``"1"`` isn't ``1``; a
present null is ``null`` and differs from an absent key.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, functions as F


def canonical(value: Any) -> str:
    if isinstance(value, bool):
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def encode(metadata: dict[str, Any] | None) -> dict[str, str]:
    return {str(k): canonical(v) for k, v in (metadata or {}).items()}


def decode(metadata: dict[str, str] | None) -> dict[str, Any]:
    return {k: None if v is None else json.loads(v) for k, v in (metadata or {}).items()}


def matches(wanted: dict[str, str], own: Column, inherited: Column) -> Column:
    """All of ``wanted`` (canonical texts) hold; a key the chunk lacks is looked up in its document; missing: false."""
    result = F.lit(True)
    for key, value in wanted.items():
        has = F.coalesce(F.map_contains_key(own, key), F.lit(False))
        found = F.when(has, F.element_at(own, F.lit(key))).otherwise(F.element_at(inherited, F.lit(key)))
        result = result & F.coalesce(found == F.lit(value), F.lit(False))
    return result


def matches_each(wanted: Column, own: Column, inherited: Column) -> Column:
    """The same where every row has its own ``wanted``, a map; a null value of it matches nothing."""

    def holds(entry: Column) -> Column:
        has = F.coalesce(F.map_contains_key(own, entry["key"]), F.lit(False))
        found = F.when(has, F.element_at(own, entry["key"])).otherwise(F.element_at(inherited, entry["key"]))
        return F.coalesce(found == entry["value"], F.lit(False))

    return F.forall(F.map_entries(wanted), holds)
