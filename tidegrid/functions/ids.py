"""Identifiers derived from content: a digest of canonical JSON (keys sorted, compact)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(**fields: Column) -> Column:
    """Canonical JSON text of the fields, in the order of their names; nulls are kept."""
    return F.to_json(F.struct(*(fields[name].alias(name) for name in sorted(fields))), {"ignoreNullFields": "false"})


def content_id(prefix: str, length: int = 24, **fields: Column) -> Column:
    """``prefix`` and the first ``length`` hexadecimal digits of the SHA-256 of the fields.

    Equal to the digest of Python's compact, key-sorted JSON for ASCII text,
    integers, doubles between 1e-3 and 1e7, lists of these, and maps with sorted keys.
    """
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical(**fields), 256), 1, length))


def driver_id(prefix: str, payload: Mapping[str, Any], length: int = 24) -> str:
    """The same on the driver, for definitions and policies."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return prefix + hashlib.sha256(text.encode()).hexdigest()[:length]


def sorted_map(entries: Column) -> Column:
    """A map from an array of (key, value) structs, in the order of the keys."""
    return F.map_from_entries(F.array_sort(entries))
