"""Rules for keys, fields, links and values, for single values and as expressions over columns."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidError
from .vectors import check_vector

MAX_KEY, MAX_TYPE, MAX_FIELDS = 1_024, 200, 1_999
TABLE = re.compile(r"[a-z][a-z0-9_]{0,62}")
FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
#: Names that fields cannot have.
RESERVED = frozenset(("key", "rowid", "oid", "_rowid_"))


def check_table(name: str) -> str:
    if not TABLE.fullmatch(name) or name.startswith(("hc_", "sqlite_")):
        raise InvalidError(f"{name!r} is not a table name")
    return name


def table_of(key: str) -> str:
    """The table a key names; the key must be valid."""
    table, colon, rest = key.partition(":")
    if not colon or not rest or "\0" in key or len(key.encode()) > MAX_KEY:
        raise InvalidError(f"{key!r} is not a key")
    return check_table(table)


def valid_key(key: Column) -> Column:
    """The same rule over a column."""
    shape = key.rlike(r"(?s)\A[a-z][a-z0-9_]{0,62}:[^\x00]+\z")
    return F.coalesce(shape & (F.octet_length(key) <= MAX_KEY) & ~key.startswith("hc_") & ~key.startswith("sqlite_"), F.lit(False))


def valid_rest(table: str, rest: Column) -> Column:
    """The same rule over what follows "<table>:" in keys of a table whose name was checked."""
    return F.coalesce((F.octet_length(rest) > 0) & (F.octet_length(rest) < MAX_KEY - len(table)) & ~F.contains(rest, F.lit("\0")), F.lit(False))


def check_fields(fields: Mapping[str, Any]) -> dict[str, Any]:
    """Field names and values made storable; two spellings of one name are refused."""
    seen: set[str] = set()
    out = {}
    for name, value in fields.items():
        if not FIELD.fullmatch(name) or name.lower() in RESERVED:
            raise InvalidError(f"{name!r} is not a field name")
        if name.lower() in seen:
            raise InvalidError(f"{name!r} is given in two spellings")
        seen.add(name.lower())
        out[name] = check_vector(value) if name.lower() == "vec" and value is not None else storable(value)
    return out


def storable(value: Any) -> Any:
    """bool to 1 or 0, times to RFC 3339 text in UTC, lists and mappings to JSON text; reals must be finite."""
    if value is None or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise InvalidError("an integer must fit 64 bits")
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise InvalidError("a real must be finite")
        return value
    if isinstance(value, dt.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return value.astimezone(dt.timezone.utc).isoformat().replace("+00:00", "Z")
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, (list, tuple, Mapping)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=isinstance(value, Mapping), allow_nan=False)
    raise InvalidError(f"a {type(value).__name__} cannot be stored")


def check_type(type_: str) -> str:
    if not 1 <= len(type_) <= MAX_TYPE or "\0" in type_:
        raise InvalidError(f"a link type has 1 to {MAX_TYPE} characters")
    return type_
