"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in the order offset, offset + skip, offset + 2 skip, ...
(mod the size). Shards take turns; in its turn a shard claims the first slot of its order that is still free,
until none is. So shards hold equal numbers of slots, within one, and adding or removing a shard moves
little besides its own share. The table is broadcast (its size is a parameter with a bound, whatever the
input) and a row is placed by hash modulo size: one lookup, no shuffle.

Defined results: a null key is placed as the text "null"; equal keys share a shard; columns of the input are kept,
and if they clash with the added names the added ones get a trailing underscore.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SHARDS, SLOTS = 32, 4093
#: The largest table that is broadcast: about 16 MB.
MAX_SLOTS = 1 << 20


def digest60(text: str) -> int:
    """The first 60 bits of an MD5, as ``key_hash`` computes on columns."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """For each slot the index of the shard that claims it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not len(shards) <= slots <= MAX_SLOTS or slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [digest60(f"{s}/offset") % slots for s in shards]
    skip = [digest60(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + skip[s]) % slots
        owner[at[s]] = s
    return owner


def assign_shards(df: DataFrame, key: str, *, shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot (int) and shard (int, index into ``shards``)."""
    names = shards if shards is not None else [f"shard-{i}" for i in range(SHARDS)]
    slot, shard = fresh(df, "slot", "shard")
    table = df.sparkSession.createDataFrame(list(enumerate(lookup_table(names, slots))), f"{slot} int, {shard} int")
    placed = df.withColumn(slot, F.pmod(key_hash(F.col(key)), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(table), slot).select(*df.columns, slot, shard)
