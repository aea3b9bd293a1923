"""Sharding by a permutation-filled lookup table (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

#: A prime; shards hold slots in equal number up to one, so the load differs by at most shards / TABLE_SIZE.
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The shard index at each slot: shards in turn claim the next free slot of their own permutation.

    ``size`` must be a prime above the number of shards. Permutations depend on the shard's name
    alone, so adding or removing one shard moves few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if len(shards) > size or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, and no less than the number of shards")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, at, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for i in order:
            while True:
                slot = (offset[i] + at[i] * skip[i]) % size
                at[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            filled += 1
            if filled == size:
                return np.array(table, np.int32)


def slot_of(id_col, size: int = TABLE_SIZE):
    """The slot of an id, from 60 bits of its MD5 digest; a null id is in slot 0."""
    digest = F.substring(F.md5(id_col.cast("string").cast("binary")), 1, 15)
    return F.coalesce(F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)), F.lit(0)).cast("int")


def shard_names(shards: int | list[str]) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)


def shard(docs: DataFrame, shards: int | list[str] = 64, size: int = TABLE_SIZE, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the column ``shard``: the index of each row's shard.

    A lookup in a broadcast table of fixed size, so there is no shuffle. Rows of one id, repeated
    or not, get one shard; null ids go to the shard of slot 0. Texts, of whatever length, null or
    empty, are not looked at. Other columns stay, whatever their names, but one that is called
    ``shard_col`` (in any case) is replaced; it can't be the id. An empty table stays empty.
    """
    table = lookup_table(shard_names(shards), size)
    kept = docs.drop(*[c for c in docs.columns if c.lower() == shard_col.lower()])
    at, number = fresh_name(kept, "shard_slot"), fresh_name(kept, "shard_number")
    slots = docs.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(table)], f"{at} int, {number} int")
    return kept.join(F.broadcast(slots), slot_of(kept[id_col], size) == slots[at]).select(*[kept[c] for c in kept.columns], slots[number].alias(shard_col))
