"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table; shards
take turns claiming their next free slot. A row's key is hashed to a slot, so placement is
one array access; adding or losing a shard moves few rows besides that shard's own.
The table has a fixed size (`slots`), so it travels inside the plan.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime well over a hundred times the shards, so shares differ by under a percent.
SLOTS = 4099
SHARDS = 32


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's walk through the slots; the step is coprime to a prime table size."""
    name = shard.encode()
    return zlib.crc32(name) % slots, zlib.crc32(b"step:" + name) % (slots - 1) + 1


def fill(names: tuple[str, ...], slots: int = SLOTS, weights: tuple[int, ...] | None = None) -> np.ndarray:
    """The shard number of each slot. weights: how many slots a shard claims on its turn."""
    if not is_prime(slots) or len(names) != len(set(names)) or not 0 < len(names) <= slots:
        raise ValueError("slots must be prime, and shards distinct and no more than slots")
    table = np.full(slots, -1, np.int32)
    walk = [preference(x, slots) for x in names]
    order = sorted(range(len(names)), key=lambda i: names[i])  # turns don't depend on the order of the list
    step, left = [0] * len(names), slots
    while left:
        for i in order:
            for _ in range(weights[i] if weights else 1):
                while left:
                    slot = (walk[i][0] + step[i] * walk[i][1]) % slots
                    step[i] += 1
                    if table[slot] < 0:
                        table[slot] = i
                        left -= 1
                        break
    return table


@lru_cache(maxsize=16)
def shard_names(shards: int) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(shards))


def key_hash(key: Column) -> Column:
    """A 60-bit hash of the key's text (MD5, so that any SQL engine can recompute it); null keys hash as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def place(df: DataFrame, key_col: str = "doc_id", names: tuple[str, ...] | None = None, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df + slot and shard of each row, without a shuffle.

    Rows with equal keys share a shard, null keys have one too; an empty table gives no rows.
    A column of df with the name of a new one is replaced.
    """
    table = fill(names or shard_names(SHARDS), slots)
    slot = F.pmod(key_hash(F.col(key_col)), F.lit(slots)).cast("int")
    return df.withColumn(slot_col, slot).withColumn(shard_col, F.element_at(F.lit(table.tolist()), F.col(slot_col) + 1))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", names: tuple[str, ...] | None = None, slots: int = SLOTS, files_per_shard: int = 1) -> None:
    """Writes the rows into one folder a shard; a shard's rows may go to several tasks, by their slot.

    Rows with null or equal keys share a folder, repeated rows stay; an empty table writes none. Columns of df
    named __slot or __shard are replaced, the latter becomes the folder's name.
    """
    names = names or shard_names(SHARDS)
    placed = place(df, key_col, names, slots, "__slot", "__shard")
    part = F.pmod(F.col("__slot"), F.lit(files_per_shard))
    placed.repartition(len(names) * files_per_shard, "__shard", part).drop("__slot").write.partitionBy("__shard").parquet(path)
