"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a table of prime size in an order of its own, and the shards take turns
claiming their next free slot until the table is full. So each shard holds as many slots as any other, give or
take one, and adding or removing a shard moves few slots of the others. A row is placed by one hash and one look
into the table, which is broadcast; its size depends on `table_size` alone. No row is shuffled, so equal or hot
keys cannot meet in one task.

Defined results: a null key is placed by the row's `fallback` columns, so such rows spread too; equal keys share a
shard; empty tables give empty results; all columns are kept, and the added ones get fresh names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally.llm.tables import fresh_name

TABLE_SIZE = 65_537
N_SHARDS = 64


def is_prime(number: int) -> bool:
    return number > 1 and all(number % d for d in range(2, int(number**0.5) + 1))


def shard_names(count: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def lookup_table(shards: list[str], table_size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot, the index of the shard that owns it."""
    if not is_prime(table_size):
        raise ValueError("the table size must be prime")
    if not 0 < len(set(shards)) == len(shards) <= table_size:
        raise ValueError("shard names must be distinct, at least one, and no more than slots")
    preferences = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        offset = int.from_bytes(digest[:8], "big") % table_size
        skip = int.from_bytes(digest[8:16], "big") % (table_size - 1) + 1
        preferences.append(((offset + skip * np.arange(table_size)) % table_size).tolist())
    owner = np.full(table_size, -1, dtype=np.int32)
    turn = [0] * len(shards)
    free = table_size
    while free:
        for shard, preferred in enumerate(preferences):
            while owner[preferred[turn[shard]]] >= 0:
                turn[shard] += 1
            owner[preferred[turn[shard]]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: str, fallback: list[str], table_size: int) -> Column:
    hashed = F.when(F.col(key).isNull(), F.xxhash64(*fallback)).otherwise(F.xxhash64(key)) if fallback else F.xxhash64(key)
    return F.pmod(hashed, F.lit(table_size)).cast("int")


def _slots(spark: SparkSession, shards: list[str], table_size: int, slot: str, shard: str) -> DataFrame:
    owner = lookup_table(shards, table_size)
    rows = pd.DataFrame({slot: np.arange(table_size, dtype=np.int32), shard: np.array(shards, dtype=object)[owner]})
    return spark.createDataFrame(rows, f"`{slot}` INT, `{shard}` STRING")


def sharded(
    docs: DataFrame, key: str = "doc_id", fallback: tuple[str, ...] = ("text",), shards: list[str] | None = None,
    table_size: int = TABLE_SIZE,
) -> DataFrame:
    """The rows with their `slot` and `shard`."""
    slot, shard = fresh_name(docs.columns, "slot"), fresh_name(docs.columns, "shard")
    slots = _slots(docs.sparkSession, shards or shard_names(N_SHARDS), table_size, slot, shard)
    placed = docs.withColumn(slot, slot_of(key, list(fallback), table_size))
    return placed.join(F.broadcast(slots), slot).select(*docs.columns, slot, shard)


def write_shards(rows: DataFrame, path: str, shard: str = "shard", max_rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; tasks write their rows without a shuffle, so a large shard is many files."""
    rows.write.option("maxRecordsPerFile", max_rows_per_file).partitionBy(shard).parquet(path)
