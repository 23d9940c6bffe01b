"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: from two hashes of its
name, ``(offset + k * skip) mod size`` visits every slot once. Shards take turns and claim the first slot of
their order that is free, until none is. Every shard then holds ``size / shards`` slots to within one, and a
shard that goes gives up little more than its own slots. The table has one number a slot, so its size is a
bound that the caller states; it is made on the driver and broadcast, and a row is placed by one lookup.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import free_name

#: Default table: a prime about 64 times the default number of shards.
SIZE, SHARDS = 65_537, 1024
#: Slots at most: the table is broadcast, 16 bytes a slot.
MOST = 1 << 20


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The number of the shard, in ``shards``, that holds each slot. Names differ and are not more than slots."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards need different names, one at least and no more than slots")
    if not _prime(size) or size > MOST:
        raise ValueError(f"the table needs a prime size up to {MOST}: {size}")
    n = len(shards)
    at = np.array([xxhash.xxh64_intdigest(s, seed=1) % size for s in shards])
    skip = np.array([xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 if size > 2 else 1 for s in shards])
    at, skip = at.tolist(), skip.tolist()
    table, filled = [-1] * size, 0
    while True:
        for k in range(n):
            c = at[k]
            while table[c] >= 0:
                c = (c + skip[k]) % size
            table[c] = k
            at[k] = (c + skip[k]) % size
            filled += 1
            if filled == size:
                return np.array(table, np.int32)


def slot(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with the columns slot int and shard string (columns of these names are replaced).

    Equal keys share a shard; a null key has a slot like any other. For a key that many rows share, place rows by a
    key that tells them apart. An empty table stays empty.
    """
    table = lookup_table(shards, size)
    spark = df.sparkSession
    at, name = free_name("_slot", df.columns), free_name("_shard", df.columns)
    slots = spark.createDataFrame([(k, shards[s]) for k, s in enumerate(table.tolist())], f"`{at}` int, `{name}` string")
    placed = df.withColumn("slot", slot(F.col(key), size)).drop("shard")
    return placed.join(F.broadcast(slots), placed["slot"] == slots[at], "left").drop(at).withColumnRenamed(name, "shard")


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """One folder a shard under ``path`` with up to ``files`` files, so a large shard is no single task's work."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    name = free_name("_salt", placed.columns)
    placed.withColumn(name, salt).repartition("shard", name).drop(name).write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """(doc_id, n_bytes, slot, shard) for every row of ``docs(doc_id, text, ...)``, by doc_id; null text has 0 bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(rows, "doc_id", [f"shard-{k:05d}" for k in range(shards)], size)
