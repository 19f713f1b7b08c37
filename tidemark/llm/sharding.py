"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order of the slots of a prime-sized table, an arithmetic
progression (offset + j * skip) modulo the size. Shards take turns claiming their next free
slot until the table is full, so slot counts differ by at most one, and adding or removing
a shard moves few keys that did not belong to it. A key's slot is its hash modulo the size.

The table is built once on the driver; its size is fixed by ``table_size`` whatever the
number of rows, so broadcasting it is safe. The rows pass one broadcast hash join and no
shuffle. The main path is DataFrame functions only.

Defined cases: a null key counts as the empty string; equal keys share a shard; columns
named slot or shard are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

TABLE_SIZE = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, skip) of a shard's preference order; skip and a prime size share no factor."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the table size must be a prime, not less than the number of shards")
    orders = [preference(s, size) for s in shards]
    at = [0] * len(shards)
    table = [-1] * size
    free = size
    while True:
        for k, (offset, skip) in enumerate(orders):
            while table[slot := (offset + at[k] * skip) % size] >= 0:
                at[k] += 1
            table[slot] = k
            at[k] += 1
            free -= 1
            if not free:
                return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def place(docs: DataFrame, *, key: str = "doc_id", shards: list[str] | None = None, table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with slot (bigint) and shard (int, index into ``shards``)."""
    table = lookup_table(shards or shard_names(SHARDS), table_size)
    cells = F.posexplode(F.split(F.lit(",".join(map(str, table))), ","))
    slots = docs.sparkSession.range(1, numPartitions=1).select(cells.alias("_slot", "_shard")).select(F.col("_slot").cast("bigint").alias("slot"), F.col("_shard").cast("int").alias("shard"))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % table_size
    return without(docs, "slot", "shard").withColumn("slot", slot).join(F.broadcast(slots), "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    placed.drop("slot").write.partitionBy("shard").parquet(path)
