"""Consistent sharding by a permutation-filled lookup table, with DataFrame functions only.

The table has a prime number of slots.  Every shard prefers the slots in an order of its own: a start and a step, both
hashed from its name, walk through all slots of a prime-sized table.  Shards take turns; at its turn each claims the
next slot of its order that is free, until the table is full.  Shards so get the same number of slots to within one,
and when a shard goes most other slots keep their owner.  The table has a fixed size and is broadcast; a row is placed
by one lookup of its key's hash, without a shuffle.

Defined results
* null keys hash like the empty string and are placed; repeated keys go to the same shard
* an empty table gives an empty result; no shard is an error
* keys of any length are hashed whole; only the key column is read, others may have any name; the result has the key under
  its own name
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime over a hundred times larger than the number of shards keeps shares even.
SLOTS = 65_537


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Where a shard's order of slots starts, and its step."""
    h = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number that owns each slot.  The order of ``shards`` doesn't matter but for the numbers."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, and at least one")
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    orders = [preference(s, slots) for s in shards]
    owner, tried, left = [-1] * slots, [0] * len(shards), slots
    while left:
        for i in turns:
            if not left:
                break
            start, step = orders[i]
            while owner[at := (start + tried[i] * step) % slots] >= 0:
                tried[i] += 1
            owner[at] = i
            left -= 1
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a DataFrame that is made from a literal."""
    owners = ",".join(map(str, fill(shards, slots)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "o")).select("slot", F.element_at(names, F.col("o").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for every row."""
    at = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    dealt = rows.select(F.col(key).alias("k"), at.alias("at"))
    return dealt.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), F.col("at") == F.col("slot")).select(F.col("k").alias(key), "slot", "shard")
