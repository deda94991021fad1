"""Sharding by a permutation-filled lookup table: constant-time placement that moves little when shards change."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slots of the table: a prime well above 100 x the number of shards keeps shares within 1 % of each other.
SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot.

    Each shard prefers slots in the order (offset + j x step) mod ``slots``, a permutation since ``slots`` is prime;
    shards take turns, each claiming the first slot it prefers that is free. A plan of fixed size, made from the
    shards' names alone: no row of data is looked at.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots is a prime not below the number of shards")
    at = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    step = [zlib.crc32(f"step:{s}".encode()) % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The filled table as rows (slot, shard): ``slots`` rows, so it may be broadcast."""
    owners = F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",").cast("array<int>")
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.get(names, F.col("owner")).alias("shard"))


def slot_of(keys: list[str], slots: int = SLOTS) -> Column:
    """The slot of a row: a hash of its key columns, the same in every run. Null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], keys: list[str], slots: int = SLOTS, column: str = "shard") -> DataFrame:
    """``docs`` with slot and ``column``, the shard of each row by its ``keys``.

    One broadcast join with a table of fixed size, no shuffle: a hot source or copies cost nothing. Rows with
    equal keys, nulls included, go to one shard; an empty table stays empty. A column that has the name
    slot or ``column`` already is replaced.
    """
    table = lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    placed = docs.withColumn("slot", slot_of(keys, slots))
    return placed.join(F.broadcast(table), F.col("slot") == F.col("__slot")).withColumn(column, F.col("__shard")).drop("__slot", "__shard")


def op10_lookup_shards(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` placed on 64 shards, and where it would go if one of them were taken away."""
    from tallygrid.llm.shared import read_table

    shards = [f"shard-{i:02d}" for i in range(64)]
    docs = place(read_table(spark, sf_dir, "documents").select("doc_id"), shards, ["doc_id"])
    return place(docs, shards[:-1], ["doc_id"], column="shard_of_63")
