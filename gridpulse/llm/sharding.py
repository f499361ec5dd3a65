"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: an offset and a skip from hashes of its
name. The shards take turns, each claiming the first slot of its order that is still free, until the table is full, so that each holds
nearly the same number of slots, and adding or removing a shard moves few others. The table has a fixed size; it is broadcast, and a row finds
its shard by one hash and one lookup. Only DataFrame functions touch the rows.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, run_folder

#: A prime well above 100 slots a shard, so shards differ by under 1 %; also the broadcast's size bound.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """(offset, skip): the order is offset, offset + skip, offset + 2 * skip, ... modulo the prime size."""
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:], "big") % (size - 1) + 1


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into the shards, sorted by name; the same for any order in which they are given."""
    if not is_prime(size) or not 0 < len(set(shards)) == len(shards) <= size:
        raise ValueError("the size must be a prime, and shard names differ and fit in it")
    orders = [list(preference(s, size)) for s in sorted(shards)]
    table, free = [-1] * size, size
    while True:
        for i, order in enumerate(orders):
            while table[order[0]] >= 0:
                order[0] = (order[0] + order[1]) % size
            table[order[0]] = i
            free -= 1
            if not free:
                return table


def place(df: DataFrame, keys: list[str], shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with its slot and shard (columns ``slot`` and ``shard``, with underscores added if those names are taken).

    Equal keys, as text, get the same shard, whatever their number; a null part of a key counts as a value of its own. A hot key goes to
    one shard by definition; nothing is gathered, so it needs no more of a task. Rows repeat as they do in ``df``; an empty table gives no row.
    """
    spark, slot, shard = df.sparkSession, free_name(df, "slot"), free_name(df, "shard")
    names = F.split(F.lit("\n".join(sorted(shards))), "\n")
    table = spark.range(size).select(
        F.col("id").alias(slot),
        F.element_at(names, F.element_at(F.split(F.lit(" ".join(map(str, lookup_table(shards, size)))), " "), (F.col("id") + 1).cast("int")).cast("int") + 1).alias(shard))
    key = F.xxhash64(*(x for k in keys for x in (F.col(k).cast("string"), F.col(k).isNull())))
    return df.withColumn(slot, F.pmod(key, F.lit(size).cast("long"))).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def write_shards(df: DataFrame, folder: str, keys: list[str], shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int | None = None) -> DataFrame:
    """Write ``df`` as one folder of Parquet files per shard, and return what was written, with slot and shard.

    Shards are gathered by a rebalancing shuffle: adaptive execution measures it, puts small shards together in a task and splits a large one, by
    blocks of rows, into files of the advisory size, so neither the rows of a hot key nor rows equal throughout must lie in one task. With ``files_per_shard``
    a shard has that many files instead, dealt by a hash of the whole rows (columns of maps and variants aside).
    """
    placed = place(df, keys, shards, size)
    shard = placed.columns[-1]
    if files_per_shard is None:
        dealt = placed.hint("rebalance", shard)
    else:
        whole = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
        file = F.pmod(F.xxhash64(F.lit("file"), *whole), F.lit(files_per_shard).cast("long"))
        number = F.array_position(F.split(F.lit("\n".join(sorted(shards))), "\n"), F.col(shard)) - 1
        dealt = placed.repartitionById(len(shards) * files_per_shard, (number * files_per_shard + file).cast("int"))
    dealt.write.partitionBy(shard).parquet(folder)
    return df.sparkSession.read.schema(placed.schema).parquet(folder).select(*placed.columns)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document by its id, as read back from the shards that the whole documents were written to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return write_shards(docs, run_folder(spark, "sharding"), ["doc_id"]).select("doc_id", "source", "slot", "shard")
