"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a table of prime size (an offset and a step
from hashes of its name). The shards take turns; each claims the first slot of its order that is still
free, until the table is full. A row's slot is its key's hash modulo the size; a broadcast join with the
table, whose size is a parameter and not the data's, places it in constant time. When a shard is added
or lost, few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE, SHARDS = 65537, 64


def hash_of(text: str) -> int:
    """The first 60 bits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in shards) that owns each slot; size must be prime and at least len(shards)."""
    if size < 2 or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError(f"table size {size} is not prime")
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one, and not more than slots")
    at = [hash_of("offset:" + s) % size for s in shards]
    step = [hash_of("step:" + s) % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def lookup_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """lookup() as slot, shard rows."""
    owners = ",".join(map(str, lookup(shards, size)))
    names = F.array(*map(F.lit, shards))
    row = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return row.select(F.col("slot").cast("long").alias("slot"), names[F.col("owner").cast("int")].alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; a null key has the slot of the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def assign(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot and shard. Equal keys share a shard; nulls count as the empty string.

    Columns of df named slot or shard are replaced. No row is moved: the table is broadcast, and its
    number of rows is size, whatever df holds.
    """
    shards = shards or [f"shard-{i:03d}" for i in range(SHARDS)]
    table = lookup_frame(df.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("__at"))
    joined = placed.join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    return joined.select(*kept, F.col("__at").alias("slot"), F.col("__shard").alias("shard"))


def write(df: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE, rows_per_file: int = 1_000_000) -> None:
    """Write df in one folder a shard; a shard's rows are dealt over files of about rows_per_file, so that no task has a whole shard."""
    shards = shards or [f"shard-{i:03d}" for i in range(SHARDS)]
    files = max(1, -(-df.count() // (rows_per_file * len(shards))))
    placed = assign(df, key, shards, size)
    placed.repartition("shard", F.pmod(F.xxhash64(*df.columns), F.lit(files))).write.partitionBy("shard").mode("overwrite").parquet(path)
