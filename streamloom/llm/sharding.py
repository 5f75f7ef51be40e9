"""Placement by a permutation-filled lookup table (Maglev hashing).

Each shard has its own order of preference over the slots of a table of prime
size; shards take turns claiming their next free slot.  A row's key picks a
slot, and a broadcast of the table, whose size is a parameter, names its shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import free_name

#: Production parameters: shards, and a prime over a hundred times as large.
SHARDS, SLOTS = 32, 4099
#: A table beyond this isn't broadcast.
MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """The owner (index into ``names``) of every slot.

    A shard's preference list is ``(offset + j * skip) mod slots``, both from
    its name, so adding or removing a shard moves few slots.
    """
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shard names must be distinct and no more than slots")
    if slots > MAX_SLOTS or not _is_prime(slots):
        raise ValueError(f"slots must be a prime up to {MAX_SLOTS}")
    hashes = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(h[:8], "big") % slots for h in hashes]
    skip = [int.from_bytes(h[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for h in hashes]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the first 60 bits of the key's MD5; null keys are the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard), from one literal."""
    owners = ",".join(map(str, lookup_table(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"))


def assign(rows: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row, without a shuffle.

    Rows with equal keys share a shard, repeated rows too; null keys have the
    empty string's.  No rows give no rows.  Input columns of these names are
    replaced.
    """
    names = names or shard_names(SHARDS)
    placed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    other = free_name(placed.columns, "_slot")
    owners = table_frame(rows.sparkSession, names, slots).withColumnRenamed("slot", other)
    joined = placed.join(F.broadcast(owners), F.col("slot") == F.col(other))
    return joined.select(*placed.columns, "shard")


def write(rows: DataFrame, path: str, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS, salts: int = 4) -> None:
    """Write Parquet by shard; each shard is dealt over ``salts`` tasks, so none takes a whole hot shard."""
    out = assign(rows, key, names, slots)
    whole = F.xxhash64(*[f.name for f in out.schema.fields if "map<" not in f.dataType.simpleString()])
    out.repartition(F.col("shard"), F.pmod(whole, F.lit(salts))).write.partitionBy("shard").parquet(path)


def oracle(names: list[str], slots: int = SLOTS) -> str:
    owners = ",".join(map(str, lookup_table(names, slots)))
    return f"""WITH k AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, slot, (string_split('{owners}', ','))[slot + 1]::BIGINT AS shard FROM k"""
