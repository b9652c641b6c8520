"""Sharding by a permutation-filled lookup table (operator 2).

Every shard has a permutation of the slots of a prime-sized table, given by
an offset and a skip hashed from its name. Shards take turns; on its turn a
shard claims the first slot of its permutation that is still free, until the
table is full. A row's key hashes to a slot, the slot names the shard. Each
shard owns nearly the same number of slots, and when a shard leaves most
slots keep their owner.

The table has a fixed number of slots, whatever the data, so it may be
broadcast; placing a row is one hash and one lookup, without a shuffle.

Defined results: a null key hashes as the empty string; repeated rows go to
the same shard; an empty table gives an empty result; extra columns pass
through, and a column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table; over a hundred for each shard keeps shares within one per cent.
DEFAULT_SLOTS = 1621
DEFAULT_SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
MOST_SLOTS = 1_000_003


def name_hash(text: str) -> int:
    """60 bits of md5, as key_hash() has for columns."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = DEFAULT_SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Owner (index of the shard) of each slot. A shard of weight w takes w turns a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    weights = list(weights or [1] * len(shards))
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of 1 or more for each shard")
    at = [name_hash(f"offset:{s}") % slots for s in shards]
    skip = [name_hash(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                if not free:
                    break
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
    return owner


def place(df: DataFrame, key: str, shards: Sequence[str] = DEFAULT_SHARDS, slots: int = DEFAULT_SLOTS, weights: Sequence[int] | None = None) -> DataFrame:
    """Add slot (bigint), shard_id (int) and shard (string) to every row of df."""
    owner = lookup_table(shards, slots, weights)
    table = df.sparkSession.createDataFrame([(s, o, shards[o]) for s, o in enumerate(owner)], "slot bigint, shard_id int, shard string")
    slot = key_hash(F.col(key)) % F.lit(slots)
    keep = [c for c in df.columns if c == key or c not in ("slot", "shard_id", "shard")]
    return df.select(*keep).withColumn("slot", slot).join(F.broadcast(table), "slot", "inner")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").cast("bigint").alias("n_chars"))
    return place(docs, "doc_id").select("doc_id", "source", "n_chars", "slot", "shard_id", "shard")


#: The same turns as a recursive query: one claim an iteration.
OP2_SQL = f"""
WITH RECURSIVE h AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(DEFAULT_SHARDS)}) t(i)),
perm AS (
  SELECT i, name, CAST('0x' || substr(md5('offset:' || name), 1, 15) AS BIGINT) % {DEFAULT_SLOTS} AS o,
         CAST('0x' || substr(md5('skip:' || name), 1, 15) AS BIGINT) % {DEFAULT_SLOTS - 1} + 1 AS s FROM h),
fill AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS owner, CAST(-1 AS BIGINT) AS slot, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT turn + 1, p.i, pick, list_append(taken, pick)
  FROM (SELECT f.turn, f.taken, p.i,
               (list_filter(list_transform(range({DEFAULT_SLOTS}), lambda j: (p.o + j * p.s) % {DEFAULT_SLOTS}),
                            lambda x: NOT list_contains(f.taken, x)))[1] AS pick
        FROM fill f JOIN perm p ON p.i = f.turn % {len(DEFAULT_SHARDS)} WHERE f.turn < {DEFAULT_SLOTS}) p)
SELECT d.doc_id, d.source, CAST(length(d.text) AS BIGINT) AS n_chars, f.slot, CAST(f.owner AS INTEGER) AS shard_id, h.name AS shard
FROM documents d
JOIN fill f ON f.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {DEFAULT_SLOTS}
JOIN h ON h.i = f.owner
"""
