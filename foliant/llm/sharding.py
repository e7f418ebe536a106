"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, (offset + j * skip) mod slots with
offset and skip hashed from its name. Shards take turns, as many in a row as their weight, each claiming the
first slot of its permutation that is still free, until all are taken. A row goes to the shard of the slot that
its key hashes to: one step through a broadcast table of fixed size, without a shuffle. When a shard leaves
or joins, few rows move but its own.

The table is control data of fixed size (MOST_SLOTS bounds it) and filled where the plan is made; rows are placed
by DataFrame functions only.

Defined results: a null key hashes as the empty string; repeated keys share a shard; an empty table gives an
empty result; other columns pass through, whatever their names. At least one shard, and a prime number of
slots not below the total weight, are required.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import free_name

SHARDS = tuple(f"shard-{k:02d}" for k in range(32))
SLOTS = 4099
MOST_SLOTS = 1_000_003


def _hash(text: str) -> int:
    """The first 60 bits of the MD5, as SQL engines can take them from its hex digits."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: tuple[str, ...], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The shard (its place in shards) of each slot."""
    weights = weights or {}
    turns = [weights.get(s, 1) for s in shards]
    if not shards or len(set(shards)) < len(shards) or min(turns) < 1:
        raise ValueError("shards need distinct names and positive weights")
    if not sum(turns) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime from {sum(turns)} to {MOST_SLOTS}")
    at = [_hash(f"{s}:offset") % slots for s in shards]
    skip = [_hash(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k, turn in enumerate(turns):
            for _ in range(turn):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                table[at[k]] = k
                left -= 1
                if not left:
                    return table


def slot_of(key: Column, slots: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> tuple[DataFrame, str, str]:
    """rows with two more columns, slot and shard, and these columns' names."""
    spark = rows.sparkSession
    slot, shard = free_name(rows, "slot"), free_name(rows, "shard")
    filled = json.dumps([shards[k] for k in fill(shards, slots, weights)])
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(filled), "array<string>")).alias(slot, shard))
    placed = rows.withColumn(slot, slot_of(F.col(f"`{key}`"), slots).cast("int"))
    return placed.join(F.broadcast(table), slot).select(*[F.col(f"`{c}`") for c in rows.columns], slot, shard), slot, shard


def digest(docs: DataFrame) -> DataFrame:
    placed, slot, shard = place(docs.select("doc_id"), "doc_id")
    return placed.select("doc_id", F.col(slot).alias("slot"), F.col(shard).alias("shard"))


SQL = f"""
WITH RECURSIVE p AS (
  SELECT k, CAST(('0x' || substr(md5(printf('shard-%02d:offset', k)), 1, 15)) AS BIGINT) % {SLOTS} AS off,
         CAST(('0x' || substr(md5(printf('shard-%02d:skip', k)), 1, 15)) AS BIGINT) % {SLOTS - 1} + 1 AS skip
  FROM (SELECT unnest(range({len(SHARDS)})) AS k)),
l AS (SELECT list(off ORDER BY k) AS offs, list(skip ORDER BY k) AS skips FROM p),
f(turn, slot, owners) AS (
  SELECT 0, CAST(offs[1] AS BIGINT), list_transform(range({SLOTS}), lambda i: CASE WHEN i = offs[1] THEN 0 ELSE -1 END) FROM l
  UNION ALL
  SELECT turn, s, list_transform(owners, lambda o, i: CASE WHEN i = s + 1 THEN turn % {len(SHARDS)} ELSE o END)
  FROM (SELECT turn + 1 AS turn, owners,
               (offs[(turn + 1) % {len(SHARDS)} + 1] + skips[(turn + 1) % {len(SHARDS)} + 1] * list_position(
                  list_transform(range({SLOTS}), lambda j: owners[(offs[(turn + 1) % {len(SHARDS)} + 1] + j * skips[(turn + 1) % {len(SHARDS)} + 1]) % {SLOTS} + 1]), -1)
                - skips[(turn + 1) % {len(SHARDS)} + 1]) % {SLOTS} AS s
        FROM f, l WHERE turn < {SLOTS - 1})),
t AS (SELECT slot, turn % {len(SHARDS)} AS k FROM f),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(d.slot AS INTEGER) AS slot, printf('shard-%02d', k) AS shard FROM d JOIN t ON t.slot = d.slot
"""
