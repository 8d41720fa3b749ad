"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, (offset + j * skip)
mod size. The shards take turns, each claiming the first slot of its order that is still free,
until the table is full. A row's key hashes to a slot and the slot names the shard, so placement
is one probe of a broadcast table; when a shard leaves, few other slots change hands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import hash60, key_text

#: Default number of slots: a prime of at least 100 slots for each of the default shards.
TABLE_SIZE = 3203
SHARDS = 32


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def shard_table(spark: SparkSession, names: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """One row (slot, shard) for each of ``table_size`` slots; shard is an index into ``names``.

    The table has exactly ``table_size`` rows whatever the data, so it may be broadcast.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(table_size) or table_size < len(names):
        raise ValueError("the table size must be a prime of at least the number of shards")
    m, n = table_size, len(names)
    # The single row's id keeps the fold out of constant folding on the driver.
    one = spark.range(1).select("id", F.array(*[F.lit(x) for x in names]).alias("names"))
    orders = one.select(
        "id",
        F.transform(
            "names",
            lambda name: F.struct(
                (hash60(F.concat(name, F.lit(":offset"))) % m).alias("offset"),
                (hash60(F.concat(name, F.lit(":skip"))) % (m - 1) + 1).alias("skip"),
            ),
        ).alias("orders"),
    ).select(
        "id",
        F.transform(
            "orders",
            lambda o: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: ((o["offset"] + j * o["skip"]) % m).cast("int")),
        ).alias("orders"),
    )
    # Bound as a lambda's argument, the orders are worked out once and not again for each turn.
    claimed = orders.select(
        F.transform(
            F.array("orders"),
            lambda known: F.aggregate(
                F.sequence(F.col("id").cast("int"), F.lit(m - 1)),
                F.array().cast("array<int>"),
                lambda got, turn: F.array_append(got, F.element_at(F.array_except(F.element_at(known, turn % n + 1), got), 1)),
            ),
        )[0].alias("claimed")
    )
    return claimed.select(F.posexplode("claimed").alias("turn", "slot")).select(
        F.col("slot").cast("long").alias("slot"), (F.col("turn") % n).alias("shard")
    )


def assign_shards(df: DataFrame, key: str, table: DataFrame, table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot (long) and shard (int); columns of these names are replaced.

    Rows with equal keys go to one shard; a null key is a key like any other. No shuffle: the
    table is broadcast, and its ``table_size`` rows don't grow with ``df``.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*kept, (hash60(key_text(F.col(f"`{key}`"))) % table_size).alias("slot"))
    return placed.join(F.broadcast(table), "slot", "left").select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    table = shard_table(spark, [f"shard-{i:03d}" for i in range(SHARDS)])
    return assign_shards(docs, "doc_id", table)


ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5(name || ':offset'), 1, 15))::BIGINT % {TABLE_SIZE} AS off,
         ('0x' || substr(md5(name || ':skip'), 1, 15))::BIGINT % ({TABLE_SIZE} - 1) + 1 AS skip
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({SHARDS}) r(i))
), orders AS (
  SELECT list([(off + j * skip) % {TABLE_SIZE} FOR j IN range({TABLE_SIZE})] ORDER BY i) AS o FROM shards
), fill AS (
  SELECT 0::BIGINT AS turn, NULL::BIGINT AS slot, [false FOR j IN range({TABLE_SIZE})] AS taken
  UNION ALL
  SELECT turn + 1, s, list_concat(taken[1:s], [true], taken[s + 2:])
  FROM (SELECT turn, taken, list_filter(o[turn % {SHARDS} + 1], lambda x: NOT taken[x + 1])[1] AS s
        FROM fill, orders WHERE turn < {TABLE_SIZE})
)
SELECT d.doc_id, f.slot, ((f.turn - 1) % {SHARDS})::INTEGER AS shard
FROM documents d
JOIN fill f ON f.slot = ('0x' || substr(md5(coalesce('=' || d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE}
"""
