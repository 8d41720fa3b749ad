"""Joins whose keys may hold a large part of all rows, and tasks by the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is split.
SHARE = 10_000
#: Rows of a split key that meet in one task, about; fewer are never split.
LEAST = 1_000
#: Rows of one task that sorts or groups them, about.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """How many tasks ``rows``, which are counted, are dealt to: what the session has, or more, so that none has many more than TASK_ROWS."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def join_split(rows: DataFrame, table: DataFrame, key: str, part: Column, how: str = "inner") -> DataFrame:
    """The join (inner or left) of ``rows`` with ``table`` on ``key``; a key that very many ``rows`` have is dealt to several tasks.

    Rows are counted by key first. A key with more than one in SHARE of all rows, and more than
    LEAST, is split by the hash of ``part``, so its rows of ``table`` go to each of its parts; at
    most SHARE keys are split, and only these with their numbers of parts are broadcast.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    each = counts.crossJoin(F.broadcast(counts.agg(F.greatest(F.sum("__n") / SHARE, F.lit(LEAST)).alias("__most"))))  # one row
    split = F.broadcast(each.filter("__n > __most").select(key, F.ceil(F.col("__n") / F.col("__most")).cast("int").alias("__parts")))
    dealt = rows.join(split, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(part), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    copied = table.join(split, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"], how).drop("__part")
