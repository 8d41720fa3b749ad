"""Parquet tables kept up by key: a write renews the buckets of its keys and leaves the others alone.

Rows lie in one of a fixed number of buckets by the hash of their key, in
``path/of=<buckets>/write=<number>/key_bucket=<bucket>``. A write adds its buckets whole, merged
with what they held, under its own number, and nothing is ever changed in place: the newest
finished write of each bucket is the table. So a write that is lost or run again does no harm, who
reads while another writes sees the table before or after it, and the cost of a write goes by the
buckets that its keys meet. There is one writer at a time. Take so many buckets that one has about
a gigabyte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.sources import scratch, storage

BUCKETS = 64


def _named(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix>=N`` below a path, ascending."""
    files, at = scratch.files(spark, path)
    if not files.exists(at):
        return []
    return sorted(int(x.getPath().getName().removeprefix(f"{prefix}=")) for x in files.listStatus(at) if x.getPath().getName().startswith(f"{prefix}="))


def _root(spark: SparkSession, path: str, buckets: int = BUCKETS) -> tuple[str, int]:
    """The table's folder and its number of buckets; ``buckets`` counts only for a new table."""
    of = (_named(spark, path, "of") or [buckets])[0]
    return f"{path}/of={of}", of


def writes(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the writes that have ended, ascending; those of which nothing is left too."""
    root, _ = _root(spark, path)
    files, _ = scratch.files(spark, root)
    ended = lambda n: files.exists(scratch.files(spark, f"{root}/write={n}/_SUCCESS")[1])
    return [n for n in _named(spark, root, "write") if ended(n)]


def current(spark: SparkSession, path: str, last: int | None = None) -> dict[int, int]:
    """The write that each bucket is read from, as of the write ``last``."""
    root, _ = _root(spark, path)
    return {b: n for n in writes(spark, path) if last is None or n <= last for b in _named(spark, f"{root}/write={n}", "key_bucket")}


def read(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The table, or some of its buckets; None where they hold nothing."""
    root, _ = _root(spark, path)
    paths = [f"{root}/write={n}/key_bucket={b}" for b, n in sorted(current(spark, path).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def _bucket(key: str, of: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")


def _clear(spark: SparkSession, path: str, kept: int, newest: int) -> None:
    """Deletes buckets that neither the write ``kept`` nor the newest one reads."""
    root, _ = _root(spark, path)
    needed = set(current(spark, path, kept).items()) | set(current(spark, path, newest).items())
    for n in writes(spark, path):
        left = [b for b in _named(spark, f"{root}/write={n}", "key_bucket") if (b, n) not in needed]
        for b in left:
            files, at = scratch.files(spark, f"{root}/write={n}/key_bucket={b}")
            files.delete(at, True)
        if n < kept and not _named(spark, f"{root}/write={n}", "key_bucket"):
            files, at = scratch.files(spark, f"{root}/write={n}")
            files.delete(at, True)


def upsert(path: str, incoming: DataFrame, key: str = "position_id", *order: str, replace: bool = True, required: str = "title", number: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """``storage.upsert_replace`` (or ``upsert_ignore``) into the table; the buckets that were written anew.

    Only buckets with incoming keys are read, and without ``replace`` only those with new keys are
    written. Rows without a key are left out. A table that isn't there yet begins with the
    incoming rows. ``number`` is the write's (the next one if none is given) and must be beyond
    all that have ended.
    """
    spark = incoming.sparkSession
    ended = writes(spark, path)
    now = number if number is not None else (ended[-1] + 1 if ended else 0)
    if ended and now <= ended[-1]:
        raise ValueError(f"write {ended[-1]} of {path} has ended already, so {now} can't be the next")
    root, of = _root(spark, path, buckets)
    scratch_path = scratch.folder(spark)
    rows = incoming.filter(F.col(key).isNotNull())
    if replace:
        new = storage.latest_per_key(rows, key, *order).drop(*order) if order else rows.dropDuplicates([key])
    else:
        known = read(spark, path)
        if known is not None:
            met = [r[0] for r in rows.select(_bucket(key, of).alias("b")).distinct().collect()]  # no more than there are buckets
            known = read(spark, path, met)
        known = rows.select(key).limit(0) if known is None else known
        new = storage.upsert_ignore(known, rows, key, *order, required=required)
    new.withColumn("key_bucket", _bucket(key, of)).write.parquet(scratch_path)
    added = spark.read.parquet(scratch_path)
    met = sorted(r[0] for r in added.select("key_bucket").distinct().collect())
    if met:
        old = read(spark, path, met)
        merged = added.drop("key_bucket") if old is None else storage.upsert_replace(old, added.drop("key_bucket"), key)
        target = merged.withColumn("key_bucket", _bucket(key, of)).repartition("key_bucket")
        target.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{root}/write={now}")
        if ended:
            _clear(spark, path, ended[-1], now)
    elif number is not None:
        # Nothing changed, but who counts writes must see this one.
        added.limit(0).drop("key_bucket").write.mode("overwrite").parquet(f"{root}/write={now}")
    files, at = scratch.files(spark, scratch_path)
    files.delete(at, True)
    return met
