"""The incremental pipeline as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from labourmill.sources import keyed, scratch, storage


#: So many batches are merged into the base, at least.
MERGE = 16


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``batch=N`` whose writing has ended, ascending."""
    files, at = scratch.files(spark, path)
    if not files.exists(at):
        return []
    named = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().removeprefix("batch=")) for p in named if files.exists(p.suffix("/_SUCCESS")))


def _since(spark: SparkSession, target: str, last: int) -> list[DataFrame]:
    """The batches after ``last``, each with its number as ``__n``."""
    return [spark.read.parquet(f"{target}/batches/batch={n}").withColumn("__n", F.lit(n)) for n in _batches(spark, f"{target}/batches") if n > last]


def _rows(spark: SparkSession, target: str) -> DataFrame:
    """The base and the batches since, with ``__n``, the number of each row's batch (the base: -1)."""
    merged = keyed.writes(spark, f"{target}/base")
    base = keyed.read(spark, f"{target}/base")
    parts = ([] if base is None else [base.withColumn("__n", F.lit(-1))]) + _since(spark, target, merged[-1] if merged else -1)
    if not parts:
        raise ValueError(f"no batch has been written under {target}")
    return reduce(DataFrame.unionByName, parts)


def latest(spark: SparkSession, target: str, replace: bool = True) -> DataFrame:
    """One row for each position_id: the last one written, or (not ``replace``) the first."""
    pick = storage.latest_per_key if replace else storage.first_per_key
    return pick(_rows(spark, target), "position_id", "__n").drop("__n")


def ingest_postings(spark: SparkSession, source: str, schema: str, normalize: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, replace: bool = True, multi_line: bool = True, buckets: int = keyed.BUCKETS) -> StreamingQuery:
    """Landed JSON pages, normalised and upserted by position_id into the table under ``target``.

    A batch writes its own rows, one a key, and nothing else; ``latest`` merges them when it
    reads. Every MERGE batches they are merged into the base, a keyed table of which only the
    ``buckets`` with their keys are written anew (without ``replace``: with new keys); what only
    older bases need is deleted. A batch that runs again writes the same rows under its number. Since a
    new checkpoint counts from 0, it is refused where the target has batches already, and a batch
    whose predecessor is gone is refused too. A file is one page, or (not ``multi_line``) a page
    a line.
    """
    pick = storage.latest_per_key if replace else storage.first_per_key

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        merged, before = keyed.writes(session, f"{target}/base"), _batches(session, f"{target}/batches")
        if number and number - 1 not in (*merged, *before):
            raise ValueError(f"batch {number - 1} isn't under {target}: this checkpoint belongs to another table, or its files are gone")
        rows = batch if replace else batch.filter(F.col("title").isNotNull())
        pick(rows.withColumn("__o", F.monotonically_increasing_id()), "position_id", "__o").drop("__o").write.mode("overwrite").parquet(f"{target}/batches/batch={number}")
        last = merged[-1] if merged else -1
        if number - last >= MERGE:
            some = reduce(DataFrame.unionByName, _since(session, target, last))
            keyed.upsert(f"{target}/base", pick(some, "position_id", "__n").drop("__n"), replace=replace, number=number, buckets=buckets)
            # The base before and the batches since stay for those who read them.
            for n in before:
                if n <= last:
                    files, at = scratch.files(session, f"{target}/batches/batch={n}")
                    files.delete(at, True)

    files, log = scratch.files(spark, f"{checkpoint}/offsets")
    if not files.exists(log) and (keyed.writes(spark, f"{target}/base") or _batches(spark, f"{target}/batches")):
        raise ValueError(f"{target} has the batches of another checkpoint than {checkpoint}")
    pages = spark.readStream.schema(schema).option("multiLine", multi_line).option("maxFilesPerTrigger", 1000).json(source)
    return normalize(pages).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_new(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered while the watermark allows."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class _First(StatefulProcessor):
    """Remembers that a key has had a row, and gives its first one."""

    def __init__(self, required: str, order: tuple[str, ...], remember: int | None):
        self.required, self.order, self.remember = required, order, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.had = handle.getValueState("had", "had boolean", self.remember)

    def handleInputRows(self, key, rows, timerValues):
        place = lambda row: [(row[o] is not None, row[o]) for o in self.order]
        known, first = self.had.exists(), None
        for row in rows:
            if not known and row[self.required] is not None and (first is None or place(row) < place(first)):
                first = row
        if first is not None:
            self.had.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_writes(rows: DataFrame, target: str, checkpoint: str, key: str, *order: str, required: str = "title", remember: int | None = None) -> StreamingQuery:
    """The stream's rows whose key is new, appended to the Parquet table ``target``: ``storage.upsert_ignore`` as a stream.

    Of a batch's rows with one key the first in the order counts, rows without the required column
    don't. A key is remembered for so many milliseconds, or for ever: there is no watermark, so a
    copy may come however late. The state is a flag a key, kept in RocksDB below the checkpoint.
    """
    spark, setting = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).transformWithState(_First(required, order, remember), rows.schema, "Append", "ProcessingTime" if remember else "None")
    before = spark.conf.get(setting)
    # A stream takes its settings when it starts; others keep theirs.
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def posting_volume(postings: DataFrame, time: str, delay: str = "90 days", width: str = "1 day", *groups: str) -> DataFrame:
    """Live counts by day (and groups); rows later than the watermark are left out."""
    counts = postings.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *groups).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("w.start").alias("day"), *groups, "count")


def months(volumes: DataFrame) -> DataFrame:
    """Daily counts rolled up when they are read."""
    return volumes.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("count").alias("count"))
