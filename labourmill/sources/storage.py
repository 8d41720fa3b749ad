"""Keyed writes, mappings and retention, as functions from tables to tables.

Where a table format has MERGE these are its conditions; on plain Parquet ``keyed`` writes only the
buckets that hold incoming keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that is last in the order."""
    last = W.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    first = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")


def upsert_replace(existing: DataFrame, incoming: DataFrame, key: str = "position_id", *order: str) -> DataFrame:
    """Last write wins, whole rows; ``order`` places incoming rows, all of which are later than existing ones.

    Incoming rows are made one a key first; existing rows then only meet their keys.
    """
    new = latest_per_key(incoming, key, *order).drop(*order) if order else incoming.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def upsert_ignore(existing: DataFrame, incoming: DataFrame, key: str = "position_id", *order: str, required: str = "title") -> DataFrame:
    """The incoming rows that are new (first write wins); rows without the required column don't count."""
    named = incoming.filter(F.col(required).isNotNull())
    new = first_per_key(named, key, *order).drop(*order) if order else named.dropDuplicates([key])
    return new.join(existing.select(key), key, "left_anti")


def append_skills(skills: DataFrame, more: DataFrame, dedup: bool = False) -> DataFrame:
    """Both, every occurrence; with ``dedup`` one row for each posting and skill."""
    both = skills.unionByName(more, allowMissingColumns=True)
    return both.dropDuplicates(["position_id", "skill_raw"]) if dedup else both


def apply_mappings(skills: DataFrame, mappings: DataFrame) -> DataFrame:
    """Uri, label, type and category of every row whose raw skill has a mapping (raw_skill, esco_*,
    skill_category); a mapping without uri changes nothing."""
    known = mappings.filter("esco_uri is not null").select(
        F.col("raw_skill").alias("skill_raw"), F.col("esco_uri").alias("__u"), F.col("esco_label").alias("__l"), F.col("esco_type").alias("__t"), F.col("skill_category").alias("__c")
    )
    pairs = {"skill_esco_uri": "__u", "skill_esco_label": "__l", "skill_esco_type": "__t", "skill_category": "__c"}
    return skills.join(known, "skill_raw", "left").withColumns({old: F.coalesce(new, old) for old, new in pairs.items()}).select(*skills.columns)


def unprocessed_postings(postings: DataFrame, skills: DataFrame, prefix: str = "jooble_") -> DataFrame:
    """Postings of one feed that have no skills yet."""
    return postings.filter(F.col("position_id").startswith(prefix)).join(skills.select("position_id"), "position_id", "left_anti")


def orphan_skills(skills: DataFrame, postings: DataFrame, kept: bool = False) -> DataFrame:
    """Skills whose posting is gone, or (kept) is there."""
    return skills.join(postings.select("position_id"), "position_id", "left_semi" if kept else "left_anti")


def retention_cleanup(postings: DataFrame, skills: DataFrame, as_of: str, days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings and skills that stay, and one row with the counts of those that go.

    Dates are compared as texts: an empty one is old, a null one stays.
    """
    old = F.coalesce(F.col("date_posted") < F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd"), F.lit(False))
    stay = postings.filter(~old)
    left = orphan_skills(skills, stay, kept=True)
    gone = postings.agg(F.count(F.when(old, 1)).alias("postings_deleted")).join(
        F.broadcast(orphan_skills(skills, stay).agg(F.count(F.lit(1)).alias("skills_deleted"))), F.lit(True)
    )
    return stay, left, gone


def collection_log_rows(runs: DataFrame, started_at: str, finished_at: str) -> DataFrame:
    """Rows of the log for runs (query, total_found, jobs_collected; keyword and error_message if they have them)."""
    has = lambda c: F.col(c) if c in runs.columns else F.lit(None).cast("string")
    error = has("error_message")
    return runs.select(
        "query", F.coalesce(has("keyword"), F.lit("")).alias("keyword"), F.col("total_found").cast("int").alias("total_found"), F.col("jobs_collected").cast("int").alias("jobs_collected"),
        F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error_message"), F.to_timestamp(F.lit(started_at)).alias("started_at"), F.to_timestamp(F.lit(finished_at)).alias("finished_at"),
    )


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Overwrites the snapshot's day and no other."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def save_bucketed(rows: DataFrame, name: str, path: str, buckets: int, key: str = "position_id") -> DataFrame:
    """The table ``name``, bucketed and sorted by key, a file a bucket.

    Tables with equal numbers of buckets are joined on the key, or grouped by it, without a
    shuffle. A key in a very large part of all rows makes its bucket as large.
    """
    rows.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return rows.sparkSession.table(name)


def store_mart(mart: DataFrame, path: str) -> None:
    mart.write.mode("overwrite").parquet(path)


def read_mart(spark: SparkSession, path: str) -> DataFrame | None:
    """The mart, or None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def mart_json(mart: DataFrame, key: str, *order: str) -> DataFrame:
    """key, data: a small mart's rows as one JSON array, in the order of the columns named."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.to_json(F.struct(*mart.columns)).alias("__json"))))
    return mart.agg(F.lit(key).alias("key"), F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["__json"]), ","), F.lit("]")).alias("data"))


def write_eval_report(metrics: DataFrame, entries: DataFrame, path: str) -> None:
    """The metrics' row as JSON under ``metrics``, the entries under ``per_entry``, a line each."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    entries.write.mode("overwrite").json(f"{path}/per_entry")
