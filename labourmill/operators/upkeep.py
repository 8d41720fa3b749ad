"""The countries' mart kept up by the postings that change, without reading those that don't.

What the mart shows follows from how often each country has each day, organization and skill:
numbers of different values are those that it has at all, and the first and last day are the least
and greatest of those. So only such counts are kept, and a change adds to some and takes from
others; no group has to be worked out anew when its least day goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.operators.analytics import skills_with_postings
from labourmill.sources import keyed


def country_counts(skills: DataFrame, postings: DataFrame) -> DataFrame:
    """country, kind (day, organization or skill), value, n. Skills of other postings don't count."""
    known = postings.filter("location_country != ''").select("position_id", F.col("location_country").alias("country"), "date_posted", "organization")
    own = known.select("country", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("day", "date_posted"), ("organization", "organization"))])).alias("v"))
    theirs = skills_with_postings(skills, known.select("position_id", "country")).select("country", F.struct(F.lit("skill").alias("kind"), F.col("skill").alias("value")).alias("v"))
    return own.unionByName(theirs).groupBy("country", "v").agg(F.count(F.lit(1)).alias("n")).select("country", "v.kind", "v.value", "n")


def keep_counts(path: str, come: tuple[DataFrame, DataFrame], gone: tuple[DataFrame, DataFrame], number: int, buckets: int = keyed.BUCKETS) -> bool:
    """Adds the counts of what came and takes away those of what went (skills, postings each), in the keyed table ``path``.

    A posting that changed went as it was and came as it is, with all its skills. Changes have
    ascending numbers; one that has been counted isn't counted again (False).
    """
    spark = come[0].sparkSession
    ended = keyed.writes(spark, path)
    if ended and number <= ended[-1]:
        return False
    # Fields that are null stay in the key as such.
    key = F.to_json(F.struct("country", "kind", "value"), {"ignoreNullFields": "false"})
    change = country_counts(*come).unionByName(country_counts(*gone).withColumn("n", -F.col("n"))).withColumn("key", key)
    change = change.groupBy("key").agg(F.first("country").alias("country"), F.first("kind").alias("kind"), F.first("value").alias("value"), F.sum("n").alias("n")).filter("n != 0")
    was = keyed.read(spark, path)
    if was is not None:
        change = change.join(was.select("key", F.col("n").alias("__was")), "key", "left").withColumn("n", F.col("n") + F.coalesce("__was", F.lit(0))).drop("__was")
    keyed.upsert(path, change, "key", number=number, buckets=buckets)
    return True


def country_marts(spark: SparkSession, path: str) -> DataFrame:
    """``analytics.country_marts`` from the counts that are kept."""
    there = keyed.read(spark, path).filter("n > 0")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    value, n = F.col("value"), F.col("n")
    return there.groupBy("country").agg(
        F.sum(of("day", n)).alias("total_postings"), F.count(of("organization", value)).alias("organizations"), F.min(of("day", value)).alias("first_posted"),
        F.max(of("day", value)).alias("last_posted"), F.count(of("skill", value)).alias("unique_skills"),
    )
