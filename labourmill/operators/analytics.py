"""Marts over job postings (P) and job skills (S).

Every ordered limit ends in a key that is unique, so results don't depend on how rows are dealt.
Averages over P joined with S are weighted by skill occurrences. Columns that a mart shows without
aggregating them are the least value of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.functions import scalars
from labourmill.operators import predicates as p
from labourmill.sources import skew

#: Logarithm of a sketch's number of counters: one standard error is 0.8 % of the count.
SKETCH = 14


def _remote() -> Column:
    return F.sum(F.col("telework_eligible").cast("long"))


def skills_with_postings(skills: DataFrame, postings: DataFrame, *columns: str) -> DataFrame:
    """One row for each skill occurrence, with the posting's columns (all if none are named).

    Both sides meet on position_id: tables that ``storage.save_bucketed`` wrote need no shuffle, and
    hot skills don't matter to this join.
    """
    return p.with_key(skills).join(postings.select("position_id", *columns) if columns else postings, "position_id")


def _annual(skills: DataFrame, postings: DataFrame) -> DataFrame:
    return skills_with_postings(skills, p.annual_salary(postings).select("position_id", "min_salary", "max_salary"))


def _distinct(column: str, approximate: bool) -> Column:
    """Number of different values, nulls left out; by a sketch if ``approximate``."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, SKETCH)) if approximate else F.countDistinct(column)


def distinct_sketches(skills: DataFrame, postings: DataFrame) -> DataFrame:
    """day, country, organizations, skills: sketches of the different organizations and skills of each day and country.

    They merge into those of any days and countries, so a day that comes in is sketched once and
    nothing that was there is read again.
    """
    day_of = [F.col("date_posted").alias("day"), F.col("location_country").alias("country")]
    own = postings.groupBy(*day_of).agg(F.hll_sketch_agg("organization", SKETCH).alias("organizations"))
    theirs = skills_with_postings(skills, postings, "date_posted", "location_country").groupBy(*day_of).agg(F.hll_sketch_agg("skill", SKETCH).alias("skills"))
    same = own["day"].eqNullSafe(theirs["day"]) & own["country"].eqNullSafe(theirs["country"])
    return own.join(theirs, same, "left").select(own["day"], own["country"], "organizations", "skills")


def distinct_estimates(sketches: DataFrame, *groups: str) -> DataFrame:
    """organizations, unique_skills of each group of ``distinct_sketches`` (day, country, both or none), estimated."""
    merged = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long"))
    return sketches.groupBy(*groups).agg(merged("organizations").alias("organizations"), merged("skills").alias("unique_skills"))


def overview(postings: DataFrame, skills: DataFrame, as_of: str, service: bool = True, approximate: bool = False) -> DataFrame:
    """One row; different values are estimated if ``approximate``. The service form rounds the share of remote postings and shows the total where a week has none."""
    annual = (F.col("salary_type") == "Per Year") & (F.col("min_salary") > 20000)
    share = _remote() * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))
    one = postings.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        _distinct("organization", approximate).alias("total_organizations"),
        F.coalesce(F.bround(F.avg(F.when(annual, F.col("min_salary"))), 0), F.lit(0.0)).cast("long").alias("avg_min_salary"),
        F.coalesce(F.bround(F.avg(F.when(annual, F.col("max_salary"))), 0), F.lit(0.0)).cast("long").alias("avg_max_salary"),
        F.coalesce(F.bround(share, 1) if service else share, F.lit(0.0)).alias("remote_percentage"),
        F.count(F.when(p.recent(as_of), 1)).alias("week"),
    )
    distinct = skills.agg(_distinct("skill_raw", approximate).alias("unique_skills"))
    week = F.when(F.col("week") == 0, F.col("total_jobs")).otherwise(F.col("week")) if service else F.col("week")
    return one.join(F.broadcast(distinct), F.lit(True)).withColumn("new_this_week", week).drop("week")


def top_skills_mapped(skills: DataFrame, n: int = 20) -> DataFrame:
    found = p.with_key(skills.filter("skill_esco_label is not null"))
    return (
        found.groupBy("skill").agg(F.min("skill_esco_type").alias("type"), F.min("skill_category").alias("category"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "skill").limit(n)
    )


def top_skills(skills: DataFrame, postings: DataFrame | None = None, country: str | None = None, n: int = 20) -> DataFrame:
    """Most frequent skills, mapped or not, in title case."""
    rows = p.with_key(skills)
    if country not in (None, "", "ALL"):
        rows = skills_with_postings(skills, p.country_filter(postings, country).select("position_id"))
    top = (
        rows.filter("skill is not null").groupBy("skill")
        .agg(F.min("skill_esco_type").alias("t"), F.min("skill_category").alias("c"), F.min("skill_raw").alias("r"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "skill").limit(n)
    )
    return top.select(
        scalars.title_case(F.col("skill")).alias("skill"), "count", F.coalesce("t", scalars.classify_skill_type(F.col("r"))).alias("type"), F.coalesce("c", F.lit("Other")).alias("category")
    )


def category_salary(skills: DataFrame, postings: DataFrame) -> DataFrame:
    rows = _annual(skills.filter("skill_category is not null"), postings)
    return (
        rows.groupBy(F.col("skill_category").alias("category"))
        .agg(F.round(F.avg("min_salary")).alias("avg_min"), F.round(F.avg("max_salary")).alias("avg_max"), F.countDistinct("position_id").alias("postings"))
        .orderBy(F.desc("avg_min"), "category")
    )


def top_per_group(rows: DataFrame, group: str, count: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the largest counts; the least keys first among equals."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(F.desc(count), key))).filter(F.col(rank) <= k)


def skill_demand(skills: DataFrame, k: int = 5) -> DataFrame:
    """category, total, skills: array of the k most frequent (skill, count) of each category."""
    counts = p.with_key(skills.filter("skill_category is not null")).groupBy(F.col("skill_category").alias("category"), "skill").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("category").agg(F.sum("count").alias("total"))
    top = top_per_group(counts.filter("skill is not null"), "category", "count", "skill", k)
    listed = top.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "skill", "count"))), lambda s: F.struct(s["skill"].alias("skill"), s["count"].alias("count"))).alias("skills"))
    return totals.join(listed, "category", "left").orderBy(F.desc("total"), "category")


def skill_roi(skills: DataFrame, postings: DataFrame, more_than: int = 30, n: int = 20) -> DataFrame:
    """Best-paid skills that more than so many postings ask for."""
    rows = _annual(skills, postings).filter("skill is not null")
    return (
        rows.groupBy("skill")
        .agg(
            F.min("skill_esco_type").alias("type"), F.min("skill_category").alias("category"), F.round(F.avg("min_salary")).alias("avg_min_salary"),
            F.round(F.avg("max_salary")).alias("avg_max_salary"), F.countDistinct("position_id").alias("postings"),
        )
        .filter(F.col("postings") > more_than).orderBy(F.desc("avg_min_salary"), "skill").limit(n)
    )


#: Column, limit and least count (exclusive) of each salary mart.
SALARY_DIMENSIONS = {"series": ("series_code", 15, 3), "state": ("location_state", 20, 3), "department": ("department", 15, 3), "grade": ("job_grade", None, None), "grade_mart": ("job_grade", 50, 3)}


def salaries_by(postings: DataFrame, dimension: str, series_names: DataFrame | None = None) -> DataFrame:
    """label, count, avg_min, avg_max; an unknown dimension is the department."""
    column, limit, least = SALARY_DIMENSIONS.get(dimension, SALARY_DIMENSIONS["department"])
    out = p.has_salary_and_group(postings, column).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("count"), F.avg("min_salary").alias("avg_min"), F.avg("max_salary").alias("avg_max"))
    out = out.filter(F.col("count") > least) if least is not None else out
    out = out.orderBy(F.desc("avg_max"), "label")
    out = out.limit(limit) if limit else out
    if column == "series_code" and series_names is not None:
        out = series_name(out.withColumnRenamed("label", "code"), "code", series_names).select(F.col("series_name").alias("label"), "count", "avg_min", "avg_max")
    return out


def series_name(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with series_name from ``names`` (series_code, name); an unknown code is its own name."""
    known = names.select(F.col("series_code").alias(column), F.col("name").alias("__name"))
    return rows.join(known, column, "left").withColumn("series_name", F.coalesce("__name", column)).drop("__name")


def locations(postings: DataFrame, n: int = 20) -> DataFrame:
    return (
        postings.filter("location_state != ''").groupBy("location_state")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("max_salary").alias("avg_max_salary"), _remote().alias("remote_count")).orderBy(F.desc("count"), "location_state").limit(n)
    )


def posting_volume(postings: DataFrame, country: str | None = None, months: int = 24) -> DataFrame:
    """The newest months with their counts, oldest first."""
    found = p.country_filter(postings, country).withColumn("month", scalars.posting_month(F.col("date_posted"))).filter("month is not null")
    return found.groupBy("month").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("month")).limit(months).orderBy("month")


def available_countries(postings: DataFrame) -> DataFrame:
    return postings.filter("location_country != ''").groupBy(F.col("location_country").alias("country")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "country")


def skill_timeline(skills: DataFrame, postings: DataFrame, skill: str, country: str | None = None) -> DataFrame:
    rows = skills_with_postings(skills, p.country_filter(postings, country).select("position_id", "date_posted"))
    months = p.skill_match(rows, skill).withColumn("month", scalars.posting_month(F.col("date_posted"))).filter("month is not null")
    return months.groupBy("month").agg(F.countDistinct("position_id").alias("count")).orderBy("month")


def country_stats(skills: DataFrame, postings: DataFrame, country: str | None = None, approximate: bool = False) -> DataFrame:
    own = p.country_filter(postings, country)
    one = own.agg(F.count(F.lit(1)).alias("total_postings"), _distinct("organization", approximate).alias("organizations"), F.min("date_posted").alias("first_posted"), F.max("date_posted").alias("last_posted"))
    rows = p.with_key(skills) if country in (None, "", "ALL") else skills_with_postings(skills, own.select("position_id"))
    return one.join(F.broadcast(rows.agg(_distinct("skill", approximate).alias("unique_skills"))), F.lit(True))


def skill_country_breakdown(skills: DataFrame, postings: DataFrame, skill: str, n: int = 20) -> DataFrame:
    rows = p.skill_match(skills_with_postings(skills, postings.select("position_id", "location_country")), skill).filter("location_country != ''")
    return rows.groupBy(F.col("location_country").alias("country")).agg(F.countDistinct("position_id").alias("count")).orderBy(F.desc("count"), "country").limit(n)


def skill_detail(skills: DataFrame, postings: DataFrame, skill: str, related: int = 8) -> DataFrame:
    """One row about a skill, with its salary and the most frequent others of its category; none if unknown."""
    keyed = p.with_key(skills)
    own = p.skill_match(keyed, skill)
    one = own.agg(
        F.min("skill").alias("skill"), F.min("skill_esco_type").alias("type"), F.min("skill_category").alias("category"), F.min("skill_esco_uri").alias("uri"),
        F.count(F.lit(1)).alias("occurrences"), F.countDistinct("position_id").alias("postings"),
    ).filter("occurrences > 0")
    paid = p.skill_match(_annual(skills, postings), skill).agg(F.round(F.avg("min_salary")).alias("avg_min_salary"), F.round(F.avg("max_salary")).alias("avg_max_salary"))
    others = keyed.filter(F.lower("skill") != skill.lower()).join(F.broadcast(one.select(F.col("category").alias("skill_category"))), "skill_category")
    top = others.groupBy("skill").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(related)
    listed = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "skill"))), lambda s: F.struct(s["skill"].alias("skill"), (-s["c"]).alias("count"))).alias("related"))
    return one.join(F.broadcast(paid), F.lit(True)).join(F.broadcast(listed), F.lit(True))


def skills_by_category(skills: DataFrame, category: str, n: int = 20) -> DataFrame:
    found = p.with_key(skills.filter(F.col("skill_category") == category)).groupBy("skill").agg(F.min("skill_esco_type").alias("type"), F.min("skill_esco_uri").alias("uri"), F.count(F.lit(1)).alias("count"))
    return found.orderBy(F.desc("count"), "skill").limit(n)


def share_of_total(rows: DataFrame, count: str, into: str) -> DataFrame:
    """For small aggregates: each row's part of the sum, in per cent."""
    total = rows.agg(F.sum(count).alias("__total"))
    return rows.join(F.broadcast(total), F.lit(True)).withColumn(into, F.col(count) * 100.0 / F.when(F.coalesce("__total", F.lit(0)) == 0, 1).otherwise(F.col("__total"))).drop("__total")


def pct_of_max(rows: DataFrame, count: str, into: str) -> DataFrame:
    most = rows.agg(F.max(count).alias("__most"))
    return rows.join(F.broadcast(most), F.lit(True)).withColumn(into, F.col(count) / F.col("__most") * 100.0).drop("__most")


def categories_summary(postings: DataFrame, names: DataFrame, n: int = 20) -> DataFrame:
    top = (
        postings.filter("series_code != ''").groupBy("series_code")
        .agg(
            F.count(F.lit(1)).alias("total_postings"), F.coalesce(F.bround(F.avg("max_salary"), 0), F.lit(0.0)).cast("long").alias("avg_salary"),
            F.bround(_remote() * 100.0 / F.count(F.lit(1)), 1).alias("remote_percentage"),
        )
        .orderBy(F.desc("total_postings"), "series_code").limit(n)
    )
    return series_name(top, "series_code", names)


def series_coverage(postings: DataFrame) -> DataFrame:
    known = F.count(F.when(F.col("series_code") != "", 1))
    return postings.agg(F.count(F.lit(1)).alias("total"), known.alias("with_series"), F.bround(known * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("coverage"))


def collection_status(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("started_at"), "query").limit(n)


def collector_stats(postings: DataFrame, skills: DataFrame, log: DataFrame, approximate: bool = False) -> DataFrame:
    kinds = {"federal": "Federal", "private": "Private", "state": "State", "non_profit": "Non-Profit"}
    one = postings.agg(F.count(F.lit(1)).alias("total_postings"), *[F.count(F.when(F.col("job_type") == v, 1)).alias(k) for k, v in kinds.items()], _distinct("organization", approximate).alias("unique_orgs"))
    return one.join(F.broadcast(skills.agg(_distinct("skill_raw", approximate).alias("unique_skills"))), F.lit(True)).join(
        F.broadcast(log.agg(F.count(F.when(F.col("status") == "error", 1)).alias("errors"))), F.lit(True)
    )


def _top_json(rows: DataFrame, column: str, name: str, n: int = 20) -> DataFrame:
    top = rows.groupBy(F.col(column).alias(name)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), name).limit(n)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), name))), lambda s: F.struct(s[name].alias(name), (-s["c"]).alias("count")))
    return top.agg(F.to_json(ordered).alias("json"))


def market_snapshot(postings: DataFrame, skills: DataFrame, day: str) -> DataFrame:
    """One row a job type, each with the corpus' top skills and states; none without postings."""
    types = postings.groupBy("job_type").agg(
        F.count(F.lit(1)).alias("total_postings"), F.avg("min_salary").alias("avg_min_salary"), F.avg("max_salary").alias("avg_max_salary"),
        (_remote() * 100.0 / F.count(F.lit(1))).alias("remote_percentage"), F.sum("total_openings").alias("total_openings"),
    )
    top = _top_json(skills, "skill_raw", "skill").withColumnRenamed("json", "top_skills")
    states = _top_json(postings.filter("location_state != ''"), "location_state", "state").withColumnRenamed("json", "top_locations")
    return types.join(F.broadcast(top), F.lit(True)).join(F.broadcast(states), F.lit(True)).withColumn("snapshot_date", F.lit(day))


def unmapped_skill_counts(skills: DataFrame) -> DataFrame:
    return p.unmapped(skills).groupBy("skill_raw").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill_raw")


def recent_jobs(postings: DataFrame, columns: list[str], keyword: str | None = None, n: int = 20) -> DataFrame:
    return p.keyword_search(postings, keyword).select(*columns).orderBy(F.desc_nulls_last("date_posted"), "position_id").limit(n)


def skill_type_share(top: DataFrame) -> DataFrame:
    """bucket, occurrences, skills of ranked skills (skill, type, count)."""
    return top.groupBy(scalars.type_bucket(F.col("type")).alias("bucket")).agg(F.sum("count").alias("occurrences"), F.count(F.lit(1)).alias("skills"))


def match_rate(top: DataFrame) -> DataFrame:
    typed = F.count(F.when(F.col("type").isin("knowledge", "competence"), 1))
    return top.agg(F.coalesce(scalars.round_half_up(typed * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))), F.lit(0)).alias("match_rate"))


def category_share_of_top(top: DataFrame) -> DataFrame:
    return top.groupBy(F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "category")


def remote_share_by_state(postings: DataFrame, n: int = 10) -> DataFrame:
    return locations(postings).orderBy(F.desc("count"), "location_state").limit(n).select("location_state", scalars.round_half_up(F.col("remote_count") * 100.0 / F.col("count")).alias("percentage"))


def category_relative_index(summary: DataFrame, n: int = 8) -> DataFrame:
    top = summary.orderBy(F.desc("total_postings"), "series_code").limit(n)
    return pct_of_max(top, "total_postings", "index").select("series_code", "total_postings", "index")


def insight_cards(demand: DataFrame) -> DataFrame:
    """card, value, note from (category, total): leading category, their number, share of IT."""
    shared = share_of_total(demand.select("category", "total"), "total", "share")
    is_it = F.contains(F.col("category"), F.lit("IT")) | F.contains(F.col("category"), F.lit("Tech"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("total"), "category").limit(1)

    pct = F.concat(F.bround("share", 0).cast("long").cast("string"), F.lit("%"))
    lead = first(shared).select(F.lit("DOMINANT CATEGORY").alias("card"), pct.alias("value"), F.col("category").alias("note"))
    number = shared.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("SKILL CATEGORIES").alias("card"), F.col("n").cast("string").alias("value"), F.lit("").alias("note"))
    it = first(shared.filter(is_it)).select(F.lit("IT & TECH SHARE").alias("card"), pct.alias("value"), F.col("category").alias("note"))
    return lead.unionByName(number).unionByName(it)


def hero_cards(one: DataFrame) -> DataFrame:
    """label, val: six cards from an overview row."""
    k = lambda c: F.bround(F.col(c) / 1000, 0).cast("long").cast("string")
    cards = {
        "JOB POSTINGS": F.concat(F.floor(F.col("total_jobs") / 1000).cast("string"), F.lit("K+")), "ESCO SKILLS": F.col("unique_skills").cast("string"),
        "ORGANIZATIONS": F.col("total_organizations").cast("string"), "REMOTE ELIGIBLE": F.concat(F.bround("remote_percentage", 0).cast("long").cast("string"), F.lit("%")),
        "AVG SALARY RANGE": F.concat(F.lit("$"), k("avg_min_salary"), F.lit("K–$"), k("avg_max_salary"), F.lit("K")), "NEW THIS WEEK": F.col("new_this_week").cast("string"),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), v.alias("val")) for c, v in cards.items()])).alias("card")).select("card.*")


# Marts of all entities at once: one grouped pass in place of a query for each skill or country.


def country_marts(skills: DataFrame, postings: DataFrame) -> DataFrame:
    """country_stats of every country. Distinct counts are taken apart and joined on the country."""
    known = postings.filter("location_country != ''")
    base = known.groupBy("location_country").agg(F.count(F.lit(1)).alias("total_postings"), F.min("date_posted").alias("first_posted"), F.max("date_posted").alias("last_posted"))
    orgs = known.select("location_country", "organization").distinct().groupBy("location_country").agg(F.count("organization").alias("organizations"))
    keys = skills_with_postings(skills, known.select("position_id", "location_country")).select("location_country", "skill").distinct().groupBy("location_country").agg(F.count("skill").alias("unique_skills"))
    return base.join(orgs, "location_country").join(keys, "location_country", "left").select(
        F.col("location_country").alias("country"), "total_postings", "organizations", "first_posted", "last_posted", F.coalesce("unique_skills", F.lit(0).cast("long")).alias("unique_skills")
    )


def country_volumes(postings: DataFrame, months: int = 24) -> DataFrame:
    counts = postings.filter("location_country != ''").groupBy(F.col("location_country").alias("country"), scalars.posting_month(F.col("date_posted")).alias("month")).agg(F.count(F.lit(1)).alias("count")).filter("month is not null")
    newest = W.partitionBy("country").orderBy(F.desc("month"))
    return counts.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= months).drop("__r")


def _by_skill(skills: DataFrame, postings: DataFrame, column: Column, name: str) -> DataFrame:
    # All rows of a posting meet in one task, for the join and the distinct rows alike; tasks are more where rows are.
    dealt = skills.repartition(skew.tasks(skills), "position_id")
    rows = skills_with_postings(dealt, postings).filter("skill is not null").select(F.lower("skill").alias("skill"), column.alias(name), "position_id").filter(F.col(name).isNotNull())
    return rows.distinct().groupBy("skill", name).agg(F.count(F.lit(1)).alias("count"))


def skill_timelines(skills: DataFrame, postings: DataFrame) -> DataFrame:
    """skill_timeline of every skill; keys in lower case."""
    return _by_skill(skills, postings.select("position_id", "date_posted"), scalars.posting_month(F.col("date_posted")), "month")


def skill_countries(skills: DataFrame, postings: DataFrame, n: int = 20) -> DataFrame:
    """skill_country_breakdown of every skill."""
    counts = _by_skill(skills, postings.select("position_id", "location_country").filter("location_country != ''"), F.col("location_country"), "country")
    return top_per_group(counts, "skill", "count", "country", n)


def skill_details(skills: DataFrame, postings: DataFrame, related: int = 8) -> DataFrame:
    """skill_detail of every skill; keys in lower case.

    The related skills of all come from the ``related`` + 1 most frequent keys of each category, of
    which a skill leaves out itself. A category's keys are few, so they are joined as one array.
    """
    keyed = p.with_key(skills).filter("skill is not null").withColumn("key", F.lower("skill"))
    own = keyed.groupBy("key").agg(
        F.min("skill_esco_type").alias("type"), F.min("skill_category").alias("category"), F.min("skill_esco_uri").alias("uri"), F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("position_id").alias("postings"),
    )
    paid = _annual(skills, postings).groupBy(F.lower("skill").alias("key")).agg(F.round(F.avg("min_salary")).alias("avg_min_salary"), F.round(F.avg("max_salary")).alias("avg_max_salary"))
    counts = keyed.filter("skill_category is not null").groupBy(F.col("skill_category").alias("category"), "key").agg(F.count(F.lit(1)).alias("count"))
    best = top_per_group(counts, "category", "count", "key", related + 1).groupBy("category").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("key").alias("skill"), "count"))).alias("best"))
    others = F.slice(F.filter("best", lambda s: s["skill"] != F.col("key")), 1, related)
    listed = F.coalesce(F.transform(others, lambda s: F.struct(s["skill"].alias("skill"), s["count"].alias("count"))), F.array().cast("array<struct<skill:string,count:bigint>>"))
    return own.join(paid, "key", "left").join(best, "category", "left").withColumn("related", listed).drop("best").withColumnRenamed("key", "skill")
