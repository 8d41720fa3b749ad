"""Row filters of the marts. Each takes and returns a DataFrame; all reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourmill.functions import scalars


def annual_salary(postings: DataFrame) -> DataFrame:
    return postings.filter((F.col("salary_type") == "Per Year") & (F.col("min_salary") > 20000))


def has_salary_and_group(postings: DataFrame, column: str) -> DataFrame:
    return postings.filter((F.col("min_salary") > 0) & (F.col(column) != ""))


def keyword_search(rows: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Rows with the keyword in any of the columns, in any case; % and _ are wildcards in it."""
    if not keyword:
        return rows
    pattern = "%" + keyword.replace("\\", "\\\\") + "%"
    found = F.lit(False)
    for c in columns or ("title", "qualification_summary"):
        found = found | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return rows.filter(found)


def recent_window(postings: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Posted within ``days`` of ``as_of`` (yyyy-MM-dd); dates are compared as texts."""
    return postings.filter(recent(as_of, days))


def recent(as_of: str, days: int = 7) -> Column:
    return F.col("date_posted") >= F.date_format(F.date_sub(F.lit(as_of).cast("date"), days), "yyyy-MM-dd")


def country_filter(rows: DataFrame, country: str | None) -> DataFrame:
    return rows if country in (None, "", "ALL") else rows.filter(F.col("location_country") == country)


def skill_match(rows: DataFrame, skill: str, key: str = "skill") -> DataFrame:
    return rows.filter(F.lower(F.col(key)) == skill.lower())


def unmapped(skills: DataFrame) -> DataFrame:
    return skills.filter((F.coalesce("skill_esco_uri", F.lit("")) == "") & (F.coalesce("skill_raw", F.lit("")) != ""))


def golden_filter(entries: DataFrame, category: str | None = None, skip_edges: bool = False, llm_only: bool = False) -> DataFrame:
    if llm_only:
        entries = entries.filter("llm_only = true")
    if skip_edges:
        entries = entries.filter("category is distinct from 'edge'")
    return entries.filter(F.col("category") == category) if category else entries


def skill_suggest(top: DataFrame, part: str, limit: int = 10) -> DataFrame:
    """Of ranked skills (skill, count) the first with the part in their names."""
    return top.filter(F.contains(F.lower("skill"), F.lit(part.lower()))).orderBy(F.desc("count"), "skill").limit(limit)


def min_volume(months: DataFrame, least: int = 10) -> DataFrame:
    return months.filter(F.col("count") > least)


def with_key(skills: DataFrame) -> DataFrame:
    """``skills`` with the display key ``skill``."""
    return skills.withColumn("skill", scalars.skill_key(F.col("skill_esco_label"), F.col("skill_raw")))
