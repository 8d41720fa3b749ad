"""Queries of the marts over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.operators import analytics as a
from labourmill.operators import predicates as pr
from labourmill.operators import textindex, upkeep
from labourmill.plans.views import AS_OF, duck, postings, skills, table
from labourmill.sources import scratch, storage

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str, more: str = ""):
    """Registers the function under its name with this DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql, more)
        return f

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    """To cents, with halves (give or take what sums of floats lose) always up."""
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 2) for c in columns})


def series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for some series, from the parts' names."""
    return table(spark, sf_dir, "part").filter("p_partkey % 60 < 40").groupBy(F.lpad((300 + F.col("p_partkey") % 60).cast("string"), 4, "0").alias("series_code")).agg(F.min("p_name").alias("name"))


NAMES = "names AS (SELECT lpad((300 + p_partkey % 60)::VARCHAR, 4, '0') AS series_code, min(p_name) AS name FROM part WHERE p_partkey % 60 < 40 GROUP BY 1)"


def collection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run a month and priority, from the orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("query"), F.date_format("o_orderdate", "yyyy-MM").alias("started_at")).agg(
        F.count(F.lit(1)).alias("jobs_collected"), F.max(F.when(F.col("o_orderkey") % 97 == 0, "error").otherwise("a_success")).alias("s")
    ).select("query", "started_at", "jobs_collected", F.when(F.col("s") == "error", "error").otherwise("success").alias("status"))


LOG = """log AS (SELECT o_orderpriority AS query, strftime(o_orderdate, '%Y-%m') AS started_at, count(*) AS jobs_collected,
  CASE WHEN bool_or(o_orderkey % 97 = 0) THEN 'error' ELSE 'success' END AS status FROM orders GROUP BY 1, 2)"""

ANNUAL = "salary_type = 'Per Year' AND min_salary > 20000"
PAID = f"paid AS (SELECT s.*, p.min_salary, p.max_salary FROM s JOIN p USING (position_id) WHERE {ANNUAL})"
COUNTRY = "EUROPE"


def _overview(service: bool) -> str:
    share = "sum(telework_eligible::INT) * 100.0 / greatest(count(*), 1)"
    week = f"count(*) FILTER (date_posted >= strftime(DATE '{AS_OF}' - 7, '%Y-%m-%d'))"
    return f"""SELECT count(*) AS total_jobs, count(DISTINCT organization) AS total_organizations,
      coalesce(round_even(avg(min_salary) FILTER ({ANNUAL}), 0), 0)::BIGINT AS avg_min_salary, coalesce(round_even(avg(max_salary) FILTER ({ANNUAL}), 0), 0)::BIGINT AS avg_max_salary,
      {f'round_even({share}, 1)' if service else share} AS remote_percentage, (SELECT count(DISTINCT skill_raw) FROM s) AS unique_skills,
      {f'CASE WHEN {week} = 0 THEN count(*) ELSE {week} END' if service else week} AS new_this_week FROM p"""


@query(_overview(True))
def A1_overview_service(spark: SparkSession, d: str) -> DataFrame:
    return a.overview(postings(spark, d), skills(spark, d), AS_OF)


@query(_overview(False))
def A1_overview_mart(spark: SparkSession, d: str) -> DataFrame:
    return a.overview(postings(spark, d), skills(spark, d), AS_OF, service=False)


@query("SELECT skill, min(skill_esco_type) AS type, min(skill_category) AS category, count(*) AS count FROM s WHERE skill_esco_label IS NOT NULL GROUP BY skill ORDER BY count DESC, skill LIMIT 20")
def A2_top_skills_mapped(spark: SparkSession, d: str) -> DataFrame:
    return a.top_skills_mapped(skills(spark, d))


def _title(column: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all(lower({column}), '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '')"


def _top(join: str, n: int) -> str:
    return f"""SELECT {_title('skill')} AS skill, count, coalesce(t, 'skill') AS type, coalesce(c, 'Other') AS category
    FROM (SELECT skill, min(skill_esco_type) AS t, min(skill_category) AS c, count(*) AS count FROM s {join} GROUP BY skill ORDER BY count DESC, skill LIMIT {n})"""


@query(_top("", 20))
def A3_top_skills(spark: SparkSession, d: str) -> DataFrame:
    return a.top_skills(skills(spark, d))


@query(_top(f"JOIN p USING (position_id) WHERE location_country = '{COUNTRY}'", 20))
def A3_top_skills_country(spark: SparkSession, d: str) -> DataFrame:
    return a.top_skills(skills(spark, d), postings(spark, d), COUNTRY)


@query("SELECT skill_category AS category, round(avg(min_salary)) AS avg_min, round(avg(max_salary)) AS avg_max, count(DISTINCT position_id) AS postings FROM paid WHERE skill_category IS NOT NULL GROUP BY 1", PAID)
def A4_category_salary(spark: SparkSession, d: str) -> DataFrame:
    return a.category_salary(skills(spark, d), postings(spark, d))


DEMAND = "counts AS (SELECT skill_category AS category, skill, count(*) AS count FROM s WHERE skill_category IS NOT NULL GROUP BY ALL), demand AS (SELECT category, sum(count)::BIGINT AS total FROM counts GROUP BY 1)"


@query(
    "SELECT category, total, r::INT AS rank, skill, count FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, skill) AS r FROM counts) JOIN demand USING (category) WHERE r <= 5", DEMAND
)
def A5_skill_demand(spark: SparkSession, d: str) -> DataFrame:
    nested = a.skill_demand(skills(spark, d))
    return nested.select("category", "total", F.posexplode("skills").alias("i", "s")).select("category", "total", (F.col("i") + 1).alias("rank"), "s.skill", "s.count")


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY organization ORDER BY n DESC, title)::INT AS rank FROM (SELECT organization, title, count(*) AS n FROM p GROUP BY ALL)) WHERE rank <= 3")
def W1_top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent titles of each organization."""
    counts = postings(spark, d).groupBy("organization", "title").agg(F.count(F.lit(1)).alias("n"))
    return a.top_per_group(counts, "organization", "n", "title", 3).select("organization", "title", "n", "rank")


@query(
    """SELECT skill, min(skill_esco_type) AS type, min(skill_category) AS category, round(avg(min_salary)) AS avg_min_salary, round(avg(max_salary)) AS avg_max_salary,
    count(DISTINCT position_id) AS postings FROM paid GROUP BY skill HAVING count(DISTINCT position_id) > 30 ORDER BY avg_min_salary DESC, skill LIMIT 20""", PAID
)
def A6_skill_roi(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_roi(skills(spark, d), postings(spark, d))


def _salaries(column: str, tail: str) -> str:
    return f"""SELECT label, count, round(avg_min + 1e-7, 2) AS avg_min, round(avg_max + 1e-7, 2) AS avg_max FROM (
    SELECT {column} AS label, count(*) AS count, avg(min_salary) AS avg_min, avg(max_salary) AS avg_max FROM p WHERE min_salary > 0 AND {column} <> '' GROUP BY 1 {tail})"""


for _dim, (_column, _limit, _least) in a.SALARY_DIMENSIONS.items():
    _tail = (f"HAVING count(*) > {_least} " if _least is not None else "") + "ORDER BY avg_max DESC, label" + (f" LIMIT {_limit}" if _limit else "")

    def _run(spark: SparkSession, d: str, dim: str = _dim) -> DataFrame:
        names = series_names(spark, d) if dim == "series" else None
        return _round(a.salaries_by(postings(spark, d), dim, names), "avg_min", "avg_max")

    QUERIES[f"A7_salaries_by_{_dim}"] = _run
    _sql = _salaries(_column, _tail)
    ORACLES[f"A7_salaries_by_{_dim}"] = duck(
        f"SELECT coalesce(name, label) AS label, count, avg_min, avg_max FROM ({_sql}) LEFT JOIN names ON series_code = label" if _dim == "series" else _sql, NAMES
    )


@query("SELECT location_state, count(*) AS count, round(avg(max_salary) + 1e-7, 2) AS avg_max_salary, sum(telework_eligible::INT)::BIGINT AS remote_count FROM p WHERE location_state <> '' GROUP BY 1 ORDER BY count DESC, 1 LIMIT 20")
def A8_locations(spark: SparkSession, d: str) -> DataFrame:
    return _round(a.locations(postings(spark, d)), "avg_max_salary")


@query("SELECT substr(date_posted, 1, 7) AS month, count(*) AS count FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def A9_posting_volume(spark: SparkSession, d: str) -> DataFrame:
    return a.posting_volume(postings(spark, d))


@query("SELECT location_country AS country, count(*) AS count FROM p GROUP BY 1")
def A10_available_countries(spark: SparkSession, d: str) -> DataFrame:
    return a.available_countries(postings(spark, d))


SKILL = "(SELECT min(skill_esco_label) FROM s)"


def _skill(spark: SparkSession, d: str) -> str:
    """A skill that the tables have, as a user would type it."""
    return skills(spark, d).agg(F.min("skill_esco_label")).first()[0].upper()


@query(f"SELECT substr(date_posted, 1, 7) AS month, count(DISTINCT position_id) AS count FROM s JOIN p USING (position_id) WHERE lower(skill) = lower({SKILL}) AND location_country = '{COUNTRY}' GROUP BY 1")
def A11_skill_timeline(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_timeline(skills(spark, d), postings(spark, d), _skill(spark, d), COUNTRY)


@query(
    f"""SELECT count(*) AS total_postings, count(DISTINCT organization) AS organizations, min(date_posted) AS first_posted, max(date_posted) AS last_posted,
    (SELECT count(DISTINCT skill) FROM s JOIN p USING (position_id) WHERE location_country = '{COUNTRY}') AS unique_skills FROM p WHERE location_country = '{COUNTRY}'"""
)
def A12_country_stats(spark: SparkSession, d: str) -> DataFrame:
    return a.country_stats(skills(spark, d), postings(spark, d), COUNTRY)


@query(
    """SELECT country, organizations, unique_skills, true AS organizations_close, true AS skills_close FROM (SELECT location_country AS country, count(DISTINCT organization) AS organizations FROM p GROUP BY 1)
    LEFT JOIN (SELECT location_country AS country, count(DISTINCT skill) AS unique_skills FROM s JOIN p USING (position_id) GROUP BY 1) USING (country)"""
)
def A12_distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The exact counts of each country, and whether those merged from its days' sketches are within 3 % of them."""
    p, s = postings(spark, d), skills(spark, d)
    exact = p.groupBy(F.col("location_country").alias("country")).agg(F.countDistinct("organization").alias("organizations"))
    of_skills = a.skills_with_postings(s, p, "location_country").groupBy(F.col("location_country").alias("country")).agg(F.countDistinct("skill").alias("unique_skills"))
    about = a.distinct_estimates(scratch.kept(a.distinct_sketches(s, p)), "country").select("country", F.col("organizations").alias("o"), F.col("unique_skills").alias("u"))
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 0.03 * F.col(y)
    both = exact.join(of_skills, "country", "left").join(about, "country", "left")
    return both.select("country", "organizations", "unique_skills", close("o", "organizations").alias("organizations_close"), close("u", "unique_skills").alias("skills_close"))


@query(f"SELECT location_country AS country, count(DISTINCT position_id) AS count FROM s JOIN p USING (position_id) WHERE lower(skill) = lower({SKILL}) GROUP BY 1 ORDER BY count DESC, 1 LIMIT 20")
def A13_skill_country_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_country_breakdown(skills(spark, d), postings(spark, d), _skill(spark, d))


@query(
    f"""SELECT o.*, m.avg_min_salary, m.avg_max_salary, rel.related FROM
    (SELECT min(skill) AS skill, min(skill_esco_type) AS type, min(skill_category) AS category, min(skill_esco_uri) AS uri, count(*) AS occurrences, count(DISTINCT position_id) AS postings FROM s WHERE lower(skill) = lower({SKILL})) o,
    (SELECT round(avg(min_salary)) AS avg_min_salary, round(avg(max_salary)) AS avg_max_salary FROM paid WHERE lower(skill) = lower({SKILL})) m,
    (SELECT string_agg(skill || '=' || n, ';' ORDER BY n DESC, skill) AS related FROM (SELECT skill, count(*) AS n FROM s
      WHERE lower(skill) <> lower({SKILL}) AND skill_category = (SELECT min(skill_category) FROM s WHERE lower(skill) = lower({SKILL})) GROUP BY skill ORDER BY n DESC, skill LIMIT 8)) rel""", PAID
)
def A14_skill_detail(spark: SparkSession, d: str) -> DataFrame:
    one = a.skill_detail(skills(spark, d), postings(spark, d), _skill(spark, d))
    return one.withColumn("related", F.array_join(F.transform("related", lambda s: F.concat(s["skill"], F.lit("="), s["count"].cast("string"))), ";"))


CATEGORY = "PROMO"


@query("SELECT skill, min(skill_esco_type) AS type, min(skill_esco_uri) AS uri, count(*) AS count FROM s WHERE skill_category = (SELECT max(p_type) FROM part) GROUP BY 1 ORDER BY count DESC, skill LIMIT 20")
def A15_skills_by_category(spark: SparkSession, d: str) -> DataFrame:
    return a.skills_by_category(skills(spark, d), table(spark, d, "part").agg(F.max("p_type")).first()[0])


SUMMARY = """summary AS (SELECT series_code, count(*) AS total_postings, coalesce(round_even(avg(max_salary), 0), 0)::BIGINT AS avg_salary,
  round_even(sum(telework_eligible::INT) * 100.0 / count(*), 1) AS remote_percentage FROM p WHERE series_code <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""


@query("SELECT summary.*, coalesce(name, series_code) AS series_name FROM summary LEFT JOIN names USING (series_code)", f"{SUMMARY}, {NAMES}")
def A16_categories_summary(spark: SparkSession, d: str) -> DataFrame:
    return a.categories_summary(postings(spark, d), series_names(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (series_code <> '') AS with_series, round_even(count(*) FILTER (series_code <> '') * 100.0 / count(*), 1) AS coverage FROM p")
def A16_series_coverage(spark: SparkSession, d: str) -> DataFrame:
    return a.series_coverage(postings(spark, d))


QUERIES["F11_series_name"], ORACLES["F11_series_name"] = (
    lambda spark, d: a.series_name(postings(spark, d).select("position_id", "series_code"), "series_code", series_names(spark, d)),
    duck("SELECT position_id, series_code, coalesce(name, series_code) AS series_name FROM p LEFT JOIN names USING (series_code)", NAMES),
)


@query("SELECT * FROM log ORDER BY started_at DESC, query LIMIT 20", LOG)
def A17_collection_status(spark: SparkSession, d: str) -> DataFrame:
    return a.collection_status(collection_log(spark, d))


@query(
    """SELECT count(*) AS total_postings, count(*) FILTER (job_type = 'Federal') AS federal, count(*) FILTER (job_type = 'Private') AS private, count(*) FILTER (job_type = 'State') AS state,
    count(*) FILTER (job_type = 'Non-Profit') AS non_profit, count(DISTINCT organization) AS unique_orgs, (SELECT count(DISTINCT skill_raw) FROM s) AS unique_skills,
    (SELECT count(*) FROM log WHERE status = 'error') AS errors FROM p""", LOG
)
def A18_collector_stats(spark: SparkSession, d: str) -> DataFrame:
    return a.collector_stats(postings(spark, d), skills(spark, d), collection_log(spark, d))


def _json(rows: str, column: str, name: str) -> str:
    return f"(SELECT '[' || string_agg('{{\"{name}\":\"' || k || '\",\"count\":' || n || '}}', ',' ORDER BY n DESC, k) || ']' FROM (SELECT {column} AS k, count(*) AS n FROM {rows} GROUP BY 1 ORDER BY n DESC, k LIMIT 20))"


@query(
    f"""SELECT job_type, count(*) AS total_postings, round(avg(min_salary) + 1e-7, 2) AS avg_min_salary, round(avg(max_salary) + 1e-7, 2) AS avg_max_salary, sum(telework_eligible::INT) * 100.0 / count(*) AS remote_percentage,
    sum(total_openings)::BIGINT AS total_openings, {_json('s', 'skill_raw', 'skill')} AS top_skills, {_json('p', 'location_state', 'state')} AS top_locations, '{AS_OF}' AS snapshot_date FROM p GROUP BY 1"""
)
def A19_market_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _round(a.market_snapshot(postings(spark, d), skills(spark, d), AS_OF), "avg_min_salary", "avg_max_salary")


@query("SELECT job_type, '2001-07-01' AS day, total_postings, total_openings FROM kinds UNION ALL SELECT job_type, '2001-08-01', total_postings, total_openings FROM kinds", "kinds AS (SELECT job_type, count(*) AS total_postings, sum(total_openings)::BIGINT AS total_openings FROM p GROUP BY 1)")
def create_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of two days in one table; a second run of a day replaces its rows and no others."""
    path = scratch.folder(spark)
    for day in ("2001-07-01", AS_OF, AS_OF):
        storage.write_snapshot(a.market_snapshot(postings(spark, d), skills(spark, d), day), path)
    return spark.read.parquet(path).select("job_type", F.col("snapshot_date").cast("string").alias("day"), "total_postings", "total_openings")


@query("SELECT skill_raw, count(*) AS count FROM s WHERE coalesce(skill_esco_uri, '') = '' AND skill_raw <> '' GROUP BY 1")
def A20_unmapped_skill_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.unmapped_skill_counts(skills(spark, d))


TOP100 = f"top AS ({_top('', 100)})"
BUCKET = "CASE WHEN contains(lower(type), 'knowledge') THEN 'knowledge' WHEN contains(lower(type), 'skill') THEN 'skill' WHEN contains(lower(type), 'competence') THEN 'competence' ELSE 'other' END"


@query(f"SELECT {BUCKET} AS bucket, sum(count)::BIGINT AS occurrences, count(*) AS skills FROM top GROUP BY 1", TOP100)
def A24_skill_type_share(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_type_share(a.top_skills(skills(spark, d), n=100))


@query("SELECT floor(count(*) FILTER (type IN ('knowledge', 'competence')) * 100.0 / count(*) + 0.5)::BIGINT AS match_rate FROM top", TOP100)
def A24_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return a.match_rate(a.top_skills(skills(spark, d), n=100))


@query("SELECT category, sum(count)::BIGINT AS count FROM top GROUP BY 1", f"top AS ({_top('', 20)})")
def A25_category_share_of_top(spark: SparkSession, d: str) -> DataFrame:
    return a.category_share_of_top(a.top_skills(skills(spark, d)))


@query("SELECT location_state, floor(sum(telework_eligible::INT) * 100.0 / count(*) + 0.5)::BIGINT AS percentage FROM p WHERE location_state <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
def A26_remote_share_by_state(spark: SparkSession, d: str) -> DataFrame:
    return a.remote_share_by_state(postings(spark, d))


@query("SELECT series_code, total_postings, total_postings / max(total_postings) OVER () * 100.0 AS index FROM (SELECT * FROM summary ORDER BY total_postings DESC, series_code LIMIT 8)", SUMMARY)
def A27_category_relative_index(spark: SparkSession, d: str) -> DataFrame:
    return a.category_relative_index(a.categories_summary(postings(spark, d), series_names(spark, d)))


@query("SELECT skill, count, count / max(count) OVER () * 100.0 AS pct FROM (SELECT skill, count(*) AS count FROM s WHERE skill_category = (SELECT max(p_type) FROM part) GROUP BY 1 ORDER BY count DESC, skill LIMIT 20)")
def W4_pct_of_max(spark: SparkSession, d: str) -> DataFrame:
    """The skills of one category against its most frequent one."""
    top = a.skills_by_category(skills(spark, d), table(spark, d, "part").agg(F.max("p_type")).first()[0]).select("skill", "count")
    return a.pct_of_max(top, "count", "pct")


@query("SELECT category, total, total * 100.0 / sum(total) OVER () AS share FROM demand", DEMAND)
def W3_share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return a.share_of_total(a.skill_demand(skills(spark, d)).select("category", "total"), "total", "share")


@query(
    """SELECT 'DOMINANT CATEGORY' AS card, round_even(total * 100.0 / (SELECT sum(total) FROM demand), 0)::BIGINT || '%' AS value, category AS note FROM (SELECT * FROM demand ORDER BY total DESC, category LIMIT 1)
    UNION ALL SELECT 'SKILL CATEGORIES', count(*)::VARCHAR, '' FROM demand
    UNION ALL SELECT 'IT & TECH SHARE', round_even(total * 100.0 / (SELECT sum(total) FROM demand), 0)::BIGINT || '%', category
      FROM (SELECT * FROM demand WHERE contains(category, 'IT') OR contains(category, 'Tech') ORDER BY total DESC, category LIMIT 1)""", DEMAND
)
def A28_insight_cards(spark: SparkSession, d: str) -> DataFrame:
    return a.insight_cards(a.skill_demand(skills(spark, d)))


@query(
    """SELECT unnest([{'label': 'JOB POSTINGS', 'val': (total_jobs // 1000) || 'K+'}, {'label': 'ESCO SKILLS', 'val': unique_skills::VARCHAR}, {'label': 'ORGANIZATIONS', 'val': total_organizations::VARCHAR},
    {'label': 'REMOTE ELIGIBLE', 'val': round_even(remote_percentage, 0)::BIGINT || '%'}, {'label': 'AVG SALARY RANGE', 'val': '$' || round_even(avg_min_salary / 1000, 0)::BIGINT || 'K–$' || round_even(avg_max_salary / 1000, 0)::BIGINT || 'K'},
    {'label': 'NEW THIS WEEK', 'val': new_this_week::VARCHAR}], recursive := true) FROM one""", f"one AS ({_overview(True)})"
)
def A29_hero_cards(spark: SparkSession, d: str) -> DataFrame:
    return a.hero_cards(a.overview(postings(spark, d), skills(spark, d), AS_OF))


@query(
    """SELECT p.location_country AS country, count(*) AS total_postings, count(DISTINCT organization) AS organizations, min(date_posted) AS first_posted, max(date_posted) AS last_posted, any_value(k.n) AS unique_skills
    FROM p JOIN (SELECT location_country, count(DISTINCT skill) AS n FROM s JOIN p USING (position_id) GROUP BY 1) k ON k.location_country = p.location_country GROUP BY 1"""
)
def A30_country_marts(spark: SparkSession, d: str) -> DataFrame:
    return a.country_marts(skills(spark, d), postings(spark, d))


@query(
    """SELECT p.location_country AS country, count(*) AS total_postings, count(DISTINCT organization) AS organizations, min(date_posted) AS first_posted, max(date_posted) AS last_posted, any_value(k.n) AS unique_skills
    FROM p JOIN (SELECT location_country, count(DISTINCT skill) AS n FROM s JOIN p USING (position_id) GROUP BY 1) k ON k.location_country = p.location_country GROUP BY 1"""
)
def A30_country_marts_kept_up(spark: SparkSession, d: str) -> DataFrame:
    """The counts begin without every tenth posting and with an older state of every seventh; both then change."""
    p, s, path = postings(spark, d), skills(spark, d), scratch.folder(spark)
    number = F.col("position_id").cast("long")
    older = p.filter(number % 7 == 0).withColumns({"organization": F.lit("before"), "date_posted": F.lit("1900-01-01")})
    upkeep.keep_counts(path, (s, p.filter((number % 10 != 0) & (number % 7 != 0)).unionByName(older)), (s.limit(0), p.limit(0)), 0, 16)
    upkeep.keep_counts(path, (s, p.filter((number % 10 == 0) | (number % 7 == 0))), (s, older), 1)
    return upkeep.country_marts(spark, path)


@query("SELECT country, month, count FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY month DESC) AS r FROM (SELECT location_country AS country, substr(date_posted, 1, 7) AS month, count(*) AS count FROM p GROUP BY ALL)) WHERE r <= 24")
def A30_country_volumes(spark: SparkSession, d: str) -> DataFrame:
    return a.country_volumes(postings(spark, d))


@query("SELECT lower(skill) AS skill, substr(date_posted, 1, 7) AS month, count(DISTINCT position_id) AS count FROM s JOIN p USING (position_id) GROUP BY ALL")
def A30_skill_timelines(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_timelines(skills(spark, d), postings(spark, d))


@query(
    "SELECT skill, country, count, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY count DESC, country) AS r FROM (SELECT lower(skill) AS skill, location_country AS country, count(DISTINCT position_id) AS count FROM s JOIN p USING (position_id) GROUP BY ALL)) WHERE r <= 20"
)
def A30_skill_countries(spark: SparkSession, d: str) -> DataFrame:
    return a.skill_countries(skills(spark, d), postings(spark, d))


@query(
    """SELECT o.*, m.avg_min_salary, m.avg_max_salary, coalesce((SELECT string_agg(k || '=' || n, ';' ORDER BY n DESC, k) FROM (SELECT k, n FROM (SELECT skill_category, lower(skill) AS k, count(*) AS n FROM s GROUP BY ALL)
      WHERE skill_category = o.category AND k <> o.skill ORDER BY n DESC, k LIMIT 8)), '') AS related FROM (SELECT lower(skill) AS skill, min(skill_esco_type) AS type, min(skill_category) AS category, min(skill_esco_uri) AS uri, count(*) AS occurrences,
    count(DISTINCT position_id) AS postings FROM s GROUP BY 1) o LEFT JOIN (SELECT lower(skill) AS skill, round(avg(min_salary)) AS avg_min_salary, round(avg(max_salary)) AS avg_max_salary FROM paid GROUP BY 1) m USING (skill)""", PAID
)
def A30_skill_details(spark: SparkSession, d: str) -> DataFrame:
    every = a.skill_details(skills(spark, d), postings(spark, d))
    return every.withColumn("related", F.array_join(F.transform("related", lambda s: F.concat(s["skill"], F.lit("="), s["count"].cast("string"))), ";"))


@query("SELECT position_id, title, organization, location_state, location_country, min_salary, max_salary, date_posted FROM p ORDER BY date_posted DESC, position_id LIMIT 20")
def T1_recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    return a.recent_jobs(postings(spark, d), ["position_id", "title", "organization", "location_state", "location_country", "min_salary", "max_salary", "date_posted"])


@query("SELECT position_id, title, date_posted FROM p WHERE title ILIKE '%not%fied%' ORDER BY date_posted DESC, position_id LIMIT 20")
def T1_keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """The latest postings with a keyword in the title, by the titles' grams."""
    path, rows = scratch.folder(spark), postings(spark, d)
    textindex.add(rows, path, "position_id", "title")
    return a.recent_jobs(textindex.keyword_search(rows, path, "position_id", "Not%fied", "title"), ["position_id", "title", "date_posted"])


@query(f"SELECT position_id, min_salary FROM p WHERE {ANNUAL}")
def P1_annual_salary(spark: SparkSession, d: str) -> DataFrame:
    return pr.annual_salary(postings(spark, d)).select("position_id", "min_salary")


@query("SELECT position_id, series_code FROM p WHERE min_salary > 0 AND series_code <> ''")
def P2_has_salary_and_group(spark: SparkSession, d: str) -> DataFrame:
    return pr.has_salary_and_group(postings(spark, d), "series_code").select("position_id", "series_code")


@query("SELECT conv_id, turn, text FROM conversations WHERE text ILIKE '%th_t%'")
def P3_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return pr.keyword_search(table(spark, d, "conversations"), "TH_T", "text").select("conv_id", "turn", "text")


@query("SELECT doc_id, text FROM documents WHERE text ILIKE '%oire%viré%'")
def P3_keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """A keyword in texts, by their grams."""
    path, rows = scratch.folder(spark), table(spark, d, "documents").select("doc_id", "text")
    textindex.add(rows, path, "doc_id", "text")
    return textindex.keyword_search(rows, path, "doc_id", "OIRE%VIRÉ", "text")


@query(f"SELECT position_id, date_posted FROM p WHERE date_posted >= strftime(DATE '{AS_OF}' - 7, '%Y-%m-%d')")
def P4_recent_window(spark: SparkSession, d: str) -> DataFrame:
    return pr.recent_window(postings(spark, d), AS_OF).select("position_id", "date_posted")


@query(f"SELECT position_id, location_country FROM p WHERE location_country = '{COUNTRY}'")
def P5_country_filter(spark: SparkSession, d: str) -> DataFrame:
    return pr.country_filter(postings(spark, d), COUNTRY).select("position_id", "location_country")


@query(f"SELECT position_id, skill FROM s WHERE lower(skill) = lower({SKILL})")
def P6_skill_match(spark: SparkSession, d: str) -> DataFrame:
    return pr.skill_match(pr.with_key(skills(spark, d)), _skill(spark, d)).select("position_id", "skill")


@query("SELECT position_id, skill_raw FROM s WHERE skill_esco_uri IS NULL")
def P7_unmapped(spark: SparkSession, d: str) -> DataFrame:
    return pr.unmapped(skills(spark, d)).select("position_id", "skill_raw")


@query("SELECT skill, count FROM (SELECT skill, count(*) AS count FROM s GROUP BY 1 ORDER BY count DESC, skill LIMIT 300) WHERE contains(lower(skill), 'use') ORDER BY count DESC, skill LIMIT 10")
def P9_skill_suggest(spark: SparkSession, d: str) -> DataFrame:
    counts = pr.with_key(skills(spark, d)).groupBy("skill").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "skill").limit(300)
    return pr.skill_suggest(counts, "Use")


@query("SELECT month, count FROM (SELECT substr(date_posted, 1, 7) AS month, count(*) AS count FROM p GROUP BY 1 ORDER BY 1 DESC LIMIT 24) WHERE count > 10")
def P10_min_volume(spark: SparkSession, d: str) -> DataFrame:
    return pr.min_volume(a.posting_volume(postings(spark, d)))


@query("SELECT position_id, skill, min_salary, date_posted FROM s JOIN p USING (position_id)")
def J1_skills_with_postings(spark: SparkSession, d: str) -> DataFrame:
    return a.skills_with_postings(skills(spark, d), postings(spark, d), "min_salary", "date_posted").select("position_id", "skill", "min_salary", "date_posted")


@query("SELECT position_id, skill, min_salary, date_posted FROM s JOIN p USING (position_id)")
def J1_bucketed_facts(spark: SparkSession, d: str) -> DataFrame:
    """J1 over both facts as bucketed tables, which meet without a shuffle."""
    name = f"facts_{uuid.uuid4().hex}"
    s = storage.save_bucketed(skills(spark, d).drop("skill"), f"{name}_s", scratch.folder(spark), 16)
    p = storage.save_bucketed(postings(spark, d), f"{name}_p", scratch.folder(spark), 16)
    return a.skills_with_postings(s, p, "min_salary", "date_posted").select("position_id", "skill", "min_salary", "date_posted")
