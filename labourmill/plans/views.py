"""The driver's tables seen as job postings and job skills, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Last order date: the day on which windowed marts are taken.
AS_OF = "2001-08-01"

_POSTINGS = """
SELECT CAST(o.o_orderkey AS {text}) AS position_id, o.o_orderpriority AS title, c.c_name AS organization, c.c_mktsegment AS department,
  '' AS location_city, n.n_name AS location_state, r.r_name AS location_country, o.o_totalprice * 0.25 AS min_salary, o.o_totalprice * 0.5 AS max_salary,
  CASE WHEN o.o_orderstatus = 'P' THEN 'Per Month' ELSE 'Per Year' END AS salary_type, o.o_orderpriority AS job_grade,
  CASE WHEN o.o_orderkey % 11 = 0 THEN '' ELSE lpad(CAST(300 + o.o_orderkey % 60 AS {text}), 4, '0') END AS series_code,
  (o.o_orderkey % 3 = 0) AS telework_eligible, {day} AS date_posted, CAST(1 + o.o_orderkey % 5 AS INT) AS total_openings,
  CASE o.o_orderstatus WHEN 'F' THEN 'Federal' WHEN 'O' THEN 'Private' ELSE 'State' END AS job_type
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""
_SKILLS = """
SELECT CAST(l.l_orderkey AS {text}) AS position_id, p.p_name AS skill_raw,
  CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE concat('https://example.org/skill/', CAST(p.p_size % 40 AS {text})) END AS skill_esco_uri,
  CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE concat('use ', p.p_name) END AS skill_esco_label,
  CASE WHEN l.l_returnflag = 'N' THEN NULL WHEN p.p_size % 3 = 0 THEN 'knowledge' ELSE 'skill/competence' END AS skill_esco_type,
  CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE p.p_type END AS skill_category
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""
DUCK_POSTINGS = _POSTINGS.format(text="VARCHAR", day="strftime(o.o_orderdate, '%Y-%m-%d')")
DUCK_SKILLS = _SKILLS.format(text="VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    frames = {name: table(spark, sf_dir, name) for name in names}
    for name in names:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **frames)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _POSTINGS.format(text="STRING", day="date_format(o.o_orderdate, 'yyyy-MM-dd')"), "orders", "customer", "nation", "region")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _SKILLS.format(text="STRING"), "lineitem", "part")


def duck(sql: str, more: str = "") -> str:
    """DuckDB SQL over the views P (postings), S (skills with the key ``skill``) and others."""
    extra = f", {more}" if more else ""
    return f"WITH RECURSIVE p AS ({DUCK_POSTINGS}), s AS (SELECT *, coalesce(skill_esco_label, skill_raw) AS skill FROM ({DUCK_SKILLS})){extra} {sql}"
