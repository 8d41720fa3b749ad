"""Landed JSON of three job feeds, made into rows of postings.

Each feed has a reader (files) and a normaliser (a DataFrame with the feed's struct columns, from
files, a stream or from_json). Normalisers only project: no shuffle, and they run on streams.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.functions import scalars
from labourmill.sources import schemas

_COLUMNS = [part.strip().split(" ") for part in schemas.POSTING.split(",")]
_EMPTY = {"string": "", "double": 0.0, "boolean": False, "int": 1}


def _posting(rows: DataFrame, values: dict[str, Column], *more: str) -> DataFrame:
    """All columns of a posting: those given, the others at their defaults."""
    return rows.select(*[values.get(n, F.lit(_EMPTY[t])).cast(t).alias(n) for n, t in _COLUMNS], *more)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _list_or_text(c: Column, separator: str, keep_empty: bool) -> Column:
    """A JSON list's items joined; other text as it is."""
    return F.when(c.startswith("["), scalars.join_list(F.from_json(c, "array<string>"), separator, keep_empty)).otherwise(_text(c))


def normalize_federal(pages: DataFrame) -> DataFrame:
    """Feed A, with its extracted skills (array ``required_skills``). Of lists the first item counts."""
    item = pages.select(F.explode("SearchResult.SearchResultItems").alias("i")).select("i.MatchedObjectDescriptor.*")
    place, pay, area = F.get("PositionLocation", F.lit(0)), F.get("PositionRemuneration", F.lit(0)), F.col("UserArea.Details")
    code = _text(F.get("JobCategory", F.lit(0))["Code"])
    who = area["WhoMayApply"]
    duties = _list_or_text(area["MajorDuties"], " | ", False)
    values = {
        "position_id": _text(F.col("PositionID")), "title": _text(F.col("PositionTitle")), "organization": _text(F.col("OrganizationName")), "department": _text(F.col("DepartmentName")),
        "location_city": _text(place["CityName"]), "location_state": _text(place["CountrySubDivisionCode"]), "location_country": scalars.country_to_iso(place["CountryCode"]),
        "min_salary": _number(pay["MinimumRange"]), "max_salary": _number(pay["MaximumRange"]), "salary_type": F.coalesce(pay["Description"], F.lit("Per Year")),
        "job_grade": _text(F.get("JobGrade", F.lit(0))["Code"]), "series_code": code, "series_group": scalars.series_group(code), "qualification_summary": _text(F.col("QualificationSummary")),
        "major_duties": duties, "education_requirements": _text(area["Education"]), "travel_percentage": _text(area["TravelCode"]), "telework_eligible": scalars.to_bool(area["TeleworkEligible"]),
        "date_posted": _text(F.col("PublicationStartDate")), "date_closing": _text(F.col("ApplicationCloseDate")), "url": _text(F.col("PositionURI")),
        "who_may_apply": F.when(who.startswith("{"), _text(F.get_json_object(who, "$.Name"))).otherwise(_text(who)), "hiring_path": _list_or_text(area["HiringPath"], ", ", True),
        "total_openings": scalars.to_int(area["TotalOpenings"]), "job_type": scalars.classify_employer(F.col("OrganizationName")),
    }
    text = F.concat_ws(" ", _text(F.col("QualificationSummary")), duties, _text(F.col("PositionTitle")))
    return _posting(item, values, scalars.extract_skills(text).alias("required_skills"))


def normalize_board(pages: DataFrame) -> DataFrame:
    """Feed B; ``pages`` also has the ``country`` that was asked for. Rows without id go."""
    rows = pages.select("country", F.explode("results").alias("r")).select("country", "r.*").filter("id != ''")
    area = F.col("location.area")
    values = {
        "position_id": F.col("id"), "title": F.col("title"), "organization": _text(F.col("company.display_name")), "department": _text(F.col("category.label")),
        "location_city": _text(F.col("location.display_name")), "location_state": _text(F.get(area, F.size(area) - 1)), "location_country": F.upper("country"),
        "min_salary": F.coalesce("salary_min", F.lit(0.0)), "max_salary": F.coalesce("salary_max", F.lit(0.0)), "salary_type": F.lit("Per Year"), "series_code": _text(F.col("category.tag")),
        "qualification_summary": _text(F.col("description")), "date_posted": _text(F.col("created")), "url": _text(F.col("redirect_url")), "hiring_path": _text(F.col("contract_time")), "job_type": F.lit("Private"),
    }
    return _posting(rows, values)


def normalize_aggregator(pages: DataFrame, name: str = "jooble", country: str = "UA") -> DataFrame:
    """Feed C. Blank ids go; titles and snippets lose their tags; the salary text is parsed."""
    rows = pages.select(F.explode("jobs").alias("j")).select("j.*").withColumn("id", scalars.strip(_text(F.col("id")))).filter("id != ''")
    rows = rows.withColumn("pay", scalars.parse_salary_range(F.col("salary")))
    title, updated = scalars.strip_html(F.col("title")), F.col("updated")
    values = {
        "position_id": F.concat(F.lit(f"{name}_"), "id"), "title": title, "organization": _text(F.col("company")), "location_city": _text(F.col("location")), "location_country": F.lit(country),
        "min_salary": F.col("pay.min"), "max_salary": F.col("pay.max"), "salary_type": scalars.salary_basis(F.col("pay.min")),
        "qualification_summary": scalars.strip(F.concat(title, F.lit(" "), scalars.strip_html(F.col("snippet")))),
        "date_posted": F.when(F.length(updated) >= 10, F.substring(updated, 1, 10)).otherwise(""), "url": _text(F.col("link")), "hiring_path": _text(F.col("type")), "job_type": F.lit(name.capitalize()),
    }
    return _posting(rows, values)


# A file is one page, or (not multi_line) a page a line.


def read_federal_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return normalize_federal(spark.read.schema(schemas.FEDERAL).option("multiLine", multi_line).json(path))


def read_board_json(spark: SparkSession, path: str, country: str, multi_line: bool = True) -> DataFrame:
    return normalize_board(spark.read.schema(schemas.BOARD).option("multiLine", multi_line).json(path).withColumn("country", F.lit(country)))


def read_aggregator_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return normalize_aggregator(spark.read.schema(schemas.AGGREGATOR).option("multiLine", multi_line).json(path))


def unify_feeds(*feeds: DataFrame) -> DataFrame:
    """One table of postings with ``feed`` (its number) of each row."""
    names = [n for n, _ in _COLUMNS]
    return reduce(DataFrame.unionByName, [f.select(*names).withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)])
