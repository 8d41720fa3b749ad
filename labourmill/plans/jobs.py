"""Queries of functions, feeds, storage, taxonomy, matching, evaluation and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.functions import lookups, terms
from labourmill.functions import scalars as sc
from labourmill.operators import candidates as ca
from labourmill.operators import evaluation as ev
from labourmill.operators import matching as ma
from labourmill.operators import neighbours as nb
from labourmill.operators import predicates as pr
from labourmill.plans.views import AS_OF, duck, postings, skills, table
from labourmill.sources import feeds, keyed, schemas, scratch, skew, storage
from labourmill.sources import taxonomy as tx
from labourmill.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str = "", more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql, more)
        return f

    return add


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _first(text: str, lists: list[tuple[str, list[str]]]) -> str:
    cases = " ".join(f"WHEN len(list_filter({_list(parts)}, lambda w: contains({text}, w))) > 0 THEN '{value}'" for value, parts in lists)
    return f"CASE {cases} ELSE NULL END"


def _case(text: str, pairs: list[tuple[str, str]]) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dict(pairs).items()) + " ELSE NULL END"


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


# --- scalar functions


@query(f"SELECT page_id, {STRIP.format('''regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')''')} AS text FROM pages")
def F1_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sc.strip_html(F.col("html")).alias("text"))


PAY = """pay AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN floor(o_totalprice)::BIGINT || chr(160) || '000 – 1 ' || floor(o_totalprice / 7)::BIGINT || ' UAH' ELSE floor(o_totalprice)::BIGINT || ' UAH, 12' END AS t FROM orders),
  runs AS (SELECT o_orderkey, list_transform(regexp_extract_all(regexp_replace(t, '[' || chr(160) || ' ,]', '', 'g'), '[0-9]{3,}'), lambda x: x::DOUBLE) AS n FROM pay)"""


def _pay(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda c: F.floor(c).cast("string")
    text = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", F.concat(whole(F.col("o_totalprice")), F.lit(" 000 – 1 "), whole(F.col("o_totalprice") / 7), F.lit(" UAH")))
    return table(spark, d, "orders").select("o_orderkey", sc.parse_salary_range(text.otherwise(F.concat(whole(F.col("o_totalprice")), F.lit(" UAH, 12")))).alias("r"))


@query("SELECT o_orderkey, coalesce(list_min(n), 0) AS min, coalesce(list_max(n), 0) AS max FROM runs", PAY)
def F2_parse_salary_range(spark: SparkSession, d: str) -> DataFrame:
    return _pay(spark, d).select("o_orderkey", "r.*")


@query("SELECT o_orderkey, CASE WHEN coalesce(list_min(n), 0) <> 0 THEN 'Per Month' ELSE 'Per Year' END AS basis FROM runs", PAY)
def F17_salary_basis(spark: SparkSession, d: str) -> DataFrame:
    return _pay(spark, d).select("o_orderkey", sc.salary_basis(F.col("r.min")).alias("basis"))


@query(f"SELECT c_custkey, substr(coalesce({_case('lower(n_name)', lookups.COUNTRIES)}, upper(n_name)), 1, 2) AS iso FROM customer JOIN nation ON c_nationkey = n_nationkey")
def F3_country_to_iso(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", sc.country_to_iso(F.col("n_name")).alias("iso"))


@query("SELECT position_id, CASE WHEN length(series_code) >= 4 THEN substr(series_code, 1, 2) || '00' ELSE '' END AS series_group FROM p")
def F4_series_group(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("position_id", sc.series_group(F.col("series_code")).alias("series_group"))


@query("SELECT position_id, array_to_string(list_filter([department, location_city, location_state], lambda x: x <> ''), ' | ') AS joined FROM p")
def F5_join_list(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("position_id", sc.join_list(F.array("department", "location_city", "location_state"), " | ").alias("joined"))


@query("SELECT o_orderkey, coalesce(lower(CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'YES' ELSE 'no' END) IN ('true', 'yes', '1'), false) AS flag FROM orders")
def F6_to_bool(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "YES").otherwise("no")
    return table(spark, d, "orders").select("o_orderkey", sc.to_bool(text).alias("flag"))


@query("SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS INT), 1) AS n, 1 AS default_n FROM orders")
def F7_to_int_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sc.to_int(F.substring("o_orderpriority", 1, 1)).alias("n"), sc.to_int(F.concat("o_orderpriority", F.lit("x"))).alias("default_n"))


@query(f"SELECT s_suppkey, coalesce({_first('''lower(s_name || ' ' || n_name)''', lookups.EMPLOYERS)}, 'Other') AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def F8_classify_employer(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select("s_suppkey", sc.classify_employer(F.concat_ws(" ", "s_name", "n_name")).alias("kind"))


TERMS = ["thwh", "tion", "eau", "keit", "ción", "the", "quzzk"]


@query(f"SELECT doc_id, unnest(list_filter({_list(TERMS)}, lambda t: contains(lower(text), t))) AS skill FROM documents")
def F9_extract_skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(sc.extract_skills(F.col("text"), TERMS)).alias("skill"))


@query("SELECT doc_id, term AS skill FROM documents JOIN (SELECT DISTINCT lower(substr(c_mktsegment, 1, 4)) AS term FROM customer UNION SELECT DISTINCT lower(substr(p_type, 1, 3)) FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT DISTINCT lower(split_part(c_name, '#', 2)) FROM customer) ON contains(lower(coalesce(text, '')), term)")
def F9_extract_terms(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of the tables' own names, all of its terms in one pass."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    named = [c.select(F.lower(F.substring("c_mktsegment", 1, 4))), p.select(F.lower(F.substring("p_type", 1, 3))), table(spark, d, "nation").select(F.lower("n_name")), c.select(F.lower(F.split_part("c_name", F.lit("#"), F.lit(2))))]
    dictionary = sorted(r[0] for r in reduce(DataFrame.union, named).distinct().collect())  # a dictionary stands at the driver
    return terms.extract_terms(table(spark, d, "documents"), "doc_id", "text", dictionary)


KNOWN = "CASE WHEN p_size < 10 THEN 'Python' WHEN p_size < 20 THEN 'Leadership' WHEN p_size < 30 THEN 'Scientific Writing' ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN list_contains({_list(lookups.KNOWLEDGE)}, lower({KNOWN})) THEN 'knowledge' WHEN list_contains({_list(lookups.COMPETENCE)}, lower({KNOWN})) THEN 'competence' ELSE 'skill' END AS kind FROM part")
def F10_classify_skill_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sc.classify_skill_type(F.expr(KNOWN)).alias("kind"))


LABEL = "CASE WHEN p_size < 5 THEN ' Docker' WHEN p_size < 8 THEN 'laboratory skills' ELSE p_name END"
CHAIN = "CASE WHEN p_size < 20 THEN 'skills' WHEN p_size < 30 THEN 'Education' ELSE 'x' END"
CHAIN2 = "CASE WHEN p_size % 2 = 0 THEN 'Digital things' ELSE p_brand END"


@query(
    f"SELECT p_partkey, coalesce({_case(f'lower(trim({LABEL}))', lookups.LABELS)}, {_case(f'lower({CHAIN})', lookups.GROUPS)}, {_case(f'lower({CHAIN2})', lookups.GROUPS)}, {_first(f'''lower({CHAIN} || ' ' || {CHAIN2})''', lookups.CHAIN_WORDS)}, 'Other') AS category FROM part"
)
def F12_skill_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sc.skill_category(F.expr(LABEL), F.array(F.expr(CHAIN), F.expr(CHAIN2))).alias("category"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part")
def F13_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sc.normalize_text(F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n"))).alias("name"))


@query("SELECT position_id, skill FROM s")
def F14_skill_key(spark: SparkSession, d: str) -> DataFrame:
    return pr.with_key(skills(spark, d)).select("position_id", "skill")


@query("SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(lower(p_type || '-' || p_name || '''s'), '\\p{L}+|[^\\p{L}]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS name FROM part")
def F15_title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sc.title_case(F.concat("p_type", F.lit("-"), "p_name", F.lit("'s"))).alias("name"))


@query("SELECT position_id, substr(date_posted, 1, 7) AS month FROM p")
def F16_posting_month(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).select("position_id", sc.posting_month(F.col("date_posted")).alias("month"))


@query("SELECT o_orderkey, sha256('[\"' || o_orderkey || '\",\"' || o_orderpriority || '\"]') AS key FROM orders")
def F18_content_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sc.content_key(F.col("o_orderkey"), F.col("o_orderpriority")).alias("key"))


@query("SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN NULL ELSE (props::JSON->>'k')::BIGINT END AS k FROM events")
def F19_parse_llm_json(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_type").like("c%"), "no json").otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return table(spark, d, "events").select("event_id", sc.parse_model_json(text, "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1000000, 1)) || 'M' WHEN n >= 1000 THEN floor(n / 1000 + 0.5)::BIGINT || 'K' ELSE n::VARCHAR END AS shown FROM (SELECT o_orderkey, floor(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 0.001 WHEN 'O' THEN 1 ELSE 30 END)::BIGINT AS n FROM orders)")
def F20_compact_number(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", F.lit(0.001)).when(F.col("o_orderstatus") == "O", F.lit(1.0)).otherwise(30.0))
    return table(spark, d, "orders").select("o_orderkey", sc.compact_number(n).alias("shown"))


@query("SELECT position_id, skill_raw, CASE WHEN skill_esco_type IS NULL THEN 'other' WHEN contains(skill_esco_type, 'knowledge') THEN 'knowledge' ELSE 'skill' END AS bucket FROM s")
def F21_type_bucket(spark: SparkSession, d: str) -> DataFrame:
    return skills(spark, d).select("position_id", "skill_raw", sc.type_bucket(F.col("skill_esco_type")).alias("bucket"))


@query("SELECT p_partkey, round(p_size / 2.0::DOUBLE) AS away, round_even(p_size / 2.0::DOUBLE, 0) AS even, floor(p_size / 2.0 + 0.5)::BIGINT AS up FROM part")
def F22_rounding(spark: SparkSession, d: str) -> DataFrame:
    half = F.col("p_size") / 2.0
    return table(spark, d, "part").select("p_partkey", F.round(half).alias("away"), F.bround(half).alias("even"), sc.round_half_up(half).alias("up"))


# --- feeds: pages of landed JSON made from the orders, written and read by the feeds' readers

SHOWN = "position_id, title, organization, location_state, location_country, min_salary, max_salary, salary_type, series_code, series_group, qualification_summary, major_duties, telework_eligible, date_posted, hiring_path, total_openings, job_type"


def _landed(spark: SparkSession, d: str, item, wrap) -> str:
    """A folder of compressed JSON, a page of 500 postings to a line.

    Postings travel to their page as they are; an item, several times as long, is made there.
    """
    path = scratch.folder(spark)
    rows = postings(spark, d).withColumn("page", F.floor(F.col("position_id").cast("long") / 500)).repartition("page")
    rows.groupBy("page").agg(F.collect_list(item).alias("items")).select(wrap(F.col("items"))).write.json(path, compression="gzip")
    return path


def _federal(spark: SparkSession, d: str) -> DataFrame:
    s = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    c, t = F.col, F.lit
    details = s(MajorDuties=F.array(c("department"), t(""), c("title")), TeleworkEligible=F.when(c("telework_eligible"), "Yes").otherwise("no"), WhoMayApply=s(Name=c("department")), HiringPath=F.array(c("title"), t("public")), TotalOpenings=F.when(c("total_openings") > 3, c("total_openings").cast("string")).otherwise("many"))
    item = s(
        PositionID=c("position_id"), PositionTitle=c("title"), OrganizationName=c("organization"), DepartmentName=c("department"),
        PositionLocation=F.array(s(CityName=t("x"), CountrySubDivisionCode=c("location_state"), CountryCode=c("location_state")), s(CityName=t("y"), CountrySubDivisionCode=t("no"), CountryCode=t("no"))),
        PositionRemuneration=F.array(s(MinimumRange=c("min_salary").cast("string"), MaximumRange=c("max_salary").cast("string"), Description=c("salary_type"))), JobCategory=F.array(s(Code=c("series_code"))),
        QualificationSummary=F.concat_ws(" ", t("python and"), "department"), PublicationStartDate=c("date_posted"), UserArea=s(Details=details),
    )
    path = _landed(spark, d, s(MatchedObjectDescriptor=item), lambda items: s(SearchResultItems=items).alias("SearchResult"))
    return feeds.read_federal_json(spark, path, multi_line=False)


FEDERAL = f"""federal AS (SELECT position_id, title, organization, location_state, substr(coalesce({_case('lower(location_state)', lookups.COUNTRIES)}, upper(location_state)), 1, 2) AS location_country,
  min_salary, max_salary, salary_type, series_code, CASE WHEN length(series_code) >= 4 THEN substr(series_code, 1, 2) || '00' ELSE '' END AS series_group, 'python and ' || department AS qualification_summary,
  department || ' | ' || title AS major_duties, telework_eligible, date_posted, title || ', public' AS hiring_path, CASE WHEN total_openings > 3 THEN total_openings ELSE 1 END AS total_openings,
  coalesce({_first('lower(organization)', lookups.EMPLOYERS)}, 'Other') AS job_type FROM p)"""


@query(f"SELECT {SHOWN} FROM federal", FEDERAL)
def read_federal_json(spark: SparkSession, d: str) -> DataFrame:
    return _federal(spark, d).selectExpr(*SHOWN.split(", "))


def _board(spark: SparkSession, d: str) -> DataFrame:
    s = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    c = F.col
    item = s(
        id=c("position_id"), title=c("title"), company=s(display_name=c("organization")), category=s(label=c("department"), tag=c("series_code")),
        location=s(display_name=c("location_city"), area=F.when(c("job_type") == "State", F.array().cast("array<string>")).otherwise(F.array("location_country", "location_state"))),
        description=c("department"), salary_min=F.when(c("telework_eligible"), c("min_salary")), salary_max=c("max_salary"), created=c("date_posted"), contract_time=c("job_type"),
    )
    return feeds.read_board_json(spark, _landed(spark, d, item, lambda items: items.alias("results")), "gb", multi_line=False)


BOARD = """board AS (SELECT position_id, title, organization, CASE WHEN job_type = 'State' THEN '' ELSE location_state END AS location_state, 'GB' AS location_country, CASE WHEN telework_eligible THEN min_salary ELSE 0 END AS min_salary,
  max_salary, 'Per Year' AS salary_type, series_code, '' AS series_group, department AS qualification_summary, '' AS major_duties, false AS telework_eligible, date_posted, job_type AS hiring_path, 1 AS total_openings, 'Private' AS job_type FROM p)"""


@query(f"SELECT {SHOWN} FROM board", BOARD)
def read_board_json(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d).selectExpr(*SHOWN.split(", "))


def _aggregator(spark: SparkSession, d: str) -> DataFrame:
    c, t = F.col, F.lit
    item = F.struct(
        F.concat(t(" "), "position_id").alias("id"), F.concat(t("<b>"), "title", t("</b>")).alias("title"), F.concat(t("for <i>"), "department", t("</i> ")).alias("snippet"),
        F.concat(F.floor("min_salary").cast("string"), t(" – "), F.floor("max_salary").cast("string"), t(" UAH")).alias("salary"), F.concat("date_posted", t("T00:00:00")).alias("updated"),
        c("organization").alias("company"), c("location_state").alias("location"), c("job_type").alias("type"),
    )
    return feeds.read_aggregator_json(spark, _landed(spark, d, item, lambda items: items.alias("jobs")), multi_line=False)


AGGREGATOR = """aggregator AS (SELECT 'jooble_' || position_id AS position_id, title, organization, '' AS location_state, 'UA' AS location_country, lo AS min_salary, hi AS max_salary,
  CASE WHEN lo <> 0 THEN 'Per Month' ELSE 'Per Year' END AS salary_type, '' AS series_code, '' AS series_group, title || ' for  ' || department AS qualification_summary, '' AS major_duties, false AS telework_eligible, date_posted,
  job_type AS hiring_path, 1 AS total_openings, 'Jooble' AS job_type FROM (SELECT *, coalesce(list_min(n), 0) AS lo, coalesce(list_max(n), 0) AS hi FROM (
    SELECT *, list_filter([floor(min_salary), floor(max_salary)], lambda x: x >= 100) AS n FROM p)))"""


@query(f"SELECT {SHOWN} FROM aggregator", AGGREGATOR)
def read_aggregator_json(spark: SparkSession, d: str) -> DataFrame:
    return _aggregator(spark, d).selectExpr(*SHOWN.split(", "))


@query(f"SELECT 0 AS feed, {SHOWN} FROM federal UNION ALL SELECT 1, {SHOWN} FROM board UNION ALL SELECT 2, {SHOWN} FROM aggregator", f"{FEDERAL}, {BOARD}, {AGGREGATOR}")
def U1_unify_feeds(spark: SparkSession, d: str) -> DataFrame:
    return feeds.unify_feeds(_federal(spark, d), _board(spark, d), _aggregator(spark, d)).selectExpr("feed", *SHOWN.split(", "))


# --- storage


def _orders(spark: SparkSession, d: str, where: str, factor: float, o: int) -> DataFrame:
    return table(spark, d, "orders").filter(where).select(F.col("o_orderkey").alias("position_id"), F.col("o_orderpriority").alias("title"), (F.col("o_totalprice") * factor).alias("price"), F.lit(o).alias("ord"))


OLD, NEW, NEWER = "o_orderstatus <> 'P'", "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'", "o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'"
FEEDS = f"""old AS (SELECT o_orderkey AS position_id, o_orderpriority AS title, o_totalprice AS price FROM orders WHERE {OLD}),
  new AS (SELECT o_orderkey AS position_id, o_orderpriority AS title, o_totalprice * 2 AS price, 1 AS ord FROM orders WHERE {NEW} UNION ALL SELECT o_orderkey, o_orderpriority, o_totalprice * 4, 2 FROM orders WHERE {NEWER})"""


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, NEW, 2.0, 1).unionByName(_orders(spark, d, NEWER, 4.0, 2))


@query("SELECT * FROM old WHERE position_id NOT IN (SELECT position_id FROM new) UNION ALL SELECT position_id, title, price FROM new QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord DESC) = 1", FEEDS)
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    return storage.upsert_replace(_orders(spark, d, OLD, 1.0, 0).drop("ord"), _incoming(spark, d), "position_id", "ord")


@query("SELECT position_id, title, price FROM new WHERE position_id NOT IN (SELECT position_id FROM old) QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord) = 1", FEEDS)
def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return storage.upsert_ignore(_orders(spark, d, OLD, 1.0, 0).drop("ord"), _incoming(spark, d), "position_id", "ord").select("position_id", "title", "price")


def _kept_up(spark: SparkSession, d: str, replace: bool) -> DataFrame:
    """The old orders as a keyed table, and the incoming ones upserted into it."""
    path = scratch.folder(spark)
    keyed.upsert(path, _orders(spark, d, OLD, 1.0, 0).drop("ord"), buckets=16)
    keyed.upsert(path, _incoming(spark, d), "position_id", "ord", replace=replace)
    return keyed.read(spark, path)


@query("SELECT * FROM old WHERE position_id NOT IN (SELECT position_id FROM new) UNION ALL SELECT position_id, title, price FROM new QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord DESC) = 1", FEEDS)
def upsert_replace_keyed(spark: SparkSession, d: str) -> DataFrame:
    return _kept_up(spark, d, True)


@query("SELECT * FROM old UNION ALL SELECT position_id, title, price FROM new WHERE position_id NOT IN (SELECT position_id FROM old) QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord) = 1", FEEDS)
def upsert_ignore_keyed(spark: SparkSession, d: str) -> DataFrame:
    return _kept_up(spark, d, False)


@query("SELECT position_id, title, price FROM new QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord DESC) = 1", FEEDS)
def W2_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return storage.latest_per_key(_incoming(spark, d), "position_id", "ord").drop("ord")


@query("SELECT position_id, title, price FROM new QUALIFY row_number() OVER (PARTITION BY position_id ORDER BY ord) = 1", FEEDS)
def W2_first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return storage.first_per_key(_incoming(spark, d), "position_id", "ord").drop("ord")


@query("SELECT position_id, skill_raw, count(*) AS n FROM (SELECT position_id, skill_raw FROM s UNION ALL SELECT position_id, department FROM p) GROUP BY ALL")
def append_skills(spark: SparkSession, d: str) -> DataFrame:
    more = postings(spark, d).select("position_id", F.col("department").alias("skill_raw"))
    return storage.append_skills(skills(spark, d), more).groupBy("position_id", "skill_raw").agg(F.count(F.lit(1)).alias("n"))


MAPPINGS = "maps AS (SELECT p_name AS raw_skill, CASE WHEN min(p_size) < 3 THEN NULL ELSE 'm/' || min(p_size) END AS esco_uri, 'label ' || p_name AS esco_label, 'skill' AS esco_type, min(p_type) AS skill_category, min(p_size) / 50.0 AS confidence FROM part GROUP BY p_name)"


def _mappings(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "part").groupBy(F.col("p_name").alias("raw_skill")).agg(F.min("p_size").alias("n"), F.min("p_type").alias("skill_category"))
    return one.select(
        "raw_skill", F.when(F.col("n") >= 3, F.concat(F.lit("m/"), F.col("n").cast("string"))).alias("esco_uri"), F.concat(F.lit("label "), "raw_skill").alias("esco_label"), F.lit("skill").alias("esco_type"),
        "skill_category", (F.col("n") / 50.0).alias("confidence"),
    )


@query(
    """SELECT position_id, skill_raw, coalesce(m.esco_uri, skill_esco_uri) AS skill_esco_uri, CASE WHEN m.esco_uri IS NULL THEN skill_esco_label ELSE m.esco_label END AS skill_esco_label,
    CASE WHEN m.esco_uri IS NULL THEN skill_esco_type ELSE m.esco_type END AS skill_esco_type, CASE WHEN m.esco_uri IS NULL THEN s.skill_category ELSE m.skill_category END AS skill_category FROM s LEFT JOIN maps m ON m.raw_skill = skill_raw""", MAPPINGS
)
def J4_apply_mappings(spark: SparkSession, d: str) -> DataFrame:
    return storage.apply_mappings(skills(spark, d), _mappings(spark, d)).select("position_id", "skill_raw", "skill_esco_uri", "skill_esco_label", "skill_esco_type", "skill_category")


@query(
    """SELECT skill_category, skill_esco_type, count(*) AS skills, count(DISTINCT skill_esco_uri) AS uris FROM (SELECT coalesce(m.esco_uri, skill_esco_uri) AS skill_esco_uri,
    CASE WHEN m.esco_uri IS NULL THEN skill_esco_type ELSE m.esco_type END AS skill_esco_type, CASE WHEN m.esco_uri IS NULL THEN s.skill_category ELSE m.skill_category END AS skill_category
    FROM s LEFT JOIN maps m ON m.raw_skill = skill_raw) GROUP BY ALL""", MAPPINGS
)
def apply_mappings(spark: SparkSession, d: str) -> DataFrame:
    """The table of skills written with its mappings applied, read back and counted."""
    path = scratch.folder(spark)
    storage.apply_mappings(skills(spark, d), _mappings(spark, d)).write.parquet(path)
    return spark.read.parquet(path).groupBy("skill_category", "skill_esco_type").agg(F.count(F.lit(1)).alias("skills"), F.countDistinct("skill_esco_uri").alias("uris"))


@query("SELECT count(*) AS total, count(esco_uri) AS mapped, count(esco_uri) / count(*) AS mapping_rate, avg(confidence) FILTER (esco_uri IS NOT NULL) AS avg_confidence, count(esco_uri) / count(*) < 0.6 AS low_rate, avg(confidence) FILTER (esco_uri IS NOT NULL) < 0.5 AS low_confidence FROM maps", MAPPINGS)
def A21_mapping_quality(spark: SparkSession, d: str) -> DataFrame:
    return ev.mapping_quality(_mappings(spark, d))


@query("SELECT esco_uri, raw_skill FROM maps WHERE esco_uri IS NOT NULL AND esco_uri NOT IN (SELECT 'm/' || r_regionkey FROM region)", MAPPINGS)
def J10_hallucination_check(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "region").select(F.concat(F.lit("m/"), F.col("r_regionkey").cast("string")).alias("uri"))
    return ev.hallucination_check(_mappings(spark, d), known).select("esco_uri", "raw_skill")


@query("SELECT position_id, date_posted FROM p WHERE position_id NOT IN (SELECT position_id FROM s WHERE skill_esco_label IS NOT NULL)")
def J2_unprocessed_postings(spark: SparkSession, d: str) -> DataFrame:
    return storage.unprocessed_postings(postings(spark, d), skills(spark, d).filter("skill_esco_label is not null"), "").select("position_id", "date_posted")


CUT = f"strftime(DATE '{AS_OF}' - 90, '%Y-%m-%d')"


@query(f"SELECT position_id, skill_raw FROM s WHERE position_id NOT IN (SELECT position_id FROM p WHERE date_posted >= {CUT})")
def J3_orphan_skills(spark: SparkSession, d: str) -> DataFrame:
    return storage.orphan_skills(skills(spark, d), storage.retention_cleanup(postings(spark, d), skills(spark, d), AS_OF)[0]).select("position_id", "skill_raw")


@query(f"SELECT (SELECT count(*) FROM p WHERE date_posted < {CUT}) AS postings_deleted, (SELECT count(*) FROM s JOIN p USING (position_id) WHERE date_posted < {CUT}) AS skills_deleted")
def R1_retention_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return storage.retention_cleanup(postings(spark, d), skills(spark, d), AS_OF)[2]


@query("SELECT 'volume' AS key, '[' || string_agg('{\"month\":\"' || month || '\",\"count\":' || n || '}', ',' ORDER BY month) || ']' AS data FROM (SELECT substr(date_posted, 1, 7) AS month, count(*) AS n FROM p GROUP BY 1)")
def store_mart(spark: SparkSession, d: str) -> DataFrame:
    months = postings(spark, d).groupBy(sc.posting_month(F.col("date_posted")).alias("month")).agg(F.count(F.lit(1)).alias("count"))
    path = scratch.folder(spark)
    storage.store_mart(months, path)
    return storage.mart_json(storage.read_mart(spark, path), "volume", "month")


@query("SELECT job_type, count(*) AS n FROM p GROUP BY 1")
def write_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    rows = postings(spark, d).groupBy("job_type").agg(F.count(F.lit(1)).alias("n")).withColumn("snapshot_date", F.lit(AS_OF))
    for _ in range(2):  # a second run of a day replaces the first
        storage.write_snapshot(rows, path)
    return spark.read.parquet(path).select("job_type", "n")


@query("SELECT o_orderpriority AS query, count(*)::INT AS jobs_collected, 'success' AS status FROM orders GROUP BY 1")
def write_collection_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    runs = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("query")).agg(F.count(F.lit(1)).cast("int").alias("total_found"))  # a run each
    storage.collection_log_rows(runs.withColumn("jobs_collected", F.col("total_found")), "2001-08-01 00:00:00", "2001-08-01 00:01:00").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("query", "jobs_collected", "status")


@query("SELECT title, count(*) AS count, round(avg(min_salary) + 1e-7, 2) AS avg_min FROM p GROUP BY 1")
def read_mart(spark: SparkSession, d: str) -> DataFrame:
    """A typed mart that replaces an older one, read back; where there is none the reader says so."""
    path = scratch.folder(spark)
    if storage.read_mart(spark, path) is not None:
        raise AssertionError("a mart that wasn't stored")
    by_title = postings(spark, d).groupBy("title").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("min_salary") + 1e-7, 2).alias("avg_min"))
    storage.store_mart(by_title.limit(1), path)
    storage.store_mart(by_title, path)
    return storage.read_mart(spark, path)


# --- taxonomy: nations below regions below a root, for candidates; orders below customers below ranges of 16 customers, and so on


def _concepts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("uri"), F.col("n_name").alias("preferred_label"), F.array(F.concat(F.lit("land "), "n_name")).alias("alt_labels"), F.lit("skill").alias("skill_type"), F.col("n_nationkey").alias("o"))
    r = table(spark, d, "region").select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("uri"), F.col("r_name").alias("preferred_label"), F.array(F.lit("Region")).alias("alt_labels"), F.lit("group").alias("skill_type"), (F.col("r_regionkey") + 1000).alias("o"))
    root = table(spark, d, "region").groupBy().agg(F.lit("root").alias("uri"), F.lit("Skills").alias("preferred_label"), F.array().cast("array<string>").alias("alt_labels"), F.lit("group").alias("skill_type"), F.lit(9999).alias("o"))
    return n.unionByName(r).unionByName(root)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    up = n.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("child_uri"), F.concat(F.lit("r/"), F.col("n_regionkey").cast("string")).alias("parent_uri"), (F.col("n_nationkey") + 1000).alias("edge_ord"))
    first = n.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("child_uri"), F.lit("nowhere").alias("parent_uri"), F.col("n_nationkey").alias("edge_ord"))
    r = table(spark, d, "region").select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("child_uri"), F.lit("root").alias("parent_uri"), F.col("r_regionkey").alias("edge_ord"))
    return up.unionByName(first).unionByName(r)


#: Ranges of 16, 256 and so on customers; the last level's parent is the root.
LEVELS = 5
_TREE = """
SELECT concat('o/', o_orderkey) AS uri, concat('Order ', o_orderkey) AS label, concat('Purchase ', o_orderkey) AS alt, 'skill' AS kind, CAST(o_orderkey AS BIGINT) AS o, concat('c/', o_custkey) AS parent FROM orders
UNION ALL SELECT concat('c/', c_custkey), c_name, 'Buyer', 'skill', CAST(c_custkey + 10000000000 AS BIGINT), concat('g1/', CAST(floor(c_custkey / 16) AS BIGINT)) FROM customer
""" + "".join(
    f"""UNION ALL SELECT DISTINCT concat('g{k}/', CAST(floor(c_custkey / {16**k}) AS BIGINT)), concat('Range {k} of ', CAST(floor(c_custkey / {16**k}) AS BIGINT)), 'Range', 'group',
  CAST({k} * 100000000000 + floor(c_custkey / {16**k}) AS BIGINT), {f"concat('g{k + 1}/', CAST(floor(c_custkey / {16 ** (k + 1)}) AS BIGINT))" if k < LEVELS else "'root'"} FROM customer
"""
    for k in range(1, LEVELS + 1)
) + "UNION ALL SELECT DISTINCT 'root', 'Skills', 'Everything', 'group', CAST(990000000000 AS BIGINT), CAST(NULL AS {text}) FROM customer"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    sql = _TREE.format(text="STRING").replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}")
    return spark.sql(sql, orders=table(spark, d, "orders"), customer=table(spark, d, "customer"))


def _tree_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("uri", F.col("label").alias("preferred_label"), F.array("alt").alias("alt_labels"), F.col("kind").alias("skill_type"), "o")


def _tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each concept's parent; orders have an older edge to nowhere."""
    t = _tree(spark, d)
    up = t.filter("parent IS NOT NULL").select(F.col("uri").alias("child_uri"), F.col("parent").alias("parent_uri"), (F.col("o") + 1_000_000_000_000).alias("edge_ord"))
    return up.unionByName(t.filter("uri LIKE 'o/%'").select(F.col("uri").alias("child_uri"), F.lit("nowhere").alias("parent_uri"), F.col("o").alias("edge_ord")))


TREE = f"""tree AS ({_TREE.format(text="VARCHAR")}), up AS (SELECT uri AS child_uri, parent AS parent_uri FROM tree WHERE parent IS NOT NULL)"""


@query("SELECT child_uri, parent_uri FROM up", TREE)
def J5_taxonomy_parent(spark: SparkSession, d: str) -> DataFrame:
    return tx.taxonomy_parent(_tree_edges(spark, d), _tree_concepts(spark, d))


@query("SELECT child_uri, max(parent_uri) FILTER (parent_uri <> 'nowhere') AS last_parent, count(*) AS edges FROM (SELECT * FROM up UNION ALL SELECT uri, 'nowhere' FROM tree WHERE uri LIKE 'o/%') GROUP BY 1", TREE)
def read_taxonomy_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges as several CSV files in order, read back: of a child's parents the last line's counts."""
    path = scratch.folder(spark)
    every = _tree_edges(spark, d)
    # A file is read by one task, so there are more files where there are more edges; children are dealt to as many tasks.
    n = skew.tasks(every)
    rows = every.repartitionByRange(n, "edge_ord").sortWithinPartitions("edge_ord")
    rows.select(F.col("child_uri").alias("conceptUri"), F.col("parent_uri").alias("broaderUri")).write.options(header=True, quoteAll=True, escape='"').csv(path)
    edges = tx.read_taxonomy_edges(spark, path).repartition(n, "child_uri")
    return tx.parents(edges).join(edges.groupBy("child_uri").agg(F.count(F.lit(1)).alias("edges")), "child_uri").select("child_uri", F.col("parent_uri").alias("last_parent"), "edges")


@query("SELECT child_uri, parent_uri FROM up UNION ALL SELECT uri, 'nowhere' FROM tree WHERE uri LIKE 'o/%'", TREE)
def J5_taxonomy_children(spark: SparkSession, d: str) -> DataFrame:
    return tx.taxonomy_children(_tree_edges(spark, d), _tree_concepts(spark, d)).select("child_uri", "parent_uri")


@query("SELECT a.child_uri AS uri, b.child_uri AS sibling_uri FROM up a JOIN up b USING (parent_uri) WHERE a.child_uri <> b.child_uri", TREE)
def J5_taxonomy_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tx.taxonomy_siblings(_tree_edges(spark, d), _tree_concepts(spark, d))


@query("SELECT uri, parent_uri, n - 1 AS n_siblings FROM (SELECT child_uri AS uri, parent_uri, count(*) OVER (PARTITION BY parent_uri) AS n FROM up)", TREE)
def J5_sibling_groups(spark: SparkSession, d: str) -> DataFrame:
    return tx.sibling_groups(_tree_edges(spark, d), _tree_concepts(spark, d))


@query("SELECT a.child_uri AS uri, b.child_uri AS sibling_uri FROM up a JOIN up b USING (parent_uri) WHERE a.child_uri <> b.child_uri AND a.child_uri LIKE 'g%'", TREE)
def J5_siblings_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = _tree_concepts(spark, d)
    return tx.taxonomy_siblings(_tree_edges(spark, d), c, c.filter("skill_type = 'group'"))


CHAINS = "chains AS (SELECT uri, uri AS top, '' AS chain FROM tree WHERE parent IS NULL UNION ALL SELECT t.uri, t.uri, CASE WHEN c.chain = '' THEN p.label ELSE c.chain || '/' || p.label END FROM chains c JOIN tree t ON t.parent = c.uri JOIN tree p ON p.uri = c.uri)"


@query("SELECT uri, chain FROM chains", f"{TREE}, {CHAINS}")
def J6_taxonomy_chain(spark: SparkSession, d: str) -> DataFrame:
    return tx.taxonomy_chain(_tree_edges(spark, d), _tree_concepts(spark, d)).select("uri", F.array_join("chain", "/").alias("chain"))


@query("SELECT l AS label, arg_max(uri, pos) AS uri, min(pos) AS pos FROM (SELECT uri, lower(unnest([label, alt])) AS l, (o << 20) + unnest(range(0, 2)) AS pos FROM tree) GROUP BY 1", TREE)
def build_label_index(spark: SparkSession, d: str) -> DataFrame:
    return tx.label_index(_tree_concepts(spark, d), "o")


def _concept_files(spark: SparkSession, concepts: DataFrame) -> str:
    """The concepts as CSV files with quoted labels on lines of their own."""
    path = scratch.folder(spark)
    rows = concepts.select(F.col("uri").alias("conceptUri"), F.col("preferred_label").alias("preferredLabel"), F.array_join("alt_labels", " \n").alias("altLabels"), F.lit('a "word"').alias("description"), F.col("skill_type").alias("skillType"))
    rows.write.options(header=True, quoteAll=True, quote='"', escape='"').csv(path)
    return path


@query("SELECT uri, label, 'group' AS skill_type FROM tree WHERE kind = 'group' AND NOT (uri LIKE 'g1/%' AND o % 2 = 0)", TREE)
def read_taxonomy_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups from files; those that are skills already, here half of the smallest ranges, are left out."""
    c = _tree_concepts(spark, d)
    path = _concept_files(spark, c.filter("skill_type = 'group'"))
    return tx.read_taxonomy_groups(spark, path, c.filter("skill_type = 'skill' OR (uri LIKE 'g1/%' AND o % 2 = 0)")).select("uri", F.col("preferred_label").alias("label"), "skill_type")


@query("SELECT uri, label AS preferred_label, alt || '|' || lower(label) AS alt_labels, kind AS skill_type FROM tree", TREE)
def read_taxonomy_skills(spark: SparkSession, d: str) -> DataFrame:
    c = _tree_concepts(spark, d).withColumn("alt_labels", F.array_append("alt_labels", F.lower("preferred_label")))
    return tx.read_taxonomy_skills(spark, _concept_files(spark, c)).select("uri", "preferred_label", F.array_join("alt_labels", "|").alias("alt_labels"), "skill_type")


# --- matching


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with their brands."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, d, "part").groupBy(name.alias("label")).agg(F.min("p_partkey").alias("pos")).withColumn("uri", F.concat(F.lit("p/"), F.col("pos").cast("string")))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their words turned round, or without their first letter."""
    p = _labels(spark, d).select("label")
    turned = p.select(F.array_join(F.reverse(F.split("label", " ")), " ").alias("raw_skill"))
    return turned.unionByName(p.select(F.expr("substr(label, 2)").alias("raw_skill"))).unionByName(p.select(F.concat(F.lit("zq "), F.substring("label", 1, 2)).alias("raw_skill"))).distinct()


def _sorted(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')), ' ')"


def _scored(name: str, raw: str, labels: str) -> str:
    """Every raw_skill with every label's token-sort ratio: a bit of a number for each place that isn't matched yet."""
    return f"""{name}_a AS (SELECT raw_skill, t, length(t) AS n, string_split(t, '') AS cs FROM (SELECT raw_skill, {_sorted('raw_skill')} AS t FROM ({raw}))),
  {name}_b AS (SELECT *, map(list_distinct(cs), list_transform(list_distinct(cs), lambda c: list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN cs[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)))) AS bits FROM {name}_a),
  {name} AS (SELECT raw_skill, label, pos, 200.0::DOUBLE * (n - bit_count(list_reduce(list_prepend((1::HUGEINT << n::INT) - 1, list_transform(string_split(l.t, ''), lambda c: coalesce(bits[c], 0::HUGEINT))),
    lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << n::INT) - 1)))) / (n + length(l.t)) AS score FROM {name}_b, (SELECT *, {_sorted('label')} AS t FROM ({labels})) l)"""


LABELS = """labels_ AS (SELECT lower(p_name || ' ' || p_brand) AS label, min(p_partkey) AS pos FROM part GROUP BY 1),
  raw_ AS (SELECT DISTINCT unnest([array_to_string(list_reverse(string_split(label, ' ')), ' '), substr(label, 2), 'zq ' || substr(label, 1, 2)]) AS raw_skill FROM labels_)"""


def _ranked(raw: str) -> str:
    return f"{LABELS}, {_scored('scored', raw, 'SELECT * FROM labels_')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY raw_skill ORDER BY score DESC, pos)::INT AS rank FROM scored)"


RANKED = _ranked("SELECT * FROM raw_")


@query("SELECT raw_skill, 'p/' || pos AS uri, label, score / 100 AS confidence FROM ranked WHERE rank = 1 AND score >= 80", RANKED)
def J7_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return ma.fuzzy_match(_raw(spark, d), _labels(spark, d))


@query("SELECT raw_skill, rank, label, 'p/' || pos AS uri, score / 100 AS score FROM ranked WHERE rank <= 3", RANKED)
def J8d_fuzzy_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ma.fuzzy_top_k(_raw(spark, d), _labels(spark, d), 3)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries: every vector whose id 20 divides; concepts: all, described by the next one's vector."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vec"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("desc_vec"))
    return q, e.join(n, "vec_id", "left").select(F.col("vec_id").cast("string").alias("uri"), F.col("embedding").alias("label_vec"), F.coalesce("desc_vec", "embedding").alias("desc_vec"))


@query("SELECT vec_id::VARCHAR AS uri, round(embedding[1]::DOUBLE, 5) AS a, round(embedding[64]::DOUBLE, 5) AS b FROM embeddings")
def read_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(spark)
    storage.store_mart(_vectors(spark, d)[1], path)
    return tx.read_vectors(spark, path).select("uri", F.round(F.col("label_vec")[0].cast("double"), 5).alias("a"), F.round(F.col("label_vec")[63].cast("double"), 5).alias("b"))


SIMS = """q AS (SELECT vec_id::VARCHAR AS text, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
  c AS (SELECT a.vec_id::VARCHAR AS uri, a.embedding::DOUBLE[] AS l, coalesce(b.embedding, a.embedding)::DOUBLE[] AS e FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  sims AS (SELECT text, uri, 0.6 * list_cosine_similarity(v, l) + 0.4 * list_cosine_similarity(v, e) AS s FROM q, c),
  best AS (SELECT text, uri, round(s, 4) AS score, row_number() OVER (PARTITION BY text ORDER BY s DESC, uri)::INT AS rank FROM sims)"""


@query("SELECT text, rank, uri, score FROM best WHERE rank <= 5", SIMS)
def J8b_knn_top_k(spark: SparkSession, d: str) -> DataFrame:
    return ma.knn_top_k(*_vectors(spark, d), k=5).withColumn("score", F.round("score", 4))


@query("SELECT text, rank, uri, score FROM best WHERE rank <= 5", SIMS)
def J8b_knn_by_pivots(spark: SparkSession, d: str) -> DataFrame:
    """The way of more concepts than a task takes, at every size."""
    return nb.nearest(*_vectors(spark, d), 5, ma.LABEL_WEIGHT).withColumn("score", F.round("score", 4))


@query("SELECT text AS raw_skill, uri, score AS confidence FROM best WHERE rank = 1 AND score >= 0.3", SIMS)
def J8_embedding_match(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    return ma.embedding_match(q.select(F.col("text").alias("raw_skill")), q, c, least=0.3).withColumn("confidence", F.round("confidence", 4))


@query("SELECT text, uri, round(s, 4) AS score FROM sims WHERE uri = (text::BIGINT + 1)::VARCHAR", SIMS)
def J8c_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    q, c = _vectors(spark, d)
    pairs = q.select("text", (F.col("text").cast("long") + 1).cast("string").alias("uri")).join(c.select("uri"), "uri", "left_semi").select("text", "uri")
    return ma.pair_similarity(pairs, q, c).withColumn("score", F.round("score", 4))


@query("SELECT array_to_string(list_reverse(string_split(label, ' ')), ' ') AS raw_skill, pos, 'p/' || pos AS esco_uri, 'fuzzy' AS method FROM labels_", LABELS)
def J9_cascade_exact(spark: SparkSession, d: str) -> DataFrame:
    raw = _labels(spark, d).select(F.array_join(F.reverse(F.split("label", " ")), " ").alias("raw_skill"))
    out = _cascade(spark, d, raw)
    return out.select("raw_skill", F.substring("esco_uri", 3, 20).cast("long").alias("pos"), "esco_uri", "method")


def _cascade(spark: SparkSession, d: str, raw: DataFrame) -> DataFrame:
    labels = _labels(spark, d)
    concepts = labels.select("uri", F.col("label").alias("preferred_label"), F.lit("skill").alias("skill_type"))
    chains = concepts.select("uri", F.array(F.lit("skills"), F.lit("digital skills")).alias("chain"))
    answers = raw.select("raw_skill", F.lit("p/1").alias("uri"), F.lit("one").alias("label"), F.lit(0.7).alias("confidence"), F.lit("batch").alias("method"))
    return ma.cascade_map_skills(raw, labels, concepts, chains, answers=answers)


def _mapped(raw: str) -> str:
    """What the cascade makes of each raw skill: labels from 0.85, the same without vectors from 0.72, else the model's answer."""
    return f"""{_ranked(raw)}, mapped AS (SELECT raw_skill, CASE WHEN score >= 72 THEN 'p/' || pos ELSE 'p/1' END AS esco_uri, CASE WHEN score >= 72 THEN label ELSE 'one' END AS esco_label,
    CASE WHEN score >= 72 THEN score / 100 ELSE 0.7 END AS confidence, CASE WHEN score >= 85 THEN 'fuzzy' WHEN score >= 72 THEN 'embedding' ELSE 'llm_batch' END AS method FROM ranked WHERE rank = 1)"""


CHAIN_CATEGORY = dict(lookups.GROUPS)["skills"]  # of the first step that is a known group


@query(f"SELECT raw_skill, esco_uri, esco_label, 'skill' AS esco_type, '{CHAIN_CATEGORY}' AS skill_category, confidence, method FROM mapped", _mapped("SELECT * FROM raw_"))
def J9_cascade_map_skills(spark: SparkSession, d: str) -> DataFrame:
    return _cascade(spark, d, _raw(spark, d))


# --- candidates


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Label hits: suppliers' nations; vector hits: customers' nations. A batch is a market or a status."""
    fuzzy = table(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("batch_id"), F.col("s_name").alias("text"), F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")).alias("uri"), (F.col("s_suppkey") % 16 / 16 + 0.0625).alias("score"))
    near = table(spark, d, "customer").select((F.col("c_custkey") % 7).alias("batch_id"), F.col("c_name").alias("text"), F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("uri"), (F.col("c_custkey") % 32 / 32).alias("score"))
    return fuzzy, near


HITS = """hits AS (SELECT s_suppkey % 7 AS batch_id, s_name AS text, 'n/' || s_nationkey AS uri, s_suppkey % 16 / 16 + 0.0625 AS score, 0 AS p FROM supplier
    UNION ALL SELECT c_custkey % 7, c_name, 'n/' || c_nationkey, c_custkey % 32 / 32, 1 FROM customer WHERE c_custkey % 32 / 32 >= 0.72),
  pool AS (SELECT batch_id, uri, max(score) AS score, CASE min(p) WHEN 0 THEN 'fuzzy' ELSE 'embedding' END AS category, count(DISTINCT text) AS n_texts FROM hits GROUP BY ALL),
  boosted AS (SELECT batch_id, uri, CASE WHEN category = 'fuzzy' AND score >= 0.95 THEN least(score + 0.15, 1.0) ELSE score END AS score, category FROM pool),
  sure AS (SELECT *, row_number() OVER (PARTITION BY batch_id, category ORDER BY score DESC, uri) <= 15 AS sure FROM boosted),
  filled AS (SELECT *, sum(sure::INT) OVER (PARTITION BY batch_id) AS n_sure, row_number() OVER (PARTITION BY batch_id, sure ORDER BY score DESC, uri) AS rest FROM sure),
  picked AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, uri)::INT AS place, uri, score, category FROM filled WHERE sure OR rest <= 20 - n_sure)"""


@query("SELECT * FROM pool", HITS)
def W6_gather_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ca.gather_candidates(*_hits(spark, d)).select("batch_id", "uri", "score", "category", F.size("texts").cast("long").alias("n_texts"))


@query("SELECT * FROM picked", HITS)
def W5_select_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ca.select_candidates(ca.gather_candidates(*_hits(spark, d)), 20)


@query("SELECT batch_id, count(*) AS n, string_agg('- [' || place || '] Label: ' || n_name || ' | Alt: land ' || n_name, chr(10) ORDER BY place) AS text FROM picked JOIN nation ON uri = 'n/' || n_nationkey GROUP BY 1", HITS)
def W7_number_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ca.number_candidates(ca.select_candidates(ca.gather_candidates(*_hits(spark, d)), 20), _concepts(spark, d))


@query("SELECT o_orderpriority, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 15 AS batch FROM orders")
def W7_batch_skills(spark: SparkSession, d: str) -> DataFrame:
    return ca.batch_skills(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderkey", 15, "o_orderpriority")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 15 AS batch FROM orders")
def W7_batch_all_skills(spark: SparkSession, d: str) -> DataFrame:
    """Batches over all rows, numbered without gaps."""
    return ca.batch_skills(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


GRAPH = f"""{HITS}, asked AS (SELECT 'Customer#' || lpad(vec_id::VARCHAR, 9, '0') AS text, embedding::DOUBLE[] AS v FROM embeddings),
  beside AS (SELECT DISTINCT h.batch_id, 'n/' || b.n_nationkey AS uri, h.text FROM hits h JOIN nation a ON h.uri = 'n/' || a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
  side AS (SELECT batch_id, uri, max(list_cosine_similarity(v, embedding::DOUBLE[])) AS score FROM beside JOIN asked USING (text) JOIN embeddings ON uri = 'n/' || vec_id GROUP BY ALL),
  found AS (SELECT batch_id, uri, score, category, 0 AS o FROM pool UNION ALL SELECT batch_id, 'r/' || n_regionkey, score, 'graph_parent', 2 FROM pool JOIN nation ON uri = 'n/' || n_nationkey
    UNION ALL SELECT batch_id, uri, score, 'graph_sibling', 3 FROM side WHERE score >= 0.1)"""


@query("SELECT batch_id, uri, round(score, 4) AS score, category FROM found QUALIFY row_number() OVER (PARTITION BY batch_id, uri ORDER BY o, score DESC) = 1", GRAPH)
def J13_graph_expand(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are nations; their vectors, and the customers' as texts, are those of the embeddings of their numbers."""
    e = table(spark, d, "embeddings")
    q = e.select(F.concat(F.lit("Customer#"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("text"), F.col("embedding").alias("vec"))
    v = e.select(F.concat(F.lit("n/"), F.col("vec_id").cast("string")).alias("uri"), F.col("embedding").alias("label_vec"), F.col("embedding").alias("desc_vec"))
    return ca.graph_expand(ca.gather_candidates(*_hits(spark, d)), _edges(spark, d), _concepts(spark, d), q, v, threshold=0.1).withColumn("score", F.round("score", 4))


ANSWERED = "said AS (SELECT p_partkey, p_name, p_size FROM part)"


@query(
    """SELECT p_partkey AS batch_id, p_name AS raw_skill, CASE WHEN p_size % 2 = 0 THEN 'n/' || (p_size % 25) ELSE 'n/0' END AS uri, 'second' AS label, p_size / 64.0 AS confidence, p_size % 2 = 0 AS via_graph
    FROM part WHERE p_size % 5 <> 4""",
)
def J11_resolve_model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each part is a batch of one skill: the answer's first item is overwritten by the second, which
    gives a candidate's number or, for odd sizes, a uri; some uris don't exist."""
    p = table(spark, d, "part")
    item = lambda name, id_, uri, label, conf: F.struct(name.alias("raw_skill"), id_.alias("esco_id"), uri.alias("esco_uri"), F.lit(label).alias("esco_label"), conf.alias("confidence"))
    none = F.lit(None).cast("string")
    even, gone = F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 4
    second = item(F.upper("p_name"), F.when(even & ~gone, "1"), F.when(gone, "n/x").when(~even, "n/0"), "second", F.col("p_size") / 64.0)
    first = item(F.col("p_name"), none, F.when(gone, "n/y").otherwise("n/1"), "first", F.lit(None).cast("double"))
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(first, second).alias("mappings"))), F.lit("\n```"))
    answers = p.select(F.col("p_partkey").alias("batch_id"), text.alias("text"))
    asked = p.select(F.col("p_partkey").alias("batch_id"), F.col("p_name").alias("raw_skill"))
    numbered = p.select(F.col("p_partkey").alias("batch_id"), F.lit(1).alias("id"), F.when(even, F.concat(F.lit("n/"), (F.col("p_size") % 25).cast("string"))).otherwise("n/2").alias("uri"), F.lit("graph_parent").alias("category"))
    return ca.resolve_model_answers(answers, asked, numbered, _concepts(spark, d)).drop("reasoning")


@query("SELECT p_partkey::VARCHAR AS id, unnest([p_name, p_type]) AS skill FROM part")
def J12_flatten_model_skills(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), F.col("p_type")).alias("skills"))
    return ca.flatten_model_skills(table(spark, d, "part").select(F.to_json(F.struct(F.array(item).alias("results"))).alias("text")))


# --- evaluation


def _golden(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("label")).agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("n"), F.min("p_type").alias("category"))
    return p.select(
        F.col("k").cast("string").alias("id"), F.when(F.col("n") > 4, F.expr("substr(label, 2)")).otherwise(F.concat(F.lit("zq "), F.substring("label", 1, 2))).alias("raw_skill"),
        F.when(F.col("n") == 1, F.concat(F.lit("p/"), F.col("k").cast("string"))).alias("expected_uri"), F.when(F.col("n") > 2, F.col("label")).alias("expected_label"), "category", (F.col("n") == 2).alias("llm_only"),
    )


GOLDEN = """golden AS (SELECT k::VARCHAR AS id, CASE WHEN n > 4 THEN substr(label, 2) ELSE 'zq ' || substr(label, 1, 2) END AS raw_skill, CASE WHEN n = 1 THEN 'p/' || k END AS expected_uri,
  CASE WHEN n > 2 THEN label END AS expected_label, category, n = 2 AS llm_only FROM (SELECT lower(p_name || ' ' || p_brand) AS label, min(p_partkey) AS k, min(p_size) AS n, min(p_type) AS category FROM part GROUP BY 1))"""
RETURNED = f"""{GOLDEN}, {_mapped('SELECT DISTINCT raw_skill FROM golden')}, {_scored('alike', 'SELECT DISTINCT expected_label AS raw_skill FROM golden WHERE expected_label IS NOT NULL', "SELECT * FROM labels_ UNION ALL SELECT 'one', 0")},
  results AS (SELECT g.*, m.esco_uri AS returned_uri, m.esco_label AS returned_label, m.confidence AS returned_confidence, coalesce(a.score / 100, 0) AS label_score,
    CASE WHEN expected_label IS NULL THEN false WHEN expected_uri IS NOT NULL THEN m.esco_uri = expected_uri ELSE coalesce(a.score / 100, 0) >= 0.8 END AS matched
    FROM golden g JOIN mapped m USING (raw_skill) LEFT JOIN alike a ON a.raw_skill = g.expected_label AND a.label = m.esco_label)"""
REPORT = """SELECT count(*) AS total, round(count(*) FILTER (expected_label IS NOT NULL) / greatest(count(*) FILTER (expected_label IS NOT NULL), 1), 4) AS mapping_rate, round(count(*) FILTER (matched) / count(*), 4) AS precision_at_1,
  round(avg(returned_confidence), 4) AS avg_confidence, round(min(returned_confidence), 4) AS min_confidence, 0.0::DOUBLE AS hallucination_rate FROM results"""


@query("SELECT id, category FROM golden WHERE llm_only AND category IS DISTINCT FROM 'edge'", GOLDEN)
def P8_golden_filter(spark: SparkSession, d: str) -> DataFrame:
    return pr.golden_filter(_golden(spark, d), skip_edges=True, llm_only=True).select("id", "category")


def _results(spark: SparkSession, d: str) -> DataFrame:
    golden = _golden(spark, d)
    mapped = _cascade(spark, d, golden.select("raw_skill").distinct())
    return ev.eval_entries(golden, mapped, _labels(spark, d).select("uri", F.col("label").alias("preferred_label")))


FAILURES = """array_to_string(list_filter([CASE WHEN precision_at_1 < 0.7 THEN 'precision_at_1' END, CASE WHEN mapping_rate < 0.75 THEN 'mapping_rate' END, CASE WHEN hallucination_rate > 0.05 THEN 'hallucination_rate' END,
  CASE WHEN avg_confidence < 0.55 THEN 'avg_confidence' END], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT *, {FAILURES} = '' AS threshold_ok, {FAILURES} AS failures FROM ({REPORT})", RETURNED)
def A22_eval_report(spark: SparkSession, d: str) -> DataFrame:
    return ev.eval_report(_results(spark, d)).withColumn("failures", F.array_join("failures", ","))


@query("SELECT id, raw_skill, expected_label, expected_uri, returned_uri, returned_label, returned_confidence, matched, false AS hallucinated, round(label_score, 3) AS label_score FROM results", RETURNED)
def A22_eval_entries(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


@query(f"SELECT r.total, r.precision_at_1, id, matched, returned_label FROM results, ({REPORT}) r", RETURNED)
def write_eval_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's files, read back: each entry with the metrics."""
    path, results = scratch.folder(spark), scratch.folder(spark)
    _results(spark, d).write.parquet(results)
    entries = spark.read.parquet(results)
    storage.write_eval_report(ev.eval_report(entries), entries, path)
    metrics = spark.read.json(f"{path}/metrics").select("total", "precision_at_1")  # one row
    return spark.read.json(f"{path}/per_entry").join(F.broadcast(metrics), F.lit(True)).select("total", "precision_at_1", "id", "matched", "returned_label")


@query("SELECT id, raw_skill, expected_uri, expected_label, category, llm_only, 80 AS label_match_ratio FROM golden", GOLDEN)
def read_golden(spark: SparkSession, d: str) -> DataFrame:
    """Golden sets of up to a thousand entries, a JSON file each, read back with their thresholds."""
    path = scratch.folder(spark)
    entry = F.struct("id", "raw_skill", "expected_uri", "expected_label", "category", "llm_only")
    sets = _golden(spark, d).groupBy(F.floor(F.col("id").cast("long") / 1000).alias("part")).agg(F.collect_list(entry).alias("entries"))
    sets.select("part", F.lit("1").alias("version"), F.struct(F.lit(80).alias("label_match_ratio")).alias("thresholds"), "entries").repartition("part").write.partitionBy("part").json(path)
    entries, heads = tx.read_golden(spark, f"{path}/part=*")
    ratio = heads.agg(F.max("label_match_ratio").alias("label_match_ratio"))  # one row
    return entries.join(F.broadcast(ratio), F.lit(True)).select("id", "raw_skill", "expected_uri", "expected_label", "category", "llm_only", "label_match_ratio")


PROPOSED = f"""{GOLDEN}, {_ranked("SELECT DISTINCT raw_skill FROM golden WHERE expected_uri IS NULL AND expected_label IS NOT NULL")}, {_scored('alike', 'SELECT DISTINCT expected_label AS raw_skill FROM golden WHERE expected_label IS NOT NULL', 'SELECT * FROM labels_')},
  proposed AS (SELECT g.*, expected_uri IS NOT NULL AS is_set, 'p/' || b.pos AS u, b.label AS l, a.score / 100 AS m FROM golden g LEFT JOIN ranked b ON b.raw_skill = g.raw_skill AND rank = 1
    LEFT JOIN alike a ON a.raw_skill = g.expected_label AND a.label = b.label),
  proposals AS (SELECT id, raw_skill, expected_uri, expected_label, category, llm_only, CASE WHEN is_set THEN expected_uri WHEN expected_label IS NOT NULL THEN u END AS proposed_uri,
    CASE WHEN is_set THEN expected_label WHEN expected_label IS NOT NULL THEN l END AS proposed_label, CASE WHEN is_set THEN 1 WHEN expected_label IS NULL THEN NULL WHEN u IS NULL THEN 0 ELSE round(m, 3) END::DOUBLE AS match,
    CASE WHEN is_set THEN 'already set' WHEN expected_label IS NULL THEN 'skip' WHEN u IS NULL THEN 'no candidate' WHEN m >= 0.8 THEN 'approve' ELSE 'review' END AS action FROM proposed)"""


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    return ev.golden_proposals(_golden(spark, d), _labels(spark, d), _labels(spark, d).select("uri", F.col("label").alias("preferred_label")))


@query("SELECT * FROM proposals", PROPOSED)
def A23_golden_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d)


@query("SELECT id, raw_skill, CASE WHEN action = 'approve' THEN proposed_uri ELSE expected_uri END AS expected_uri, expected_label, category, llm_only FROM proposals", PROPOSED)
def A23_apply_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The golden set with the uris of approved proposals."""
    return ev.apply_proposals(_proposals(spark, d), _golden(spark, d).columns)


# --- streams over the events


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of several files: a file source watches a folder."""
    events, path = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), scratch.folder(spark)
    events.repartition(4, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream holds when all that is there has been read."""
    spark, path = stream.sparkSession, scratch.folder(stream.sparkSession)
    done = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out"))
    done.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT 'e' || event_id AS position_id, event_type AS title, value AS min_salary FROM events")
def ST1_stream_ingest_postings(spark: SparkSession, d: str) -> DataFrame:
    """The events as landed pages of a board, each twice; the upsert leaves one row each."""
    path = scratch.folder(spark)
    e = table(spark, d, "events")
    item = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.col("value").alias("salary_min"))
    page = e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(item).alias("results"))
    for _ in range(2):
        page.select("results").write.mode("append").json(f"{path}/pages")
    ingest.ingest_postings(spark, f"{path}/pages", schemas.BOARD, lambda x: feeds.normalize_board(x.withColumn("country", F.lit("us"))), f"{path}/table", f"{path}/log", multi_line=False).awaitTermination()
    return ingest.latest(spark, f"{path}/table").select("position_id", "title", "min_salary")


@query("SELECT event_id, event_type, value FROM events")
def ST2_stream_dedup_new(spark: SparkSession, d: str) -> DataFrame:
    twice = _events(spark, d).union(_events(spark, d))
    return _ran(ingest.dedup_new(twice, "event_id", "ts"), "append").select("event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events WHERE event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def ST2_stream_first_writes(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch.folder(spark), _events(spark, d)
    ingest.first_writes(rows.union(rows), f"{path}/out", f"{path}/log", "user_id", "ts", "event_id", required="event_type").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").select("user_id", "event_id", "event_type", "value")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def ST3_stream_posting_volume(spark: SparkSession, d: str) -> DataFrame:
    return _ran(ingest.posting_volume(_events(spark, d), "ts", "90 days", "1 day", "event_type"), "complete").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "count")
