"""Scalar functions on hand-computed rows."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labourmill.functions import scalars as sc
from labourmill.functions.ratio import common_subsequence, ratio, token_sort_ratio


def one(spark, values, kind, use):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(use(F.col("v")).alias("x")).collect()]


def test_salary_text(spark):
    got = one(spark, ["", "17 600 UAH", "20 000 – 35 000 UAH", "12 UAH", None, "1 500,5"], "string", sc.parse_salary_range)
    assert [(r["min"], r["max"]) for r in got] == [(0, 0), (17600, 17600), (20000, 35000), (0, 0), (0, 0), (15005, 15005)]


def test_title_case(spark):
    assert one(spark, ["node.js", "people's", "c++", "six-sigma"], "string", sc.title_case) == ["Node.Js", "People'S", "C++", "Six-Sigma"]


def test_country(spark):
    assert one(spark, ["Germany", "Ukraine", None, "ua", ""], "string", sc.country_to_iso) == ["DE", "UK", "US", "UA", "US"]


def test_employer(spark):
    names = ["Nevada Widgets Inc", "Acme LLC", "Red Shelter Charity", "Zed", None, "Department of State"]
    assert one(spark, names, "string", sc.classify_employer) == ["Federal", "Private", "Non-Profit", "Other", "Other", "Federal"]


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,)], "x double")
    rows = df.select(F.round("x"), F.bround("x"), sc.round_half_up(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(3.0, 2.0, 3), (-3.0, -2.0, -2)]


def test_small_functions(spark):
    assert one(spark, ["0301", "03", None], "string", sc.series_group) == ["0300", "", ""]
    assert one(spark, ["TRUE", "yes", "0", None], "string", sc.to_bool) == [True, True, False, False]
    assert one(spark, ["12", " 3 ", "4.5", "many", None], "string", sc.to_int) == [12, 3, 1, 1, 1]
    assert one(spark, [["a", "", None, "b"]], "array<string>", lambda c: sc.join_list(c, " | ")) == ["a | b"]
    assert one(spark, ["<p>a<br>b</p> "], "string", sc.strip_html) == ["a b"]
    assert one(spark, ["Use JavaScript", None], "string", lambda c: sc.extract_skills(c, ["java", "javascript", "go"])) == [["java", "javascript"], []]
    assert one(spark, [1_250_000, 1500, 999], "long", sc.compact_number) == ["1.3M", "2K", "999"]
    assert one(spark, ["Skill/Competence", "KNOWLEDGE", "competence", None], "string", sc.type_bucket) == ["skill", "knowledge", "competence", "other"]


def test_skill_category(spark):
    rows = [(" Docker ", None), ("x", ["skills", "Digital skills"]), ("x", ["none", "software things"]), ("x", []), ("laboratory skills", None), (None, ["nothing"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, chain array<string>")
    got = [r[0] for r in df.orderBy("i").select(sc.skill_category(F.col("label"), F.col("chain"))).collect()]
    assert got == ["IT & Technology", "Other", "IT & Technology", "Other", "Sciences & Analytics", "Other"]


def test_model_json(spark):
    got = one(spark, ['```json\n{"k": 3}\n```', "no"], "string", lambda c: sc.parse_model_json(c, "k int")["k"])
    assert got == [3, None]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abcd é", max_size=80), st.text("abcd é", max_size=80))
def test_common_subsequence(a, b):
    assert common_subsequence(a, b) == slow_lcs(a, b)


def test_ratio():
    assert token_sort_ratio("b a", "a  b") == 100 and ratio("", "") == 100 and ratio("a", "") == 0
    assert ratio("abcde", "abcdx") == 80
