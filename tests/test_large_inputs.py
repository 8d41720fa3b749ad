"""Dictionaries of many terms, pools without groups, and sketches of distinct counts."""

import random
import time

from pyspark.sql import functions as F

from labourmill.functions import scalars, terms
from labourmill.operators import analytics, candidates


def test_terms_are_those_of_one_by_one(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [word(rng.randrange(200)) for _ in range(100)] + ["", None, "ABC abc", "x"]
    listed = [word(rng.randrange(1, 6)) for _ in range(150)] + ["", "abc", "ABC", "abc", "not there"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted(map(tuple, rows.select("id", F.explode(scalars.extract_skills(F.col("text"), listed)).alias("skill")).collect()))
    for most in (200, 4_000_000):
        monkeypatch.setattr(terms, "CHARACTERS", most)
        assert sorted(map(tuple, terms.extract_terms(rows, "id", "text", listed).collect())) == want
    assert terms.extract_terms(rows, "id", "text", []).count() == 0
    assert terms.extract_terms(rows.limit(0), "id", "text", listed).count() == 0


def test_many_terms_take_one_pass(spark):
    """A hundred thousand terms: one by one they would take a hundred thousand searches a text."""
    rng = random.Random(5)
    listed = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(8, 20))) for _ in range(100_000)})
    texts = [" ".join(rng.choice(listed) if rng.random() < 0.02 else "filler" for _ in range(500)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    took = {}
    for n in (1000, len(listed)):
        since = time.perf_counter()
        found = terms.extract_terms(rows, "id", "text", listed[:n]).groupBy("id").agg(F.sort_array(F.collect_list("skill")).alias("s")).collect()
        took[n] = time.perf_counter() - since
    print("seconds by number of terms", took)
    known = set(listed)
    whole = {r.id: set(r.s) for r in found}
    assert all(known & set(t.split()) <= whole.get(i, set()) for i, t in enumerate(texts))
    assert took[len(listed)] < 20 * took[1000] + 20


def test_numbers_have_no_gaps(spark):
    rows = spark.createDataFrame([(f"k{i % 50:02}", i) for i in range(1000)] + [("same", 0)] * 400 + [(None, 1)] * 7, "key string, n int").repartition(5)
    got = candidates.numbered(rows, "key").orderBy("number").collect()
    assert [r.number for r in got] == list(range(1407))
    assert [r.key or "" for r in got] == sorted(r.key or "" for r in got)
    batches = candidates.batch_skills(rows, "key", 15).groupBy("batch").count().orderBy("batch").collect()
    assert [(r.batch, r["count"]) for r in batches] == [(i, 15) for i in range(93)] + [(93, 12)]
    assert candidates.batch_skills(rows.limit(0), "key").count() == 0


def test_one_pool_is_cut_before_it_is_gathered(spark):
    rng = random.Random(6)
    pool = [(0, f"u{i:05}", round(rng.random(), 3), rng.choice(["fuzzy", "embedding", "graph_parent", "graph_sibling"])) for i in range(5000)]
    picked = candidates.select_candidates(spark.createDataFrame(pool, "batch_id int, uri string, score double, category string"), 60)
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()
    boost = lambda s, c: min(s + 0.15, 1.0) if c == "fuzzy" and s >= 0.95 else s
    ranked = sorted((-boost(s, c), u, c) for _, u, s, c in pool)
    seats, sure = dict(candidates.SLOTS), []
    for x in ranked:
        if seats[x[2]] > 0:
            seats[x[2]] -= 1
            sure.append(x)
    rest = [x for x in ranked if x not in sure][: 60 - len(sure)]
    assert [r.uri for r in picked.orderBy("place").collect()] == [u for _, u, _ in sorted(sure + rest)]


def test_sketches_merge(spark):
    p = spark.range(60000).select(F.col("id").cast("string").alias("position_id"), F.concat(F.lit("o"), (F.col("id") % 20011).cast("string")).alias("organization"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("2001-07-0"), (F.col("id") % 7).cast("string"))).alias("date_posted"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), (F.col("id") % 3).cast("string"))).alias("location_country"))
    null = F.lit(None).cast("string")
    s = p.select("position_id", F.concat(F.lit("s"), F.pmod(F.xxhash64("position_id"), F.lit(9000)).cast("string")).alias("skill_raw"), null.alias("skill_esco_uri"), null.alias("skill_esco_label"), null.alias("skill_esco_type"), null.alias("skill_category"))
    sketches = analytics.distinct_sketches(s, p)
    one = analytics.distinct_estimates(sketches).first()
    exact = analytics.country_stats(s, p, "ALL").first()
    print("organizations", one.organizations, exact.organizations, "skills", one.unique_skills, exact.unique_skills)
    assert abs(one.organizations - 20011) <= 0.03 * 20011 and abs(one.unique_skills - exact.unique_skills) <= 0.03 * exact.unique_skills
    assert (exact.organizations, sketches.count()) == (20011, 28)
    about = analytics.country_stats(s, p, "ALL", approximate=True).first()
    assert (about.organizations, about.unique_skills) == (one.organizations, one.unique_skills)
    nothing = analytics.distinct_estimates(analytics.distinct_sketches(s.limit(0), p.limit(0))).first()
    assert (nothing.organizations, nothing.unique_skills) == (0, 0)


def test_passes_over_terms_do_not_stand_in_one_task(spark, monkeypatch, tmp_path):
    """A pass over a table has tasks of its own, so a task never has two automata."""
    monkeypatch.setattr(terms, "CHARACTERS", 8)
    spark.createDataFrame([(1, "abcd efgh ijkl"), (2, None)], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    found = terms.extract_terms(rows, "id", "text", ["abcd", "efgh", "ijkl", "mnop", "qrst"])
    assert sorted(r.skill for r in found.collect()) == ["abcd", "efgh", "ijkl"]
    assert found.rdd.getNumPartitions() == 3 * rows.rdd.getNumPartitions()
