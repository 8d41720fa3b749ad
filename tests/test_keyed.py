"""Keyed tables: only buckets with incoming keys are written, nothing is changed in place, and bucketed facts join without a shuffle."""

import os
import random
import re

import pytest

from labourmill.operators import analytics
from labourmill.sources import keyed, scratch, storage

ROW = "position_id string, title string, n int"


def files(root):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def table(spark, path):
    return {r.position_id: (r.title, r.n) for r in keyed.read(spark, path).collect()}


@pytest.mark.parametrize("replace", [True, False])
def test_upserts_are_those_of_dictionaries(spark, tmp_path, replace):
    rng, path, want = random.Random(3), str(tmp_path / "t"), {}
    for write in range(5):
        rows = [(f"p{rng.randrange(60)}", "t", 100 * write + i) for i in range(20 if write else 60)] + [(None, "no key", 1), (f"q{write}", "t", write)]
        keyed.upsert(path, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ROW + ", o int"), "position_id", "o", replace=replace, buckets=8)
        for key, title, n in rows:
            if key and (replace or key not in want):
                want[key] = (title, n)
        got = keyed.read(spark, path)
        assert got.columns == ["position_id", "title", "n"] and got.count() == len(want)
        assert table(spark, path) == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(path, spark.createDataFrame([(f"p{i}", "t", i) for i in range(500)], ROW), buckets=32)
    before, was = files(path), keyed.current(spark, path)
    met = keyed.upsert(path, spark.createDataFrame([("p7", "new", -1), ("p8", "new", -2)], ROW))
    now = keyed.current(spark, path)
    assert 1 <= len(met) <= 2 and [b for b in now if now[b] != was[b]] == met
    # What was there is unchanged, byte for byte, so who reads the table as it was still can.
    assert before.items() <= files(path).items()
    assert table(spark, path)["p7"] == ("new", -1) and len(table(spark, path)) == 500
    # The third write lets go of what only the first one reads.
    keyed.upsert(path, spark.createDataFrame([("p7", "newer", -3)], ROW))
    assert not before.items() <= files(path).items() and len(files(path)) <= 32 + 3
    # Keys that are known already aren't written at all when the first write wins.
    untouched = files(path)
    assert keyed.upsert(path, spark.createDataFrame([("p7", "late", 0)], ROW), replace=False) == []
    assert files(path) == untouched and table(spark, path)["p7"] == ("newer", -3)


def test_a_lost_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(path, spark.createDataFrame([("a", "t", 1), ("b", "t", 2)], ROW), buckets=4)
    keyed.upsert(path, spark.createDataFrame([("a", "u", 3)], ROW))
    os.remove(tmp_path / "t" / "of=4" / "write=1" / "_SUCCESS")
    assert table(spark, path) == {"a": ("t", 1), "b": ("t", 2)}
    keyed.upsert(path, spark.createDataFrame([("b", "v", 4)], ROW))
    assert table(spark, path) == {"a": ("t", 1), "b": ("v", 4)}
    with pytest.raises(ValueError):
        keyed.upsert(path, spark.createDataFrame([("b", "v", 4)], ROW), number=0)


def test_nothing_comes_in(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed.read(spark, path) is None
    assert keyed.upsert(path, spark.createDataFrame([], ROW)) == [] and keyed.read(spark, path) is None
    keyed.upsert(path, spark.createDataFrame([("a", "t", 1)], ROW))
    assert keyed.upsert(path, spark.createDataFrame([], ROW), number=7) == [] and keyed.writes(spark, path) == [0, 7]
    assert table(spark, path) == {"a": ("t", 1)}


def test_bucketed_facts_join_without_shuffle(spark, monkeypatch):
    p = spark.createDataFrame([(f"p{i}", "t", 30000.0 + i, 60000.0, "Per Year", "2001-07-01") for i in range(300)], "position_id string, title string, min_salary double, max_salary double, salary_type string, date_posted string")
    s = spark.createDataFrame([(f"p{i % 310}", f"s{i % 7}", None, None, None, None) for i in range(900)], "position_id string, skill_raw string, skill_esco_uri string, skill_esco_label string, skill_esco_type string, skill_category string")
    want = sorted(map(tuple, analytics.skills_with_postings(s, p, "min_salary").select("position_id", "skill", "min_salary").collect()))
    names = [f"facts_{k}" for k in "ps"]
    bp, bs = (storage.save_bucketed(x, n, scratch.folder(spark), 6) for x, n in zip((p, s), names, strict=True))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = analytics.skills_with_postings(bs, bp, "min_salary").select("position_id", "skill", "min_salary")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search("Exchange", plan), plan
        assert sorted(map(tuple, joined.collect())) == want
        unbucketed = analytics.skills_with_postings(s, p, "min_salary")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in unbucketed
        for mart in (analytics.skill_roi,):
            plan = mart(bs, bp)._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("SortMergeJoin"):]
            assert "Exchange" not in below, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"DROP TABLE {n}")
