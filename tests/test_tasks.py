"""Tasks grow in number with the rows."""

import json
from pathlib import Path

from labourmill.operators import analytics, candidates
from labourmill.plans import jobs
from labourmill.sources import skew


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    assert skew.tasks(spark.range(5)) == 4 and skew.tasks(spark.range(101)) == 11
    skills = spark.createDataFrame([(str(i % 50), "a", None) for i in range(200)], "position_id string, skill_raw string, skill_esco_label string")
    postings = spark.createDataFrame([(str(i), "x") for i in range(50)], "position_id string, location_country string")
    found = analytics.skill_countries(skills, postings)
    assert [tuple(r) for r in found.select("skill", "country", "count", "rank").collect()] == [("a", "x", 50, 1)]
    assert "hashpartitioning(position_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan


def test_edges_have_files_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    monkeypatch.setattr(jobs.scratch, "folder", lambda _: f"{tmp_path}/edges")
    edges = jobs._tree_edges(spark, "/root/testdata/sf0.001")
    assert jobs.read_taxonomy_edges(spark, "/root/testdata/sf0.001").count() == edges.select("child_uri").distinct().count()
    assert len([*Path(f"{tmp_path}/edges").glob("part-*")]) >= edges.count() / 50 > 4


def test_answers_are_dealt_by_their_number(spark, monkeypatch):
    """Small files with many answers: no task has them all, no table of theirs is sent to all, and results are as said."""
    monkeypatch.setattr(candidates, "TASK_ITEMS", 10)
    said = [("Welding", "7"), ("welding", "[8]"), ("PAINT", "u/2"), ("paint", "007"), ("nothing", "u/1"), ("Sew", "u/9"), (None, "7"), ("sew", "99"), ("SEW", "")]
    texts = {b: json.dumps({"mappings": [{"raw_skill": r, "esco_id": s, "esco_label": f"{b}.{i}", "confidence": "0.5"} for i, (r, s) in enumerate(said)]}) for b in range(60)}
    answers = spark.createDataFrame(list(texts.items()), "batch_id int, text string")
    asked = spark.createDataFrame([(b, r) for b in range(60) for r in ("Welding", "welding", "Paint", "paint", "sew", "sew", None)], "batch_id int, raw_skill string")
    numbered = spark.createDataFrame([(b, i, f"u/{i % 3}", "graph_parent" if i == 2 else "fuzzy") for b in range(60) for i in (2, 7, 8)], "batch_id int, id int, uri string, category string")
    concepts = spark.createDataFrame([("u/1",), ("u/2",)], "uri string")
    for extra in (False, True):
        found = candidates.resolve_model_answers(answers, asked, numbered, concepts, extra)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(batch_id" in plan and ", 42), REPARTITION_BY_NUM" in plan
        assert plan.count("BroadcastExchange") <= 1  # the concepts
        each = [("Welding", "u/1", 0, False), ("welding", "u/2", 1, True), ("Paint", "u/2", 2, True), ("paint", "u/1", 3, False)] + [("nothing", "u/1", 4, False)] * extra
        want = [(b, r, u, f"{b}.{i}", g) for b in range(60) for r, u, i, g in each]
        assert sorted(tuple(r) for r in found.select("batch_id", "raw_skill", "uri", "label", "via_graph").collect()) == sorted(want)
