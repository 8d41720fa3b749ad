"""Storage, taxonomy, matching, candidates and evaluation on small hand-made tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labourmill.operators import analytics, candidates, evaluation, matching
from labourmill.operators import predicates as pr
from labourmill.sources import keyed, feeds, schemas, storage, taxonomy
from labourmill.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upserts(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "position_id string, title string, n int")
    new = spark.createDataFrame([("b", "y", 2, 1), ("b", "z", 3, 2), ("c", "y", 4, 1), ("c", "y", 5, 2), ("d", None, 6, 1)], "position_id string, title string, n int, o int")
    assert rows(storage.upsert_replace(old, new.filter("title is not null"), "position_id", "o")) == [("a", "x", 1), ("b", "z", 3), ("c", "y", 5)]
    assert rows(storage.upsert_ignore(old, new, "position_id", "o").select("position_id", "n")) == [("c", 4)]


def test_retention(spark):
    p = spark.createDataFrame([("a", ""), ("b", None), ("c", "2001-05-03"), ("d", "2001-05-02")], "position_id string, date_posted string")
    s = spark.createDataFrame([("a", "x"), ("c", "x"), ("gone", "x")], "position_id string, skill_raw string")
    stay, left, counts = storage.retention_cleanup(p, s, "2001-08-01")
    assert [r[0] for r in stay.orderBy("position_id").collect()] == ["b", "c"]
    assert rows(left) == [("c", "x")] and rows(counts) == [(2, 2)]


def test_mappings_keep_what_has_none(spark):
    s = spark.createDataFrame([("a", "x", "u0", "l0", None, None), ("a", "y", None, None, None, None)], schemas.SKILL)
    m = spark.createDataFrame([("y", "u1", "l1", "skill", "C"), ("x", None, None, None, None)], "raw_skill string, esco_uri string, esco_label string, esco_type string, skill_category string")
    assert sorted((r.skill_raw, r.skill_esco_uri) for r in storage.apply_mappings(s, m).collect()) == [("x", "u0"), ("y", "u1")]


def test_label_index(spark):
    c = spark.createDataFrame([("u1", "Java", ["Coffee"], 0), ("u2", "Tea", ["java"], 1)], "uri string, preferred_label string, alt_labels array<string>, o int")
    got = {r.label: (r.uri, r.pos) for r in taxonomy.label_index(c, "o").collect()}
    assert got["java"] == ("u2", 0) and got["coffee"] == ("u1", 1) and got["tea"][0] == "u2"


def test_chain(spark):
    c = spark.createDataFrame([(u, u.upper()) for u in "abcdxy"], "uri string, preferred_label string")
    e = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("c", "d", 2), ("x", "y", 3), ("y", "x", 4), ("b", "gone", 5)], "child_uri string, parent_uri string, edge_ord long")
    got = {r.uri: r.chain for r in taxonomy.taxonomy_chain(e, c).collect()}
    assert got == {"a": ["D", "C"], "b": [], "c": ["D"], "d": [], "x": ["Y"], "y": ["X"]}
    assert rows(taxonomy.taxonomy_siblings(e, c)) == []


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('conceptUri,preferredLabel,altLabels,description,skillType\nu1,One,"a\n b \n\n","say ""x""",knowledge\n')
    (tmp_path / "g.csv").write_text("conceptUri,preferredLabel,description\nu1,One,\ng1,Group,d\n")
    (tmp_path / "e.csv").write_text("conceptUri,broaderUri\nu1,g1\nu1,g2\n")
    s = taxonomy.read_taxonomy_skills(spark, str(tmp_path / "s.csv"))
    assert s.first().alt_labels == ["a", "b"] and s.first().description == 'say "x"'
    assert [(r.uri, r.skill_type) for r in taxonomy.read_taxonomy_groups(spark, str(tmp_path / "g.csv"), s).collect()] == [("g1", "group")]
    assert rows(taxonomy.parents(taxonomy.read_taxonomy_edges(spark, str(tmp_path / "e.csv")))) == [("u1", "g2")]


def test_golden_and_report(spark, tmp_path):
    entries = [
        {"id": "1", "raw_skill": "python", "expected_label": "Python", "category": "it", "llm_only": True},
        {"id": "2", "raw_skill": "junk", "expected_label": None, "category": "edge"},
        {"id": "3", "raw_skill": "bad", "expected_label": "Bad", "expected_uri": "u9", "category": "it"},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"version": "1", "thresholds": {"label_match_ratio": 80}, "entries": entries}, indent=1))
    golden, head = taxonomy.read_golden(spark, str(tmp_path / "g.json"))
    assert head.first().label_match_ratio == 80
    assert [r.id for r in pr.golden_filter(golden, "it", True, True).collect()] == ["1"]
    mapped = spark.createDataFrame([("python", "u1", "python", 0.9), ("junk", "u2", "x", 0.5), ("bad", "u9", "Bad", 0.4)], "raw_skill string, esco_uri string, esco_label string, confidence double")
    known = spark.createDataFrame([("u1",), ("u2",)], "uri string")
    results = evaluation.eval_entries(golden, mapped, known)
    assert {r.id: (r.matched, r.hallucinated) for r in results.collect()} == {"1": (True, False), "2": (False, False), "3": (True, True)}
    report = evaluation.eval_report(results).first()
    assert (report.total, report.mapping_rate, report.precision_at_1, report.hallucination_rate) == (3, 1.0, 0.6667, 0.3333) and report.failures == ["precision_at_1", "hallucination_rate"]
    empty = evaluation.eval_report(results.limit(0)).first()
    assert (empty.total, empty.precision_at_1, empty.avg_confidence) == (0, 0.0, 0.0)
    storage.write_eval_report(evaluation.eval_report(results), results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "per_entry")).count() == 3 and spark.read.json(str(tmp_path / "out" / "metrics")).first().total == 3


def test_fuzzy(spark):
    labels = spark.createDataFrame([("data analysis", "u1", 0), ("analysis data", "u2", 1), ("nursing", "u3", 2)], "label string, uri string, pos long")
    raw = spark.createDataFrame([("Analysis  Data",), ("nursin",), ("zzz",), (" ",)], "raw_skill string")
    assert {r.raw_skill: (r.uri, round(r.confidence, 3)) for r in matching.fuzzy_match(raw, labels).collect()} == {"Analysis  Data": ("u1", 1.0), "nursin": ("u3", round(12 / 13, 3))}
    assert [(r.rank, r.uri) for r in matching.fuzzy_top_k(raw.filter("raw_skill like 'A%'"), labels, 2).orderBy("rank").collect()] == [(1, "u1"), (2, "u2")]


def test_knn_is_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c, e = rng.normal(size=(7, 5)), rng.normal(size=(40, 5)), rng.normal(size=(40, 5))
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("none", None)], "text string, vec array<float>")
    concepts = spark.createDataFrame([(f"c{i:02d}", x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(c, e))], "uri string, label_vec array<float>, desc_vec array<float>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = 0.6 * unit(q) @ unit(c).T + 0.4 * unit(q) @ unit(e).T
    got = {}
    for r in matching.knn_top_k(queries, concepts, 3).orderBy("text", "rank").collect():
        got.setdefault(r.text, []).append(r.uri)
    assert got == {f"q{i}": [f"c{j:02d}" for j in np.argsort(-scores[i])[:3]] for i in range(7)}
    pair = spark.createDataFrame([("q0", "c00"), ("q0", "gone")], "text string, uri string")
    sims = {r.uri: r.score for r in matching.pair_similarity(pair, queries, concepts).collect()}
    assert abs(sims["c00"] - scores[0, 0]) < 1e-5 and sims["gone"] == 0


def test_answers(spark):
    concepts = spark.createDataFrame([("u1",), ("u2",)], "uri string")
    asked = spark.createDataFrame([(0, "Java"), (0, "SQL")], "batch_id int, raw_skill string")
    numbered = spark.createDataFrame([(0, 1, "u1", "fuzzy"), (0, 2, "u2", "graph_parent")], "batch_id int, id int, uri string, category string")
    said = {"mappings": [
        {"raw_skill": "java", "esco_id": 1, "esco_label": "a", "confidence": 0.5}, {"raw_skill": "Java", "esco_id": ["2"], "esco_label": "b"}, {"raw_skill": "SQL", "esco_uri": "u9", "confidence": 1},
        {"raw_skill": "other", "esco_id": "1", "confidence": 0.2},
    ]}
    answers = spark.createDataFrame([(0, "```json\n" + json.dumps(said) + "\n```"), (1, "junk")], "batch_id int, text string")
    got = candidates.resolve_model_answers(answers, asked, numbered, concepts).collect()
    assert [(r.raw_skill, r.uri, r.confidence, r.via_graph) for r in got] == [("Java", "u2", 0.0, True)]
    assert {r.raw_skill for r in candidates.resolve_model_answers(answers, asked, numbered, concepts, allow_extra=True).collect()} == {"Java", "other"}


def test_graph(spark):
    concepts = spark.createDataFrame([(u,) for u in ("p", "a", "b", "c")], "uri string")
    edges = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("c", "p", 2)], "child_uri string, parent_uri string, edge_ord long")
    found = spark.createDataFrame([(0, "a", 0.9, "fuzzy", ["t"]), (1, "a", 0.8, "fuzzy", [])], "batch_id int, uri string, score double, category string, texts array<string>")
    q = spark.createDataFrame([("t", [1.0, 0.0])], "text string, vec array<float>")
    v = spark.createDataFrame([("b", [1.0, 0.1], [1.0, 0.1]), ("c", [0.0, 1.0], [0.0, 1.0])], "uri string, label_vec array<float>, desc_vec array<float>")
    got = {(r.batch_id, r.uri): (r.category, round(r.score, 2)) for r in candidates.graph_expand(found, edges, concepts, q, v).collect()}
    assert got == {(0, "a"): ("fuzzy", 0.9), (0, "p"): ("graph_parent", 0.9), (0, "b"): ("graph_sibling", 1.0), (1, "a"): ("fuzzy", 0.8), (1, "p"): ("graph_parent", 0.8), (1, "b"): ("graph_sibling", 0.4), (1, "c"): ("graph_sibling", 0.4)}


def test_feed_files(spark, tmp_path):
    job = {"PositionID": "1", "PositionTitle": "Nurse", "OrganizationName": "Acme LLC", "PositionLocation": [{"CityName": "X", "CountrySubDivisionCode": "TX", "CountryCode": "United States"}],
           "PositionRemuneration": [{"MinimumRange": "30000", "MaximumRange": "bad"}], "JobCategory": [], "QualificationSummary": "python",
           "UserArea": {"Details": {"MajorDuties": "one text", "TeleworkEligible": True, "WhoMayApply": "All", "HiringPath": ["a", "b"], "TotalOpenings": "few"}}}
    (tmp_path / "a.json").write_text(json.dumps({"SearchResult": {"SearchResultCountAll": 1, "SearchResultItems": [{"MatchedObjectDescriptor": job}]}}))
    r = feeds.read_federal_json(spark, str(tmp_path / "a.json")).first()
    assert (r.position_id, r.location_country, r.min_salary, r.max_salary, r.series_code, r.major_duties, r.telework_eligible, r.who_may_apply, r.hiring_path, r.total_openings, r.job_type) == (
        "1", "US", 30000.0, 0.0, "", "one text", True, "All", "a, b", 1, "Private")
    assert set(r.required_skills) == {"python"}
    (tmp_path / "c.json").write_text(json.dumps({"jobs": [{"id": " ", "title": "x"}, {"id": 7, "title": "<b>T</b>", "snippet": "s", "salary": "10 000", "updated": "2024-01-02T00"}]}))
    (got,) = feeds.read_aggregator_json(spark, str(tmp_path / "c.json")).collect()
    assert (got.position_id, got.title, got.min_salary, got.salary_type, got.date_posted, got.qualification_summary) == ("jooble_7", "T", 10000.0, "Per Month", "2024-01-02", "T s")


def test_overview_of_nothing(spark):
    p = spark.createDataFrame([], schemas.POSTING)
    s = spark.createDataFrame([], schemas.SKILL)
    r = analytics.overview(p, s, "2001-08-01").first()
    assert (r.total_jobs, r.avg_min_salary, r.remote_percentage, r.unique_skills, r.new_this_week) == (0, 0, 0.0, 0, 0)
    assert analytics.market_snapshot(p, s, "2001-08-01").count() == 0 and analytics.skill_detail(s, p, "x").count() == 0


def test_stream_upsert_is_batch(spark, tmp_path):
    pages = [{"results": [{"id": "1", "title": "a"}, {"id": "2", "title": "b"}]}, {"results": [{"id": "1", "title": "c"}, {"id": "", "title": "d"}]}]
    source = tmp_path / "pages"
    source.mkdir()
    for i, page in enumerate(pages):
        (source / f"{i}.json").write_text(json.dumps(page))
        ingest.ingest_postings(spark, str(source), schemas.BOARD, lambda x: feeds.normalize_board(x.withColumn("country", F.lit("us"))), str(tmp_path / "t"), str(tmp_path / "log")).awaitTermination()
    got = {r.position_id: r.title for r in ingest.latest(spark, str(tmp_path / "t")).collect()}
    assert got == {"1": "c", "2": "b"}


def test_stream_keeps_what_it_has(spark, tmp_path, monkeypatch):
    """Many batches are merged into bases; a lost table or another checkpoint is refused, not begun anew."""
    monkeypatch.setattr(ingest, "MERGE", 3)
    source, want = tmp_path / "pages", {}
    source.mkdir()
    run = lambda log, replace=True: ingest.ingest_postings(spark, str(source), schemas.BOARD, lambda x: feeds.normalize_board(x.withColumn("country", F.lit("us"))), str(tmp_path / "t"), str(tmp_path / log), replace).awaitTermination()
    for i in range(9):
        items = [{"id": str(k), "title": f"{k} in {i}"} for k in {i, i // 2, 100}]
        want |= {x["id"]: x["title"] for x in items}
        (source / f"{i}.json").write_text(json.dumps({"results": items}))
        run("log")
        assert {r.position_id: r.title for r in ingest.latest(spark, str(tmp_path / "t")).collect()} == want
    assert keyed.writes(spark, str(tmp_path / "t" / "base"))[-2:] == [5, 8]
    assert sorted(x.name for x in (tmp_path / "t" / "batches").iterdir()) == ["batch=6", "batch=7", "batch=8"]
    with pytest.raises(ValueError):
        run("other")
    (source / "9.json").write_text(json.dumps({"results": [{"id": "1", "title": "late"}]}))
    (tmp_path / "t").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="batch 8"):
        run("log")
    with pytest.raises(ValueError):
        ingest.latest(spark, str(tmp_path / "t"))


def test_first_write_wins(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    for i, items in enumerate([[("1", "a"), ("1", "b"), ("2", None)], [("1", "c"), ("2", "d")]]):
        (source / f"{i}.json").write_text(json.dumps({"results": [{"id": k, "title": t} for k, t in items]}))
        ingest.ingest_postings(spark, str(source), schemas.BOARD, lambda x: feeds.normalize_board(x.withColumn("country", F.lit("us"))), str(tmp_path / "t"), str(tmp_path / "log"), False).awaitTermination()
    assert {r.position_id: r.title for r in ingest.latest(spark, str(tmp_path / "t"), False).collect()} == {"1": "a", "2": "d"}


def test_ratios_at_once():
    """All labels at once give what one pair at a time gives, long texts and other alphabets too."""
    import random

    from labourmill.functions.ratio import Labels, token_sort_ratio

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcéя😀-") for _ in range(rng.randint(0, 9)))
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))
    known = [text() for _ in range(60)] + ["", "a" * 100, "b " * 40, "abc " * 30]
    labels = Labels(known)
    for mine in [text() for _ in range(40)] + ["", "c" * 62, "c" * 63, "abc " * 25]:
        for least in (0.0, 45.0, 80.0):
            want = {i: token_sort_ratio(mine, t) for i, t in enumerate(known) if mine.split() or t.split()}
            found, scores = labels.ratios(mine, least)
            assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {i: s for i, s in want.items() if s >= least}


@pytest.mark.parametrize("block", [20_000, 7])
def test_blocks_of_labels(spark, monkeypatch, block):
    from labourmill.functions.ratio import token_sort_ratio

    monkeypatch.setattr(matching, "BLOCK", block)
    names = [f"{a} {b}" for a in ("data", "dates", "tada", "nurse") for b in ("one", "two", "eno", "x", "yy")]
    labels = spark.createDataFrame([(t, f"u{i}", i) for i, t in enumerate(names)], "label string, uri string, pos long")
    raw = ["one data", "two nurses", "yyx", "dada"]
    got = {(r.raw_skill, r["rank"]): (r.uri, round(r.score, 9)) for r in matching.fuzzy_top_k(spark.createDataFrame([(x,) for x in raw], "raw_skill string"), labels, 3).collect()}
    for x in raw:
        best = sorted((-token_sort_ratio(x, t), i) for i, t in enumerate(names))[:3]
        assert [got[x, k + 1] for k in range(3)] == [(f"u{i}", round(-s / 100, 9)) for s, i in best]
