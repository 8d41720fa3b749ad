"""What is kept up by changes against what is worked out anew."""

import json
import random

from labourmill.operators import analytics, upkeep
from labourmill.sources import keyed
from labourmill.streaming import ingest

POSTING = "position_id string, title string, organization string, location_country string, date_posted string"
SKILL = "position_id string, skill_raw string, skill_esco_uri string, skill_esco_label string, skill_esco_type string, skill_category string"


def test_marts_follow_the_changes(spark, tmp_path):
    rng, path = random.Random(8), str(tmp_path / "t")
    now, tags = {}, {}
    frames = lambda keys: (spark.createDataFrame([(k, t, None, None, None, None) for k in keys for t in tags.get(k, [])], SKILL), spark.createDataFrame([(k, "t", *now[k]) for k in keys if k in now], POSTING))
    rows = lambda df: sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    for change in range(5):
        keys = [f"p{i}" for i in rng.sample(range(60), 60 if not change else 12)]
        # As lists, so that later changes of the dictionaries don't reach them.
        gone = frames(keys)
        for k in keys:
            if k in now and rng.random() < 0.4:
                del now[k], tags[k]
            else:
                now[k] = (rng.choice(["a", "b", "c", None]), rng.choice(["US", "UA", "", None, "DE"]), rng.choice(["2001-01-01", "2001-01-02", "2001-02-03", None]))
                tags[k] = [rng.choice("xyzvw") for _ in range(rng.randrange(4))]
        come = frames(keys)
        assert upkeep.keep_counts(path, come, gone, change, buckets=4)
        assert not upkeep.keep_counts(path, come, gone, change)
        assert rows(upkeep.country_marts(spark, path)) == rows(analytics.country_marts(*frames(list(now))))
    assert keyed.writes(spark, path)[-1] == 4


def test_first_writes_over_restarts(spark, tmp_path):
    """Each run is a stream of its own over what has landed since; the keys before are remembered."""
    source, target, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    source.mkdir()
    rng, want = random.Random(9), {}
    for run in range(3):
        lines = [{"id": rng.choice([f"k{rng.randrange(30)}", f"r{run}"]), "title": rng.choice(["t", None]), "n": 100 * run + i} for i in range(25)] + [{"id": None, "title": "t", "n": 1}]
        (source / f"{run}.json").write_text("\n".join(json.dumps({k: v for k, v in x.items() if v is not None}) for x in lines))
        for x in lines:
            if x["id"] and x["title"]:
                want.setdefault(x["id"], x["n"])
        stream = spark.readStream.schema("id string, title string, n int").json(str(source))
        ingest.first_writes(stream, target, log, "id", "n").awaitTermination()
        got = spark.read.parquet(target).collect()
        assert len(got) == len(want) and {r.id: r.n for r in got} == want
