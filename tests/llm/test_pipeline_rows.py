"""The pipeline with null and repeated doc_ids, held against a brute-force deduplication."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from labourmill.llm.shared import key_text, materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Groups of linked rows."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r)
    return list(groups.values())


def made():
    rng = random.Random(11)
    body = lambda n: " ".join("wörd%d" % rng.randint(0, 3000) for _ in range(n))

    def near(text):
        w = text.split(" ")
        w[len(w) // 2] = "other"
        return " ".join(w)

    a, b, c, d, e, f = (body(90) for _ in range(6))
    texts = [
        (None, a), (None, b), (None, near(b)), (None, c), (None, c), (7, c), (None, near(c)),  # alone; two; copies of a row with an id
        (1, d), (1, e), (1, near(e)), (1, near(d)), (2, near(d)), (2, body(90)), (2, f), (3, f), (3, f), (3, body(60)),
    ]
    texts += [(None, body(70)) for _ in range(6)] + [(20 + i % 3, body(70)) for i in range(6)]
    return [(k, t, "en", f"s{len(t) % 2}", len(t)) for k, t in texts]


def test_one_row_of_each_group(spark):
    rows = made() + [(None, None, "en", "s0", 0), (None, " \n", "en", "s1", 0), (1, "", "en", "s0", 0), (1, "", "en", "s0", 0)]
    kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()]
    groups = brute(rows)
    assert len(kept) == len(groups)
    for group in groups:
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert sum((k is None, k or 0) == least and any(t == r[1] and k == r[0] for r in group) for k, t in kept) >= 1
    worded = [k for k in kept if (k[1] or "").strip()]
    assert Counter(next(i for i, g in enumerate(groups) if any(r[1] == t for r in g)) for _, t in worded).most_common(1)[0][1] == 1


def test_run_keeps_unlinked_rows(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    clean = [tuple(r) for r in cp.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()]
    groups = brute(clean)
    assert len(clean) == len(rows) and len(groups) > len({r[0] for r in rows})
    hashes = {(r.doc_id, r.text): r.h for r in spark.createDataFrame(clean, SCHEMA).select("doc_id", "text", F.xxhash64(key_text(F.col("doc_id")), "text").alias("h")).collect()}
    least = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[0], r[1]])) for g in groups]
    now = spark.createDataFrame(least, SCHEMA)
    for _, stage in cp.STAGES[2:-1]:
        now = materialize(stage(spark, now, ""))
    want = cp.STAGES[-1][1](spark, now, "")
    pieces = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.filter("start = 0").collect())
    assert pieces(got) == pieces(want)
    assert {k for k, _ in pieces(got)} == {r[0] for r in least}
