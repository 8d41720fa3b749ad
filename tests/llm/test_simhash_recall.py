"""The search among fingerprints finds near copies by five-word Jaccard, and all within its radius."""

import random
from collections import Counter

from labourmill.llm import simhash


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def made():
    """Near copies of 25 texts, down to a similarity of about 0.75, and 100 other texts."""
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randint(0, 5000)
    out = [[word() for _ in range(rng.randint(30, 200))] for _ in range(100)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 200))]
        out.append(base)
        for edits in range(1, 6):
            one = list(base)
            for _ in range(edits):
                one[rng.randrange(len(one))] = word()
            out.append(one)
    return out


def test_near_copies_are_found(spark, tmp_path):
    texts = made()
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(df, ["doc_id"]).collect()}
    every = spark.createDataFrame([(x,) for x in prints.values()], "fingerprint long")
    got = {(r["query"], r.found) for r in simhash.near_fingerprints(every, every).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b) for a in prints.values() for b in prints.values() if bits(a, b) <= simhash.RADIUS}
    found = sum((prints[a], prints[b]) in got for a, b in near)
    assert len(near) > 100 and found >= 0.95 * len(near)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = Counter(prints.values())
    want = {(i, sum(n for f, n in rows.items() if bits(prints[i], f) <= simhash.RADIUS)) for i in range(0, len(texts), 20)}
    assert {(r.doc_id, r.n_near) for r in simhash.simhash_neighbours(spark, str(tmp_path)).collect()} == want


def test_wide_radii_find_all(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(8)]
    every = sorted({(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 16)))) for b in base for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for radius, blocks in ((13, 4), (7, 5), (5, 5), (2, 1)):
        got = Counter((r["query"], r.found) for r in simhash.near_fingerprints(df, df, radius, blocks).collect())
        assert got == Counter((a, b) for a in signed for b in signed if bits(a, b) <= radius)


def test_a_frequent_key_is_split(spark, monkeypatch):
    """All fingerprints have one key in a table: tiles and shares still bound what meets in a task."""
    monkeypatch.setattr(simhash, "TILE", 40)
    monkeypatch.setattr(simhash, "SHARE", 30)
    rng = random.Random(6)
    every = sorted({rng.getrandbits(20) << 40 for _ in range(150)})
    df = spark.createDataFrame([(x,) for x in every], "fingerprint long")
    near = simhash.near_fingerprints(df, df, 6, 4)
    got = Counter((r["query"], r.found) for r in near.collect())
    assert got == Counter((a, b) for a in every for b in every if (a ^ b).bit_count() <= 6)
    assert near.rdd.getNumPartitions() >= 4 * 4 * 5
