"""Label search by pairs of letters against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from labourmill.functions.ratio import token_sort_ratio
from labourmill.operators import matching


def edited(rng, text):
    letters = list(text)
    for _ in range(rng.randrange(6)):
        at = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 and letters:
            letters.pop(min(at, len(letters) - 1))
        else:
            letters.insert(at, rng.choice("abcdeé "))
    return "".join(letters)


@pytest.mark.parametrize("least", [80.0, 85.0, 100.0])
def test_candidates_lose_no_pair(spark, monkeypatch, least):
    monkeypatch.setattr(matching, "BLOCK", 100)
    rng = random.Random(int(least))
    word = lambda n: "".join(rng.choice("abcdefghijklmno") for _ in range(n))
    names = {" ".join(word(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5))) for _ in range(300)} | {"a", "ab", "abc", "b a", "aaaa", "aaaaaaaaaa", "abababababab", "x" * 90}
    names = sorted(names)
    raw = sorted({edited(rng, rng.choice(names)) for _ in range(250)} | {"", " ", "a", "aaa", "ba", "b", "aaaaaaaa", "babababababa", "x" * 80, "y"})
    labels = spark.createDataFrame([(t, f"u{i}", i) for i, t in enumerate(names)], "label string, uri string, pos long")
    asked = spark.createDataFrame([(t,) for t in raw], "raw_skill string")
    want = {(r, t): token_sort_ratio(r.lower(), t) for r in raw if r.strip() for t in names}
    want = {pair: s for pair, s in want.items() if s >= least}
    candidates = {tuple(x) for x in matching.fuzzy_candidates(asked, labels, least).collect()}
    assert set(want) <= candidates
    print(f"least {least}: {len(want)} pairs, {len(candidates)} candidates of {len(raw) * len(names)}")
    assert len(candidates) <= 0.05 * len(raw) * len(names)
    got = {(r.raw_skill, r.label): r.score for r in matching.fuzzy_top_k(asked, labels, 1000, least).collect()}
    assert {k: round(100 * s, 9) for k, s in got.items()} == {k: round(s, 9) for k, s in want.items()}


def test_top_k_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 10)
    rng = random.Random(2)
    names = [f"{a} {b}" for a in ("data", "dates", "tada", "nurse", "nursing") for b in ("one", "two", "eno", "x", "yy")]
    labels = spark.createDataFrame([(t, f"u{i}", i) for i, t in enumerate(names)], "label string, uri string, pos long")
    raw = sorted({edited(rng, rng.choice(names)) for _ in range(40)} - {""})
    raw = [r for r in raw if r.strip()]
    got = {}
    for r in matching.fuzzy_top_k(spark.createDataFrame([(x,) for x in raw], "raw_skill string"), labels, 3).orderBy("raw_skill", "rank").collect():
        got.setdefault(r.raw_skill, []).append((r.uri, round(r.score, 9)))
    for x in raw:
        best = sorted((-token_sort_ratio(x.lower(), t), i) for i, t in enumerate(names))[:3]
        assert got[x] == [(f"u{i}", round(-s / 100, 9)) for s, i in best]


def test_gram_numbers(spark):
    row = spark.range(1).select(matching._grams(F.lit("abab"), 2).alias("a"), matching._grams(F.lit("a"), 2).alias("b"), matching._grams(F.lit("aab"), 1).alias("c")).first()
    assert (row.a, row.b, row.c) == (["ab#0", "ab#1", "ba#0"], [], ["a#0", "a#1", "b#0"]) or (len(set(row.a)), row.b, len(set(row.c))) == (3, [], 3)
