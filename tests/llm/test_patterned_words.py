"""Words whose letters follow patterns, and windows that one hash calls equal, are told apart."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labourmill.llm import jaccard, substring
from labourmill.llm import words as wd

OTHER = str.maketrans("ab", "ba")
KEY = wd.Key.draw()


def thue_morse(doublings):
    out = "a"
    for _ in range(doublings):
        out += out.translate(OTHER)
    return out


def patterned():
    """One-word texts: Thue-Morse words, their complements, rotations and powers; and lists of such words."""
    words = [w for k in range(6, 15) for w in (thue_morse(k), thue_morse(k).translate(OTHER))]
    words += ["ab" * 2048, "ba" * 2048, "a" * 4096, "a" * 4097, "\0a", "a\0", "a", "a\0\0"]
    words += [thue_morse(11)[k:] + thue_morse(11)[:k] for k in range(1, 20)]
    return list(dict.fromkeys(words))


def test_hashes_differ():
    words = patterned()
    assert len(set(wd.split(pa.array(words), KEY).hash.tolist())) == len(words)
    a, b = thue_morse(12), thue_morse(12).translate(OTHER)
    texts = [" ".join(a), " ".join(b)]  # the pattern in words, not letters
    w = wd.split(pa.array(texts), KEY)
    for size in (4096, 2048, 1024, 35, 5):
        at, hashes = w.windows(size)
        said = [tuple(texts[int(i >= 4096)].split()[i % 4096 : i % 4096 + size]) for i in at]
        assert len(set(said)) == len(set(hashes.tolist())) and len(set(zip(said, hashes.tolist(), strict=True))) == len(set(said))


def test_windows_of_any_size():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["x", "yy", "é" * 40, "z" * 9]) for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None]
    w = wd.split(pa.array(texts), KEY)
    for size in range(1, 40):
        at, hashes = w.windows(size)
        parts = [tuple(t.split()[i : i + size]) for t in texts if t is not None for i in range(len(t.split()) - size + 1)]
        assert len(at) == len(parts) and len(set(zip(parts, hashes.tolist(), strict=True))) == len(set(parts)) == len(set(hashes.tolist()))


def test_no_link_between_complements(spark):
    words = patterned()
    a, b = thue_morse(13), thue_morse(13).translate(OTHER)
    tail = " ".join("w%d" % i for i in range(40))
    rows = list(enumerate([*words, f"{a} {tail}", f"{b} {tail}"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    n = len(words)
    assert all(got[i] == (1, i) for i in range(n)) and got[n] == (37, n) and got[n + 1] == (37, n)  # the last two share 36 of 38
    left = [f"{a} " + " ".join("u%d" % i for i in range(40)), f"{b} " + " ".join("v%d" % i for i in range(40))]
    removed = substring.remove_repeats(spark.createDataFrame(list(enumerate(left)), "doc_id long, text string")).collect()
    assert {(r.n_words, r.n_removed) for r in removed} == {(41, 0)}


def test_hashes_that_meet_are_told_apart():
    w = wd.split(pa.array(["a b c d e f", "a b c x y z", "c d e"]), KEY)
    first, hashes = w.windows(3)
    words = [x for t in ("a b c d e f", "a b c x y z", "c d e") for x in t.split()]
    said = [tuple(words[i : i + 3]) for i in first]
    for weak in (hashes, hashes & wd.U(1), hashes & wd.U(0)):
        where = substring.equal_windows(w, first, weak, 3)
        assert len(set(zip(said, where.tolist(), strict=True))) == len(set(said)) == len(set(where.tolist()))


#: Two words that one fixed hash took for the same (found by solving its last step), and windows and texts around them.
MET = ("mntyadvygiwlhvgk", "ldekccvbn)$<`}(5")


def test_words_made_to_meet(spark):
    for _ in range(5):
        w = wd.split(pa.array(list(MET)), wd.Key.draw())
        assert len(set(w.hash.tolist())) == len(set(w.other.tolist())) == 2
    rows = list(enumerate(MET))
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1}
    passage = " ".join(f"p{i}" for i in range(34))
    rows = [(i, f"{passage} {MET[i % 2] if i < 2 else f'u{i}'} {i}a {i}b") for i in range(302)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()) == brute_repeats(rows, 35)


@pytest.mark.parametrize("bits", [0, 2])
def test_weak_hashes_change_nothing(spark, monkeypatch, bits):
    """With hashes of windows that nearly all meet, words decide."""
    whole = substring.window_hashes

    def weak(w, at, window):
        out = whole(w, at, window)
        out["a"], out["b"] = out["a"] & wd.U(((1 << bits) - 1) << 32), 0
        return out

    rng = random.Random(4)
    body = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n))
    passage = body(50)
    rows = [(i, f"{body(20)} {passage} {body(20)}") for i in range(12)] + [(50 + i, f"{passage[:100]} {body(30)}") for i in range(6)]
    w = wd.split(pa.array([t for _, t in rows]), KEY)
    at = w.begins(35)
    said = [tuple(w.data.tobytes()[w.start[i] : w.end[i + 34]].split()) for i in at]
    where = substring.equal_windows(w, at, weak(w, at, 35), 35)
    assert len(set(zip(said, where.tolist(), strict=True))) == len(set(said)) == len(set(where.tolist()))
    left, key = spark.createDataFrame(rows, "doc_id long, text string"), wd.Key.draw()
    opened = [np.arange(max(0, len(t.split()) - 34), dtype="<u4").tobytes() for _, t in rows]
    asked = spark.createDataFrame([(k, k, bytearray(o), t) for (k, t), o in zip(rows, opened, strict=True)], "doc_id long, h long, open binary, text string")
    second = substring._second_pass(asked, 35, substring.exchange_for(left), key).collect()
    hit = {r.doc_id: {j for a, b in np.frombuffer(r.ranges, "<u4").reshape(-1, 2).tolist() for j in range(a, b)} for r in second}
    want = {k: n for (k, _, n, _), c in brute_repeats(rows, 35).items() if n}
    assert {k: len(v) for k, v in hit.items()} == want


def test_links_need_equal_words():
    """Sets whose hashes all meet, but whose words don't, have no link."""
    import zstandard

    texts = [b"a b c d e f g", b"a b c d e f x", b"h i j k l m n", b"a b c d e f g"]
    tokens = np.arange(3, dtype=np.uint64).tobytes()
    table = pa.table({"set_key": list(range(4)), "n": [3] * 4, "tokens": [tokens] * 4, "text": [zstandard.compress(t) for t in texts]})
    task = jaccard._Sets(table, 5, 75)
    task.connect()
    assert task.links in ([(0, 3)], [(3, 0)])


def brute_repeats(rows, size):
    seen = Counter(tuple(w[i : i + size]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - size + 1))
    out = Counter()
    for k, t in rows:
        w = (t or "").split()
        hit = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out[(k, len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit))] += 1
    return out


@pytest.mark.parametrize("hot", [2, 4, 255])
def test_hot_minimisers_go_by_window(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "MOST", hot)
    rng = random.Random(2)
    body = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(n))
    passage, other = body(60), body(20)
    rows = [(i, f"{body(rng.randint(0, 30))} {passage} {body(rng.randint(0, 30))}") for i in range(20)]
    rows += [(100 + i, f"{other} {body(30)} {other}") for i in range(20)] + [(200, "same " * 500), (201, "same " * 70 + passage), (202, None), (203, passage[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect())
    assert got == brute_repeats(rows, 35)


def test_two_hashes_of_windows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (200, 36, 35, 80)]
    w = wd.split(pa.array(texts), KEY)
    at, hashes = w.windows(6)
    pairs = substring.window_hashes(w, at, 6)
    said = [tuple(t.split()[i : i + 6]) for t in texts for i in range(len(t.split()) - 5)]
    assert (pairs["a"] == hashes).all() and not (pairs["a"] == pairs["b"]).any()
    for x in (pairs["a"], pairs["b"], pairs):
        assert len(set(zip(said, x.tolist(), strict=True))) == len(set(said)) == len(set(x.tolist()))
