"""Fingerprints, site posteriors and packed ids against plain Python, on whole small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from labourmill.llm import classifier, packing, queries, simhash

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in regex.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_fingerprint(texts):
    votes, n = [0] * 64, 0
    for text in texts:
        w = words(text)
        for i in range(len(w)):
            h = 42
            for part in w[i : i + simhash.RUN]:
                h = xxhash.xxh64_intdigest(part.encode(), seed=h)
            n += 1
            for b in range(64):
                votes[b] += h >> b & 1
    return f"{sum(1 << b for b in range(64) if 2 * votes[b] > n):016x}"


def test_registered_fingerprints(spark):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op3_simhash"](spark, SF).collect()}
    prints = {k: brute_fingerprint([t]) for k, t in rows}
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        following, other = rows[(i + 1) % len(rows)]
        cut = len(t) // 4
        edited = brute_fingerprint([t[: len(t) - cut] + other[:cut]])
        r = got[k]
        assert (r.fingerprint, r.edited_fingerprint) == (prints[k], edited)
        assert (r.near_edited, r.near_next) == (like(prints[k], edited), like(prints[k], prints[following]))


def test_fingerprints_of_odd_texts(spark):
    texts = [None, "", " \n", "one", "one two", "one one one one", "é 😀 ö " * 9, "x" * 9000, " ".join(str(i) for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, "two three")], "k int, text string")
    got = {r.k: f"{r.fingerprint & (2**64 - 1):016x}" for r in simhash.fingerprints(df, ["k"]).collect()}
    assert got == {i: brute_fingerprint([t, "two three"] if i == 3 else [t]) for i, t in enumerate(texts)}


def brute_features(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if x.strip(" ")]
    share = lambda part, whole: 0 if part == 0 else min(20, math.ceil(20 * part / max(whole, 1)))
    count = lambda pattern: sum(len(x) for x in regex.findall(pattern, text))
    n, chars = len(w), len(text)
    return [
        f"words{math.floor(2 * (math.log(n + 1) / math.log(2)))}", f"length{min(30, math.floor(2.0 * chars / max(n, 1)))}", f"upper{share(count(r'\p{Lu}'), chars)}", f"digit{share(count('[0-9]'), chars)}",
        f"symbol{share(count(r'[#*$%&|<>{}=_~^+@\\/]'), chars)}", f"stop{share(count('[.,;:!?]'), n)}", f"mark{share(count('!'), n)}", f"distinct{share(len(set(w)), n)}", f"line{share(len(lines) - len(set(lines)), len(lines))}",
    ]


def brute_classes(docs, labels):
    """doc_id: (host_quality, path_quality, score), all by sums over the other documents."""
    features = {k: brute_features(t) for k, t, _, _ in docs}
    good = [(features[k], q == 1) for k, q in labels if k in features and q is not None]
    yes, no = Counter(f for x, g in good if g for f in x), Counter(f for x, g in good if not g for f in x)
    n_yes = sum(g for _, g in good)
    n_no = len(good) - n_yes
    weight = {f: math.log((yes[f] + 1) / (n_yes + 2) / ((no[f] + 1) / (n_no + 2))) for f in {*yes, *no}}
    prior = (n_yes + 1) / (len(good) + 2)
    logit = lambda p: math.log(p / (1 - p))
    odds = lambda x: 1 / (1 + math.exp(-x))
    evidence = {k: round(classifier.EVIDENCE * sum(weight.get(f, 0.0) for f in x), 9) for k, x in features.items()}
    p = {k: odds(logit(prior) + e) for k, e in evidence.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for k, _, host, path in docs:
        hosts[host].append(p[k])
        paths[host, path].append(p[k])
    mean = sum(p.values()) / len(p)
    spread = lambda x, m: sum((y - z) ** 2 for y, z in zip(x, m, strict=True)) / len(x)
    bounded = lambda m, s: max(1.0, min(1e6, m * (1 - m) / s - 1)) if s > 0 else 1e6
    rates = [sum(x) / len(x) for x in hosts.values()]
    k_host = bounded(mean, spread(rates, [sum(rates) / len(rates)] * len(rates)))
    quality = {h: (sum(x) + k_host * mean) / (len(x) + k_host) for h, x in hosts.items()}
    own = [quality[h] for h, _ in paths]
    k_path = bounded(sum(own) / len(own), spread([sum(x) / len(x) for x in paths.values()], own))
    out = {}
    for k, _, host, path in docs:
        rest = (sum(p.values()) - p[k] + prior) / len(p)
        of_host = (sum(hosts[host]) - p[k] + k_host * rest) / (len(hosts[host]) - 1 + k_host)
        of_path = (sum(paths[host, path]) - p[k] + k_path * of_host) / (len(paths[host, path]) - 1 + k_path)
        out[k] = of_host, of_path, odds(logit(min(max(of_path, 1e-6), 1 - 1e-6)) + evidence[k])
    return out


def agrees(got, want):
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert all(abs(a - b) < 1e-7 for a, b in zip((r.host_quality, r.path_quality, r.score), want[r.doc_id], strict=True)), r
        assert r.keep == (r.score >= 0.5)


def test_registered_classifier(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    agrees(queries.QUERIES["op8_classifier"](spark, SF).collect(), brute_classes(docs, labels))


@pytest.mark.parametrize("hot", [10_000, 3])
def test_classes_of_odd_rows(spark, monkeypatch, hot):
    from labourmill.llm import shared

    monkeypatch.setattr(shared, "HOT", hot)  # with 3 most sites are shuffled
    rng = random.Random(3)
    docs = [(i, None if i == 7 else " ".join(rng.choice(["A", "b", "C!", "7", "d d"]) for _ in range(rng.randint(0, 40))), rng.choice(["h0", "h1", "h2", "h3", None]), rng.choice(["x", "y", None])) for i in range(80)]
    docs += [(200, "alone", "only", "z")]
    labels = [(i, rng.randint(0, 1)) for i in range(0, 80, 2)] + [(3, None), (999, 1), (4, 1)]
    frame = spark.createDataFrame([(*d, "clash", 0.5) for d in docs], "doc_id long, text string, source string, lang string, host string, p double")
    agrees(classifier.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect(), brute_classes(docs, labels))


def test_packed_ids_and_their_checksums(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in rows}
    pieces, used = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op6_packing"](spark, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for k, parts in pieces.items():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))]))[:-1] and sum(n for _, n in parts) == len(ids[k])
    for parts in used.values():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))]))[:-1] and sum(n for _, n in parts) <= 2048
    assert sum(sum(n for _, n in parts) < 2048 for parts in used.values()) <= 1


def test_ids_of_random_texts():
    """The faster encoder gives what the tokenizer's own library gives, on letters of every kind."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    rng, tokenizer, own = random.Random(6), Tokenizer.from_file(path), packing._encoder(path)
    kinds = ["abc the ' re s t", "\n\t \x0b\r   x", "0123456789²½٣", "éüßñçøЖя中文日本", "😀👩‍👩️́", "!?#{}()_-+=<|>'\"", "<|endoftext|>"]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x3FFFF)])) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["<|endoftext|>" * 3, "a <|endoftext|> b", "'LL 'Re", " " * 50 + "x" + " " * 50]
    assert own(texts) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
