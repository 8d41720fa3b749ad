"""The training-data operators on small tables with every odd row, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from labourmill.llm import chat, classifier, components, jaccard, mixing, packing, pii, quality, sharding, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, kept string, bucket int, block int, epoch string"
SPACE = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def texts():
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated lines and windows."""
    rng = random.Random(7)
    vocabulary = ["wörd%d" % i for i in range(60)] + ["The", "of", "a"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, shared = sentence(120), sentence(50)
    near = base.split(" ")
    near[60] = "other"
    out = [None, "", " \n\t ", "one", "one two three", "ONE two three", base, base, " ".join(near), base.upper(), shared + " " + sentence(90), sentence(90) + "\n" + shared, sentence(40) + " " + shared + " " + shared]
    out += ["a b c d e f g h\n" * 12, "#$ %& x" * 30, " ".join(["same"] * 200), sentence(30_000), "é" * 50_000, "tab\there\x0bthere\x0c\r\n" + sentence(30), "emoji 😀 " * 10 + sentence(25)]
    out += [sentence(rng.randint(1, 150)) for _ in range(25)]
    return out


def table(spark):
    rows = [(i if i != 5 else None, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[6], rows[6], rows[0]]  # repeated rows
    return spark.createDataFrame([(*r, "x", "x", 1, 2, "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    df = table(spark)
    df.cache()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_is_the_turn_taking_fill(spark, docs, empty):
    names, m = [f"n{i}" for i in range(7)], 211
    got = {r.slot: r.shard for r in sharding.shard_table(spark, names, m).collect()}
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = [[(h(n + ":offset") % m + j * (h(n + ":skip") % (m - 1) + 1)) % m for j in range(m)] for n in names]
    want = {}
    for turn in range(m):
        slot = next(s for s in order[turn % 7] if s not in want)
        want[slot] = turn % 7
    assert got == want
    fewer = {r.slot: r.shard for r in sharding.shard_table(spark, names[:-1], m).collect()}
    assert sum(fewer[s] != got[s] for s in got if got[s] != 6) < 0.2 * m
    placed = sharding.assign_shards(docs, "doc_id", sharding.shard_table(spark, names, m), m)
    assert placed.count() == docs.count() and placed.filter("slot is null or shard is null").count() == 0
    assert sorted(placed.columns) == sorted({*docs.columns, "shard"})
    assert all(len({x.shard for x in placed.filter(F.col("doc_id").eqNullSafe(F.lit(k))).collect()}) == 1 for k in (6, None))
    assert sharding.assign_shards(empty, "doc_id", sharding.shard_table(spark, names, m), m).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_table(spark, names, 210)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def private_texts():
    rng = random.Random(3)
    alphabet = ["a", "Z", "7", "0", "1", ".", "@", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "\n", "4111111111111111", "10.0.0.255", "x@y.zz", "+1 (555) 123-4567"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000255.1.1.256 000255.1.1.25", "4111 1111-1111 1111 2", "é😀 x@y.zz", "+1" + " " * 50_000, "9" * 60_000, "a" * 60_000 + "@b.cc", "a@" * 20_000, "x@y.zz " * 1500,
            'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', *made]


def test_private_spans(spark):
    rows = list(enumerate(private_texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(1, "", "x", 1)], "doc_id long, text string, spans string, kind int").repartition(2)
    got = defaultdict(list)
    for r in pii.find_spans(df).collect():
        got[r.doc_id].append([tuple(s) for s in r.spans])
    assert len(got[1]) == 2
    for i, t in rows:
        for spans in got[i]:
            assert [(a, k, b) for a, k, b, base in spans if base] == base_spans(t), i
            assert spans == sorted(spans) and all(k >= 4 for _, k, _, base in spans if not base)
    clean = {r.doc_id: r for r in pii.redact(df.withColumn("n_chars", F.length("text").cast("int"))).collect()}
    assert clean[6].text == "é😀 [EMAIL]" and clean[6].n_chars == 10 and clean[0].text is None
    assert all(not base_spans(clean[i].text) for i in (2, 5, 11))
    assert pii.find_spans(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_label_model_learns_who_is_right(spark):
    rng, rows = random.Random(1), []
    for _ in range(4000):
        true = rng.random() < 0.3
        vote = lambda right, y=true: (1 if y else -1) * (1 if rng.random() < right else -1)
        rows.append((0, [vote(0.95), vote(0.9), vote(0.85), vote(0.5), 0, vote(0.9)], true))
    df = spark.createDataFrame(rows, "kind int, votes array<tinyint>, y boolean")
    told = pii.label_model(df).collect()
    p = {tuple(r.votes): r.p for r in told}
    assert sum((p[tuple(v)] > 0.5) == y for _, v, y in rows) > 0.97 * len(rows)


def test_simhash(spark, docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (k, t) in enumerate(order):
        n, nxt = len(t) // 4, order[(i + 1) % len(order)][1]
        want[(k, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest())] += 1
    for size in (500, 4):  # one bucket, and many
        got = simhash.edit_likeness(docs, size).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert simhash.edit_likeness(empty).count() == 0
    alone = simhash.edit_likeness(docs.filter("doc_id = 8")).first()
    assert alone.near_next == 1.0


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    near = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 62, rng.integers(0, 6)))) for b in base for _ in range(4)]
    every = sorted({int(b) for b in base} | set(near))
    df = spark.createDataFrame([(x,) for x in every] + [(every[0],), (None,)], "fingerprint long")
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    for radius, blocks in ((3, 6), (0, 1), (4, 6)):
        got = Counter((r["query"], r.found) for r in simhash.near_fingerprints(df.filter("fingerprint > 0"), df, radius, blocks).collect())
        assert got == Counter((a, b) for a in every if a > 0 for b in every if bits(a, b) <= radius)


def shingle_set(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i][0], len(sets[i]), rows[i][0] if not sets[i] else least[root(i)]) for i in range(len(rows)))


def near_copies(seed, n, length, edits):
    rng = random.Random(seed)
    base = ["w%d" % rng.randint(0, 5000) for _ in range(length)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(rng.randint(0, edits)):
            one[rng.randrange(length)] = "w%d" % rng.randint(0, 5000)
        out.append(" ".join(one))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_jaccard(spark, docs, empty, large, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(1, 60, 100, 8) + near_copies(2, 25, 60, 4))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, set_key string, n int").repartition(5)
    if large:  # cells over the bound go the other way
        monkeypatch.setattr(jaccard, "CELL_SETS", 7)
        monkeypatch.setattr(jaccard, "PIVOTS", 2)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect())
    assert got == brute_components(rows)
    if not large:
        assert jaccard.similar_documents(empty).count() == 0


def test_t_occurrence(spark):
    made = near_copies(3, 40, 80, 10)
    sets = [sorted(hash(s) & (2**63 - 1) for s in shingle_set(t)) for t in made]
    rows = {"set_key": list(range(len(sets))), "n": [len(s) for s in sets], "tokens": [np.array(s, np.uint64).tobytes() for s in sets], "text": [zstandard.compress(t.lower().encode()) for t in made]}
    task = jaccard._Sets(pa.table(rows), 5, 75)
    task.search(list(range(len(sets))), list(range(len(sets))))
    want = brute_components(list(enumerate(made)))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[task.root(i)].append(i)
    assert Counter((i, len(sets[i]), min(g)) for g in groups.values() for i in g) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_rules(text):
    w, t = words(text), text or ""
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, empty):
    source = docs.withColumn("source", F.when(F.col("doc_id") < 6, "bad").otherwise(F.col("source")))
    rows = [(r.doc_id, r.text, r.source) for r in source.collect()]
    got = quality.judge(source, keep=["doc_id", "text", "source"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((k, *brute_rules(t)) for k, t, _ in rows)
    fails = lambda t: (lambda n, _c, _s, _d, r: n < 20 or 100 * r > 30 * n)(*brute_rules(t))
    hosts = defaultdict(list)
    for _, t, s in rows:
        hosts[s].append(fails(t))
    rates = {s: sum(x) / len(x) for s, x in hosts.items()}
    mean = sum(map(sum, hosts.values())) / len(rows)
    spread = sum((r - sum(rates.values()) / len(rates)) ** 2 for r in rates.values()) / len(rates)
    k = max(1, min(1e6, mean * (1 - mean) / spread - 1))
    verdict = {s: (sum(x) + mean * k) / (len(x) + k) for s, x in hosts.items()}
    assert verdict["bad"] > 0.5 > min(verdict.values())
    assert all(abs(r.host_rate - verdict[r.source]) < 1e-8 and r.kept == (not fails(r.text) and verdict[r.source] <= 0.5) for r in got)
    kept = quality.filter_documents(source)
    assert kept.columns == source.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality.judge(empty).count() == 0 and quality.filter_documents(empty).count() == 0


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    reference = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "a <|endoftext|> b 'll    \n\n x1234567", "x")], "doc_id long, text string, length string")
    df = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    pieces = packing.pack(df, length=64).collect()
    ids = Counter((r.doc_id, tuple(reference.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in df.collect())
    whole, sequences = defaultdict(dict), defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        at = r.sequence_id * 64 + r.offset
        whole[(r.doc_id, at - r.start)][r.start] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    got = Counter()
    for (doc_id, _), parts in whole.items():
        joined = np.frombuffer(b"".join(parts[s].ids for s in sorted(parts)), "<u4")
        first = parts[0]
        assert first.opens and first.doc_tokens == len(joined)
        got[(doc_id, tuple(int(x) for x in joined))] += 1
    assert got == ids
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(sequences)
    assert packing.pack(empty).count() == 0
    assert zlib.crc32(b"") == 0


def brute_repeats(rows, size):
    seen = Counter(tuple(w[i : i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = Counter()
    for k, t in rows:
        w = words(t)
        hit = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out[(k, len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit))] += 1
    return out


@pytest.mark.parametrize("size,run", [(35, 5), (6, 2)])
def test_substrings(spark, docs, empty, size, run):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, size, run).collect())
    assert got == brute_repeats(rows, size)
    if size == 35:
        assert substring.remove_repeats(empty).count() == 0


def test_classifier_held_out(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        host, good = f"h{i % 4}", rng.random() < (0.9 if i % 4 else 0.2)
        text = " ".join("wörd%d" % rng.randint(0, 400) for _ in range(rng.randint(30, 90))) if good else "BUY!! $$$ NOW " * rng.randint(3, 30)
        rows.append((i, text, host if i % 50 else None, "x", "clash", 1.0))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None, None)], "doc_id long, text string, source string, lang string, host string, score double")
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs, known).collect()
    assert len(got) == 601
    right = [r.keep == bool(labels[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id % 2 == 0]
    assert sum(right) > 0.95 * len(right) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert classifier.classify(docs, known.limit(0)).count() == 601 and classifier.classify(docs.limit(0), known).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("a", "p", 0.9)] * 500 + [("a", "q", 0.0)] + [("b", "p", 0.1)] * 500 + [("c", "p", 1.0)]
    got = {(r.host, r.path): r for r in classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got[("a", "p")].path_quality > 0.85 and got[("b", "p")].path_quality < 0.15
    assert got[("a", "q")].path_quality > 0.2 and 0.5 < got[("c", "p")].host_quality < 1


def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes é"), (1, 2, "user", "more"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (4, 0, "user", "other"), (4, 0, "user", "other"),
        (5, 0, None, None), (None, 0, "user", "hi"), (6, 3, "user", "hi"), (6, 9, "assistant", "yes é"), (6, 10, "user", "more"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.chosen_id: r for r in chat.preference_rows(chat.pair_by_opening(chat.assemble(df))).collect()}
    hi = "<|im_start|>user\nhi<|im_end|>\n"
    assert set(got) == {None, 2, 6, 4, 5}
    assert (got[None].rejected_id, got[None].prompt_turns, got[None].prompt, got[None].chosen, got[None].chosen_mask) == (1, 1, hi, "", "")
    assert got[None].rejected == "<|im_start|>assistant\nyes é<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    a, b = map(int, got[None].rejected_mask.split(":"))
    assert got[None].rejected[a:b] == "yes é<|im_end|>"
    assert (got[2].rejected_id, got[2].prompt_turns, got[2].rejected) == (3, 1, "")
    assert (got[6].rejected_id, got[6].prompt, got[6].rejected, got[6].rejected_mask) == (None, "", None, None)
    assert got[4].chosen.count("other") == 2 and got[5].chosen == "<|im_start|>\n<|im_end|>\n"
    assert chat.preference_rows(chat.pair_by_opening(chat.assemble(df.limit(0)))).count() == 0


def test_mixing(spark, empty):
    rng, rows = random.Random(6), []
    for s, n in (("big", 3000), ("mid", 600), ("low", 60), (None, 40)):
        rows += [(len(rows) + i, s, rng.randint(1, 50)) for i in range(n)]
    rows += [(None, "none", 0), (None, "none", 0), (3, "big", 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, tokens long, epoch string")
    got = mixing.mix(df, F.col("tokens"), max_repeats=8.0, target_entropy=None).groupBy("source").agg(F.sum("tokens").alias("t"), F.max("epoch").alias("e"), F.count(F.lit(1)).alias("n")).collect()
    total = Counter()
    for _, s, t in rows:
        total[s] += t
    seen = {r.source: r.t / total[r.source] for r in got if total[r.source]}
    assert abs(seen["big"] - 1) < 0.02 and abs(seen[None] - 8) < 0.4 and 1 < seen["mid"] < seen["low"] <= 8.2
    assert {r.source: r.n for r in got}["none"] == 2
    weights = {r.source: r.weight for r in mixing.source_weights(spark.createDataFrame([("a", 80), ("b", 15), ("c", 5), ("z", 0)], "source string, tokens long"), 0.9, None).collect()}
    p = [weights[k] for k in "abc"]
    assert weights["z"] == 0 and abs(sum(p) - 1) < 1e-9 and abs(-sum(x * math.log(x) for x in p) - 0.9 * math.log(3)) < 1e-6
    some = mixing.mix(df, F.col("tokens"), budget=sum(total.values()) // 2, target_entropy=None, max_repeats=1.0).agg(F.sum("tokens")).first()[0]
    assert abs(some / (sum(total.values()) / 2) - 1) < 0.05
    assert mixing.mix(empty, F.lit(1)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    rng = random.Random(8)
    body = lambda n: " ".join("wörd%d" % rng.randint(0, 3000) for _ in range(n))
    base = body(100)
    rows = [(0, base, "en", "s0", 0), (1, base, "en", "s1", 0), (2, body(80) + " mail x@y.zz end", "en", "s0", 0), (3, "too short", "en", "s0", 0), (4, None, "en", "s1", 0)]
    rows += [(10 + i, body(60), "en", f"s{i % 2}", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now = docs
    for _, stage in cp.STAGES[:2]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.collect()) == [0, 2, *range(10, 30)]
    assert [name for name, _ in cp.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
