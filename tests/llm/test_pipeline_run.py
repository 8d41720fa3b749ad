"""The whole pipeline against plain Python: which documents stay, what is redacted, how often each
one comes, and the ids of every piece."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as cp
from labourmill.llm import mixing, packing, pii, shared
from test_operators import base_spans, brute_components, brute_rules  # noqa: I001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(21)
    body = lambda n: " ".join("wörd%d" % rng.randint(0, 4000) for _ in range(n))
    base = body(120)
    near = base.replace(base.split(" ")[60], "other", 1)
    rows = [base, base, near, "too short", None, "", "same words again " * 40, body(40) + " mail x@y.zz or +1 (555) 123-4567 end", body(40) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
    rows += [body(30) + " host 10.0.0.7, card 4111 1111 1111 1111", body(5000), "spam " * 25, "spam spam " * 13]
    rows += [body(rng.randint(25, 90)) for _ in range(60)]
    out = [(i, t, "en", f"s{min(i % 7, 2)}", len(t or "")) for i, t in enumerate(rows)]
    out += [(500 + i, "bad", "en", "poor", 3) for i in range(30)] + [(600, body(50), "en", "poor", 0)]  # a host that is rejected
    return out


def after_rules(rows):
    fails = lambda t: (lambda n, _c, _s, _d, r: n < 20 or 100 * r > 30 * n)(*brute_rules(t))
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(fails(r[1]))
    mean = sum(map(sum, hosts.values())) / len(rows)
    raw = [sum(x) / len(x) for x in hosts.values()]
    spread = sum((x - sum(raw) / len(raw)) ** 2 for x in raw) / len(raw)
    k = max(1, min(1e6, mean * (1 - mean) / spread - 1))
    return [r for r in rows if not fails(r[1]) and (sum(hosts[r[3]]) + mean * k) / (len(hosts[r[3]]) + k) <= 0.5]


def after_duplicates(rows):
    classes = {k: c for k, _, c in brute_components([r[:2] for r in rows])}
    return [r for r in rows if classes[r[0]] == r[0]]


def redacted(spark, rows):
    """Base spans by plain regular expressions; the others are what the operator finds, held to be secrets here."""
    found = {r.doc_id: r.spans for r in pii.find_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = []
    for k, text, *rest in rows:
        spans = sorted({(a, i, b) for a, i, b in base_spans(text)} | {(s.start, s.kind, s.end) for s in found[k] if not s.base})
        assert {(s.start, s.kind, s.end) for s in found[k] if s.base} == set(base_spans(text))
        at, new = 0, ""
        for a, i, b in spans:
            if a >= at:
                new += text[at:a] + f"[{pii.KINDS[i].upper()}]"
            at = max(at, b)
        new += text[at:]
        out.append((k, new, *rest[:-1], len(new)))
    return out


def test_run_is_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    left = after_rules(rows)
    assert {r[0] for r in rows} - {r[0] for r in left} >= {3, 4, 5, 6, 11, 12, 600, *range(500, 530)} and len(left) > 60
    left = redacted(spark, after_duplicates(left))
    texts = {k: t for k, t, *_ in left}
    assert 1 not in texts and 2 not in texts and "[EMAIL]" in texts[7] and "[SECRET]" in texts[8] and "[CARD]" in texts[9]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(left, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    times = Counter(k for k, *_ in con.sql(mixing.ORACLE).fetchall())
    assert times.keys() == texts.keys() and max(times.values()) > 1
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    pieces, at = Counter(), defaultdict(list)
    for r in cp.run(spark, str(tmp_path)).collect():
        own = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert own == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id] += r.length
        at[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({k: n * len(ids[k]) for k, n in times.items()})
    for s, parts in at.items():
        assert sum(n for _, n in parts) == 2048 or s == max(at)


def test_stages_on_odd_tables(spark):
    """Every stage takes an empty table, columns that it doesn't know, and nothing but nulls."""
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "en", "s", 0), (1, " \t", "en", "s", 2)]
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)):
        more = df.withColumns({"set_key": F.lit("x"), "row": F.lit(2), "ids": F.lit("y"), "__host": F.lit("z")})
        for name, stage in cp.STAGES:
            got = stage(spark, df, "").collect()
            clash = more.drop("epoch") if name == "mixing" else more
            assert len(stage(spark, clash, "").collect()) == len(got)
            if name in ("near duplicates", "personal data"):
                assert len(got) == len(df.collect())


def test_materialized_tables_can_go(spark):
    table = shared.materialize(spark.range(10).repartition(3))
    assert table.count() == 10
    path = re.sub("^file:", "", table.inputFiles()[0].rsplit("/", 1)[0])
    import os

    assert os.path.isdir(path.replace("///", "/").replace("//", "/"))
    shared.discard(table)
    shared.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))  # not ours
    assert not os.path.isdir(path.replace("///", "/").replace("//", "/")) and os.path.exists("/root/testdata/sf0.001/region.parquet")
