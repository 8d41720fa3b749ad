"""Redaction piece by piece: any spans, and texts of megabytes."""

import random
import time

from pyspark.sql import functions as F

from labourmill.llm import pii

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def brute(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_any_spans(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("ab é😀\n") for _ in range(rng.choice([1, 5, 511, 512, 513, 1024, 3000])))
        spans = []
        for _ in range(rng.choice([1, 2, 30, 1300])):
            a = rng.randrange(len(text))
            spans.append((a, rng.randrange(len(pii.KINDS)), min(len(text), a + rng.choice([1, 2, 40, 1500]))))
        rows.append((i, text, sorted(set(spans))))
    df = spark.createDataFrame(rows, f"i long, text string, spans {SPANS}")
    got = {r.i: r.out for r in df.select("i", pii._replaced(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert got == {i: brute(t, s) for i, t, s in rows}


def test_very_many_spans(spark):
    n = 200_000
    df = spark.createDataFrame([(1, "a@b.cc é" * n, 0)], "doc_id long, text string, n_chars long")
    began = time.time()
    row = pii.redact(df).first()
    took = time.time() - began
    print(f"{n} spans in {took:.0f} s")
    assert row.text == "[EMAIL] é" * n and row.n_chars == 9 * n and took < 120
