"""Keyword search by grams against the comparison of all rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labourmill.operators import predicates, textindex

ROWS = "id long, title string, qualification_summary string"


def made(rng, n):
    word = lambda: "".join(rng.choice("abcdeéßÜ_%\\İΣ😀") for _ in range(rng.randrange(1, 9)))
    text = lambda: None if rng.random() < 0.1 else " ".join(word() for _ in range(rng.randrange(0, 9)))
    return [(None if rng.random() < 0.02 else rng.randrange(n), text(), text()) for _ in range(n)]


def keywords(rng, rows, n):
    """Parts of texts, in another case or with wildcards in them, and some that nothing has."""
    texts = [t for r in rows for t in r[1:] if t]
    for _ in range(n):
        t = rng.choice(texts)
        i = rng.randrange(len(t))
        k = list(t[i : i + rng.randrange(1, 12)])
        if rng.random() < 0.4:
            k[rng.randrange(len(k))] = rng.choice("%_")
        yield rng.choice([str.upper, str.lower, str])("".join(k))
    yield from ("", None, "ab", "abc_", "%", "a\\b", "no such", "ΣΑΣ", "😀😀a")


def test_index_equals_the_scan(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "i")
    rows = made(rng, 400)
    columns = ("title", "qualification_summary")
    df = spark.createDataFrame(rows, ROWS)
    textindex.add(df.filter("id < 200 OR id IS NULL"), path, "id", *columns)
    textindex.add(df.filter("id >= 200"), path, "id", *columns)
    textindex.add(df.filter("id < 20"), path, "id", *columns)  # again
    show = lambda d: sorted(map(repr, d.collect()))
    hits = 0
    for k in keywords(rng, rows, 14):
        want = show(predicates.keyword_search(df, k, *columns))
        assert show(textindex.keyword_search(df, path, "id", k, *columns)) == want, k
        assert show(textindex.keyword_search(df, path, "id", k, "title")) == show(predicates.keyword_search(df, k, "title")), k
        hits += 0 < len(want) < 400
    assert hits > 5


def test_changed_rows_are_found_by_their_new_text(spark, tmp_path):
    path = str(tmp_path / "i")
    old = spark.createDataFrame([(1, "welder", None), (2, "painter", None)], ROWS)
    textindex.add(old, path, "id", "title")
    new = spark.createDataFrame([(1, "plumber", None), (2, "painter", None)], ROWS)
    textindex.add(new.filter("id = 1"), path, "id", "title")
    assert [r.id for r in textindex.keyword_search(new, path, "id", "PLUMB", "title").collect()] == [1]
    assert not textindex.keyword_search(new, path, "id", "weld", "title").collect()


def test_few_rows_are_compared(spark, tmp_path):
    """On the texts of the driver's tables, and the scan of the lists is by gram."""
    path = str(tmp_path / "i")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    textindex.add(docs, path, "doc_id", "text")
    found = predicates.keyword_search(docs, "oire%viré", "text").count()
    met = textindex.candidates(spark, path, "oire%viré")
    assert found and found <= met.count() < docs.count() / 2
    plan = met._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), In(gram" in plan
    lists = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("gram").alias("low"), F.max("gram").alias("high")).orderBy("low", "high").collect()
    assert all(x.high <= y.low for x, y in zip(lists, lists[1:], strict=False))


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "i")
    none = spark.createDataFrame([], ROWS)
    textindex.add(none, path, "id", "title")
    assert not textindex.keyword_search(none, path, "id", "word", "title").collect()


def test_lists_are_those_of_the_texts(spark, tmp_path, monkeypatch):
    """Pieces of a few characters and alphabets too large for one number give the same grams; a gram's texts share rows."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab çİ😀") for _ in range(rng.randrange(60))) for _ in range(150)] + [None, "", "ab", "abc", "".join(map(chr, range(0x4E00, 0x9E00)))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    low = {r.id: r.t or "" for r in df.select("id", F.lower("text").alias("t")).collect()}
    want = sorted({(t[k : k + 3], i) for i, t in low.items() for k in range(len(t) - 2)})
    for most in (7, 4_000_000):
        path = str(tmp_path / str(most))
        monkeypatch.setattr(textindex, "CHARACTERS", most)
        textindex.add(df, path, "id", "text")
        listed = spark.read.parquet(path)
        assert sorted(set(map(tuple, listed.select("gram", F.explode("keys")).collect()))) == want
    rows = np.repeat(np.arange(9), 3000)
    codes = np.arange(27000, dtype="<u4") % 2900 * 300 + 300  # 2900 letters in 9 texts
    codes[(codes >= 0xD800) & (codes < 0xE000)] = 32
    many = np.concatenate([codes, np.arange(0x10000, 0x110000, dtype="<u4")])  # a million more in the tenth: a number for each gram and text would be too large
    met = textindex._lists(many, np.concatenate([rows, np.full(0x100000, 9)]), pa.array(range(10)))
    got = {(g, k) for b in met for g, ks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in ks}
    whole = many.tobytes().decode("utf-32-le")
    assert got == {(whole[k : k + 3], i) for i, (a, z) in enumerate([(3000 * i, 3000 * i + 3000) for i in range(9)] + [(27000, len(whole))]) for k in range(a, z - 2)}


def test_a_row_lists_many_texts(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    textindex.add(docs, path, "doc_id", "text")
    listed = spark.read.parquet(path)
    assert listed.count() < listed.select(F.explode("keys")).count() / 10
