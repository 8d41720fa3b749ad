"""Keyword search by lists of three-character pieces (grams), kept as a table beside the texts.

A keyword's own grams name the rows that can have it; only these are compared with it, so the
result is that of ``predicates.keyword_search`` over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labourmill.operators import predicates
from labourmill.sources import scratch

#: Of a keyword's grams the rarest so many are asked for; the rest would save little.
ASKED = 4
#: Characters of texts whose grams are listed together.
CHARACTERS = 4_000_000


def _lists(codes: np.ndarray, rows: np.ndarray, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """gram, keys: the texts that have it, by characters in a row and the number of each one's text."""
    if len(codes) < 3:
        return
    letters = np.flatnonzero(np.bincount(codes))
    rank = np.zeros(letters[-1] + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    a, low, n = len(letters), int(rows[0]), int(rows[-1] - rows[0]) + 1
    if a**3 * n >= 1 << 63:
        half = len(codes) // 2
        yield from _lists(codes[: half + 2], rows[: half + 2], keys)
        yield from _lists(codes[half:], rows[half:], keys)
        return
    x = rank[codes]
    x = (((x[:-2] * a + x[1:-1]) * a + x[2:]) * n + (rows[:-2] - low))[rows[:-2] == rows[2:]]
    if not len(x):
        return
    x.sort()
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    gram = x // n
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    g = gram[starts]
    text = letters[np.stack([g // (a * a), g // a % a, g % a], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), keys.take(pa.array(x - gram * n + low)))
    yield pa.RecordBatch.from_arrays([pa.array([text[k : k + 3] for k in range(0, len(text), 3)]), listed], ["gram", "keys"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the texts of all columns but the first, which has the keys; a long text's come in pieces."""
    for batch in batches:
        for texts in batch.columns[1:]:
            part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // CHARACTERS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                some = texts.slice(low, high - low)
                codes = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), "<u4")
                rows = np.repeat(np.arange(low, high), pc.utf8_length(some).to_numpy(zero_copy_only=False))
                for k in range(0, len(codes), CHARACTERS):
                    yield from _lists(codes[k : k + CHARACTERS + 2], rows[k : k + CHARACTERS + 2], batch.column(0))


def add(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """Add the grams of the columns of ``rows`` to the table at ``path``: gram, keys, one row for a gram and some of its texts.

    Grams are the runs of three characters of a text in lower case; shorter and null texts have none.
    Lists are made once, then dealt in ranges of gram and first key, so a gram that most texts have
    is split, and a file holds few grams, which its statistics name. New and changed rows are added
    in the same way. What a changed row had before stays listed, which costs a comparison and
    changes no result.
    """
    texts = [F.make_valid_utf8(F.lower(F.coalesce(F.col(f"`{c}`"), F.lit("")))).alias(f"__{i}") for i, c in enumerate(columns)]
    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(rows.schema[key].dataType))])
    listed = scratch.kept(rows.select(F.col(f"`{key}`"), *texts).mapInArrow(_listed, kind))
    listed.repartitionByRange("gram", F.col("keys")[0]).sortWithinPartitions("gram").write.mode("append").parquet(path)


def keyword_grams(spark: SparkSession, keyword: str) -> list[str]:
    """Grams that every text with the keyword has; % and _ stand for unknown characters."""
    # Lower case is Spark's, as in the texts.
    low = spark.range(1).select(F.lower(F.lit(keyword))).first()[0]
    return sorted({part[i : i + 3] for part in re.split("[%_]", low) for i in range(len(part) - 2)})


def candidates(spark: SparkSession, path: str, keyword: str) -> DataFrame | None:
    """key: rows that have the keyword's rarest grams; None where it has no gram.

    The numbers of rows of its grams (as many as the keyword is long, at most) come to the driver.
    """
    asked = keyword_grams(spark, keyword)
    if not asked:
        return None
    listed = spark.read.parquet(path).filter(F.col("gram").isin(asked))
    counts = {r.gram: r["count"] for r in listed.groupBy("gram").agg(F.sum(F.size("keys")).alias("count")).collect()}
    rare = sorted(asked, key=lambda g: (counts.get(g, 0), g))[:ASKED]
    # A row that was added again is listed again, so grams are counted apart.
    met = listed.filter(F.col("gram").isin(rare)).select("gram", F.explode("keys").alias("key")).groupBy("key").agg(*[F.max(F.col("gram") == g).alias(f"g{i}") for i, g in enumerate(rare)])
    return met.filter(" AND ".join(f"g{i}" for i in range(len(rare)))).select("key")


def keyword_search(rows: DataFrame, path: str, key: str, keyword: str | None, *columns: str) -> DataFrame:
    """``predicates.keyword_search`` over rows whose texts are listed at ``path`` by ``key``.

    A keyword without three characters in a row between its wildcards is looked for in all rows,
    and an empty one keeps all. A null key is a key; rows with one key are all compared. The
    columns must be among those that were added.
    """
    met = candidates(rows.sparkSession, path, keyword) if keyword else None
    if met is not None:
        met = met.withColumnRenamed("key", "__met")
        rows = rows.join(met, F.col(f"`{key}`").eqNullSafe(F.col("__met")), "left_semi")
    return predicates.keyword_search(rows, keyword, *columns)
