"""Vectors as short codes: each part of a vector by the nearest entry of that part's codebook.

Parts and entries, padded with zeros to a power of two, go through the integer Walsh-Hadamard
transform, rows in order of their sign changes (sequency). It keeps squared distances up to the
factor of the padded width, and most of a difference lies in its first rows. So squared
differences are added up row by row, and an entry whose sum is beyond the exact distance of a
good one is left out of the rows that follow. All in whole numbers: no rounding, and ties are real.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import join_hot, key_text, materialize
from labourmill.llm.vectors import first_vectors, matrices, most_component, packed, sums

SIZE, SCALE = 64, 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, padded with zeros, in order of sequency."""
    wide = 1 << (x.shape[-1] - 1).bit_length()
    y = np.concatenate([x, np.zeros((*x.shape[:-1], wide - x.shape[-1]), np.int64)], -1)
    half = 1
    while half < wide:
        pair = y.reshape(*x.shape[:-1], wide // (2 * half), 2, half)
        y = np.stack([pair[..., 0, :] + pair[..., 1, :], pair[..., 0, :] - pair[..., 1, :]], -2).reshape(*x.shape[:-1], wide)
        half *= 2
    return y[..., sequency(wide)]


def sequency(wide: int) -> np.ndarray:
    """The rows of the Hadamard matrix, from none to most changes of sign."""
    signs = np.ones((1, 1), np.int64)
    while len(signs) < wide:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((np.diff(signs, axis=1) != 0).sum(1), kind="stable")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and scaled squared distance of the entry nearest to each row of ``x``, both transformed; ties: the lower index."""
    wide, lead = x.shape[1], min(2, x.shape[1])
    begun = ((x[:, None, :lead] - entries[None, :, :lead]) ** 2).sum(2)
    guess = begun.argmin(1)
    bound = ((x - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(begun <= bound[:, None])
    so_far = begun[row, entry]
    for k in range(lead, wide):
        so_far += (x[row, k] - entries[entry, k]) ** 2
        stay = so_far <= bound[row]
        row, entry, so_far = row[stay], entry[stay], so_far[stay]
    # Rows stand in order, and a row's entries in order of their index.
    least = np.minimum.reduceat(so_far, np.searchsorted(row, np.arange(len(x)))) if len(x) else so_far
    hit = np.flatnonzero(so_far == least[row])
    return entry[hit[np.unique(row[hit], return_index=True)[1]]], least


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a row for each vector, a column for each part) and squared distances, by part."""
    parts, _, width = books.shape
    cut = x.reshape(len(x), parts, width)
    codes, errors = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
    turned, entries = transform(cut), transform(books)
    for p in range(parts):
        codes[:, p], errors[:, p] = nearest(turned[:, p], entries[p])
    return codes, errors // turned.shape[-1]


def compress(rows: DataFrame, column: str, key: str, keep: list[str], parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """key, the columns ``keep``, code and error of every kept vector, and the codebooks (part, entry, component).

    A vector is kept if it has ``size`` components (a multiple of ``parts``), none null or not
    finite; a component x counts as floor(scale * x), and vectors with one beyond 2 ** 26 (for 8
    components a part) go too, since distances would need more than 64 bits. The codebooks begin
    with the vectors of the least keys; of repeated keys the one whose vector has the least bytes
    is first, null keys come last. Repeated rows count each. With fewer vectors than ``entries``
    (at most 256) the codebooks have as many; an empty table has none. ``code`` has two hexadecimal digits a part.
    A round reads the vectors and brings back ``entries`` * ``size`` sums.
    """
    if size % parts or entries > 256:
        raise ValueError("parts have equal sizes, and codebooks at most 256 entries")
    width = size // parts
    terms = max(parts * width, (1 << (width - 1).bit_length()) ** 2)
    kept = packed(rows, column, scale, size, most_component(terms), {c: F.col(f"`{c}`") for c in (key, *keep)})
    start = first_vectors(kept, entries, F.col(f"`{key}`").asc_nulls_last()).reshape(-1, parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))

    for _ in range(rounds):

        def add(x: np.ndarray, count: np.ndarray, total: np.ndarray, books: np.ndarray = books) -> None:
            codes, _ = encode(x, books)
            cut = x.reshape(len(x), parts, width)
            counts, totals = count.reshape(books.shape), total.reshape(books.shape)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=books.shape[1])[:, None]
                np.add.at(totals[p], codes[:, p], cut[:, p])

        count, total = sums(kept, size, books.size, add)
        books = np.where(count > 0, total // np.maximum(count, 1), books.ravel()).reshape(books.shape)

    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, size):
            codes, errors = encode(x, books)
            text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text, pa.array(errors.sum(1))], names=[*names, "code", "error"])

    fields = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names]
    return kept.mapInArrow(run, ", ".join([*fields, "code string", "error long"])), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), "embedding", "vec_id", ["label"])
    coded = materialize(found.select("vec_id", "code", "error", key_text(F.col("label")).alias("label_key")))
    labels = materialize(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return join_hot(coded, labels, ["label_key"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after the other, over a row for each component."""
    width = SIZE // PARTS
    floored = "((sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*))::BIGINT"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT r, p, e, sum((x - y) * (x - y))::BIGINT AS d FROM xs JOIN b{i} USING (p, i) GROUP BY r, p, e), "
            f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{i} GROUP BY r, p)"
        )
        if i < ROUNDS:
            steps.append(
                f"b{i + 1} AS MATERIALIZED (SELECT p, e, i, {floored} AS y FROM a{i} JOIN xs USING (r, p) GROUP BY p, e, i "
                f"UNION ALL SELECT p, e, i, y FROM b{i} WHERE (p, e) NOT IN (SELECT (p, e) FROM a{i}))"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x))) = {SIZE}
),
xs AS MATERIALIZED (SELECT r, j // {width} AS p, j % {width} AS i, floor({SCALE} * v[j + 1]::DOUBLE)::BIGINT AS x FROM (SELECT r, v, unnest(range({SIZE})) AS j FROM kept)),
b0 AS (SELECT p, (r - 1)::INTEGER AS e, i, x AS y FROM xs WHERE r <= {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""


ORACLE = _oracle()
