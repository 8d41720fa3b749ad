"""Vectors as whole numbers, and the rounds of a clustering over them.

Float vectors become 32-bit whole numbers once, as packed bytes; a round reads them, sends each
task the centroids (a few rows) and gets back exact sums, a bounded number of rows a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labourmill.llm.shared import materialize

#: Rows that a task works on at once.
ROWS = 2048


def most_component(terms: int) -> int:
    """Components up to this size keep a sum of ``terms`` squared differences below 2 ** 60; they fit 32 bits."""
    return min(isqrt(2**60 // (4 * terms)), 2**31 - 1)


def packed(rows: DataFrame, column: str, scale: int, size: int, most: int, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and ``__v``: floor(scale * x) of ``size`` components as little-endian 32-bit numbers.

    Rows go whose vector is null, has another number of components, or has one that is null, not
    finite, or becomes larger than ``most``. The result is written once, for the rounds that read it.
    """
    vector = F.col(f"`{column}`")
    wide = rows.select(*[v.alias(k) for k, v in keep.items()], F.when(F.size(vector) == size, vector).cast("array<double>").alias("__v")).filter("__v is not null")
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            x = np.asarray(lists.flatten().fill_null(np.nan)).reshape(len(lists), size)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * x)
                good = np.flatnonzero((np.abs(scaled) <= most).all(1))
            whole = scaled[good].astype("<i4")
            bytes_ = pa.array([r.tobytes() for r in whole], pa.binary())
            some = pa.array(good)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(some) for i in range(len(names))), bytes_], names=[*names, "__v"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[:-1]]
    return materialize(wide.mapInArrow(run, ", ".join([*fields, "__v binary"])))


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch, in parts of ROWS, with its vectors as 64-bit whole numbers."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            data = b"".join(batch.column("__v").to_pylist())
            yield batch, np.frombuffer(data, "<i4").reshape(-1, size).astype(np.int64)


def first_vectors(rows: DataFrame, k: int, *order: Column) -> np.ndarray:
    """The first k vectors of ``packed`` rows in that order, equal places by their bytes; fewer if there are fewer."""
    got = [np.frombuffer(bytes(r[0]), "<i4").astype(np.int64) for r in rows.orderBy(*order, "__v").limit(k).select("__v").collect()]
    return np.stack(got) if got else np.zeros((0, 0), np.int64)


def sums(rows: DataFrame, size: int, cells: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and totals of ``cells`` cells over all vectors: ``add`` puts a matrix's share into both arrays.

    A task sends a row for each cell that it met, so at most ``cells`` rows; these are added by
    Spark, and ``cells`` sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for _, x in matrices(batches, size):
            add(x, count, total)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(total[met])], names=["cell", "n", "total"])

    found = rows.select("__v").mapInArrow(run, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    count, total = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in found.collect():
        count[r["cell"]], total[r["cell"]] = r["n"], r["total"]
    return count, total
