"""Exact nearest concepts by weighted cosine, over cells of vectors that share their nearest pivot.

The weighted cosine of a query with a concept's two vectors is its product with one vector, the
weighted sum of both. That sum is at most as long as the weights; with one more component it has
exactly that length, and then the concepts with the largest products are the nearest ones. For
distances the triangle inequality holds: a cell none of whose vectors can be as near as the k-th
best known one is left out.

Pivots are a bounded number of concepts; they, and a row for each of their cells, go to every task.
A query first meets the cell of its nearest pivot, then the cells that its k-th distance doesn't
rule out. Small cells share a tile and large ones are cut into several; a tile meets its queries in
shares. So a group in a task is bounded however many vectors are alike, a query travels once to each
tile that it asks, and no row is made for a query and a cell: where nothing can be ruled out this is
a search of all pairs whose tables grow with the input and the number of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labourmill.sources import scratch

#: Most pivots; there are about as many as the square root of the concepts.
PIVOTS = 1024
#: Vectors of a tile, and queries, that meet in a task.
BLOCK = 16_384
#: Most tasks of one meeting.
MOST_TASKS = 10_000
#: Rows whose distances are worked out at once.
STRIPE = 256
#: Distances are known to about 5e-8 where they are near 0.
SLACK = 1e-6

_FOUND = "text string, uri string, score double"


class Cells(NamedTuple):
    """Concepts (uri, vec, cell, far), the pivots' vectors, and of each cell its number of vectors,
    the largest ``far``, its first tile and the number of its tiles."""

    members: DataFrame
    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def _tiles(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell its first tile and the number of its tiles: small cells share one, large ones are cut."""
    first, parts = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    free, room = 0, 0
    for cell, n in enumerate(counts):
        if n > room:
            first[cell], parts[cell] = free, -(-n // BLOCK)
            free, room = free + parts[cell], (BLOCK - n if n <= BLOCK else 0)
        elif n:
            first[cell], parts[cell] = free - 1, 1
            room -= n
    return first, parts


def _striped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of STRIPE at most, none of them empty."""
    for batch in batches:
        for at in range(0, len(batch), STRIPE):
            yield batch.iloc[at : at + STRIPE]


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _lifted(labels: pd.Series, descriptions: pd.Series, weight: float) -> np.ndarray:
    """The weighted sums of unit vectors, with the component that makes all of them equally long."""
    both = weight * _unit(labels) + (1 - weight) * _unit(descriptions)
    longest = abs(weight) + abs(1 - weight)
    return np.column_stack([both, np.sqrt(np.maximum(longest**2 - (both * both).sum(axis=1), 0.0))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(squares, 0.0))


def cells(concepts: DataFrame, weight: float) -> Cells | None:
    """``concepts`` (uri, label_vec, desc_vec) by nearest pivot; None where no concept has both vectors."""
    spark = concepts.sparkSession
    whole = concepts.filter("label_vec is not null and desc_vec is not null")
    wanted = min(PIVOTS, int(np.sqrt(whole.count())) + 1)
    drawn = whole.orderBy(F.xxhash64("uri"), "uri").limit(wanted).toPandas()
    if not len(drawn):
        return None
    pivots = np.unique(_lifted(drawn["label_vec"], drawn["desc_vec"], weight), axis=0)
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _striped(batches):
            x = _lifted(batch["label_vec"], batch["desc_vec"], weight)
            far = _distances(x, sent.value)
            cell = far.argmin(axis=1)
            yield pd.DataFrame({"uri": batch["uri"].to_numpy(), "vec": list(x), "cell": cell.astype(np.int32), "far": far[np.arange(len(x)), cell]})

    members = scratch.kept(whole.select("uri", "label_vec", "desc_vec").mapInPandas(place, "uri string, vec array<double>, cell int, far double"))
    counts, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for row in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
        counts[row.cell], radius[row.cell] = row.n, row.far
    return Cells(members, pivots, counts, radius, *_tiles(counts))


def _asked(queries: DataFrame, to: Cells, k: int) -> DataFrame:
    """text, vec, home (its nearest cell that isn't empty), norm, reach (a distance within which k concepts are for certain)."""
    sent = queries.sparkSession.sparkContext.broadcast((to.pivots, to.counts, to.radius))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, counts, radius = sent.value
        for batch in _striped(batches):
            x = np.column_stack([_unit(batch["vec"]), np.zeros(len(batch))])
            far = np.where(counts > 0, _distances(x, pivots), np.inf)
            latest = far + radius
            order = np.argsort(latest, axis=1)
            within = np.cumsum(counts[order], axis=1) >= k
            reach = np.where(within.any(axis=1), np.take_along_axis(latest, order, 1)[np.arange(len(x)), within.argmax(axis=1)], np.inf)
            yield pd.DataFrame({"text": batch["text"].to_numpy(), "vec": list(x), "home": far.argmin(axis=1).astype(np.int32), "norm": (x * x).sum(axis=1), "reach": reach})

    return queries.mapInPandas(run, "text string, vec array<double>, home int, norm double, reach double")


class _Map(NamedTuple):
    """What tasks know of the cells: their pivots, how far these are apart, and their numbers."""

    pivots: np.ndarray
    apart: np.ndarray
    counts: np.ndarray
    radius: np.ndarray

    def others(self, x: np.ndarray, home: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query which cells, but for home, may hold a concept within ``reach``; and its distances from the pivots.

        A cell is left out if it lies farther than its radius and ``reach`` together, or if the border
        between its pivot and the nearest one does: its members are on their own pivot's side.
        """
        far, own = _distances(x, self.pivots), np.arange(len(x))
        apart = self.apart[home]
        border = np.where(apart > SLACK, (far**2 - far[own, home][:, None] ** 2) / (2 * np.maximum(apart, 1e-12)), -np.inf)
        met = np.maximum(far - self.radius, border) <= reach[:, None] + SLACK
        met[:, self.counts == 0] = False
        met[own, home] = False
        return met, far


def _map(to: Cells) -> _Map:
    return _Map(to.pivots, _distances(to.pivots, to.pivots), to.counts, to.radius)


def other_tiles(asked: DataFrame, to: Cells) -> DataFrame:
    """``asked`` (text, vec, home, reach, worst) with the number of other cells that it must meet, ``met``, and their ``tiles``."""
    holds = np.zeros((len(to.counts), int((to.first + to.parts).max())), np.float32)
    for cell, (at, n) in enumerate(zip(to.first, to.parts, strict=True)):
        holds[cell, at : at + n] = 1
    sent = asked.sparkSession.sparkContext.broadcast((_map(to), holds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, has = sent.value
        for batch in _striped(batches):
            met, _ = known.others(np.stack(batch["vec"].to_numpy()), batch["home"].to_numpy(), batch["reach"].to_numpy())
            asks = met.astype(np.float32) @ has > 0
            yield batch.assign(met=met.sum(axis=1), tiles=[np.nonzero(line)[0].astype(np.int32) for line in asks])

    columns = ["text", "vec", "home", "reach", "worst"]
    return asked.select(*columns).mapInPandas(run, "text string, vec array<double>, home int, reach double, worst double, met long, tiles array<int>")


def _hits(scores: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, columns and scores of each row's k best (the earlier of equal ones) that reach its ``least``."""
    n = min(k, scores.shape[1])
    least = least.copy()
    blank = np.isneginf(least)
    if blank.any():
        least[blank] = np.partition(scores[blank], -n, axis=1)[:, -n]
    row, column = np.nonzero(scores >= least[:, None] - 1e-9)
    ends = np.searchsorted(row, np.arange(len(scores) + 1))
    for i in np.unique(row):
        some = column[ends[i] : ends[i + 1]]
        # So equal vectors have equal scores wherever they stand in a tile.
        exact = np.round(scores[i, some], 12)
        best = np.argsort(-exact, kind="stable")[:n]
        yield i, some[best], exact[best]


def _meet(asks: DataFrame, to: Cells, k: int, home: bool) -> DataFrame:
    """text, uri, score: of each ask (text, vec, home, reach, worst, tiles) the k best of a tile's
    members in its first cell (``home``) or in the others, if they reach ``worst``."""
    spark = asks.sparkSession
    numbers = asks.select(F.explode("tiles").alias("tile")).groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a tile
    shares = F.broadcast(spark.createDataFrame([(r.tile, -(-r.n // BLOCK)) for r in numbers], "tile int, shares int"))
    placed = [(c, int(to.first[c]), int(to.parts[c])) for c in np.nonzero(to.counts)[0].tolist()]
    tiles = F.broadcast(spark.createDataFrame(placed, "cell int, first int, parts int"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    mine = asks.select("text", "vec", "home", "reach", "worst", F.explode("tiles").alias("tile")).join(shares, "tile").withColumn("share", dealt("text", "shares")).drop("shares")
    its = to.members.join(tiles, "cell").select("uri", "vec", "cell", "far", (F.col("first") + dealt("uri", "parts")).alias("tile")).join(shares, "tile")
    its = its.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    sent = spark.sparkContext.broadcast(_map(to))

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        known, parts = sent.value, [pd.DataFrame({"text": pd.Series(dtype=object), "uri": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})]
        if not len(q) or not len(t):
            return parts[0]
        t = t.sort_values("uri")
        y, uri, far = np.stack(t["vec"].to_numpy()), t["uri"].to_numpy(), t["far"].to_numpy()
        cells_, of = np.unique(t["cell"].to_numpy(), return_inverse=True)
        for some in _striped([q.sort_values("home")]):  # so the queries of a stripe ask for much the same
            x, own, reach = np.stack(some["vec"].to_numpy()), some["home"].to_numpy(), some["reach"].to_numpy()
            if home:
                at = np.nonzero(np.isin(cells_, own)[of])[0]
            else:
                met, away = known.others(x, own, reach)
                met, away = met[:, cells_], away[:, cells_]
                near = np.where(met, away - reach[:, None], np.inf).min(axis=0) - SLACK
                beyond = np.where(met, away + reach[:, None], -np.inf).max(axis=0) + SLACK
                at = np.nonzero((far >= near[of]) & (far <= beyond[of]))[0]
            if not len(at):
                continue
            scores = x @ (y if len(at) == len(y) else y[at]).T
            mine_only = own[:, None] == t["cell"].to_numpy()[at][None]
            # What the other pass compares is left to it, so that nothing is found twice.
            scores[~mine_only if home else mine_only] = -np.inf
            text = some["text"].to_numpy()
            for i, columns, exact in _hits(scores, some["worst"].to_numpy(), k):
                real = exact > -np.inf
                parts.append(pd.DataFrame({"text": text[i], "uri": uri[at[columns[real]]], "score": exact[real]}))
        return pd.concat(parts)

    # As many tasks as there are meetings: rows are few for the work they make.
    tasks = min(MOST_TASKS, max(sum(-(-r.n // BLOCK) for r in numbers), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    mine, its = (x.repartition(tasks, "tile", "share").groupBy("tile", "share") for x in (mine, its))
    return mine.cogroup(its).applyInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("text").orderBy(F.desc("score"), "uri"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("text", "rank", "uri", "score")


def reached(queries: DataFrame, to: Cells, k: int, weight: float) -> tuple[DataFrame, DataFrame]:
    """The k best of each query's first cell, and the queries with ``reach`` narrowed by them and the k-th best score, ``worst``."""
    spark = queries.sparkSession
    asked = scratch.kept(_asked(queries, to, k))
    placed = [(c, list(range(to.first[c], to.first[c] + to.parts[c]))) for c in np.nonzero(to.counts)[0].tolist()]
    tiles = F.broadcast(spark.createDataFrame(placed, "home int, tiles array<int>"))
    first = scratch.kept(_best(_meet(asked.withColumn("worst", F.lit(float("-inf"))).join(tiles, "home"), to, k, home=True), k))
    worst = first.filter(F.col("rank") == k).select("text", F.col("score").alias("worst"))
    longest = (abs(weight) + abs(1 - weight)) ** 2
    # Null where the first cell has fewer than k, so that the reach stays.
    found = F.when(F.col("worst").isNotNull(), F.sqrt(F.greatest(F.col("norm") + longest - 2 * F.col("worst"), F.lit(0.0))))
    narrowed = asked.join(worst, "text", "left").withColumn("reach", F.least("reach", found)).withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    return first, narrowed.drop("norm")


def nearest(queries: DataFrame, concepts: DataFrame, k: int, weight: float) -> DataFrame:
    """text, rank, uri, score of the k concepts with the largest weighted cosine; equal scores (to 12 decimals) go by uri.

    ``queries`` (text, vec), distinct texts; a query without a vector has no row, a concept
    without either vector is never found.
    """
    asked = queries.filter("vec is not null").select("text", "vec")
    to = cells(concepts, weight)
    if to is None:
        return queries.sparkSession.createDataFrame([], "text string, rank int, uri string, score double")
    first, narrowed = reached(asked, to, k, weight)
    others = scratch.kept(other_tiles(narrowed, to))
    return _best(first.select("text", "uri", "score").unionByName(_meet(others, to, k, home=False)), k)


def cells_met(queries: DataFrame, concepts: DataFrame, k: int, weight: float) -> DataFrame:
    """text, cells, met (its first cell included): how many cells a query is compared with."""
    to = cells(concepts, weight)
    if to is None:
        return queries.sparkSession.createDataFrame([], "text string, cells long, met long")
    _, narrowed = reached(queries.filter("vec is not null").select("text", "vec"), to, k, weight)
    return other_tiles(narrowed, to).select("text", F.lit(int((to.counts > 0).sum())).cast("long").alias("cells"), (F.col("met") + 1).alias("met"))
