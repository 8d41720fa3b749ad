"""Clustering of vectors around centroids, each vector's centroid found by the threshold algorithm.

The centroids stand in one sorted list for each dimension. From a vector's value every list is
walked outward, the nearer side first, and each centroid that is met for the first time has its
exact distance worked out. The next, unmet values of all lists (the frontier) bound the distance
of what no list has met from below; when their squared distances add up to strictly more than the
best exact distance, no other centroid can be as near, not even at a tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import materialize
from labourmill.llm.vectors import first_vectors, matrices, most_component, packed, sums

SIZE, SCALE = 64, 1024
CLUSTERS, ROUNDS = 8, 10
#: More than any distance between two components.
_FAR = 2**28


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the centroid nearest to each row of ``x``; ties: the smaller number."""
    k, size = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    # A value beyond either end of each list, at the places 0 and k + 1.
    lists = np.concatenate([np.zeros((1, size), np.int64), np.take_along_axis(centroids, order, 0), np.zeros((1, size), np.int64)])
    number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    at, dims = np.arange(len(x)), np.arange(size)
    exact = np.full((len(x), k), np.iinfo(np.int64).max)
    low = (lists[None, 1 : k + 1] < x[:, None]).sum(1)
    high = low + 1
    while len(at):
        below, above = np.where(low > 0, x - lists[low, dims], _FAR), np.where(high <= k, lists[high, dims] - x, _FAR)
        down = below <= above
        # Every list gives its nearest centroid that it hasn't given yet.
        given = order[np.where(down, low, high) - 1, dims]
        met = np.zeros(exact.shape, bool)
        met[np.arange(len(x))[:, None], given] = True
        row, centroid = np.nonzero(met & (exact == np.iinfo(np.int64).max))
        exact[row, centroid] = ((x[row] - centroids[centroid]) ** 2).sum(1)
        low, high = low - down, high + ~down
        frontier = np.minimum(np.where(low > 0, x - lists[low, dims], _FAR), np.where(high <= k, lists[np.minimum(high, k + 1), dims] - x, _FAR))
        best = exact.min(1)
        done = ((frontier**2).sum(1) > best) | (exact < np.iinfo(np.int64).max).all(1)
        number[at[done]], distance[at[done]] = exact[done].argmin(1), best[done]
        at, x, low, high, exact = at[~done], x[~done], low[~done], high[~done], exact[~done]
    return number, distance


def cluster(rows: DataFrame, column: str, key: str, seed: str = "3:", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """key, cluster, distance of every kept vector, and the final centroids.

    A vector is kept if it has ``size`` components, none null or not finite; a component x counts as
    floor(scale * x), and vectors with one beyond 2 ** 26 go too, since distances would need more
    than 64 bits. The first centroids are the vectors whose key, behind ``seed``, has the least
    sha256; of repeated keys the one whose vector has the least bytes is first, null keys come last.
    Repeated rows count each. With fewer vectors than ``clusters`` there are as many centroids; an
    empty table has none. A round reads the vectors and brings back ``clusters`` * ``size`` sums.
    """
    kept = packed(rows, column, scale, size, most_component(size), {key: F.col(f"`{key}`")})
    hashed = F.sha2(F.concat(F.lit(seed), F.col(f"`{key}`").cast("string")).cast("binary"), 256)
    centroids = first_vectors(kept, clusters, hashed.asc_nulls_last()).reshape(-1, size)

    for _ in range(rounds):

        def add(x: np.ndarray, count: np.ndarray, total: np.ndarray, centroids: np.ndarray = centroids) -> None:
            of = nearest(x, centroids)[0]
            n = np.bincount(of, minlength=len(centroids))
            count += np.repeat(n, size)
            for c in np.flatnonzero(n).tolist():
                total[c * size : (c + 1) * size] += x[of == c].sum(0)

        count, total = sums(kept, size, centroids.size, add)
        centroids = np.where(count > 0, total // np.maximum(count, 1), centroids.ravel()).reshape(-1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, size):
            of, far = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.astype(np.int32)), pa.array(far)], names=[key, "cluster", "distance"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[key].dataType.simpleString()}, cluster int, distance long"), centroids


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding", "vec_id")
    found = materialize(found)
    each = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    told = [(c, each.get(c, 0), sum(each.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    # A row for each of the centroids.
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, over a row for each component."""
    floored = "((sum(x) - ((sum(x) % count(*) + count(*)) % count(*))) // count(*))::BIGINT"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(
            f"d{i} AS MATERIALIZED (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM xs JOIN c{i} USING (i) GROUP BY r, c), "
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d FROM d{i} GROUP BY r)"
        )
        if i < ROUNDS:
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c, i, {floored} AS y FROM a{i} JOIN xs USING (r) GROUP BY c, i "
                f"UNION ALL SELECT c, i, y FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), embedding) AS r, vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x))) = {SIZE}
),
xs AS MATERIALIZED (SELECT r, i, floor({SCALE} * v[i]::DOUBLE)::BIGINT AS x FROM (SELECT r, v, unnest(range(1, {SIZE + 1})) AS i FROM kept)),
c0 AS (SELECT (r - 1)::INTEGER AS c, i, x AS y FROM xs WHERE r <= {CLUSTERS}),
{", ".join(steps)},
told AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS s FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN told USING (c)
"""


ORACLE = _oracle()
