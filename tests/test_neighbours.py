"""Vector search by pivots against all pairs."""

import numpy as np
import pandas as pd
import pytest

from labourmill.operators import matching, neighbours

CONCEPTS, QUERIES = "uri string, label_vec array<double>, desc_vec array<double>", "text string, vec array<double>"


def brute(queries, concepts, k, weight):
    unit = lambda v: np.asarray(v) / max(np.linalg.norm(v), 1e-12)
    whole = [(u, weight * unit(a) + (1 - weight) * unit(b)) for u, a, b in concepts if a is not None and b is not None]
    out = {}
    for text, v in queries:
        if v is not None:
            best = sorted((-round(float(unit(v) @ c), 12), u) for u, c in whole)[:k]
            out[text] = [(u, pytest.approx(-s, abs=1e-9)) for s, u in best]
    return out


def rows(found):
    out = {}
    for r in found.orderBy("text", "rank").collect():
        out.setdefault(r.text, []).append((r.uri, r.score))
    return out


def clusters(rng, n, d=16, groups=12):
    centres = 4 * rng.normal(size=(groups, d))
    return [centres[i % groups] + 0.2 * rng.normal(size=d) for i in range(n)]


@pytest.mark.parametrize("weight", [0.6, 1.0, 0.0])
@pytest.mark.parametrize("block", [20, 4096])
def test_pivots_are_brute_force(spark, monkeypatch, weight, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(block)
    vectors = clusters(rng, 400)
    same = vectors[7].tolist()
    concepts = [(f"u{i:04}", v.tolist(), (v + 0.1 * rng.normal(size=16)).tolist()) for i, v in enumerate(vectors)]
    # A third of all concepts have one vector; ties go by uri.
    concepts += [(f"same{i:03}", same, same) for i in range(200)]
    concepts += [("none", None, same), ("zero", [0.0] * 16, [0.0] * 16)]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(clusters(rng, 60) + list(rng.normal(size=(20, 16))))]
    queries += [("same", same), ("no vector", None), ("zero", [0.0] * 16)]
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(concepts, CONCEPTS)
    assert rows(neighbours.nearest(q, c, 5, weight)) == brute(queries, concepts, 5, weight)


def test_more_asked_than_there_are(spark):
    concepts = [("a", [1.0, 0.0], [1.0, 0.0]), ("b", [0.0, 1.0], [0.0, 1.0])]
    queries = [("x", [1.0, 0.1]), ("y", [-1.0, -1.0])]
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(concepts, CONCEPTS)
    assert rows(neighbours.nearest(q, c, 3, 0.6)) == brute(queries, concepts, 3, 0.6)
    assert neighbours.nearest(q, c.limit(0), 3, 0.6).count() == 0
    assert neighbours.nearest(q.limit(0), c, 3, 0.6).count() == 0


def test_cells_are_left_out(spark):
    rng = np.random.default_rng(5)
    both = clusters(rng, 2200, groups=40)
    rng.shuffle(both)
    c = spark.createDataFrame([(f"u{i}", v.tolist(), v.tolist()) for i, v in enumerate(both[:2000])], CONCEPTS)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(both[2000:])], QUERIES)
    met = neighbours.cells_met(q, c, 3, 0.6).toPandas()
    print("share of cells met", met["met"].sum() / met["cells"].sum())
    assert len(met) == 200 and met["met"].sum() <= 0.1 * met["cells"].sum()


def test_many_concepts_go_by_pivots(spark, monkeypatch):
    rng = np.random.default_rng(6)
    concepts = [(f"u{i}", v.tolist(), v.tolist()) for i, v in enumerate(clusters(rng, 300))]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(clusters(rng, 30))]
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(concepts, CONCEPTS)
    small = rows(matching.knn_top_k(q, c))
    monkeypatch.setattr(matching, "BLOCK", 100)
    want = brute(queries, concepts, 3, matching.LABEL_WEIGHT)
    assert small == want and rows(matching.knn_top_k(q, c)) == want


def test_a_tasks_rows_are_bounded(spark, monkeypatch):
    """No row for a query and a cell, and no frame that holds many queries times all cells or concepts."""
    rng = np.random.default_rng(8)
    both = rng.normal(size=(2100, 8))  # nothing is near enough to be left out
    c = spark.createDataFrame([(f"u{i}", v.tolist(), v.tolist()) for i, v in enumerate(both[:2000])], CONCEPTS)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(both[2000:])], QUERIES)
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    to = neighbours.cells(c, 0.6)
    tiles = int((to.first + to.parts).max())
    sizes = {t: 0 for t in range(tiles)}
    for cell, n in enumerate(to.counts):
        sizes[int(to.first[cell])] += int(n) if to.parts[cell] == 1 else 0
    assert tiles < 10 < len(to.counts) and max(sizes.values()) <= 500 and (to.parts[to.counts > 0] >= 1).all()
    _, narrowed = neighbours.reached(q, to, 3, 0.6)
    asks = neighbours.other_tiles(narrowed, to).toPandas()
    assert len(asks) == 100 and asks["met"].sum() > 500 and asks["tiles"].map(len).max() <= tiles
    assert max(len(f) for f in neighbours._striped([pd.DataFrame({"a": range(10_000)})])) == neighbours.STRIPE


def test_large_cells_are_cut_into_tiles(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    first, parts = neighbours._tiles(np.array([3, 0, 7, 1, 25, 4, 10, 0, 2]))
    assert parts.tolist() == [1, 0, 1, 1, 3, 1, 1, 0, 1]
    assert first[parts > 0].tolist() == [0, 0, 1, 2, 5, 6, 7]
