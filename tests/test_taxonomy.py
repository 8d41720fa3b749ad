"""Chains, siblings and split joins: deep, wide and circular hierarchies."""

import random

import pytest

from labourmill.sources import skew, taxonomy

EDGE, CONCEPT = "child_uri string, parent_uri string, edge_ord long", "uri string, preferred_label string"


def brute_chains(edges, concepts):
    up = {}
    for child, parent, _ in sorted(edges, key=lambda e: e[2]):
        up[child] = parent
    out = {}
    for uri in concepts:
        seen, at = [uri], up.get(uri)
        while at in concepts and at not in seen:
            seen.append(at)
            at = up.get(at)
        out[uri] = [concepts[u] for u in reversed(seen[1:])]
    return out


def chains(spark, edges, concepts):
    e = spark.createDataFrame(edges, EDGE)
    return {r.uri: r.chain for r in taxonomy.taxonomy_chain(e, spark.createDataFrame(list(concepts.items()), CONCEPT)).collect()}


def test_deep_chain_is_whole(spark):
    concepts = {f"u{i}": f"L{i}" for i in range(1001)}
    edges = [(f"u{i}", f"u{i + 1}", i) for i in range(1000)]
    got = chains(spark, edges, concepts)
    assert got == brute_chains(edges, concepts) and len(got["u0"]) == 1000


@pytest.mark.parametrize("seed", range(3))
def test_random_hierarchies(spark, seed):
    rng = random.Random(seed)
    concepts = {f"u{i}": f"L{i % 7}" for i in range(120)}
    edges = [(f"u{rng.randrange(120)}", f"u{rng.randrange(125)}", i) for i in range(150)]  # cycles, several parents, unknown ones, loops
    edges += [(f"v{i}", f"v{(i + 1) % 40}", 1000 + i) for i in range(40)] + [("u5", "v3", 2000)]
    concepts |= {f"v{i}": f"V{i}" for i in range(40)}
    assert chains(spark, edges, concepts) == brute_chains(edges, concepts)


@pytest.mark.parametrize("seed", range(2))
def test_parents_are_done_first(spark, monkeypatch, seed):
    """Leaves never double: cycles, unknown parents, loops and concepts without labels above them."""
    rng = random.Random(seed)
    met, plain = [], taxonomy._doubled
    monkeypatch.setattr(taxonomy, "FEW", 10)
    monkeypatch.setattr(taxonomy, "_doubled", lambda rows: (met.append(rows.count()), plain(rows))[1])
    concepts = {f"u{i}": f"L{i % 7}" for i in range(400)} | {"u3": None}
    edges = [(f"u{i}", f"u{rng.randrange(max(1, i // 4))}" if rng.random() < 0.95 else "nowhere", i) for i in range(1, 400)]
    edges += [("u0", "u9", 1000), ("u11", "u11", 1001), (None, "u1", 1002), ("u12", None, 1003)]
    assert chains(spark, edges, concepts) == brute_chains(edges, concepts)
    assert len(met) == 1 and met[0] <= 30


def test_no_concepts(spark):
    assert chains(spark, [("a", "b", 1)], {"x": "X"}) == {"x": []}
    assert taxonomy.taxonomy_chain(spark.createDataFrame([], EDGE), spark.createDataFrame([], CONCEPT)).collect() == []


def test_parent_of_very_many(spark):
    n = 100_000
    e = spark.range(n).selectExpr("concat('c', id) AS child_uri", "'p' AS parent_uri", "id AS edge_ord")
    c = spark.range(n).selectExpr("concat('c', id) AS uri", "concat('C', id) AS preferred_label").union(spark.createDataFrame([("p", "P")], CONCEPT))
    groups = taxonomy.sibling_groups(e, c)
    assert groups.filter("n_siblings = 99999 AND parent_uri = 'p'").count() == n
    only = spark.createDataFrame([("c7",), ("c8",)], "uri string")
    pairs = taxonomy.taxonomy_siblings(e, c, only)
    assert pairs.count() == 2 * (n - 1) and pairs.filter("uri = sibling_uri").count() == 0
    assert taxonomy.taxonomy_chain(e, c).filter("chain = array('P')").count() == n


def test_groups_agree_with_pairs(spark):
    rng = random.Random(1)
    e = spark.createDataFrame([(f"u{rng.randrange(40)}", f"u{rng.randrange(8)}", i) for i in range(70)], EDGE)
    c = spark.createDataFrame([(f"u{i}", f"L{i}") for i in range(30)], CONCEPT)
    pairs = {}
    for r in taxonomy.taxonomy_siblings(e, c).collect():
        pairs.setdefault(r.uri, set()).add(r.sibling_uri)
    got = {r.uri: r.n_siblings for r in taxonomy.sibling_groups(e, c).collect()}
    assert {u: n for u, n in got.items() if n} == {u: len(s) for u, s in pairs.items()}


def test_split_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    rows = spark.range(300).selectExpr("id", "CASE WHEN id < 200 THEN 'hot' WHEN id < 290 THEN concat('k', id % 9) END AS k")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v int")
    got = skew.join_split(rows, table, "k", rows["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table, "k").collect()))
    assert got.columns == ["k", "id", "v"]
