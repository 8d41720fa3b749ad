"""Centroids and vector codes against plain Python, and what becomes of odd rows."""

import hashlib
import math

import numpy as np
import pytest

from labourmill.llm import centroids, codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int"


def kept(rows, scale):
    whole = [(k, [math.floor(scale * float(x)) for x in v], label) for k, v, label in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    return [r for r in whole if all(abs(x) <= 2**26 for x in r[1])]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(entries, parts, of):
    out = []
    for e, entry in enumerate(entries):
        mine = [p for p, o in zip(parts, of, strict=True) if o == e]
        out.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else entry)
    return out


def lowest(entries, p):
    far = [square(p, e) for e in entries]
    return far.index(min(far))


def brute_clusters(rows, rounds=10):
    rows = kept(rows, 1024)
    packed = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), packed(r[1])))
    middle = [r[1] for r in first[:8]]
    vectors = [r[1] for r in rows]
    for _ in range(rounds):
        middle = moved(middle, vectors, [lowest(middle, v) for v in vectors])
    of = [lowest(middle, v) for v in vectors]
    far = [square(v, middle[o]) for v, o in zip(vectors, of, strict=True)]
    inertia = {o: sum(f for f, p in zip(far, of, strict=True) if p == o) for o in of}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((r[0], o, f, inertia[o], sum(far), digest[o]) for r, o, f in zip(rows, of, far, strict=True)), key=repr)


def brute_codes(rows, rounds=6):
    rows = kept(rows, 4096)
    packed = lambda v: np.array(v, "<i4").tobytes()
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, packed(r[1])))[:16]
    code, error, books = [""] * len(rows), [0] * len(rows), []
    for p in range(0, 64, 8):
        entries, parts = [r[1][p : p + 8] for r in first], [r[1][p : p + 8] for r in rows]
        for _ in range(rounds):
            entries = moved(entries, parts, [lowest(entries, x) for x in parts])
        books.append(entries)
        for i, x in enumerate(parts):
            e = lowest(entries, x)
            code[i] += f"{e:02x}"
            error[i] += square(entries[e], x)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {r[2]: sum(x for x, o in zip(error, rows, strict=True) if o[2] == r[2]) for r in rows}
    return sorted(((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(rows, code, error, strict=True)), key=repr)


def read(spark, folder, rows):
    spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def both(spark, folder):
    a = centroids.op11_centroids(spark, folder).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    b = codes.op13_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 64).astype("f4").tolist(), i % 3 if i % 4 else None) for i in range(60)]
    same = rng.normal(0, 0.3, 64).astype("f4").tolist()
    rows += [(100 + i, same, 1) for i in range(40)]  # a third has one vector
    rows += [(3, same, 2), (3, same, 2), (None, same, None), (None, rows[0][1], 0)]  # repeated and null keys
    rows += [(200, None, 1), (201, [], 1), (202, same[:63], 1), (203, [*same, 0.0], 1)]
    rows += [(204, [None, *same[1:]], 1), (205, [math.nan, *same[1:]], 1), (206, [*same[1:], -math.inf], 1), (207, [1e30, *same[1:]], 1)]
    return rows


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    got = both(spark, read(spark, tmp_path, rows))
    assert got == (brute_clusters(rows), brute_codes(rows))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64, None) for i in range(n)]
    assert both(spark, read(spark, tmp_path, rows)) == (brute_clusters(rows), brute_codes(rows))


def test_ties_go_to_the_lower_number(spark, tmp_path):
    # Two groups of equal vectors: entries repeat, and the lower of equals has all.
    rows = [(i, [0.5 if i % 2 else -0.5] * 64, 0) for i in range(30)]
    assert both(spark, read(spark, tmp_path, rows)) == (brute_clusters(rows), brute_codes(rows))


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert both(spark, SF) == (brute_clusters(rows), brute_codes(rows))


@pytest.mark.parametrize("seed", range(20))
def test_searches_are_exact(seed):
    rng = np.random.default_rng(seed)
    width, n = int(rng.integers(1, 20)), int(rng.integers(1, 12))
    spread = int(rng.choice([2, 50, 2**20]))
    x, entries = rng.integers(-spread, spread, (200, width)), rng.integers(-spread, spread, (n, width))
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    number, distance = centroids.nearest(x, entries)
    assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()
    turned = codes.transform(entries)
    code, scaled = codes.nearest(codes.transform(x), turned)
    assert (code == far.argmin(1)).all() and (scaled == far.min(1) * turned.shape[1]).all()


def test_transform_is_in_order_of_sequency():
    rows = codes.transform(np.eye(8, dtype=np.int64)).T
    assert (np.diff(rows, axis=1) != 0).sum(1).tolist() == list(range(8)) and (rows @ rows.T == 8 * np.eye(8)).all()


def test_parts_padded_with_zeros(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 12).tolist()) for i in range(50)]
    found, books = codes.compress(spark.createDataFrame(rows, "v long, e array<double>"), "e", "v", [], parts=4, entries=5, size=12)
    whole = {k: [math.floor(4096 * x) for x in v] for k, v in rows}
    for r in found.collect():
        parts = [whole[r.v][3 * p : 3 * p + 3] for p in range(4)]
        near = [lowest(books[p].tolist(), x) for p, x in enumerate(parts)]
        assert r.code == "".join(f"{e:02x}" for e in near) and r.error == sum(square(x, books[p][e].tolist()) for p, (x, e) in enumerate(zip(parts, near, strict=True)))
