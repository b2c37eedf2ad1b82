"""Latent-space and shape operators against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.operators import coverage, joins, latent, search, shapes


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


def residuals(edges, got):
    """(eigenvalues of a dense solver, residuals of the coordinates against their own quotients, these)."""
    rows = {r["id"]: (r["c1"], r["c2"]) for r in got.collect()}
    place = {i: k for k, i in enumerate(sorted(rows))}
    dense = np.zeros((len(rows), len(rows)))
    for r in edges.collect():
        dense[place[r["src"]], place[r["dst"]]] = r["l"]
    x = np.array([rows[i] for i in sorted(rows)])
    value = np.diag(x.T @ dense @ x)
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-6)
    return np.linalg.eigvalsh(dense), np.linalg.norm(dense @ x - x * value, axis=0), value


def test_spectral_coords_equal_eigenvectors(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(12, 6)) * 0.3 + c for c in (np.eye(6)[0] * 3, np.eye(6)[1] * 3, np.eye(6)[2] * 3)])
    edges = latent.knn_graph(table(spark, x), 20)
    values, off, own = residuals(edges, latent.spectral_coords(edges))
    assert (off < 2e-3).all() and own == pytest.approx(values[1:3], abs=1e-5)


def test_all_knn_in_blocks(spark):
    x = np.random.default_rng(11).normal(size=(90, 5))
    got = {(r["query"], r["rank"]): r["id"] for r in search.all_knn(table(spark, x), 4, block=13).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert got == {(i, r + 1): j for i in range(90) for r, j in enumerate(sorted(range(90), key=lambda j: (-s[i, j], j))[:4])}
    assert search.all_knn(table(spark, x).limit(0), 4).count() == 0


def kinds(seed):
    rng = np.random.default_rng(seed)
    apart = rng.normal(size=(1500, 12))
    close = (rng.normal(size=(30, 24)) * 2)[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 24))
    return apart, close


@pytest.mark.parametrize("which", [0, 1])
def test_descent_finds_neighbours(spark, which):
    """Recall among random directions and among groups, less a vector itself."""
    x = kinds(21)[which]
    rows = table(spark, x)
    exact = {(r["query"], r["id"]) for r in search.all_knn(rows, 9).collect() if r["query"] != r["id"]}
    got = search.descend_knn(rows, 9).collect()
    assert len(got) == 9 * len(x) and {r["rank"] for r in got} == set(range(1, 10))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(r["similarity"] == pytest.approx(u[r["query"]] @ u[r["id"]], abs=1e-6) for r in got[:500])
    assert len(exact & {(r["query"], r["id"]) for r in got}) / len(exact) >= 0.95


def test_descent_of_copies_zeros_and_nothing(spark):
    x = np.concatenate([np.tile(np.eye(4)[:1], (400, 1)), np.zeros((3, 4)), np.eye(4)[1:]])
    got = search.descend_knn(table(spark, x).unionByName(spark.createDataFrame([(-1, None)], "id long, v array<double>")), 3)
    by = {}
    for r in got.collect():
        by.setdefault(r["query"], []).append(r["similarity"])
    assert sorted(by) == list(range(len(x))) and all(by[k] == [1.0] * 3 for k in range(400)) and max(by[401]) == 0.0
    assert search.descend_knn(table(spark, x).limit(0), 3).count() == 0
    assert [(r["query"], r["id"]) for r in search.descend_knn(table(spark, x[:1]), 3).collect()] == [(0, 0)]


def test_graph_of_descent(spark):
    x = kinds(5)[1][:400]
    a, b = ({(r["src"], r["dst"]): (r["w"], r["l"]) for r in latent.knn_graph(table(spark, x), 6, exact=e).collect()} for e in (True, False))
    same = a.keys() & b.keys()
    assert len(same) >= 0.97 * len(a) and np.mean([abs(a[e][0] - b[e][0]) for e in same]) < 1e-2


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.0, 0.0, 0.0, 5.0], [4.0, 1.0, 9.0, 1.0, 7.0], []])
def test_exact_median(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    assert latent.exact_median(rows, "x") == (float(np.median(values)) if values else None)


def test_distortion_of_the_same_vectors_is_none(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    ratio, score = latent.jl_distortion(table(spark, x), table(spark, 3 * x), 40)
    assert ratio == pytest.approx(1) and score == pytest.approx(1)


def test_sammon_strain(spark):
    rng = np.random.default_rng(2)
    h, low = rng.normal(size=(20, 6)), rng.normal(size=(20, 2))
    got = {r["id"]: r["strain"] for r in latent.sammon_strain(table(spark, h), table(spark, low), 100).collect()}
    u = h / np.linalg.norm(h, axis=1, keepdims=True)
    a = np.array([[min(max(1 - p @ q, 0), 2) for q in u] for p in u])
    b = np.array([[np.linalg.norm(p - q) for q in low] for p in low])
    b = b * np.median(a) / np.median(b)
    for i in range(20):
        assert got[i] == pytest.approx(sum((a[i, j] - b[i, j]) ** 2 / a[i, j] for j in range(20) if j != i))
    assert latent.sammon_strain(table(spark, h).limit(0), table(spark, low)).count() == 0


def test_strain_worked_by_hand(spark):
    """Three directions at right angles or opposite, and places 0, 1 and 4 on a line. Cosine distances: 1, 2, 1, and lines:
    1, 4, 3; medians with the diagonal's zeros: 1 and 1, so the scale is 1."""
    high, low = np.array([[2.0, 0.0], [0.0, 3.0], [-1.0, 0.0]]), np.array([[0.0, 0.0], [1.0, 0.0], [4.0, 0.0]])
    got = {r["id"]: (r["strain"], r["stress"]) for r in latent.sammon_strain(table(spark, high), table(spark, low)).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({0: (1 - 1) ** 2 / 1 + (2 - 4) ** 2 / 2, 1: 0 + (1 - 3) ** 2 / 1, 2: 2 + 4})
    assert got[0][1] == pytest.approx((2 + 4 + 6) / (3 + 2 + 3))


def test_gate_separates(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(y), float(a), float(b)) for y in (0, 1) for a, b in rng.normal(size=(40 if y else 160, 2)) + 4 * y], "y double, a double, b double")
    got = latent.apply_gate(latent.train_gate(rows, ["a", "b"]), rows).collect()
    assert np.mean([(r["decision"] > 0) == (r["y"] == 1) for r in got]) > 0.97


def test_principal_components(spark):
    x = np.random.default_rng(4).normal(size=(80, 5)) * [5, 2, 0.1, 0.1, 0.1]
    got = np.array([(r["x_2d"], r["y_2d"]) for r in latent.reduce_2d(table(spark, x)).orderBy("id").collect()])
    assert abs(np.corrcoef(got[:, 0], x[:, 0])[0, 1]) > 0.99 and abs(np.corrcoef(got[:, 1], x[:, 1])[0, 1]) > 0.98


def test_vector_table_checks_length(spark):
    t = latent.VectorTable(table(spark, np.eye(4)), 4)
    with pytest.raises(ValueError):
        t.upsert(table(spark, np.eye(3)))
    assert t.upsert(table(spark, np.ones((2, 4)))).rows.count() == 4


def test_shadow_shape(spark):
    image = np.full((16, 16), 100.0)
    image[3:5, 2:14] = 1.0  # a bar of 2 by 12
    image[12, 12] = 1.0
    rows = [(0, image.ravel().tolist()), (1, [0.0] * 256), (2, [5.0] * 256), (3, None)]
    got = {r["id"]: (r["area"], r["aspect"]) for r in shapes.shadow_shape(spark.createDataFrame(rows, "id int, px array<double>"), "id", "px", 16).collect()}
    assert got[0][0] == pytest.approx(25 / 256) and 5.5 < got[0][1] < 6.5
    assert got[1] == got[3] == (0.0, 99.0) and got[2] == (0.0, 1.0)


def test_largest_blob():
    rng = np.random.default_rng(5)
    for _ in range(20):
        mask = rng.random((12, 12)) < 0.35
        best, left = 0, {tuple(p) for p in np.argwhere(mask)}
        while left:
            stack, n = [left.pop()], 0
            while stack:
                y, x = stack.pop()
                n += 1
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                stack += near
            best = max(best, n)
        assert len(shapes.largest_blob(mask)) == best


def test_cover_reaches_the_region(spark):
    rng = np.random.default_rng(6)
    rows = [(f"p{k:03d}", k % 5, *(round(float(v), 1) for v in (x, y, x + 1.5, y + 1.5)), 1.0, 45.0) for k, (x, y) in enumerate(rng.uniform(-1, 4, (200, 2)))]
    df = spark.createDataFrame(rows, "product_id string, orbit int, min_lon double, min_lat double, max_lon double, max_lat double, resolution double, incidence double")
    boxes = df.withColumn("ring", coverage.box_ring([F.col(c) for c in joins.BOX]))
    picks = coverage.select_coverage(boxes, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 1.5).orderBy("pick").collect()
    gains = [r["gain"] for r in picks]
    assert 0.99 * 16 < sum(gains) <= 16 + 1e-9 and gains == sorted(gains, reverse=True) and {r["pass"] for r in picks} == {0}
    assert sum(gains[:-1]) <= 0.99 * 16 and [r["pick"] for r in picks] == list(range(1, len(picks) + 1))


def test_terrain_converges(spark):
    rays = spark.createDataFrame([("hit", 3e6, 0.0, 0.0, -1.0, 0.0, 0.0), ("miss", 3e6, 2.5e6, 0.0, -1.0, 0.0, 0.0)], "ray_id string, px double, py double, pz double, dx double, dy double, dz double")
    heights = spark.createDataFrame([(0, 0, 1234.0)], "i long, j long, height_m double")
    got = {r["ray_id"]: r for r in joins.terrain_intersect(rays, heights, 1.0).collect()}
    assert got["hit"]["height_m"] == 1234.0 and got["miss"]["height_m"] is None


def test_as_of_ties(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (1, 6, "c")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, "k", "t", "v").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
