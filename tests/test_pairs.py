"""Operators on pairs of vectors and boxes: what they send and what they meet."""

import numpy as np
from pyspark.sql import functions as F

from gridquarry.operators import coverage, latent, nms, search


def test_distances_of_all_pairs_are_not_joined(spark):
    from gridquarry.plans.queries import QUERIES

    found = QUERIES["j15_distances_to_queries"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert found.count() > 0


def test_best_of_each_row_with_ties_by_id():
    rng = np.random.default_rng(3)
    s, ids = np.round(rng.normal(size=(40, 200)), 1), rng.permutation(1000)[:200]
    s[3, 5] = np.nan
    row, j = search._best(s, ids, 7)
    want = [sorted(range(200), key=lambda c: (np.isnan(s[r, c]), -s[r, c], ids[c]))[:7] for r in range(40)]
    assert [(int(a), int(b)) for a, b in zip(row, j, strict=True)] == [(r, c) for r in range(40) for c in want[r]]


def test_a_pair_of_blocks_meets_once(spark):
    """40 vectors in 4 blocks: 4 + 1 copies of each, where both sides of all pairs of blocks would take 8."""
    x = np.random.default_rng(0).normal(size=(40, 4))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    found = search.all_knn(rows, 3, block=10)
    sides = found._jdf.queryExecution().analyzed().toString()
    assert sides.count("sequence(0, 3") == 0  # no side goes to all blocks
    got = {(r["query"], r["id"]) for r in found.collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert got == {(k, int(c)) for k in range(40) for c in np.lexsort((np.arange(40), -s[k]))[:3]}


def test_euclid_by_products_keeps_its_digits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 64)) + 5
    x[1], x[2] = x[0], x[0] + 1e-9
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = latent._euclid(x, x)
    assert (got[0, :2] == 0).all() and np.allclose(got, want, rtol=1e-10, atol=0)


def test_of_equal_boxes_only_the_best_meets_others(spark, monkeypatch):
    df = spark.range(900).select("id", *[F.lit(v).alias(c) for c, v in (("x0", 0.1), ("y0", 0.1), ("x1", 0.4), ("y1", 0.4))])
    flat = spark.createDataFrame([(1000, 0.2, 0.2, 0.2, 0.3), (1001, 0.2, 0.2, 0.2, 0.3), (1002, None, 0.2, 0.2, 0.3)], "id long, x0 double, y0 double, x1 double, y1 double")
    met, plain = [], nms._suppressed
    monkeypatch.setattr(nms, "_suppressed", lambda edges: met.append(edges.count()) or plain(edges))
    kept = nms.nms_iou(df.unionByName(flat), ("x0", "y0", "x1", "y1"), [-F.col("id")], 0.3, 0.5)
    assert sorted(r["id"] for r in kept.collect()) == [899, 1000, 1001, 1002]
    assert met == [0]


def test_footprints_of_equal_rings_are_one_candidate(spark):
    x = F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    ring = coverage.box_ring([x, F.lit(0.0), x + 1.0 + (F.col("id") % 2) * 0.5, F.lit(1.0)])
    rows = spark.range(60).select((F.col("id") + 10).cast("string").alias("product_id"), ring.alias("ring"), F.lit(1).alias("orbit"), F.lit(40.0).alias("incidence"), F.lit(1.0).alias("resolution"))
    products, shapes = coverage._candidates(rows, [np.array([(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 1.0)])], 0.5)
    assert (products.count(), shapes.count()) == (60, 2)
    found = coverage.select_coverage(rows, [(0, 0), (3, 0), (3, 1), (0, 1)], 0.5)
    assert [(r["pick"], r["product_id"], round(r["gain"], 9)) for r in found.orderBy("pick").collect()] == [(1, "11", 1.5), (2, "10", 1.0)]
