"""Operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.operators import aggregates, coverage, joins, nms, search, tiles


def greedy(rows, near):
    kept = []
    for r in sorted(rows):
        if not any(near(r, k) for k in kept):
            kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("metric", ["l2", "l1", "chebyshev"])
@pytest.mark.parametrize("seed", [0, 1])
def test_nms_plane(spark, metric, seed):
    rng = np.random.default_rng(seed)
    rows = [(float(s), i, float(x), float(y), int(g)) for i, (s, x, y, g) in enumerate(zip(rng.integers(0, 50, 300), rng.integers(-100, 100, 300), rng.integers(0, 200, 300), rng.integers(0, 2, 300)))]
    df = spark.createDataFrame(rows, "s double, i int, x double, y double, g int")
    tests = {"l2": lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 < 20, "l1": lambda a, b: abs(a[2] - b[2]) + abs(a[3] - b[3]) < 20, "chebyshev": lambda a, b: abs(a[2] - b[2]) < 20 and abs(a[3] - b[3]) < 20}
    want = greedy(rows, lambda a, b: a[4] == b[4] and tests[metric](a, b))
    got = nms.nms_plane(df, "x", "y", [F.col("s"), F.col("i")], 20.0, metric, ["g"])
    assert sorted(map(tuple, got.collect())) == want


def test_nms_plane_edges(spark):
    schema = "s double, x double, y double, id long, cell string"
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1, "a"), (1.0, 0.0, 0.0, 1, "a"), (2.0, None, 0.0, 2, None)], schema)
    assert nms.nms_plane(df, "x", "y", [F.col("s")], 5.0).count() == 2  # equal rows keep one; rows without place stay
    assert nms.nms_plane(spark.createDataFrame([], schema), "x", "y", [F.col("s")], 5.0).count() == 0


def test_nms_sphere(spark):
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(88, 90, 60), rng.uniform(-1, 1, 60)])
    lon = np.concatenate([rng.uniform(0, 360, 60), (rng.uniform(-1, 1, 60) + 360) % 360])
    rows = [(float(i % 7), i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]

    def near(a, b):
        p, q, d = np.radians(a[2]), np.radians(b[2]), np.radians(a[3] - b[3])
        h = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
        return 2 * 1737400.0 * np.arcsin(min(1, h**0.5)) < 15_000

    got = nms.nms_sphere(spark.createDataFrame(rows, "s double, i int, lat double, lon double"), "lat", "lon", [F.col("s"), F.col("i")], 15_000.0)
    assert sorted(map(tuple, got.collect())) == greedy(rows, near)


def test_nms_iou(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 30)), i, *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(*(rng.integers(a, b, 150) for a, b in ((0, 50), (0, 50), (1, 15), (1, 15)))))]

    def near(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        o = max(w, 0) * max(h, 0)
        return o > 0.3 * ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - o)

    df = spark.createDataFrame(rows, "s double, i int, a double, b double, c double, d double")
    assert sorted(map(tuple, nms.nms_iou(df, ("a", "b", "c", "d"), [F.col("s"), F.col("i")], 0.3, 8.0).collect())) == greedy(rows, near)


@pytest.mark.parametrize("batch", [2, 64])
def test_greedy_cover(spark, batch):
    rng = np.random.default_rng(5)
    sets = {f"p{k:02d}": {(int(i), int(j)) for i, j in rng.integers(0, 12, (rng.integers(3, 30), 2))} for k in range(30)}
    df = spark.createDataFrame([(p, i, j) for p, s in sets.items() for i, j in s], "product_id string, i int, j int")
    want, left = [], {p: set(s) for p, s in sets.items()}
    while True:
        p = min(left, key=lambda n: (-len(left[n]), n))
        if not left[p]:
            break
        want.append((p, len(left[p])))
        taken = set(left[p])
        left = {n: s - taken for n, s in left.items()}
    assert coverage.greedy_cover(df, batch=batch)[0] == want


def test_search_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**62), 2**62, (200, 2))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<long>").repartition(3)
    queries = df.where("id % 20 = 0").withColumnRenamed("id", "query")
    monkeypatch.setattr(search, "BLOCK", 3)
    d = np.array([[sum(int(int(a) ^ int(b)).bit_count() if (int(a) ^ int(b)) >= 0 else ((int(a) ^ int(b)) + 2**64).bit_count() for a, b in zip(p, q)) for p in x] for q in x[::20]])
    want = {(20 * i, int(j), int(d[i, j])) for i in range(10) for j in sorted(range(200), key=lambda j: (d[i, j], j))[:5]}
    got = search.hamming_knn(df, queries, 5)
    assert {(r["query"], r["id"], r["distance"]) for r in got.collect()} == want


def test_nearest_site_at_pole_and_meridian(spark):
    rng = np.random.default_rng(7)
    lat = np.concatenate([rng.uniform(89.5, 90, 40), rng.uniform(-0.05, 0.05, 40)])
    lon = np.concatenate([rng.uniform(0, 360, 40), rng.uniform(-0.05, 0.05, 40) % 360])
    hits = [(float(a), float(b)) for a, b in zip(lat[::2], lon[::2])]
    sites = [(f"s{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(lat[1::2], lon[1::2]))]

    def metres(a, b, c, d):
        dlon = np.radians((b - d + 540) % 360 - 180) * np.cos(np.radians((a + c) / 2))
        return 1737400.0 * np.hypot(np.radians(a - c), dlon)

    want = {}
    for a, b in hits:
        m, n = min((metres(a, b, c, d), n) for n, c, d in sites)
        want[a, b] = n if m <= 1500 else None
    got = joins.nearest_site(spark.createDataFrame(hits, "lat double, lon double"), spark.createDataFrame(sites, "name string, latitude double, longitude double"), 1500.0)
    assert {(r["lat"], r["lon"]): r["name"] for r in got.collect()} == want


def test_embed_halves_on_memory_error(spark):
    def factory():
        def model(x):
            if len(x) > 3:
                raise MemoryError
            return x[:, :2].astype(float)

        return model

    df = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(20)], "id long, px array<double>")
    got = tiles.embed(df, factory, "id", "px")
    assert {r["id"]: r["embedding"] for r in got.collect()} == {k: [float(k), 1.0] for k in range(20)}


def test_family_thresholds_and_merge(spark):
    q = spark.createDataFrame([(k, 0 if k < 50 else 1) for k in range(51)], "query int, family int")
    got = {r["family"]: r["threshold"] for r in search.family_thresholds(q, 113).collect()}
    assert got == {0: 112, 1: 103}


def test_nms_with_priorities_along_a_chain(spark):
    """The worst case for rounds: every row waits for the one before."""
    df = spark.createDataFrame([(k, float(k)) for k in range(12)], "s int, x double").withColumn("y", F.lit(0.0))
    assert sorted(r["s"] for r in nms.nms_plane(df, "x", "y", [F.col("s")], 1.5).collect()) == list(range(0, 12, 2))


def test_crop_roi(spark):
    frame = np.arange(12 * 10, dtype=float).reshape(12, 10)
    stripes = spark.createDataFrame([("p", k, row.tolist()) for k, row in enumerate(frame)], "product_id string, line int, values array<double>")
    frames = spark.createDataFrame([("p", 12, 10), ("empty", 5, 5)], "product_id string, lines int, samples int")
    at = [(1, "p", 5.9, 6.2), (2, "p", 0.0, 0.0), (3, "p", 11.5, 13.0), (4, "p", 14.1, 0.0), (5, "p", None, 1.0), (6, "none", 1.0, 1.0), (7, "empty", 2.0, 2.0), (8, "p", -4.0, -4.0)]
    got = {r["k"]: r["pixels"] for r in tiles.crop_roi(spark.createDataFrame(at, "k int, product_id string, x double, y double"), frames, stripes, "k", 4, 4).collect()}
    for k, _, x, y in at[:3] + at[7:]:
        want = np.full((4, 4), np.nan)
        for i in range(4):
            for j in range(4):
                r, c = int(np.floor(y)) - 2 + i, int(np.floor(x)) - 2 + j
                if 0 <= r < 12 and 0 <= c < 10:
                    want[i, j] = frame[r, c]
        assert np.array_equal(np.array(got[k]).reshape(4, 4), want, equal_nan=True)
    assert got[4] is None and got[5] is None and got[6] is None and np.isnan(got[7]).all() and len(got[7]) == 16


def test_read_rasters(spark, tmp_path):
    from gridquarry.sources import rasters, tables

    one, two = np.array([[1, -32768, 3], [4, 5, 6]]), np.arange(6).reshape(3, 2)
    (tmp_path / "a.IMG").write_bytes(b"label" + one.astype(">i2").tobytes())
    (tmp_path / "b.IMG").write_bytes(two.astype("<u1").tobytes()[:4])  # a line is missing
    labels = [("a.IMG", "A", 5, 2, 3, 16, True, True, 0.5, 1.0), ("b.IMG", "B", 0, 3, 2, 8, False, False, 1.0, 0.0), ("c.IMG", "C", 0, 1, 1, 8, False, False, 1.0, 0.0)]
    schema = "file string, product_id string, header_bytes int, lines int, samples int, bits int, msb boolean, signed boolean, scale double, offset double"
    found = rasters.read_rasters(spark, str(tmp_path), spark.createDataFrame(labels, schema), range_bytes=5)
    got = {(r["product_id"], r["line"]): r["values"] for r in found.collect()}
    assert np.isnan(got["A", 0][1]) and got["A", 0][::2] == [1.5, 2.5] and got["A", 1] == [3.0, 3.5, 4.0] and got["B", 1] == [2.0, 3.0] and len(got) == 4
    most = {(r["product_id"], r["line"]): r["values"] for r in tables.by_frame_maximum(found).collect()}
    assert most["A", 1] == [0.75, 0.875, 1.0] and most["B", 0] == [0.0, pytest.approx(1 / 3)]


def test_scan_of_a_region(spark):
    """The same as a scan of the chosen product's tiles in the region."""
    from gridquarry.plans import scan
    from gridquarry.plans.queries import QUERIES
    from gridquarry.plans.standins import table

    sf = "/root/testdata/sf0.001"
    got = QUERIES["f07_scan_roi"](spark, sf).collect()
    pieces = table(spark, sf, "tiles")
    inside = pieces.where("lon BETWEEN 300.004 AND 300.036")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    names = {r["product_id"] for r in got}
    whole = scan.scan(vectors, table(spark, sf, "anchors"), inside.where(F.col("product_id").isin(sorted(names))), base=40)
    assert 1 <= len(names) < pieces.select("product_id").distinct().count() and got == whole.collect()
    roi_tiles = {r["tile_id"] for r in inside.collect()}
    assert {r["tile_id"] for r in got} <= roi_tiles


def test_files_without_a_window_go_with_all(spark):
    products = spark.createDataFrame([("p",), ("q",)], "product_id string").withColumn("ts", F.lit("2020-01-05").cast("timestamp"))
    files = spark.createDataFrame([(f"open{k}",) for k in range(2500)] + [("x_2020001_2020010",), ("x_2021001_2021010",)], "name string")
    got = joins.covering_files(products, files)
    assert got.count() == 2 * 2501 and got.where("name LIKE 'x%'").count() == 2


def test_dual_scale_pooling_of_ties_and_hot_groups(spark):
    """Against numpy: a group of most rows, equal norms, a group of one, null vectors and null keys."""
    rng = np.random.default_rng(8)
    rows = [("hot", k, rng.integers(-2, 3, 6).astype(float).tolist()) for k in range(300)] + [("one", 1, [3.0, 0.0, 0.0, 0.0, 0.0, 4.0]), ("zero", 1, [0.0] * 6)]
    df = spark.createDataFrame([*rows, ("hot", 999, None)], "g string, k long, v array<double>").repartition(3)
    got = {r["g"]: r["pooled"] for r in aggregates.dual_scale_pooling(df, "g", "v", "k").collect()}
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    for g in ("hot", "one", "zero"):
        own = sorted(((k, np.array(v)) for h, k, v in rows if h == g), key=lambda r: (-round(float(r[1] @ r[1]), 9), r[0]))
        n = len(own) + (g == "hot")  # a null vector counts as a row, the last
        best = [v for _, v in own[: max(1, int(0.1 * n))]]
        expected = unit(np.concatenate([unit(np.mean([v for _, v in own], axis=0)), unit(np.mean(best, axis=0))]))
        assert got[g] == pytest.approx(expected.tolist(), abs=1e-9)


def test_a_shadow_without_an_offset_points_down(spark):
    moments = "struct<area:bigint,cx:double,cy:double,width:int,height:int>"
    masks = spark.createDataFrame([(1, (20, 3.5, 3.5, 7, 7), (20, 3.5, 3.5, 7, 7)), (2, (20, 3.0, 4.0, 7, 7), (20, 3.0, 3.0, 7, 7))], f"id long, shadow {moments}, edge {moments}")
    found = aggregates.physics_validate(masks, "id", F.lit(10.0), F.lit(60.0))
    assert {r["id"]: (r["shadow_deg"], r["error_deg"]) for r in found.collect()} == {1: (180.0, 10.0), 2: (180.0, 10.0)}


def test_limits_of_a_tile_are_sorted_once(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0, 4.0]), (2, [5.0, 5.0]), (3, [])], "id int, px array<double>")
    found = tiles.normalize(rows, "px", shares=(0.25, 0.75))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
    assert dict(map(tuple, found.collect())) == {1: [0, 0, 127, 255, 255], 2: [0, 0], 3: []}
