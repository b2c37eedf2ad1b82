"""Closed-form cases of column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.functions import geo, ids, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(x):
    return F.lit(x)


def corners(ul, ur, ll, lr):
    return {f"{n}_{k}": lit(float(v)) for n, p in (("ul", ul), ("ur", ur), ("ll", ll), ("lr", lr)) for k, v in zip(("lon", "lat"), p)}


@pytest.mark.parametrize("lon", [312.4, -47.6])
def test_inverse_projection_wraps(spark, lon):
    lons, lats = geo.corner_order(corners((312.0, 20), (312.8, 20), (312.0, 19), (312.8, 19)))
    x, y = geo.lonlat_to_pixel(lit(lon), lit(19.5), lit(1001), lit(2001), lons, lats)
    r = one(spark, x, y)
    assert r[0] == pytest.approx(500, abs=1e-3) and r[1] == pytest.approx(1000, abs=1e-3)


@pytest.mark.parametrize("lon", [360.0, 0.0])
def test_inverse_projection_across_the_meridian(spark, lon):
    lons, lats = geo.corner_order(corners((359.5, 10), (0.5, 10), (359.5, 9), (0.5, 9)))
    r = one(spark, *geo.lonlat_to_pixel(lit(lon), lit(9.5), lit(1001), lit(2001), lons, lats))
    assert r[0] == pytest.approx(500, abs=1e-3) and r[1] == pytest.approx(1000, abs=1e-3)


def test_ascending_pass_starts_in_the_south(spark):
    lons, lats = geo.corner_order(corners((40, 12), (40.5, 12), (40, 10), (40.5, 10)), lit(10.0), lit(12.0))
    assert one(spark, geo.lonlat_to_pixel(lit(40.25), lit(10.0), lit(1001), lit(2001), lons, lats)[1])[0] == pytest.approx(0, abs=1e-6)


def test_projection_round_trip_of_skewed_corners(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        j = rng.uniform(-0.05, 0.05, 8)
        lons, lats = geo.corner_order(corners((10 + j[0], 5 + j[1]), (10.6 + j[2], 5.1 + j[3]), (10.1 + j[4], 3 + j[5]), (10.7 + j[6], 3.1 + j[7])))
        lon, lat = geo.pixel_to_lonlat(lit(777.0), lit(1234.0), lit(1001), lit(2001), lons, lats)
        r = one(spark, *geo.lonlat_to_pixel(lon, lat, lit(1001), lit(2001), lons, lats))
        assert r[0] == pytest.approx(777, abs=1e-4) and r[1] == pytest.approx(1234, abs=1e-4)


def test_product_keys_order_by_number(spark):
    key = lambda s: ids.product_sort_key(lit(s))
    assert one(spark, key("M1103873683RC") > key("M116943122RC"))[0]
    assert one(spark, key("M999999999RC") < key("M1000000000RC"))[0]


def test_ids(spark):
    assert one(spark, ids.normalize_product_id(lit(" m100000001r.img ")))[0] == "M100000001RC"
    assert [one(spark, ids.camera_side(lit(s)))[0] for s in ("M1118880788RC", "M1118880788LE", "M1118880788L", "X1")] == ["R", "L", "L", None]
    with pytest.raises(Exception):
        one(spark, ids.camera_side(lit("X1"), strict=True))


@pytest.mark.parametrize("lat, lon, name", [
    (14.091, 303.228, "00N_30N_270_315"), (-15.0, -45.0, "30S_00S_315_360"), (-45.0, 0.0, "60S_30S_000_045"), (60.0, 180.0, "30N_60N_180_225"),
])
def test_dem_tile_name(spark, lat, lon, name):
    assert one(spark, ids.dem_tile_name(lit(lat), lit(lon)))[0] == f"SLDEM2015_512_{name}"


@pytest.mark.parametrize("lat", [61.0, -60.5, float("nan")])
def test_dem_tile_name_outside(spark, lat):
    assert one(spark, ids.dem_tile_name(lit(lat), lit(0.0)))[0] is None


def test_codes():
    h = vectors.hadamard_matrix(384)
    assert (h @ h.T == 384 * np.eye(384)).all()
    assert vectors.binary_codes(np.random.default_rng(0).normal(size=(10, 384))).shape == (10, 6)
    assert vectors.binary_codes(np.zeros((1, 64))).shape == (1, 1)


def test_null_bearing_is_the_default(spark):
    assert one(spark, geo.bearing_deg(lit(None).cast("double"), lit(1.0), lit(2.0), lit(3.0)))[0] == 180.0


def test_a_bearing_a_hair_west_of_north_is_360(spark):
    assert one(spark, F.round(geo.bearing_deg(lit(14.64), lit(200.0), lit(10.0), lit(20.0)), 6))[0] == 360.0


def test_ray_misses(spark):
    assert one(spark, geo.ray_sphere([lit(3e6), lit(2e6), lit(0.0)], [lit(-1.0), lit(0.0), lit(0.0)]))[0] is None


def ring(points):
    return F.array(*[F.struct(lit(float(x)).alias("lon"), lit(float(y)).alias("lat")) for x, y in points])


@pytest.mark.parametrize("by, area", [
    ([(0, 0), (4, 0), (0, 4)], 6.0), ([(0, 4), (4, 0), (0, 0)], 6.0), ([(5, 5), (6, 5), (6, 6)], 0.0), ([(-9, -9), (9, -9), (9, 9), (-9, 9)], 9.0), ([(1, 1), (2, 1), (2, 2), (1, 2)], 1.0),
    ([(1.5, -1), (4, 1.5), (1.5, 4), (-1, 1.5)], 9 - 4 * 0.5 * 0.5 * 0.5),
])
def test_convex_clip(spark, by, area):
    square = [(0, 0), (3, 0), (3, 3), (0, 3)]
    want = 6.0 if area == 6.0 else area
    if area == 6.0:  # the triangle loses its two corners beyond the square
        want = 8 - 2 * 0.5
    got = one(spark, geo.convex_clip_area(ring(square), ring(by)), geo.convex_clip_area(ring(square[::-1]), ring(by)))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(want)


def test_clip_of_random_triangles_is_symmetric(spark):
    rng = np.random.default_rng(2)
    for _ in range(4):
        p, q = rng.uniform(0, 4, (2, 3, 2))
        a, b, n = one(spark, geo.convex_clip_area(ring(p), ring(q)), geo.convex_clip_area(ring(q), ring(p)), lit(1))
        at = rng.uniform(0, 4, (200_000, 2))

        def inside(t):
            d = [(t[(k + 1) % 3][0] - t[k][0]) * (at[:, 1] - t[k][1]) - (t[(k + 1) % 3][1] - t[k][1]) * (at[:, 0] - t[k][0]) for k in range(3)]
            return (np.array(d) >= 0).all(0) | (np.array(d) <= 0).all(0)

        assert a == pytest.approx(b) and a == pytest.approx((inside(p) & inside(q)).mean() * 16, abs=0.1)


def test_chain_of_places(spark):
    nan, none = lit(float("nan")), lit(None).cast("double")
    lon, lat = geo.first_place((none, lit(1.0)), (nan, lit(1.0)), (lit(0.0), lit(0.0)), (lit(0.0), lit(5.0)), (lit(9.0), lit(9.0)))
    assert tuple(one(spark, lon, lat)) == (0.0, 5.0)
    assert tuple(one(spark, *geo.first_place((none, none)))) == (None, None)
