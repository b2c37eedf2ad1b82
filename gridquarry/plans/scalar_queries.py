"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, ids, vectors
from .registry import Tables, query

col = F.col


def r6(c):
    return F.round(c, 6)


@query("p01_normalize_product_id", "footprints", r"""
SELECT product_id AS pid, replace(product_id, 'RC', 'RE') AS as_edr, regexp_replace(lower(product_id), 'rc$', 'r') || '.img' AS raw FROM footprints""")
def p01(t: Tables):
    raw = F.concat(F.regexp_replace(F.lower("product_id"), "rc$", "r"), F.lit(".img"))
    return t.footprints.select(ids.normalize_product_id(raw).alias("pid"), ids.normalize_product_id(col("product_id"), "E").alias("as_edr"), raw.alias("raw"))


@query("p02_is_valid_product_id", "footprints", r"SELECT product_id, regexp_matches(substr(product_id, CAST(orbit % 3 + 1 AS INT)), '^M\d{7,10}[A-Z]{1,2}[CE]$') AS valid FROM footprints")
def p02(t: Tables):
    return t.footprints.select("product_id", ids.is_valid_product_id(col("product_id").substr((col("orbit") % 3 + 1).cast("int"), F.lit(99))).alias("valid"))


@query("p03_product_sort_key", "footprints", "SELECT product_id, 1000000000 + orderkey AS clock, 'RC' AS rest FROM footprints UNION ALL SELECT 'x' || product_id, -1, 'x' || product_id FROM footprints")
def p03(t: Tables):
    both = t.footprints.select("product_id").unionByName(t.footprints.select(F.concat(F.lit("x"), "product_id").alias("product_id")))
    return both.withColumn("k", ids.product_sort_key(col("product_id"))).select("product_id", "k.clock", "k.rest")


@query("p04_filter_footprints", "footprints", """
SELECT product_id, resolution, coalesce(incidence, 45.0) AS incidence FROM footprints
WHERE (resolution IS NULL OR resolution <= 1.5) AND (incidence IS NULL OR incidence BETWEEN 30 AND 60)""")
def p04(t: Tables):
    from ..operators.gates import filter_footprints

    return filter_footprints(t.footprints).select("product_id", "resolution", "incidence")


@query("p05_pit_gate", "scored", """
SELECT doc_id, CASE WHEN s / 300 > 10 THEN 'strain' WHEN delta_h * 4 > 2.2 THEN 'aspect' WHEN doc_id % 200 > 120 THEN 'distance' WHEN doc_id % 37 < 10 THEN 'contrast' ELSE 'valid' END AS gate FROM scored""")
def p05(t: Tables):
    return t.scored.select("doc_id", ids.pit_gate(col("s") / 300, col("delta_h") * 4, col("doc_id") % 200, col("doc_id") % 37).alias("gate"))


@query("p10_window_covers", "footprints", """
WITH n AS (SELECT product_id, ts, 'kernel_' || (1992 + orderkey % 7) || lpad(CAST(orderkey % 300 + 1 AS VARCHAR), 3, '0') || '_' || (1993 + orderkey % 7) || '100.bc' AS name,
  make_date(1992 + orderkey % 7, 1, 1) + CAST(orderkey % 300 AS INT) AS a, make_date(1993 + orderkey % 7, 1, 1) + 99 AS b FROM footprints)
SELECT product_id, name, ts >= a AND ts <= b AS covered FROM n""")
def p10(t: Tables):
    k = col("orderkey")
    name = F.concat(F.lit("kernel_"), (k % 7 + 1992).cast("string"), F.lpad((k % 300 + 1).cast("string"), 3, "0"), F.lit("_"), (k % 7 + 1993).cast("string"), F.lit("100.bc"))
    return t.footprints.select("product_id", name.alias("name"), ids.window_covers(name, col("ts")).alias("covered"))


@query("p11_dem_tile_name", "hits", """
SELECT lat, lon, 'SLDEM2015_512_' || CASE WHEN lat < -30 THEN '60S_30S' WHEN lat < 0 THEN '30S_00S' WHEN lat < 30 THEN '00N_30N' ELSE '30N_60N' END || '_' ||
  lpad(CAST(CAST(floor(lon / 45) AS INT) * 45 AS VARCHAR), 3, '0') || '_' || lpad(CAST(CAST(floor(lon / 45) AS INT) * 45 + 45 AS VARCHAR), 3, '0') AS tile FROM hits""")
def p11(t: Tables):
    return t.hits.select("lat", "lon", ids.dem_tile_name(col("lat"), col("lon")).alias("tile"))


@query("p12_classify_host", "catalog", """
SELECT id, CASE id % 4 WHEN 0 THEN 'Mare Skylight' WHEN 1 THEN 'Impact Melt Pit' WHEN 2 THEN 'Highland Feature' ELSE 'Pit Candidate' END AS kind FROM catalog""")
def p12(t: Tables):
    word = F.element_at(F.array(*map(F.lit, ["Marius_Hills", "Crookes", "Highland", "none"])), (col("id") % 4 + 1).cast("int"))
    return t.catalog.select("id", ids.classify_host(F.concat("name", F.lit("_"), word)).alias("kind"))


@query("p13_swap_archive_suffix", "footprints", "SELECT product_id, left(product_id, length(product_id) - 1) || 'E' AS swapped FROM footprints")
def p13(t: Tables):
    return t.footprints.select("product_id", ids.swap_archive_suffix(col("product_id")).alias("swapped"))


@query("p14_camera_side", "footprints", "SELECT product_id, 'R' AS side, CASE WHEN orderkey % 2 = 0 THEN 'L' END AS other FROM footprints")
def p14(t: Tables):
    other = F.when(col("orderkey") % 2 == 0, F.replace("product_id", F.lit("R"), F.lit("L"))).otherwise(F.concat(F.lit("X"), "product_id"))
    return t.footprints.select("product_id", ids.camera_side(col("product_id")).alias("side"), ids.camera_side(other).alias("other"))


@query("p15_archive_url", "footprints", "SELECT product_id, 'https://archive.example/data/' || product_id || '.IMG' AS url, 'https://archive.example/LRO-L-LROC-2-EDR-V1.0/' || product_id || '.IMG' AS whole FROM footprints")
def p15(t: Tables):
    spec = F.concat(F.lit("LRO-L-LROC-2-EDR-V1.0/"), "product_id", F.lit(".IMG"))
    root = "/LRO-L-LROC-2-EDR-V1.0"
    return t.footprints.select("product_id", ids.archive_url("https://archive.example/data/", spec).alias("url"), ids.archive_url(f"https://archive.example{root}/LROLRC_0001", spec, root).alias("whole"))


@query("p16_clean_float", "catalog", "SELECT id, round(coalesce(depth_m / 7, -1), 6) AS depth FROM catalog")
def p16(t: Tables):
    return t.catalog.select("id", ids.clean_float(F.when(col("depth_m").isNull(), F.lit(float("nan"))).otherwise(col("depth_m") / 7), -1.0).alias("depth"))


@query("p18_wrap_lon", "hits", "SELECT lon, round(CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END, 6) AS pm180, round(lon, 6) AS wrapped FROM hits")
def p18(t: Tables):
    return t.hits.select("lon", r6(geo.wrap_lon(col("lon"), "pm180")).alias("pm180"), r6(geo.wrap_lon(col("lon") - 720)).alias("wrapped"))


@query("m01_haversine", "hits", """
SELECT lat, lon, round(2 * 1737400.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2)))), 3) AS m FROM hits""")
def m01(t: Tables):
    return t.hits.select("lat", "lon", F.round(geo.haversine_m(F.lit(10.0), F.lit(20.0), col("lat"), col("lon")), 3).alias("m"))


@query("m02_flat_distance", "hits", """
WITH d AS (SELECT lat, lon, radians(CASE WHEN lon - 20 > 180 THEN lon - 380 ELSE lon - 20 END) * cos(radians((lat + 10) / 2)) AS dx, radians(lat - 10) AS dy FROM hits)
SELECT lat, lon, round(1737400.0 * sqrt(dx * dx + dy * dy), 3) AS m FROM d""")
def m02(t: Tables):
    return t.hits.select("lat", "lon", F.round(geo.flat_distance_m(col("lat"), col("lon"), F.lit(10.0), F.lit(20.0)), 3).alias("m"))


@query("m03_bearing", "hits", """
WITH b AS (SELECT lat, lon, degrees(atan2(sin(radians(20 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon)))) AS d FROM hits)
SELECT lat, lon, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS bearing FROM b""")
def m03(t: Tables):
    return t.hits.select("lat", "lon", r6(geo.bearing_deg(col("lat"), col("lon"), F.lit(10.0), F.lit(20.0))).alias("bearing"))


_SIGNS = ", ".join(str(int(s)) for s in vectors.code_signs(64))
CODES_SQL = f"""codes AS (
  SELECT vec_id, bit_or(CASE WHEN y < 0 THEN 0::BIGINT WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << i::INT END) AS code FROM (
    SELECT vec_id, i, list_sum(list_transform(range(64), lambda j: CAST(embedding[j + 1] AS DOUBLE) * ([{_SIGNS}])[j + 1] * (1 - 2 * (bit_count(CAST(i & j AS BIGINT)) % 2)))) AS y
    FROM embeddings, range(64) r(i)) GROUP BY vec_id)"""


@query("m04_binary_code", "", f"WITH {CODES_SQL} SELECT vec_id, code FROM codes")
def m04(t: Tables):
    from ..operators.search import encode

    return encode(t.embeddings).select("vec_id", col("code")[0].alias("code"))


@query("m05_family_id", "anchors", "SELECT anchor_id, (strpos('0123456789abcdef', right(md5(name), 1)) - 1) % 8 AS family FROM anchors")
def m05(t: Tables):
    return t.anchors.select("anchor_id", ids.family_id(col("name")).alias("family"))


_CORNERS = {"ul_lon": "min_lon", "ul_lat": "max_lat", "ur_lon": "max_lon", "ur_lat": "max_lat", "ll_lon": "min_lon", "ll_lat": "min_lat", "lr_lon": "max_lon", "lr_lat": "min_lat"}


def _pixel(t: Tables):
    fp = t.footprints
    lons, lats = geo.corner_order({k: col(v) for k, v in _CORNERS.items()})
    return fp, lons, lats


@query("m06_pixel_to_lonlat", "footprints", "SELECT product_id, round(min_lon + 0.25 * (max_lon - min_lon), 6) AS lon, round(max_lat - 0.5 * (max_lat - min_lat), 6) AS lat FROM footprints")
def m06(t: Tables):
    fp, lons, lats = _pixel(t)
    lon, lat = geo.pixel_to_lonlat(F.lit(250), F.lit(1000), F.lit(1001), F.lit(2001), lons, lats)
    return fp.select("product_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("i08_invert_projection", "footprints", "SELECT product_id, 300.0e0 AS x, 1500.0e0 AS y FROM footprints")
def i08(t: Tables):
    fp, lons, lats = _pixel(t)
    lon, lat = col("min_lon") + 0.3 * (col("max_lon") - col("min_lon")), col("max_lat") - 0.75 * (col("max_lat") - col("min_lat"))
    x, y = geo.lonlat_to_pixel(lon, lat, F.lit(1001), F.lit(2001), lons, lats)
    return fp.select("product_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("m07_ray_sphere", "hits", "SELECT votes, round(CASE WHEN votes * 40000 <= 1737400 THEN 3000000 - sqrt(1737400.0 * 1737400.0 - votes * 40000.0 * votes * 40000.0) END, 3) AS d FROM hits")
def m07(t: Tables):
    position = [F.lit(3_000_000.0), col("votes") * 40_000.0, F.lit(0.0)]
    return t.hits.select("votes", F.round(geo.ray_sphere(position, [F.lit(-1.0), F.lit(0.0), F.lit(0.0)]), 3).alias("d"))


@query("m08_hamming", "anchors", f"WITH {CODES_SQL} SELECT vec_id, bit_count(xor(code, (SELECT code FROM codes WHERE vec_id = 0))) AS d FROM codes")
def m08(t: Tables):
    from ..operators.search import encode, hamming_range

    codes = encode(t.embeddings).select(col("vec_id").alias("id"), col("code").alias("v"))
    first = codes.where("id = 0").select(col("id").alias("query"), "v", F.lit(64).alias("threshold"))
    return hamming_range(codes, first).select(col("id").alias("vec_id"), col("distance").alias("d"))


@query("m09_vector_norms", "", """
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS dot, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, 1.0e0 AS self_cosine, 0.0e0 AS self_distance FROM embeddings""")
def m09(t: Tables):
    e = col("embedding")
    return t.embeddings.select("vec_id", r6(vectors.dot(e, e)).alias("dot"), r6(vectors.l2_norm(e)).alias("norm"), r6(vectors.cosine(e, e)).alias("self_cosine"), r6(vectors.l2_distance(e, e)).alias("self_distance"))


@query("m10_rect_overlap", "footprints", """
SELECT product_id, round(greatest(least(max_lon, 5.5) - greatest(min_lon, 2.5), 0) * greatest(least(max_lat, 6.5) - greatest(min_lat, 1.5), 0), 6) AS shared,
       round((max_lon - min_lon) * (max_lat - min_lat), 6) AS area FROM footprints""")
def m10(t: Tables):
    box = [col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    point = lambda x, y: F.struct(col(x).alias("lon"), col(y).alias("lat"))
    ring = F.array(point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("max_lon", "max_lat"), point("min_lon", "max_lat"))
    return t.footprints.select("product_id", r6(geo.rect_overlap_area(box, [F.lit(x) for x in (2.5, 1.5, 5.5, 6.5)])).alias("shared"), r6(geo.polygon_area(ring)).alias("area"))


@query("m10_convex_clip", "footprints", """WITH b AS (SELECT product_id, greatest(least(max_lon, 5.5) - greatest(min_lon, 2.5), 0) AS w, greatest(least(max_lat, 6.5) - greatest(min_lat, 1.5), 0) AS h, max_lon - min_lon AS a, max_lat - min_lat AS b FROM footprints)
SELECT product_id, round(w * h, 6) AS shared, round(a * b / 2, 6) AS half, round(w * h, 6) AS turned FROM b""")
def m10_clip(t: Tables):
    """Boxes against a box, that runs one way and the other, and against a triangle that is half of each."""
    point = lambda x, y: F.struct((col(x) if isinstance(x, str) else F.lit(x)).alias("lon"), (col(y) if isinstance(y, str) else F.lit(y)).alias("lat"))
    box = F.array(point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("max_lon", "max_lat"), point("min_lon", "max_lat"))
    region = F.array(*[point(x, y) for x, y in ((2.5, 1.5), (5.5, 1.5), (5.5, 6.5), (2.5, 6.5))])
    half = F.array(point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("min_lon", "max_lat"))
    return t.footprints.select(
        "product_id", r6(geo.convex_clip_area(box, region)).alias("shared"), r6(geo.convex_clip_area(box, half)).alias("half"), r6(geo.convex_clip_area(F.reverse(box), F.reverse(region))).alias("turned"),
    )


@query("m12_metric_axes", "", "SELECT p_partkey AS id, greatest(p_size / 1.5e0 / 2, 0.5) AS a, greatest(CASE WHEN p_size % 3 = 0 THEN p_size ELSE p_size / 4.0e0 END / 1.5 / 2, 0.5) AS b FROM part")
def m12_axes(t: Tables):
    a, b = geo.metric_axes(col("p_size").cast("double"), F.when(col("p_size") % 3 != 0, col("p_size") / 4), F.lit(1.5))
    return t.part.select(col("p_partkey").alias("id"), a.alias("a"), b.alias("b"))


@query("m12_in_ellipse", "hits", """
WITH p AS (SELECT x_offset AS x, y_offset AS y, (x_offset - 2400) * sin(radians(30)) - (y_offset - 26000) * cos(radians(30)) AS a, (x_offset - 2400) * cos(radians(30)) + (y_offset - 26000) * sin(radians(30)) AS b FROM hits)
SELECT x, y, pow(a / 20000, 2) + pow(b / 9000, 2) <= 1 + 1e-12 AS inside FROM p""")
def m12(t: Tables):
    lit = [F.lit(float(x)) for x in (2400, 26000, 20000, 9000, 30)]
    return t.hits.select(col("x_offset").alias("x"), col("y_offset").alias("y"), geo.in_ellipse(col("x_offset"), col("y_offset"), *lit).alias("inside"))


@query("m13_stretch_u8", "", """
SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(least(greatest((CAST(x AS DOUBLE) + 1) / 2, 0), 1) * 255) AS INT)) AS px FROM embeddings""")
def m13(t: Tables):
    from ..functions.raster import stretch_u8

    return t.embeddings.select("vec_id", stretch_u8(col("embedding"), F.lit(-1.0), F.lit(1.0)).alias("px"))


@query("m14_offset_lonlat", "hits", "SELECT lat, lon, round(lon + 1000 / (pi() * 1737400.0 / 180 * cos(radians(lat))), 6) AS lon2, round(lat - 500 / (pi() * 1737400.0 / 180), 6) AS lat2 FROM hits")
def m14(t: Tables):
    lon, lat = geo.offset_lonlat(col("lon"), col("lat"), F.lit(1000.0), F.lit(-500.0))
    return t.hits.select("lat", "lon", r6(lon).alias("lon2"), r6(lat).alias("lat2"))


@query("m15_envelope_lonlat", "footprints", """WITH b AS (SELECT product_id, CASE WHEN orderkey % 5 = 0 THEN 0 ELSE min_lon END AS a, CASE WHEN orderkey % 5 < 2 THEN -90 ELSE min_lat END AS b, CASE WHEN orderkey % 5 = 0 THEN 0 ELSE max_lon END AS c,
  CASE WHEN orderkey % 5 = 0 THEN -75 WHEN orderkey % 5 = 1 THEN -90 ELSE max_lat END AS d FROM footprints)
SELECT product_id, round(a + 0.25 * (c - a), 6) AS lon, round(b + 0.5 * (d - b), 6) AS lat FROM b""")
def m15(t: Tables):
    """Of some footprints all bounds are null, of some the latitudes are NaN."""
    k, nan = col("orderkey") % 5, F.lit(float("nan"))
    bounds = tuple(F.when(k > 1, col(c)).when(k == 1, nan if "lat" in c else col(c)) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    lon, lat = geo.envelope_lonlat(F.lit(25.0), F.lit(50.0), F.lit(100.0), F.lit(100.0), bounds)
    return t.footprints.select("product_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("f03_coordinate_chain", "footprints", """SELECT product_id, CASE orderkey % 4 WHEN 0 THEN 7.5 WHEN 1 THEN round(min_lon + 0.25 * (max_lon - min_lon), 6) ELSE round(min_lon + 0.5 * (max_lon - min_lon), 6) END AS lon,
  CASE orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN round(max_lat - 0.5 * (max_lat - min_lat), 6) ELSE round(min_lat + 0.25 * (max_lat - min_lat), 6) END AS lat FROM footprints""")
def f03(t: Tables):
    """A quarter of the footprints has a pose, a quarter only corners; of the others one lacks, or is not a number or nowhere."""
    fp, lons, lats = _pixel(t)
    k = col("orderkey") % 4
    pose = F.when(k == 0, 7.5).when(k == 1, F.lit(float("nan"))), F.when(k <= 1, 0.0)
    corners = geo.pixel_to_lonlat(F.lit(250), F.lit(1000), F.lit(1001), F.lit(2001), lons, lats)
    corners = tuple(F.when(k <= 1, c).when(k == 3, F.lit(0.0)) for c in corners)
    bounds = tuple(col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    lon, lat = geo.first_place(pose, corners, geo.envelope_lonlat(F.lit(500), F.lit(500), F.lit(1000), F.lit(2000), bounds))
    return fp.select("product_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("m16_calibrate", "hits", "SELECT product_id, round((score * 0.5 + 3) / max(score * 0.5 + 3) OVER (PARTITION BY product_id), 6) AS v FROM hits")
def m16(t: Tables):
    from ..functions.raster import calibrate
    from ..operators.aggregates import global_minmax

    hits = t.hits.withColumn("c", calibrate(col("score"), 0.5, 3.0))
    return hits.join(global_minmax(hits, "product_id", "c"), "product_id").select("product_id", r6(col("c") / col("high")).alias("v"))


@query("m17_sphere_band_area", "hits", "SELECT lat, round(abs(sin(radians(lat + 5)) - sin(radians(lat))), 6) AS area FROM hits")
def m17(t: Tables):
    return t.hits.select("lat", r6(geo.sphere_band_area(col("lat"), col("lat") + 5)).alias("area"))


@query("m19_doy_to_date", "", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def m19(t: Tables):
    day = ids.doy_to_date(F.year("o_orderdate"), F.dayofyear("o_orderdate"))
    return t.orders.select("o_orderkey", day.alias("day"))


@query("m21_json_access", "", "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events")
def m21(t: Tables):
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(F.map_values(props), 1).alias("first_value"), F.coalesce(F.json_array_length(F.to_json(F.json_object_keys("props"))), F.lit(0)).cast("long").alias("n_keys"))
