"""Queries of latent-space, shape, source, streaming-twin and composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import aggregates, evaluation, gates, joins, latent, shapes, tiles
from ..session import scratch_path, stage
from ..sources import rasters
from ..sources import tables as sources
from ..streaming import scanlog
from . import scan
from .registry import Tables, query
from .scalar_queries import CODES_SQL, r6
from .table_queries import ANCHORS_SQL, COSINE_SQL, PHYSICS_SQL, PIXELS_SQL, anchors_of, codes_of, masks_of, rounds_sql, sphere_sql, vectors_of

col = F.col
GRAPH_SQL = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)), 6) AS c FROM u a, u b),
k AS (SELECT src, dst, greatest(1 - c, 0) AS d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM s) WHERE r <= 8),
o AS (SELECT src, dst, exp(-pow(d / (SELECT median(d) + 1e-6 FROM k), 2) / 2) AS w FROM k),
w AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM o UNION ALL SELECT dst, src, w FROM o) GROUP BY ALL), g AS (SELECT src, sum(w) AS degree FROM w GROUP BY src)"""


@query("a16_knn_graph", "", GRAPH_SQL + " SELECT w.src, w.dst, round(w, 5) AS w, round(CASE WHEN w.src = w.dst THEN 1 ELSE 0 END - w / sqrt(a.degree * b.degree), 5) AS l FROM w JOIN g a ON a.src = w.src JOIN g b ON b.src = w.dst")
def a16(t: Tables):
    return latent.knn_graph(vectors_of(t)[0], 8).select("src", "dst", F.round("w", 5).alias("w"), F.round("l", 5).alias("l"))


def _low(t: Tables):
    return t.embeddings.select(col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))


STRAIN_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS h, list_transform(list_slice(embedding, 1, 2), lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings),
d AS (SELECT v.vec_id, v.vec_id = q.vec_id AS same, list_distance(v.h, q.h) AS e, list_distance(v.l, q.l) AS b,
             least(greatest(1 - list_inner_product(v.h, q.h) / sqrt(list_inner_product(v.h, v.h) * list_inner_product(q.h, q.h)), 0), 2) AS c FROM v, v q WHERE q.vec_id % 50 = 0),"""


@query("a14_jl_distortion", "", STRAIN_SQL + """ m AS (SELECT median(e) AS e0, median(b) AS b0 FROM d WHERE NOT same), r AS (SELECT (b / b0) / (e / e0) AS ratio FROM d, m WHERE NOT same AND e > 0)
SELECT round(avg(ratio), 6) AS ratio, round(greatest(0, 1 - avg(abs(ratio - 1))), 6) AS score FROM r""")
def a14(t: Tables):
    """All vectors against the query set."""
    vectors, queries = vectors_of(t)
    ratio, score = latent.jl_distortion(vectors, _low(t), queries=queries)
    return t.spark.createDataFrame([(round(ratio, 6), round(score, 6))], "ratio double, score double")


@query("a15_sammon_strain", "", STRAIN_SQL + """ m AS (SELECT median(c) / median(b) AS s FROM d), p AS (SELECT vec_id, CASE WHEN NOT same AND c > 1e-12 THEN pow(c - b * s, 2) / c ELSE 0 END AS strain, CASE WHEN NOT same AND c > 1e-12 THEN c ELSE 0 END AS reach FROM d, m)
SELECT vec_id AS id, round(sum(strain), 5) AS strain, round((SELECT sum(strain) / (sum(reach) + 1e-9) FROM p), 5) AS stress FROM p GROUP BY vec_id""")
def a15(t: Tables):
    vectors, queries = vectors_of(t)
    return latent.sammon_strain(vectors, _low(t), queries=queries).select("id", F.round("strain", 5).alias("strain"), F.round("stress", 5).alias("stress"))


@query("f05_reduce_2d")
def f05(t: Tables):
    return latent.reduce_2d(vectors_of(t)[0])


@query("f02_vector_table", "", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 10 = 0 THEN -1 ELSE 1 END) AS e FROM embeddings),
s AS (SELECT q.vec_id AS anchor_id, v.vec_id, round(list_inner_product(q.e, v.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(v.e, v.e)), 6) AS similarity FROM v, v q WHERE q.vec_id % 50 = 0)
SELECT anchor_id, vec_id, -similarity AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity, vec_id) AS rank FROM s) WHERE rank <= 5""")
def f02(t: Tables):
    vectors, queries = vectors_of(t)
    doubles = vectors.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    flipped = doubles.where("id % 10 = 0").withColumn("v", F.transform("v", lambda x: -x))
    found = latent.VectorTable(doubles, 64).upsert(flipped).search(queries, 5)
    return found.select(col("query").alias("anchor_id"), col("id").alias("vec_id"), "similarity")


@query("f04_train_gate")
def f04(t: Tables):
    rows = t.scored.select("doc_id", "s", "delta_h", col("toxic").cast("double").alias("y"))
    return latent.apply_gate(latent.train_gate(rows, ["s", "delta_h"]), rows).select("doc_id", "y", "decision")


@query("f04_cross_validation")
def f04_folds(t: Tables):
    """Gates on four sets of features, by 25 folds each; the tests hold them against models trained fold by fold."""
    rows = t.scored.withColumns({"id": col("doc_id"), "y": col("toxic").cast("int"), "root": F.sqrt("s"), "low": (col("delta_h") < 0.35).cast("double")})
    sets = {"retrieval": ["s"], "form": ["s", "root"], "physics": ["s", "delta_h"], "all": ["s", "delta_h", "root", "low"]}
    return evaluation.cross_validate(rows, sets)


@query("m20_shadow_shape")
def m20(t: Tables):
    bright = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 1).alias("px"))
    return shapes.shadow_shape(bright, "vec_id", "px", 8, 50.0, 8)


@query("m11_split_dateline", "hits", """WITH b AS (SELECT orderkey, line, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS w, lon FROM hits)
SELECT orderkey, line, round(w, 6) AS min_lon, round(least(w + 30, 180), 6) AS max_lon FROM b UNION ALL SELECT orderkey, line, -180.0, round(w - 330, 6) FROM b WHERE w + 30 > 180""")
def m11(t: Tables):
    boxes = t.hits.select("orderkey", "line", col("lon").alias("min_lon"), (col("lon") + 30).alias("max_lon"))
    return shapes.split_dateline(boxes).select("orderkey", "line", r6(col("min_lon")).alias("min_lon"), r6(col("max_lon")).alias("max_lon"))


_SITES_SQL = "s AS (SELECT p_partkey AS id, p_size / 4.0e0 AS major, p_size / 8.0e0 AS minor, radians(p_partkey % 180) AS a FROM part)"


def _sites(t: Tables):
    return t.part.select(col("p_partkey").alias("id"), (col("p_size") / 4).alias("major"), (col("p_size") / 8).alias("minor"), (col("p_partkey") % 180).alias("azimuth"), F.lit(16).alias("cx"), F.lit(16).alias("cy"))


@query("r08_ellipse_labels", "", f"""WITH {_SITES_SQL}, p AS (SELECT id, x, y FROM s, range(32) gx(x), range(32) gy(y) WHERE 2 * greatest(major, minor) <= 22.4
  AND pow(((x - 16) * sin(a) - (y - 16) * cos(a)) / greatest(major, 0.5), 2) + pow(((x - 16) * cos(a) + (y - 16) * sin(a)) / greatest(minor, 0.5), 2) <= 1 + 1e-12),
m AS (SELECT id, count(*) AS area, max(x) - min(x) AS width, max(y) - min(y) AS height FROM p GROUP BY id)
SELECT id, CASE WHEN 2 * greatest(major, minor) > 22.4 THEN 'skip' WHEN area IS NULL THEN 'skip' ELSE 'ok' END AS status, area, CASE WHEN 2 * greatest(major, minor) > 22.4 THEN 'pit-too-large-px=' || CAST(floor(2 * major + 0.5) AS INT) WHEN area IS NULL THEN 'empty-mask' ELSE '' END AS reason FROM s LEFT JOIN m USING (id)""")
def r08(t: Tables):
    return shapes.ellipse_labels(_sites(t), "id", 32).select("id", "status", "area", "reason")


@query("k07_build_annotation_table", "", f"""WITH {_SITES_SQL}, p AS (SELECT id, x, y FROM s, range(32) gx(x), range(32) gy(y) WHERE 2 * greatest(major, minor) <= 22.4
  AND pow(((x - 16) * sin(a) - (y - 16) * cos(a)) / greatest(major, 0.5), 2) + pow(((x - 16) * cos(a) + (y - 16) * sin(a)) / greatest(minor, 0.5), 2) <= 1 + 1e-12),
m AS (SELECT id, count(*) AS area, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) - min(x) + 1 AS INT) AS w, CAST(max(y) - min(y) + 1 AS INT) AS h FROM p GROUP BY id)
SELECT row_number() OVER (ORDER BY id) AS annotation_id, row_number() OVER (ORDER BY id) AS image_id, id, x0 AS bx, y0 AS by, w, h, CAST(area AS DOUBLE) AS area FROM m""")
def k07_tables(t: Tables):
    _, found = shapes.annotation_tables(shapes.ellipse_labels(_sites(t), "id", 32), "id", 32, [F.asc("id")])
    box = [col("bbox")[k].alias(c) for k, c in enumerate(("bx", "by", "w", "h"))]
    return found.select("annotation_id", "image_id", "id", *box, "area")


@query("k07_build_log", "", f"WITH {_SITES_SQL} SELECT CASE WHEN 2 * greatest(major, minor) > 22.4 THEN 'skip' ELSE 'ok' END AS status, count(*) AS count FROM s GROUP BY 1")
def k07(t: Tables):
    return aggregates.status_counts(shapes.ellipse_labels(_sites(t), "id", 32))


@query("p19_adaptive_mask_threshold", "", f"WITH {PIXELS_SQL} SELECT vec_id, round(greatest(0.25, quantile_cont(v, 0.9)), 6) AS threshold FROM px GROUP BY vec_id")
def p19(t: Tables):
    return t.embeddings.select("vec_id", r6(gates.adaptive_mask_threshold(col("embedding"))).alias("threshold"))


@query("j12_match_by_name", "", """WITH f AS (SELECT DISTINCT p_brand || '-x' || p_type AS stem FROM part), n AS (SELECT p_brand AS name, min(p_partkey) AS ord FROM part GROUP BY p_brand),
m AS (SELECT stem, arg_min(name, ord) AS name FROM f JOIN n ON contains(regexp_replace(lower(stem), '[^a-z0-9]', '', 'g'), regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) GROUP BY stem)
SELECT stem, name FROM f LEFT JOIN m USING (stem)""")
def j12(t: Tables):
    files = t.part.select(F.concat("p_brand", F.lit("-x"), "p_type").alias("stem")).distinct()
    sites = t.part.groupBy(col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return joins.match_by_name(files, sites)


@query("w02_running_rank", "hits", "SELECT product_id, score, row_number() OVER (ORDER BY product_id, score DESC) AS rank FROM hits")
def w02(t: Tables):
    return joins.running_rank(t.hits.select("product_id", "score"), "product_id", [F.desc("score")])


@query("j08_elevation_lookup", "hits", """WITH c AS (SELECT i, j, CASE WHEN (i + j) % 3 <> 0 THEN i * 10.0e0 + j ELSE CASE WHEN i % 2 = 0 THEN -1.0e0 END END AS h FROM range(36) a(i), range(-6, 6) b(j))
SELECT lat, lon, h AS height_m FROM hits JOIN c ON i = CAST(floor(lon / 10) AS BIGINT) AND j = CAST(floor(lat / 10) AS BIGINT)""")
def j08(t: Tables):
    grid = t.spark.range(36).select(col("id").alias("i"), F.explode(F.sequence(F.lit(-6), F.lit(5))).alias("j"))
    first = grid.select("i", "j", F.when((col("i") + col("j")) % 3 != 0, col("i") * 10.0 + col("j")).alias("value"), F.lit(1).alias("priority"))
    second = grid.select("i", "j", F.when(col("i") % 2 == 0, -1.0).alias("value"), F.lit(2).alias("priority"))
    return joins.elevation_lookup(t.hits.select("lat", "lon"), first.unionByName(second), 10.0).select("lat", "lon", "height_m")


@query("j08_dem_elevation", "hits", """WITH v AS (SELECT *, CAST(floor(lon / 10) AS INT) AS c, CAST(floor((60 - lat) / 10) AS INT) AS r FROM hits),
f AS (SELECT lat, lon, CASE WHEN lon <= 180 AND least(c, 17) % 4 <> 1 THEN (r * 100 + least(c, 17)) * 0.5e0 + 10 END AS one, CASE WHEN lon >= 90 AND least(c - 9, 26) % 3 <> 0 THEN r * 100 + least(c - 9, 26) + 0.0e0 END AS two FROM (SELECT lat, lon, least(greatest(r, 0), 11) AS r, c FROM v))
SELECT lat, lon, coalesce(one, two) AS first_m, coalesce(two, one) AS last_m FROM f""")
def j08_dem(t: Tables):
    """Two tiles of 10 degree cells that share 90 degrees: the first has nodata in every fourth column, the second misses every third."""
    tile = "tile_id string, priority int, west double, south double, east double, north double, n_rows int, n_cols int, scale double, offset double, nodata double"
    grid = t.spark.createDataFrame([("a", 1, 0.0, -60.0, 180.0, 60.0, 12, 18, 0.5, 10.0, -1.0), ("b", 2, 90.0, -60.0, 360.0, 60.0, 12, 27, 1.0, 0.0, None)], tile)
    cells = grid.select("tile_id", F.explode(F.sequence(F.lit(0), col("n_rows") - 1)).alias("row"), "n_cols").select("tile_id", "row", F.explode(F.sequence(F.lit(0), col("n_cols") - 1)).alias("col"))
    value = F.when((col("tile_id") == "a") & (col("col") % 4 == 1), -1).otherwise(col("row") * 100 + col("col"))
    cells = cells.withColumn("value", value).where("NOT (tile_id = 'b' AND col % 3 = 0)")
    first, last = (joins.dem_elevation(t.hits.select("lat", "lon").distinct(), grid, cells, last=k).withColumnRenamed("height_m", n) for k, n in ((False, "first_m"), (True, "last_m")))
    return t.hits.select("lat", "lon").join(first, ["lat", "lon"]).join(last, ["lat", "lon"]).select("lat", "lon", "first_m", "last_m")


@query("i09_terrain_intersect", "footprints", """WITH RECURSIVE g AS (SELECT CAST(floor(min_lon / 0.5e0) AS BIGINT) AS i, CAST(floor(min_lat / 0.5e0) AS BIGINT) AS j, min(orderkey) % 41 * 400.0e0 - 3000.0e0 AS height_m FROM footprints GROUP BY 1, 2),
c AS (SELECT product_id, radians(min_lon) AS a, radians(min_lat) AS b, radians(min_lon + 0.603e0) AS a2, radians(min_lat + 0.807e0) AS b2 FROM footprints),
q AS (SELECT product_id, 1837400e0 * cos(b) * cos(a) AS px, 1837400e0 * cos(b) * sin(a) AS py, 1837400e0 * sin(b) AS pz, 1737400e0 * cos(b2) * cos(a2) AS tx, 1737400e0 * cos(b2) * sin(a2) AS ty, 1737400e0 * sin(b2) AS tz FROM c),
d AS (SELECT product_id, px, py, pz, (tx - px) / n AS dx, (ty - py) / n AS dy, (tz - pz) / n AS dz FROM (SELECT *, sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py) + (tz - pz) * (tz - pz)) AS n FROM q)),
r AS (SELECT *, 0.0e0 AS h, 1e300 AS moved, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS lat, 0 AS turn FROM d UNION ALL
SELECT product_id, px, py, pz, dx, dy, dz, CASE WHEN moved < 1 THEN h ELSE height_m END, CASE WHEN moved < 1 THEN moved ELSE abs(height_m - h) END, flon, flat, turn + 1
FROM (SELECT *, degrees(atan2(y, x)) AS flon, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS flat FROM (SELECT *, px + t * dx AS x, py + t * dy AS y, pz + t * dz AS z
FROM (SELECT *, CASE WHEN b * b - c >= 0 THEN -b - sqrt(greatest(b * b - c, 0.0e0)) END AS t FROM (SELECT *, px * dx + py * dy + pz * dz AS b, px * px + py * py + pz * pz - pow(1737400e0 + h, 2) AS c FROM r WHERE turn < 6)))) f
LEFT JOIN g ON g.i = CAST(floor(flon / 0.5e0) AS BIGINT) AND g.j = CAST(floor(flat / 0.5e0) AS BIGINT))
SELECT product_id AS ray_id, round(lon, 5) AS lon, round(lat, 5) AS lat, h AS height_m FROM r WHERE turn = 6""")
def i09(t: Tables):
    """Slanted rays from 100 km above each footprint's corner, on terrain that the footprints of each half degree give, with steep
    steps; rays that leave it find no height."""
    cell = lambda c: F.floor(col(c) / 0.5)
    heights = t.footprints.groupBy(cell("min_lon").alias("i"), cell("min_lat").alias("j")).agg((F.min("orderkey") % 41 * 400.0 - 3000.0).alias("height_m"))

    def place(r: float, lon, lat):
        a, b = F.radians(lon), F.radians(lat)
        return r * F.cos(b) * F.cos(a), r * F.cos(b) * F.sin(a), r * F.sin(b)

    start, aim = place(1_837_400.0, col("min_lon"), col("min_lat")), place(1_737_400.0, col("min_lon") + 0.603, col("min_lat") + 0.807)
    rays = t.footprints.select(col("product_id").alias("ray_id"), *[x.alias(f"p{n}") for n, x in zip("xyz", start)], *[(y - x).alias(n) for n, x, y in zip("abc", start, aim)])
    length = F.sqrt(col("a") * col("a") + col("b") * col("b") + col("c") * col("c"))
    rays = rays.select("ray_id", "px", "py", "pz", *[(col(n) / length).alias(f"d{m}") for n, m in zip("abc", "xyz")])
    return joins.terrain_intersect(rays, heights, 0.5).select("ray_id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "height_m")


# --- sources and sinks


@query("s03_read_footprints", "footprints", "SELECT product_id, round(min_lon, 6) AS ul_lon, round(max_lat, 6) AS ul_lat, round((min_lon + max_lon) / 2, 6) AS center_lon, resolution, orbit FROM footprints")
def s03(t: Tables):
    path = scratch_path(t.spark, "features")
    point = lambda x, y: F.array(col(x), col(y))
    ring = F.array(point("min_lon", "max_lat"), point("max_lon", "max_lat"), point("max_lon", "min_lat"), point("min_lon", "min_lat"))
    attributes = F.struct(col("resolution").alias("Resolution"), col("incidence").alias("Incidence"), col("orbit").alias("Orbit"))
    feature = F.struct(F.struct(F.lower("product_id").alias("label"), attributes.alias("attributes")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    parts = t.footprints.select(feature.alias("f"), F.floor(col("orderkey") / 2000).alias("part")).groupBy("part").agg(F.collect_list("f").alias("features"))  # a file of a bounded size each
    parts.select(F.to_json(F.struct("features")).alias("value"), "part").write.partitionBy("part").text(path)
    found = sources.read_footprints(t.spark, path)
    return found.select("product_id", r6(col("ul_lon")).alias("ul_lon"), r6(col("ul_lat")).alias("ul_lat"), r6(col("center_lon")).alias("center_lon"), "resolution", "orbit")


@query("s06_read_rasters", "", """WITH s AS (SELECT 'P' || CAST(vec_id // 50 AS VARCHAR) AS product_id, vec_id % 50 AS line, list_transform(embedding, lambda z: CAST(floor(CAST(z AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings),
g AS (SELECT * FROM range(0, 49, 16) a(x), range(0, 35, 16) b(y))
SELECT product_id, x AS x_offset, y AS y_offset, round(sum(list_sum(list_transform(list_slice(v, x + 1, x + 16), lambda z: z * 0.5e0 + 3))), 4) AS total FROM s, g WHERE line BETWEEN y AND y + 15 GROUP BY ALL HAVING count(*) = 16""")
def s06(t: Tables):
    """Frames of 50 lines, a vector each, written as raster files; then read by ranges of eight lines, and cut into tiles."""
    path = scratch_path(t.spark, "rasters")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    stripes = t.embeddings.select(F.concat(F.lit("P"), F.floor(col("vec_id") / 50).cast("string")).alias("product_id"), (col("vec_id") % 50).cast("int").alias("line"), whole.alias("values"))
    rasters.write_rasters(stripes, path, 0.5, 3.0)
    cut = tiles.cut_tiles(rasters.read_rasters(t.spark, path, range_bytes=8 * 128), 16, 16)
    return cut.select("product_id", "x_offset", "y_offset", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("s07_read_anchors", "anchors", "SELECT anchor_id, (strpos('0123456789abcdef', right(md5(name), 1)) - 1) % 8 AS family, 'Pit Candidate' AS category, CASE WHEN anchor_id % 100 = 0 THEN 1 ELSE 64 END AS dim FROM anchors")
def s07(t: Tables):
    """Half of the anchors are compiled too, with vectors of one number that tell them apart."""
    raw, compiled = scratch_path(t.spark, "anchors"), scratch_path(t.spark, "compiled")
    t.anchors.write.parquet(raw)
    t.anchors.where("anchor_id % 100 = 0").withColumn("embedding", F.slice("embedding", 1, 1)).write.parquet(compiled)
    return sources.read_anchors(t.spark, raw, compiled).select("anchor_id", "family", "category", F.size("embedding").alias("dim"))


@query("s08_read_volume_snapshot", "volumes", "SELECT volume_id, ord AS row_count, 'M' || first_key || 'RC' AS first_pid FROM volumes")
def s08(t: Tables):
    path = scratch_path(t.spark, "snapshot")
    pid = lambda c: F.concat(F.lit("M"), col(c).cast("string"), F.lit("RC"))
    t.volumes.select("volume_id", F.lit("x").alias("index_url"), F.lit(80).alias("record_bytes"), col("ord").cast("int").alias("row_count"), pid("first_key").alias("first_pid"), pid("last_key").alias("last_pid")).write.json(path)
    return sources.read_volume_snapshot(t.spark, path, lines=True).select("volume_id", col("row_count").cast("long"), "first_pid")


@query("s09_read_pit_products", "catalog", "SELECT name AS pit_id, 'M' || id || 'LC' AS product_id FROM catalog UNION ALL SELECT name, 'own' || id FROM catalog WHERE id % 2 = 0")
def s09(t: Tables):
    path = scratch_path(t.spark, "products")
    entry = lambda product, url: F.struct(product.cast("string").alias("product"), url.alias("url"))
    i = col("id").cast("string")
    first = entry(F.lit(None), F.concat(F.lit("https://archive.example/M"), i, F.lit("LC.IMG")))
    both = F.when(col("id") % 2 == 0, F.array(first, entry(F.concat(F.lit("own"), i), F.lit("u")))).otherwise(F.array(first))
    maps = t.catalog.select("name", both.alias("list"), F.floor(col("id") / 2000).alias("part")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("name", "list"))).alias("m"))
    maps.select(F.to_json("m").alias("value"), "part").write.partitionBy("part").text(path)
    return sources.read_pit_products(t.spark, path).select("pit_id", "product_id")


@query("k02_write_manifold", "tiles anchors", f"""WITH {CODES_SQL}, a AS (SELECT code AS q FROM codes JOIN anchors ON anchor_id = vec_id) SELECT product_id, tile_id, min(bit_count(xor(code, q))) AS hamming_dist, round(any_value(CAST(embedding[1] AS DOUBLE)), 6) AS x_2d FROM codes, a, tiles, embeddings WHERE tile_id = codes.vec_id AND embeddings.vec_id = codes.vec_id GROUP BY ALL""")
def k02(t: Tables):
    from ..operators.search import nearest_query

    path = scratch_path(t.spark, "manifold")
    near = nearest_query(codes_of(t), anchors_of(t)).select(col("id").alias("tile_id"), col("distance").alias("hamming_dist"))
    flat = _low(t).select(col("id").alias("tile_id"), r6(col("v")[0]).alias("x_2d"), r6(col("v")[1]).alias("y_2d"))
    sources.write_manifold(t.tiles, near, flat, path)
    return t.spark.read.parquet(path).select("product_id", "tile_id", "hamming_dist", "x_2d")


@query("k05_write_geojson_features", "hits", """SELECT row_number() OVER (ORDER BY orderkey, line, partkey, supp, score, votes) AS det_id, round(score, 4) AS score, 12.0e0 AS area, round(lon + 2, 3) AS centroid_x, round(lat + 1.5, 3) AS centroid_y, 5 AS points FROM hits""")
def k05(t: Tables):
    """Two boxes a detection, of areas 2 and 12, and one that is no ring. All is read back from the file."""
    path = scratch_path(t.spark, "geojson")
    point = lambda x, y: F.struct((col("lon") + x).alias("lon"), (col("lat") + y).alias("lat"))
    box = lambda w, h: F.array(point(0, 0), point(w, 0), point(w, h), point(0, h))
    places = joins.ranked(t.hits, [col(c).asc() for c in ("orderkey", "line", "partkey", "supp", "score", "votes")], "det_id")
    dets = places.select("det_id", "class", "score", F.array(box(2, 1), box(4, 3), F.array(point(0, 0))).alias("rings"))
    sources.write_geojson_features(dets, path)
    back = t.spark.read.schema("properties struct<det_id:bigint,score:double,area:double>, geometry struct<coordinates:array<array<array<double>>>>").json(path)
    ring = col("geometry.coordinates")[0]
    corners = F.slice(ring, 1, F.size(ring) - 1)  # a box: its centroid is the mean of its corners
    mean = lambda k: F.round(F.aggregate(corners, F.lit(0.0), lambda s, p: s + p[k]) / F.size(corners), 3)
    return back.select("properties.det_id", "properties.score", "properties.area", mean(0).alias("centroid_x"), mean(1).alias("centroid_y"), F.size(ring).cast("long").alias("points"))


@query("k06_write_splits", "hits", """WITH r AS (SELECT supp, row_number() OVER (PARTITION BY supp ORDER BY score, orderkey, partkey, line) - 1 AS r, count(*) OVER (PARTITION BY supp) AS n FROM hits)
SELECT supp, CASE WHEN r < n - floor(n * 0.1) - floor(n * 0.2) THEN 'train' WHEN r < n - floor(n * 0.2) THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def k06(t: Tables):
    path = scratch_path(t.spark, "splits")
    sources.write_splits(t.hits, path, "supp", ["score", "orderkey", "partkey", "line"], {"train": 0.7, "val": 0.1, "test": 0.2})
    return t.spark.read.parquet(path).groupBy("supp", "split").agg(F.count("*").alias("n"))


# --- batch twins of streams, and composed pipelines


def _log_lines(t: Tables):
    """A log for each user number modulo 200, its lines in order of event_id."""
    n = lambda k: (col("event_id") % k).cast("string")
    text = F.when(col("event_type") == "signup", F.lit("PARAMETER CHECK: min_inc: 30.0 max_inc: 60.0")).when(
        col("event_type") == "view", F.concat(F.lit("Selected "), n(9), F.lit(" images covering "), n(100), F.lit(".5% of ROI"))).when(
        col("event_type") == "click", F.concat(F.lit("NODE COMPLETE: lattice frame M"), col("user_id").cast("string"))).when(
        (col("event_type") == "purchase") & (col("event_id") % 7 == 0), F.concat(F.lit("Total Pipeline Execution Time  \u2502 "), n(500), F.lit(".5 s"))).otherwise("noise")
    stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] INFO "))
    return t.events.select((col("user_id") % 200).cast("string").alias("log"), col("event_id").alias("at"), F.concat(stamp, text).alias("value"))


LOG_SQL = """WITH e AS (SELECT CAST(user_id % 200 AS VARCHAR) AS log, date_trunc('second', ts) AS ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'selected' WHEN 'click' THEN 'node_complete' ELSE 'pipeline_time' END AS kind, event_id AS x
  FROM events WHERE event_type IN ('signup', 'view', 'click') OR (event_type = 'purchase' AND event_id % 7 = 0)),
r AS (SELECT *, count(*) FILTER (kind = 'start') OVER (PARTITION BY log ORDER BY x) AS run FROM e), p AS (SELECT *, (run - 1) % 10 AS band FROM r WHERE run > 0),
f AS (SELECT *, count(*) FILTER (kind = 'node_complete') OVER w AS so_far, last_value(CASE WHEN kind = 'selected' THEN x % 9 END IGNORE NULLS) OVER (PARTITION BY log, run ORDER BY x ROWS UNBOUNDED PRECEDING) AS planned FROM p WINDOW w AS (PARTITION BY log, run ORDER BY x)),
g AS (SELECT log, band, run, arg_max(x % 9, x) FILTER (kind = 'selected') AS planned, arg_max(x % 100 + 0.5, x) FILTER (kind = 'selected') AS coverage, count(*) FILTER (kind = 'node_complete') AS done, arg_max(x % 500 + 0.5, x) FILTER (kind = 'pipeline_time') AS seconds,
      CASE WHEN bool_or(kind = 'pipeline_time') OR bool_or(planned > 0 AND so_far >= planned) THEN 'done' ELSE 'running' END AS status, arg_min(ts, x) AS first_ts, arg_max(ts, x) AS last_ts FROM f GROUP BY log, band, run),
s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY log, band ORDER BY run DESC) = 1)"""


@query("x01_parse_scan_log", "", LOG_SQL + """ SELECT log, x AS place, ts, kind, CASE WHEN kind = 'selected' THEN CAST(x % 9 AS VARCHAR) WHEN kind = 'pipeline_time' THEN (x % 500) || '.5' END AS arg, CASE WHEN kind = 'selected' THEN x % 100 + 0.5e0 END AS share FROM e""")
def x01(t: Tables):
    arg = F.when(col("kind").isin("selected", "pipeline_time"), col("arg"))
    return scanlog.parse_scan_log(_log_lines(t)).select("log", col("at").alias("place"), col("ts").cast("timestamp_ntz").alias("ts"), "kind", arg.alias("arg"), "share")


def _states(t: Tables):
    return scanlog.band_states(scanlog.place_events(scanlog.parse_scan_log(_log_lines(t))))


@query("x02_band_state", "", LOG_SQL + " SELECT log, band, planned, CAST(coverage AS DOUBLE) AS coverage, done, CAST(seconds AS DOUBLE) AS seconds, status, first_ts, last_ts FROM s")
def x02(t: Tables):
    found = _states(t).withColumns({c: col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})
    return found.select("log", "band", "planned", "coverage", "done", "seconds", "status", "first_ts", "last_ts")


_BANDS_SQL = "(VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(scanlog.BANDS)) + ") v(band, min_lat, max_lat)"


@query("a12_band_progress", "", LOG_SQL + f""", one AS (SELECT band, sum(planned) AS planned, sum(done) AS done, avg(coverage) AS coverage, sum(seconds) AS seconds, max(status) AS status, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM s WHERE band % 3 <> 1 GROUP BY band),
b AS (SELECT v.*, abs(sin(radians(v.max_lat)) - sin(radians(v.min_lat))) AS area, planned, coalesce(done, 0) AS done, coverage, seconds, status, first_ts, last_ts, coalesce(planned > 0, false) AS known FROM {_BANDS_SQL} LEFT JOIN one USING (band)),
d AS (SELECT avg(planned / area) FILTER (known AND band NOT IN (0, 9)) AS density, coalesce(sum(coalesce(seconds, 0) / 4) FILTER (known AND status = 'done') / sum(planned) FILTER (known AND status = 'done'), 18) AS pace, list(band) FILTER (known) AS ks FROM b),
c AS (SELECT *, CASE WHEN known THEN planned WHEN band IN (0, 9) THEN 545 WHEN density IS NOT NULL THEN round_even(density * area / 25, 0) * 25 ELSE 8886 END AS images, epoch(last_ts) - epoch(first_ts) AS elapsed FROM b, d)
SELECT band, CAST(images AS BIGINT) AS images, CAST(done AS BIGINT) AS done, round(coalesce(coverage, 0), 6) AS coverage, CAST(coalesce(seconds, 0) AS DOUBLE) AS seconds, coalesce(status, 'pending') AS status,
CASE WHEN known THEN 'REAL' WHEN list_contains(ks, 9 - band) THEN 'HIGH' WHEN density IS NOT NULL THEN 'MED' ELSE 'LOW' END AS confidence,
round(CASE WHEN status = 'running' AND elapsed > 300 AND done > 10 THEN done / elapsed * 3600 END, 6) AS per_hour, round(CASE WHEN status = 'done' THEN 0 ELSE greatest(images - done, 0) END * pace, 4) AS estimate_s FROM c""")
def a12(t: Tables):
    """All logs' bands added up, as if one scan had run in many logs; every third band was not begun."""
    one = _states(t).where("band % 3 <> 1").groupBy("band").agg(
        F.sum("planned").alias("planned"), F.sum("done").alias("done"), F.avg("coverage").alias("coverage"), F.sum("seconds").alias("seconds"), F.max("status").alias("status"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )
    found = aggregates.band_progress(one, scanlog.BANDS)
    return found.select("band", "images", "done", r6(col("coverage")).alias("coverage"), "seconds", "status", "confidence", r6(col("per_hour")).alias("per_hour"), F.round("estimate_s", 4).alias("estimate_s"))


@query("x04_new_arrivals", "volumes", """SELECT volume_id, CASE WHEN ord % 3 = 0 THEN 1 WHEN ord % 3 = 1 THEN 2 ELSE 4 END AS sweep FROM volumes
UNION ALL SELECT volume_id, 5 FROM volumes WHERE ord % 6 = 1""")
def x04(t: Tables):
    """Five sweeps, 31 days apart: a third of the volumes is in all of them, a third comes with the second, half of which is away in
    the fourth, and a third comes with the fourth."""
    into, out = scratch_path(t.spark, "snapshots"), scratch_path(t.spark, "arrivals")
    rows = t.volumes.select("volume_id", "ord", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sweep"))
    rows = rows.where("sweep >= CASE ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AND NOT (sweep = 4 AND ord % 6 = 1)")
    rows = rows.withColumn("ts", F.timestamp_seconds(col("sweep") * 31 * 86_400))
    tell = scanlog.new_arrivals(lambda new, number: new.write.mode("overwrite").parquet(f"{out}/number={number}"), f"{out}-known", sweep="ts")
    for sweep in range(1, 6):  # the stream reads what one sweep has left, then the next
        rows.where(col("sweep") == sweep).write.mode("append").parquet(into)
        stream = t.spark.readStream.schema(rows.schema).parquet(into).writeStream.option("checkpointLocation", f"{out}-marks").trigger(availableNow=True)
        stream.foreachBatch(tell).start().awaitTermination()
    found = t.spark.read.schema("volume_id string, ts timestamp").parquet(out)
    return found.select("volume_id", (F.unix_timestamp("ts") / (31 * 86_400)).cast("int").alias("sweep"))


@query("x05_incremental_ingest", "tiles", "SELECT product_id, tile_id, CASE WHEN product_id < 'M100000002RC' THEN 1 ELSE 2 END AS written FROM tiles")
def x05(t: Tables):
    """Two deliveries; the second repeats the products of the first, which are skipped."""
    into, out = scratch_path(t.spark, "tiles"), scratch_path(t.spark, "index")
    rows = t.tiles.select("product_id", "tile_id")
    first, second = rows.where("product_id < 'M100000002RC'").withColumn("written", F.lit(1)), rows.withColumn("written", F.lit(2))
    for delivery in (first, second):
        delivery.write.mode("append").parquet(into)
        scanlog.incremental_ingest(t.spark.readStream.schema(second.schema).parquet(into), out, f"{out}-marks").awaitTermination()
    return t.spark.read.parquet(out).select("product_id", "tile_id", "written")


@query("x08_late_rows", "", """WITH b AS (SELECT event_id, ts, event_id % 2 AS batch FROM events), m AS (SELECT max(ts) AS newest FROM b WHERE batch = 0)
SELECT event_id, batch = 1 AND ts < newest - INTERVAL 600 SECONDS AS late FROM b, m""")
def x08(t: Tables):
    """Events in two batches: of the second, those that are too old for the first's latest time are rejected."""
    into, out = scratch_path(t.spark, "events"), scratch_path(t.spark, "split")
    rows = t.events.select("event_id", "ts")
    to = lambda late: lambda batch, number: batch.select("event_id", F.lit(late).alias("late")).write.mode("overwrite").parquet(f"{out}/late={str(late).lower()}/number={number}")
    for k in (0, 1):
        rows.where(col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(into)
        stream = t.spark.readStream.schema(rows.schema).parquet(into).writeStream.option("checkpointLocation", f"{out}-marks").trigger(availableNow=True)
        stream.foreachBatch(scanlog.split_late(to(False), to(True), f"{out}-times")).start().awaitTermination()
    return t.spark.read.schema("event_id long, late boolean").parquet(f"{out}/late=false/number=*", f"{out}/late=true/number=*")


@query("f07_refine", "tiles", f"""WITH RECURSIVE {COSINE_SQL[5:]}, m AS (SELECT vec_id, max(similarity) AS similarity FROM s GROUP BY vec_id),
n AS (SELECT row_number() OVER (ORDER BY similarity DESC, vec_id) AS id, vec_id, similarity, lat, lon FROM m JOIN tiles ON tile_id = vec_id WHERE similarity >= CASE WHEN (SELECT count(DISTINCT anchor_id) FROM s) < 10 THEN 0.05 WHEN (SELECT count(DISTINCT anchor_id) FROM s) < 20 THEN 0.1 WHEN (SELECT count(DISTINCT anchor_id) FROM s) < 50 THEN 0.75 ELSE 0.85 END),
{sphere_sql(150)}, {rounds_sql()} SELECT vec_id, similarity, row_number() OVER (ORDER BY id) AS rank FROM kept""")
def f07_refine(t: Tables):
    vectors, queries = vectors_of(t)
    places = t.tiles.select(col("tile_id").alias("id"), "lat", "lon")
    return scan.refine(vectors.withColumn("score", F.lit(1.0)).join(places, "id"), queries).select(col("id").alias("vec_id"), "similarity", "rank")


@query("f07_classify", "tiles catalog", f"""WITH {PHYSICS_SQL}, k AS (SELECT h.vec_id, lat, lon, CASE WHEN h.vec_id % 100 < 20 THEN 'score' WHEN coalesce(n.k, 0) < 20 THEN 'shadow' WHEN coalesce(m.k, 0) < 15 THEN 'edge' WHEN NOT (err < 45 AND ratio >= 0.1) THEN 'physics' WHEN depth < 0.1 THEN 'depth' WHEN err > 30 THEN 'alignment' WHEN h.vec_id % 10 < 2 THEN 'decision' ELSE 'valid' END AS reason
  FROM h LEFT JOIN (SELECT vec_id, count(*) AS k FROM sm GROUP BY vec_id) n USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) AS k FROM em GROUP BY vec_id) m USING (vec_id) JOIN tiles ON tile_id = h.vec_id),
d AS (SELECT vec_id, min(1737400.0 * sqrt(pow(radians(k.lat - c.latitude), 2) + pow(radians((k.lon - c.longitude + 540) % 360 - 180) * cos(radians((k.lat + c.latitude) / 2)), 2))) AS m FROM k JOIN catalog c ON abs(k.lat - c.latitude) < 2 GROUP BY vec_id)
SELECT vec_id, reason, CASE WHEN reason <> 'valid' THEN 'rejected' WHEN coalesce(m, 1e9) <= 30000 THEN 'ground_truth_pit_match' ELSE 'potential_new_pit_discovery' END AS class FROM k LEFT JOIN d USING (vec_id)""")
def f07_classify(t: Tables):
    tiles = t.tiles.select(col("tile_id").alias("id"), "lat", "lon")
    hits = tiles.withColumns({"score": (col("id") % 100) / 100, "votes": col("id") % 8, "azimuth": F.pmod(col("id").cast("double"), F.lit(360.0)), "incidence": F.lit(60.0)})
    masks = masks_of(t).withColumnRenamed("vec_id", "id")
    found = scan.classify(hits, masks, t.catalog, (col("id") % 10) / 10, 30_000.0, {"score": 0.2, "shadow_px": 20, "depth_m": 0.1})
    return found.select(col("id").alias("vec_id"), "reason", "class")


@query("f07_generate_candidates", "tiles anchors", f"WITH {ANCHORS_SQL} SELECT tile_id, product_id, bit_count(bit_or(1 << family)) AS votes, min(d) AS best FROM p JOIN tiles ON tile_id = vec_id WHERE d <= threshold GROUP BY ALL")
def f07_candidates(t: Tables):
    return scan.generate_candidates(vectors_of(t)[0], t.anchors, t.tiles).select("tile_id", "product_id", "votes", "best")


@query("f07_scan_roi")
def f07_scan_roi(t: Tables):
    """A region's cover by the products' boxes, then the scan of its tiles; the test composes the same by hand."""
    box = [f(c).alias(n) for f, c, n in ((F.min, "lon", "min_lon"), (F.min, "lat", "min_lat"), (F.max, "lon", "max_lon"), (F.max, "lat", "max_lat"))]
    footprints = t.tiles.groupBy("product_id").agg(*box).withColumns({"orbit": F.lit(1).cast("long"), "resolution": F.lit(None).cast("double"), "incidence": F.lit(None).cast("double")})
    low, west = t.tiles.agg(F.min("lat")).first()[0], 300.0
    return scan.scan_roi(footprints, (west + 0.004, low, west + 0.036, 10.0), vectors_of(t)[0], t.anchors, t.tiles, 0.01, 1e-7, base=40)


@query("i07_spectral_coords")
def i07(t: Tables):
    return latent.spectral_coords(stage(latent.knn_graph(vectors_of(t)[0], 8), "graph"))


@query("k08_latent_summary")
def k08(t: Tables):
    """Of each vector: place, nearest anchor and its name, whether it is one, strain and mean distortion against the query set,
    three principal and two spectral coordinates, degree in the neighbour graph, gate."""
    from ..operators.search import nearest_query

    vectors, queries = vectors_of(t)
    near = nearest_query(codes_of(t), anchors_of(t)).select("id", col("query").alias("anchor_id"), "distance")
    strain = latent.sammon_strain(vectors, _low(t), queries=queries).select("id", "strain")
    ratio = latent.jl_ratios(vectors, _low(t), queries=queries).select("id", F.when(col("pairs") > 0, col("ratio") / col("pairs")).otherwise(1.0).alias("ratio"))
    graph = stage(latent.knn_graph(vectors, 8), "graph")
    degree = graph.groupBy(col("src").alias("id")).agg(F.sum("w").alias("degree"))
    places = t.tiles.select(col("tile_id").alias("id"), "product_id", "lon", "lat")
    names = t.anchors.select("anchor_id", "name")
    marked = t.anchors.select(col("anchor_id").alias("id"), F.lit(True).alias("is_anchor"))
    near = near.join(names, "anchor_id").join(marked, "id", "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    parts = [places, latent.reduce_2d(vectors, ("x_3d", "y_3d", "z_3d")), strain, ratio, degree, latent.spectral_coords(graph)]
    for part in parts:
        near = near.join(part, "id", "left")
    return near.withColumn("gate", ids.pit_gate(col("strain"), F.lit(1.0), col("distance"), F.lit(99)))
