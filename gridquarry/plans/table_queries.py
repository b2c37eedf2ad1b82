"""Queries of operators over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, ids, raster
from ..operators import aggregates, coverage, delta, evaluation, gates, joins, nms, order, search, tiles
from ..session import scratch_path, stage
from ..sources import tables as sources
from .registry import Tables, query
from .scalar_queries import CODES_SQL, r6

col = F.col
ANCHORS_SQL = f"""{CODES_SQL},
a0 AS (SELECT anchor_id, code AS acode, (strpos('0123456789abcdef', right(md5(name), 1)) - 1) % 8 AS family FROM anchors JOIN codes ON anchor_id = vec_id),
fam AS (SELECT family, count(*) AS n FROM a0 GROUP BY family),
a AS (SELECT anchor_id, acode, family, least(63, greatest(16, 26 - greatest(1, 10 - n // 4))) AS threshold FROM a0 JOIN fam USING (family)),
p AS (SELECT anchor_id, family, threshold, vec_id, bit_count(xor(code, acode)) AS d FROM codes, a)"""


def codes_of(t: Tables):
    return search.encode(t.embeddings).select(col("vec_id").alias("id"), col("code").alias("v"))


def anchors_of(t: Tables, base: int = 26):
    """Anchors as queries: query, v, threshold, family."""
    coded = search.encode(t.anchors, "anchor_id").join(t.anchors.select("anchor_id", ids.family_id(col("name")).alias("family")), "anchor_id")
    found = search.family_thresholds(coded, base)
    return stage(found.select(col("anchor_id").alias("query"), col("code").alias("v"), "threshold", "family"), "anchors")


def vectors_of(t: Tables):
    return t.embeddings.select(col("vec_id").alias("id"), col("embedding").alias("v")), t.anchors.select(col("anchor_id").alias("query"), col("embedding").alias("v"))


_BY = ["score", "orderkey", "partkey", "line"]


def _priority():
    return [(-col("score")).alias("s"), col("orderkey"), col("partkey"), col("line")]


# --- search -------------------------------------------------------------------------------------------------------


@query("j04_hamming_knn", "anchors", f"WITH {ANCHORS_SQL} SELECT anchor_id, vec_id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= 20")
def j04(t: Tables):
    found = search.hamming_knn(codes_of(t), anchors_of(t), 20)
    return found.select(col("query").alias("anchor_id"), col("id").alias("vec_id"), col("distance").alias("d"), "rank")


COSINE_SQL = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT a.vec_id AS anchor_id, u.vec_id, round(list_inner_product(a.e, u.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(u.e, u.e)), 6) AS similarity FROM u, u a WHERE a.vec_id % 50 = 0)"""


@query("j05_cosine_knn", "", COSINE_SQL + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 20")
def j05(t: Tables):
    found = search.cosine_knn(*vectors_of(t), 20)
    return found.select(col("query").alias("anchor_id"), col("id").alias("vec_id"), "similarity", "rank")


@query("j06_hamming_range", "anchors", f"WITH {ANCHORS_SQL} SELECT anchor_id, vec_id, d FROM p WHERE d <= threshold")
def j06(t: Tables):
    return search.hamming_range(codes_of(t), anchors_of(t)).select(col("query").alias("anchor_id"), col("id").alias("vec_id"), col("distance").alias("d"))


@query("j14_nearest_anchor", "anchors", f"WITH {ANCHORS_SQL} SELECT vec_id, min(d) AS d, arg_min(anchor_id, CAST(d AS BIGINT) * 1000000000 + anchor_id) AS anchor_id FROM p GROUP BY vec_id")
def j14(t: Tables):
    return search.nearest_query(codes_of(t), anchors_of(t)).select(col("id").alias("vec_id"), col("distance").alias("d"), col("query").alias("anchor_id"))


@query("j15_distances_to_queries", "anchors", f"""WITH {CODES_SQL}, {COSINE_SQL[5:]}
SELECT s.anchor_id, s.vec_id, round(least(greatest(1 - similarity, 0), 2), 6) AS cosine_distance, bit_count(xor(c.code, q.code)) AS hamming FROM s JOIN codes c ON c.vec_id = s.vec_id JOIN codes q ON q.vec_id = s.anchor_id""")
def j15(t: Tables):
    vectors, queries = vectors_of(t)
    found = search.all_distances(vectors, queries)
    return found.select(col("query").alias("anchor_id"), col("id").alias("vec_id"), r6(col("cosine_distance")).alias("cosine_distance"), "hamming")


@query("j17_contrastive", "anchors", f"""WITH {ANCHORS_SQL}, g AS (SELECT vec_id, min(d) FILTER (anchor_id % 100 = 0) AS d_pos, min(d) FILTER (anchor_id % 100 <> 0) AS d_neg FROM p GROUP BY vec_id)
SELECT vec_id, d_pos, coalesce(d_neg, 64) AS d_neg, coalesce(d_neg, 64) - d_pos AS score FROM g""")
def j17(t: Tables):
    anchors = anchors_of(t)
    found = search.contrastive(codes_of(t), anchors.where("query % 100 = 0"), anchors.where("query % 100 <> 0"), 64)
    return found.select(col("id").alias("vec_id"), "d_pos", "d_neg", "score")


@query("a01_vote_aggregate", "anchors", f"""WITH {ANCHORS_SQL} SELECT vec_id, count(*) AS votes, min(d) AS best FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d, vec_id) AS rank FROM p) WHERE rank <= 50 GROUP BY vec_id""")
def a01(t: Tables):
    return search.vote_aggregate(search.hamming_knn(codes_of(t), anchors_of(t), 50)).select(col("id").alias("vec_id"), "votes", "best")


@query("a02_resonant_vote", "anchors", f"WITH {ANCHORS_SQL} SELECT vec_id, CAST(bit_or(1 << family) AS INT) AS mask, min(d) AS best, bit_count(bit_or(1 << family)) AS n_families FROM p WHERE d <= threshold GROUP BY vec_id")
def a02(t: Tables):
    return search.resonant_vote(codes_of(t), anchors_of(t)).withColumnRenamed("id", "vec_id")


@query("a03_family_thresholds", "anchors", f"WITH {ANCHORS_SQL} SELECT anchor_id, family, threshold FROM a")
def a03(t: Tables):
    return anchors_of(t).select(col("query").alias("anchor_id"), "family", "threshold")


@query("p09_similarity_gate", "anchors", COSINE_SQL + """, m AS (SELECT vec_id, max(similarity) AS similarity FROM s GROUP BY vec_id)
SELECT vec_id, similarity FROM m WHERE similarity >= (SELECT CASE WHEN count(*) < 10 THEN 0.05 WHEN count(*) < 20 THEN 0.1 WHEN count(*) < 50 THEN 0.75 ELSE 0.85 END FROM anchors) AND vec_id % 7 >= 3""")
def p09(t: Tables):
    vectors, queries = vectors_of(t)
    scored = search.max_similarity(vectors, queries).withColumn("score", col("id") % 7)
    return gates.similarity_gate(scored, queries, min_score=3).select(col("id").alias("vec_id"), "similarity")


@query("x03_delta_index", "anchors", f"""WITH {CODES_SQL}, live AS (SELECT vec_id AS id, code FROM codes WHERE vec_id % 10 >= 2 UNION ALL SELECT vec_id, xor(code, 7) FROM codes WHERE vec_id % 10 = 1)
SELECT anchor_id, id, bit_count(xor(live.code, codes.code)) AS d FROM live, codes JOIN anchors ON anchor_id = vec_id""")
def x03(t: Tables):
    main = codes_of(t)
    changed = main.where("id % 10 < 2").withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(False))
    last = changed.withColumn("seq", F.lit(2)).withColumn("deleted", col("id") % 10 == 0).withColumn("v", F.transform("v", lambda w: w.bitwiseXOR(F.lit(7).cast("long"))))
    live = search.merge_delta(main, changed.unionByName(last))
    found = search.hamming_range(live, anchors_of(t).withColumn("threshold", F.lit(64)))
    return found.select(col("query").alias("anchor_id"), "id", col("distance").alias("d"))


@query("x03_delta_knn", "anchors", f"""WITH {CODES_SQL}, live AS (SELECT vec_id AS id, code FROM codes WHERE vec_id % 10 >= 2 UNION ALL SELECT vec_id, xor(code, 7) FROM codes WHERE vec_id % 10 = 1)
SELECT anchor_id, id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d, id) AS rank FROM (SELECT anchor_id, id, bit_count(xor(live.code, codes.code)) AS d FROM live, codes JOIN anchors ON anchor_id = vec_id)) WHERE rank <= 10""")
def x03_knn(t: Tables):
    """A table of all codes whose buffer holds a fifth of them changed, then half of these deleted and half changed again."""
    main = codes_of(t)
    index = delta.DeltaIndex.create(main.where("id % 10 <> 1"), scratch_path(t.spark, "index"), 1 << 40)
    index.insert(main.where("id % 10 < 2"))
    index.delete(main.where("id % 10 = 0"))
    index.insert(main.where("id % 10 = 1").withColumn("v", F.transform("v", lambda w: w.bitwiseXOR(F.lit(7).cast("long")))))
    return index.search(anchors_of(t), 10).select(col("query").alias("anchor_id"), "id", col("distance").alias("d"), "rank")


@query("f08_top_hit_provenance", "tiles anchors", f"""WITH {ANCHORS_SQL}, m AS (SELECT vec_id, min(d) AS d, min(anchor_id) FILTER (d = md) AS anchor_id FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS md FROM p) GROUP BY vec_id)
SELECT product_id, tile_id, x_offset, y_offset, d, 'anchor' AS kind, CAST(anchor_id AS VARCHAR) AS label FROM m JOIN tiles ON tile_id = vec_id""")
def f08(t: Tables):
    near = search.nearest_query(codes_of(t), anchors_of(t)).select(col("id").alias("tile_id"), col("distance").alias("d"), col("query").alias("anchor_id"))
    found = near.join(t.tiles, "tile_id").join(t.anchors.select("anchor_id", F.split("name", "_").alias("parts")), "anchor_id")
    return found.select("product_id", "tile_id", "x_offset", "y_offset", "d", col("parts")[0].alias("kind"), col("parts")[1].alias("label"))


@query("j09_attach_metadata", "tiles anchors", f"WITH {ANCHORS_SQL} SELECT tile_id, product_id, lon, lat, CAST(bit_or(1 << family) AS INT) AS mask FROM p JOIN tiles ON tile_id = vec_id WHERE d <= threshold GROUP BY ALL")
def j09(t: Tables):
    hits = search.resonant_vote(codes_of(t), anchors_of(t)).select(col("id").alias("tile_id"), "mask").join(t.tiles.select("tile_id", "product_id"), "tile_id")
    return joins.attach_metadata(hits, t.tiles).select("tile_id", "product_id", "lon", "lat", "mask")


# --- places, ids and time -----------------------------------------------------------------------------------------


@query("j01_assign_volume", "footprints volumes", "SELECT f.product_id, (SELECT arg_min(volume_id, ord) FROM volumes v WHERE 1000000000 + f.orderkey BETWEEN first_key AND last_key) AS volume_id FROM footprints f")
def j01(t: Tables):
    return joins.assign_volume(t.footprints.select("product_id"), t.volumes)


@query("j02_resolve_products", "footprints", """
SELECT product_id, CASE WHEN orderkey % 3 = 0 THEN 'cache://' || product_id WHEN orderkey % 3 = 1 THEN 'https://archive.example/' || product_id || '.IMG' END AS url,
       CASE orderkey % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'index' ELSE 'unknown' END AS status FROM footprints""")
def j02(t: Tables):
    fp = t.footprints
    urls = fp.where("orderkey % 3 = 0").select("product_id", F.concat(F.lit("cache://"), "product_id").alias("url"))
    index = fp.where("orderkey % 3 = 1").select("product_id", F.concat("product_id", F.lit(".IMG")).alias("file_spec"))
    return joins.resolve_products(fp.select("product_id"), urls, index, "https://archive.example/")


_ROIS = "(VALUES (1, 0.5, 0.5, 2.0, 1.5), (2, 4.0, 4.0, 7.25, 6.0), (3, 9.0, 2.0, 9.9, 9.9)) r(roi_id, x0, y0, x1, y1)"


def rois_of(t: Tables):
    return t.spark.sql(f"SELECT roi_id, cast(x0 AS DOUBLE) min_lon, cast(y0 AS DOUBLE) min_lat, cast(x1 AS DOUBLE) max_lon, cast(y1 AS DOUBLE) max_lat FROM {_ROIS.replace('r(', 'AS r(')}")


@query("j03_spatial_join", "footprints", f"""SELECT product_id, roi_id, round((least(max_lon, x1) - greatest(min_lon, x0)) * (least(max_lat, y1) - greatest(min_lat, y0)), 6) AS area
FROM footprints, {_ROIS} WHERE least(max_lon, x1) > greatest(min_lon, x0) AND least(max_lat, y1) > greatest(min_lat, y0)""")
def j03(t: Tables):
    return joins.box_join(t.footprints, rois_of(t), "product_id", "roi_id", 0.5).withColumn("area", r6(col("area")))


@query("j03_ring_join", "footprints", """WITH t AS (SELECT product_id, max_lon - min_lon AS w, max_lat - min_lat AS h, min_lon, min_lat, max_lon, max_lat FROM footprints)
SELECT product_id, 1 AS roi_id, round(w * h / 2, 6) AS area FROM t""")
def j03_rings(t: Tables):
    """Triangles, each half of a footprint's box, against a region that holds them all and one far away."""
    point = lambda x, y: F.struct(col(x).alias("lon"), col(y).alias("lat"))
    triangles = t.footprints.select("product_id", F.array(point("min_lon", "min_lat"), point("max_lon", "min_lat"), point("min_lon", "max_lat")).alias("ring"))
    corner = lambda x, y: f"named_struct('lon', cast({x} AS DOUBLE), 'lat', cast({y} AS DOUBLE))"
    regions = t.spark.sql(" UNION ALL ".join(f"SELECT {k} AS roi_id, array({', '.join(corner(x, y) for x, y in ring)}) AS ring" for k, ring in ((1, ((-1, -1), (30, -1), (30, 30), (-1, 30))), (2, ((40, 40), (41, 40), (41, 41))))))
    return joins.ring_join(triangles, regions, "product_id", "roi_id", 2.0).withColumn("area", r6(col("area")))


NEAREST_SQL = """d AS (SELECT h.lat, h.lon, c.name, 1737400.0 * sqrt(pow(radians(h.lat - c.latitude), 2) + pow(radians((h.lon - c.longitude + 540) % 360 - 180) * cos(radians((h.lat + c.latitude) / 2)), 2)) AS m
  FROM (SELECT DISTINCT lat, lon FROM hits) h JOIN catalog c ON abs(h.lat - c.latitude) < 0.02),
b AS (SELECT lat, lon, arg_min(name, {(m, name)}) AS name, round(min(m), 3) AS distance_m FROM d WHERE m <= LIMIT_M GROUP BY lat, lon)""".replace("{(m, name)}", "ROW(m, name)")


@query("j07_nearest_catalog", "hits catalog", "WITH " + NEAREST_SQL.replace("LIMIT_M", "300") + """
SELECT h.product_id, h.x_offset, h.y_offset, h.lat, h.lon, b.name, b.distance_m, CASE WHEN b.name IS NULL THEN 'potential_new_pit_discovery' ELSE 'ground_truth_pit_match' END AS status FROM hits h LEFT JOIN b USING (lat, lon)""")
def j07(t: Tables):
    hits = t.hits.select("product_id", "x_offset", "y_offset", "lat", "lon")
    return joins.match_sites(hits, t.catalog, 300.0).withColumn("distance_m", F.round("distance_m", 3))


@query("j07_missed_sites", "hits catalog", "WITH " + NEAREST_SQL.replace("LIMIT_M", "300") + " SELECT id, name FROM catalog WHERE name NOT IN (SELECT name FROM b)")
def j07_missed(t: Tables):
    return joins.missed_sites(t.hits.select("lat", "lon"), t.catalog, 300.0).select("id", "name")


@query("a17_catalog_recall", "hits catalog", "WITH " + NEAREST_SQL.replace("LIMIT_M", "300") + " SELECT count(b.name) AS matched, count(*) AS n, count(b.name) / count(*) AS rate FROM hits h LEFT JOIN b USING (lat, lon)")
def a17(t: Tables):
    return joins.catalog_recall(t.hits.select("lat", "lon"), t.catalog, 300.0)


@query("p08_exclude_known_sites", "hits", "SELECT lat, lon, CASE WHEN abs(lat - 10) < 0.5 AND abs(lon - 20) < 0.5 THEN 'a' WHEN abs(lat + 30) < 1 AND abs(lon - 300) < 1 THEN 'b' END AS site FROM hits")
def p08(t: Tables):
    return gates.tag_known_sites(t.hits, [("a", 10.0, 20.0, 0.5), ("b", -30.0, 300.0, 1.0)]).select("lat", "lon", "site")


@query("j10_pit_product_pairs", "catalog", """SELECT id, CASE WHEN id % 3 = 0 THEN 'own' || id WHEN id % 3 = 1 THEN 'mapped' || id END AS product_id FROM catalog""")
def j10(t: Tables):
    own = t.catalog.select("id", F.when(col("id") % 3 == 0, F.array(F.concat(F.lit("own"), col("id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("reference_nac"))
    mapping = t.catalog.where("id % 3 <= 1").select("id", F.array(F.concat(F.lit("mapped"), col("id").cast("string")), F.lit("other")).alias("products"))
    return joins.pit_product_pairs(own, mapping, "id")


@query("j11_new_only", "volumes", "SELECT volume_id FROM volumes WHERE ord % 4 <> 0")
def j11(t: Tables):
    return joins.new_only(t.volumes, t.volumes.where("ord % 4 = 0"), "volume_id").select("volume_id")


@query("j13_covering_files", "footprints", """WITH f AS (SELECT DISTINCT 'ck_' || year(ts) || lpad(CAST(month(ts) * 28 - 20 AS VARCHAR), 3, '0') || '_' || year(ts) || lpad(CAST(month(ts) * 28 + 5 AS VARCHAR), 3, '0') || '.bc' AS name,
  make_date(year(ts), 1, 1) + CAST(month(ts) * 28 - 21 AS INT) AS a, make_date(year(ts), 1, 1) + CAST(month(ts) * 28 + 4 AS INT) AS b FROM footprints)
SELECT product_id, name FROM footprints JOIN f ON ts BETWEEN a AND b UNION ALL SELECT product_id, 'naif0012.tls' FROM footprints""")
def j13(t: Tables):
    ts = col("ts")
    day = lambda k: F.lpad((F.month(ts) * 28 + k).cast("string"), 3, "0")
    year = F.year(ts).cast("string")
    names = t.footprints.select(F.concat(F.lit("ck_"), year, day(-20), F.lit("_"), year, day(5), F.lit(".bc")).alias("name")).distinct()
    files = names.unionByName(t.spark.sql("SELECT 'naif0012.tls' AS name"))
    return joins.covering_files(t.footprints, files).select("product_id", "name")


@query("j13_newest_files", "footprints", "SELECT 'clock_' || orbit AS family, max('clock_' || orbit || '_v' || lpad(CAST(orderkey % 1000 AS VARCHAR), 4, '0') || '.tsc') AS name FROM footprints GROUP BY orbit")
def j13_newest(t: Tables):
    """Of each family of clock files the one of the largest version."""
    version = F.lpad((col("orderkey") % 1000).cast("string"), 4, "0")
    files = t.footprints.select(F.concat(F.lit("clock_"), col("orbit").cast("string"), F.lit("_v"), version, F.lit(".tsc")).alias("name"))
    return joins.newest(files, F.regexp_extract("name", "^(.*)_v", 1), F.regexp_extract("name", r"_v(\d+)", 1).cast("int"))


@query("j16_band_of", "hits", "SELECT lat, CASE WHEN lat <= -30 THEN 0 WHEN lat <= 0 THEN 1 WHEN lat <= 30 THEN 2 ELSE 3 END AS band FROM hits")
def j16(t: Tables):
    return t.hits.select("lat", joins.band_of(col("lat"), [-60.0, -30.0, 0.0, 30.0, 60.0]).alias("band"))


@query("j18_as_of", "", "SELECT e.event_id, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = (SELECT max(o2.o_orderdate) FROM orders o2 WHERE o2.o_custkey = e.user_id AND o2.o_orderdate <= e.ts)) AS orderkey FROM events e")
def j18(t: Tables):
    last = t.orders.groupBy(col("o_custkey").alias("user_id"), col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("orderkey"))
    return joins.as_of(t.events.select("event_id", "user_id", "ts"), last, "user_id", "ts", "orderkey").select("event_id", "orderkey")


@query("j18_exact_pose", "", "SELECT l_orderkey AS product, l_linenumber AS line, l_partkey AS sample, o_totalprice AS px FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 3")
def j18_exact(t: Tables):
    """Pixels (product, line, sample) with the pose of exactly their line; poses are there for the first three lines."""
    pixels = t.lineitem.select(col("l_orderkey").alias("product"), col("l_linenumber").alias("line"), col("l_partkey").alias("sample"))
    poses = t.orders.select(col("o_orderkey").alias("product"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("line"), col("o_totalprice").alias("px"))
    return joins.pixel_poses(pixels, poses, ["product", "line"])


@query("j19_grid_tasks", "footprints", """SELECT product_id AS roi_id, round(greatest(min_lon, i * 0.5), 6) AS x0, round(greatest(min_lat, j * 0.5), 6) AS y0, round(least(max_lon, (i + 1) * 0.5), 6) AS x1, round(least(max_lat, (j + 1) * 0.5), 6) AS y1
FROM footprints, range(30) a(i), range(30) b(j) WHERE least(max_lon, (i + 1) * 0.5) > greatest(min_lon, i * 0.5) AND least(max_lat, (j + 1) * 0.5) > greatest(min_lat, j * 0.5)""")
def j19(t: Tables):
    found = joins.grid_tasks(t.footprints.withColumnRenamed("product_id", "roi_id"), 0.5)
    return found.select("roi_id", *[r6(col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("a04_reject_area_outliers", "footprints", """WITH f AS (SELECT product_id, orbit, round((max_lon - min_lon) * (max_lat - min_lat), 6) AS area FROM footprints),
m AS (SELECT orbit, median(area) AS m, count(*) AS n FROM f GROUP BY orbit) SELECT product_id, orbit, area FROM f JOIN m USING (orbit) WHERE n < 3 OR m <= 0 OR area <= 1.5 * m""")
def a04(t: Tables):
    sized = t.footprints.select("product_id", "orbit", r6((col("max_lon") - col("min_lon")) * (col("max_lat") - col("min_lat"))).alias("area"))
    return aggregates.reject_area_outliers(sized, 1.5).select("product_id", "orbit", "area")


@query("a05_run_report", "trace", """WITH s AS (SELECT band, count(DISTINCT product_id) AS products, coalesce(sum(value) FILTER (metric = 'ingest_tiles'), 0) AS tiles, coalesce(sum(value) FILTER (metric = 'ingest_s'), 0) AS ingest_s,
  coalesce(sum(value) FILTER (metric = 'index_compile_s'), 0) AS compile_s, coalesce(sum(value) FILTER (metric = 'index_size_bytes'), 0) AS index_bytes FROM trace GROUP BY band)
SELECT band, products, round(tiles, 4) AS tiles, round(ingest_s, 4) AS ingest_s, round(compile_s, 4) AS compile_s, round(index_bytes, 4) AS index_bytes, round(CASE WHEN ingest_s > 0 THEN tiles / ingest_s ELSE 0 END, 6) AS tiles_per_s, round(ingest_s / products, 6) AS s_per_product FROM s""")
def a05(t: Tables):
    found = aggregates.run_report(t.trace, "band")
    return found.select("band", "products", *[F.round(c, 4).alias(c) for c in ("tiles", "ingest_s", "compile_s", "index_bytes")], r6(col("tiles_per_s")).alias("tiles_per_s"), r6(col("s_per_product")).alias("s_per_product"))


@query("a06_group_invariance_stats", "scored", "SELECT y, count(*) AS n, round(avg(delta_h), 6) AS mean, round(stddev_pop(delta_h), 6) AS std, round(100 * avg(CASE WHEN delta_h < 0.35 THEN 1 ELSE 0 END), 6) AS below_35, round(100 * avg(CASE WHEN delta_h < 0.2 THEN 1 ELSE 0 END), 6) AS below_20 FROM scored GROUP BY y")
def a06(t: Tables):
    found = aggregates.group_stats(t.scored, "y", "delta_h")
    return found.select("y", "n", *[r6(col(c)).alias(c) for c in ("mean", "std", "below_35", "below_20")])


@query("a07_precision_at_k", "scored", """WITH r AS (SELECT y, delta_h < 0.35 AS ok, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM scored), c AS (SELECT count(*) AS positives FROM scored WHERE y = 1),
k AS (SELECT k, count(*) FILTER (y = 1) / count(*) AS p, count(*) FILTER (y = 1) AS hits, count(*) FILTER (ok AND y = 1) AS gated, count(*) FILTER (ok) AS m FROM r, (VALUES (10), (50), (100)) v(k) WHERE rank <= k GROUP BY k),
g AS (SELECT *, CASE WHEN m > 0 THEN gated / m ELSE 0 END AS gp FROM k, c)
SELECT k, round(p, 6) AS precision, round(hits / positives, 6) AS recall, round(gp, 6) AS gated_precision, round(gated / positives, 6) AS gated_recall, round((gp - p) * 100, 4) AS boost FROM g""")
def a07(t: Tables):
    found = evaluation.precision_at_k(t.scored, [10, 50, 100], [F.desc("s"), F.asc("doc_id")], gate=col("delta_h") < 0.35)
    return found.select("k", *[r6(col(c)).alias(c) for c in ("precision", "recall", "gated_precision", "gated_recall")], F.round("boost", 4).alias("boost"))


@query("a08_class_metrics", "scored", """WITH c AS (SELECT doc_id % 3 AS p, CASE WHEN y = 1 THEN 1 ELSE toxic * 2 END AS t FROM scored),
s AS (SELECT k, sum(CASE WHEN p = k AND t = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p = k AND t <> k THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN p <> k AND t = k THEN 1 ELSE 0 END) AS fn FROM c, (VALUES (0), (1), (2)) v(k) GROUP BY k),
m AS (SELECT k, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END AS iou, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM s)
SELECT k AS class, round(iou, 6) AS iou, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r + 1e-8) ELSE 0 END, 6) AS f05, round(avg(iou) OVER (), 6) AS miou FROM m""")
def a08(t: Tables):
    rows = t.scored.select((col("doc_id") % 3).alias("p"), F.when(col("y") == 1, 1).otherwise(col("toxic") * 2).alias("t"))
    found = evaluation.class_metrics(rows, "p", "t", [0, 1, 2])
    return found.select("class", *[r6(col(c)).alias(c) for c in ("iou", "precision", "recall", "f05", "miou")])


@query("a09_best_per_class", "hits", """WITH c AS (SELECT product_id, score, class, CASE class WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS priority FROM hits WHERE score >= 10000)
SELECT product_id, arg_max(class, ROW(priority, score, class)) AS class, arg_max(score, ROW(priority, score, class)) AS score FROM c GROUP BY product_id""")
def a09(t: Tables):
    return aggregates.best_per_class(t.hits, "product_id", {"R": 2, "A": 1}, 10_000)


PIXELS_SQL = "px AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("a10_tile_stats", "", f"""WITH {PIXELS_SQL} SELECT vec_id, count(*) AS n, count(v) AS n_valid, avg(CASE WHEN v <> 0 THEN 1.0e0 ELSE 0 END) AS nonzero, round(min(v), 6) AS low, round(max(v), 6) AS high,
round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p98 FROM px GROUP BY vec_id""")
def a10(t: Tables):
    found = aggregates.tile_stats(t.embeddings, "vec_id", "embedding")
    return found.select("vec_id", "n", "n_valid", "nonzero", *[r6(col(c)).alias(c) for c in ("low", "high", "p2", "p98")])


@query("p06_filter_empty_tiles", "", f"WITH {PIXELS_SQL}, s AS (SELECT vec_id, avg(CASE WHEN v > 0 THEN v ELSE 0 END) AS m, avg(CASE WHEN v > 0 THEN 1.0e0 ELSE 0 END) AS nonzero FROM px GROUP BY vec_id) SELECT vec_id, nonzero FROM s WHERE nonzero >= 0.5")
def p06(t: Tables):
    bright = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float"))).alias("px"))
    return gates.filter_empty_tiles(aggregates.tile_stats(bright, "vec_id", "px")).select("vec_id", "nonzero")


MASK_SQL = f"""{PIXELS_SQL}, sm AS (SELECT vec_id, p % 8 AS x, p // 8 AS y FROM px WHERE v < -0.05), em AS (SELECT vec_id, p % 8 AS x, p // 8 AS y FROM px WHERE v > 0.05)"""


def masks_of(t: Tables):
    moments = lambda test: aggregates.array_moments(F.transform("embedding", lambda x: x.cast("double")), 8, test)
    return t.embeddings.select("vec_id", moments(lambda x: x < -0.05).alias("shadow"), moments(lambda x: x > 0.05).alias("edge"))


@query("a11_mask_moments", "", f"WITH {MASK_SQL} SELECT vec_id, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS width, max(y) - min(y) AS height FROM sm GROUP BY vec_id")
def a11(t: Tables):
    found = masks_of(t).select("vec_id", "shadow.*").where("area > 0")
    return found.withColumns({"cx": r6(col("cx")), "cy": r6(col("cy"))})


@query("a11_mask_moments_of_rows", "", f"WITH {MASK_SQL} SELECT vec_id, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, max(x) - min(x) AS width FROM em GROUP BY vec_id")
def a11_rows(t: Tables):
    px = tiles.pixels(t.embeddings, "vec_id", "embedding", 8).where("value > 0.05").drop("value")
    return aggregates.mask_moments(px, "vec_id").select("vec_id", "area", r6(col("cx")).alias("cx"), r6(col("cy")).alias("cy"), "width")


PHYSICS_SQL = f"""{MASK_SQL}, s AS (SELECT vec_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM sm GROUP BY vec_id), e AS (SELECT vec_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h FROM em GROUP BY vec_id),
b AS (SELECT coalesce(s.vec_id, e.vec_id) AS vec_id, coalesce(s.n, 0) >= 10 AND coalesce(e.n, 0) >= 10 AS ok, s.cx - e.cx AS dx, s.cy - e.cy AS dy, greatest(e.w, e.h) * 0.5 AS width FROM s FULL JOIN e ON s.vec_id = e.vec_id),
c AS (SELECT *, vec_id % 360.0e0 AS az, CASE WHEN ok THEN (degrees(atan2(dx, -dy)) + 360) % 360 ELSE 0 END AS sv FROM b),
f AS (SELECT *, CASE WHEN ok THEN (az + 180) % 360 ELSE az END AS solar FROM c),
g AS (SELECT *, CASE WHEN NOT ok THEN 180 WHEN abs(sv - solar) > 180 THEN 360 - abs(sv - solar) ELSE abs(sv - solar) END AS err, CASE WHEN ok THEN sqrt(dx * dx + dy * dy) * 0.5 / tan(radians(60)) ELSE 0 END AS depth FROM f),
h AS (SELECT *, CASE WHEN ok AND width > 0 THEN depth / width ELSE 0 END AS ratio FROM g)"""


def physics_of(t: Tables):
    return aggregates.physics_validate(masks_of(t).where("shadow.area > 0 OR edge.area > 0"), "vec_id", F.pmod(col("vec_id").cast("double"), F.lit(360.0)), F.lit(60.0))


@query("a21_physics_validate", "", f"""WITH {PHYSICS_SQL} SELECT vec_id, round(sv, 4) AS shadow_deg, round(solar, 4) AS solar_deg, round(err, 4) AS error_deg, round(depth, 6) AS depth_m, round(ratio, 6) AS ratio, err < 45 AND ratio >= 0.1 AS valid,
round(CASE WHEN err < 45 AND ratio >= 0.1 THEN least(1, (1 - err / 45) * 0.7 + ratio * 0.3) ELSE 0 END, 6) AS confidence FROM h""")
def a21(t: Tables):
    return physics_of(t).select("vec_id", *[F.round(c, 4).alias(c) for c in ("shadow_deg", "solar_deg", "error_deg")], r6(col("depth_m")).alias("depth_m"), r6(col("ratio")).alias("ratio"), "valid", r6(col("confidence")).alias("confidence"))


@query("p07_strict_refine_gate", "", f"""WITH {PHYSICS_SQL}, n AS (SELECT vec_id, count(*) AS k FROM sm GROUP BY vec_id), m AS (SELECT vec_id, count(*) AS k FROM em GROUP BY vec_id)
SELECT h.vec_id, CASE WHEN h.vec_id % 100 < 20 THEN 'score' WHEN coalesce(n.k, 0) < 25 THEN 'shadow' WHEN coalesce(m.k, 0) < 15 THEN 'edge' WHEN NOT (err < 45 AND ratio >= 0.1) THEN 'physics' WHEN depth < 0.1 THEN 'depth' WHEN err > 30 THEN 'alignment' WHEN h.vec_id % 10 < 2 THEN 'decision' ELSE 'valid' END AS reason
FROM h LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)""")
def p07(t: Tables):
    rows = physics_of(t)
    rows = rows.withColumns({"score": (col("vec_id") % 100) / 100, "decision": (col("vec_id") % 10) / 10})
    return rows.select("vec_id", gates.first_failure(gates.strict_gates(score=0.2, depth_m=0.1)).alias("reason"))


CURVE_SQL = """b AS (SELECT s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, count(*) AS m FROM scored GROUP BY s),
c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(m) OVER (ORDER BY s DESC) AS n, sum(p) OVER () AS a FROM b), d AS (SELECT s, tp, n, tp / n AS precision, tp / a AS recall FROM c)"""


@query("w06_precision_curve", "scored", f"WITH {CURVE_SQL} SELECT s, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, round(precision, 6) AS precision, round(recall, 6) AS recall FROM d")
def w06(t: Tables):
    return evaluation.pr_curve(t.scored).select("s", "tp", "n", r6(col("precision")).alias("precision"), r6(col("recall")).alias("recall"))


@query("a13_pr_auc", "scored", f"WITH {CURVE_SQL} SELECT round(sum((recall - pr) * (precision + pp) / 2), 6) AS pr_auc FROM (SELECT recall, precision, coalesce(lag(recall) OVER (ORDER BY s DESC), 0) AS pr, coalesce(lag(precision) OVER (ORDER BY s DESC), 1) AS pp FROM d)")
def a13(t: Tables):
    return evaluation.pr_auc(t.scored).select(r6(col("pr_auc")).alias("pr_auc"))


@query("a18_sample_per_group", "tiles", """WITH r AS (SELECT product_id, tile_id, md5(CAST(tile_id AS VARCHAR) || '/7') AS h, row_number() OVER (PARTITION BY product_id ORDER BY md5(CAST(tile_id AS VARCHAR) || '/7'), tile_id) AS r FROM tiles)
SELECT product_id, tile_id FROM r WHERE r <= 100 // 5 + 1 ORDER BY h, tile_id LIMIT 100""")
def a18(t: Tables):
    return aggregates.sample_per_group(t.tiles, "product_id", "tile_id", 100).select("product_id", "tile_id")


@query("a19_score_summary", "hits", "SELECT count(score) AS n, min(score) AS low, max(score) AS high, round(avg(score), 4) AS mean FROM hits")
def a19(t: Tables):
    return aggregates.score_summary(t.hits, "score").withColumn("mean", F.round("mean", 4))


@query("a20_global_minmax", "hits", "SELECT supp, CASE WHEN supp % 2 = 0 THEN 0.0 ELSE min(score) END AS low, CASE WHEN supp % 2 = 0 THEN 1.0 ELSE max(score) END AS high FROM hits GROUP BY supp")
def a20(t: Tables):
    known = t.supplier.where("s_suppkey % 2 = 0").select(col("s_suppkey").alias("supp"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return aggregates.global_minmax(t.hits, "supp", "score", known)


@query("a22_classifier_features", "hits", "SELECT orderkey, partkey, line, score AS f_score, CAST(votes AS DOUBLE) AS f_votes, CASE WHEN line > 1 THEN round(partkey % 50 / (line - 1.0), 6) ELSE 0 END AS f_area_ratio FROM hits")
def a22(t: Tables):
    rows = t.hits.withColumns({"shadow_px": col("partkey") % 50, "edge_px": col("line") - 1, "dx": F.lit(0.0), "dy": F.lit(0.0), "width": F.lit(1), "height": F.lit(1), "error_deg": F.lit(0.0), "depth_m": F.lit(0.0)})
    return gates.classifier_features(rows).select("orderkey", "partkey", "line", "f_score", "f_votes", r6(col("f_area_ratio")).alias("f_area_ratio"))


@query("a23_status_counts", "", "SELECT event_type AS status, count(*) AS count FROM events GROUP BY ALL")
def a23(t: Tables):
    return aggregates.status_counts(t.events.select(col("event_type").alias("status")))


# --- order, ranks and sets ----------------------------------------------------------------------------------------


@query("t01_global_top_k", "hits", "SELECT score, votes, orderkey, partkey, line FROM hits ORDER BY score DESC, orderkey, partkey, line LIMIT 100")
def t01(t: Tables):
    return order.top_k(t.hits, 100, _priority()).select("score", "votes", "orderkey", "partkey", "line")


@query("t02_top_k_per_query", "hits", "SELECT product_id, score, rank FROM (SELECT product_id, score, row_number() OVER (PARTITION BY product_id ORDER BY score DESC) AS rank FROM hits) WHERE rank <= 5")
def t02(t: Tables):
    return order.top_k_per_group(t.hits, "product_id", 5, _priority()).select("product_id", "score", "rank")


@query("w03_first_per_key", "hits", "SELECT supp, min(score) AS score FROM hits GROUP BY supp")
def w03(t: Tables):
    return order.first_per_key(t.hits.select("supp", "score"), ["supp"], [F.asc("score")])


@query("w05_zero_crossing", "", """WITH e AS (SELECT user_id, ts, value - 50 AS v, event_id FROM events), l AS (SELECT *, lag(v) OVER w AS pv, lag(epoch_us(ts)) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(pt / 1e6 + (epoch_us(ts) - pt) / 1e6 * pv / (pv - v), 3) AS crossed FROM l WHERE pv * v < 0""")
def w05(t: Tables):
    rows = t.events.select("user_id", "event_id", (F.unix_micros(col("ts").cast("timestamp")) / 1e6).alias("s"), (col("value") - 50).alias("v"))
    return order.zero_crossings(rows, "user_id", ["s", "event_id"], "s", "v").select("event_id", F.round("crossed", 3).alias("crossed"))


@query("w07_sequential_splits", "hits", """WITH r AS (SELECT supp, score, row_number() OVER (PARTITION BY supp ORDER BY score, orderkey, partkey, line) - 1 AS r, count(*) OVER (PARTITION BY supp) AS n FROM hits)
SELECT supp, score, CASE WHEN r < n - floor(n * 0.1) - floor(n * 0.2) THEN 'train' WHEN r < n - floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r""")
def w07(t: Tables):
    found = evaluation.sequential_splits(t.hits, "supp", ["score", "orderkey", "partkey", "line"], {"train": 0.7, "val": 0.1, "test": 0.2})
    return found.select("supp", "score", "split")


@query("w08_stratified_folds", "scored", """SELECT doc_id, y, r AS repeat, ntile(5) OVER (PARTITION BY y, r ORDER BY md5(CAST(doc_id AS VARCHAR) || '/' || CAST(r AS VARCHAR)), doc_id) AS fold FROM scored, range(5) v(r)""")
def w08(t: Tables):
    return evaluation.stratified_folds(t.scored, "y", "doc_id").select("doc_id", "y", "repeat", "fold")


@query("w09_time_since_start", "trace", "SELECT event_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', min(ts) OVER (PARTITION BY band))) AS seconds, max(ts) OVER (PARTITION BY band) AS last_ts FROM trace")
def w09(t: Tables):
    return order.since_start(t.trace, "band", "ts").select("event_id", col("seconds").cast("double").alias("seconds"), "last_ts")


@query("t03_multi_key_sort", "hits", "SELECT class, score, row_number() OVER (ORDER BY class DESC, score, orderkey, partkey, line) AS rank FROM hits")
def t03(t: Tables):
    by = [F.desc("class"), F.asc("score"), F.asc("orderkey"), F.asc("partkey"), F.asc("line")]
    return joins.ranked(t.hits.select("class", "score", "orderkey", "partkey", "line"), by).select("class", "score", "rank")


@query("ua_union_hits", "hits catalog", "SELECT lat, lon, 'hit' AS kind FROM hits UNION ALL SELECT latitude, longitude, 'site' FROM catalog")
def ua(t: Tables):
    sites = t.catalog.select(col("latitude").alias("lat"), col("longitude").alias("lon"), F.lit("site").alias("kind"))
    return t.hits.select("lat", "lon", F.lit("hit").alias("kind")).unionByName(sites)


@query("ud_distinct_positions", "hits", "SELECT DISTINCT lat, lon FROM hits")
def ud(t: Tables):
    return t.hits.select("lat", "lon").dropDuplicates()


@query("ue_volume_difference", "volumes", "SELECT volume_id FROM volumes WHERE ord % 5 <> 0")
def ue(t: Tables):
    return joins.delta_rows(t.volumes.select("volume_id"), t.volumes.where("ord % 5 = 0").select("volume_id"))


@query("ui_intersect_ids", "hits catalog", "SELECT DISTINCT partkey AS id FROM hits INTERSECT SELECT id FROM catalog")
def ui(t: Tables):
    return t.hits.select(col("partkey").alias("id")).intersect(t.catalog.select("id"))


# --- tiles and pixels ---------------------------------------------------------------------------------------------

FRAMES_SQL = "f AS (SELECT s_suppkey AS id, CAST(300 + s_suppkey % 9 * 100 AS INT) AS samples, CAST(400 + s_suppkey % 7 * 150 AS INT) AS lines FROM supplier)"


def frames_of(t: Tables):
    return t.supplier.select(col("s_suppkey").alias("id"), (col("s_suppkey") % 9 * 100 + 300).cast("int").alias("samples"), (col("s_suppkey") % 7 * 150 + 400).cast("int").alias("lines"))


@query("r01_tile_grid", "", f"WITH {FRAMES_SQL} SELECT id, i * 192 AS x_offset, j * 192 AS y_offset FROM f, range(20) a(i), range(20) b(j) WHERE i * 192 + 256 <= samples AND j * 192 + 256 <= lines")
def r01(t: Tables):
    return tiles.tile_grid(frames_of(t)).select("id", "x_offset", "y_offset")


@query("r02_tile_grid_clamped", "", f"WITH {FRAMES_SQL} SELECT DISTINCT id, least(i * 192, samples - 256) AS x_offset, least(j * 192, lines - 256) AS y_offset FROM f, range(20) a(i), range(20) b(j) WHERE (i - 1) * 192 < samples - 256 AND (j - 1) * 192 < lines - 256")
def r02(t: Tables):
    return tiles.tile_grid_clamped(frames_of(t)).select("id", "x_offset", "y_offset")


@query("r03_tile_grid_overlap", "", f"WITH {FRAMES_SQL} SELECT id, i * 128 AS x_offset, j * 128 AS y_offset FROM f, range(20) a(i), range(20) b(j) WHERE i * 128 + 256 <= samples AND j * 128 + 256 <= lines")
def r03(t: Tables):
    return tiles.tile_grid_overlap(frames_of(t)).select("id", "x_offset", "y_offset")


@query("r04_cut_tiles", "", """WITH s AS (SELECT vec_id // 50 AS frame, vec_id % 50 AS line, embedding AS v FROM embeddings), g AS (SELECT * FROM range(0, 57, 4) a(x), range(0, 43, 4) b(y))
SELECT CAST(frame AS BIGINT) AS product_id, x AS x_offset, y AS y_offset, round(sum(list_sum(list_transform(list_slice(v, x + 1, x + 8), lambda z: CAST(z AS DOUBLE)))), 5) AS total FROM s, g WHERE line BETWEEN y AND y + 7 GROUP BY ALL HAVING count(*) = 8""")
def r04(t: Tables):
    stripes = t.embeddings.select(F.floor(col("vec_id") / 50).alias("product_id"), (col("vec_id") % 50).cast("int").alias("line"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    cut = tiles.cut_tiles(stripes, 8, 4)
    return cut.select("product_id", "x_offset", "y_offset", F.round(F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("r06_pad_reflect", "", f"WITH {PIXELS_SQL} SELECT a.vec_id, i, round(v, 6) AS v FROM (SELECT vec_id, i, CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END AS p FROM embeddings, range(-5, 70) r(i)) a JOIN px ON px.vec_id = a.vec_id AND px.p = a.p")
def r06(t: Tables):
    rows = t.embeddings.withColumn("i", F.explode(F.sequence(F.lit(-5), F.lit(69))))
    return rows.select("vec_id", "i", r6(F.get("embedding", tiles.reflected(col("i"), 64).cast("int")).cast("double")).alias("v"))


@query("r06_crop_bounds", "hits", "SELECT x_offset, y_offset, x_offset - 128 AS x0, y_offset - 128 AS y0 FROM hits WHERE x_offset >= 128 AND y_offset >= 128 AND x_offset + 128 <= 5064 AND y_offset + 128 <= 52224")
def r06b(t: Tables):
    box = tiles.crop_bounds(col("x_offset"), col("y_offset"), 256, F.lit(5064), F.lit(52224))
    return t.hits.select("x_offset", "y_offset", box.alias("b")).where("b IS NOT NULL").select("x_offset", "y_offset", "b.x0", "b.y0")


@query("r07_weak_labels", "", f"WITH {PIXELS_SQL} SELECT vec_id, p % 8 AS x, p // 8 AS y, CASE WHEN sqrt(pow(p % 8 - 4, 2) + pow(p // 8 - 4, 2)) > 3 THEN 0 WHEN v + 0.5 < 0.4 THEN 1 WHEN v + 0.5 > 0.6 THEN 2 ELSE 0 END AS label FROM px")
def r07(t: Tables):
    px = tiles.pixels(t.embeddings, "vec_id", "embedding", 8)
    norm = col("value").cast("double") + 0.5
    return px.select("vec_id", "x", "y", raster.weak_label(norm, col("x"), col("y"), F.lit(4), F.lit(4), 3.0, 0.4, 0.6).alias("label"))


@query("r09_strict_classes", "", """WITH e AS (SELECT vec_id, exp((CAST(embedding[1] AS DOUBLE)) / 0.1) AS a, exp(CAST(embedding[2] AS DOUBLE) / 0.1) AS b, exp(CAST(embedding[3] AS DOUBLE) / 0.1) AS c FROM embeddings)
SELECT vec_id, round(a / (a + b + c), 6) AS p0, CASE WHEN b / (a + b + c) > 0.4 THEN 1 WHEN c / (a + b + c) > 0.5 THEN 2 ELSE 0 END AS class FROM e""")
def r09(t: Tables):
    probs = raster.softmax(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), 0.1)
    rows = t.embeddings.select("vec_id", probs.alias("p"))
    return rows.select("vec_id", r6(col("p")[0]).alias("p0"), raster.strict_classes(col("p"), 0.4).alias("class"))


@query("r10_normalize_minmax", "", f"WITH {PIXELS_SQL}, m AS (SELECT vec_id, min(v) AS a, max(v) AS b FROM px GROUP BY vec_id) SELECT vec_id, p, CAST(floor(least(greatest((v - a) / (b - a), 0), 1) * 255) AS INT) AS u8 FROM px JOIN m USING (vec_id)")
def r10(t: Tables):
    d = F.transform("embedding", lambda x: x.cast("double"))
    rows = t.embeddings.select("vec_id", raster.stretch_u8(d, F.array_min(d), F.array_max(d)).alias("px"))
    return rows.select("vec_id", F.posexplode("px").alias("p", "u8"))


@query("r10_normalize_by_product", "tiles", f"""WITH {PIXELS_SQL}, m AS (SELECT product_id, min(v) AS a, max(v) AS b FROM px JOIN tiles ON tile_id = vec_id GROUP BY product_id)
SELECT vec_id, p, CAST(floor(least(greatest((v - a) / (b - a), 0), 1) * 255) AS INT) AS u8 FROM px JOIN tiles ON tile_id = vec_id JOIN m USING (product_id)""")
def r10_product(t: Tables):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px")).join(t.tiles.select(col("tile_id").alias("vec_id"), "product_id"), "vec_id")
    return tiles.normalize(rows, "px", by="product_id").select("vec_id", F.posexplode("px").alias("p", "u8"))


@query("r10_normalize_percentile", "", f"WITH {PIXELS_SQL}, m AS (SELECT vec_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM px GROUP BY vec_id) SELECT vec_id, p, CAST(floor(least(greatest((v - a) / (b - a), 0), 1) * 255 + 1e-9) AS INT) AS u8 FROM px JOIN m USING (vec_id)")
def r10_percentile(t: Tables):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    return tiles.normalize(rows, "px", shares=(0.02, 0.98)).select("vec_id", F.posexplode("px").alias("p", "u8"))


@query("r05_crop_roi", "", """WITH f AS (SELECT vec_id // 50 AS frame, vec_id % 50 AS line, embedding AS e FROM embeddings), n AS (SELECT frame, count(*) AS lines FROM f GROUP BY frame),
q AS (SELECT vec_id, vec_id // 50 AS frame, vec_id * 7 % 90 - 12 AS x, vec_id * 3 % 80 - 15 AS y FROM embeddings), g AS (SELECT q.*, i, j, x - 4 + i AS c, y - 4 + j AS r, lines FROM q JOIN n USING (frame), range(8) a(i), range(8) b(j) WHERE x >= -8 AND x < 72 AND y >= -8 AND y < lines + 8)
SELECT vec_id, count(e) AS inside, round(sum(CAST(e[c + 1] AS DOUBLE)), 5) AS total FROM g LEFT JOIN f ON f.frame = g.frame AND f.line = g.r AND c BETWEEN 0 AND 63 GROUP BY vec_id""")
def r05(t: Tables):
    """Crops of 8 by 8 around places in frames of 50 lines, some over the edge and some too far outside."""
    lines = t.embeddings.select(F.floor(col("vec_id") / 50).alias("product_id"), (col("vec_id") % 50).cast("int").alias("line"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    frames = lines.groupBy("product_id").agg(F.count("*").cast("int").alias("lines"), F.lit(64).alias("samples"))
    at = t.embeddings.select("vec_id", F.floor(col("vec_id") / 50).alias("product_id"), (col("vec_id") * 7 % 90 - 12 + 0.25).alias("x"), (col("vec_id") * 3 % 80 - 15 + 0.75).alias("y"))
    found = tiles.crop_roi(at, frames, lines, "vec_id", 8, 8).where("pixels IS NOT NULL")
    fine = F.filter("pixels", lambda v: ~F.isnan(v))
    total = F.when(F.size(fine) > 0, F.round(F.aggregate(fine, F.lit(0.0), lambda a, v: a + v), 5))
    return found.select("vec_id", F.size(fine).cast("long").alias("inside"), total.alias("total"))


@query("f01_embed_tiles", "", f"WITH {PIXELS_SQL}, b AS (SELECT vec_id, p // 8 AS k, avg(v) AS m FROM px GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(m * m)) AS n FROM b GROUP BY vec_id) SELECT vec_id, k, round(m / n, 5) AS v FROM b JOIN n USING (vec_id)")
def f01(t: Tables):
    px = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px"))
    found = tiles.embed(px, lambda: tiles.block_mean_encoder(8), "vec_id", "px")
    return found.select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.round("v", 5))


@query("t04_dual_scale_pooling", "", """WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 9) DESC, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
q AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v, r <= greatest(1, floor(0.1 * n)) AS top FROM r), m AS (SELECT label, p, avg(v) FILTER (top) AS top_mean, avg(v) AS mean FROM q GROUP BY label, p),
n AS (SELECT label, sqrt(sum(top_mean * top_mean)) AS a, sqrt(sum(mean * mean)) AS b FROM m GROUP BY label)
SELECT label, p, round(mean / b / sqrt(2), 6) AS v FROM m JOIN n USING (label) UNION ALL SELECT label, p + 64, round(top_mean / a / sqrt(2), 6) FROM m JOIN n USING (label)""")
def t04(t: Tables):
    found = aggregates.dual_scale_pooling(t.embeddings, "label", "embedding", "vec_id")
    return found.select("label", F.posexplode("pooled").alias("p", "v")).withColumn("v", r6(col("v")))


# --- windows of time ----------------------------------------------------------------------------------------------


@query("x06_throughput_windows", "trace", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total, arg_max(product_id, ROW(ts, event_id)) AS last_product FROM trace GROUP BY 1")
def x06(t: Tables):
    return aggregates.throughput_windows(t.trace).select("start", "n", F.round("total", 4).alias("total"), "last_product")


@query("x07_session_gaps", "trace", """WITH l AS (SELECT band, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY band ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM trace), s AS (SELECT band, ts, sum(new) OVER (PARTITION BY band ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT band, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY band, s""")
def x07(t: Tables):
    return aggregates.session_gaps(t.trace, "band")


# --- suppression and cover ------------------------------------------------------------------------------------------
# In SQL: rows n with their place in order (id), edges e of neighbours (low, high), and rounds in which every row that waits for
# no better neighbour is kept (1) or, if one was kept, gone (2).


def rounds_sql(n: str = "n", e: str = "e", kept: str = "kept") -> str:
    r = f"{kept}_r"
    return f"""{r} AS (SELECT 0 AS i, id, 0 AS st FROM {n} UNION ALL
  SELECT {r}.i + 1, {r}.id, CASE WHEN {r}.st <> 0 THEN {r}.st WHEN l.kept THEN 2 WHEN l.waits THEN 0 ELSE 1 END
  FROM {r} LEFT JOIN (SELECT {e}.high, bool_or(q.st = 1) AS kept, bool_or(q.st = 0) AS waits FROM {e} JOIN {r} q ON q.id = {e}.low GROUP BY {e}.high) l ON l.high = {r}.id WHERE EXISTS (SELECT 1 FROM {r} o WHERE o.st = 0)),
{kept} AS (SELECT {n}.* FROM {n} JOIN {r} USING (id) WHERE st = 1 AND i = (SELECT max(i) FROM {r}))"""


ROUNDS_SQL = rounds_sql()
_HITS_SQL = "n AS (SELECT row_number() OVER (ORDER BY score DESC, orderkey, partkey, line) AS id, * FROM hits)"


def plane_sql(x: str, y: str, distance: float, near: str, group: str = "") -> str:
    """e: neighbours among rows n, by cells of the distance's size."""
    same = f"AND a.{group} = b.{group}" if group else ""
    cells = f"SELECT *, CAST(floor({x} / {distance}) AS BIGINT) AS ci, CAST(floor({y} / {distance}) AS BIGINT) AS cj FROM n"
    return f"""c AS ({cells}), e AS (SELECT a.id AS low, b.id AS high FROM c a JOIN (SELECT * REPLACE (ci + di AS ci, cj + dj AS cj) FROM c, range(-1, 2) s(di), range(-1, 2) t(dj)) b
  ON a.ci = b.ci AND a.cj = b.cj {same} WHERE a.id < b.id AND {near})"""


def sphere_sql(metres: float, n: str = "n", e: str = "e") -> str:
    """e: neighbours among rows n, by cubes around the sphere's surface."""
    axes = ["cos(radians(lat)) * cos(radians(lon))", "cos(radians(lat)) * sin(radians(lon))", "sin(radians(lat))"]
    cells = ", ".join(f"CAST(floor({a} * 1737400.0e0 / {metres}) AS BIGINT) AS c{k}" for k, a in enumerate(axes))
    return f"""{e}_c AS (SELECT *, {cells} FROM {n}),
{e} AS (SELECT a.id AS low, b.id AS high FROM {e}_c a JOIN (SELECT * REPLACE (c0 + d0 AS c0, c1 + d1 AS c1, c2 + d2 AS c2) FROM {e}_c, range(-1, 2) s(d0), range(-1, 2) t(d1), range(-1, 2) u(d2)) b ON a.c0 = b.c0 AND a.c1 = b.c1 AND a.c2 = b.c2 WHERE a.id < b.id
  AND 2 * 1737400.0e0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) < {metres})"""


SPHERE_SQL = sphere_sql(15_000)


@query("i01_nms_pixels", "hits", f"WITH RECURSIVE {_HITS_SQL}, {plane_sql('x_offset', 'y_offset', 512.0, 'sqrt(pow(a.x_offset - b.x_offset, 2) + pow(a.y_offset - b.y_offset, 2)) < 512', 'product_id')}, {ROUNDS_SQL} SELECT product_id, x_offset, y_offset, score FROM kept")
def i01(t: Tables):
    kept = nms.nms_plane(t.hits.select("product_id", "x_offset", "y_offset", *_BY), "x_offset", "y_offset", _priority(), 512.0, group=["product_id"])
    return kept.select("product_id", "x_offset", "y_offset", "score")


@query("i02_nms_sphere", "hits", f"WITH RECURSIVE {_HITS_SQL}, {SPHERE_SQL}, {ROUNDS_SQL} SELECT product_id, lat, lon, score FROM kept")
def i02(t: Tables):
    return nms.nms_sphere(t.hits.select("product_id", "lat", "lon", *_BY), "lat", "lon", _priority(), 15_000.0).select("product_id", "lat", "lon", "score")


@query("i03_dedupe_l1", "hits", f"WITH RECURSIVE {_HITS_SQL}, {plane_sql('x_offset', 'y_offset', 300.0, 'abs(a.x_offset - b.x_offset) + abs(a.y_offset - b.y_offset) < 300', 'product_id')}, {ROUNDS_SQL} SELECT product_id, x_offset, y_offset, score FROM kept")
def i03(t: Tables):
    return nms.nms_plane(t.hits.select("product_id", "x_offset", "y_offset", *_BY), "x_offset", "y_offset", _priority(), 300.0, "l1", ["product_id"]).select("product_id", "x_offset", "y_offset", "score")


@query("i04_dedupe_box", "hits", f"WITH RECURSIVE {_HITS_SQL}, {plane_sql('lon', 'lat', 0.2, 'abs(a.lon - b.lon) < 0.2 AND abs(a.lat - b.lat) < 0.2')}, {ROUNDS_SQL} SELECT lon, lat, score FROM kept")
def i04(t: Tables):
    return nms.nms_plane(t.hits.select("lon", "lat", *_BY), "lon", "lat", _priority(), 0.2, "chebyshev").select("lon", "lat", "score")


@query("i05_nms_iou", "footprints", f"""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY coalesce(resolution, 9), product_id) AS id, *, (max_lon - min_lon) * (max_lat - min_lat) AS area FROM footprints),
o AS (SELECT a.id AS low, b.id AS high, a.area + b.area AS areas, greatest(least(a.max_lon, b.max_lon) - greatest(a.min_lon, b.min_lon), 0) * greatest(least(a.max_lat, b.max_lat) - greatest(a.min_lat, b.min_lat), 0) AS shared FROM n a JOIN n b ON a.orbit = b.orbit AND a.id < b.id),
e AS (SELECT low, high FROM o WHERE shared > 0.3 * (areas - shared)), {ROUNDS_SQL} SELECT product_id, orbit FROM kept""")
def i05(t: Tables):
    first = [F.coalesce("resolution", F.lit(9.0)).alias("r"), col("product_id")]
    return nms.nms_iou(t.footprints, tuple(joins.BOX), first, 0.3, 0.5, ["orbit"]).select("product_id", "orbit")


@query("i06_select_coverage")
def i06(t: Tables):
    """A region with a notch, covered by area; tests hold covers against greedy one at a time."""
    boxes = t.footprints.withColumn("ring", coverage.box_ring([col(c) for c in joins.BOX]))
    roi = [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (4.0, 4.0), (2.0, 6.0)]
    return coverage.select_coverage(boxes, roi, 0.5).withColumn("gain", r6(col("gain")))


@query("w01_rerank", "hits", f"WITH RECURSIVE {_HITS_SQL}, {SPHERE_SQL}, {ROUNDS_SQL} SELECT product_id, lat, lon, score, row_number() OVER (ORDER BY score DESC, lat, lon, product_id) AS rank FROM kept")
def w01(t: Tables):
    """Ranks after suppression, of every hit that stays."""
    return joins.ranked(i02(t), [F.desc("score"), F.asc("lat"), F.asc("lon"), F.asc("product_id")])


@query("scan_candidates", "tiles anchors", f"""WITH RECURSIVE {ANCHORS_SQL}, v AS (SELECT vec_id AS tile_id, bit_count(bit_or(1 << family)) AS votes, min(d) AS best FROM p WHERE d <= threshold GROUP BY vec_id),
n AS (SELECT row_number() OVER (ORDER BY votes DESC, best, tile_id) AS id, * FROM v JOIN tiles USING (tile_id)), {plane_sql('x_offset', 'y_offset', 512.0, 'sqrt(pow(a.x_offset - b.x_offset, 2) + pow(a.y_offset - b.y_offset, 2)) < 512', 'product_id')}, {ROUNDS_SQL},
f AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY id) <= 100), {sphere_sql(150, 'f', 'g')}, {rounds_sql('f', 'g', 'apart')}
SELECT row_number() OVER (ORDER BY id) AS rank, product_id, tile_id, votes, best, lon, lat FROM apart""")
def scan_candidates(t: Tables):
    """The whole scan: codes, family votes, tile positions, suppression, rank."""
    from .scan import scan

    return scan(t.embeddings.select(col("vec_id").alias("id"), col("embedding").alias("v")), t.anchors, t.tiles)


# --- sources and sinks --------------------------------------------------------------------------------------------


@query("s01_read_catalog", "catalog", "SELECT id, name, latitude, longitude, depth_m, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS n_nac FROM catalog WHERE id % 10 <> 0")
def s01(t: Tables):
    path = scratch_path(t.spark, "catalog")
    empty = F.lit(None).cast("string")
    rows = t.catalog.select(
        "id", "name", "host", F.lit("mare").alias("host_type"), F.when(col("id") % 10 == 0, "unknown").otherwise(col("latitude").cast("string")).alias("latitude"), col("longitude").cast("string").alias("longitude"),
        *[empty.alias(c) for c in ("funnel_max_m", "funnel_min_m", "inner_max_m", "inner_min_m", "azimuth_deg")], col("depth_m").cast("string").alias("depth_m"),
        F.when(col("id") % 3 == 0, "M100000001L; ;M100000002R;").alias("reference_nac"),
    )
    rows.write.csv(path, header=True)
    return sources.read_catalog(t.spark, path).select("id", "name", "latitude", "longitude", "depth_m", F.size("reference_nac").alias("n_nac"))


@query("s02_read_archive_index", "footprints", "SELECT product_id, 'vol/' || product_id || '.IMG' AS file_spec, round(min_lat, 6) AS center_latitude, CASE WHEN orderkey % 4 <> 0 THEN resolution END AS resolution FROM footprints")
def s02(t: Tables):
    path = scratch_path(t.spark, "index")
    cells = [F.lit("") for _ in range(82)]
    cells[0], cells[1], cells[5] = F.lit('"VOL_1"'), F.concat(F.lit('"vol/'), "product_id", F.lit('.IMG"')), F.concat(F.lit('"'), "product_id", F.lit('  "'))
    cells[57] = F.when(col("orderkey") % 4 == 0, "n/a").otherwise(F.coalesce(col("resolution").cast("string"), F.lit("")))
    cells[69] = F.round("min_lat", 6).cast("string")
    t.footprints.select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    return sources.read_archive_index(t.spark, path).select("product_id", "file_spec", "center_latitude", "resolution")


@query("s04_read_url_cache", "footprints", "SELECT product_id, 'https://archive.example/' || product_id AS url FROM footprints")
def s04(t: Tables):
    path = scratch_path(t.spark, "urls")
    t.footprints.select("product_id", F.concat(F.lit("https://archive.example/"), "product_id").alias("url"), "orbit").write.parquet(path)
    return sources.read_url_cache(t.spark, path)


@query("s05_read_tile_index", "tiles", "SELECT product_id, tile_id, x_offset FROM tiles WHERE product_id <> 'M100000003RC'")
def s05(t: Tables):
    path = scratch_path(t.spark, "tiles")
    sources.write_tile_index(t.tiles, path)
    vectors = t.tiles.join(t.embeddings.select(col("vec_id").alias("tile_id"), "embedding"), "tile_id").select("product_id", "tile_id", "embedding")
    vectors = vectors.where("NOT (product_id = 'M100000003RC' AND tile_id < 10)")
    return sources.read_tile_index(t.spark, path, vectors).select("product_id", "tile_id", "x_offset")


@query("k01_write_tile_index", "tiles", "SELECT product_id, tile_id, CASE WHEN product_id IN ('M100000000RC', 'M100000001RC') THEN 1 ELSE 2 END AS written FROM tiles")
def k01(t: Tables):
    path = scratch_path(t.spark, "tiles")
    rows = t.tiles.select("product_id", "tile_id")
    sources.write_tile_index(rows.where("product_id < 'M100000002RC'").withColumn("written", F.lit(1)), path)
    sources.write_tile_index(rows.withColumn("written", F.lit(2)), path)
    return t.spark.read.parquet(path).select("product_id", "tile_id", "written")


@query("k03_write_hits_json", "hits", "SELECT product_id, round(score, 6) AS score, lat, lon FROM hits")
def k03(t: Tables):
    path = scratch_path(t.spark, "hits")
    sources.write_hits_json(t.hits.select("product_id", ids.clean_float(col("score")).alias("score"), "lat", "lon"), path)
    return t.spark.read.json(path, schema="product_id string, score double, lat double, lon double")


@query("k04_write_candidates_csv", "hits", "SELECT product_id, score, votes FROM hits")
def k04(t: Tables):
    path = scratch_path(t.spark, "candidates")
    sources.write_candidates_csv(t.hits.select("product_id", "score", "votes"), path, "score")
    return t.spark.read.csv(path, header=True, schema="product_id string, score double, votes long")
