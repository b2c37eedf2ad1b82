"""Stand-in tables over the driver's tables: the same SQL text defines them in Spark and in DuckDB.

Every table covers all rows of what it is made from. anchors is a query set: the vectors whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXT = {
    "tiles": """
SELECT concat('M', cast(100000000 + vec_id % 5 AS STRING), 'RC') AS product_id, vec_id AS tile_id,
       cast(floor(vec_id / 5) AS BIGINT) % 10 * 192 AS x_offset,
       cast(floor(floor(vec_id / 5) / 10) AS BIGINT) * 192 AS y_offset, 256 AS width, 256 AS height,
       300.0e0 + (cast(floor(vec_id / 5) AS BIGINT) % 10) * 0.004e0 AS lon,
       10.0e0 - floor(floor(vec_id / 5) / 10) * 0.004e0 AS lat
FROM embeddings""",
    "anchors": """
SELECT vec_id AS anchor_id, concat('anchor_', cast(vec_id AS STRING)) AS name, embedding FROM embeddings WHERE vec_id % 50 = 0""",
    "hits": """
SELECT concat('M', cast(100000000 + l_suppkey AS STRING), 'LC') AS product_id, l_suppkey AS supp,
       l_partkey * 7 % 4809 AS x_offset, l_orderkey * 13 % 51969 AS y_offset,
       l_extendedprice AS score, cast(l_quantity AS BIGINT) AS votes, l_returnflag AS class,
       (l_partkey * 37 + l_linenumber) % 36000 / 100.0e0 AS lon, (l_orderkey * 53) % 12000 / 100.0e0 - 60.0e0 AS lat,
       l_orderkey AS orderkey, l_partkey AS partkey, l_linenumber AS line
FROM lineitem""",
    "catalog": """
SELECT p_partkey AS id, concat(p_name, ' ', cast(p_partkey AS STRING)) AS name, p_brand AS host,
       (p_partkey * 37) % 36000 / 100.0e0 AS longitude, (p_partkey * 91) % 12000 / 100.0e0 - 60.0e0 AS latitude,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE cast(p_size AS DOUBLE) END AS depth_m
FROM part""",
    "footprints": """
SELECT concat('M', cast(1000000000 + o_orderkey AS STRING), 'RC') AS product_id, o_custkey % 40 AS orbit, o_orderkey AS orderkey,
       (o_orderkey * 17) % 1000 / 100.0e0 AS min_lon, (o_orderkey * 29) % 1000 / 100.0e0 AS min_lat,
       (o_orderkey * 17) % 1000 / 100.0e0 + (10 + o_custkey % 30) / 100.0e0 AS max_lon,
       (o_orderkey * 29) % 1000 / 100.0e0 + (20 + o_custkey % 50) / 100.0e0 AS max_lat,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (50 + o_orderkey % 150) / 100.0e0 END AS resolution,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_custkey % 90 AS DOUBLE) END AS incidence, o_orderdate AS ts
FROM orders""",
    "volumes": """
SELECT concat('V_', cast(s_suppkey AS STRING)) AS volume_id, s_suppkey AS ord,
       1000000000 + s_suppkey * 150 AS first_key, 1000000000 + s_suppkey * 150 + 139 AS last_key FROM supplier""",
    "trace": """
SELECT event_id, ts, user_id % 10 AS band, concat('M', cast(100000000 + user_id AS STRING), 'RC') AS product_id,
       CASE event_type WHEN 'view' THEN 'ingest_tiles' WHEN 'click' THEN 'ingest_s' WHEN 'purchase' THEN 'index_compile_s'
                       WHEN 'signup' THEN 'index_size_bytes' ELSE 'node_complete' END AS metric, value
FROM events""",
    "scored": """
SELECT d.doc_id, l.quality AS y, l.toxic AS toxic, cast(d.n_chars AS DOUBLE) AS s, (d.doc_id * 31) % 100 / 100.0e0 AS delta_h
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or one of the driver's tables."""
    if name not in TEXT:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    words = set(TEXT[name].replace(",", " ").split())
    text, used = TEXT[name], {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: body over the named stand-ins."""
    body = body.strip()
    if not names:
        return body
    views = ", ".join(f"{n} AS ({TEXT[n].strip()})" for n in names.split())
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"
