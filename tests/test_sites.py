"""Sites are matched without a broadcast of the catalogue."""

from pyspark.sql import functions as F

from gridquarry.operators import joins


def tables(spark):
    hits = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 20.0), (3, -40.0, 300.0)], "id int, lat double, lon double")
    sites = spark.createDataFrame([("b", 10.0, 20.0), ("a", 10.0, 20.0), ("c", 50.0, 50.0)], "name string, latitude double, longitude double")
    return hits, sites


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recall_broadcasts_no_sites(spark):
    found = joins.catalog_recall(*tables(spark), 300.0)
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(2, 3, 2 / 3)]


def test_match_broadcasts_no_sites(spark):
    found = joins.match_sites(*tables(spark), 300.0)
    assert "Broadcast" not in plan(found)
    assert sorted((r["id"], r["name"]) for r in found.where("name IS NOT NULL").collect()) == [(1, "a"), (2, "a")]


def test_classify_broadcasts_no_sites(spark):
    from gridquarry.plans.queries import QUERIES

    found = QUERIES["f07_classify"](spark, "/root/testdata/sf0.001")
    assert "latitude" not in "".join(line for line in plan(found).splitlines() if "BroadcastExchange" in line)
    assert found.count() == found.select("vec_id").distinct().count() > 0


def test_sites_at_one_place_meet_hits_once(spark):
    hits, _ = tables(spark)
    sites = spark.range(2000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"))
    found = joins.nearest_site(hits, sites, 300.0)
    assert {r["name"] for r in found.collect()} == {"s0", None}


def test_missed_sites_broadcast_nothing(spark):
    found = joins.missed_sites(*tables(spark), 300.0)
    assert "Broadcast" not in plan(found)
    assert sorted(r["name"] for r in found.collect()) == ["b", "c"]
