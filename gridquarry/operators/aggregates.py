"""Aggregations over hits, footprints, telemetry, masks and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import ranked_in_groups


def reject_area_outliers(footprints: DataFrame, factor: float = 6.0, least: int = 3) -> DataFrame:
    """Rows whose area is at most factor times their orbit's median; orbits of fewer rows, or with median 0, keep all."""
    stats = footprints.groupBy("orbit").agg(F.median("area").alias("m"), F.count("*").alias("n"))
    found = footprints.join(stats, "orbit")
    return found.where((F.col("n") < least) | (F.col("m") <= 0) | (F.col("area") <= factor * F.col("m"))).drop("m", "n")


def run_report(trace: DataFrame, run: str) -> DataFrame:
    """Per run: sums of telemetry, tiles a second, seconds a product; 0 where a denominator is 0. trace: run, product_id, metric, value."""
    total = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    sums = trace.groupBy(run).agg(
        F.countDistinct("product_id").alias("products"), total("ingest_tiles").alias("tiles"), total("ingest_s").alias("ingest_s"),
        total("index_compile_s").alias("compile_s"), total("index_size_bytes").alias("index_bytes"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumn("tiles_per_s", ratio("tiles", "ingest_s")).withColumn("s_per_product", ratio("ingest_s", "products"))


def group_stats(scored: DataFrame, group: str, value: str, limits: tuple[float, ...] = (0.35, 0.20)) -> DataFrame:
    """Per group: rows, mean, population deviation, and the percentage below each limit."""
    v = F.col(value)
    below = [(100.0 * F.avg((v < x).cast("double"))).alias(f"below_{int(100 * x)}") for x in limits]
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), *below)


def best_per_class(dets: DataFrame, key: str, priority: dict[str, int], min_score: float) -> DataFrame:
    """Of each key the detection of highest class priority, then score; those below min_score are dropped."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair])[F.col("class")], F.lit(0))
    return dets.where(F.col("score") >= min_score).groupBy(key).agg(F.max(F.struct(rank.alias("priority"), "score", "class")).alias("best")).select(key, "best.class", "best.score")


def array_percentile(ordered: Column, share: float) -> Column:
    """Of an array in order, between its neighbours in proportion; null if it is empty."""
    at = (F.size(ordered) - 1) * share
    low, part = F.floor(at).cast("int"), at - F.floor(at)
    return F.when(F.size(ordered) > 0, F.get(ordered, low) * (1 - part) + F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) * part)


def tile_stats(tiles: DataFrame, key: str, pixels: str, invalid: float = -32752.0) -> DataFrame:
    """key, n, n_valid (above invalid), nonzero (share of all), low, high, p2, p98 (of valid pixels, exact).

    A tile is a row and stays where it is. A null or empty array has n 0 and no other numbers."""
    values = F.transform(F.col(pixels), lambda x: x.cast("double"))
    rows = tiles.select(F.col(key).alias("k"), F.coalesce(values, F.array().cast("array<double>")).alias("px"))
    valid = rows.withColumn("v", F.array_sort(F.filter("px", lambda x: x > invalid)))
    nonzero = F.size(F.filter("v", lambda x: x != 0)) / F.when(F.size("px") > 0, F.size("px"))
    return valid.select(
        F.col("k").alias(key), F.size("px").cast("long").alias("n"), F.size("v").cast("long").alias("n_valid"), nonzero.alias("nonzero"), F.get("v", F.lit(0)).alias("low"),
        F.get("v", F.size("v") - 1).alias("high"), array_percentile(F.col("v"), 0.02).alias("p2"), array_percentile(F.col("v"), 0.98).alias("p98"),
    )


def mask_moments(pixels: DataFrame, key: str) -> DataFrame:
    """Of pixel rows (key, x, y): area, centroid and bounding box."""
    return pixels.groupBy(key).agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"),
    )


def array_moments(values: Column, width: int, test: Callable[[Column], Column]) -> Column:
    """mask_moments of the pixels of an array (rows of width) that pass test, as a struct; area 0 and nulls if none does."""
    places = F.filter(F.transform(values, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    at = F.transform(places, lambda i: F.struct((i % width).alias("x"), F.floor(i / width).cast("int").alias("y")))

    def moments(m: Column) -> Column:
        n = F.size(m)
        xs, ys = F.transform(m, lambda p: p["x"]), F.transform(m, lambda p: p["y"])
        mean = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x) / F.when(n > 0, n)
        return F.struct(
            n.cast("long").alias("area"), mean(xs).alias("cx"), mean(ys).alias("cy"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
            (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"),
        )

    return F.transform(F.array(F.coalesce(at, F.array().cast("array<struct<x:int,y:int>>"))), moments)[0]


def physics_validate(masks: DataFrame, key: str, azimuth: Column, incidence: Column, scale: float = 0.5, least_ratio: float = 0.1, least_px: int = 10) -> DataFrame:
    """A shadow against the sun: key, shadow_deg, solar_deg, error_deg, depth_m, ratio, valid, confidence, shadow_px, edge_px.

    masks: key, and the moments of its shadow and of its edge as structs (see array_moments; null: an empty mask). Masks of
    fewer than least_px pixels are invalid with an error of 180. azimuth and incidence are columns over masks."""
    both = masks.select(key, *[F.col(f"{m}.{c}").alias(f"{m[0]}_{c}") for m in ("shadow", "edge") for c in ("area", "cx", "cy", "width", "height")], azimuth.alias("azimuth"), incidence.alias("incidence"))
    px = {f"{name}_px": F.coalesce(f"{name[0]}_area", F.lit(0)).cast("long") for name in ("shadow", "edge")}
    enough = (px["shadow_px"] >= least_px) & (px["edge_px"] >= least_px)
    dx, dy = F.col("s_cx") - F.col("e_cx"), F.col("s_cy") - F.col("e_cy")
    # Spark's atan2 takes -0.0 for 0.0: without an offset, atan2(0.0, -0.0) is half a turn elsewhere
    angle = F.when((dx == 0) & (dy == 0), F.lit(180.0)).otherwise((F.degrees(F.atan2(dx, -dy)) + 360) % 360)
    both = both.withColumn("shadow_deg", F.when(enough, angle).otherwise(0.0))
    both = both.withColumn("solar_deg", F.when(enough, F.pmod(F.col("azimuth") + 180, F.lit(360.0))).otherwise(F.col("azimuth").cast("double")))
    gap = F.abs(F.col("shadow_deg") - F.col("solar_deg"))
    tan = F.tan(F.radians("incidence"))
    depth = F.when(enough & (tan > 0.01), F.sqrt(dx * dx + dy * dy) * scale / tan).otherwise(0.0)
    width = F.greatest("e_width", "e_height") * scale
    both = both.withColumn("error_deg", F.when(enough, F.when(gap > 180, 360 - gap).otherwise(gap)).otherwise(180.0)).withColumn("depth_m", depth)
    both = both.withColumn("ratio", F.when(enough & (width > 0), F.col("depth_m") / width).otherwise(0.0))
    both = both.withColumn("valid", (F.col("error_deg") < 45) & (F.col("ratio") >= least_ratio))
    confidence = F.when(F.col("valid"), F.least(F.lit(1.0), (1 - F.col("error_deg") / 45) * 0.7 + F.col("ratio") * 0.3)).otherwise(0.0)
    return both.select(key, "shadow_deg", "solar_deg", "error_deg", "depth_m", "ratio", "valid", confidence.alias("confidence"), *[c.alias(name) for name, c in px.items()])


def band_progress(states: DataFrame, bands: list[tuple[float, float]], workers: int = 4, polar: int = 545, fallback: int = 8886, pace: float = 18.0) -> DataFrame:
    """Every planned band: min_lat, max_lat, images, done, coverage, seconds, status, confidence, per_hour, hours_left, estimate_s.

    states (band from 0, planned, done, coverage, seconds, status, first_ts, last_ts) are of bands that were begun; others
    are pending. Where no image count is known, images is estimated: polar for the first and the last band, else the mean
    images per area on the sphere of the known other bands, rounded to 25, or fallback if none is known. confidence: REAL
    for known bands, HIGH if the band mirrored at the equator is known, MED if any density is, else LOW.
    per_hour and hours_left are measured (after 300 seconds and 10 images at least); estimate_s is what is left at the mean
    pace of finished bands (their seconds shared by workers), or at pace. bands: edges of latitude, a few numbers."""
    spark, last = states.sparkSession, len(bands) - 1
    plan = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(bands)], "band int, min_lat double, max_lat double")
    area = F.abs(F.sin(F.radians("max_lat")) - F.sin(F.radians("min_lat")))
    begun = states.select(F.col("band").cast("int"), "planned", "done", "coverage", "seconds", "status", "first_ts", "last_ts")
    rows = plan.withColumn("area", area).join(begun, "band", "left").withColumn("known", F.coalesce(F.col("planned") > 0, F.lit(False)))
    over = F.col("known") & (F.col("status") == "done")
    sums = rows.agg(  # one row
        F.avg(F.when(F.col("known") & ~F.col("band").isin(0, last), F.col("planned") / F.col("area"))).alias("density"),
        F.coalesce(F.sum(F.when(over, F.coalesce("seconds", F.lit(0.0)) / workers)) / F.sum(F.when(over, F.col("planned"))), F.lit(pace)).alias("pace"),
        F.collect_set(F.when(F.col("known"), F.col("band"))).alias("known_bands"),
    )
    rows = rows.crossJoin(F.broadcast(sums))
    guess = F.when(F.col("band").isin(0, last), F.lit(polar)).when(F.col("density").isNotNull(), F.rint(F.col("density") * F.col("area") / 25) * 25).otherwise(F.lit(fallback))
    rows = rows.withColumn("images", F.when(F.col("known"), F.col("planned")).otherwise(guess.cast("long"))).withColumn("done", F.coalesce("done", F.lit(0)))
    trust = F.when(F.col("known"), "REAL").when(F.array_contains("known_bands", last - F.col("band")), "HIGH").when(F.col("density").isNotNull(), "MED").otherwise("LOW")
    elapsed = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    left = F.when(F.col("status") == "done", 0).otherwise(F.greatest(F.col("images") - F.col("done"), F.lit(0)))
    rows = rows.withColumn("per_hour", F.when((F.col("status") == "running") & (elapsed > 300) & (F.col("done") > 10), F.col("done") / elapsed * 3600))
    return rows.select(
        "band", "min_lat", "max_lat", "images", "done", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("status", F.lit("pending")).alias("status"), trust.alias("confidence"), "per_hour", (left / F.col("per_hour")).alias("hours_left"), (left * F.col("pace")).alias("estimate_s"),
    )


def sample_per_group(df: DataFrame, group: str, key: str, target: int, seed: str = "7") -> DataFrame:
    """At most target / groups + 1 rows of each group, then target rows; chosen by md5 of key and seed, so reruns agree."""
    groups = df.select(group).distinct().count()
    order = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(seed)))
    per = df.withColumn("__h", order).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__h", key)))
    return per.where(F.col("__r") <= target // max(1, groups) + 1).orderBy("__h", key).limit(target).drop("__h", "__r")


def score_summary(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return df.agg(F.count(s).alias("n"), F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"))


def global_minmax(df: DataFrame, group: str, value: str, known: DataFrame | None = None) -> DataFrame:
    """low and high of each group: from known where it has the group, else from the rows themselves."""
    own = df.groupBy(group).agg(F.min(value).alias("own_low"), F.max(value).alias("own_high"))
    if known is None:
        return own.select(group, F.col("own_low").alias("low"), F.col("own_high").alias("high"))
    return own.join(known, group, "left").select(group, F.coalesce("low", "own_low").alias("low"), F.coalesce("high", "own_high").alias("high"))


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").count()


def throughput_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events, distinct products and the last product of each window of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("product_id", F.struct("ts", "event_id")).alias("last_product")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "last_product")


def session_gaps(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a key that are never further apart than gap."""
    w = F.session_window("ts", gap)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def dual_scale_pooling(tokens: DataFrame, group: str, vector: str, key: str, share: float = 0.1) -> DataFrame:
    """group and pooled: the mean of a group's vectors, and the mean of the share of them (one at least) with the largest norm, each
    as a unit vector, one after the other, together a unit vector again.

    Norms count to 9 places, ties go by key. Only norms and keys are put in order, in ranges, so that a group of any size goes
    through many tasks; vectors stay where they are, and tasks send sums for each group and place."""
    from ..functions.vectors import dot, l2_normalize

    rows = tokens.select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("n2", F.round(dot(F.col("v"), F.col("v")), 9))
    placed = ranked_in_groups(rows.select("g", "k", "n2"), ["g"], [F.desc("n2"), F.asc("k")], "r", total="n")
    last = placed.where(F.col("r") == F.greatest(F.lit(1), F.floor(share * F.col("n")))).select("g", F.col("k").alias("last"), F.col("n2").alias("least"))
    last = stage(last, "last")  # a row a group
    met = rows.join(F.broadcast(last) if last.limit(20_001).count() <= 20_000 else last, "g")
    best = F.expr("n2 > least OR (n2 = least AND (k IS NULL OR k <= last))")
    px = met.select("g", F.coalesce(best, F.lit(False)).alias("best"), F.posexplode("v").alias("p", "x"))
    means = px.groupBy("g", "p").agg(F.avg("x").alias("mean"), F.avg(F.when(F.col("best"), F.col("x"))).alias("top_mean"))
    held = means.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "mean", "top_mean"))).alias("m"))
    half = lambda c: l2_normalize(F.transform("m", lambda x: x[c]))
    return held.select(F.col("g").alias(group), l2_normalize(F.concat(half("mean"), half("top_mean"))).alias("pooled"))
