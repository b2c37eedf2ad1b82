"""Joins by range, place, time and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_M, convex_clip, convex_clip_area, flat_distance_m, polygon_area, rect_overlap_area
from ..functions.ids import file_window, product_sort_key
from ..session import stage


def range_lookup(df: DataFrame, key: str, ranges: DataFrame, low: str, high: str, order: str, take: list[str], width: int) -> DataFrame:
    """df left-joined with the first of ranges (by order) whose closed [low, high] holds key; columns take are null without one.

    Ranges are cut into buckets of width, so the join is by bucket and no side needs to be small. width: about a range's length."""
    cut = ranges.select(low, high, order, *[c for c in take if c not in (low, high, order)])
    cut = cut.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__b", F.floor(F.col(key) / width))
    met = keys.join(cut, "__b").where(F.col(key).between(F.col(low), F.col(high)))
    first = met.groupBy(key).agg(F.min_by(F.struct(*take), order).alias("__first"))
    return df.join(first, key, "left").select(*[df[c] for c in df.columns], *[F.col(f"__first.{c}").alias(c) for c in take])


def assign_volume(products: DataFrame, volumes: DataFrame, width: int = 150) -> DataFrame:
    """products (product_id) plus volume_id: the first volume whose range of numeric keys holds the product."""
    keyed = products.withColumn("key", product_sort_key(F.col("product_id"))["clock"])
    return range_lookup(keyed, "key", volumes, "first_key", "last_key", "ord", ["volume_id"], width).drop("key")


def resolve_products(requests: DataFrame, urls: DataFrame, index: DataFrame, base: str) -> DataFrame:
    """requests (product_id) plus url and status: the cached url, or else one made from the index, or "unknown"."""
    found = requests.join(urls.select("product_id", F.col("url").alias("cached")), "product_id", "left").join(index.select("product_id", "file_spec"), "product_id", "left")
    url = F.coalesce("cached", F.concat(F.lit(base.rstrip("/") + "/"), F.col("file_spec")))
    status = F.when(F.col("cached").isNotNull(), "cached").when(F.col("file_spec").isNotNull(), "index").otherwise("unknown")
    return found.select("product_id", url.alias("url"), status.alias("status"))


def _box_cells(box: list[Column], cell: float) -> Column:
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(span(box[0], box[2]), lambda i: F.transform(span(box[1], box[3]), lambda j: F.struct(i.alias("i"), j.alias("j")))))


BOX = ["min_lon", "min_lat", "max_lon", "max_lat"]


def box_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float) -> DataFrame:
    """Pairs of boxes that share area: a_id, b_id, area. Both sides are cut into cells; a pair counts in the cell of its overlap's lower corner."""
    side = lambda df, key, name: df.select(F.struct(F.col(key).alias("id"), *BOX).alias(name), F.explode(_box_cells([F.col(c) for c in BOX], cell)).alias("cell"))
    met = side(a, a_id, "a").join(side(b, b_id, "b"), "cell")
    p, q = ([F.col(f"{s}.{c}") for c in BOX] for s in "ab")
    corner = F.struct(F.floor(F.greatest(p[0], q[0]) / cell).alias("i"), F.floor(F.greatest(p[1], q[1]) / cell).alias("j"))
    area = rect_overlap_area(p, q)
    return met.where((area > 0) & (F.col("cell") == corner)).select(F.col("a.id").alias(a_id), F.col("b.id").alias(b_id), area.alias("area"))


def ring_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, cell: float, a_ring: str = "ring", b_ring: str = "ring") -> DataFrame:
    """Pairs of rings that share area: a_id, b_id, area. Rings may have any shape and cross 180 degrees (see ringparts.ring_parts);
    both become convex parts, which meet by the cells of their boxes, and only parts whose boxes meet are cut. ids are unique
    on either side."""
    from .ringparts import ring_parts

    def side(df: DataFrame, key: str, ring: str, name: str) -> DataFrame:
        parts = ring_parts(df, key, ring)
        return parts.select(F.struct(F.col(key).alias("id"), "ring", *BOX).alias(name), F.explode(_box_cells([F.col(c) for c in BOX], cell)).alias("cell"))

    met = side(a, a_id, a_ring, "a").join(side(b, b_id, b_ring, "b"), "cell")
    p, q = ([F.col(f"{s}.{c}") for c in BOX] for s in "ab")
    corner = F.struct(F.floor(F.greatest(p[0], q[0]) / cell).alias("i"), F.floor(F.greatest(p[1], q[1]) / cell).alias("j"))
    met = met.where((rect_overlap_area(p, q) > 0) & (F.col("cell") == corner))
    shared = met.select(F.col("a.id").alias(a_id), F.col("b.id").alias(b_id), convex_clip_area(F.col("a.ring"), F.col("b.ring")).alias("area"))
    return shared.groupBy(a_id, b_id).agg(F.sum("area").alias("area")).where("area > 1e-12")


def nearest_site(hits: DataFrame, sites: DataFrame, max_m: float, radius: float = RADIUS_M) -> DataFrame:
    """hits (lat, lon, …) with the nearest site within max_m: name and distance_m, null without one; ties by name.

    Sites (name, latitude, longitude) are blocked by latitude strips of max_m, then by longitude within a strip as wide as
    max_m is at the strip's highest latitude. Equal hits are looked up once, and of sites at one place the first by name. Sites
    are never broadcast: they grow with the catalogue, and each of its rows goes to nine blocks."""
    step = max_m / (radius * 3.141592653589793 / 180)
    strip = lambda lat: F.floor(lat / step)
    wide = lambda s: step / F.greatest(F.cos(F.radians(F.least((F.greatest(F.abs(s), F.abs(s + 1)) + 1) * step, F.lit(90.0)))), F.lit(1e-9))
    turns = lambda s: F.greatest(F.floor(F.lit(360.0) / wide(s)), F.lit(1))
    slot = lambda lon, s: F.floor(F.pmod(lon, F.lit(360.0)) / (F.lit(360.0) / turns(s)))
    own = hits.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct().withColumn("s", strip(F.col("lat"))).withColumn("c", slot(F.col("lon"), F.col("s")))
    once = sites.groupBy("latitude", "longitude").agg(F.min(F.struct("name")).alias("first"))  # ties by name
    near = once.select("first.name", "latitude", "longitude").withColumn("s", F.explode(F.array(*[strip(F.col("latitude")) + d for d in (-1, 0, 1)])))
    near = near.withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("c", F.pmod(slot(F.col("longitude"), F.col("s")) + F.col("k"), turns(F.col("s"))))
    distance = flat_distance_m(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"), radius)
    met = own.join(near.drop("k").distinct().hint("merge"), ["s", "c"]).withColumn("distance_m", distance).where(F.col("distance_m") <= max_m)
    best = met.groupBy("lat", "lon").agg(F.min(F.struct("distance_m", "name")).alias("best")).select("lat", "lon", "best.name", "best.distance_m")
    return hits.join(best.hint("merge"), ["lat", "lon"], "left")


def match_sites(hits: DataFrame, sites: DataFrame, max_m: float = 150.0) -> DataFrame:
    """nearest_site plus status: a match of a known site, or a potential discovery."""
    found = nearest_site(hits, sites, max_m)
    return found.withColumn("status", F.when(F.col("name").isNotNull(), "ground_truth_pit_match").otherwise("potential_new_pit_discovery"))


def missed_sites(hits: DataFrame, sites: DataFrame, max_m: float = 150.0) -> DataFrame:
    """sites that are no hit's nearest within max_m."""
    matched = nearest_site(hits.select("lat", "lon").distinct(), sites, max_m).select("name").where("name IS NOT NULL").distinct()
    return sites.join(matched.hint("merge"), "name", "left_anti")


def attach_metadata(hits: DataFrame, tiles: DataFrame) -> DataFrame:
    return hits.join(tiles, ["product_id", "tile_id"])


def new_only(current: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows of current whose key is not in seen; null keys are new."""
    return current.join(seen.select(key).distinct(), key, "left_anti")


def covering_files(products: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of products (product_id, ts) and files (name) whose window holds ts. Files without a window go with all.

    Windows are cut into months, so the join is by month and not of all with all. Files without a window are listed on each
    product's row, in lists of a thousand: the result has a row for each product and such file."""
    first, last = file_window(F.col("name"))
    dated = files.withColumn("first", first).withColumn("last", last)
    month = lambda d: F.year(d) * 12 + F.month(d)
    windows = dated.where("first IS NOT NULL AND last >= first").withColumn("m", F.explode(F.sequence(month(F.col("first")), month(F.col("last")))))
    own = products.withColumn("m", month(F.col("ts")))
    met = own.join(windows, "m").where((F.col("ts") >= F.col("first").cast("timestamp")) & (F.col("ts") <= F.col("last").cast("timestamp")))
    open_ = running_sums(dated.where("first IS NULL").select("name"), [F.col("name")], {"at": F.lit(1).cast("long")})
    lists = open_.groupBy(F.floor((F.col("at") - 1) / 1000).alias("list")).agg(F.collect_list("name").alias("names"))
    n = stage(lists, "lists").agg(F.max("list")).first()[0]
    every = products.select("product_id", "ts")
    if n is None:
        return met.select("product_id", "ts", "name")
    spread = every.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))
    return met.select("product_id", "ts", "name").unionByName(spread.join(F.broadcast(lists) if n < 100 else lists, "list").select("product_id", "ts", F.explode("names").alias("name")))


def newest(files: DataFrame, family: Column, version: Column) -> DataFrame:
    """The file of largest version of each family."""
    return files.groupBy(family.alias("family")).agg(F.max_by("name", F.struct(version, F.col("name"))).alias("name"))


def band_of(lat: Column, edges: list[float]) -> Column:
    """Number of the first band [edges[k], edges[k + 1]] that holds lat, closed at both ends; null outside."""
    band = None
    for k in range(len(edges) - 1):
        test = (lat >= edges[k]) & (lat <= edges[k + 1])
        band = F.when(test, k) if band is None else band.when(test, k)
    return band


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left (key, at) plus the last value of right at or before at, of the same key. Union and one window, no pairs."""
    both = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("__side"))
    rows = both.unionByName(right.select(key, at, value, F.lit(0).alias("__side")), allowMissingColumns=True)
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(value, last).where("__side = 1").drop("__side")


def grid_tasks(rois: DataFrame, cell: float = 2.0) -> DataFrame:
    """Cells of the grid that share area with a region's box, clipped to it: roi_id and the box of each."""
    i, j = F.col("c.i"), F.col("c.j")
    cells = rois.withColumn("c", F.explode(_box_cells([F.col(c) for c in BOX], cell)))
    clipped = cells.select("roi_id", F.greatest("min_lon", i * cell).alias("x0"), F.greatest("min_lat", j * cell).alias("y0"), F.least("max_lon", (i + 1) * cell).alias("x1"), F.least("max_lat", (j + 1) * cell).alias("y1"))
    return clipped.where("x1 > x0 AND y1 > y0")


def ring_grid_tasks(rois: DataFrame, cell: float = 2.0, roi_id: str = "roi_id") -> DataFrame:
    """Cells of the grid that begins at the lower left corner of each region's bounds, where they share area with the region's ring:
    roi_id, i, j, the cell's box within the bounds (x0, y0, x1, y1), area and pieces (convex rings that make it up).

    Rings may have any shape and cross 180 degrees, where they are cut. A region's parts are cut cell by cell, so no task holds
    a region's cells together."""
    from .ringparts import ring_parts

    parts = ring_parts(rois, roi_id)
    low, size = {"i": F.col("low_lon"), "j": F.col("low_lat")}, F.lit(float(cell))
    span = lambda a, b, k: F.sequence(F.floor((F.col(a) - low[k]) / size), F.floor((F.col(b) - low[k]) / size))
    cells = parts.withColumn("i", F.explode(span("min_lon", "max_lon", "i"))).withColumn("j", F.explode(span("min_lat", "max_lat", "j")))
    x0, y0 = low["i"] + F.col("i") * size, low["j"] + F.col("j") * size
    box = cells.withColumns({"x0": x0, "y0": y0, "x1": F.least(x0 + size, "high_lon"), "y1": F.least(y0 + size, "high_lat")}).where("x1 > x0 AND y1 > y0")
    corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    piece = convex_clip(F.col("ring"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    cut = box.withColumn("piece", piece).withColumn("area", polygon_area(F.col("piece"))).where("area > 1e-12")
    return cut.groupBy(roi_id, "i", "j", "x0", "y0", "x1", "y1").agg(F.sum("area").alias("area"), F.collect_list("piece").alias("pieces"))


def delta_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of current that previous lacks, with their numbers (set difference of volumes)."""
    return current.exceptAll(previous)


def match_by_name(files: DataFrame, sites: DataFrame, least: int = 4) -> DataFrame:
    """files (stem) with the first site (ord) whose normalised name stands in the stem: stem, name; null without one.

    Both are lower-cased, and all but letters and digits left out. Names shorter than least do not count. Files meet the
    names that begin with one of their runs of least characters, so no file meets all names."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    names = sites.select("name", "ord", plain(F.col("name")).alias("n")).where(F.length("n") >= least).withColumn("g", F.substring("n", 1, least))
    stems = files.select("stem").distinct().withColumn("s", plain(F.col("stem")))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - least + 1, F.lit(1))), lambda k: F.col("s").substr(k, F.lit(least))))
    met = stems.withColumn("g", F.explode(grams)).join(names, "g").where(F.contains("s", "n"))
    best = met.groupBy("stem").agg(F.min_by("name", "ord").alias("name"))
    return files.join(best, "stem", "left")


def running_rank(hits: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """hits plus rank over all groups, in order of group and then of order: ranks in a group are shifted by the rows before it.

    Only the groups' counts are put in one order, never the hits."""
    own = hits.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = hits.groupBy(group).count().select(group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    return own.join(starts, group).withColumn("rank", F.col("__s") + F.col("__r")).drop("__r", "__s")


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], per: int = 100_000) -> DataFrame:
    """rows plus, for each name in sums, the sum of its column over all rows up to this one in order.

    Ranges of about per rows are sorted each in a task, summed inside, and shifted by the sums of the ranges before; only one
    line per range is put in one order. Rows that are equal in order lie in one range, in any order."""
    rows = stage(rows, "unranked")
    parts = max(1, -(-rows.count() // per))
    ranged = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("__p", F.shiftright("__at", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__p").agg(*[F.sum(c).alias(f"__{k}") for k, c in enumerate(sums.values())])
    starts = totals.select("__p", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in range(len(sums))])
    inside = Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumns({f"__own{k}": F.sum(c).over(inside) for k, c in enumerate(sums.values())}).join(starts, "__p")
    return found.select(*rows.columns, *[(F.col(f"__{k}") + F.col(f"__own{k}")).alias(name) for k, name in enumerate(sums)])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", per: int = 100_000) -> DataFrame:
    """rows plus name: each row's place in order, from 1, over all rows (see running_sums). order must be total for ranks that
    do not vary."""
    return running_sums(rows, order, {name: F.lit(1).cast("long")}, per)


def ranked_in_groups(rows: DataFrame, group: list[str], order: list[Column], name: str, total: str | None = None, per: int = 100_000) -> DataFrame:
    """rows plus name: each row's place in order, from 1, within its group (columns; null is a group), and total, the group's rows.

    As ranked, over all groups in one order, less the rows of the groups before; so a group of any size goes through many tasks.
    The groups' counts are broadcast if a count shows that they are few."""
    found = ranked(rows.withColumn("__g", F.struct(*group)), [F.col("__g").asc(), *order], "__r", per)
    sizes = stage(found.groupBy("__g").agg((F.min("__r") - 1).alias("__s"), F.count("*").alias("__n")), "sizes")
    found = found.join(F.broadcast(sizes) if sizes.limit(20_001).count() <= 20_000 else sizes, "__g")
    out = found.withColumn(name, F.col("__r") - F.col("__s"))
    return (out if total is None else out.withColumn(total, F.col("__n"))).drop("__g", "__r", "__s", "__n")


def terrain_intersect(rays: DataFrame, heights: DataFrame, cell: float, rounds: int = 6, tolerance: float = 1.0) -> DataFrame:
    """rays (ray_id, px, py, pz, dx, dy, dz: unit direction) with lon, lat and height_m where they meet the terrain.

    heights: i, j (cells of longitude and latitude), height_m. Each round meets the sphere at the height found before and
    looks the height up there, until it changes by less than tolerance. Misses, and points without height, are null."""
    from ..functions.geo import RADIUS_M

    at = rays.withColumn("h", F.lit(0.0)).withColumn("moved", F.lit(float("inf")))
    p, d = [F.col(c) for c in ("px", "py", "pz")], [F.col(c) for c in ("dx", "dy", "dz")]
    for _ in range(rounds):
        b = sum((x * y for x, y in zip(p, d)), F.lit(0.0))
        c = sum((x * x for x in p), F.lit(0.0)) - F.pow(F.lit(RADIUS_M) + F.col("h"), 2)
        t = F.when(b * b - c >= 0, -b - F.sqrt(F.greatest(b * b - c, F.lit(0.0))))
        point = at.withColumn("t", F.when(t > 0, t)).withColumns({k: x + F.col("t") * y for k, x, y in zip("xyz", p, d)})
        r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        point = point.withColumns({"lon": F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)), "lat": F.degrees(F.asin(F.col("z") / r))})
        point = point.withColumns({"i": F.floor(F.col("lon") / cell), "j": F.floor(F.col("lat") / cell)})
        found = point.join(heights.select("i", "j", F.col("height_m").alias("new")), ["i", "j"], "left")
        done = F.col("moved") < tolerance
        found = found.withColumn("next", F.when(done, F.col("h")).otherwise(F.col("new"))).withColumn("moved", F.when(done, F.col("moved")).otherwise(F.abs(F.col("new") - F.col("h"))))
        at = found.select(*rays.columns, F.col("next").alias("h"), "moved", "lon", "lat")
    return at.select("ray_id", "lon", "lat", F.col("h").alias("height_m"))


def elevation_lookup(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """points (point_id, lat, lon) with height_m from the first tile (priority) that has a value in the point's cell; null without."""
    place = points.withColumns({"i": F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / cell), "j": F.floor(F.col("lat") / cell)})
    keys = place.select("i", "j").distinct()
    best = keys.join(cells.where("value IS NOT NULL"), ["i", "j"]).groupBy("i", "j").agg(F.min_by("value", "priority").alias("height_m"))
    return place.join(best, ["i", "j"], "left").drop("i", "j")


def dem_elevation(points: DataFrame, tiles: DataFrame, cells: DataFrame, last: bool = False, block: float = 5.0) -> DataFrame:
    """points (lat, lon, ...) with height_m of the first tile, by priority, that covers a point and has a value there.

    tiles: tile_id, priority, west, south, east, north (closed), n_rows, n_cols, scale, offset, nodata (null: none); cells: tile_id,
    row, col (from the north-west corner), value. Heights are value * scale + offset; a cell that is missing, NaN or nodata
    has none, and the next tile is asked. With last, later tiles win, as in bulk reads. Points that no tile covers, or
    without coordinates, have null. Tiles are cut into blocks of degrees, and places are looked up once each."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / block), F.floor(F.col(b) / block))
    cut = tiles.withColumn("bi", F.explode(span("west", "east"))).withColumn("bj", F.explode(span("south", "north")))
    at = points.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").distinct().withColumn("x", F.pmod(F.col("lon").cast("double"), F.lit(360.0)))
    at = at.withColumns({"bi": F.floor(F.col("x") / block), "bj": F.floor(F.col("lat") / block)})
    met = at.join(cut, ["bi", "bj"]).where("x BETWEEN west AND east AND lat BETWEEN south AND north")
    inside = lambda share, n: F.least(F.greatest(F.floor(share * F.col(n)), F.lit(0)), F.col(n) - 1).cast("int")
    met = met.withColumns({
        "row": inside((F.col("north") - F.col("lat")) / (F.col("north") - F.col("south")), "n_rows"), "col": inside((F.col("x") - F.col("west")) / (F.col("east") - F.col("west")), "n_cols"),
    })
    value = F.col("value").cast("double")
    known = met.join(cells.select("tile_id", "row", "col", value.alias("value")), ["tile_id", "row", "col"])
    known = known.where(F.col("value").isNotNull() & ~F.isnan("value") & ~F.coalesce(F.col("value") == F.col("nodata"), F.lit(False)))
    height = F.col("value") * F.col("scale") + F.col("offset")
    best = known.groupBy("lat", "lon").agg((F.max_by if last else F.min_by)(height, F.col("priority")).alias("height_m"))
    return points.join(best, ["lat", "lon"], "left")


def pixel_poses(pixels: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """pixels with the pose (position, direction) of exactly their product and line; pixels of lines without a pose are left out.
    For poses at other times than lines see as_of."""
    return pixels.join(poses, keys)


def pit_product_pairs(catalog: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """key and product_id: a site's own first reference (reference_nac), else the first of its mapped products; null without any."""
    found = catalog.select(key, "reference_nac").join(mapping.select(key, "products"), key, "left")
    return found.select(key, F.coalesce(F.get("reference_nac", F.lit(0)), F.get("products", F.lit(0))).alias("product_id"))


def catalog_recall(hits: DataFrame, sites: DataFrame, max_m: float) -> DataFrame:
    """matched (hits with a site within max_m), n (all hits), rate."""
    found = nearest_site(hits.select("lat", "lon"), sites, max_m).agg(F.count("name").alias("matched"), F.count("*").alias("n"))
    return found.withColumn("rate", F.when(F.col("n") > 0, F.col("matched") / F.col("n")).otherwise(0.0))
