"""Small sets of footprints that cover a region: greedy by area, or by cells, not yet covered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..session import drop, stage
from .aggregates import reject_area_outliers
from .gates import filter_footprints
from .joins import BOX, _box_cells, running_sums
from .ringparts import POINTS, points


def footprint_cells(footprints: DataFrame, roi: tuple[float, float, float, float], cell: float) -> DataFrame:
    """product_id and i, j of the grid cells of the region whose centre a footprint's box holds."""
    rows = footprints.select("product_id", *BOX, F.explode(_box_cells([F.col(c) for c in BOX], cell)).alias("c"))
    x, y = (F.col("c.i") + 0.5) * cell, (F.col("c.j") + 0.5) * cell
    inside = x.between(F.col("min_lon"), F.col("max_lon")) & y.between(F.col("min_lat"), F.col("max_lat"))
    region = x.between(roi[0], roi[2]) & y.between(roi[1], roi[3])
    return rows.where(inside & region).select("product_id", F.col("c.i").alias("i"), F.col("c.j").alias("j")).distinct()


def _named(like: DataFrame, names: list[str]) -> DataFrame:
    """A table of product_id; picks are few, as they are what a user goes through."""
    return like.sparkSession.createDataFrame([(n,) for n in names], like.select("product_id").schema)


def greedy_cover(cells: DataFrame, min_gain: int = 1, stop_uncovered: int = 0, most: int | None = None, batch: int = 64) -> tuple[list[tuple[str, int]], DataFrame]:
    """Greedy set cover over (product_id, i, j): the picks in order with their gains, and the cells left uncovered.

    Each pick has the largest number of cells not yet covered, ties by product_id. A round looks at the batch products of
    largest gain, with the cells of those only, and takes picks from them as long as no product outside the batch could
    gain more, so picks equal those of the one-at-a-time greedy. most, if given, bounds the picks: the cells left uncovered tell
    whether it cut the cover short. Gains of all others shrink in the next round's join."""
    left, picks = stage(cells, "cells"), []
    while most is None or len(picks) < most:
        gains = left.groupBy("product_id").count().orderBy(F.desc("count"), "product_id").limit(batch + 1).collect()
        if not gains or gains[0]["count"] < min_gain:
            break
        bound = gains[batch]["count"] if len(gains) > batch else 0
        names = [r["product_id"] for r in gains[:batch]]
        own: dict[str, set] = {n: set() for n in names}
        for r in left.join(_named(left, names), "product_id", "left_semi").toLocalIterator():  # batch footprints
            own[r["product_id"]].add((r["i"], r["j"]))
        chosen = []
        while own and (most is None or len(picks) < most):
            name = min(own, key=lambda n: (-len(own[n]), n))
            gain = len(own[name])
            tie = gain == bound and name > gains[batch]["product_id"] if bound else False
            if gain < max(bound, min_gain) or tie:
                break
            taken = own.pop(name)
            picks.append((name, gain))
            chosen.append(name)
            for rest in own.values():
                rest -= taken
        covered = left.join(_named(left, chosen), "product_id", "left_semi").select("i", "j").distinct()
        left = stage(left.join(covered, ["i", "j"], "left_anti"), "cells")
        if stop_uncovered and left.select("i", "j").distinct().count() <= stop_uncovered:
            break
    return picks, left.select("i", "j").distinct()


_PIECES = "array<array<double>>"
_CELLS = "array<struct<i:int,j:int>>"


def _columns(held: list[list[np.ndarray]], cell: float) -> list[pa.Array]:
    """pieces (corners in a row of numbers), gain (their area) and the cells of their boxes, of each candidate."""
    cells = []
    for pieces in held:
        own = set()
        for piece in pieces:
            (a, b), (c, d) = np.floor(piece.min(0) / cell).astype(int).tolist(), np.floor(piece.max(0) / cell).astype(int).tolist()
            own |= {(i, j) for i in range(a, c + 1) for j in range(b, d + 1)}
        cells.append([{"i": i, "j": j} for i, j in sorted(own)])
    flat = pa.array([[piece.ravel().tolist() for piece in pieces] for pieces in held], pa.list_(pa.list_(pa.float64())))
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
    return [flat, pa.array([float(sum(map(rings.area, pieces))) for pieces in held], pa.float64()), pa.array(cells, kind)]


def _candidates(footprints: DataFrame, roi: list[np.ndarray], cell: float) -> tuple[DataFrame, DataFrame]:
    """(products, shapes): product_id, orbit, incidence, resolution and shape; and what each shape, a number for all footprints of
    equal rings, shares with the region: pieces, gain, cells. Equal rings are cut once; what shares no area is left out."""
    orbit = F.coalesce(F.col("orbit").cast("long"), F.lit(0).cast("long")).alias("orbit")
    rows = footprints.dropDuplicates(["product_id"]).select("product_id", orbit, F.col("incidence").cast("double").alias("incidence"), F.col("resolution").cast("double").alias("resolution"), F.col("ring").cast(POINTS).alias("ring"))
    rows = stage(rows, "footprints")
    different = stage(rows.select("ring").distinct(), "rings").withColumn("shape", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[piece for part in rings.turned_parts(points(r)) for by in roi if len(piece := rings.clip(part, by))] for r in batch.column("ring").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shape"), batch.column("ring"), *_columns(held, cell)], ["shape", "ring", "pieces", "gain", "cells"])

    found = stage(different.select("shape", "ring").mapInArrow(run, f"shape long, ring {POINTS}, pieces {_PIECES}, gain double, cells {_CELLS}").where("gain > 0"), "shapes")
    products = stage(rows.join(found.select("ring", "shape"), "ring").drop("ring"), "products")
    drop(rows)
    return products, found.drop("ring")


def _without(shapes: DataFrame, taken: DataFrame, cell: float) -> DataFrame:
    """shapes less what taken (shape, taken: pieces) covers, and less those of which nothing is left. Only shapes in taken reach Python."""
    own = [c for c in shapes.columns if c not in ("pieces", "gain", "cells")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for pieces, gone in zip(batch.column("pieces").to_pylist(), batch.column("taken").to_pylist(), strict=True):
                pieces = [np.array(p).reshape(-1, 2) for p in pieces]
                for by in gone:
                    pieces = rings.subtract(pieces, np.array(by).reshape(-1, 2))
                held.append(pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *_columns(held, cell)], [*own, "pieces", "gain", "cells"])

    schema = ", ".join(f"{c} {shapes.schema[c].dataType.simpleString()}" for c in own)
    cut = shapes.join(taken, "shape").select(*own, "pieces", "taken").mapInArrow(run, f"{schema}, pieces {_PIECES}, gain double, cells {_CELLS}")
    return cut.where("gain > 0").select(*shapes.columns).unionByName(shapes.join(taken.select("shape"), "shape", "left_anti"))


def _greedy_areas(shapes: DataFrame, cell: float, min_gain: float) -> tuple[DataFrame | None, DataFrame]:
    """Picks (product_id, gain) of the greedy cover by area among shapes that are open, and what is left of the others. A shape's
    product_id is the first of the open products that have it.

    Greedy takes the candidate that adds most, again and again. One that adds more than all those it shares a cell with is
    taken with just this gain whatever happens elsewhere, since only they could lessen it. So a round takes all such
    candidates at once, and cuts from the others in their cells, where each cell has one taker, what they cover: picks and
    gains equal those of greedy one at a time, whose order is that of falling gain. Nothing is compared in pairs, and rounds
    are as many as the longest chain of candidates that wait for one another."""
    picks = None
    by = (-F.round("gain", 9)).alias("loss")
    while True:
        live = shapes.where(F.col("open") & (F.col("gain") >= min_gain))
        cells = live.select("shape", F.struct(by, "product_id").alias("rank"), F.explode("cells").alias("cell"))
        best = cells.groupBy("cell").agg(F.min("rank").alias("best"))
        waits = cells.join(best, "cell").where("best.product_id <> rank.product_id").select("shape").distinct()
        taken = stage(live.join(waits, "shape", "left_anti").select("shape", "product_id", "gain", "pieces", "cells"), "taken")
        if taken.isEmpty():
            return picks, shapes
        picks = taken.select("product_id", "gain") if picks is None else picks.unionByName(taken.select("product_id", "gain"))
        others = shapes.join(taken.select("shape"), "shape", "left_anti")
        takers = taken.select(F.col("shape").alias("taker"), F.explode("cells").alias("cell"))
        met = others.select("shape", F.explode("cells").alias("cell")).join(takers, "cell").select("shape", "taker").distinct()
        gone = stage(met.join(taken.select(F.col("shape").alias("taker"), "pieces"), "taker").groupBy("shape").agg(F.flatten(F.collect_list("pieces")).alias("taken")), "gone")
        shapes = stage(_without(others, gone, cell), "shapes")


def box_ring(box: list[Column]) -> Column:
    """A box (min_lon, min_lat, max_lon, max_lat) as a ring."""
    corner = lambda x, y: F.struct(box[x].cast("double").alias("lon"), box[y].cast("double").alias("lat"))
    return F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))


def select_coverage(
    footprints: DataFrame,
    roi: list[tuple[float, float]],
    cell: float = 1.0,
    ceilings: tuple[float, ...] = (60.0, 85.0, 89.5),
    uncovered: float = 0.01,
    min_gain: float = 1e-3,
    max_resolution: float = 1.5,
) -> DataFrame:
    """Footprints that cover a region but for a share uncovered of its area: pick (from 1), product_id, gain (square degrees that it
    added), pass. Greedy by area: each pick adds most, ties by product_id, and at least min_gain.

    footprints: product_id, ring (array of struct(lon, lat)), orbit, incidence, resolution; roi: a ring. Both may have any shape
    and cross 180 degrees (see rings.turned_parts); areas are exact in the plane. Passes open footprints of more incidence:
    30 degrees up to each ceiling, then any; a null incidence or resolution passes. In each pass, footprints whose part of
    what is uncovered is an outlier in their orbit (null: 0) are left out. Passes and picks end when no more than the share is
    uncovered. Of rows of equal product_id one counts; rings without area in the region are no candidates. A region without
    area, and an empty table, give no picks.

    Footprints of equal rings are one candidate, for the first of them that is open. cell is the side of the cells by which candidates
    find each other: about a footprint's size. See _greedy_areas."""
    spark = footprints.sparkSession
    region = rings.turned_parts(np.array(roi, float))
    total = sum(map(rings.area, region))
    out = spark.createDataFrame([], f"pick long, product_id {footprints.schema['product_id'].dataType.simpleString()}, gain double, pass int")
    if not total:
        return out
    products, shapes = _candidates(footprints, region, cell)
    covered, number = 0.0, 0
    for k, (low, high) in enumerate([*((30.0, c) for c in ceilings), (0.0, 90.0)]):
        if (total - covered) / total < uncovered:
            break
        candidates = products.join(shapes.select("shape", F.col("gain").alias("area")), "shape")
        fine = reject_area_outliers(filter_footprints(candidates, max_resolution, low, high))
        open_ = fine.groupBy("shape").agg(F.min("product_id").alias("product_id"), F.lit(True).alias("open"))
        marked = stage(shapes.join(open_, "shape", "left").withColumn("open", F.coalesce("open", F.lit(False))), "marked")
        picks, rest = _greedy_areas(marked, cell, min_gain)
        shapes = rest.drop("open", "product_id")
        if picks is None:
            continue
        ordered = running_sums(picks, [(-F.round("gain", 9)).alias("loss"), F.col("product_id").asc()], {"upto": F.col("gain"), "at": F.lit(1).cast("long")})
        before = covered + F.col("upto") - F.col("gain")
        kept = stage(ordered.where((total - before) / total >= uncovered).select((F.col("at") + number).alias("pick"), "product_id", "gain", F.lit(k).alias("pass")), "picks")
        gain, n = kept.agg(F.coalesce(F.sum("gain"), F.lit(0.0)), F.count("*")).first()
        covered, number, out = covered + gain, number + n, out.unionByName(kept)
    return out
