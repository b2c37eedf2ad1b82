"""Tile grids over frames, and rows of pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _grid(products: DataFrame, xs, ys) -> DataFrame:
    return products.withColumn("x_offset", F.explode(xs)).withColumn("y_offset", F.explode(ys))


def _full(size, tile: int, stride: int):
    """Offsets of whole tiles; none if the frame is smaller than a tile."""
    return F.when(size >= tile, F.sequence(F.lit(0), size - tile, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def tile_grid(products: DataFrame, tile: int = 256, stride: int = 192) -> DataFrame:
    """products (samples, lines: int) with x_offset and y_offset of all whole tiles."""
    return _grid(products, _full(F.col("samples"), tile, stride), _full(F.col("lines"), tile, stride))


def tile_grid_clamped(products: DataFrame, tile: int = 256, overlap: int = 64) -> DataFrame:
    """As tile_grid, but the last tile of each row and column is moved back to the frame's edge; no tile twice."""
    step = tile - overlap

    def offsets(size):
        last = F.greatest(size - tile, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last + step - 1, F.lit(step)), lambda x: F.least(x, last)))

    return _grid(products, offsets(F.col("samples")), offsets(F.col("lines")))


def tile_grid_overlap(products: DataFrame, tile: int = 256, overlap: float = 0.5) -> DataFrame:
    """Whole tiles with a stride of the rounded share of a tile that does not overlap."""
    return tile_grid(products, tile, max(1, int(tile * (1 - overlap) + 0.5)))


def crop_bounds(x, y, tile: int, samples, lines):
    """Box of a tile centred on (x, y): struct(x0, y0, x1, y1), or null if it leaves the frame."""
    x0, y0 = F.floor(x - tile / 2), F.floor(y - tile / 2)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 + tile <= samples) & (y0 + tile <= lines)
    return F.when(inside, F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + tile).alias("x1"), (y0 + tile).alias("y1")))


def reflected(index, size: int):
    """The index inside 0 to size - 1 that a mirror at both edges shows (edges not repeated)."""
    period = max(1, 2 * (size - 1))
    at = F.pmod(index, F.lit(period))
    return F.when(at < size, at).otherwise(period - at)


def pixels(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """One row per pixel of an array read as rows of width: key, x, y, value."""
    rows = df.select(key, F.posexplode(values).alias("p", "value"))
    return rows.select(key, (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), "value")


def cut_tiles(stripes: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tiles of pixels from stripes of lines: product_id, x_offset, y_offset, pixels (tile * tile, by line).

    stripes: product_id, line (int), values (array of a line's pixels). A line goes to the tiles that it crosses, cut to
    their columns, and a tile's lines meet in one group, so no frame is ever whole in memory. Tiles that lack a line are left out."""
    width = F.size("values")
    # tiles start at multiples of stride; those that hold a line start above it by less than a tile
    first = F.greatest(F.ceil((F.col("line") - tile + 1) / stride), F.lit(0))
    lines = stripes.withColumn("y_offset", F.explode(F.sequence(first * stride, F.floor(F.col("line") / stride) * stride, F.lit(stride).cast("long"))))
    lines = lines.withColumn("x_offset", F.explode(F.when(width >= tile, F.sequence(F.lit(0), width - tile, F.lit(stride))).otherwise(F.array().cast("array<int>"))))
    parts = lines.select("product_id", "x_offset", "y_offset", "line", F.slice("values", F.col("x_offset") + 1, tile).alias("part"))
    held = parts.groupBy("product_id", "x_offset", "y_offset").agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("lines"))
    return held.where(F.size("lines") == tile).select("product_id", "x_offset", "y_offset", F.flatten(F.transform("lines", lambda r: r["part"])).alias("pixels"))


def crop_roi(places: DataFrame, frames: DataFrame, stripes: DataFrame, key: str, width: int = 256, height: int = 256) -> DataFrame:
    """key and pixels of a crop of width by height around each place, by line; what lies outside the frame is NaN.

    places: key (unique), product_id, x, y in pixels (see geo.lonlat_to_pixel); the centre is the pixel that holds the place.
    frames: product_id, lines, samples. stripes: product_id, line, values. A place more than a crop's size outside its frame,
    or without coordinates or frame, has null pixels. Only the lines of a crop meet it, cut to its columns."""
    x0, y0 = F.floor("x") - width // 2, F.floor("y") - height // 2
    near = (F.floor("x") >= -width) & (F.floor("x") < F.col("samples") + width) & (F.floor("y") >= -height) & (F.floor("y") < F.col("lines") + height)
    at = places.select(key, "product_id", "x", "y").join(frames.select("product_id", "lines", "samples"), "product_id", "left")
    at = at.select(key, "product_id", "samples", x0.alias("x0"), y0.alias("y0"), F.coalesce(near, F.lit(False)).alias("near"))
    lines = at.where("near").withColumn("line", F.explode(F.sequence(F.col("y0"), F.col("y0") + height - 1)))
    met = lines.join(stripes.select("product_id", F.col("line").cast("long").alias("line"), "values"), ["product_id", "line"], "left")
    nans = lambda n: F.array_repeat(F.lit(float("nan")), n.cast("int"))
    left = F.least(F.greatest(-F.col("x0"), F.lit(0)), F.lit(width))
    kept = F.coalesce(F.when(F.col("x0") < F.col("samples"), F.slice("values", F.greatest(F.col("x0"), F.lit(0)).cast("int") + 1, (F.lit(width) - left).cast("int"))), F.array().cast("array<double>"))
    part = F.concat(nans(left), F.transform(kept, lambda v: v.cast("double")))
    part = F.concat(part, nans(F.lit(width) - F.size(part)))
    held = met.select(key, "line", part.alias("part")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "part"))).alias("rows"))
    return at.select(key).join(held, key, "left").select(key, F.flatten(F.transform("rows", lambda r: r["part"])).alias("pixels"))


def normalize(tiles: DataFrame, pixels_col: str, by: str | None = None, shares: tuple[float, float] = (0.0, 1.0), known: DataFrame | None = None) -> DataFrame:
    """tiles with their pixels stretched to 0 to 255: from minimum to maximum (or two percentiles) of valid pixels of the tile
    itself, or, with by, of all tiles of the same product; known (by, low, high) has limits that come before these."""
    from ..functions.raster import INVALID, stretch_u8
    from .aggregates import array_percentile

    once = lambda column, f: F.transform(F.array(column), f)[0]  # f(column), which is evaluated once, not wherever f names it
    fine = F.sort_array(F.filter(F.transform(pixels_col, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (x > INVALID)))
    own = once(fine, lambda v: F.struct(array_percentile(v, shares[0]).alias("low"), array_percentile(v, shares[1]).alias("high")))
    rows, limits = tiles, own
    if by is not None:
        found = tiles.select(by, own.alias("__l")).groupBy(by).agg(F.min("__l.low").alias("__low"), F.max("__l.high").alias("__high"))
        if known is not None:
            found = found.join(known.select(by, "low", "high"), by, "left").select(by, F.coalesce("low", "__low").alias("__low"), F.coalesce("high", "__high").alias("__high"))
        rows, limits = tiles.join(found, by), F.struct(F.col("__low").alias("low"), F.col("__high").alias("high"))
    return rows.withColumn(pixels_col, once(limits, lambda x: stretch_u8(F.col(pixels_col), x["low"], x["high"]))).drop("__low", "__high")


def block_mean_encoder(dim: int) -> Callable[[np.ndarray], np.ndarray]:
    """A model for tests: means of dim equal blocks of a tile's pixels, as a unit vector."""

    def encode(x: np.ndarray) -> np.ndarray:
        means = np.stack([b.mean(1) for b in np.array_split(x.astype(float), dim, axis=1)], 1)
        norm = np.linalg.norm(means, axis=1, keepdims=True)
        return means / np.where(norm > 0, norm, 1)

    return encode


def embed(tiles: DataFrame, model_factory: Callable[[], Callable[[np.ndarray], np.ndarray]], key: str, pixels_col: str, batch: int = 64) -> DataFrame:
    """key and embedding of each tile by any model from arrays to vectors.

    The model is built once per task. A batch that does not fit in memory is halved, down to one tile."""

    def halves(model, x: np.ndarray) -> list[np.ndarray]:
        try:
            return [model(x)]
        except MemoryError:
            if len(x) < 2:
                raise
            return halves(model, x[: len(x) // 2]) + halves(model, x[len(x) // 2 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                model = model or model_factory()
                x = part.column("px").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                found = np.concatenate(halves(model, x))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["key", "embedding"])

    rows = tiles.select(F.col(key).alias("key"), F.col(pixels_col).alias("px"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, embedding array<double>").withColumnRenamed("key", key)
