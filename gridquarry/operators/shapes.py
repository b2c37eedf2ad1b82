"""Shapes of shadows, ellipses and annotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_ellipse
from ..session import stage
from .aggregates import mask_moments
from .joins import ranked


def largest_blob(mask: np.ndarray) -> np.ndarray:
    """Places (y, x) of the largest set of pixels that touch by sides or corners; ties go to the first in reading order."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        wide = np.pad(label, 1)
        low = np.where(wide == 0, mask.size + 1, wide)
        near = np.min([low[1 + i : low.shape[0] - 1 + i, 1 + j : low.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, 0)
        if (new == label).all():
            break
        label = new
    names, counts = np.unique(label[mask], return_counts=True)
    return np.argwhere(label == names[counts.argmax()]) if len(names) else np.zeros((0, 2), np.int64)


def shadow_shape(tiles: DataFrame, key: str, pixels: str, width: int, percentile: float = 15.0, least_px: int = 16) -> DataFrame:
    """key, area (share of valid pixels in shadow) and aspect of the largest shadow, by its second moments.

    Shadow: valid (positive) pixels below the percentile of valid ones. Blobs of fewer than least_px pixels have aspect
    1.0; tiles without valid pixels have area 0 and aspect 99.0. Each tile is handled by itself."""

    def shape(values: np.ndarray) -> tuple[float, float]:
        image = values[: len(values) // width * width].reshape(-1, width)
        valid = np.isfinite(image) & (image > 0)
        if not valid.any():
            return 0.0, 99.0
        mask = valid & (image < np.percentile(image[valid], percentile))
        blob = largest_blob(mask).astype(float)
        if len(blob) < least_px:
            return float(mask.sum() / valid.sum()), 1.0
        spread = np.linalg.eigvalsh(np.cov(blob.T) + np.eye(2) / 12)
        return float(mask.sum() / valid.sum()), float(np.sqrt(spread[1] / spread[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shape(np.array(v if v is not None else [], float)) for v in batch.column("px").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64())], ["key", "area", "aspect"])

    rows = tiles.select(F.col(key).alias("key"), F.col(pixels).alias("px"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, area double, aspect double").withColumnRenamed("key", key)


def ellipse_pixels(sites: DataFrame, key: str, size: int) -> DataFrame:
    """key, x, y of the pixels of a size by size crop that a site's ellipse (cx, cy, major, minor, azimuth) holds."""
    side = F.sequence(F.lit(0), F.lit(size - 1))
    grid = sites.withColumn("x", F.explode(side)).withColumn("y", F.explode(side))
    return grid.where(in_ellipse(F.col("x"), F.col("y"), *(F.col(c).cast("double") for c in ("cx", "cy", "major", "minor", "azimuth")))).select(key, "x", "y")


def ellipse_labels(sites: DataFrame, key: str, size: int, most: float = 0.7) -> DataFrame:
    """key, status, reason, and area and box of the site's mask. Sites wider than most of the crop, or whose mask is empty, are
    skipped; sites without axes fail."""
    diameter = 2 * F.greatest("major", "minor")
    fit = sites.where(diameter <= most * size)
    boxes = mask_moments(ellipse_pixels(fit, key, size), key).select(key, "area", "x0", "y0", "width", "height")
    rows = sites.select(key, diameter.alias("__d")).join(boxes, key, "left")
    reason = (
        F.when(F.col("__d").isNull(), "no-axes").when(F.col("__d") > most * size, F.concat(F.lit("pit-too-large-px="), F.round("__d").cast("long").cast("string")))
        .when(F.col("area").isNull(), "empty-mask").otherwise("")
    )
    status = F.when(F.col("__d").isNull(), "fail").when(reason == "", "ok").otherwise("skip")
    return rows.withColumns({"reason": reason, "status": status}).drop("__d")


def annotation_tables(labels: DataFrame, key: str, size: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of the labels (of ellipse_labels) that are ok, with ids from 1 in order.

    images: image_id, key, width, height; annotations: annotation_id, image_id, category_id, key, bbox (x, y, width, height,
    pixels at both ends count), area."""
    rows = stage(ranked(labels.where("status = 'ok'"), order, "image_id"), "annotations")
    bbox = F.array("x0", "y0", (F.col("width") + 1).alias("w"), (F.col("height") + 1).alias("h"))
    images = rows.select("image_id", key, F.lit(size).alias("width"), F.lit(size).alias("height"))
    return images, rows.select(F.col("image_id").alias("annotation_id"), "image_id", F.lit(1).alias("category_id"), key, bbox.alias("bbox"), F.col("area").cast("double").alias("area"))


def split_dateline(boxes: DataFrame) -> DataFrame:
    """Boxes with min_lon and max_lon of any turn, cut where they cross 180 degrees: one or two rows each, within -180 to 180."""
    width = F.least(F.col("max_lon") - F.col("min_lon"), F.lit(360.0))
    west = F.pmod(F.col("min_lon") + 180, F.lit(360.0)) - 180
    east = west + width
    part = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    parts = F.when(east > 180, F.array(part(west, F.lit(180.0)), part(F.lit(-180.0), east - 360))).otherwise(F.array(part(west, east)))
    return boxes.withColumn("__p", F.explode(parts)).withColumns({"min_lon": F.col("__p.a"), "max_lon": F.col("__p.b")}).drop("__p")


def split_dateline_rings(rows: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """key and ring: rings of any shape within -180 to 180, cut where they cross 180 degrees, as convex parts; a row per part."""
    from .ringparts import ring_parts

    return ring_parts(rows, key, ring).select(key, "ring")
