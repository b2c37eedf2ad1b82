"""Rings of any shape as rows of convex parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rings

POINTS = "array<struct<lon:double,lat:double>>"


def points(ring: list | None) -> np.ndarray:
    """A ring of struct(lon, lat), as Arrow gives it, as (n, 2); missing numbers are NaN."""
    return np.array([(np.nan, np.nan) if p is None else (p["lon"], p["lat"]) for p in ring or []], float).reshape(-1, 2)


def structs(ring: np.ndarray) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for x, y in ring]


def ring_parts(df: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """key, ring (a convex part), its box (min_lon to max_lat), and the box of all of the ring's parts (low_lon to high_lat): a row per
    part. Longitudes are within -180 to 180, and what crosses 180 degrees is cut there. Rings may be concave, cross themselves
    (even-odd rule) or repeat corners; those without area, or with missing corners, have no row."""
    rows = df.select(F.col(key).alias("id"), F.col(ring).cast(POINTS).alias("ring"))
    point = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    box = ["min_lon", "min_lat", "max_lon", "max_lat", "low_lon", "low_lat", "high_lon", "high_lat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts, boxes = [], [], []
            for row, given in enumerate(batch.column("ring").to_pylist()):
                own = rings.turned_parts(points(given))
                if own:
                    every = np.concatenate(own)
                    whole = [*every.min(0), *every.max(0)]
                    for part in own:
                        at.append(row)
                        parts.append(structs(part))
                        boxes.append([*part.min(0), *part.max(0), *whole])
            columns = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(parts, point), *(pa.array([b[k] for b in boxes], pa.float64()) for k in range(8))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ring", *box])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ring {POINTS}, " + ", ".join(f"{c} double" for c in box)).withColumnRenamed("id", key)
