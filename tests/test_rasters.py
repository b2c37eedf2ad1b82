"""Raster files: labels, ranges of lines, the sink."""

import numpy as np
import pytest

from gridquarry.sources import rasters


def test_labels():
    text = rasters.label_text("P", 3, 40, 0.5, -1.0).decode()
    assert rasters.parse_label(text, "x.IMG") == ("P", len(text), 3, 40, 16, False, True, 0.5, -1.0) and len(text) % 80 == 0
    other = 'RECORD_BYTES = 10 /* of ten */\n^IMAGE = ("F.IMG", 301 <BYTES>)\nLINES = 2\nLINE_SAMPLES = 5\nSAMPLE_BITS = 8\nSAMPLE_TYPE = MSB_UNSIGNED_INTEGER\nSCALING_FACTOR = 2.5 <I/F>\nEND\nLINES = 9'
    assert rasters.parse_label(other, "F.IMG") == ("F", 300, 2, 5, 8, True, False, 2.5, 0.0)
    assert rasters.parse_label("RECORD_BYTES = 10\nLABEL_RECORDS = 4\nLINES = 1\nLINE_SAMPLES = 5", "F.IMG")[1] == 40
    assert rasters.parse_label("no label", "F.IMG") is None


def test_ranges_are_tasks(spark, tmp_path):
    frame = np.arange(32 * 20).reshape(32, 20)
    (tmp_path / "a.IMG").write_bytes(rasters.label_text("A", 32, 20, 1.0, 0.0) + frame.astype("<i2").tobytes())
    (tmp_path / "notes.txt").write_bytes(b"no raster")
    found = rasters.read_rasters(spark, str(tmp_path), range_bytes=4 * 40)
    assert found.rdd.getNumPartitions() == 8
    from pyspark.sql import functions as F

    by_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min("line").alias("first"), F.max("line").alias("last")).collect()
    assert len(by_task) == 8 and all(r["n"] == 4 and r["last"] == r["first"] + 3 for r in by_task)
    assert {r["line"]: r["values"] for r in found.collect()} == {k: line.tolist() for k, line in enumerate(frame.astype(float))}


def test_sink_and_back(spark, tmp_path):
    """Missing lines, nulls, short lines, repeated lines, numbers beyond 16 bits, several products, another write beside."""
    path = str(tmp_path / "out")
    rows = [("A", 2, [1, None, 3]), ("A", 0, [40_000, -40_000, 0]), ("A", 0, [40_000, -40_000, 0]), ("B", 1, [7]), ("B", 0, None), (None, 0, [1]), ("C", None, [1])]
    rasters.write_rasters(spark.createDataFrame(rows, "product_id string, line int, values array<int>"), path, 2.0, 1.0)
    rasters.write_rasters(spark.createDataFrame([("D", 0, [5])], "product_id string, line int, values array<int>"), path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")) == ["A.IMG", "B.IMG", "D.IMG"]
    assert not (tmp_path / "out" / "_temporary").exists()
    got = {(r["product_id"], r["line"]): [None if np.isnan(v) else v for v in r["values"]] for r in rasters.read_rasters(spark, path, range_bytes=1).collect()}
    assert got == {("A", 0): [65535.0, None, 1.0], ("A", 1): [None] * 3, ("A", 2): [3.0, None, 7.0], ("B", 0): [None], ("B", 1): [15.0], ("D", 0): [5.0]}


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    path.mkdir()
    bad = spark.createDataFrame([("A", 0, [1]), ("no/such/folder", 0, [1])], "product_id string, line int, values array<int>")
    with pytest.raises(Exception):  # noqa: B017  whatever the store says
        rasters.write_rasters(bad, str(path))
    assert not list(path.glob("*.IMG")) and not (path / "_temporary").exists()
