"""Raster files with attached labels: read by ranges of lines, written by a data source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.raster import INVALID

#: What a label tells of a raster.
LABEL = "product_id string, header_bytes long, lines int, samples int, bits int, msb boolean, signed boolean, scale double, offset double"
#: Bytes at the start of a file in which its label is looked for.
LABEL_BYTES = 1 << 16


def _opened(path: str) -> tuple:
    """(file system, path in it) of a path as Spark writes it. Executors open files by themselves, so the store must be one that
    pyarrow.fs knows: a shared or mounted folder, or an object or HDFS store."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def parse_label(text: str, name: str) -> tuple | None:
    """The fields of LABEL from lines KEY = VALUE of an attached label, or None without lines and samples. The first of equal keys
    counts; units in angle brackets, quotes and comments are left out. The raster begins at record ^IMAGE (from 1), or at a byte
    of that number, or after LABEL_RECORDS; product_id is the file's stem if the label has none."""
    found: dict[str, str] = {}
    for line in text.split("\n"):
        key, mark, value = line.partition("=")
        if key.strip() == "END" and not mark:
            break
        if mark:
            found.setdefault(key.strip().upper(), re.sub(r"/\*.*?\*/", "", value).strip().strip('"'))
    number = lambda key, other: float(re.sub(r"<.*?>", "", found[key])) if key in found else other
    try:
        lines, samples, bits = (int(number(k, d)) for k, d in (("LINES", None), ("LINE_SAMPLES", None), ("SAMPLE_BITS", 16)))
        record, pointer = int(number("RECORD_BYTES", 1)), found.get("^IMAGE", "")
        at = re.match(r"\D*(\d+)\D*$", re.sub(r'^\(?\s*"[^"]*"\s*,', "", pointer))
        start = int(number("LABEL_RECORDS", 0)) * record if at is None else (int(at[1]) - 1) * (1 if "BYTES" in pointer.upper() else record)
        scale, offset = number("SCALING_FACTOR", 1.0), number("OFFSET", 0.0)
    except (TypeError, ValueError):
        return None
    kind = found.get("SAMPLE_TYPE", "LSB_INTEGER").upper()
    return found.get("PRODUCT_ID", name.rsplit(".", 1)[0]), start, lines, samples, bits, "MSB" in kind, "UNSIGNED" not in kind, scale, offset


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path and LABEL's fields of each raster file under path; files without a label are left out. Only the first LABEL_BYTES of a
    file are read, in tasks."""
    fields = [f.split()[0] for f in LABEL.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [types[f.split()[1]] for f in LABEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for name in batch.column("path").to_pylist():
                store, place = _opened(name)
                with store.open_input_stream(place) as file:
                    found = parse_label(file.read(LABEL_BYTES).decode("latin-1"), name.rsplit("/", 1)[-1])
                if found is not None:
                    kept.append(name)
                    rows.append(found)
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), *columns], ["path", *fields])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, f"path string, {LABEL}")


def read_rasters(spark: SparkSession, path: str, labels: DataFrame | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """Frames of raster files as stripes of one line: product_id, line, values (scaled; NaN where a pixel is missing).

    labels: file (its name) and LABEL's fields; without labels, files have attached ones (read_labels). Files without a label, and
    labels without a file, are left out; of equal product ids all stay. A file is cut into ranges of whole lines of about
    range_bytes, which are dealt out evenly, a task each, so a large file is read by many tasks and none holds more than some
    lines. Lines that a short file lacks are missing."""
    if labels is None:
        known = read_labels(spark, path)
    else:
        files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
        known = files.join(labels, "file").drop("file")
    line = F.greatest(F.col("samples") * F.col("bits") / 8, F.lit(1))
    step = F.greatest(F.floor(range_bytes / line), F.lit(1)).cast("int")
    fine = known.where("lines > 0 AND samples > 0").withColumn("step", step)
    ranges = fine.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("lines") - 1, F.col("step"))))
    n = fine.agg(F.sum(F.ceil(F.col("lines") / F.col("step")))).first()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = np.dtype(f"{'>' if r['msb'] else '<'}{'i' if r['signed'] else 'u'}{r['bits'] // 8}")
                width, stop = r["samples"] * kind.itemsize, min(r["first"] + r["step"], r["lines"])
                store, place = _opened(r["path"])
                with store.open_input_file(place) as file:
                    file.seek(min(r["header_bytes"] + r["first"] * width, file.size()))
                    for at in range(r["first"], stop, 256):
                        raw = file.read(min(256, stop - at) * width)
                        got = len(raw) // width
                        part = np.frombuffer(raw[: got * width], kind).reshape(got, r["samples"]).astype(float)
                        values = np.where(part > INVALID, part * r["scale"] + r["offset"], np.nan)
                        held = pa.ListArray.from_arrays(pa.array(np.arange(got + 1, dtype=np.int32) * r["samples"]), pa.array(values.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([r["product_id"]] * got, pa.string()), pa.array(np.arange(at, at + got, dtype=np.int32)), held], ["product_id", "line", "values"])
                        if got < min(256, stop - at):
                            break

    return ranges.repartition(max(1, int(n or 0))).mapInArrow(read, "product_id string, line int, values array<double>")


def label_text(product_id: str, lines: int, samples: int, scale: float, offset: float) -> bytes:
    """A label for signed 16-bit lines, low byte first, filled with spaces to whole records, each of a line's length."""
    record, records = 2 * samples, 1
    while True:
        text = "\r\n".join([
            "PDS_VERSION_ID = PDS3", f"RECORD_BYTES = {record}", f"LABEL_RECORDS = {records}", f"^IMAGE = {records + 1}", f'PRODUCT_ID = "{product_id}"', "OBJECT = IMAGE",
            f"LINES = {lines}", f"LINE_SAMPLES = {samples}", "SAMPLE_BITS = 16", "SAMPLE_TYPE = LSB_INTEGER", f"SCALING_FACTOR = {scale!r}", f"OFFSET = {offset!r}", "END_OBJECT = IMAGE", "END", "",
        ]).encode()
        if len(text) <= records * record:
            return text.ljust(records * record)
        records = -(-len(text) // record)


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _RasterWriter(DataSourceWriter):
    """Tasks write whole files aside; commit moves them to their place, abort removes them, so a failed or repeated task leaves none."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, rows: Iterator) -> _Written:
        import uuid

        store, place = _opened(self.path)
        aside = f"{place}/_temporary/{uuid.uuid4().hex}"
        store.create_dir(aside)
        moves = []
        for product, own in groupby(rows, key=lambda r: r["product_id"]):
            name, at = f"{product}.IMG", 0
            with store.open_output_stream(f"{aside}/{name}") as file:
                for r in own:
                    if not at:
                        file.write(label_text(product, r["lines"], r["samples"], r["scale"], r["offset"]))
                    line = np.full(r["samples"], INVALID, "<i2")
                    file.write(line.tobytes() * (r["line"] - at))  # lines that were not given
                    given = np.array([INVALID if v is None else v for v in r["values"][: r["samples"]]], np.int64)
                    line[: len(given)] = np.clip(given, INVALID, 2**15 - 1)
                    file.write(line.tobytes())
                    at = r["line"] + 1
                file.write(np.full(r["samples"] * max(r["lines"] - at, 0), INVALID, "<i2").tobytes())
            moves.append((f"{aside}/{name}", f"{place}/{name}"))
        return _Written(moves)

    def commit(self, messages: list) -> None:
        store, place = _opened(self.path)
        for message in messages:
            for aside, name in message.moves if message else []:
                store.move(aside, name)
        self._clear(store, place)

    def abort(self, messages: list) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _clear(store, place: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{place}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{place}/_temporary")


class RasterSink(DataSource):
    """Rasters as a place to write to: spark.dataSource.register(RasterSink), then df.write.format("rasters").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return "product_id string, lines int, samples int, scale double, offset double, line int, values array<int>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RasterWriter(self.options["path"])


def write_rasters(stripes: DataFrame, path: str, scale: float = 1.0, offset: float = 0.0) -> None:
    """stripes (product_id, line from 0, values: whole numbers) as one file a product under path, product_id.IMG, with an attached
    label and signed 16-bit lines, as long as the product's longest.

    Missing lines, nulls and what a short line lacks become the number that stands for no pixel; larger numbers are cut to 16
    bits. Rows without product or line are left out; of equal lines of a product one is written. A file is written by one
    task, line by line, and stands in its place only when all are written."""
    rows = stripes.where("product_id IS NOT NULL AND line IS NOT NULL").select("product_id", F.col("line").cast("int").alias("line"), F.col("values").cast("array<int>").alias("values"))
    rows = rows.dropDuplicates(["product_id", "line"])
    sizes = rows.groupBy("product_id").agg((F.max("line") + 1).alias("lines"), F.greatest(F.max(F.size("values")), F.lit(1)).alias("samples"))
    placed = rows.join(sizes, "product_id").repartition("product_id").sortWithinPartitions("product_id", "line")
    stripes.sparkSession.dataSource.register(RasterSink)
    columns = ["product_id", "lines", "samples", F.lit(float(scale)).alias("scale"), F.lit(float(offset)).alias("offset"), "line", F.coalesce("values", F.array().cast("array<int>")).alias("values")]
    placed.select(*columns).write.format("rasters").mode("append").save(path)
