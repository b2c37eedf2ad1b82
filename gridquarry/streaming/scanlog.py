"""A scan's log: typed events, the bands they belong to, the state of bands, windows of throughput, late rows; batch and stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import stage

# The lines that matter, by kind, with what is kept of each.
PATTERNS = {
    "start": r"PARAMETER CHECK.*max_inc:\s*([\d.]+)",
    "candidates": r"QuickMap returned (\d+) candidate images",
    "selected": r"Selected (\d+) images covering ([\d.]+)% of ROI",
    "node_complete": r"NODE COMPLETE.*lattice frame (\S+)",
    "solver": r"(\d+) images selected so far, ([\d.]+)% ROI still uncovered",
    "pipeline_time": r"Total Pipeline Execution Time\s+[│|]+\s+([\d.]+)\s+s",
}
# A time of day with or without its date, pairs of longitude and latitude, and the corners that open and close a table.
TIME, PAIR, OPENS, CLOSES, REGION = r"\[?(\d{4}-\d{2}-\d{2}\s+)?(\d{2}:\d{2}:\d{2})\]?", r"(-?\d+\.\d+),(-?\d+\.\d+)", "┌", "└", "Target ROI"
# The bands of latitude of a global scan, and the day of lines that name none.
BANDS = [(-89.999, -80.0), (-80.0, -50.0), (-50.0, -20.0), (-20.0, -10.0), (-10.0, 0.0), (0.0, 10.0), (10.0, 20.0), (20.0, 50.0), (50.0, 80.0), (80.0, 89.999)]
DAY = "2026-07-16"


def read_scan_log(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Lines of logs: log (the folder of a line's file), at (its place: files by name, then by place in the file), value. A folder
    is one log, in one or several files, whose names are in order of time.

    As a stream, Spark's checkpoint remembers which files were read. A file comes as one row and is split in its task, so a
    log that still grows is cut into files of some MB, at line ends; in batch, files may have any size."""
    file = F.col("_metadata.file_path")
    log, name = F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("log"), F.element_at(F.split(file, "/"), -1).alias("file")
    if stream:
        whole = spark.readStream.format("text").option("wholetext", True).load(path).select(log, name, F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("row", "value"))
        return whole.select("log", F.struct("file", F.lit(0).cast("long").alias("block"), F.col("row").cast("long").alias("row")).alias("at"), "value")
    at = F.struct(name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(log, at.alias("at"), "value")


def parse_scan_log(lines: DataFrame) -> DataFrame:
    """log, at, ts, kind, arg, share of each line of a known form, and of lines of tables opens, region, closes and lats (latitudes
    in the line); other lines are left out. Each line is read by itself. lines: log, at, value; batch or stream."""
    kind, arg, share = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, pattern in reversed(PATTERNS.items()):
        hit = F.col("value").rlike(pattern)
        kind, arg = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract("value", pattern, 1)).otherwise(arg)
        if pattern.count("(") > 1:
            share = F.when(hit, F.regexp_extract("value", pattern, 2).try_cast("double")).otherwise(share)
    day = F.coalesce(F.nullif(F.trim(F.regexp_extract("value", TIME, 1)), F.lit("")), F.lit(DAY))
    ts = F.concat(day, F.lit(" "), F.regexp_extract("value", TIME, 2)).try_cast("timestamp")
    lats = F.transform(F.regexp_extract_all("value", F.lit(PAIR), F.lit(2)), lambda x: x.cast("double"))
    rows = lines.select(
        "log", "at", ts.alias("ts"), kind.alias("kind"), arg.alias("arg"), share.alias("share"), F.contains("value", F.lit(OPENS)).alias("opens"),
        F.contains("value", F.lit(REGION)).alias("region"), F.contains("value", F.lit(CLOSES)).alias("closes"), lats.alias("lats"),
    )
    return rows.where("kind IS NOT NULL OR opens OR region OR closes OR size(lats) > 0")


def _band(low: Column, high: Column, starts: Column) -> Column:
    """The first band, from 0, whose edges lie within 0.1 of low and high; without one, the bands in turn."""
    band = F.pmod(starts - 1, F.lit(len(BANDS))).cast("int")
    for k, (a, b) in reversed(list(enumerate(BANDS))):
        band = F.when((F.abs(low - a) < 0.1) & (F.abs(high - b) < 0.1), k).otherwise(band)
    return band


def place_events(events: DataFrame) -> DataFrame:
    """Events (of parse_scan_log, batch) with run and band: the parameter check before a line starts a run of a band, which the
    latitudes of the last table of a region tell. Lines before the first run are left out.

    Each log is put in order by itself, after all but the lines that matter have gone."""
    log = Window.partitionBy("log").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy("log", "table").orderBy("at")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("table", F.sum(F.col("opens").cast("int")).over(log))
    on = F.max("region").over(upto) & ~F.coalesce(F.max("closes").over(before), F.lit(False))
    rows = rows.withColumn("lats", F.when(on, F.col("lats")))
    edges = F.struct(F.min(F.array_min("lats")).over(upto).alias("low"), F.max(F.array_max("lats")).over(upto).alias("high"))
    rows = rows.withColumn("edges", edges).withColumn("edges", F.when(F.col("closes") & F.col("edges.low").isNotNull(), F.col("edges")))
    rows = rows.withColumn("edges", F.last("edges", ignorenulls=True).over(log)).withColumn("run", F.count(F.when(F.col("kind") == "start", 1)).over(log))
    band = F.when(F.col("kind") == "start", _band(F.col("edges.low"), F.col("edges.high"), F.col("run")))
    rows = rows.withColumn("band", F.last(band, ignorenulls=True).over(log)).where("run > 0 AND kind IS NOT NULL")
    return rows.select("log", "at", "ts", "kind", "arg", "share", "run", "band")


def band_states(placed: DataFrame) -> DataFrame:
    """Of place_events, one row per log and band, of its last run: planned, coverage, candidates, done, seconds, status, first_ts, last_ts.

    Done when as many nodes are complete as images were selected, or a pipeline time was logged; else running."""
    k = F.col("kind")
    w = Window.partitionBy("log", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far, planned = F.count(F.when(k == "node_complete", 1)).over(w), F.last(F.when(k == "selected", F.col("arg").cast("long")), ignorenulls=True).over(w)
    rows = placed.withColumn("full", (planned > 0) & (so_far >= planned))
    last = lambda kind, what: F.max_by(F.when(k == kind, what), F.when((k == kind) & what.isNotNull(), F.col("at")))
    per = rows.groupBy("log", "run", "band").agg(
        last("selected", F.col("arg")).cast("long").alias("planned"), last("selected", F.col("share")).alias("coverage"), last("candidates", F.col("arg")).cast("long").alias("candidates"),
        F.count(F.when(k == "node_complete", 1)).alias("done"), last("pipeline_time", F.col("arg")).cast("double").alias("seconds"),
        F.max(F.coalesce("full", F.lit(False))).alias("full"), F.min_by("ts", "at").alias("first_ts"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("at"))).alias("last_ts"),
    )
    status = F.when(F.col("full") | F.col("seconds").isNotNull(), "done").otherwise("running")
    row = F.struct("planned", "coverage", "candidates", "done", "seconds", status.alias("status"), "first_ts", "last_ts")
    return per.groupBy("log", "band").agg(F.max_by(row, "run").alias("s")).select("log", "band", "s.*")


#: A log's place between batches: edges of the last table, whether a table is open at its region and the latitudes in it so far,
#: runs begun, and the band of the last.
_PLACE = "low double, high double, open boolean, least double, most double, runs int, band int"
#: A band's counters, of its last run.
_BAND = "planned long, done long, finished boolean, last timestamp"


def _band_number(low: float | None, high: float | None, runs: int) -> int:
    """As _band, in a task."""
    for k, (a, b) in enumerate(BANDS):
        if low is not None and abs(low - a) < 0.1 and abs(high - b) < 0.1:
            return k
    return (runs - 1) % len(BANDS)


class _BandProcessor(StatefulProcessor):
    """Follows each log: a value state for its place, a map state of counters by band, and a timer that forgets logs that fell
    silent."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _PLACE)
        self.bands = handle.getMapState("bands", "band int", _BAND)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        events = pd.concat(list(rows), ignore_index=True)
        at = pd.DataFrame([tuple(a.values()) if isinstance(a, dict) else tuple(a) for a in events["at"]])
        events = events.iloc[np.lexsort([at[c] for c in reversed(at.columns)])].reset_index(drop=True)
        low, high, is_open, least, most, runs, band = self.place.get() if self.place.exists() else (None, None, False, None, None, 0, None)

        # the lines that open, fill and close tables and start runs are few; they cut the others into stretches of one band
        stretches, begin = [], 0
        lats, opens, region, closes, kind = (events[c].to_numpy() for c in ("lats", "opens", "region", "closes", "kind"))
        marks = np.flatnonzero(opens | region | closes | (kind == "start") | np.array([x is not None and len(x) > 0 for x in lats], bool))
        for k in marks.tolist():
            if opens[k]:
                is_open, least, most = False, None, None
            is_open = bool(is_open or region[k])
            if is_open and len(lats[k]):
                own = [float(x) for x in lats[k]]
                least, most = min(own + ([least] if least is not None else [])), max(own + ([most] if most is not None else []))
            if closes[k]:
                if least is not None:
                    low, high = least, most
                is_open = False
            if kind[k] == "start":
                stretches.append((band, begin, k, False))
                runs, begin = runs + 1, k
                band = _band_number(low, high, runs)
                stretches.append((band, k, k, True))  # a run starts anew
        stretches.append((band, begin, len(events), False))
        self.place.update((low, high, is_open, least, most, runs, band))

        held: dict[int, list] = {}
        number = pd.to_numeric(events["arg"].where(kind == "selected"), errors="coerce").to_numpy()
        ts = events["ts"].to_numpy()
        for band, begin, end, anew in stretches:
            if band is None or (begin == end and not anew):
                continue
            if anew:
                held[band] = [None, 0, False, None]
                continue
            if band not in held:
                held[band] = list(self.bands.getValue((band,))) if self.bands.containsKey((band,)) else [None, 0, False, None]
            self._count(held[band], kind[begin:end], number[begin:end], ts[begin:end])
        for band, counters in held.items():
            self.bands.updateValue((band,), tuple(counters))
        names = sorted(held)
        yield pd.DataFrame({
            "log": pd.Series([key[0]] * len(names), dtype=object), "band": pd.array(names, "Int32"), "planned": pd.array([held[b][0] for b in names], "Int64"), "done": pd.array([held[b][1] for b in names], "Int64"),
            "status": pd.Series(["done" if held[b][2] else "running" for b in names], dtype=object), "last_ts": pd.to_datetime([held[b][3] for b in names]),
        })

    @staticmethod
    def _count(counters: list, kind: np.ndarray, number: np.ndarray, ts: np.ndarray) -> None:
        """A stretch of one run's lines, by columns."""
        planned, done, finished, last = counters
        nodes = kind == "node_complete"
        so_far = done + np.cumsum(nodes)
        known = pd.Series(np.concatenate([[np.nan if planned is None else planned], number])).ffill().to_numpy()[1:]
        full = bool(((known > 0) & (so_far >= known)).any())
        matters = ts[(kind != None) & ~pd.isna(ts)]  # noqa: E711  by element
        counters[:] = [
            planned if not len(known) or np.isnan(known[-1]) else int(known[-1]), int(done + nodes.sum()), bool(finished or full or (kind == "pipeline_time").any()),
            pd.Timestamp(matters[-1]).to_pydatetime() if len(matters) else last,
        ]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.place.clear()
        self.bands.clear()
        return iter(())

    def close(self) -> None:
        pass


def band_state_stream(events: DataFrame, forget: str | None = None) -> DataFrame:
    """band_states as a stream, over parse_scan_log: log, band, planned, done, status, last_ts of every band that a batch touched.

    A log's state is its place and, by band, a few counters, so it has a bounded size whatever the log's length; it is kept in
    Spark's RocksDB state store, which this session is set to. Files of a log must come in order of their names, and a
    batch's lines of a log are put in order in one task (maxFilesPerTrigger bounds them). With forget, a log without a line
    for that long, by the clock, is forgotten: lines that come later are those of a new log. Timers make Spark run batches
    without data, so a stream that should end by itself needs spark.sql.streaming.noDataMicroBatches.enabled = false."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    forget_ms = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)
    schema = "log string, band int, planned long, done long, status string, last_ts timestamp"
    return events.groupBy("log").transformWithStateInPandas(_BandProcessor(forget_ms), schema, "Update", "None" if forget is None else "ProcessingTime")


def throughput_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Of each window of event time, final once the watermark has passed: start, end, n (events), nodes (completed), last_product (of
    the latest of these, by time and then by place; null without) and hours_a_thousand (at the window's pace; null without).

    events: as of parse_scan_log. A window's state is a few numbers and one product."""
    node = F.col("kind") == "node_complete"
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.count(F.when(node, 1)).alias("nodes"), F.max_by("arg", F.when(node, F.struct("ts", "at"))).alias("last_product")
    )
    hours = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 3600
    return windows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "nodes", "last_product", F.when(F.col("nodes") > 0, hours * 1000 / F.col("nodes")).alias("hours_a_thousand"))


def session_stream(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def split_late(sink: Callable[[DataFrame, int], None], rejects: Callable[[DataFrame, int], None], state: str, late_s: int = 600) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows older than the latest time of batches before, by more than late_s, go to rejects.

    The latest time of each batch is written under state, a shared folder, by the batch's number, so it outlives a restart
    and a batch that is run again is split as the first time. Rows without a time are not late."""

    def run(batch: DataFrame, number: int) -> None:
        known = _exists(batch.sparkSession, state)
        limit = batch.sparkSession.read.schema("newest timestamp, number long").parquet(state).where(F.col("number") < number).agg(F.max("newest")).first()[0] if known else None
        old = F.lit(False) if limit is None else F.coalesce(F.col("ts") < F.lit(limit) - F.expr(f"INTERVAL {late_s} SECONDS"), F.lit(False))
        sink(batch.where(~old), number)
        rejects(batch.where(old), number)
        batch.agg(F.max(F.col("ts").cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{state}/number={number}")

    return run


def new_arrivals(sink: Callable[[DataFrame, int], None], state: str, key: str = "volume_id", sweep: str = "sweep", since: str = "last") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over snapshots (key, sweep: a number or time that rises): sink gets, for every sweep, the keys that the
    sweep before it did not hold (key, sweep; each once), however long ago that was.

    since "last" compares with the last sweep alone, so a key that was gone for a sweep is new when it comes back; "ever" with
    all sweeps. In the first sweep all keys are new. A batch may hold several sweeps, and a sweep may come in several batches;
    rows of sweeps that were over in an earlier batch tell nothing new and are left out. Rows without key or sweep are left out.

    What must be known is a table of keys under state, a shared folder, by the batch's number: for "last" the keys of the two
    newest sweeps, for "ever" each key with its first sweep. A batch reads that of the one before it and writes its own, so it
    outlives restarts, and a batch that is run again announces the same and writes the same. Keys are joined, never gathered."""
    if since not in ("last", "ever"):
        raise ValueError(f"no such choice: {since}")

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(key).alias("key"), F.col(sweep).alias("sweep")).where("key IS NOT NULL AND sweep IS NOT NULL").distinct()
        spark, before = batch.sparkSession, f"{state}/number={number - 1}"
        known = spark.read.schema(rows.schema).parquet(before) if number and _exists(spark, before) else spark.createDataFrame([], rows.schema)
        newest = known.agg(F.max("sweep").alias("newest"))
        known = known.where("key IS NOT NULL")  # the row without a key tells the newest sweep
        rows = stage(rows.join(F.broadcast(newest)).where("newest IS NULL OR sweep >= newest").drop("newest"), "sweep")  # newest is one row
        every = stage(known.unionByName(rows).distinct(), "known")
        if since == "ever":
            kept = every.groupBy("key").agg(F.min("sweep").alias("sweep"))
            new = rows.join(kept, ["key", "sweep"], "left_semi")
        else:
            order = Window.orderBy("sweep")
            sweeps = every.select("sweep").distinct()  # a row for each sweep of the batch, and two
            following = sweeps.withColumn("next", F.lead("sweep").over(order))
            held = every.join(F.broadcast(following), "sweep").where("next IS NOT NULL").select("key", F.col("next").alias("sweep"))
            new = rows.join(held, ["key", "sweep"], "left_anti")
            kept = every.join(F.broadcast(sweeps.orderBy(F.desc("sweep")).limit(2)), "sweep", "left_semi")
        new = new.join(known, ["key", "sweep"], "left_anti")  # a sweep's earlier batch has told it
        sink(new.select(F.col("key").alias(key), F.col("sweep").alias(sweep)), number)
        last = rows.select("sweep").unionByName(newest.toDF("sweep")).agg(F.max("sweep").alias("sweep"))
        kept = kept.select("key", "sweep").unionByName(last.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "sweep"))
        kept.write.mode("overwrite").parquet(f"{state}/number={number}")

    return run


def incremental_ingest(tiles: DataFrame, path: str, checkpoint: str):
    """Write each batch's products to a tile index unless they are there; returns the query. Every available file is read once."""
    from ..sources.tables import write_tile_index

    return tiles.writeStream.foreachBatch(lambda batch, _: write_tile_index(batch, path) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
