"""Logs and streams: lines of a scan's log, streams against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from gridquarry.streaming import scanlog

HEAD = "[2026-07-16 10:00:00] INFO PARAMETER CHECK: min_inc: 30.0 | max_inc: 60.0"
TABLE = ["┌──── Plan ────┐", "│ Target ROI  │ 0.00000,{a} 10.00000,{a} │", "│             │ 10.00000,{b} 0.00000,{b} │", "└──────────────┘"]
LOGS = {
    "one": [
        "2026-07-16 09:59:00 before any band: Selected 99 images covering 1.0% of ROI", *[x.format(a="20.00000", b="50.00000") for x in TABLE], HEAD,
        "[10:00:30] QuickMap returned 120 candidate images", "[10:00:40] 3 images selected so far, 40.5% ROI still uncovered", "[10:01:00] Selected 2 images covering 99.1% of ROI",
        "[2026-07-16 10:20:00] NODE COMPLETE: resonant lattice frame M1", "noise", "[2026-07-16 10:40:00] NODE COMPLETE: resonant lattice frame M2",
        "┌ Summary ┐ 1.5,77.7", "└ end ┘", HEAD.replace("10:00:00", "11:00:00"), "[11:05:00] Selected 5 images covering 80.0% of ROI", "[2026-07-16 11:10:00] NODE COMPLETE: resonant lattice frame M3",
    ],
    "two": [
        HEAD, "NODE COMPLETE without a time: lattice frame X", HEAD, "Total Pipeline Execution Time   │ 12.5 s", *[x.format(a="-80.00000", b="-89.99900") for x in TABLE], HEAD.replace("10:00:00", "23:00:00"),
        "Selected 4 images covering 50% of ROI",
    ],
}
# band, planned, done, status: the second run of "one" starts band 7 anew (the table's edges still hold); in "two" bands go in turn
WANT = {("one", 7): (5, 1, "running"), ("two", 0): (4, 0, "running"), ("two", 1): (None, 0, "done")}


def write(tmp_path):
    for name, lines in LOGS.items():
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "0.log").write_text("\n".join(lines) + "\n")


def run(spark, df, mode, name, **options):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).options(**options).start()
    q.awaitTermination(120)
    return spark.table(name)


def states(df):
    return {(r["log"].rsplit("/", 1)[-1], r["band"]): (r["planned"], r["done"], r["status"]) for r in df.collect()}


def test_lines_of_a_log(spark, tmp_path):
    write(tmp_path)
    placed = scanlog.place_events(scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "*"), stream=False)))
    found = scanlog.band_states(placed)
    assert states(found) == WANT
    first = scanlog.band_states(placed.where("run = 1 AND log LIKE '%one'")).first()
    assert (first["band"], first["planned"], first["coverage"], first["candidates"], first["done"], first["status"]) == (7, 2, 99.1, 120, 2, "done")
    assert str(first["first_ts"]) == "2026-07-16 10:00:00" and str(first["last_ts"]) == "2026-07-16 10:40:00"
    assert found.where("log LIKE '%two' AND band = 1").first()["seconds"] == 12.5
    assert scanlog.band_states(placed.limit(0)).count() == 0


def test_band_state_stream(spark, tmp_path):
    """The same states when logs come in two parts and the stream starts again between, wherever the first part ends."""
    for cut in (3, 6, 9):
        path, last = tmp_path / str(cut), {}
        for name in LOGS:
            (path / name).mkdir(parents=True)

        def keep(batch, _, last=last):
            for r in batch.collect():
                last[r["log"].rsplit("/", 1)[-1], r["band"]] = (r["planned"], r["done"], r["status"])

        for k in range(2):
            for name, lines in LOGS.items():
                (path / name / f"{k}.log").write_text("\n".join(lines[cut:] if k else lines[:cut]) + "\n")
            stream = scanlog.band_state_stream(scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(path / "*"))))
            stream.writeStream.outputMode("update").option("checkpointLocation", str(path / "marks")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(120)
        assert last == WANT


def test_silent_logs_are_forgotten(spark, tmp_path):
    """A timer ends a log that fell silent, when the other log's line makes a batch: its next line stands before any run."""
    quiet, got = "spark.sql.streaming.noDataMicroBatches.enabled", []
    before = spark.conf.get(quiet)
    spark.conf.set(quiet, "false")
    try:
        for k, (log, line) in enumerate([("a", HEAD), ("a", "NODE COMPLETE: lattice frame M1"), ("b", HEAD), ("a", "NODE COMPLETE: lattice frame M1"), ("b", "NODE COMPLETE: lattice frame M1")]):
            (tmp_path / log).mkdir(exist_ok=True)
            (tmp_path / log / f"{k}.log").write_text(line + "\n")
            stream = scanlog.band_state_stream(scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "[ab]"))), forget="1 ms" if k == 1 else "1 days")
            out = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True)
            out.foreachBatch(lambda b, _, k=k: got.extend((k, r["log"][-1], r["done"]) for r in b.collect())).start().awaitTermination(60)
    finally:
        spark.conf.set(quiet, before)
    assert got == [(0, "a", 0), (1, "a", 1), (2, "b", 0), (4, "b", 1)]


def test_throughput_stream(spark, tmp_path):
    write(tmp_path)
    events = scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "*"))).where("kind IS NOT NULL")
    got = run(spark, scanlog.throughput_stream(events), "append", "hours").collect()
    batch = scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "*"), stream=False)).where("kind IS NOT NULL AND ts < '2026-07-16 22:00'")
    assert sum(r["n"] for r in got) == batch.count()  # all but the last hour, which is open until the watermark passes it
    nodes = sorted((r["ts"], r["at"], r["arg"]) for r in batch.where("kind = 'node_complete'").collect())
    assert sum(r["nodes"] for r in got) == len(nodes) > 0
    for r in got:
        own = [arg for ts, _, arg in nodes if r["start"] <= ts < r["end"]]
        assert r["last_product"] == (own[-1] if own else None)
        assert r["hours_a_thousand"] == (pytest.approx(1000 / len(own)) if own else None)


def test_band_state_stream_equals_batch(spark, tmp_path):
    """A long log of many runs, cut at random lines, with a restart at each cut."""
    rng, lines = random.Random(3), []
    for k in range(40):
        if rng.random() < 0.4:
            a, b = scanlog.BANDS[rng.randrange(10)]
            lines += [x.format(a=f"{a:.5f}", b=f"{b:.5f}") for x in TABLE]
        lines.append(HEAD.replace("10:00:00", f"{k % 24:02d}:00:00"))
        for _ in range(rng.randrange(30)):
            lines.append(rng.choice(["noise", "[10:01:00] Selected {n} images covering 9.1% of ROI", "[2026-07-16 10:20:{n:02d}] NODE COMPLETE: lattice frame M1", "NODE COMPLETE: lattice frame M2", "Total Pipeline Execution Time │ 12.5 s" if rng.random() < 0.2 else "x"]).format(n=rng.randrange(1, 20)))
    cuts = sorted(rng.sample(range(1, len(lines)), 3))
    (tmp_path / "log").mkdir()
    last = {}

    def keep(batch, _):
        for r in batch.collect():
            last[r["band"]] = (r["planned"], r["done"], r["status"], r["last_ts"])

    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        (tmp_path / "log" / f"{k}.log").write_text("\n".join(lines[a:b]) + "\n")
        stream = scanlog.band_state_stream(scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "log"))))
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(120)
    batch = scanlog.band_states(scanlog.place_events(scanlog.parse_scan_log(scanlog.read_scan_log(spark, str(tmp_path / "log"), stream=False))))
    assert last == {r["band"]: (r["planned"], r["done"], r["status"], r["last_ts"]) for r in batch.collect()}
    assert len(last) > 5


def test_ingest_twice(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 3)], "product_id string, tile_id int").withColumn("ts", F.timestamp_seconds("tile_id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        scanlog.incremental_ingest(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("since", ["last", "ever"])
def test_new_arrivals(spark, tmp_path, since):
    """Sweeps months apart, in several batches, some of them run twice; b is away in the third sweep."""
    sweeps = {1: "ab", 2: "abc", 3: "ac", 4: "abcd", 5: "abcd", 6: "abcde"}
    batches = [[(1, "a"), (1, "a"), (1, "b")], [(2, x) for x in sweeps[2]] + [(3, "a")], [(3, "c"), (None, "x"), (4, None)], [(2, "z"), *[(k, x) for k in (4, 5) for x in sweeps[k]]], [(6, x) for x in sweeps[6]]]
    told = []

    def sink(new, number):
        told.append((number, sorted((r["sweep"], r["key"]) for r in new.collect())))

    for number, rows in enumerate(batches):
        df = spark.createDataFrame([(x, s) for s, x in rows], "key string, sweep int")
        for _ in range(2):  # again, as after a restart
            scanlog.new_arrivals(sink, str(tmp_path / "known"), "key", since=since)(df, number)
    assert all(told[k] == told[k + 1] for k in range(0, len(told), 2))
    back = [(4, "b")] if since == "last" else []
    assert sorted(x for _, new in told[::2] for x in new) == sorted([(1, "a"), (1, "b"), (2, "c"), *back, (4, "d"), (6, "e")])
    scanlog.new_arrivals(sink, str(tmp_path / "none"), "key", since=since)(df.limit(0), 0)
    assert told[-1] == (0, [])


def test_late_rows_are_split(spark, tmp_path):
    kept, late = [], []
    make = lambda: scanlog.split_late(lambda d, _: kept.extend(d.collect()), lambda d, _: late.extend(d.collect()), str(tmp_path / "times"))
    at = lambda *s: spark.sql("SELECT timestamp(col1) AS ts FROM VALUES " + ", ".join(f"('2024-01-01 {x}')" for x in s))
    make()(at("12:00:00"), 0)
    for _ in range(2):  # after a restart, and again: the batch's own times do not count
        kept.clear(), late.clear()
        make()(at("11:45:00", "11:55:00", "12:10:00"), 1)
        assert len(kept) == 2 and len(late) == 1
    make()(spark.sql("SELECT CAST(NULL AS timestamp) AS ts UNION ALL SELECT timestamp'2024-01-01 11:59:00'"), 2)
    assert len(kept) == 3 and len(late) == 2
