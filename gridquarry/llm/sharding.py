"""Sharding: a two-pass external shuffle. Seeded hashes scatter records into memory-sized buckets, each is Fisher-Yates shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_join, stage


def shard_of(key: Column, shards: int) -> Column:
    """The shard with the largest hash of key and shard number: one more shard takes rows from all others, only into itself."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(s)).alias("hash"), F.lit(s).alias("shard")) for s in range(shards)]))["shard"]


def shuffle_into_shards(
    df: DataFrame,
    shards: int = 8,
    law: str = "rows",
    seed: int = 11,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of df in random order, dealt to shards: df's columns in struct "record", then shard, slot (gapless from 0).

    Pass 1 scatters whole records by seeded hash into buckets of about bucket_bytes of text (set it to what one task can
    hold several times over). Pass 2 shuffles each bucket with shuffle(), Spark's Fisher-Yates, and numbers its records
    after those of the buckets before. Law "rows": records are dealt to the shards in turn, so counts differ by one at
    most. Law "key": the id and the shard count decide (largest hash of id and shard), so one more shard takes records
    only into itself. In both, copies of a text are spread, since order is random.

    The buckets are written as a table in the shared folder; what follows reads it. The hash covers the id, the text and the
    record's place in the input, so repeated or null ids fill no bucket. A single text above bucket_bytes is a record like others. Null texts have no bytes. Empty tables give empty results;
    the record is a struct, so names in it cannot clash. Order depends on the seed and on how the input is split."""
    if law not in ("rows", "key"):
        raise ValueError(f"no such law: {law}")
    n_bytes = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(64))).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    records = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    text = F.coalesce(F.col(f"record.{text_col}"), F.lit("")).cast("binary")
    draw = F.xxhash64(F.lit(seed), F.col(f"record.{id_col}"), F.crc32(text), F.monotonically_increasing_id())
    by_draw = lambda x, y: F.when(x["draw"] < y["draw"], -1).when(x["draw"] > y["draw"], 1).otherwise(0)
    scattered = records.withColumn("draw", draw).withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(buckets)).cast("int"))
    held = scattered.groupBy("bucket").agg(F.collect_list(F.struct("draw", "record")).alias("held"))
    # one row per bucket; a fixed order of rows and of records makes a repeated task draw the same
    held = held.sortWithinPartitions("bucket").withColumn("held", F.array_sort("held", by_draw))
    shuffled = held.select("bucket", F.posexplode(F.shuffle("held", seed)).alias("at", "one")).select("bucket", "at", "one.record")
    if law == "key":
        shuffled = shuffled.withColumn("shard", shard_of(F.col(f"record.{id_col}"), shards))
    shuffled = stage(shuffled, "buckets")
    key = ["shard"] if law == "key" else []
    counts = shuffled.groupBy("bucket", *key).count()
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select("bucket", *key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")), "starts")
    if law == "key":
        shuffled = shuffled.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("at")) - 1)
    # a row of starts is two or three numbers
    found = small_join(shuffled, starts, ["bucket", *key], bound=1_000_000).withColumn("index", F.col("start") + F.col("at"))
    if law == "key":
        return found.select("record", "shard", F.col("index").alias("slot"))
    return found.select("record", F.pmod("index", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("index") / shards).alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The records of shuffle_into_shards under path/shard=N, files in order of slot."""
    found = shuffle_into_shards(df, **options)
    size = 1 << 17
    found = found.withColumn("part", F.floor(F.col("slot") / size)).repartition("shard", "part").sortWithinPartitions("shard", "slot")
    found.select("record.*", "shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """documents in shards 0 to 7 by law "rows"."""
    found = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return found.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
