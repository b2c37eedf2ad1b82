"""What the operators of this subpackage share: scratch tables, ASCII lower case, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stage  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that separate words of running text, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of texts, about. Batches of Spark's default, 10,000 rows or 64 MB, stand several times in a task: off
#: the heap of the JVM on the way there and back, and in Python.
BATCH_BYTES = 4 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_texts(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(function, schema) in batches of about BATCH_BYTES (or one row, if that is longer). The bound is a setting of
    df's session, which is lowered if it is larger."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2. A null id counts as empty text, so it is never held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", bound: int = 20_000) -> DataFrame:
    """Broadcasts right if it has bound rows at most (counted, so give a staged table); a shuffled join otherwise."""
    return left.join(F.broadcast(right) if right.limit(bound + 1).count() <= bound else right, on, how)


def row_key(id_: Column, text: Column) -> Column:
    """A row's id and text in 32 characters; order by it is order by nothing in particular."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), id_.cast("string")), F.lit("")), F.lit("/"), F.coalesce(text, F.lit(""))))


def keep_one(df: DataFrame, key: str, gone: DataFrame, several: DataFrame) -> DataFrame:
    """df without the rows whose key is in gone (key), and with one row of each key in several (key), which all have it more
    than once. Both are written first. Rows stay where they are, but for those of several, or if gone is large."""
    gone, several = (stage(t.select(F.col("key").alias(key)), "keys") for t in (gone, several))
    left = small_join(df, gone, [key], "left_anti", bound=200_000)
    if several.isEmpty():
        return left
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = small_join(left, several, [key], "left_semi", bound=200_000).select(F.col(key).alias("k"), record.alias("r")).groupBy("k").agg(F.first("r").alias("r"))
    return small_join(left, several, [key], "left_anti", bound=200_000).unionByName(one.select("r.*"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: (node, component), component being its smallest node.

    Each round hooks every component to its smallest neighbour, then halves the resulting trees by pointer jumping
    until they are stars, then contracts the edges. At least half of the touched components vanish per round, and
    every table is shuffled by node; nothing is gathered. Null ends are ignored; an empty table gives no rows."""
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        while True:
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hooks = stage(hooks.join(up, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "jump")
            if hooks.where("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.select("a", "to")
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            labels = stage(
                labels.join(hooks.withColumnRenamed("a", "component"), "component", "left")
                .select("node", F.coalesce("to", "component").alias("component")),
                "labels",
            )
        edges = stage(
            edges.join(hooks, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
            .join(hooks, "a").select(F.col("x").alias("a"), F.col("to").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    return edges.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels
