"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, small_join, stage

#: Rows of a digest and two numbers that may be broadcast (some MB), if a count shows that there are no more.
_BOUND = 200_000


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _classes(rows: DataFrame, signed: DataFrame, keep: str) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size) of texts that stand more than once, and (digest, norm, keep_id, group_size) of all texts
    whose digest is that of another text too; None if there are none.

    Only rows whose digest repeats are compared byte by byte: by grouping on (digest, norm), which Spark does before the
    shuffle, so a group of copies of any size sends one text per task."""
    repeated = stage(signed.groupBy("digest").count().where("count > 1").select("digest"), "repeated")
    suspects = small_join(rows.select("id", "norm", "digest"), repeated, ["digest"], "left_semi", _BOUND)
    pick = {"smallest": F.min, "largest": F.max}[keep]
    texts = suspects.groupBy("digest", "norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    by_digest = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    classes = stage(by_digest, "classes")
    collided = classes.where("texts > 1").select("digest")
    if collided.isEmpty():
        return classes.drop("texts"), None
    return classes.where("texts = 1").drop("texts"), stage(small_join(texts, collided, ["digest"], "left_semi", _BOUND), "collided")


def _placed(rows: DataFrame, classes: DataFrame, collided: DataFrame | None) -> DataFrame:
    """rows (id, digest, and norm if texts collided) with keep_id and group_size. Rows stay where they are if classes are few."""
    found = rows.drop("norm") if collided is None else small_join(rows, stage(collided.select("digest").distinct(), "apart"), ["digest"], "left_anti", _BOUND).drop("norm")
    found = small_join(found, classes, ["digest"], "left", _BOUND)
    if collided is not None:
        found = found.unionByName(rows.join(collided, ["digest", "norm"]).drop("norm"))
    alone = F.col("group_size").isNull()
    return found.withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = _md5,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Every row of df with the class of equal texts it belongs to.

    Texts are equal when they are identical after lower-casing A-Z. Returns one row per row of df: id_col, text_col as
    it was (or instead the columns of carry, of df's row), keep_id (smallest or largest id of the class), group_size, kept
    (the row carries keep_id).

    Null text counts as empty. Null ids are never kept while the class has another id. Rows that repeat an id and a text
    are all flagged alike. Empty tables give empty results; other columns of df are left out, so names cannot clash.

    Rows are grouped by a 128-bit digest first, without their texts; bytes are compared where a digest repeats (_classes).
    Two texts of one digest are kept apart. digest may be replaced, for tests, by a weak hash."""
    norm = ascii_lower(F.col(text_col))
    carry = {text_col: F.col(text_col)} if carry is None else carry
    own = F.struct(*[c.alias(name) for name, c in carry.items()]).alias("own")
    rows = df.select(F.col(id_col).alias("id"), norm.alias("norm"), own, digest(norm.cast("binary")).alias("digest"))
    small = text_col not in carry
    signed = stage(rows.drop("norm") if small else rows.select("id", "digest"), "signed")
    classes, collided = _classes(rows, signed, keep)
    found = _placed(signed if small and collided is None else rows, classes, collided)
    return found.select(F.col("id").alias(id_col), "own.*", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = _md5) -> DataFrame:
    """df with one row of each class of exact_dedup, in df's own columns: that of the smallest (or largest) id.

    Of rows that share that id and the class, the one whose text as it was has the smallest md5 stays; of equal ones any,
    but one only. A class whose ids are all null keeps one row. Null texts are in the class of empty ones. Columns of df
    may have any names; an empty table gives an empty one."""
    norm, record = ascii_lower(F.col(text_col)), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")
    rows = df.select(F.col(id_col).alias("id"), norm.alias("norm"), digest(norm.cast("binary")).alias("digest"), record)
    signed = stage(rows.select("id", "digest"), "signed")
    classes, collided = _classes(rows, signed, keep)
    mine = F.col("id").eqNullSafe(F.col("keep_id"))
    if collided is None:
        kept = _placed(rows, classes, None).where(mine)
        several = stage(_placed(signed, classes, None).where(mine & (F.col("group_size") > 1)).groupBy("digest").count().where("count > 1").select("digest"), "several")
        if several.isEmpty():
            return kept.select("record.*")
        left = small_join(kept, several, ["digest"], "left_anti", _BOUND).select("record")
        many = small_join(kept, several, ["digest"], "left_semi", _BOUND).select("digest", F.lit("").alias("norm"), "record")
    else:
        kept = _placed(rows.withColumn("again", F.col("norm")), classes, collided).where(mine).select("digest", F.col("again").alias("norm"), "group_size", "record")
        left, many = kept.where("group_size = 1").select("record"), kept.where("group_size > 1")
    one = many.groupBy("digest", "norm").agg(F.min_by("record", F.md5(F.coalesce(F.col(f"record.`{text_col}`"), F.lit("")))).alias("record"))
    return left.unionByName(one.select("record")).select("record.*")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Of texts of documents that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="largest", carry={"text_sha256": F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)})


OP7_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
