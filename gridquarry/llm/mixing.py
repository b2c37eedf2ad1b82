"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small_join, stage

#: Weights of sources in turn, and the share of all words that a mix takes.
WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7

#: Parts of a source's rows, by seeded hash; only the part in which the target is reached is ranked row by row.
CELLS = 4096


def count_words(text: Column) -> Column:
    """Number of words between white space; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float = 2.0) -> DataFrame:
    """sources (with weight and source_size) plus target: total shared by weight, no source above max_epochs times its size.

    Sources that would exceed their cap are clamped to it, and the rest of total is shared again by weight among the
    others until none is above (at most one round per distinct cap-to-weight ratio, usually two or three). Each round is
    one aggregate of two sums. Sources of size 0 get 0, as do all when total is 0. If the caps sum to less than total,
    every source gets its cap."""
    caps = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        fixed, open_weight, n_full = caps.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))
        ).first()
        if not open_weight:
            level = float("inf")
            break
        new = max(level, (total - fixed) / open_weight)
        if new == level:
            break
        level = new
    share = F.lit(level) * F.col("weight")
    target = F.col("cap") if level == float("inf") else F.when(F.col("cap") <= share, F.col("cap")).otherwise(share)
    return caps.withColumn("target", target.cast("double")).drop("cap")


def weigh_in_order(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sources plus weight: weights in turn along the sources by code point, null last.

    The order is taken without bringing all sources into one task: ranges are sorted, then shifted by the rows before."""
    parts = max(1, min(64, sources.count() // 10_000))
    ranged = stage(
        sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .withColumn("at", F.monotonically_increasing_id()),
        "ranged",
    )
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).count().collect()):  # 64 rows at most
        starts[p], before = before, before + n
    table = F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)]) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0))
    index = (table[part] + row) % len(weights)
    return ranged.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int"))).drop("at")


def _key(source) -> Column:
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))


def _draw(seed: int, id_col: str, text_col: str) -> Column:
    """A row's place in the order in which rows are taken: a digest of id and text, the same in every run."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))


def _cell(draw: Column) -> Column:
    """The first of CELLS parts of the order, by the draw's first three digits."""
    return F.conv(F.substring(draw, 1, 3), 16, 10).cast("int")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source: key, source_size, target, whole, and where its once more ends: cut_cell, cut_draw, and of the ties
    rows of that draw how many are taken (take)."""
    cells = stage(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    sources = stage(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(weigh_in_order(sources, weights), share * total, max_epochs)
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(q)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stage(targets.select(_key("source").alias("key"), "source_size", "target", "whole", "rest"), "targets")

    # of each source's cells, in order: those before the target are taken, one is divided row by row, the others are left
    run = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = small_join(cells.withColumn("key", _key("source")), targets.select("key", "rest"), ["key"]).withColumn("upto", F.sum("cell_size").over(run))
    cut = stage(
        upto.where(F.col("upto") > F.col("rest")).groupBy("key")
        .agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("cell_size")).alias("room"))).alias("cut"))
        .select("key", "cut.cell", "cut.room"),
        "cut",
    )
    inside = small_join(rows.withColumn("key", _key("source")), cut, ["key", "cell"])
    draws = inside.groupBy("key", "draw").agg(F.max("size").alias("size"), F.count("*").alias("ties"), F.first("room").alias("room"))
    run = Window.partitionBy("key").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("room") - F.sum(F.col("size") * F.col("ties")).over(run) + F.col("size") * F.col("ties")  # before this draw
    near = F.when(F.col("size") > 0, F.least(F.col("ties"), F.floor(left / F.col("size") + 0.5))).when(left >= 0, F.col("ties")).otherwise(0)
    last = draws.withColumn("take", near.cast("long")).where("take > 0").groupBy("key").agg(F.max(F.struct(F.col("draw").alias("cut_draw"), "take", "ties")).alias("last"))
    return stage(targets.join(cut.select("key", F.col("cell").alias("cut_cell")), "key", "left").join(last, "key", "left").select("*", "last.*").drop("rest", "last"), "plan")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (key, ...), written, with number: from 1 for each key. Numbers go through the parts of the table one after the other."""
    rows = stage(rows.withColumn("at", F.monotonically_increasing_id()), "ties").withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("key", "part").count().select("key", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("at"))
    return rows.join(starts, ["key", "part"]).withColumn("number", F.col("start") + own).drop("at", "part", "start")


def _with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (key, draw, cell, ...) with the plan's columns and repeats. Where only some of equal rows are taken, they are
    numbered; the others are decided by themselves."""
    found = small_join(rows, plan, ["key"])
    at_cut = (F.col("cell") == F.col("cut_cell")) & (F.col("draw") == F.col("cut_draw"))
    before = (F.col("cell") < F.col("cut_cell")) | (F.col("cell") == F.col("cut_cell")) & (F.col("draw") <= F.col("cut_draw"))
    all_alike = found.withColumn("repeats", F.col("whole") + F.coalesce(before, F.lit(False)).cast("long"))
    if plan.where("take < ties").isEmpty():
        return all_alike
    some = F.coalesce(at_cut & (F.col("take") < F.col("ties")), F.lit(False))
    ties = _numbered(found.where(some))
    return all_alike.where(~some).unionByName(ties.withColumn("repeats", F.col("whole") + (F.col("number") <= F.col("take")).cast("long")).drop("number"))


def _sizes(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), _draw(seed, id_col, text_col).alias("draw")
    )
    return stage(sized.withColumn("cell", _cell(F.col("draw"))), "sizes")


def mix_sources(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often each row of df is taken by a mix of share times all words.

    Returns one row per row of df: id_col, source_col, size (words), source_size, target (words of its source in the
    mix), repeats (times the row is taken), taken (size times repeats). A target of q times the source's size takes every
    row floor(q) times, and once more the rows of smallest seeded digest of id and text, in turn until the rest of the
    target is reached (the last one only if that comes nearer), so a source misses its target by half a row at most. Rows
    that repeat an id and a text are taken one by one too; which of them is left open.

    Null source is a source of its own, the last; null or blank texts have size 0. Reruns agree. Empty tables give empty
    results; other columns are left out, so names cannot clash."""
    rows = _sizes(df, seed, id_col, text_col, source_col)
    found = _with_repeats(rows.withColumn("key", _key("source")), _plan(rows, weights, share, max_epochs))
    return found.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
    )


def repeat_rows(
    df: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: df with every row as often as mix_sources takes it, in df's own columns, which may have any names.

    Texts stay where they are: the decision needs a row's own digest and its source's line of the plan. Nulls and empty
    tables as in mix_sources."""
    plan = _plan(_sizes(df, seed, id_col, text_col, source_col), weights, share, max_epochs)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    rows = rows.select(
        "record", _key(f"record.`{source_col}`").alias("key"), _draw(seed, f"record.`{id_col}`", f"record.`{text_col}`").alias("draw")
    ).withColumn("cell", _cell(F.col("draw")))
    found = _with_repeats(rows, plan)
    return found.select("record", F.explode(F.array_repeat(F.lit(1), F.col("repeats").cast("int")))).select("record.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """A mix of 150% of all words of documents; sources by code point weigh 5, 2, 1 in turn, no document more than twice."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(concat('{SEED}/', coalesce(CAST(doc_id AS VARCHAR), ''), '/', md5(coalesce(text, '')))) AS draw,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {EPOCHS}::DOUBLE AS cap FROM s),
c AS (SELECT *, {SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW o AS (ORDER BY cap / weight, source)),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight OR level IS NULL THEN cap ELSE level * weight END AS target
      FROM c, (SELECT max(room / open) FILTER (room / open <= cap / weight) AS level FROM c)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY draw ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
