"""Firsts, tops and steps along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows in order; each task keeps k rows at most."""
    return rows.orderBy(*order).limit(k)


def top_k_per_group(rows: DataFrame, group: str, k: int, order: list[Column]) -> DataFrame:
    """rows with rank, up to k in each group. Tasks cut groups to k rows before they are shuffled."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def zero_crossings(rows: DataFrame, group: str, order: list[str], at: str, value: str) -> DataFrame:
    """Rows whose value has another sign than the one before in their group, with crossed: where between both the value is 0."""
    w = Window.partitionBy(group).orderBy(*order)
    both = rows.withColumns({"__v": F.lag(value).over(w), "__at": F.lag(at).over(w)}).where(F.col("__v") * F.col(value) < 0)
    step = F.col("__v") / (F.col("__v") - F.col(value))
    return both.withColumn("crossed", F.col("__at") + (F.col(at) - F.col("__at")) * step).drop("__v", "__at")


def since_start(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """rows with seconds since the first time of their group, and last_ts, its last. The groups' times are found first, by partial
    aggregates, so a large group is no single task's."""
    ends = rows.groupBy(group).agg(F.min(ts).alias("__first"), F.max(ts).alias("last_ts"))
    return rows.join(ends, group).withColumn("seconds", F.unix_timestamp(ts) - F.unix_timestamp("__first")).drop("__first")
