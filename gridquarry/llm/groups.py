"""Groups of similar items from buckets of candidates, without making all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small_join, stage

#: Buckets of more members than this meet their smallest member first.
PAIRED = 8
#: Buckets of more members than this are hot: their rows are not dealt by bucket, and meet in blocks of this size.
HOT = 256
#: Rounds in which the members outside a bucket's main component meet one drawn member of it, before they meet all others.
TRIES = 2


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).where("a <> b").distinct()


def _by_bucket(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (bucket, hot, ...) with table (bucket, once each; hot, ...). Rows of hot buckets stay where they are: the few lines
    of table for them travel, if a count shows that they are few."""
    cold = rows.where("NOT hot").join(table.where("NOT hot").drop("hot"), "bucket")
    return cold.unionByName(small_join(rows.where("hot"), table.where("hot").drop("hot"), ["bucket"]))


def _all_in_bucket(x: DataFrame, y: DataFrame) -> DataFrame:
    """Every x with every y of its bucket. Hot buckets are cut into blocks of about HOT rows, and each pair of blocks is a key."""
    cold = x.where("NOT hot").select("bucket", "x").join(y.where("NOT hot").select("bucket", "y"), "bucket")
    block = lambda side: F.pmod(F.xxhash64(f"{side}.node"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = x.where("hot").select("bucket", "x", block("x").alias("i"), every.alias("j"))
    right = y.where("hot").select("bucket", "y", every.alias("i"), block("y").alias("j"))
    return cold.select("x", "y").unionByName(left.join(right, ["bucket", "i", "j"]).select("x", "y"))


def bucket_components(
    members: DataFrame,
    fit: Column,
    prepare: Callable[[DataFrame], object],
    verify: Callable[[DataFrame, object], DataFrame],
    sketches: Callable[[object], DataFrame] | None = None,
    may: Column | None = None,
) -> DataFrame:
    """Components (node, component) of the links that verify() finds among nodes that share a bucket.

    members: bucket, node and what fit, a condition on structs x and y of two members, needs. prepare gets every node that
    may be verified, once; verify gets pairs (a, b), a < b, each once, with what prepare returned, and gives those linked, or
    as many of them as join the same nodes.

    Members of small buckets meet pairwise, those of large ones meet their smallest member. After that, members of a
    large bucket outside its most common component meet a drawn member of that component, and those still outside meet
    the members of all other components, if may, a condition on sketches (node, sketch) of both, does not rule out a
    link. So every pair that shares a bucket and fits is verified unless links already join it or it cannot be linked:
    components are exact, and a bucket of any size whose members are alike needs few pairs. Everything is joined by
    bucket or node, hot buckets in blocks; nothing is gathered."""
    members = stage(members, "members")
    info = [c for c in members.columns if c != "bucket"]
    row = F.struct(*info)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.struct("node", *[c for c in info if c != "node"])).alias("y"))
    sizes = stage(sizes.where("m > 1").withColumn("hot", F.col("m") > HOT), "sizes")
    hot = sizes.where("hot").select("bucket", F.lit(True).alias("hot"))
    tagged = stage(small_join(members, hot, ["bucket"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "tagged")
    few, many = sizes.where(F.col("m") <= PAIRED).select("bucket"), sizes.where(F.col("m") > PAIRED)
    small = tagged.where("NOT hot").join(few, "bucket", "left_semi").select("bucket", row.alias("x"))
    met = small.join(small.select("bucket", F.col("x").alias("y")), "bucket").where("x.node < y.node").where(fit)
    starred = _by_bucket(tagged.select("bucket", "hot", row.alias("x")), many.select("bucket", "hot", "y")).where(fit)
    pairs = stage(_pairs(met.select("x", "y").unionByName(starred.select("x", "y"))), "pairs")

    wide = stage(_by_bucket(tagged, many.select("bucket", "hot", F.ceil(F.col("m") / HOT).alias("blocks"))), "wide")
    ready = prepare(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(wide.select("node")).distinct())
    links = verify(pairs, ready)
    found = components(links)

    done = pairs
    for attempt in range(TRIES + 1):
        at = stage(wide.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "at")
        counts = at.groupBy("bucket", "hot", "component").count()
        main = counts.groupBy("bucket", "hot").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("n_components"))
        at = _by_bucket(at, stage(main.where("n_components > 1").select("bucket", "hot", "main"), "main"))
        at = stage(at if sketches is None else at.join(sketches(ready), "node"), "rest")
        row = F.struct(*info, "component", *([] if sketches is None else ["sketch"]), (F.col("component") == F.col("main")).alias("in_main"))
        x, y = at.where("component <> main").select("bucket", "hot", "blocks", row.alias("x")), at.select("bucket", "hot", "blocks", row.alias("y"))
        if attempt < TRIES:
            draw = F.xxhash64("y.node", "bucket", F.lit(attempt))
            rest = _by_bucket(x, stage(y.where("y.in_main").groupBy("bucket", "hot").agg(F.min_by("y", draw).alias("y")), "drawn"))
        else:
            rest = _all_in_bucket(x, y)
        test = F.expr("x.component <> y.component AND (y.in_main OR x.node < y.node)") & fit
        rest = rest.where(test if may is None else test & may)
        rest = stage(_pairs(rest).join(done, ["a", "b"], "left_anti"), "rest-pairs")
        if rest.isEmpty():
            if attempt < TRIES:
                continue
            break
        done, links = done.unionByName(rest), links.unionByName(verify(rest, ready))
        found = components(links)
    return found
