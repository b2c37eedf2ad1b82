"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stage
from .groups import bucket_components

#: Buckets probed per table, and the recall of pairs at the threshold for which the number of tables is chosen.
PROBES, RECALL = 4, 0.99
#: Vectors of one component that are compared at once, with as many others.
BLOCK = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x


def table_keys(x: np.ndarray, table: int, bits: int, probes: int = PROBES, seed: int = 3) -> np.ndarray:
    """(rows, probes) 64-bit keys of one table. A hash is the nearest of the 2d signed unit vectors after three rounds of random
    signs and a Hadamard transform; a key joins as many as make bits, the last over fewer coordinates. Probes replace hashes
    by the second nearest, least loss first."""
    rng = np.random.default_rng((seed, table))
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    whole = width.bit_length()  # a hash has 2 * width values
    sizes = [whole] * (bits // whole) + ([max(2, bits % whole)] if bits % whole else [])
    codes, gaps = [], []
    for size in sizes:
        y = x
        for signs in rng.choice([-1.0, 1.0], size=(3, width)):
            y = hadamard(y * signs) / np.sqrt(width)
        y = y[:, : 1 << (size - 1)]
        two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        value = np.take_along_axis(y, two, 1)
        order = np.argsort(-np.abs(value), axis=1)
        two, value = np.take_along_axis(two, order, 1), np.take_along_axis(value, order, 1)
        codes.append(2 * two + (value < 0))
        gaps.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
    choices = np.array(list(itertools.product((0, 1), repeat=min(len(sizes), 8))))  # of more hashes, the last keep their nearest
    best = np.argsort(np.stack(gaps[:8], 1) @ choices.T, axis=1, kind="stable")[:, :probes]
    key = np.full(best.shape, table * 1_000_003 + x.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for h, code in enumerate(codes):
            own = np.take_along_axis(code, choices[best, h], 1) if h < 8 else code[:, :1]
            key = arrays.mix(key * np.uint64(31) + own.astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def table_bits(vectors: int, probes: int = PROBES) -> int:
    """Bits of a key: eight times as many buckets as the vectors probe, so chance meetings grow with the vectors, not their square."""
    return max(4, (8 * probes * max(vectors, 1) - 1).bit_length())


def choose_tables(dim: int, bits: int, threshold: float, recall: float = RECALL, probes: int = PROBES, pairs: int = 1000, most: int = 512) -> int:
    """Tables after which the share recall of random pairs of cosine threshold have shared a bucket (tried out on some pairs)."""
    if dim < 2 or threshold >= 1:
        return 1
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(pairs, bool)
    for table in range(most):
        met |= (table_keys(a, table, bits, probes)[:, :, None] == table_keys(b, table, bits, probes)[:, None, :]).any((1, 2))
        if met.mean() >= recall:
            return table + 1
    raise ValueError(f"{most} tables do not reach a recall of {recall} at a cosine of {threshold} in {dim} dimensions")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of little-endian doubles in binary form; all of one length."""
    return np.stack([np.frombuffer(v, "<f8") for v in column.to_pylist()])


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for length in batch.column("dim").unique():
        yield batch.filter(pa.compute.equal(batch.column("dim"), length))


def link_work(binary: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (component, node, times, v, own, low, high) of the block pairs to compare, and the columns to group them by.

    A pair of blocks of a component of several is a group of its own, about 2 * BLOCK rows whatever the component's size;
    components of one block share groups of about 4 * BLOCK rows."""
    sizes = stage(found.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK)), "sizes")
    inside = binary.join(found, "node").join(sizes, "component")
    inside = inside.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    small = sizes.where("blocks = 1").agg(F.sum("count")).first()[0] or 0
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, small // (4 * BLOCK)))))
    inside = inside.select("component", "node", "times", "v", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), task.alias("task"))
    inside = inside.withColumn("whole", F.when(F.col("task").isNull(), F.col("component")))
    return inside, ["task", "whole", "low", "high"]


def embedding_groups(
    df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, probes: int = PROBES
) -> DataFrame:
    """Every row of df with its links and group: id_col, n_links, component_id, kept.

    Two rows are linked when the cosine of their vectors, in double precision, is threshold or more. n_links counts the
    other rows linked directly; component_id is the smallest id that links lead to; kept: the row carries that id.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their own id;
    vectors of different lengths do not link. Rows with equal vectors are linked, and handled as one vector with a
    count. Other columns are left out.

    Pairs come from the buckets that vectors share (groups.bucket_components) and are verified. Keys have more bits the more
    vectors of a length there are (table_bits), and the number of tables is chosen for that and the length, so that the
    share recall of pairs at the threshold share a bucket; nearer pairs, and those joined through others, are found more
    often. Links are then counted exactly inside each component, in blocks of BLOCK by BLOCK vectors, so a task holds two
    blocks and no pair of rows is written; rows of different components count as not linked. The cost of that is the square
    of a component's distinct vectors."""
    import pyarrow.compute  # noqa: F401

    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v"))
    vectors = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("first_id"), F.count("*").alias("times"))
    vectors = stage(vectors.withColumn("node", F.monotonically_increasing_id()), "vectors")
    binary = vectors.select("node", "times", F.size("v").alias("dim"), "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.array(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "times", "dim")), pa.array(held, pa.binary())], ["node", "times", "dim", "v"])

    binary = stage(binary.mapInArrow(pack, "node long, times long, dim int, v binary"), "binary")

    plan = {}
    for dim, n in binary.groupBy("dim").count().collect():  # a row per length
        bits = table_bits(n, probes)
        plan[dim] = bits, choose_tables(dim, bits, threshold, recall, probes)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for batch in _by_length(whole.slice(at, 2048)):
                    x, dim = _matrix(batch.column("v")), batch.column("dim")[0].as_py()
                    bits, tables = plan[dim]
                    keys = np.sort(np.concatenate([table_keys(x, t, bits, probes) + dim for t in range(tables)], 1), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(new)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new]), batch.column("node").take(pa.array(row))], ["bucket", "node"])

    members = binary.mapInArrow(hash_, "bucket long, node long")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole):
                x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
                cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield batch.filter(pa.array(cos >= threshold)).select(["a", "b"])

    def verify(pairs: DataFrame, _) -> DataFrame:
        x, y = binary.select(F.col("node").alias("a"), "dim", F.col("v").alias("x")), binary.select(F.col("node").alias("b"), "dim", F.col("v").alias("y"))
        return stage(pairs.join(x, "a").join(y, ["b", "dim"]).select("a", "b", "dim", "x", "y").mapInArrow(check, "a long, b long"), "links")

    found = stage(bucket_components(members, F.lit(True), lambda nodes: None, verify), "components")

    inside, keys = link_work(binary, found)

    def count(table: pa.Table) -> pa.Table:
        names = ("component", "low", "high", "own", "node", "times")
        component, low, high, own, node, times = (table[c].to_numpy() for c in names)
        values = table["v"].combine_chunks()
        order = np.lexsort((own, high, low, component))
        cuts = np.flatnonzero(np.diff(component[order]) | np.diff(low[order]) | np.diff(high[order])) + 1
        nodes, links = [], []
        for at in np.split(order, cuts):
            x = _matrix(values.take(pa.array(at)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            left = own[at] == low[at]
            y = left if low[at[0]] == high[at[0]] else ~left
            near = x[left] @ x[y].T >= threshold
            close = np.abs(x[left] @ x[y].T - threshold) < 1e-12
            if low[at[0]] == high[at[0]]:
                np.fill_diagonal(near, False)
            if close.any():  # as in check(), whatever the order of sums
                for i, j in zip(*np.nonzero(close), strict=True):
                    p, q = (np.frombuffer(values[int(at[np.flatnonzero(m)[k]])].as_py(), "<f8") for m, k in ((left, i), (y, j)))
                    near[i, j] = (p * q).sum() / (np.linalg.norm(p) * np.linalg.norm(q)) >= threshold and (low[at[0]] != high[at[0]] or i != j)
            nodes.append(node[at[left]])
            links.append(near @ times[at[y]])
            if low[at[0]] != high[at[0]]:
                nodes.append(node[at[y]])
                links.append(near.T @ times[at[left]])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"node": pa.array(np.concatenate(nodes or empty)), "links": pa.array(np.concatenate(links or empty))})

    counted = inside.groupBy(*keys).applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = stage(vectors.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counted, "node", "left"), "named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("v", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("v IS NOT NULL").join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.9."""
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, which the operator need not compare; the same as its result where no link lies at the threshold.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
u AS (SELECT rid, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0),
l AS (SELECT a.rid AS x, b.rid AS y FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT rid, rid AS reach FROM v UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.reach),
c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.reach GROUP BY r.rid), k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN k ON k.x = v.rid
"""
