"""Search of many vectors or codes against a query set: blocks of queries travel, rows stay where they are."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import binary_codes
from ..session import stage

#: Queries that a task holds at once, and rows that meet them at once.
BLOCK, ROWS = 2048, 2048
#: Vectors that meet at once along a direction.
_RUN = 256


def _lists(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Binary codes: id_col, code (array of 64-bit words). Null vectors are left out; all others have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = binary_codes(_lists(batch.column("v"), float), seed)
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), words], ["id", "code"])

    rows = df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, code array<long>").withColumnRenamed("id", id_col)


def _query_blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """The queries, BLOCK at a time; the driver holds one block, whatever their number."""
    block = []
    for row in queries.select(*columns).orderBy(columns[0]).toLocalIterator(prefetchPartitions=True):
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _scan(rows: DataFrame, queries: DataFrame, columns: list[str], dtype, visit, schema: str, prepare: Callable | None = None) -> DataFrame:
    """visit(ids, vectors, block's rows, block's vectors) -> columns of schema, for every batch of rows and block of queries. With
    prepare, a task makes prepare(block's rows, block's vectors) once, which takes the place of the vectors."""
    names = [field.split()[0] for field in schema.split(", ")]
    out = None
    for block in _query_blocks(queries, columns):
        values = np.array([r[1] for r in block], dtype)

        def run(batches: Iterator[pa.RecordBatch], block=block, values=values) -> Iterator[pa.RecordBatch]:
            ready = None
            for whole in batches:
                if ready is None:
                    ready = values if prepare is None else prepare(block, values)
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    found = visit(batch.column("id").to_numpy(), _lists(batch.column("v"), dtype), block, ready)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(q)), np.int32)
    for word in range(x.shape[1]):
        total += np.bitwise_count((x[:, word, None] ^ q[None, :, word]).view(np.uint64))
    return total


class CodeIndex:
    """A block of query codes (rows of 64-bit words), each with a threshold, as a multi-index over parts of PART bits.

    Of m parts of two codes within t bits, one differs in t // m bits at most (pigeonhole). So every query is entered, for
    each of its parts, under all values within that radius, and a code looks up its own parts: only pairs that meet are
    compared, word by word, and each leaves as soon as its distance so far passes the threshold. Where the entries would
    let a fourth of all pairs or more through, or be more than MOST a query, all pairs start at the first word instead. Rows
    are the same either way. full counts the pairs that were compared to the last word."""

    PART, MOST = 16, 4096

    def __init__(self, codes: np.ndarray, thresholds: np.ndarray):
        self.codes, self.thresholds, self.full = np.ascontiguousarray(codes), thresholds, 0
        parts = self._parts(self.codes)
        self.m = parts.shape[1]
        radius = np.where(thresholds >= 0, thresholds // max(self.m, 1), -1)
        most = int(radius.max(initial=-1))
        flips = [0]
        sizes = [0] + [1]  # entries up to each radius: sizes[r + 1]
        for r in range(1, most + 1):
            if sizes[-1] * self.m > self.MOST:
                break
            flips += [sum(1 << b for b in bits) for bits in itertools.combinations(range(self.PART), r)]
            sizes.append(len(flips))
        share = sum(sizes[min(r + 1, len(sizes) - 1)] for r in radius.tolist()) * self.m / 2**self.PART / max(len(codes), 1)
        self.selective = len(sizes) == most + 2 and share < 0.25
        if not self.selective:
            return
        self.tables = []
        near = np.array(flips, np.uint16)
        for part in range(self.m):
            entries = [parts[radius == r, part][:, None] ^ near[None, : sizes[r + 1]] for r in range(most + 1)]
            owners = [np.repeat(np.flatnonzero(radius == r), sizes[r + 1]) for r in range(most + 1)]
            values, owner = np.concatenate([e.ravel() for e in entries] or [np.zeros(0, np.uint16)]), np.concatenate(owners or [np.zeros(0, np.int64)])
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange(2**self.PART + 1))
            self.tables.append((starts, owner[order]))

    def _parts(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint16) if codes.size else np.zeros((len(codes), 0), np.uint16)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, query, distance) of all pairs within the query's threshold, in order of row and query."""
        if not len(x) or not len(self.codes):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)
        if self.selective:
            row, query = self._meet(np.ascontiguousarray(x))
            distance, first = np.zeros(len(row), np.int32), 0
        else:
            d = np.bitwise_count((x[:, 0, None] ^ self.codes[None, :, 0]).view(np.uint64)).astype(np.int32)
            self.full += d.size if x.shape[1] == 1 else 0
            row, query = np.nonzero(d <= self.thresholds[None, :])
            distance, first = d[row, query], 1
        for word in range(first, x.shape[1]):
            self.full += len(row) if word == x.shape[1] - 1 else 0
            distance = distance + np.bitwise_count((x[row, word] ^ self.codes[query, word]).view(np.uint64)).astype(np.int32)
            on = distance <= self.thresholds[query]
            row, query, distance = row[on], query[on], distance[on]
        return row, query, distance

    def _meet(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, found = self._parts(x), []
        for part, (starts, owner) in enumerate(self.tables):
            low = starts[parts[:, part].astype(np.int64)]
            times = starts[parts[:, part].astype(np.int64) + 1] - low
            row = np.repeat(np.arange(len(x)), times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            found.append(row * len(self.codes) + owner[at])
        met = np.unique(np.concatenate(found))
        return met // len(self.codes), met % len(self.codes)


def _code_index(block: list, values: np.ndarray) -> CodeIndex:
    return CodeIndex(values, np.array([r[2] for r in block], np.int64))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the k smallest scores of each query in this batch, ties by id."""
    order = np.stack([np.lexsort((ids, score[:, j]))[:k] for j in range(score.shape[1])], 1)
    return order.ravel(), np.tile(np.arange(score.shape[1]), len(order))


def _top(found: DataFrame, by, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(by, "id"))).where(F.col("rank") <= k)


def hamming_knn(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """codes (id, v: words) nearest to each of queries (query, v): query, id, distance, rank. Ties by id."""

    def visit(ids, x, block, q):
        d = _distances(x, q)
        row, j = _nearest(d, ids, k)
        return np.array([r[0] for r in block])[j], ids[row], d[row, j]

    return _top(_scan(codes, queries, ["query", "v"], np.int64, visit, "query long, id long, distance int"), F.col("distance"), k)


def cosine_knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (id, v) most similar to each of queries (query, v): query, id, similarity (rounded to 6 places), rank. Ties by id."""

    def visit(ids, x, block, q):
        s = np.round(_unit(x) @ _unit(q).T, 6)
        row, j = _nearest(-s, ids, k)
        return np.array([r[0] for r in block])[j], ids[row], s[row, j]

    return _top(_scan(vectors, queries, ["query", "v"], float, visit, "query long, id long, similarity double"), F.desc("similarity"), k)


def cosine_distances(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """All pairs of vectors (id, v) and queries (query, v): query, id, cosine_distance (1 less the cosine rounded to 6 places, 0 to
    2). Nothing is ranked or shuffled; a row leaves its task once for each query."""

    def visit(ids, x, block, q):
        d = np.clip(1 - np.round(_unit(x) @ _unit(q).T, 6), 0, 2)
        return np.tile(np.array([r[0] for r in block]), len(ids)), np.repeat(ids, len(block)), d.ravel()

    return _scan(vectors, queries, ["query", "v"], float, visit, "query long, id long, cosine_distance double")


def all_distances(vectors: DataFrame, queries: DataFrame, seed: int = 42) -> DataFrame:
    """cosine_distances of all pairs, with hamming, the distance of their codes (see encode), found in the same visit: nothing is
    joined or shuffled."""

    def prepare(block, q):
        return _unit(q).T, binary_codes(q, seed)

    def visit(ids, x, block, ready):
        q, codes = ready
        d = np.clip(1 - np.round(_unit(x) @ q, 6), 0, 2)
        bits = _distances(binary_codes(x, seed), codes) if len(ids) else np.zeros(d.shape, np.int32)
        return np.tile(np.array([r[0] for r in block]), len(ids)), np.repeat(ids, len(block)), d.ravel(), bits.ravel()

    rows = vectors.where("v IS NOT NULL")
    return _scan(rows, queries.where("v IS NOT NULL"), ["query", "v"], float, visit, "query long, id long, cosine_distance double, hamming int", prepare)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row of s, ties by the columns' ids; NaN comes last."""
    s = np.where(np.isnan(s), -np.inf, s)
    if s.shape[1] > k:
        last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        row, j = np.nonzero(s >= last[:, None])
    else:
        row, j = (x.ravel() for x in np.indices(s.shape))
    order = np.lexsort((ids[j], -s[row, j], row))
    row, j = row[order], j[order]
    first = np.searchsorted(row, np.arange(len(s)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], j[keep]


def all_knn(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Of each vector (id, v) the k most similar of all, itself among them: query, id, similarity (rounded to 6 places). Ties by id.

    Every vector meets every other: vectors are dealt to blocks, each pair of blocks is a group of its own, of two blocks
    whatever their number, and gives k rows a vector, so nothing passes the driver. A pair of blocks meets once, for the
    neighbours of both, and vectors travel as they are; each is sent once per block and once more. block: vectors of a
    block; by default an eighth of all, 2,048 at least, and no more than have two million numbers."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), "v")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or max(1, min(max(2048, -(-n // 8)), 16_384, (1 << 21) // max(dim or 1, 1)))
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = rows.withColumn("i", own).select("id", "v", "i", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))).alias("j"))
    right = rows.withColumn("j", own).select("id", "v", F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"), "j")

    def near(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if x.num_rows and y.num_rows:
            ids, others = x["id"].to_numpy(), y["id"].to_numpy()
            p, q = (_unit(_lists(t["v"].combine_chunks(), float)) for t in (x, y))
            turns = [(ids, p, others, q)] if key[0].as_py() == key[1].as_py() else [(ids, p, others, q), (others, q, ids, p)]
            for a, u, b, v in turns:
                for at in range(0, len(a), 512):
                    s = np.round(u[at : at + 512] @ v.T, 6)
                    row, j = _best(s, b, k)
                    found.append((a[at + row], b[j], s[row, j]))
        query, id_, similarity = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query": query, "id": id_, "similarity": similarity})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(near, "query long, id long, similarity double")
    return _top(found, F.desc("similarity"), k)


def descend_knn(vectors: DataFrame, k: int, width: int = 28, starts: int = 4, rounds: int = 12, least: float = 0.001, seed: int = 1) -> DataFrame:
    """As all_knn, in rows and columns, but approximate: neighbours of neighbours are met instead of all pairs.

    Vectors first meet those beside them in order along some random directions (starts), in runs of _RUN. Then, round by round, all
    that a vector and those that list it know meet one another, as far as any of them is new, and each keeps its width best,
    until fewer than the share least of the entries change. Of those that list a vector, 2 * width are drawn a round, newest
    first, so no vector's meeting grows with its fame. Work and rows shuffled grow with the vectors, not with their square;
    tests measure the recall. Null vectors are left out; a zero vector has similarity 0. Ids must be distinct."""
    width = max(width, k)
    rows = vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    rows = stage(rows, "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query long, id long, similarity double"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _runs(batches, max(_RUN, 3 * width + 1)):
            v = _unit(v)
            s = np.round(v @ v.T, 6)
            np.fill_diagonal(s, -np.inf)
            row, j = _nearest(-s, ids, min(width, len(ids) - 1)) if len(ids) > 1 else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(ids[row]), pa.array(s[row, j])], ["query", "id", "similarity"])

    def best(found: DataFrame, known: DataFrame | None) -> DataFrame:
        """The width best of all, and whether known lacks them."""
        every = found.withColumn("new", F.lit(True))
        every = every if known is None else every.unionByName(known.withColumn("new", F.lit(False)))
        once = every.groupBy("query", "id").agg(F.max("similarity").alias("similarity"), F.min("new").alias("new"))
        return stage(_top(once, F.desc("similarity"), width).drop("rank"), "graph")

    found = None
    for direction in np.random.default_rng(seed).normal(size=(starts, dim or 0)):
        along = F.aggregate(F.zip_with("v", F.lit(direction.tolist()).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
        beside = rows.withColumn("node", F.lit(0).cast("long")).withColumn("p", along).repartitionByRange("p", "id").sortWithinPartitions("p", "id")
        part = beside.select("node", "id", "v").mapInArrow(meet, schema)
        found = part if found is None else found.unionByName(part)
    graph = best(found, None)
    for turn in range(rounds):
        if graph.where("new").count() <= least * n * width:
            break
        lists = graph.select(F.col("query").alias("node"), "id", "new")
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64("id", F.lit(turn)), "id"))
        listed = graph.select(F.col("id").alias("node"), F.col("query").alias("id"), "new").withColumn("r", drawn).where(F.col("r") <= 2 * width).drop("r")
        members = lists.unionByName(listed).groupBy("node", "id").agg(F.max("new").alias("new"))
        fresh = members.where("new").select("node").distinct()
        members = members.select("node", "id").unionByName(rows.select(F.col("id").alias("node"), "id")).join(fresh, "node", "left_semi")
        together = members.join(rows, "id").select("node", "id", "v").repartition("node").sortWithinPartitions("node")
        graph = best(together.mapInArrow(meet, schema), graph.drop("new"))
    norm = F.exists("v", lambda x: x != 0)
    itself = rows.select(F.col("id").alias("query"), "id", F.when(norm, 1.0).otherwise(0.0).alias("similarity"))
    return _top(graph.drop("new").unionByName(itself), F.desc("similarity"), k)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of rows (node, id, v) that come in order of node: those of one node together, most of them at once."""
    node, ids, v = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _lists(batch.column("v"), float)
        node, ids = np.concatenate([node, batch.column("node").to_numpy()]), np.concatenate([ids, batch.column("id").to_numpy()])
        v = new if v is None else np.concatenate([v, new])
        cuts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(node)], strict=True):
            while b - a >= most or (b < len(node) and a < b):
                yield ids[a : min(b, a + most)], v[a : min(b, a + most)]
                a = min(b, a + most)
        node, ids, v = node[a:], ids[a:], v[a:]
    if len(ids):
        yield ids, v


def hamming_range(codes: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs within the threshold of the query: query, id, distance. queries: query, v, threshold. See CodeIndex."""

    def visit(ids, x, block, index):
        row, j, d = index.near(x)
        return np.array([r[0] for r in block])[j], ids[row], d

    return _scan(codes, queries, ["query", "v", "threshold"], np.int64, visit, "query long, id long, distance int", _code_index)


def resonant_vote(codes: DataFrame, queries: DataFrame) -> DataFrame:
    """For each code within the threshold of any query, the families of such queries: id, mask (bit per family), n_families, best.
    See CodeIndex."""

    def visit(ids, x, block, index):
        row, j, d = index.near(x)
        mask, best = np.zeros(len(ids), np.int64), np.full(len(ids), 1 << 30, np.int32)
        np.bitwise_or.at(mask, row, (1 << np.array([r[3] for r in block], np.int64))[j])
        np.minimum.at(best, row, d)
        keep = mask > 0
        return ids[keep], mask[keep].astype(np.int32), best[keep]

    found = _scan(codes, queries, ["query", "v", "threshold", "family"], np.int64, visit, "id long, mask int, best int", _code_index)
    found = found.groupBy("id").agg(F.bit_or("mask").alias("mask"), F.min("best").alias("best"))
    return found.withColumn("n_families", F.bit_count("mask").cast("int"))


def nearest_query(codes: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each code the nearest query, ties to the smallest: id, query, distance."""

    def visit(ids, x, block, q):
        d = _distances(x, q)
        j = d.argmin(1)
        return ids, np.array([r[0] for r in block])[j], d[np.arange(len(d)), j]

    found = _scan(codes, queries, ["query", "v"], np.int64, visit, "id long, query long, distance int")
    best = found.groupBy("id").agg(F.min(F.struct("distance", "query")).alias("best"))
    return best.select("id", "best.query", "best.distance")


def max_similarity(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Of each vector the largest cosine to a query, rounded to 6 places: id, similarity."""

    def visit(ids, x, block, q):
        return ids, np.round((_unit(x) @ _unit(q).T).max(1), 6)

    return _scan(vectors, queries, ["query", "v"], float, visit, "id long, similarity double").groupBy("id").agg(F.max("similarity").alias("similarity"))


def vote_aggregate(knn: DataFrame) -> DataFrame:
    """Of each id that a search returned: votes (queries that returned it) and its best distance. Negative ids are ignored."""
    return knn.where("id >= 0").groupBy("id").agg(F.count("*").alias("votes"), F.min("distance").alias("best"))


def family_thresholds(queries: DataFrame, base: int, most: int | None = None, floor: int = 16) -> DataFrame:
    """queries (with family) plus threshold: large families are searched more narrowly."""
    n = F.count("*").alias("n")
    by_family = queries.groupBy("family").agg(n)
    factor = F.greatest(F.lit(1), F.lit(10) - F.floor(F.col("n") / 4))
    wide = F.greatest(F.lit(floor), F.lit(base) - factor)
    cap = most if most is not None else max(63, base)
    return queries.join(F.broadcast(by_family), "family").withColumn("threshold", F.least(F.lit(cap), wide).cast("int")).drop("n")


def contrastive(codes: DataFrame, positives: DataFrame, negatives: DataFrame, dim: int) -> DataFrame:
    """id, d_pos, d_neg (dim without negatives) and score = d_neg - d_pos."""
    pos = nearest_query(codes, positives).select("id", F.col("distance").alias("d_pos"))
    neg = nearest_query(codes, negatives).select("id", F.col("distance").alias("d_neg"))
    found = pos.join(neg, "id", "left").withColumn("d_neg", F.coalesce("d_neg", F.lit(dim)))
    return found.withColumn("score", F.col("d_neg") - F.col("d_pos"))


def merge_delta(main: DataFrame, delta: DataFrame, id_col: str = "id") -> DataFrame:
    """main with the last entry of each id in delta (seq, deleted, and main's columns) applied: what a search should see."""
    last = delta.groupBy(id_col).agg(F.max_by(F.struct("deleted", *[c for c in main.columns if c != id_col]), "seq").alias("last"))
    kept = main.join(last.select(id_col), id_col, "left_anti")
    return kept.unionByName(last.where(~F.col("last.deleted")).select(id_col, *[F.col(f"last.{c}").alias(c) for c in main.columns if c != id_col]))
