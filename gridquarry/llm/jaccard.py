"""N-gram Jaccard join: sets of shingles in one global order hang below their rare tokens, and are joined in prefix trees.

A set's rarest tokens are the first level of the tree: they deal sets to each other across tasks, with bounds on what
remains. Below that level a task holds the sets of a block in one tree and sends many sets through it at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import LOWER, SPACE, UPPER, keep_one, map_texts, row_key, small_join, stage
from .groups import bucket_components

#: Cells of the count sketch that orders tokens from frequent to rare; 4 bytes each, whatever the size of the input.
CELL_BITS = 20
_CHUNK = 1 << 14
#: Bits of the filter of wanted sets: at most this many; more wanted sets only let more unwanted ones through.
_FILTER_BITS = 1 << 28
#: 64-bit words of a set's sketch, in which each token sets one bit.
_SKETCH = 16
#: Tokens of the sets that a prefix tree holds at once, about.
_BLOCK_TOKENS = 1 << 20
#: Rows of two or three numbers that may be broadcast (some MB), if a count shows that there are no more.
_BOUND = 400_000


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sets(block: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(row, sorted tokens, two halves of a 128-bit digest of the set) of each text with words."""
    tokens, counts = arrays.shingle_sets(block, k)
    at = 0
    for row, n in enumerate(counts.tolist()):
        if n:
            own = tokens[at : at + n]
            at += n
            one, two = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
            yield row, own, one, two


def _signatures(rows: DataFrame, k: int) -> DataFrame:
    """A row per text (id, key if there is one, n, c1, c2: size and digest of its set), and for each task the chunks of its
    token counts."""
    own_columns = [c for c in rows.columns if c != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        kinds, seen, waiting = None, [], 0
        for batch in batches:
            for block in arrays.blocks(batch):
                found = np.zeros((3, block.num_rows), np.int64)
                for row, own, one, two in _sets(block, k):
                    found[:, row] = len(own), one, two
                    seen.append(own)
                    waiting += len(own)
                    if waiting >= 1 << 20:
                        counts += np.bincount(_cell(np.concatenate(seen)), minlength=len(counts)).astype(np.uint32)
                        seen, waiting = [], 0
                kinds = [block.schema.field(c).type for c in own_columns]
                empty = pa.nulls(block.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in own_columns), *(pa.array(x) for x in found), empty], [*own_columns, "n", "c1", "c2", "cells"])
        if seen:
            counts += np.bincount(_cell(np.concatenate(seen)), minlength=len(counts)).astype(np.uint32)
        if kinds is not None:
            chunks = counts.reshape(-1, _CHUNK)
            n, part = len(chunks), TaskContext.get().partitionId()
            columns = [*(pa.nulls(n, kind) for kind in kinds), pa.array([-1] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array([x.tobytes() for x in chunks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*own_columns, "n", "c1", "c2", "cells"])

    own = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own_columns)
    return stage(map_texts(rows, sign, f"{own}, n long, c1 long, c2 long, cells binary"), "signatures")


def _token_counts(signed: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts per cell, added up 256 tasks at a time; 4 MB reach the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.uint64)
        for cells in table["cells"].to_pylist():
            total += np.frombuffer(cells, np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
        return pa.table({"c1": table["c1"][:1], "c2": table["c2"][:1], "cells": pa.array([total], pa.binary())})

    parts = signed.where("n = -1").select("c1", "c2", "cells")
    most = parts.agg(F.max("c2")).first()[0]
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    if most is None:
        return counts
    while True:
        parts = parts.withColumn("c2", F.floor(F.col("c2") / 256)).groupBy("c1", "c2").applyInArrow(add, "c1 long, c2 long, cells binary")
        if most < 256:
            break
        parts, most = stage(parts, "counts"), most // 256
    for row in parts.collect():
        counts[row["c1"] * _CHUNK : (row["c1"] + 1) * _CHUNK] = np.frombuffer(row["cells"], np.uint32)
    return counts


def _postings(rows: DataFrame, k: int, percent: int, counts) -> DataFrame:
    """The rarest tokens of every set, as many as two linked sets cannot both miss: token, c1, place (n << 32 | pos; pos 0: rarest)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, done = counts.value, set()
        for batch in batches:
            for block in arrays.blocks(batch):
                out = []
                for _, own, one, two in _sets(block, k):
                    if (one, two) in done:  # copies in this task
                        continue
                    done.add((one, two))
                    n = len(own)
                    rare = n - -(-percent * n // 100) + 1
                    order = np.lexsort((own, cells[_cell(own)]))[:rare]
                    out.append((own[order].view(np.int64), one, (n << 32) + np.arange(rare)))
                if out:
                    columns = [np.concatenate([x[0] for x in out]), np.repeat([x[1] for x in out], [len(x[0]) for x in out]), np.concatenate([x[2] for x in out])]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["token", "c1", "place"])

    return map_texts(rows, post, "token long, c1 long, place long")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of tokens that several sets post, each once.

    Postings come to a task in order of token, and one is held back until the next is seen, so a token of any frequency
    needs no memory."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, False  # the last posting so far, and whether an earlier one has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy() for c in ("token", "c1", "place")])
            if held is not None:
                x = np.concatenate([held, x], axis=1)
            new = np.ones(x.shape[1], bool)
            new[1:] = (x[:, 1:] != x[:, :-1]).any(0)
            x, start = x[:, new], found and held is not None
            same = x[0, 1:] == x[0, :-1]
            before, after = np.concatenate([[start], same]), np.concatenate([same, [False]])
            held, found = x[:, -1:], bool(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[:, :-1][:, (before | after)[:-1]]], ["token", "c1", "place"])
        if held is not None and found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["token", "c1", "place"])

    return postings.repartition("token").sortWithinPartitions("token", "c1", "place").mapInArrow(keep, "token long, c1 long, place long")


def _fetch(rows: DataFrame, k: int, counts, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted classes (node, c1, c2, first_id): node, n, tokens from the most frequent to the rarest, sketch.

    A filter of fixed size tells tasks which texts may be wanted; the join drops the few others it lets through. Rows that
    repeat in the input may give a set once per task, which does no harm."""
    bits = min(_FILTER_BITS, 1 << max(20, (16 * wanted.count()).bit_length()))
    chunk = 1 << 17

    def mark(table: pa.Table) -> pa.Table:
        found = np.zeros(chunk, np.uint8)
        found[table["bit"].to_numpy() % chunk] = 1
        return pa.table({"at": pa.array([int(table["bit"][0].as_py()) // chunk], pa.int64()), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    bit = F.pmod(F.xxhash64("first_id"), F.lit(bits))
    marked = wanted.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / chunk)).applyInArrow(mark, "at long, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for row in marked.collect():
        table[row["at"] * chunk // 8 : (row["at"] + 1) * chunk // 8] = np.frombuffer(row["bits"], np.uint8)
    wanted_bits = rows.sparkSession.sparkContext.broadcast(table)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, may, done = counts.value, wanted_bits.value, set()
        for batch in batches:
            for block in arrays.blocks(batch):
                at = block.column("bit").to_numpy()
                hit = (may[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
                if not hit.any():
                    continue
                block = block.filter(pa.array(hit.astype(bool)))
                out = []
                for _, own, one, two in _sets(block, k):
                    if (one, two) not in done:  # repeated rows
                        done.add((one, two))
                        ordered = own[np.lexsort((own, -cells[_cell(own)].astype(np.int64)))]
                        bits = np.zeros(64 * _SKETCH, np.uint8)
                        bits[(own % np.uint64(64 * _SKETCH)).astype(np.int64)] = 1
                        out.append((one, two, len(own), ordered.tobytes(), np.packbits(bits).view(np.int64).tolist()))
                columns = [*(pa.array([x[j] for x in out], pa.int64()) for j in range(3)), pa.array([x[3] for x in out], pa.binary()), pa.array([x[4] for x in out], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "n", "tokens", "sketch"])

    near = rows.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(bits)))
    found = map_texts(near.select("text", "bit"), fetch, "c1 long, c2 long, n long, tokens binary, sketch array<long>")
    return stage(small_join(found, wanted.select("c1", "c2", "node"), ["c1", "c2"], bound=_BOUND).select("node", "n", "tokens", "sketch"), "sets")


class SetTrie:
    """Sets in one global order as paths from a root; a node holds a run of tokens that all sets below it share."""

    class Node:
        __slots__ = ("run", "kids", "ends", "least", "most")

        def __init__(self, run: np.ndarray):
            self.run, self.kids, self.ends, self.least, self.most = run, {}, [], 1 << 60, 0

    def __init__(self) -> None:
        self.root = self.Node(np.zeros(0, np.uint64))

    def add(self, tokens: np.ndarray, name: int) -> None:
        node, at, n = self.root, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append(name)
                return
            kid = node.kids.get(tokens[at].item())
            if kid is None:
                kid = node.kids[tokens[at].item()] = self.Node(tokens[at:])
                kid.least = kid.most = n
                kid.ends.append(name)
                return
            m = min(len(kid.run), n - at)
            differ = kid.run[:m] != tokens[at : at + m]
            same = int(differ.argmax()) if differ.any() else m
            if same < len(kid.run):  # split the run
                upper = self.Node(kid.run[:same])
                upper.least, upper.most, upper.kids = kid.least, kid.most, {kid.run[same].item(): kid}
                kid.run = kid.run[same:]
                node.kids[tokens[at].item()] = kid = upper
            node, at = kid, at + same

    def similar(self, probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, list[int]]]:
        """(name, places in probes) for each set with probes for which 100 * intersection >= percent * union.

        Probes go down the tree together. What a run of tokens adds to their overlaps is counted once for all sets below
        it, and a probe leaves a branch when even the longest set below could not reach the similarity."""
        size = np.array([len(x) for x in probes])
        of = np.repeat(np.arange(len(probes)), size)
        tokens = np.concatenate(probes)
        order = np.argsort(tokens, kind="stable")
        tokens, of = tokens[order], of[order]
        stack = [(self.root, 0, np.zeros(len(probes), np.int64), np.arange(len(probes)))]
        while stack:
            node, depth, overlap, who = stack.pop()
            if len(node.run):
                low, high = np.searchsorted(tokens, node.run), np.searchsorted(tokens, node.run, "right")
                times = high - low
                places = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                overlap = overlap + np.bincount(of[places], minlength=len(probes))[who]
                depth += len(node.run)
            reach = np.minimum(size[who], overlap + node.most - depth)
            on = (100 + percent) * reach >= percent * (size[who] + node.least)
            overlap, who = overlap[on], who[on]
            if not len(who):
                continue
            if node.ends:
                near = who[(100 + percent) * overlap >= percent * (size[who] + depth)].tolist()
                if near:
                    yield from ((name, near) for name in node.ends)
            stack += [(kid, depth, overlap, who) for kid in node.kids.values()]


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b) that join what all linked ones of pairs join, and maybe some that were met with them.

    Pairs are dealt to blocks by a, those of a set with many partners by both, so that a block has some thousand tokens of
    pairs. The sets b of a block form one prefix tree, through which its sets a are sent together."""
    total = pairs.count()
    if not total:
        return pairs
    mean = sets.agg(F.avg("n")).first()[0] or 1.0
    per = max(1, min(300, int(_BLOCK_TOKENS / mean)))
    many = pairs.groupBy("a").count().where(F.col("count") > per).withColumn("salts", F.ceil(F.col("count") / per)).drop("count")
    salted = small_join(pairs, stage(many, "many"), ["a"], "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))))
    block = F.pmod(F.xxhash64("a", "salt"), F.lit(-(-total // per)))
    salted = stage(salted.select("a", "b", block.alias("block")), "salted")
    # a few numbers per pair go to the sets, not the sets to them, as long as the pairs are few
    members = small_join(sets.select(F.col("node").alias("b"), "tokens"), stage(salted.select("b", "block").distinct(), "in-trees"), ["b"], bound=_BOUND)
    probes = small_join(sets.select(F.col("node").alias("a"), "tokens"), stage(salted.select("a", "block").distinct(), "probes"), ["a"], bound=_BOUND)

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = SetTrie()
        for b, tokens in dict(zip(right["b"].to_pylist(), right["tokens"].to_pylist(), strict=True)).items():
            tree.add(np.frombuffer(tokens, np.uint64), b)
        asked = dict(zip(left["a"].to_pylist(), left["tokens"].to_pylist(), strict=True))
        names, out, up = list(asked), [], {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        if names and right.num_rows:
            for b, near in tree.similar([np.frombuffer(x, np.uint64) for x in asked.values()], percent):
                for j in near:
                    p, q = top(names[j]), top(b)
                    if p != q:  # links that join nothing new are not needed
                        up[p] = q
                        out.append((min(names[j], b), max(names[j], b)))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    probes, members = probes.toDF(*probes.columns), members.toDF(*members.columns)
    return stage(probes.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(verify, "a long, b long"), "links")


def _fit(percent: int):
    """Whether two sets can be linked if this is the first of their tokens that they share, in order of rarity."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent) - 1e-9)
    return (F.col("x.pos") <= F.col("x.n") - need) & (F.col("y.pos") <= F.col("y.n") - need)


def _may(percent: int):
    """Whether two sets can be linked, by their sketches: a bit that only one of them has set stands for a token of its own."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent) - 1e-9)

    def own(a: str, b: str):
        words = F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(words, F.lit(0), lambda total, w: total + w)

    return (F.col("x.n") - own("x", "y") >= need) & (F.col("y.n") - own("y", "x") >= need)


def jaccard_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of df with its group of similar texts: id_col, n_shingles, component_id.

    A text's set holds its distinct k-word shingles (words between white space, A-Z in lower case); fewer words count as
    one shingle. Two texts are linked when 100 * intersection >= percent * union of their sets; component_id is the
    smallest id that links lead to. Texts without words, or null, have no shingle, no link and their own id. Null ids
    are never a component_id unless no member has one. Repeated rows are equal sets. Other columns are left out.

    Exact, not sampled: texts with equal sets are one class first. Tokens are ordered by frequency (a sketch of counts over
    all texts; any order is right, a good one is fast), and each class posts its rarest tokens, one more than two linked
    sets can miss. Classes meet at a common token unless what remains of them is too short (groups.bucket_components:
    a group of near copies of any size needs few pairs)."""
    out = _components(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(rows: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """rows (id, text, and key if there is one) with n, node (of their component, null without words) and component_id."""
    spark = rows.sparkSession
    signed = _signatures(rows, k)
    counts = spark.sparkContext.broadcast(_token_counts(signed))
    texts = signed.where("n >= 0").drop("cells")
    classes = stage(
        texts.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "classes"
    )

    shared = stage(_shared(_postings(rows, k, percent, counts)), "shared")
    place = F.col("place")
    shared = shared.select(F.col("token").alias("bucket"), "c1", F.shiftright(place, 32).alias("n"), place.bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
    members = shared.join(classes.select("c1", "n", "node"), ["c1", "n"]).select("bucket", "node", "n", "pos")  # halves of digests that meet only add candidates

    def sets_of(nodes: DataFrame) -> DataFrame:
        return _fetch(rows, k, counts, stage(classes.join(nodes, "node", "left_semi"), "wanted"))

    found = bucket_components(
        members, _fit(percent), sets_of, lambda pairs, sets: _links(pairs, sets, percent),
        lambda sets: sets.select("node", "sketch").dropDuplicates(["node"]), _may(percent),
    )

    first = stage(classes.join(found, "node", "left").select("c1", "c2", "first_id", F.coalesce("component", "node").alias("component")), "first")
    smallest = first.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = first.join(smallest, "component").select("c1", "c2", F.col("component").alias("node"), "component_id")
    out = texts.join(named, ["c1", "c2"], "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of similar texts, in df's own columns: that of the smallest id.

    Of rows that share the smallest id, that of the smallest md5 of the text stays, and of equal ones any, but one only.
    Null ids come after all others. Texts without words, or null, are groups of their own, so all their rows stay.
    Columns of df may have any names; an empty table gives an empty one."""
    keyed = df.withColumn("__key", row_key(F.col(id_col), F.col(text_col)))
    found = stage(_components(keyed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("__key").alias("key")), **options), "found")
    worded = found.where("n > 0")
    stays = worded.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("node").agg(F.min("key").alias("key"))
    gone = worded.select("key").distinct().join(stays.select("key"), "key", "left_anti")
    several = worded.groupBy("key").count().where("count > 1").join(stays.select("key"), "key", "left_semi").select("key")
    return keep_one(keyed, "__key", gone, several).drop("__key")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END) AS t FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x, y FROM c JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS reach FROM w UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT r.rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.reach GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
