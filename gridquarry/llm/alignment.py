"""Cross-tokenizer alignment: two tokenizations of a text are cut where tokens of both end, by divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stage
from .packing import text_encoder

#: Linked id pairs of highest counts whose counts travel to all tasks: 17 bytes each, whatever the size of the input.
HOT_PAIRS = 1 << 18


class Tokens:
    """A tokenizer as the operator needs it: spelled[id] is the bytes of an id, encode(texts) gives the ids of each text and the bytes
    that they spell."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spelled: list[bytes]):
        self.ids, self.spelled = encode, spelled
        self.sizes = np.array([len(x) for x in spelled], np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        found = self.ids(texts)
        return [np.array(ids, np.uint32) for ids in found], [b"".join([self.spelled[k] for k in ids]) for ids in found]


@cache
def byte_level_tokens(tokenizer: str | None = None, ranks: str | None = None) -> Tokens:
    """A byte-level tokenizer of the tokenizers library, on a space and the text; special tokens' strings are plain text. By default
    the public one with 50,257 ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json")).get_vocab(with_added_tokens=True)
    # Entries are written in letters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands_for = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in printable)}
    spelled = [b""] * (max(vocabulary.values()) + 1)
    for entry, k in vocabulary.items():
        spelled[k] = bytes(stands_for[x] for x in entry)
    encode = text_encoder(tokenizer, ranks, plain_specials=True)
    return Tokens(lambda texts: encode([" " + x for x in texts]), spelled)


@cache
def piece_tokens(model: str | None = None) -> Tokens:
    """A model of the sentencepiece library, which puts a space before the text. By default the public one with 32,000 ids."""
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [own.id_to_piece(k) for k in range(own.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if own.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
    return Tokens(lambda texts: own.encode(texts, num_threads=1), spelled)


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ends, in order, at which tokens of both sides end, inside of intervals and at their ends.

    a and b are rising ends of tokens; interval k holds the ends first[k] to last[k] of a, the last of which is also in b.
    Divide and conquer: in each open interval the middle end of a is looked up in b by bisection, then its neighbours, ever
    farther from the middle, until one is an end of both: a cut, at which the interval falls into two. Intervals without a
    cut are leaves. All open intervals take each step together, and as cuts are dense, most find theirs at once."""
    cuts = [a[last]]
    low, high = first, last  # ends of a that may be cuts: low to high - 1
    while True:
        low, high = low[low < high], high[low < high]
        if not len(low):
            break
        middle, at, step = (low + high) // 2, np.full(len(low), -1), 0
        seeking = np.arange(len(low))
        while len(seeking):
            for side in (1, -1) if step else (1,):
                tried = middle[seeking] + side * step
                inside = (tried >= low[seeking]) & (tried < high[seeking])
                ends = a[np.where(inside, tried, low[seeking])]
                place = np.minimum(np.searchsorted(b, ends), len(b) - 1)
                hit = inside & (b[place] == ends)
                at[seeking[hit]] = tried[hit]
                seeking = seeking[~hit]
            step += 1
            reach = np.maximum(middle[seeking] - low[seeking], high[seeking] - 1 - middle[seeking])
            seeking = seeking[reach >= step]
        cut = at >= 0
        cuts.append(a[at[cut]])
        low, high = np.concatenate([low[cut], at[cut] + 1]), np.concatenate([at[cut], high[cut]])
    return np.sort(np.concatenate(cuts))


def _side(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, number of ids by text, bytes that they spell by text)."""
    ids, said = tokens.encode(texts)
    return np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64), np.array([len(x) for x in ids], np.int64), said


def align(texts: list[str], a: Tokens, b: Tokens) -> dict[str, np.ndarray | list]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its linked id pairs: pairs (a id times b's number of ids plus
    b id, rising), times (links of each) and n_pairs (how many). Texts without tokens have zeros and no digest."""
    n = len(texts)
    ids_a, count_a, said_a = _side(a, texts)
    ids_b, count_b, said_b = _side(b, texts)
    good = np.array([bool(x) and p == q == b" " + x.encode() for x, p, q in zip(texts, said_a, said_b, strict=True)], bool).reshape(n)
    ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
    count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
    end_a, end_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])  # over all texts; a text's last end is in both
    last = np.cumsum(count_a)[good] - 1
    cuts = shared_cuts(end_a, end_b, last - count_a[good] + 1, last) if len(last) else np.zeros(0, np.int64)

    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    text_of = np.searchsorted(end_a[last], cuts) if len(last) else np.zeros(0, np.int64)
    text_of = np.flatnonzero(good)[text_of]
    n_groups, n_links = np.bincount(text_of, minlength=n), np.bincount(text_of, in_a * in_b, n).astype(np.int64)

    # equal ids of a group count as one with its number of places, so that a group of many equal ids stays small
    key_a, times_a = np.unique(group_a * len(a.spelled) + ids_a, return_counts=True)
    key_b, times_b = np.unique(group_b * len(b.spelled) + ids_b, return_counts=True)
    distinct_a, distinct_b = key_a // len(a.spelled), key_b // len(b.spelled)
    many = np.bincount(distinct_b, minlength=len(cuts))
    start = np.cumsum(many) - many
    wide = many[distinct_a]
    left = np.repeat(np.arange(len(key_a)), wide)
    right = start[distinct_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide)
    pair = (key_a[left] % len(a.spelled)) * len(b.spelled) + key_b[right] % len(b.spelled)
    times, of = times_a[left] * times_b[right], text_of[distinct_a[left]]
    order = np.argsort(of * (len(a.spelled) * len(b.spelled)) + pair)
    pair, times, of = pair[order], times[order], of[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return {
        "n_a": count_a, "n_b": count_b, "n_groups": n_groups, "n_links": n_links,
        "groups_sha256": _digests(n, good, (ids_a, group_a, in_a, len(a.spelled)), (ids_b, group_b, in_b, len(b.spelled)), text_of),
        "pairs": pair[at], "times": np.add.reduceat(times, at) if len(at) else times, "n_pairs": np.bincount(of[at], minlength=n),
    }


@cache
def _written(ids_of_a: int, ids_of_b: int) -> list[bytes]:
    """Every id of a in writing, within and at the end of its group's side, then every id of b."""
    return [b"%d%s" % (k, mark) for n, marks in ((ids_of_a, (b",", b"|")), (ids_of_b, (b",", b";"))) for mark in marks for k in range(n)]


def _digests(n: int, good: np.ndarray, one: tuple, two: tuple, text_of: np.ndarray) -> list[str]:
    """sha256 of each text's groups in writing: ids of a, a bar, ids of b, groups between semicolons."""
    (ids_a, group_a, in_a, n_a), (ids_b, group_b, in_b, n_b) = one, two
    table = _written(n_a, n_b)
    final_a, final_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    words = np.empty(len(ids_a) + len(ids_b), np.int64)
    words[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = ids_a + final_a * n_a
    words[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = ids_b + final_b * n_b + 2 * n_a
    ends = np.cumsum(np.bincount(text_of, in_a + in_b, n).astype(np.int64)).tolist()
    out, start = [], 0
    for fine, end in zip(good.tolist(), ends, strict=True):
        said = b"".join([table[k] for k in words[start:end].tolist()])
        out.append(hashlib.sha256(said[:-1]).hexdigest() if fine else "")
        start = end
    return out


_COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(rows: DataFrame, make: Callable[[], tuple[Tokens, Tokens]]) -> DataFrame:
    """rows (id, text) with what align finds, and row, their number."""
    import pyarrow.compute

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                found = align([x or "" for x in block.column("text").to_pylist()], *make())
                offsets = pa.array(np.concatenate([[0], np.cumsum(found["n_pairs"])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c])) for c in ("pairs", "times")]
                columns = [block.column("id"), *(pa.array(found[c]) for c in _COUNTED), pa.array(found["groups_sha256"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", *_COUNTED, "groups_sha256", "pairs", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTED)}, groups_sha256 string, pairs array<long>, times array<long>"
    return stage(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame, ids_of_b: int) -> DataFrame:
    """pair, count (documents that hold it linked) and best: whether no other pair of its id of a has a higher count."""
    counts = stage(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").count(), "counts")
    a = F.floor(F.col("pair") / ids_of_b).alias("a")
    highest = counts.groupBy(a).agg(F.max("count").alias("highest"))
    return stage(counts.withColumn("a", a).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pair-counts")


def align_tokenizers(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    ranks: str | None = None,
    model: str | None = None,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Every row of df with the alignment of its text's two tokenizations: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256.

    Side a is a byte-level tokenizer on a space and the text (tokenizer, ranks: see text_encoder), side b a sentencepiece
    model; each token spells bytes. Places where tokens of both end cut a text into groups (shared_cuts); all tokens of a
    group's sides are linked. A pair of ids counts in how many rows it is linked. n_best counts a row's links whose pair has
    the highest count of all pairs of its id of a, ties included; count_sum adds up their counts.

    Texts that are null or empty, or whose tokens on either side do not spell a space and the text, have zeros and no digest
    (''). Repeated rows count each. An empty table gives no rows; other columns are left out.

    Each text is aligned once. Pairs are counted over all rows, with partial sums in tasks. The counts of the hot_pairs most
    frequent pairs, a table of fixed size, go to the rows, and so do most of all; the rows' other pairs go to the counts, in
    a join by pair in which no key is frequent."""

    def make() -> tuple[Tokens, Tokens]:
        return byte_level_tokens(tokenizer, ranks), piece_tokens(model)

    aligned = _aligned(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make)
    counts = pair_counts(aligned, len(piece_tokens(model).spelled))
    top = counts.orderBy(F.desc("count"), "pair").limit(hot_pairs).toPandas().sort_values("pair")
    hot = df.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["count"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def known(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(row, pair, times of each pair, whether it is hot, its place among those)."""
        lists = batch.column("pairs")
        pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
        table = hot.value[0]
        at = np.minimum(np.searchsorted(table, pair), max(len(table) - 1, 0))
        return of, pair, times, (table[at] == pair if len(table) else np.zeros(len(pair), bool)), at

    def sum_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            of, _, times, is_hot, at = known(batch)
            of, times, at = of[is_hot], times[is_hot], at[is_hot]
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, of, times * hot.value[2][at])
            np.add.at(total, of, times * hot.value[1][at])
            own = batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(best), pa.array(total)], [*own.schema.names, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            of, pair, times, is_hot, _ = known(batch)
            row = batch.column("row").to_numpy()[of[~is_hot]]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pair[~is_hot]), pa.array(times[~is_hot])], ["row", "pair", "times"])

    kind = aligned.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTED)}, groups_sha256 string, row long, n_best long, count_sum long"
    sums = aligned.select("id", *_COUNTED, "groups_sha256", "pairs", "times", "row").mapInArrow(sum_hot, schema)
    rest = stage(aligned.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long"), "others")
    rest = rest.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum")
    )
    more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    found = sums.join(rest, "row", "left")
    return found.select(F.col("id").alias(id_col), *_COUNTED, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Both tokenizations of every document, aligned."""
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
