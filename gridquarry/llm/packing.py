"""Best-fit packing: token pieces go into sequences of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import map_texts, stage

#: Where the two tokenizer libraries surely split alike; other texts go to the slower one that defines the ids.
_COMMON = re.compile(r"[^\x00-ɏ]|<\|endoftext\|>")


def text_encoder(tokenizer: str | None, ranks: str | None, plain_specials: bool = False):
    """A function from texts to lists of ids. ranks holds tokenizer's own vocabulary for a faster library, or is empty. With
    plain_specials, the strings of special tokens are text like others."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = plain_specials
    if tokenizer and not ranks:
        return lambda texts: [x.ids for x in exact.encode_batch_fast(texts, add_special_tokens=False)]
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(x, add_special_tokens=False).ids if _COMMON.search(x) else fast.encode_ordinary(x) for x in texts]

    return encode


def token_pieces(
    df: DataFrame,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    tokenizer: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """The token ids of each text plus end_id, in pieces of capacity ids; of a longer text the first piece may be shorter.

    Columns: id, piece (from 0), start, length, ids_crc32 (of the ids as little-endian 32-bit numbers), and with_ids the
    ids themselves in that form. Null texts count as empty (one piece: end_id). tokenizer is the path of a file of the
    tokenizers library, by default the public byte-level one with 50,257 ids; executors read it themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            for block in arrays.blocks(batch):
                encode = encode or text_encoder(tokenizer, ranks)
                at, piece, start, length, crc, held = [], [], [], [], [], []
                for row, ids in enumerate(encode([x or "" for x in block.column("text").to_pylist()])):
                    ids = np.array([*ids, end_id], "<u4")
                    cuts = np.arange(len(ids) % capacity or capacity, len(ids), capacity)
                    for k, part in enumerate(np.split(ids, cuts)):
                        at.append(row)
                        piece.append(k)
                        start.append(int(cuts[k - 1]) if k else 0)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        held.append(part.tobytes() if with_ids else None)
                out = [block.column("id").take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_texts(rows, cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, number of sequences) for items in the given order.

    open[g] counts the open sequences with gap g. An item goes into the gap, of its own length or more, for which the sum of
    the squares of these counts is smallest afterwards; a new sequence is opened only if no gap takes it. Ties take the
    smallest gap."""
    count = np.zeros(capacity + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        after = 2 * (count[: capacity + 1 - size] - count[size:]) + 2  # from gap g to g - size
        after[count[size:] == 0] = 1 << 40
        after[-1] = 1 << 39  # a new sequence
        if size < capacity and count[size]:
            after[0] = 1 - 2 * count[size]  # closes a sequence
        gap = size + int(after.argmin())
        if gap == capacity:
            bin_, used = used, used + 1
        else:
            bin_ = by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = bin_, capacity - gap
        if gap > size:
            by_gap[gap - size].append(bin_)
            count[gap - size] += 1
    return sequence, offset, used


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """sum_of_squares by falling length, equal lengths as they come; the same for blocks of any size."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    sequence[order], offset[order], used = sum_of_squares(lengths[order], capacity)
    return sequence, offset, used


def pack(pieces: DataFrame, capacity: int = 2048, block_pieces: int = 1 << 16) -> DataFrame:
    """Places of pieces (row, length; row is unique): row, sequence_id, offset. Lengths are 1 to capacity.

    Pieces of full length are sequences by themselves. The others are dealt by a hash of their row to blocks of about
    block_pieces, and each block is packed on its own: at that size the rule wastes well under one percent, and neither
    a task nor the driver holds more than one block."""
    blocks = max(1, -(-pieces.where(F.col("length") < capacity).count() // block_pieces))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sequence, offset, _ = pack_block(table["length"].to_numpy(), capacity)
        block = int(table["block"][0].as_py())
        return pa.table({"row": table["row"], "sequence_id": pa.array(sequence + (block << 32)), "offset": pa.array(offset)})

    short = pieces.where(F.col("length") < capacity).select("row", "length", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    packed = short.groupBy("block").applyInArrow(place, "row long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(df: DataFrame, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """token_pieces of df's texts, each with its place: sequence_id and offset (gapless from 0 in each sequence).

    Extra columns of df are left out, so names cannot clash; ids may be null or repeat. An empty table packs to nothing."""
    pieces = stage(token_pieces(df, capacity, end_id, **options).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "row").drop("row")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, tokenized, in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
