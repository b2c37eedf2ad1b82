"""Token ids in binary files: shards compressed by Re-Pair grammars, with expansion lengths for decoding from any place."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import running_sums
from ..session import scratch_path
from . import arrays
from .common import map_texts

#: Ids of a shard, about: whole documents, so that a longer one makes a longer shard.
SHARD_TOKENS = 1 << 19
#: A pair becomes a nonterminal if it stands this often in the shard, and rounds end when one replaces less than this share of it.
LEAST_COUNT, LEAST_SHARE = 8, 0.02
#: Places of the sequence between two entries of the table of starts.
_STEP = 64
#: Bits of the cells that count pairs: tables of 2 MB.
_COUNT_BITS = 18
#: Units of words whose ids a Python worker remembers, and half as many words that are not split into units.
_UNITS = 1 << 20
#: Kinds of bytes: 1 letters (also the bytes of those of two), 2 digits, 3 signs, 4 line ends. Those of even kind stand alone.
_KINDS = np.array([4 if k == 10 else 2 if 48 <= k < 58 else 1 if 97 <= k < 123 or k >= 128 else 3 for k in range(256)], np.uint8)
_MAGIC = b"RPG1"


@dataclass
class Grammar:
    """Ids as a sequence of symbols. Symbols below first are ids; first + k stands for the two symbols of rule k, which are smaller.
    lengths holds the number of ids of each rule."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    sequence: np.ndarray
    _starts: np.ndarray | None = None

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.first
        out[ruled] = self.lengths[symbols[ruled] - self.first]
        return out

    def expand(self, symbols: np.ndarray | None = None) -> np.ndarray:
        """The ids of symbols, or of all. Of symbols, every pass replaces all nonterminals at once; there are as many passes as the
        deepest rule has levels. Of all, every rule is expanded once, and its ids are copied to wherever it stands."""
        if symbols is None:
            return self._expand_all()
        out = symbols
        while True:
            ruled = out >= self.first
            if not ruled.any():
                return out
            at = np.cumsum(ruled + 1) - 1  # place of a symbol, or of the second of its two
            new = np.empty(at[-1] + 1, np.uint32)
            new[at[~ruled]] = out[~ruled]
            pair = self.rules[out[ruled] - self.first]
            new[at[ruled] - 1], new[at[ruled]] = pair[:, 0], pair[:, 1]
            out = new

    def _expand_all(self) -> np.ndarray:
        flat, lengths = np.zeros(0, np.uint32), self.lengths.astype(np.int64)
        ends, most = np.cumsum(lengths), self.rules.max(1, initial=0)

        def ids(symbols: np.ndarray) -> np.ndarray:
            """Ids of symbols whose rules are in flat, in which symbols themselves come behind."""
            ruled, size = symbols >= self.first, self._long(symbols)
            begins = np.arange(len(flat), len(flat) + len(symbols))
            rule = symbols[ruled] - self.first
            begins[ruled] = ends[rule] - lengths[rule]
            after = np.cumsum(size)
            return np.concatenate([flat, symbols])[np.repeat(begins - after + size, size) + np.arange(after[-1])]

        done = 0
        while done < len(self.rules):  # all rules at once that stand for what is expanded already
            open_ = np.flatnonzero(most[done:] >= self.first + done)
            upto = done + int(open_[0]) if len(open_) else len(self.rules)
            flat = np.concatenate([flat, ids(self.rules[done:upto].reshape(-1))])
            done = upto
        return ids(self.sequence) if done else self.sequence

    def __len__(self) -> int:
        return int(self.starts()[-1])

    def starts(self) -> np.ndarray:
        """Ids before every _STEP-th symbol, and of all: what a reader looks places up in."""
        if self._starts is None:
            ends = np.cumsum(self._long(self.sequence))
            self._starts = np.concatenate([[0], ends[_STEP - 1 : -1 : _STEP], ends[-1:] if len(ends) else [0]]).astype(np.int64)
        return self._starts

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: the table of starts finds the symbols, lengths pass over all that lies outside, and only rules that
        cross an end are opened one by one."""
        starts = self.starts()
        start, stop = max(0, start), min(stop, int(starts[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        block = int(np.searchsorted(starts[:-1], start, "right")) - 1
        last = int(np.searchsorted(starts[:-1], stop, "left"))
        symbols = self.sequence[block * _STEP : last * _STEP]
        ends = starts[block] + np.cumsum(self._long(symbols))
        begins = ends - self._long(symbols)
        out = []
        inside = (begins >= start) & (ends <= stop)
        for crossing, part in groupby(range(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(begins, stop, "left"))), lambda k: not inside[k]):
            part = list(part)
            if not crossing:
                out.append(self.expand(symbols[part]))
                continue
            for k in part:
                out += self._cut(int(symbols[k]), start - int(begins[k]), stop - int(begins[k]))
        return np.concatenate(out)

    def _cut(self, symbol: int, start: int, stop: int) -> list[np.ndarray]:
        """Ids start to stop of one symbol's, in order."""
        out, stack = [], [(symbol, 0)]
        while stack:
            symbol, at = stack.pop()
            n = int(self.lengths[symbol - self.first]) if symbol >= self.first else 1
            if at >= stop or at + n <= start:
                continue
            if symbol < self.first or (at >= start and at + n <= stop):
                out.append(self.expand(np.array([symbol], np.uint32)))
                continue
            left, right = self.rules[symbol - self.first].tolist()
            first = int(self.lengths[left - self.first]) if left >= self.first else 1
            stack += [(right, at + first), (left, at)]
        return out

    def to_bytes(self) -> bytes:
        """Little-endian: magic, first, number of rules, of symbols and of starts; rules; their lengths; the sequence; starts; a crc32."""
        starts = self.starts()
        head = _MAGIC + struct.pack("<IIQI", self.first, len(self.rules), len(self.sequence), len(starts))
        body = b"".join([head, self.rules.astype("<u4").tobytes(), self.lengths.astype("<u4").tobytes(), self.sequence.astype("<u4").tobytes(), starts.astype("<u8").tobytes()])
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Grammar:
        if data[:4] != _MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("no grammar, or a damaged one")
        first, rules, symbols, starts = struct.unpack("<IIQI", data[4:24])
        at = 24
        pairs = np.frombuffer(data, "<u4", 2 * rules, at).reshape(-1, 2)
        lengths = np.frombuffer(data, "<u4", rules, at + 8 * rules)
        at += 12 * rules
        return cls(first, pairs, lengths, np.frombuffer(data, "<u4", symbols, at), np.frombuffer(data, "<u8", starts, at + 4 * symbols).astype(np.int64))


def _frequent(keys: np.ndarray, least_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places that may hold a frequent key, the number of each one's key (-1: it is not frequent), those keys and their counts.

    Keys are counted by hash. A cell counts the last of its keys; other keys of a cell, which are few, are sorted."""
    cells = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)
    may = np.flatnonzero(np.bincount(cells, minlength=1 << _COUNT_BITS)[cells] >= least_count)
    keys, cells = keys[may], cells[may]
    held = np.empty(1 << _COUNT_BITS, np.uint64)
    held[cells] = keys
    own = held[cells] == keys
    counts = np.bincount(cells[own], minlength=1 << _COUNT_BITS)
    used = np.flatnonzero(counts >= least_count)
    number = np.full(1 << _COUNT_BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    of = np.where(own, number[cells], -1)
    rest, at, times = np.unique(keys[~own], return_inverse=True, return_counts=True)
    often = times >= least_count
    of[~own] = np.where(often, len(used) + np.cumsum(often) - 1, -1)[at]
    return may, of, np.concatenate([held[used], rest[often]]), np.concatenate([counts[used], times[often]])


def re_pair(ids: np.ndarray, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE) -> Grammar:
    """Replace frequent pairs of neighbours by nonterminals, round by round, the most frequent first.

    A round counts all pairs and gives a nonterminal to those that stand least_count times or more. Where replaceable pairs
    overlap, the more frequent one is taken, by powers of two, and among those of a power the one that a hash puts first, so
    that a chain of equally frequent pairs is replaced in many places at once; nonterminals that few places are left for are
    given back. Rounds end when one would shorten the sequence by less than least_share of it."""
    sequence = ids.astype(np.uint32)
    first = int(sequence.max(initial=0)) + 1
    rules, lengths = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.int64)]
    top = first
    while len(sequence) >= 2 * least_count:
        keys = (sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:]
        may, of, pairs, counts = _frequent(keys, least_count)
        if not len(pairs):
            break
        order = np.lexsort((arrays.mix(pairs) >> np.uint64(32), np.frexp(counts.astype(float))[1]))
        pairs, by = pairs[order], np.empty(len(pairs) + 1, np.int32)
        by[order], by[-1] = np.arange(1, len(pairs) + 1), 0
        rank = np.zeros(len(keys) + 2, np.int32)  # of the pair at a place, with one more place at either end; 0: no rule
        rank[1:-1][may] = by[of]
        own, before, after = rank[1:-1], rank[:-2], rank[2:]
        taken = (own > 0) & (own > before) & (own >= after)
        same = (own > 0) & (own == before)  # runs of one pair overlap themselves: every second place
        if same.any():
            runs = np.flatnonzero((own > 0) & (own == after) & (own != before))
            for at in runs.tolist():
                end = at
                while own[end + 1 : end + 2].size and own[end + 1] == own[at]:
                    end += 1
                taken[at : end + 1] = False
                taken[at : end + 1 : 2] = True
                if own[end + 1 : end + 2].size and own[end + 1] > own[at]:
                    taken[end] = False
                if at and taken[at - 1]:
                    taken[at] = False
        places = np.flatnonzero(taken)
        left = np.bincount(own[places], minlength=len(pairs) + 1)[1:]
        good = np.flatnonzero(left >= max(3, least_count // 2))  # a rule costs three numbers
        good = good[np.argsort(pairs[good])]
        number = np.full(len(pairs) + 1, -1)
        number[good + 1] = np.arange(len(good))
        of = number[own[places]]
        places, of = places[of >= 0], of[of >= 0]
        if len(places) < least_share * len(sequence) or not len(places):
            break
        new = pairs[good]
        pair = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.concatenate(lengths)
        size = np.ones(pair.shape, np.int64)
        ruled = pair >= first
        size[ruled] = known[pair[ruled] - first]
        rules.append(pair)
        lengths.append(size.sum(1))
        sequence = sequence.copy()
        sequence[places] = top + of
        keep = np.ones(len(sequence), bool)
        keep[places + 1] = False
        sequence, top = sequence[keep], top + len(pair)
    return Grammar(first, np.concatenate(rules), np.concatenate(lengths), sequence)


class Remembered:
    """Keys with what make gives for each. Half of most (or the keys of one call, if they are more) stand in a young table; when it is
    full it becomes the old one, from which keys that are asked for again come back, so that frequent ones are not made anew."""

    def __init__(self, make: Callable, most: int = _UNITS):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def of(self, keys: list) -> list:
        """What is given for keys, which differ."""
        found = list(map(self.young.get, keys))
        new = [k for k, x in enumerate(found) if x is None]
        if new and len(self.young) + len(new) > self.most // 2:
            self.old, self.young, found, new = self.young, {}, [None] * len(keys), range(len(keys))
        for k in new:
            made = self.old.get(keys[k])
            self.young[keys[k]] = found[k] = self.make(keys[k]) if made is None else made
        return found


def _offsets(binary: pa.Array) -> np.ndarray:
    """Where the values of a whole array of large_binary begin, and the last one ends."""
    return np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1) if len(binary) else np.zeros(1, np.int64)


def _joined(texts: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), pa.scalar(by, pa.large_string()))[0].as_py()


def _units(words: str) -> tuple[pa.Array, np.ndarray]:
    """Pieces of words, each of which a line end ends, and which of the pieces are line ends, pieces of their own.

    For lower case of common Latin letters and signs, this is the default tokenizer's pattern: 's, 't, 're, 've, 'm, 'll, 'd where a
    piece begins, else runs of letters, single digits, runs of other signs."""
    raw = words.encode()
    data = np.frombuffer(raw, np.uint8)
    kind = _KINDS[data]
    if len(raw) > len(words):  # the second bytes of two signs among letters, each with its first
        signs = np.flatnonzero((data == 0x97) | (data == 0xB7))
        kind[signs] = kind[signs - 1] = 3
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] % 2 == 0)
    at = np.flatnonzero(begin & (data == ord("'")))
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    size = np.where(long, 2, np.isin(one, list(b"stmd")).astype(int))
    at, size = at[size > 0], size[size > 0]
    begin[at + 1] = False
    begin[at + 1 + size] = True
    starts = np.flatnonzero(begin)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(raw)]), kind[starts] == 4


@cache
def texts_encoder(tokenizer: str | None = None) -> Callable[[pa.Array], list[bytes]]:
    """A function from an array of texts, none null, to their ids as little-endian 32-bit numbers. No special tokens are added, but
    those that stand in a text are found. tokenizer: a file of the tokenizers library, by default the public lower-casing one with
    49,408 ids.

    The default one never looks across ASCII white space: it drops it, its patterns match none, and neither normal forms nor
    lower case reach across. So each different word of an array is encoded once. Words of common Latin letters and signs, which
    its normal form leaves alone, are split as its pattern splits them, all at once, and the library's model gives the ids of
    units that are not remembered; the library encodes other words as they are, remembered too. Other tokenizers encode whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    exact = Tokenizer.from_file(tokenizer or public_tokenizers.path("word_bpe_49k.json"))

    def encode(text: str) -> bytes:
        ids = exact.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    if tokenizer:
        return lambda texts: list(map(encode, texts.to_pylist()))
    common, special = re.compile("[\n\x21-\x7E\u00C0-\u00FF]*").fullmatch, re.compile(r"<\|(start|end)oftext\|>").search
    level, model = ByteLevel(add_prefix_space=False, use_regex=False), exact.model
    as_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))})  # letters that stand for bytes

    def unit(text: str) -> bytes:
        ids = [x.id for x in model.tokenize(text if text.isascii() else text.translate(as_bytes))] if text != "\n" else []
        return struct.pack(f"<{len(ids)}I", *ids)

    known, known_words = Remembered(unit), Remembered(encode, _UNITS // 2)

    def plain(words: str) -> pa.Array:
        pieces, last = _units(words.lower() + "\n")
        pieces = pieces.dictionary_encode()
        ids = pa.array(known.of(_joined(pieces.dictionary, " ").split(" ")), pa.large_binary()).take(pieces.indices)
        ends = _offsets(ids)[1:][last]
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), ids.buffers()[2]])

    def encode_words(words: str) -> pa.Array:
        if common(words) and not special(words):
            return plain(words)
        split = words.split("\n")
        own = np.array([common(x) is not None and not special(x) for x in split])
        order = np.argsort(np.argsort(~own, kind="stable"))
        others = pa.array(known_words.of(list(compress(split, ~own))), pa.large_binary())
        return pa.concat_arrays([plain("\n".join(compress(split, own)))[: own.sum()], others]).take(pa.array(order))

    def encode_texts(texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.values.dictionary_encode()
        ids = encode_words(_joined(words.dictionary, "\n")).take(words.indices)
        ends = _offsets(ids)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    return encode_texts


def word_encoder(tokenizer: str | None = None) -> Callable[[str], bytes]:
    """texts_encoder for one text at a time."""
    encode = texts_encoder(tokenizer)
    return lambda text: encode(pa.array([text], pa.string()))[0]


def write_token_files(
    df: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None
) -> None:
    """The ids of df's documents, each whole text's and end_id, in ascending order of document id under path: shards, and index, the
    ids before each shard.

    A row of shards is one shard: part and shard (its place), ids and lengths (of its documents, in order), n_tokens, and grammar
    (see Grammar.to_bytes), its token ids replaced by Re-Pair. A shard holds whole documents, shard_tokens ids or the one that
    passes them, so a task holds one shard, and a frequent document id fills as many shards as it needs. Null ids come first;
    rows of equal id are ordered by a digest of their text, and equal rows are alike. Null and empty texts are one end_id. An
    empty table gives empty files; other columns are left out.

    Texts are put in order as they are, and become ids and grammars in the tasks that write them."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(1, -(-total // (16 * shard_tokens)))  # a few shards a task
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, held_ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        encode, end = None, struct.pack("<I", end_id)

        def made() -> pa.RecordBatch:
            grammar = re_pair(np.frombuffer(b"".join(held), "<u4")).to_bytes()
            lengths = [len(x) // 4 for x in held]
            ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(held_ids))
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), ids, pa.array([lengths], pa.list_(pa.int32())), pa.array([size], pa.int64()), pa.array([grammar], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "shard", "ids", "lengths", "n_tokens", "grammar"])

        for batch in batches:
            encode = encode or texts_encoder(tokenizer)
            start = 0
            for row, found in enumerate(encode(batch.column("text"))):
                held.append(found + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    held_ids.append(batch.column("id").slice(start, row + 1 - start))
                    yield made()
                    start, shard, held, held_ids, size = row + 1, shard + 1, [], [], 0
            if start < batch.num_rows:
                held_ids.append(batch.column("id").slice(start))
        if held:
            yield made()

    placed = rows.select("id", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("at"), "text")
    ordered = placed.repartitionByRange(parts, "id", "key", "at").sortWithinPartitions("id", "key", "at").select("id", "text")
    shards = map_texts(ordered, cut, f"part int, shard int, ids array<{kind}>, lengths array<int>, n_tokens long, grammar binary")
    shards.write.option("compression", "zstd").parquet(f"{path}/shards")
    sizes = df.sparkSession.read.parquet(f"{path}/shards").select("part", "shard", "n_tokens")
    found = running_sums(sizes, [F.col("part"), F.col("shard")], {"upto": F.col("n_tokens")})
    found.select("part", "shard", (F.col("upto") - F.col("n_tokens")).alias("base")).write.parquet(f"{path}/index")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of write_token_files: id, start (ids of all documents before), n_tokens, ids_crc32 and, with_ids, the ids
    themselves, as little-endian 32-bit numbers. A task expands one shard after the other."""
    shards = spark.read.parquet(f"{path}/shards")
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    rows = shards.join(spark.read.parquet(f"{path}/index"), ["part", "shard"]).select("ids", "lengths", "grammar", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = batch.column("ids")[row].values, batch.column("lengths")[row].values.to_numpy()
                data = memoryview(Grammar.from_bytes(batch.column("grammar")[row].as_py()).expand().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                parts = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [ids, pa.array(batch.column("base")[row].as_py() + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return rows.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The ids of ranges (name, start, stop: places among all ids of write_token_files), decoded from the shards they touch without
    expanding these: name, at (place of the first), ids (little-endian 32-bit numbers), a row for each shard that a range touches.

    Shards are found by blocks of places, so neither side need be small; what lies outside of all ids gives no row."""
    shards = spark.read.parquet(f"{path}/shards").select("part", "shard", "n_tokens").join(spark.read.parquet(f"{path}/index"), ["part", "shard"])
    width = SHARD_TOKENS
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    wanted = ranges.select("name", "start", "stop").where("stop > start AND start >= 0").withColumn("block", blocks(F.col("start"), F.col("stop")))
    own = shards.withColumn("block", blocks(F.col("base"), F.col("base") + F.col("n_tokens")))
    met = wanted.join(own, "block").where("start < base + n_tokens AND stop > base").select("name", "start", "stop", "part", "shard", "base").distinct()
    rows = spark.read.parquet(f"{path}/shards").select("part", "shard", "grammar").join(met, ["part", "shard"]).drop("part", "shard")
    kind = ranges.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, stop, base = (batch.column(c)[row].as_py() for c in ("start", "stop", "base"))
                ids = Grammar.from_bytes(batch.column("grammar")[row].as_py()).slice(start - base, stop - base)
                yield pa.RecordBatch.from_arrays([batch.column("name").slice(row, 1), pa.array([max(start, base)]), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["name", "at", "ids"])

    return rows.mapInArrow(run, f"name {kind}, at long, ids binary")


def op13_tokens(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, written to token files and read back from them."""
    path = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")
