"""Arrow text columns as numpy arrays, for tasks that handle whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; what a task holds is a small multiple of it (and of its longest text).
BLOCK_BYTES = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Separators of words as byte masks: white space only, and everything in ASCII but letters and digits.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BLOCK_BYTES of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _power(n: int) -> list[np.ndarray]:
    """_BASE to the powers 0 to n, and the inverses; kept for up to BLOCK_BYTES."""
    if len(_powers[0]) > n:
        return _powers
    found = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(max(n, BLOCK_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if n <= BLOCK_BYTES:
        _powers[:] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct_pairs(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first of each different pair of a text's number and a hash, told apart by 64 bits of both."""
    with np.errstate(over="ignore"):
        return np.unique(mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, counts): places of the words in the bytes, and words of each text. No word spans two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words (in order of start) with A-Z in lower case: a polynomial over the word's bytes, mixed. Words are
    taken in runs of about BLOCK_BYTES, so a long text needs no more memory than a block does."""
    out, at = np.empty(len(start), np.uint64), 0
    with np.errstate(over="ignore"):
        while at < len(start):
            low = start[at]
            to = max(at + 1, int(np.searchsorted(end, low + BLOCK_BYTES, "right")))
            part, first, last = data[low : end[to - 1]], start[at:to] - low, end[at:to] - low
            power, inverse = _power(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[_LOWER[part]] * power[: len(part)], out=total[1:])
            out[at:to] = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
            at = to
    return out


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_sets(batch: pa.RecordBatch, k: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, counts): for each text the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    data, offsets = utf8(batch.column(text))
    start, end, counts = words(data, offsets, BLANKS)
    hashes = word_hashes(data, start, end)
    with np.errstate(over="ignore"):
        of = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the end of the text
        rolled, wide = np.zeros(len(hashes), np.uint64), np.minimum(counts, k)
        for j in range(min(k, len(hashes))):  # a block may hold fewer words than a shingle
            ok = left > j
            rolled[ok] = rolled[ok] * _BASE + hashes[j:][ok[: len(hashes) - j]] if j else hashes[ok]
        keep = left >= wide[of]
        tokens, of = mix(rolled[keep] + wide[of[keep]].astype(np.uint64)), of[keep]
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    return tokens[new], np.bincount(of[new], minlength=len(counts))
