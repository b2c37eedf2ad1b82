"""Vectors and binary codes as columns, and their numpy forms for tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """A vector of zeros stays. The vector and its norm are evaluated once, not once for each component."""
    divided = lambda v, n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))
    return F.transform(F.array(a), lambda v: F.transform(F.array(l2_norm(v)), lambda n: divided(v, n))[0])[0]


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero."""
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def hamming(a: Column, b: Column, words: int | None = None) -> Column:
    """Differing bits of two codes (arrays of 64-bit words), or of their first words."""
    if words:
        a, b = F.slice(a, 1, words), F.slice(b, 1, words)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def code_signs(dim: int, seed: int = 42) -> np.ndarray:
    """The fixed signs of binary codes: every producer of codes must use the same."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=dim).astype(float)


def hadamard_matrix(dim: int) -> np.ndarray:
    """Sylvester's matrix for powers of two; Paley's of order 12 times Sylvester's for 12 times a power of two."""
    small, rest = (np.ones((1, 1)), dim)
    if dim % 12 == 0 and (dim // 12) & (dim // 12 - 1) == 0:
        residues = {k * k % 11 for k in range(1, 11)}
        small, rest = np.ones((12, 12)), dim // 12
        small[1:, 1:] = [[1.0 if (j - i) % 11 in residues else -1.0 for j in range(11)] for i in range(11)]
    if rest & (rest - 1):
        raise ValueError(f"no transform of order {dim}")
    large = np.ones((1, 1))
    while len(large) < rest:
        large = np.block([[large, large], [large, -large]])
    return np.kron(small, large)


def binary_codes(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """(rows, dim / 64) 64-bit codes: bit i of word i div 64 is set where coordinate i of the transformed unit vector is >= 0."""
    x = np.asarray(x, float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1) * code_signs(x.shape[1], seed)
    bits = x @ hadamard_matrix(x.shape[1]).T >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")
