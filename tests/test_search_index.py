"""Threshold search through parts of codes, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.operators import search


def planted(words, n=2000, queries=40):
    """Random codes, and queries that differ from one of them in 0 to 39 bits."""
    rng = np.random.default_rng(words)
    x = rng.integers(-(2**63), 2**63, (n, words))
    bits = np.unpackbits(x[rng.choice(n, queries, replace=False)].view(np.uint8), axis=1)
    for k in range(queries):
        bits[k, rng.choice(64 * words, k, replace=False)] ^= 1
    return x, np.packbits(bits, axis=1).view(np.int64)


def distances(x, q):
    return sum(np.bitwise_count((x[:, w, None] ^ q[None, :, w]).view(np.uint64)).astype(int) for w in range(x.shape[1]))


@pytest.mark.parametrize("words", [1, 2, 6])
@pytest.mark.parametrize("base", [-1, 0, 5, 16, 26, 113])
def test_near_pairs_equal_all_pairs(words, base):
    x, q = planted(words)
    t = np.random.default_rng(base + 1).integers(max(base - 3, -1), base + 1, len(q))
    row, query, d = search.CodeIndex(q, t).near(x)
    all_ = distances(x, q)
    want = np.nonzero(all_ <= t)
    assert (row == want[0]).all() and (query == want[1]).all() and (d == all_[want]).all()


def test_few_full_distances():
    """At a threshold of 26 bits of 384, far fewer than a tenth of all pairs are compared to the last word."""
    x, q = planted(6)
    index = search.CodeIndex(q, np.full(len(q), 26))
    row, _, _ = index.near(x)
    assert len(row) >= 27
    assert index.selective and index.full < 0.01 * len(x) * len(q)


def test_vote_and_range_through_the_index(spark, monkeypatch):
    x, q = planted(6, 300, 30)
    monkeypatch.setattr(search, "BLOCK", 7)
    codes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<long>").repartition(3)
    queries = spark.createDataFrame([(k, v.tolist(), 20 + k % 7, k % 3) for k, v in enumerate(q)], "query long, v array<long>, threshold int, family int")
    near = [(k, j, int(d)) for (j, k), d in np.ndenumerate(distances(x, q)) if d <= 20 + k % 7]
    assert sorted(map(tuple, search.hamming_range(codes, queries).collect())) == sorted(near)
    got = {r["id"]: (r["mask"], r["best"], r["n_families"]) for r in search.resonant_vote(codes, queries).collect()}
    want = {}
    for k, j, d in near:
        families, best = want.get(j, (set(), 999))
        want[j] = families | {k % 3}, min(best, d)
    assert got == {j: (sum(1 << f for f in fs), best, len(fs)) for j, (fs, best) in want.items()}
    assert search.hamming_range(codes.limit(0), queries).count() == 0
    assert search.hamming_range(codes, queries.where(F.lit(False))).count() == 0
