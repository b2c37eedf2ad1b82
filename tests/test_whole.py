"""Operators and queries that must cover every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.operators import joins, latent
from gridquarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_ranked_over_several_ranges(spark):
    rng = np.random.default_rng(8)
    rows = [(int(s), k) for k, s in enumerate(rng.integers(0, 40, 500))]
    got = joins.ranked(spark.createDataFrame(rows, "s long, k long"), [F.desc("s"), F.asc("k")], per=60)
    assert [(r["s"], r["k"]) for r in got.orderBy("rank").collect()] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, 501))
    assert joins.ranked(got.drop("rank").limit(0), [F.asc("k")]).count() == 0


def test_rerank_ranks_every_kept_hit(spark):
    got = [tuple(r) for r in QUERIES["w01_rerank"](spark, SF).orderBy("rank").select("rank", "score", "lat", "lon", "product_id").collect()]
    kept = [tuple(r) for r in QUERIES["i02_nms_sphere"](spark, SF).select("score", "lat", "lon", "product_id").collect()]
    assert len(kept) > 1000
    assert got == [(k, *r) for k, r in enumerate(sorted(kept, key=lambda r: (-r[0], *r[1:])), 1)]


def test_strain_and_ratio_of_every_vector(spark):
    rng = np.random.default_rng(10)
    h, low = rng.normal(size=(700, 5)), rng.normal(size=(700, 2))
    high, flat = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>") for x in (h, low))
    queries = high.where("id % 50 = 0").select(F.col("id").alias("query"))
    u, at = h / np.linalg.norm(h, axis=1, keepdims=True), np.arange(0, 700, 50)
    off = np.arange(700)[:, None] != at
    a, b = np.clip(1 - u @ u[at].T, 0, 2), np.linalg.norm(low[:, None] - low[at], axis=2)
    want = np.where(off, (a - b * np.median(a) / np.median(b)) ** 2 / np.where(off, a, 1), 0).sum(1)
    got = {r["id"]: r["strain"] for r in latent.sammon_strain(high, flat, queries=queries).collect()}
    assert [got[k] for k in range(700)] == pytest.approx(want.tolist())
    d = np.linalg.norm(h[:, None] - h[at], axis=2)
    ratio = (b[off] / np.median(b[off])) / (d[off] / np.median(d[off]))
    assert latent.jl_distortion(high, flat, queries=queries) == pytest.approx((ratio.mean(), max(0, 1 - np.abs(ratio - 1).mean())))


def test_latent_summary_covers_every_vector(spark):
    got = QUERIES["k08_latent_summary"](spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.count() == n
    assert {"ratio", "degree", "c1", "c2"} <= set(got.columns)
    assert got.where("strain IS NULL OR ratio IS NULL OR degree IS NULL OR c1 IS NULL").isEmpty()
