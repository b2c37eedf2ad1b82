"""Repeated stratified cross-validation against models trained fold by fold, and folds and splits over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.operators import evaluation, joins

SETS = {"a": ["x0"], "b": ["x0", "x2"], "all": ["x0", "x1", "x2", "x3"], "flat": ["x4"]}


def rows(n=240):
    rng = np.random.default_rng(3)
    y = (rng.random(n) < 0.3).astype(int)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3] + y[:, None] * [1.0, 4.0, 0.02, 0.0] + [0, 50, 0, -2]
    return y, np.round(np.column_stack([x, np.full(n, 7.0)]), 2)


def pr_area(s, y):
    order = np.argsort(-s, kind="stable")
    s, y = s[order], y[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, n = np.cumsum(y)[last], np.arange(1, len(y) + 1)[last]
    recall, precision = np.append(0, tp / y.sum()), np.append(1, tp / n)
    return float((np.diff(recall) * (precision[1:] + precision[:-1]) / 2).sum())


def brute(x, y, train, test, penalty=1.0):
    """Weighted ridge regression on standardised features, by its own matrices."""
    mean, spread = x[train].mean(0), x[train].std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / np.where(spread > 1e-12, spread, 1)])
    w = np.where(y[train] == 1, len(train) / (2 * y[train].sum()), len(train) / (2 * (1 - y[train]).sum()))
    a = z[train].T @ (z[train] * w[:, None]) + penalty * np.diag([1e-9] + [1.0] * x.shape[1])
    s = z[test] @ np.linalg.solve(a, z[train].T @ (w * (2 * y[train] - 1)))
    took, hit = (s > 0).sum(), ((s > 0) & (y[test] == 1)).sum()
    return hit / took if took else 0.0, hit / y[test].sum(), 2 * hit / (took + y[test].sum()), pr_area(np.round(s, 9), y[test])


def test_equals_fold_by_fold(spark):
    y, x = rows()
    df = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(len(y))], "id int, y int, x0 double, x1 double, x2 double, x3 double, x4 double")
    odd = spark.createDataFrame([(9001, 1, None, 1.0, 1.0, 1.0, 7.0), (9002, None, 1.0, 1.0, 1.0, 1.0, 7.0)], df.schema)
    folds = {(r["id"], r["repeat"]): r["fold"] for r in evaluation.stratified_folds(df, "y", "id").collect()}
    got = {r["tier"]: r for r in evaluation.cross_validate(df.unionByName(odd), {k: v for k, v in SETS.items() if k != "flat"}).collect()}
    for name in ("a", "b", "all"):
        at, found = [int(c[1]) for c in SETS[name]], []
        for repeat in range(5):
            fold = np.array([folds[k, repeat] for k in range(len(y))])
            found += [brute(x[:, at], y, np.flatnonzero(fold != f), np.flatnonzero(fold == f)) for f in range(1, 6)]
        want = np.array(found)
        assert got[name]["folds"] == 25
        for k, c in enumerate(("precision", "recall", "f1", "pr_auc")):
            assert got[name][f"{c}_mean"] == pytest.approx(want[:, k].mean(), abs=1e-9), (name, c)
            assert got[name][f"{c}_std"] == pytest.approx(want[:, k].std(), abs=1e-9), (name, c)
    assert got["all"]["pr_auc_mean"] > got["a"]["pr_auc_mean"]


def test_odd_tables(spark):
    y, x = rows(40)
    df = spark.createDataFrame([(k, 0, *map(float, x[k])) for k in range(40)], "id int, y int, x0 double, x1 double, x2 double, x3 double, x4 double")
    one = evaluation.cross_validate(df, {"flat": ["x4"]}).first()  # one class only
    assert (one["precision_mean"], one["recall_mean"], one["pr_auc_mean"], one["folds"]) == (0.0, 0.0, 0.0, 25)
    assert evaluation.cross_validate(df.limit(0), {"flat": ["x4"]}).count() == 0


def test_places_within_groups(spark):
    """Groups that lie across ranges, null groups, and folds as ntile would give them."""
    rng = np.random.default_rng(5)
    data = [(None if g == 0 else int(g), int(v)) for g, v in zip(rng.choice([0, 1, 2, 2, 2, 3], 300), rng.permutation(300), strict=True)]
    df = spark.createDataFrame(data, "g int, v int")
    got = joins.ranked_in_groups(df, ["g"], [F.desc("v")], "k", "n", per=40).collect()
    by = {}
    for g, v in data:
        by.setdefault(g, []).append(v)
    assert sorted((r["g"] or 0, r["v"], r["k"], r["n"]) for r in got) == sorted((g or 0, v, k, len(vs)) for g, vs in by.items() for k, v in enumerate(sorted(vs, reverse=True), 1))
    few = spark.createDataFrame([(1, k) for k in range(3)] + [(0, k) for k in range(10, 23)], "y int, id int")
    sizes = {(r["y"], r["repeat"], r["fold"]): r["count"] for r in evaluation.stratified_folds(few, "y", "id", 5, 2).groupBy("y", "repeat", "fold").count().collect()}
    assert sizes == {(y, r, f): n for y, ns in ((1, (1, 1, 1)), (0, (3, 3, 3, 2, 2))) for r in (0, 1) for f, n in enumerate(ns, 1)}
