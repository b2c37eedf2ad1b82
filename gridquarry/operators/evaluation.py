"""Ranking and classification quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .joins import ranked_in_groups, running_sums


def precision_at_k(scored: DataFrame, ks: list[int], order: list[Column], label: str = "y", gate: Column | None = None) -> DataFrame:
    """k, precision and recall among the k best rows; with gate, a condition, also gated_precision and gated_recall among those
    of them that pass it, and boost, the gain in precision in points. Only max(ks) rows are ranked; the others are counted."""
    one, passed = F.col(label) == 1, F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))
    total = scored.agg(F.count(F.when(one, 1)).alias("positives"))
    best = scored.withColumn("__pass", passed).orderBy(*order).limit(max(ks)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    count = lambda test: F.count(F.when(test, 1))
    per = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("k").agg(
        count(one).alias("hits"), F.count("*").alias("n"), count(one & F.col("__pass")).alias("gated"), count(F.col("__pass")).alias("m")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    found = per.join(F.broadcast(total)).withColumns({"precision": ratio("hits", "n"), "gated_precision": ratio("gated", "m")})
    out = [F.col("k"), F.col("precision"), ratio("hits", "positives").alias("recall")]
    if gate is not None:
        out += [F.col("gated_precision"), ratio("gated", "positives").alias("gated_recall"), ((F.col("gated_precision") - F.col("precision")) * 100).alias("boost")]
    return found.select(*out)


def class_metrics(df: DataFrame, pred: str, target: str, classes: list[int]) -> DataFrame:
    """class, iou, precision, recall, f05 (weighs precision twice) from one confusion table, 1.0 where nothing could be found; and
    miou, the mean iou, the same for all classes."""
    table = df.groupBy(pred, target).count()
    pairs = table.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    p, t = F.coalesce(F.col(pred) == F.col("class"), F.lit(False)), F.coalesce(F.col(target) == F.col("class"), F.lit(False))
    n = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0))
    sums = pairs.groupBy("class").agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"))
    ratio = lambda d: F.when(d > 0, F.col("tp") / d).otherwise(1.0)
    found = sums.select("class", ratio(F.col("tp") + F.col("fp") + F.col("fn")).alias("iou"), ratio(F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp") + F.col("fn")).alias("recall"))
    q, r = F.col("precision"), F.col("recall")
    found = found.withColumn("f05", F.when(q + r > 0, 1.25 * q * r / (0.25 * q + r + 1e-8)).otherwise(0.0))
    return found.join(F.broadcast(found.agg(F.avg("iou").alias("miou"))))


def pr_curve(scored: DataFrame, score: str = "s", label: str = "y") -> DataFrame:
    """score, tp, n, precision, recall at every distinct score, best first.

    Rows are summed by score before they are put in order, and the running sums go through ranges of scores, so no task
    holds all of them."""
    return _curve(scored, score, label).select(score, "tp", "n", "precision", "recall")


def _curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    by = stage(scored.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.count("*").alias("m")), "scores")
    all_ = by.agg(F.sum("p")).first()[0]
    found = running_sums(by, [F.desc(score)], {"tp": F.col("p"), "n": F.col("m")})
    return found.withColumn("precision", F.col("tp") / F.col("n")).withColumn("recall", F.try_divide(F.col("tp"), F.lit(all_)))


def pr_auc(scored: DataFrame, score: str = "s", label: str = "y") -> DataFrame:
    """Area under the precision-recall curve by trapezoids, starting at recall 0 with precision 1."""
    # the point before this one follows from the sums without this score's rows
    tp, n, p = F.col("tp") - F.col("p"), F.col("n") - F.col("m"), F.col("p")
    gained = F.when(F.col("tp") > 0, F.col("recall") * p / F.col("tp")).otherwise(0.0)
    step = gained * (F.col("precision") + F.when(n > 0, tp / n).otherwise(1.0)) / 2
    return _curve(scored, score, label).select(step.alias("step")).agg(F.sum("step").alias("pr_auc"))


def sequential_splits(df: DataFrame, group: str, order: list[str], ratios: dict[str, float]) -> DataFrame:
    """df plus split: within each group, in order, floor(ratio * n) rows for each split; the first split gets the rest. Groups may have
    any size (see joins.ranked_in_groups)."""
    rows = ranked_in_groups(df, [group], [F.col(c).asc() for c in order], "__k", "__m")
    first, *others = ratios
    start = F.col("__m") - sum((F.floor(F.col("__m") * ratios[s]) for s in others), F.lit(0))
    split, at = F.when(F.col("__k") <= start, first), start
    for s in others:
        at = at + F.floor(F.col("__m") * ratios[s])
        split = split.when(F.col("__k") <= at, s)
    return rows.withColumn("split", split).drop("__k", "__m")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, repeats: int = 5) -> DataFrame:
    """df repeated, with repeat and fold: near-equal folds within each label, the first ones larger by one at most, in order of md5 of
    key and repeat. A label may have any number of rows (see joins.ranked_in_groups)."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.col("repeat").cast("string")))
    rows = ranked_in_groups(rows.withColumn("__o", order), [label, "repeat"], [F.col("__o").asc(), F.col(key).asc()], "__k", "__m")
    size, more, at = F.floor(F.col("__m") / folds), F.col("__m") % folds, F.col("__k") - 1
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", (fold + 1).cast("int")).drop("__o", "__k", "__m")


def _moments(folded: DataFrame, features: list[str], label: str) -> dict[tuple[int, int, int], np.ndarray]:
    """By repeat, fold and class: sums over rows of the products of (1, features) with themselves."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    out = {}
    for r in folded.groupBy("repeat", "fold", F.col(label).cast("int").alias("y")).agg(*sums).collect():  # a row for each repeat, fold and class
        m = np.zeros((len(x), len(x)))
        for i in range(len(x)):
            for j in range(i, len(x)):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["repeat"], r["fold"], r["y"]] = m
    return out


def gate_weights(one: np.ndarray, zero: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """A linear gate (intercept, weights) from the products of (1, features) of either class: least squares to +1 and -1 on
    standardised features, both classes weighing the same in all, with penalty on the weights. 0s without rows of both classes."""
    n1, n0 = one[0, 0], zero[0, 0]
    if not n1 or not n0:
        return np.zeros(len(one))
    both, n = one + zero, n1 + n0
    mean = both[0] / n
    spread = np.sqrt(np.maximum(np.diag(both) / n - mean**2, 0))
    spread[0], mean[0] = 1.0, 0.0
    spread = np.where(spread > 1e-12, spread, 1.0)
    turn = np.eye(len(one))
    turn[0, 1:] = -mean[1:]
    turn = turn / spread  # (1, x) @ turn = (1, standardised x)
    weighed = turn.T @ (one * (n / (2 * n1)) + zero * (n / (2 * n0))) @ turn
    target = turn.T @ (one[0] * (n / (2 * n1)) - zero[0] * (n / (2 * n0)))
    return turn @ np.linalg.solve(weighed + penalty * np.diag([1e-9] + [1.0] * (len(one) - 1)), target)


def cross_validate(df: DataFrame, sets: dict[str, list[str]], label: str = "y", key: str = "id", folds: int = 5, repeats: int = 5, penalty: float = 1.0) -> DataFrame:
    """Repeated stratified cross-validation of linear gates: for each named set of features, mean and deviation over all folds of
    precision, recall, f1 and pr_auc (tier, precision_mean, precision_std and so on, folds).

    All models are trained together: one pass sums products by fold, a fold's training rows are all others of its repeat, and a set
    of features takes its part of the sums (see gate_weights). A second pass scores every row with its fold's models. Rows that
    lack a feature or label are left out. key is unique. Without a positive in a fold its recall is 0; undefined ratios are 0."""
    spark, features = df.sparkSession, sorted({c for own in sets.values() for c in own})
    whole = df.select(key, F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    folded = stage(stratified_folds(whole, label, key, folds, repeats), "folded")
    moments = _moments(folded, features, label)
    empty, models = np.zeros((len(features) + 1,) * 2), []
    for k, own in enumerate(sets.values()):
        at = [0, *(1 + features.index(c) for c in own)]
        for repeat, fold in sorted({m[:2] for m in moments}):
            train = [sum((m for (r, f, c), m in moments.items() if (r, c) == (repeat, y) and f != fold), empty)[np.ix_(at, at)] for y in (1, 0)]
            weights = np.zeros(len(features) + 1)
            weights[at] = gate_weights(*train, penalty)
            models.append((k, repeat, fold, weights.tolist()))
    table = spark.createDataFrame(models, "tier int, repeat int, fold int, w array<double>")  # sets times folds rows
    scored = folded.join(F.broadcast(table), ["repeat", "fold"])
    s = sum((F.col("w")[k + 1] * F.col(c) for k, c in enumerate(features)), F.col("w")[0])
    by = scored.select("tier", "repeat", "fold", s.alias("s"), F.col(label).alias("y")).groupBy("tier", "repeat", "fold", "s")
    by = by.agg(F.sum("y").alias("p"), F.count("*").alias("m"))
    group = ["tier", "repeat", "fold"]
    upto = running_sums(by, [*(F.col(c).asc() for c in group), F.desc("s")], {"tp": F.col("p"), "n": F.col("m")})
    ends = upto.groupBy(*group).agg(F.min(F.col("tp") - F.col("p")).alias("tp0"), F.min(F.col("n") - F.col("m")).alias("n0"), F.sum("p").alias("all"))
    curve = upto.join(F.broadcast(ends), group).withColumns({"tp": F.col("tp") - F.col("tp0"), "n": F.col("n") - F.col("n0")})
    before, gained = (F.col("tp") - F.col("p"), F.col("n") - F.col("m")), F.try_divide(F.col("p"), F.col("all"))
    step = gained * (F.col("tp") / F.col("n") + F.when(before[1] > 0, before[0] / before[1]).otherwise(1.0)) / 2
    chosen = F.col("s") > 0
    sums = curve.groupBy(*group).agg(F.sum(step).alias("pr_auc"), F.sum(F.when(chosen, F.col("p")).otherwise(0)).alias("hit"), F.sum(F.when(chosen, F.col("m")).otherwise(0)).alias("taken"), F.max("all").alias("all"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = sums.withColumns({"precision": ratio(F.col("hit"), F.col("taken")), "recall": ratio(F.col("hit"), F.col("all")), "f1": ratio(2 * F.col("hit"), F.col("taken") + F.col("all")), "pr_auc": F.coalesce("pr_auc", F.lit(0.0))})
    names = ("precision", "recall", "f1", "pr_auc")
    found = sums.groupBy("tier").agg(*[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))], F.count("*").alias("folds"))
    tier = F.element_at(F.array(*map(F.lit, sets)), F.col("tier") + 1)
    return found.withColumn("tier", tier)
