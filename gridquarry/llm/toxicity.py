"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model over their votes, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import held_out, stage

#: Bound of what is learned: labelled texts, by hash of the id.
SAMPLE_TEXTS = 20_000
#: Lengths in bytes of word beginnings that may enter the lexicons beside whole words, so that unseen endings are met.
STEMS = (4, 5, 6)
# Insults for voters that need no labels.
INSULTS = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
#: Log-likelihood ratios from which a word counts as tied to the label (chance reaches the first for about one word in 40,000):
#: words from each on make a lexicon of their own.
TIED = (18.0, 40.0, 120.0)
KINDS = ("words", *(f"beginnings of {n}" for n in STEMS))
PARTS = len(KINDS) * len(TIED)
VOTERS = [*(f"{kind}, tied by {t:.0f}" for kind in KINDS for t in TIED), "any tied word", "several tied words", "dense tied words", "insults", "several insults", "shouting", "exclamations"]


@dataclass
class Toxicity:
    """The learned words and word beginnings (hashes in order, with their lexicons) and the weights of the classifier."""

    lexicon: np.ndarray
    part: np.ndarray
    weights: np.ndarray | None = None

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(votes, counts) of each text: 0/1 by voter; logs of lexicon hits, of their density, of words."""
        data, offsets = arrays.utf8(texts)
        n = len(offsets) - 1
        start, end, words = arrays.words(data, offsets, arrays.PUNCTUATION)
        of = np.repeat(np.arange(n), words)
        votes = np.zeros((n, len(VOTERS)))
        toxic, insult = np.zeros(len(of), bool), np.zeros(len(of), bool)
        for k, (hashes, word) in enumerate(_stems(data, start, end)):
            hit, at = _find(self.lexicon, hashes)
            votes[of[word[hit]], self.part[at]] = 1
            toxic[word[hit]] = True
            if not k:
                insult[_find(_insults(), hashes)[0]] = True
        hits = np.bincount(of[toxic], minlength=n).astype(float)
        insults = np.bincount(of[insult], minlength=n)
        totals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))]), np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))]), np.concatenate([[0], np.cumsum(data == 33)])
        upper, lower, marks = (t[offsets[1:]] - t[offsets[:-1]] for t in totals)
        votes[:, PARTS:] = np.stack([hits >= 1, hits >= 2, (hits > 0) & (hits >= 0.01 * words), insults >= 1, insults >= 2, upper > lower, marks > 0.05 * np.maximum(words, 1)], 1)
        return votes, np.stack([np.log1p(hits), np.log1p(100 * hits / np.maximum(words, 1)), np.log1p(words) / 10], 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return _sigmoid(_design(*self.features(texts)) @ self.weights)


@cache
def _insults() -> np.ndarray:
    return np.sort(np.array([arrays.hash_word(w) for w in INSULTS], np.uint64))


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, word of each): all words whole, then the beginnings of longer words."""
    yield arrays.word_hashes(data, start, end), np.arange(len(start))
    for length in STEMS:
        word = np.flatnonzero(end - start > length)
        yield arrays.mix(arrays.word_hashes(data, start[word], start[word] + length) + np.uint64(length)), word


def _find(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are in the ordered table, their places there)."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.zeros(1 << 16, bool)
    low[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    may = np.flatnonzero(low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, hashes[may]), len(table) - 1)
    same = table[at] == hashes[may]
    return may[same], at[same]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _design(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(votes), 1)), votes, counts], 1)


def label_model(votes: np.ndarray, rounds: int = 50, shrink: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, accuracies, correlations) of 0/1 votes for a hidden class: a generative model fitted by EM.

    Each voter has a rate of votes in either class, and within the classes votes have one covariance: the log odds of a row
    are those of two such clouds of votes, so voters that say the same share one weight, and ones that never vote have none.
    The start is a vote of its own: class 1 where a third of the voters vote. shrink times the mean variance on the diagonal
    keeps copies of a voter apart."""
    n, m = votes.shape
    posterior = np.where(votes.mean(1) >= 1 / 3, 0.95, 0.05)
    covariance = np.eye(m)
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        rate = [(w @ votes + 0.05) / (w.sum() + 0.1) for w in (1 - posterior, posterior)]
        residual = votes - np.outer(1 - posterior, rate[0]) - np.outer(posterior, rate[1])
        covariance = residual.T @ residual / n
        weight = np.linalg.solve(covariance + (shrink * np.trace(covariance) / m + 1e-9) * np.eye(m), rate[1] - rate[0])
        new = _sigmoid((votes - (rate[0] + rate[1]) / 2) @ weight + np.log(prior / (1 - prior)))
        done = np.abs(new - posterior).max() < 1e-4
        posterior = new
        if done:
            break
    spread = np.sqrt(np.diag(covariance)) + 1e-9
    accuracy = (posterior[:, None] * votes + (1 - posterior)[:, None] * (1 - votes)).mean(0)
    return posterior, accuracy, covariance / np.outer(spread, spread)


def fit_linear(design: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method."""
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = _sigmoid(design @ w)
        gradient = design.T @ (p - target) + penalty * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> Toxicity:
    """Learn from labelled texts: a bounded sample (about sample_texts, by hash of the id), with its words counted in Spark.

    Labels make the lexicons: words and word beginnings tied to label 1 by log-likelihood ratio, in as many lexicons as there
    are kinds and strengths. These and patterns vote, and so does the label, whose accuracy is estimated like any other's; the
    label model turns votes into posteriors, and the classifier learns these from the text's own votes. Ids with several labels count as 1 if any is, ids with several texts by the smallest;
    null labels teach nothing. Without labels of both kinds, every score is 0."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n = known.count()
    if not n:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    span = 1 << 30
    sample = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(span)) < min(span, span * sample_texts // n))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    texts = stage(texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y")), "labelled")  # about sample_texts rows

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                data, offsets = arrays.utf8(block.column("text"))
                start, end, n_words = arrays.words(data, offsets, arrays.PUNCTUATION)
                of = np.repeat(np.arange(block.num_rows), n_words)
                for kind, (hashes, word) in enumerate(_stems(data, start, end)):
                    once = arrays.distinct_pairs(of[word], hashes)
                    y = block.column("y").take(pa.array(of[word][once]))
                    yield pa.RecordBatch.from_arrays([y, pa.array(np.full(len(y), kind, np.int32)), pa.array(hashes[once].view(np.int64))], ["y", "kind", "word"])

    words = texts.select("y", "text").mapInArrow(stems, "y int, kind int, word long")
    n1, n0 = texts.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    a, b, rate = F.col("a"), F.col("b"), n1 / (n0 + n1)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    both = part(a, (a + b) * rate) + part(b, (a + b) * (1 - rate)) + part(n1 - a, (n1 + n0 - a - b) * rate) + part(n0 - b, (n1 + n0 - a - b) * (1 - rate))
    tied = words.groupBy("kind", "word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).withColumn("g", 2 * both)
    tied = tied.where((F.col("g") >= TIED[0]) & (a > 3 * rate * (a + b))).orderBy("word", "kind").collect()  # words of several sampled texts each
    part = [len(TIED) * r["kind"] + sum(r["g"] >= t for t in TIED) - 1 for r in tied]
    hashes = np.array([r["word"] for r in tied], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Toxicity(hashes[order], np.array(part, np.int64)[order])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                votes, counts = model.features(block.column("text"))
                yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(np.concatenate([votes, counts], 1).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    rows = texts.select("y", "text").mapInArrow(featurise, "y int, x array<double>").toPandas()  # about sample_texts rows
    x = np.concatenate([np.array(rows["x"].tolist()), rows["y"].to_numpy(float)[:, None]], 1)
    x = x[np.lexsort(x.T)]
    votes, counts, label = np.split(x, [len(VOTERS), x.shape[1] - 1], axis=1)
    model.weights = fit_linear(_design(votes, counts), label_model(np.concatenate([votes, label], 1))[0])
    return model


def score_toxicity(df: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row of df, from its whole text alone; null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in arrays.blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(shared.value.score(block.column("text")))], ["id", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels of those that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn_toxicity(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
