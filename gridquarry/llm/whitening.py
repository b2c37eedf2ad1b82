"""Embedding whitening: polarisation covariance, from exact squares of centred values of every dimension and pair sum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Integers a unit of a vector's entries is cut into.
STEPS = 256
#: Vectors that a task handles at once.
_ROWS = 4096
#: Squares are added up in two parts of this many bits, so that no 64-bit sum overflows.
_LOW = 24
#: Bound of centred values, and of their sums by pairs.
_MOST = 1 << 49
_COUNTS, _SQUARES = "dim int, i int, s long, n long", "dim int, i int, j int, s decimal(38,0)"


@dataclass
class Whitening:
    """n vectors of one length in the fit list, the sum of each dimension, and the first components (columns) with their eigenvalues;
    explained is each one's share of all variance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the vectors less the sums: whole numbers. Beyond their bound, an OverflowError."""
        if len(x) and (self.n * float(np.abs(x).max()) + float(np.abs(self.sums).max()) >= _MOST / 2):
            raise OverflowError(f"vectors of entries up to {np.abs(x).max()} in a list of {self.n} are beyond exact sums")
        return self.n * x - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Scores on the components, of variance 1; NaN on components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (centred / self.n) @ self.vectors / np.sqrt(self.values), np.nan)


def whole_vectors(df: DataFrame, vector_col: str, steps: int = STEPS) -> DataFrame:
    """df plus x: floor(steps * entry) of each entry as double; null for vectors that are null or hold a null, NaN or infinity."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.withColumn("x", F.when(fine, F.transform(v, lambda c: F.floor(c * steps))))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal length, _ROWS at most, with their vectors as a matrix."""
    import pyarrow.compute

    for whole in batches:
        lengths = pyarrow.compute.list_value_length(whole.column("x"))
        for length in lengths.unique():
            same = whole.filter(pyarrow.compute.equal(lengths, length))
            for at in range(0, same.num_rows, _ROWS):
                batch = same.slice(at, _ROWS)
                yield batch, batch.column("x").flatten().to_numpy().reshape(batch.num_rows, length.as_py())


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By length: vectors of the fit list, and the sum of each dimension. A row per dimension reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches):
            d = x.shape[1]
            if d and float(np.abs(x).max()) * len(x) >= 2.0**62:
                raise OverflowError("entries are beyond exact sums")
            columns = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), x.sum(0), np.full(d, len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "i", "s", "n"])

    found: dict[int, dict] = {}
    for r in fit.mapInArrow(add, _COUNTS).groupBy("dim", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        found.setdefault(r["dim"], {})[r["i"]] = r["n"], r["s"]
    return {d: (own[0][0], np.array([own[i][1] for i in range(d)], np.int64)) for d, own in found.items()}


def square_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of squares of whole numbers by column, as Python integers; |y| below 2^49, rows up to _ROWS."""
    high, low = y >> _LOW, y & ((1 << _LOW) - 1)
    parts = [np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << (2 * _LOW)) + (parts[1] << (_LOW + 1)) + parts[2]


def _pair_squares(fit: DataFrame, counts: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By length: a matrix of exact sums of squares, of every centred dimension (on the diagonal) and of the sum of every two.

    A task adds up its own rows and sends a row per pair; as many reach the driver, whatever the number of vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for _, x in _blocks(batches):
            d = x.shape[1]
            if not d:
                continue
            n, sums = counts[d]
            y = Whitening(n, sums, *[np.zeros(0)] * 3).centred(x)
            total = totals.setdefault(d, np.zeros((d, d), object))
            for i in range(d):
                total[i, i:] += np.concatenate([square_sums(y[:, i : i + 1]), square_sums(y[:, i : i + 1] + y[:, i + 1 :])])
        for d, total in totals.items():
            i, j = np.triu_indices(d)
            values = pa.array([Decimal(v) for v in total[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values], ["dim", "i", "j", "s"])

    out: dict[int, np.ndarray] = {d: np.zeros((d, d), object) for d in counts}
    for r in fit.mapInArrow(add, _SQUARES).groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["dim"]][r["i"], r["j"]] = int(r["s"])
    return out


def polarised(squares: np.ndarray) -> np.ndarray:
    """Exact sums of products from sums of squares: x y = ((x + y)^2 - x^2 - y^2) / 2, twice over so that they stay whole."""
    d = len(squares)
    own = np.array([squares[i, i] for i in range(d)], object)
    out = np.zeros((d, d), object)
    for i in range(d):
        out[i, i] = 2 * own[i]
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = squares[i, j] - own[i] - own[j]
    return out


def _components(n: int, sums: np.ndarray, squares: np.ndarray, k: int) -> Whitening:
    """Unit eigenvectors of the covariance by falling eigenvalue, the largest entry of each positive."""
    double, scale = polarised(squares), 2 * n**3  # centred values hold a factor n each, and the mean one more
    covariance = np.array([[float(Fraction(int(v), scale)) for v in row] for row in double]).reshape(len(sums), len(sums))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    trace = float(Fraction(sum(int(double[i, i]) for i in range(len(sums))), scale))
    none = 1e-12 * trace  # what eigh leaves of no variance
    values = np.where(values > none, values, 0.0)[:k]
    return Whitening(n, sums, vectors[:, :k], values, values / trace if trace else values)


def fit_whitening(fit: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """The first components of fit's vectors (x: array<long>, each a row of its own), by their length.

    The sums of every dimension come first. A second pass squares, exactly, what is centred by them: each dimension, and each
    sum of two; half the difference of such a sum's variance and those of its two dimensions is their covariance. Vectors of
    other lengths are lists of their own; empty ones have no component."""
    counts = {d: c for d, c in _sums(fit).items() if d}
    squares = _pair_squares(fit, counts)
    return {d: _components(n, sums, squares[d], components) for d, (n, sums) in counts.items()}


def identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest entry, in absolute value, of the whitened fit list's covariance minus the identity, over components
    with variance. Two passes: means, then products of what is centred by them."""

    def moments(centre: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in _blocks(batches):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                w = model.whitened(model.centred(x))[:, model.values > 0]
                d, k = x.shape[1], w.shape[1]
                if centre:
                    w = w - centre[d]
                found = w.T @ w if centre else w.sum(0)[None, :]
                i, j = np.indices(found.shape, np.int32)
                columns = [np.full(i.size, d, np.int32), i.ravel(), j.ravel(), found.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "i", "j", "s"])

        out = {d: np.zeros(((m.values > 0).sum() if centre else 1, (m.values > 0).sum())) for d, m in models.items()}
        for r in fit.mapInArrow(add, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():
            out[r["dim"]][r["i"], r["j"]] = r["s"] / models[r["dim"]].n
        return out

    means = {d: m[0] for d, m in moments({}).items()}
    return {d: float(np.abs(m - np.eye(len(m))).max(initial=0.0)) for d, m in moments(means).items()} if means else {}


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = STEPS) -> DataFrame:
    """Every row of df with a proper vector, whitened: id_col, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, floor(steps * entry). The fit list holds each distinct vector once; n counts it. deviation is
    the row's squared distance from the mean, times n squared, exact; whitened its score on a component, of variance 1 over the
    fit list; explained the component's share of all variance; identity_error how far the whitened list's covariance is
    from the identity. Components are unit eigenvectors of the exact covariance by falling eigenvalue, as many as there are
    dimensions if these are fewer.

    Vectors that are null or hold a null, NaN or infinity are left out. Vectors of each length are a list of their own; empty
    vectors have no component, so no row. Repeated rows and ids stay. On components without variance (one vector, or equal
    ones) whitened is null, and explained 0. Entries so large that n times them pass 2^48 raise an error. Other columns are
    left out; an empty table gives no rows."""
    rows = whole_vectors(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", steps).where("x IS NOT NULL").select("id", "x")
    fit = stage(rows.select("x").distinct(), "fit")
    models = fit_whitening(fit, components)
    errors = identity_errors(fit, models)
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            model = models.get(x.shape[1])
            if model is None:
                continue
            y, k = model.centred(x), len(model.values)
            if (y.astype(float) ** 2).sum(1).max() >= 2.0**63:
                raise OverflowError("the squared distance of a vector does not fit 64 bits")
            w = model.whitened(y).ravel()
            at = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)),
                pa.array((y * y).sum(1)[at]), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(at), errors[x.shape[1]])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    found = rows.mapInArrow(score, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return found.withColumnRenamed("id", id_col)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on the first four components of their distinct vectors."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
