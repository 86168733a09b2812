"""Whitening of embeddings with exact covariances, by products of digit slices.

Vectors become integers.  Their sums are exact; centred by the whole part of the mean, each is
split into limbs of 20 bits, and blocks of 4096 vectors multiply limb by limb in float64: every
product sum stays below 2**53, so BLAS is exact.  Limb products become big integers with their
shifts, tasks' matrices are merged in a tree, and the rest of the mean is taken out exactly, so the
covariance is the rational one rounded once.  Eigenvectors are then found in one small matrix
on the driver (dimension squared, whatever the number of vectors).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

LIMB_BITS = 20
BLOCK = 4096
_MOST = float(2**61)  # entries beyond are taken as this


def _lattice(embeddings: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id, x (array of long) of the rows with a usable vector."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & ~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(_MOST)), F.lit(-_MOST))) + shift).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _merged(vectors: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """What ``partial`` makes of each task's batches, merged in a tree; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(b for b in batches if b.num_rows)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    both = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return vectors.mapInArrow(run, "made binary").rdd.map(lambda r: pickle.loads(r.made)).treeAggregate(None, both, both)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as big integers."""
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    return low.astype(object) + high.astype(object) * (1 << 32)


def limbs_of(x: np.ndarray) -> list[np.ndarray]:
    """float64 digit slices of integers; the last one carries the sign."""
    out = []
    while True:
        if not len(x) or (-(1 << LIMB_BITS) < int(x.min()) and int(x.max()) < 1 << LIMB_BITS):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x'x as big integers, from products of digit slices of blocks of rows."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        limbs = limbs_of(x[at : at + BLOCK])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB_BITS * (i + j))
                out += product if i == j else product + product.T
    return out


def covariance(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, whole means m (int64), sums of x - m (big integers), covariance (float64, each entry rounded once)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Any:
        n, s = 0, np.zeros(dims, object)
        for batch in batches:
            n, s = n + batch.num_rows, s + exact_sums(_matrix(batch, dims))
        return (n, s) if n else None

    n, s = _merged(vectors, sums, lambda a, b: (a[0] + b[0], a[1] + b[1])) or (0, np.zeros(dims, object))
    if not n:
        return 0, np.zeros(dims, np.int64), s, np.zeros((dims, dims))
    means = np.array([(2 * int(v) + n) // (2 * n) for v in s], np.int64)
    rest = np.array([int(v) - n * int(m) for v, m in zip(s, means, strict=True)], object)

    def products(batches: Iterator[pa.RecordBatch]) -> Any:
        made = None
        for batch in batches:
            g = exact_gram(_matrix(batch, dims) - means)
            made = g if made is None else made + g
        return made

    gram = _merged(vectors, products, lambda a, b: a + b)
    exact = n * gram - np.outer(rest, rest)
    return n, means, rest, np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64).reshape(dims, dims)


def eigenpairs(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns); the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    top = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, int)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - rest)**2, exact; None beyond a long.  ``x`` is centred by the whole means."""
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(r)) for r in rest) if x.size else 0
    if bound * bound * max(1, x.shape[1]) < 2**63:
        d = x * n - rest.astype(np.int64)
        return [int(v) for v in (d * d).sum(axis=1)]
    d = x.astype(object) * n - rest
    return [v if v < 2**63 else None for v in map(int, (d * d).sum(axis=1))]


def whiten(embeddings: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries go.  Vectors must have one
    length: that of most usable rows, of equally many the longest; rows of another go too (and so
    does every row if that is 0).  The fit list is each distinct vector once.  A component
    without variance (below 1e-12 of the first) has a null ``whitened`` and is left out of
    identity_error, which is 0 if none has any; ``explained`` is then 0.  A deviation beyond a
    long is null; entries beyond 2**61 count as that.  Rows that repeat a vec_id are rows of
    their own, a null vec_id is kept.  Empty tables are fine; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = _lattice(embeddings, scale, shift)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length.d if length else 0
    kind = embeddings.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dims)
    fit = materialise(rows.select("x").distinct())
    n, means, rest, cov = covariance(fit, dims)
    values, vectors = eigenpairs(cov, components)
    trace = float(np.trace(cov))
    usable = values > 1e-12 * max(float(values[0]), 0.0) if len(values) else values > 0
    remainder = np.array([int(r) / n for r in rest])
    axes = vectors / np.sqrt(np.where(usable, values, 1.0))
    project = lambda x: (x.astype(np.float64) - remainder) @ axes

    def moments(batches: Iterator[pa.RecordBatch]) -> Any:
        made = None
        for batch in batches:
            w = project(_matrix(batch, dims) - means)
            mean = w.mean(axis=0)
            own = (len(w), mean, (w - mean).T @ (w - mean))
            made = own if made is None else _both(made, own)
        return made

    count, _, spread = _merged(fit, moments, _both)
    error = np.abs(spread / count - np.eye(len(values)))[np.ix_(usable, usable)]
    identity_error = float(error.max()) if error.size else 0.0
    explained = values / trace if trace > 0 else np.zeros(len(values))
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, dims) - means
            each = np.repeat(np.arange(len(x)), k)
            made = pa.array(project(x).reshape(-1), mask=np.tile(~usable, len(x)))
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                pa.array(deviations(x, n, rest), pa.int64()).take(pa.array(each)), made, pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def _both(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two parts together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)
