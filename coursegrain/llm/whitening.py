"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, which are kept in blocks of rows. Each step is one pass over the
blocks: a task takes its rows of the centred matrix X, forms its part of Xv and, at once, its
part of the transposed product with what it has just formed. Left vectors are as long as the
table and lie in the range of X, so they are never stored: u = Xw is known by w. With t = X'u
kept for each of them, the inner products of a new Xv with all left vectors are those of their
w with X'Xv, so that full reorthogonalisation of both sides, done twice, needs no other pass
and nothing but vectors of the dimension's length on the driver. The singular values of the
small bidiagonal matrix are the deviations, its right vectors give the components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS = 8
BLOCK = 4096
#: Partial sums that come to the driver at once; more are summed in Spark first.
MOST_PARTS = 512
#: A variance below this share of the largest is rounding.
ROUNDING = 1e-12
# How an entry becomes a whole number, as the contract gives it.
SCALE, SHIFT = 1024, 100_000


def usable(embedding: str = "embedding"):
    """Not null, not empty, no null or non-finite entry, and no entry whose whole number isn't a long."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 52))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, fits), F.lit(False))


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * float(SCALE)).astype(np.int64) + SHIFT


def _matrices(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole numbers of vectors of one length (of dim, if given), BLOCK at most at a time."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes) if dim is None else [dim]:
        at = np.flatnonzero(sizes == d)
        for lo in range(0, len(at), BLOCK):
            part = at[lo : lo + BLOCK]
            yield part, whole(values[starts[part][:, None] + np.arange(d)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, x in _matrices(b.column(0)):
            yield pa.record_batch([pa.array([x.shape[1]], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["dim", "n", "x"])


def _matrix(x: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(-1, dim)


def _sum(blocks: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], kind: type, many: bool = False) -> np.ndarray:
    """The sum of of(x) over all blocks x, in the order of the partitions; many of these are summed in Spark first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                part = of(_matrix(x, dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, kind) for b in batches for x in b.column(0).to_pylist()]
        if parts:
            yield pa.record_batch([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["s"])

    sums = blocks.select("x").mapInArrow(run, "s binary")
    if many:
        sums = sums.repartition(MOST_PARTS // 8).mapInArrow(again, "s binary")
    return np.sum([np.frombuffer(r["s"], kind) for r in sums.collect()], axis=0)


class Centre:
    """The mean of whole numbers, as the whole number next to it and an exact rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        near = [(2 * s + n) // (2 * n) for s in sums]
        self.near = np.array(near, np.int64)
        self.rest = [s - n * m for s, m in zip(sums, near)]
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S) ** 2 over each row, exact."""
        d = x - self.near
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * x.shape[1] >= 1 << 63:
            d = d.astype(object)
        y = d * self.n - np.array(self.rest, d.dtype)
        return (y * y).sum(1).tolist()


def bidiagonalise(gram: Callable[[np.ndarray], np.ndarray], dim: int, trace: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of X'X, and their unit vectors as columns; gram(v) is X'(Xv).

    Steps end with the dimension, or when the wanted triplets have converged and what is left
    of the trace is below the last of them, so that no equal value can be hidden in directions
    not seen. Where the space ends early, a step starts again from a direction not seen."""
    rng = np.random.default_rng([20240802, dim])
    right = np.zeros((0, dim))
    coefficients, images = np.zeros((0, dim)), np.zeros((0, dim))
    diagonal: list[float] = []
    above: list[float] = []
    tiny = ROUNDING * 1e-2 * max(trace, 0.0)
    residue = rng.standard_normal(dim)
    while len(right) < dim:
        for _ in range(2):
            residue = residue - right.T @ (right @ residue)
        beta = float(np.sqrt(residue @ residue))
        if beta * beta <= tiny or not len(right):
            above.append(0.0)
            fresh = rng.standard_normal(dim)
            for _ in range(3):
                fresh = fresh - right.T @ (right @ fresh)
                fresh /= np.sqrt(fresh @ fresh)
            v = fresh
        else:
            above.append(beta)
            v = residue / beta
        right = np.vstack([right, v])
        image, w = gram(v), v
        for _ in range(2):
            c = coefficients @ image
            w, image = w - coefficients.T @ c, image - images.T @ c
        alpha2 = float(w @ image)
        if alpha2 <= tiny:
            diagonal.append(0.0)
            coefficients, images = np.vstack([coefficients, np.zeros(dim)]), np.vstack([images, np.zeros(dim)])
            residue = np.zeros(dim)
        else:
            alpha = math.sqrt(alpha2)
            diagonal.append(alpha)
            coefficients, images = np.vstack([coefficients, w / alpha]), np.vstack([images, image / alpha])
            residue = image / alpha - alpha * v
        k = len(diagonal)
        if k >= wanted:
            left, s, _ = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
            # How much of the left vectors is on the last step, times the next step's size.
            open_ = residue - right.T @ (right @ residue)
            bound = float(np.sqrt(open_ @ open_)) * np.abs(left[-1, :wanted]).max()
            if bound <= 4e-16 * s[0] and trace - float(s @ s) < float(s[wanted - 1] ** 2) * (1 - 1e-6):
                break
    _, s, vt = np.linalg.svd(np.diag(diagonal) + np.diag(above[1:], 1))
    vectors = right.T @ vt[:wanted].T
    return s[:wanted] ** 2, vectors


def fit(blocks: DataFrame, dim: int, n: int, components: int = COMPONENTS, many: bool = False) -> tuple[Centre, np.ndarray, np.ndarray, float]:
    """The centre, the variances, the components as columns, and the trace of the covariance."""
    split = lambda x: np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
    high, low = _sum(blocks, dim, split, np.int64, many).reshape(2, dim).tolist()
    centre = Centre(n, [(h << 32) + lo for h, lo in zip(high, low)])
    trace = float(_sum(blocks, dim, lambda x: (centre.centred(x) ** 2).sum(0), np.float64, many).sum())

    def gram(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ v)

        return _sum(blocks, dim, part, np.float64, many)

    if not trace > 0:
        return centre, np.zeros(0), np.zeros((dim, 0)), 0.0
    values, vectors = bidiagonalise(gram, dim, trace, min(components, dim))
    some = values > ROUNDING * values[0]
    values, vectors = values[some] / n, vectors[:, some]
    largest = np.abs(vectors).argmax(0)
    return centre, values, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])]), trace / n


def identity_error(blocks: DataFrame, dim: int, centre: Centre, scaled: np.ndarray, many: bool = False) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    k = scaled.shape[1]
    mean = _sum(blocks, dim, lambda x: (centre.centred(x) @ scaled).sum(0), np.float64, many) / centre.n

    def outer(x: np.ndarray) -> np.ndarray:
        y = centre.centred(x) @ scaled - mean
        return (y.T @ y).ravel()

    return float(np.abs(_sum(blocks, dim, outer, np.float64, many).reshape(k, k) / centre.n - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Left out are vectors that are null, empty, or hold a null or non-finite entry (an entry of
    2 ** 52 or more, whose whole number isn't a long, counts as one), and vectors whose length
    isn't the one that most have (the longer one of a tie), as they have no covariance with the
    others. A component without variance has no rows, so equal vectors, or a single one, have
    none; nor has an empty table. Rows of one vec_id, and of a null one, are vectors of their
    own; repeated rows count as often as they are there. Equal variances leave a choice of
    components, which is the same for all rows. deviation is null where it needs more
    than 64 bits. Other columns are not looked at."""
    rows = vectors.select("vec_id", "embedding").filter(usable())
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    blocks = written(rows.select("embedding").mapInArrow(_blocks, "dim int, n long, x binary"), "whole-vectors")
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = most["dim"], most["n"]
    blocks = blocks.filter(F.col("dim") == dim)
    many = blocks.rdd.getNumPartitions() > MOST_PARTS
    centre, values, directions, trace = fit(blocks, dim, n, components, many)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = directions / np.sqrt(values)
    error, explained = identity_error(blocks, dim, centre, scaled, many), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _matrices(b.column(1), dim):
                deviations = [d if d < 1 << 63 else None for d in centre.deviations(x)]
                again = np.repeat(np.arange(len(at)), k)
                columns = [
                    b.column(0).take(pa.array(at[again])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(again), n, np.int64)),
                    pa.array(deviations, pa.int64()).take(pa.array(again)),
                    pa.array((centre.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(at))),
                    pa.array(np.full(len(again), error)),
                ]
                yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
