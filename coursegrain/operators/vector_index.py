"""An inverted-file index of unit vectors: coarse cells, posting lists by course and cell, residual codes.

Cells are means trained on a bounded sample; every vector is indexed under the cell nearest to
it. A posting holds ids and one signed byte for each dimension of what the cell's mean leaves,
with a scale for each vector, in lists of bounded length. A query looks into the lists of its
course in the order of the cells' nearness, ranks by the codes, and only the few best of all its
lists are scored by the vectors themselves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..sources.tables import written
from .joins import salted_join

#: The sample that cells are trained on has so many bytes at most, whatever the table's size.
FIT_BYTES = 16 << 20
MOST_CELLS = 4096
ROUNDS = 8
#: Vectors of a posting list, and queries that meet one at a time.
POSTINGS = 4096
QUERIES = 256
#: Vectors scored exactly for each hit that is asked for.
SHORTLIST = 3
#: Recall over the sample's own neighbours that the number of probed cells is chosen for.
TARGET = 0.97
_TRIALS = 512


@dataclass(frozen=True)
class Cells:
    """Unit means of the cells, and how many of them a query looks into."""

    means: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each row of x, nearest first."""
        near = x @ self.means.T
        return near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


def unit_rows(vectors, dim: int) -> np.ndarray:
    """Rows of length one; null, zero and non-finite ones, and those of another length, are zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    out[~np.isfinite(out).all(1)] = 0
    most = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(most > 0, most, 1)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def train(sample: np.ndarray, cells: int, k: int, target: float = TARGET) -> Cells:
    """Cells by rounds of spherical means, and the least number of probes that finds target of the sample's k nearest neighbours."""
    rng = np.random.default_rng([31, *sample.shape])
    cells = min(cells, len(sample))
    means = sample[np.sort(rng.choice(len(sample), cells, replace=False))]
    for _ in range(ROUNDS):
        own = (sample @ means.T).argmax(1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        means = np.where(size > 0, sums / np.where(size > 0, size, 1), means)
    own = (sample @ means.T).argmax(1)
    trial = rng.choice(len(sample), min(_TRIALS, len(sample)), replace=False)
    near = sample[trial] @ sample.T
    near[np.arange(len(trial)), trial] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    # In which probe each neighbour's cell comes up.
    turn = np.empty((len(trial), cells), np.int64)
    order = np.argsort(-(sample[trial] @ means.T), axis=1, kind="stable")
    np.put_along_axis(turn, order, np.arange(cells)[None, :].repeat(len(trial), 0), 1)
    turns = np.sort(np.take_along_axis(turn, own[best], 1).ravel()) if best.size else np.zeros(1, np.int64)
    return Cells(means, int(turns[min(len(turns) - 1, int(np.ceil(target * len(turns))) - 1)]) + 1)


def fit_cells(vectors: DataFrame, column: str = "embedding", k: int = DEFAULTS.top_k, cells: int | None = None, fit_bytes: int = FIT_BYTES, target: float = TARGET) -> Cells | None:
    """Cells for vectors, from a sample of fit_bytes at most drawn by a hash; None without any vector.

    There are 2 sqrt(n) cells unless a number is given, and MOST_CELLS at most."""
    size = vectors.filter(F.size(column) > 0).agg(F.count(F.lit(1)).alias("n"), F.mode(F.size(column)).alias("dim")).first()
    if not size["n"]:
        return None
    n, dim = size["n"], size["dim"]
    most = max(1, fit_bytes // (8 * dim))
    share = min(1.0, most / n)
    drawn = vectors.filter(F.size(column) == dim).filter(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(column).limit(2 * most).collect()
    sample = unit_rows([r[0] for r in drawn], dim)
    sample = sample[(sample != 0).any(1)]
    if not len(sample):
        return None
    return train(sample, cells or max(1, min(MOST_CELLS, len(sample), round(2 * n**0.5))), k, target)


def build_index(vectors: DataFrame, cells: Cells, postings: int = POSTINGS) -> DataFrame:
    """course_id, cell, part, entries (chunk_id, scale, code): lists of about postings vectors.

    All rows of vectors (chunk_id, course_id, embedding) are in it but those of a null course;
    a vector that can't be scaled to length one has a code of zeros."""
    dim, kinds = cells.means.shape[1], dict(vectors.dtypes)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit_rows(b.column(2).to_pylist(), dim)
            cell = cells.nearest(x)[:, 0]
            rest = np.where((x != 0).any(1, keepdims=True), x - cells.means[cell], -cells.means[cell])
            scale = np.abs(rest).max(1, initial=0) / 127
            bytes_ = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(scale.astype(np.float32)), pa.array([r.tobytes() for r in bytes_], pa.binary())], names=["chunk_id", "course_id", "cell", "scale", "code"])

    rows = vectors.filter("course_id is not null").select("chunk_id", "course_id", "embedding")
    coded = written(rows.mapInArrow(code, f"chunk_id {kinds['chunk_id']}, course_id {kinds['course_id']}, cell int, scale float, code binary"), "vector-codes")
    sizes = written(coded.groupBy("course_id", "cell").agg(F.count(F.lit(1)).alias("k")), "list-sizes")
    parts = sizes.select("course_id", "cell", F.ceil(F.col("k") / F.lit(postings)).cast("int").alias("parts"))
    lists = salted_join(coded, parts, ["course_id", "cell"], ["chunk_id"], counts=sizes).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    return written(lists.groupBy("course_id", "cell", "part").agg(F.collect_list(F.struct("chunk_id", "scale", "code")).alias("entries")), "postings")


def _probed(queries: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """query_id, course_id, query (unit), cell for the cells that a query looks into."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def order(q: pd.Series) -> pd.Series:
        return pd.Series(list(cells.nearest(unit_rows(list(q), cells.means.shape[1]), max(2, probes))[:, :probes].astype(np.int32)))

    return queries.select("query_id", "course_id", "query", F.explode(order("query")).alias("cell"))


def candidates(queries: DataFrame, index: DataFrame, cells: Cells, shortlist: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id of the shortlist vectors that the codes rank best for each query."""
    dim = cells.means.shape[1]
    asked = _probed(queries, cells, probes or cells.probes).withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // QUERIES)))))
    batches = asked.groupBy("course_id", "cell", "batch").agg(F.collect_list(F.struct("query_id", "query")).alias("queries"))
    kinds = dict(index.select(F.col("entries")[0]["chunk_id"].alias("c")).dtypes)["c"], dict(queries.dtypes)["query_id"]

    def rank(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                entries, asking = b.column(1)[i].values, b.column(2)[i].as_py()
                ids, scale, code = entries.flatten()
                x = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, dim) * scale.to_numpy()[:, None].astype(np.float64)
                x += cells.means[b.column(0)[i].as_py()]
                size = np.sqrt((x * x).sum(1))
                near = unit_rows([a["query"] for a in asking], dim) @ x.T / np.where(size > 0, size, 1)
                few = min(shortlist, near.shape[1])
                best = np.argpartition(-near, few - 1, axis=1)[:, :few]
                yield pa.record_batch([pa.array(np.repeat([a["query_id"] for a in asking], few)), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(near, best, 1).ravel())], names=["query_id", "chunk_id", "near"])

    met = index.join(batches, ["course_id", "cell"]).select("cell", "entries", "queries")
    found = met.mapInArrow(rank, f"query_id {kinds[1]}, chunk_id {kinds[0]}, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= shortlist).select("query_id", "chunk_id")
