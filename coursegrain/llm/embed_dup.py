"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted by a random offset and
quantised in steps of WIDTH; HASHES of these make the bucket of one of TABLES tables. Unit
vectors of cosine 0.93 are 0.374 apart, so two of them share a bucket of one table with
probability 0.168 and miss all 72 with 1.8e-6; closer ones miss less.

Equal vectors of a label are one node with a count. A bucket's vectors are dealt into blocks
of about BLOCK, and each pair of blocks is a task's group, so that a bucket of any size is
spread over many tasks. There blocks are multiplied; a pair of cosine MIN_COSINE or more, in
double precision, counts in the first table that its two vectors share. What comes out is not
the pairs but, for each vector, how many it links with, and a spanning forest of the group's
links, so that the output grows with the vectors. The counts are exact for the pairs found."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import table, written
from .graph import components

MIN_COSINE = 0.93
TABLES = 72
HASHES = 8
WIDTH = 1.5
BLOCK = 2048
_TILE = 512


@lru_cache(maxsize=8)
def projections(dim: int, tables: int = TABLES, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Directions (dim, tables * hashes) and offsets, the same in every task."""
    r = np.random.default_rng([20240802, dim])
    return r.standard_normal((dim, tables * hashes)), r.random(tables * hashes)


def cells(unit: np.ndarray, tables: int = TABLES, upto: int | None = None) -> np.ndarray:
    """The quantised projections (vector, table, hash) of the first upto tables, or of all."""
    a, shift = projections(unit.shape[1], tables)
    n = (tables if upto is None else upto) * HASHES
    return np.floor(unit @ a[:, :n] / WIDTH + shift[:n]).astype(np.int64).reshape(len(unit), -1, HASHES)


def bucket_keys(unit: np.ndarray, label: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """A 64-bit key for each vector and table; labels (as hashes) and lengths have keys of their own."""
    own = cells(unit, tables).view(np.uint64)
    first = label.view(np.uint64)[:, None] + np.uint64(unit.shape[1])
    key = (first ^ (first >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(tables, dtype=np.uint64)
    for j in range(HASHES):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ own[:, :, j]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def usable(vectors: DataFrame, embedding: str = "embedding", label: str = "label"):
    """A vector with a label that can link: not null, no null or non-finite part, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    e = F.col(embedding)
    return F.coalesce(F.col(label).isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))


def units(rows: list[list[float]]) -> np.ndarray:
    """Rows scaled to length one, in double precision; the scaling keeps squares finite."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, list]]:
    """Places and values of vectors of one length, 256 at most at a time."""
    rows = column.to_pylist()
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        by_dim.setdefault(len(v), []).append(i)
    for at in by_dim.values():
        for lo in range(0, len(at), 256):
            yield np.array(at[lo : lo + 256]), [rows[i] for i in at[lo : lo + 256]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, ...) with v scaled to length one, as bytes; the scaling keeps squares finite."""
    for b in batches:
        for at, rows in _by_length(b.column(0)):
            x = np.array(rows, np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            rest = [b.column(i).take(pa.array(at)) for i in range(1, b.num_columns)]
            yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), *rest], names=b.schema.names)


def _spread(tables: int):
    """(v, label_key, node) to bucket, t, node: a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(1).to_numpy()
            for at, rows in _by_length(b.column(0)):
                keys = bucket_keys(np.frombuffer(b"".join(rows), np.float64).reshape(len(at), -1), labels[at], tables)
                table_no = np.tile(np.arange(tables, dtype=np.int32), len(at))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(table_no), b.column(2).take(pa.array(np.repeat(at, tables)))], names=["bucket", "t", "node"])

    return run


class _Forest:
    """Which of the places 0 to n are linked; join tells whether a link was news."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked(one: list[tuple], two: list[tuple] | None, table_no: int, tables: int, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Nodes, for each how many vectors it links with, and a forest of the links.

    one and two are two blocks (node, copies, v) of one bucket, or one and None for a block
    with itself. Only pairs that share no table before table_no are looked at."""
    both = one + (two or [])
    ids = np.array([r[0] for r in both], np.int64)
    copies = np.array([r[1] for r in both], np.int64)
    x = np.frombuffer(b"".join(r[2] for r in both), np.float64).reshape(len(both), -1)
    n_one = len(one)
    counts = np.zeros(len(both), np.int64)
    forest, links = _Forest(len(both)), []
    for i in range(0, n_one, _TILE):
        rows = range(i, min(i + _TILE, n_one))
        for j in range(n_one, len(both), _TILE) if two else range(i, n_one, _TILE):
            columns = range(j, min(j + _TILE, len(both) if two else n_one))
            near = x[rows.start : rows.stop] @ x[columns.start : columns.stop].T >= least
            if i == j:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            if not len(p):
                continue
            p, q = p + i, q + j
            if table_no:
                own = cells(x[rows.start : rows.stop], tables, table_no)
                other = cells(x[columns.start : columns.stop], tables, table_no)
                first = np.ones(len(p), bool)
                for lo in range(0, len(p), 1 << 12):
                    part = slice(lo, lo + (1 << 12))
                    first[part] = ~(own[p[part] - i] == other[q[part] - j]).all(2).any(1)
                p, q = p[first], q[first]
            counts += np.bincount(p, weights=copies[q], minlength=len(both)).astype(np.int64) + np.bincount(q, weights=copies[p], minlength=len(both)).astype(np.int64)
            links += [(int(ids[a]), int(ids[b])) for a, b in zip(p.tolist(), q.tolist()) if forest.join(a, b)]
    return ids, counts, links


def _linked_groups(tables: int, least: float):
    """(group, side, t, node, copies, v), sorted by group and side, to counts (a, n) and links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, t, sides = None, 0, ([], [])

        def close():
            if len(sides[0]) + len(sides[1]) < 2:
                return
            ids, counts, links = linked(sides[0], sides[1] or None, t, tables, least)
            some = np.flatnonzero(counts)
            if len(some):
                none = pa.nulls(len(some), pa.int64())
                yield pa.record_batch([pa.array(ids[some]), none, pa.array(counts[some])], names=["a", "b", "n"])
            if links:
                yield pa.record_batch([pa.array([a for a, _ in links]), pa.array([b for _, b in links]), pa.nulls(len(links), pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for group, side, table_no, node, copies, v in zip(*(c.to_pylist() for c in batch.columns)):
                if group != at:
                    yield from close()
                    at, t, sides = group, table_no, ([], [])
                sides[side].append((node, copies, v))
        yield from close()

    return run


def _dealt(spread: DataFrame, block: int) -> DataFrame:
    """group, side, t, node from rows bucket, t, node: pairs of blocks of each bucket of two vectors or more.

    A bucket of up to block vectors is one group. A larger one has parts, and a row is in a
    group with each part; parts come from a count by bucket, which sums before its shuffle."""
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    sizes = written(sizes.select("bucket", F.ceil(F.col("k") / F.lit(block)).cast("int").alias("parts")), "bucket-sizes")
    rows = salted_join(spread, sizes, ["bucket"], ["node"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - F.lit(1))))
    group = F.when(F.col("parts") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(group.alias("group"), (F.col("own") > F.col("other")).cast("int").alias("side"), "t", "node")


def near_vectors(vectors: DataFrame, least: float = MIN_COSINE, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors of different or null labels are never compared, nor are vectors that are null,
    empty, zero, or hold a null or a non-finite part: these are their own component. Rows of
    one vec_id are vectors of their own. A null vec_id is its component's id only if no other
    is there. Other columns are not looked at; an empty table has no rows."""
    rows = vectors.select("vec_id", "embedding", "label").withColumn("ok", usable(vectors))
    # -0.0 is 0.0; vectors of different lengths are different and never link.
    same = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    named = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64(F.col("label"), same, F.lit("vector"))))
    nodes = named.filter("ok").groupBy("node").agg(F.min(same).alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.min(F.xxhash64("label")).alias("label_key"))
    kinds = f"v binary, node long, copies long, first {dict(rows.dtypes)['vec_id']}, label_key long"
    nodes = written(nodes.select("v", "node", "copies", "first", "label_key").mapInArrow(_units, kinds), "vectors")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(nodes.select("v", "label_key", "node").mapInArrow(_spread(tables), "bucket long, t int, node long"), "vector-buckets")
    dealt = _dealt(spread, block).join(nodes.select("node", "copies", "v"), "node").select("group", "side", "t", "node", "copies", "v")
    found = dealt.repartition(4 * n, "group").sortWithinPartitions("group", "side").mapInArrow(_linked_groups(tables, least), "a long, b long, n long")
    found = written(found, "vector-links")

    others = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    names = components(found.filter("b is not null").select("a", "b"))
    placed = nodes.select("node", "copies", "first").join(names, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed.join(others.withColumnRenamed("a", "node"), "node", "left"), "vector-roots")
    heads = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = salted_join(placed, heads, ["root"], ["node"])
    known = known.select("node", "component_id", (F.col("copies") - F.lit(1) + F.coalesce("others", F.lit(0))).alias("n_links"))
    # A vector that many rows have is a node of many rows.
    joined = salted_join(named.select("vec_id", "node"), known, ["node"], ["vec_id"], "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS ok
  FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE ok),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= {MIN_COSINE}),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY 1) c USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) n USING (vec_id)
"""
