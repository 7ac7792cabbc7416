"""Greedy acceptance of vectors in order, without a table of near pairs.

Vectors meet where they share a bucket of random projections. A bucket is cut into blocks, and
a pair of blocks is a task's group, in which matrix products tell, for each vector not yet
decided, the earliest vector before it that is near and not rejected. That is one row for each
vector and group, summed to one for each vector, however many pairs are near. If there is none
the vector is accepted; if the earliest is an accepted one the vector is rejected, and that one
is what it matches; else it waits for the next round. Rejected vectors take no further part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions.text import cosine
from ..sources.tables import written
from .joins import salted_join

#: Tables of buckets, projections of a bucket, their width, and vectors of a block.
TABLES = 48
HASHES = 6
WIDTH = 1.5
BLOCK = 1024


def bucket_keys(tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        """Quantised Gaussian projections of normalised vectors, hashes of them to a key."""
        out = []
        for v in vectors:
            x = np.zeros(0) if v is None else np.asarray(v, np.float64)
            size = np.sqrt((x * x).sum())
            if not np.isfinite(size) or size == 0:
                out.append([])
                continue
            r = np.random.default_rng([11, len(x)])
            a, shift = r.standard_normal((len(x), tables * hashes)), r.random(tables * hashes)
            cells = np.floor(x / size @ a / width + shift).astype(np.int64).reshape(tables, hashes)
            key = np.arange(tables, dtype=np.int64)
            for j in range(hashes):
                key = key * np.int64(6364136223846793005) + cells[:, j] * np.int64(1442695040888963407)
                key ^= key >> np.int64(29)
            out.append(key.tolist())
        return pd.Series(out)

    return keys


def dealt_groups(rows: DataFrame, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """group, side, v: pairs of blocks of each bucket of two vectors or more, of rows (v, course_id, embedding).

    A bucket of any size is spread: its vectors are cut into blocks, and one is in a group with
    each block. Sides part the two blocks; a block with itself has side 0 only."""
    spread = written(rows.select("v", "course_id", F.explode(bucket_keys(tables)("embedding")).alias("bucket")), "stem-spread")
    on = ["course_id", "bucket"]
    sizes = written(spread.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "stem-buckets")
    parts = sizes.select(*on, F.ceil(F.col("k") / F.lit(block)).cast("int").alias("parts"))
    d = salted_join(spread, parts, on, ["v"], counts=sizes)
    d = d.withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - F.lit(1))))
    group = F.xxhash64("course_id", "bucket", F.least("own", "other"), F.greatest("own", "other"))
    return written(d.select(group.alias("group"), (F.col("own") > F.col("other")).cast("int").alias("side"), "v"), "stem-groups")


def _earliest(least: float):
    """(group, side, v, nth, accepted, unit), sorted by group, to (v, nth, accepted) of each undecided v's earliest near one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close():
            side, v, nth, accepted = (np.array(c) for c in list(zip(*held))[:4])
            open_ = np.flatnonzero(~accepted)
            if len(held) < 2 or not len(open_):
                return
            x = np.array([u for *_, u in held])
            both = side.any()
            best = np.full(len(held), -1)
            order = np.argsort(nth, kind="stable")
            for lo in range(0, len(open_), 256):
                some = open_[lo : lo + 256]
                near = x[some] @ x[order].T >= least
                near &= nth[order][None, :] < nth[some][:, None]
                if both:
                    near &= side[order][None, :] != side[some][:, None]
                hit = near.any(1)
                best[some[hit]] = order[near[hit].argmax(1)]
            found = np.flatnonzero(best >= 0)
            if len(found):
                yield pa.record_batch([pa.array(v[found]), pa.array(nth[best[found]]), pa.array(accepted[best[found]])], names=["v", "nth", "accepted"])

        for b in batches:
            for group, side, v, nth, accepted, unit in zip(*(c.to_pylist() for c in b.columns)):
                if group != at:
                    if held:
                        yield from close()
                    at, held = group, []
                held.append((side, v, nth, accepted, unit))
        if held:
            yield from close()

    return run


def _unit(c: str):
    x = F.transform(c, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: v / norm)


def accept_in_order(stems: DataFrame, least: float, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """v, accepted, match: each of stems (v, nth, course_id, embedding) in the order of nth.

    v and nth are unique; match is the nth of the earliest accepted vector near a rejected one."""
    groups = dealt_groups(stems, block, tables)
    units = written(stems.select("v", "nth", _unit("embedding").alias("unit")), "stem-units")
    state = written(units.select("v", "nth", F.lit(False).alias("accepted")), "stem-state")
    done = None
    n = int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # Groups in which nothing is open take no part.
        live = groups.join(state, "v")
        if done is not None:
            live = live.join(live.filter("not accepted").select("group").distinct(), "group", "left_semi")
        met = live.join(units.select("v", "unit"), "v").select("group", "side", "v", "nth", "accepted", "unit")
        found = met.repartition(4 * n, "group").sortWithinPartitions("group").mapInArrow(_earliest(least), "v long, nth long, accepted boolean")
        first = found.groupBy("v").agg(F.min(F.struct("nth", "accepted")).alias("b"))
        told = state.filter("not accepted").select("v", "nth").join(first, "v", "left")
        told = written(told.select("v", "nth", F.when(F.col("b").isNull(), 1).when(F.col("b.accepted"), 2).otherwise(0).alias("fate"), F.col("b.nth").alias("match")), "stem-fates")
        settled = told.filter("fate > 0").select("v", (F.col("fate") == 1).alias("accepted"), F.when(F.col("fate") == 2, F.col("match")).alias("match"))
        done = settled if done is None else done.unionByName(settled)
        if told.filter("fate = 0").isEmpty():
            return done
        kept = state.filter("accepted").unionByName(told.filter("fate <> 2").select("v", "nth", (F.col("fate") == 1).alias("accepted")))
        state = written(kept, "stem-state")


def semantic_dedup(rows: DataFrame, least: float = DEFAULTS.stem_cosine, block: int = BLOCK, tables: int = TABLES) -> DataFrame:
    """id, accepted, matched: each row in its place is accepted unless an accepted one before is near.

    rows has id, course_id, place and embedding; ids are unique, and break ties of place. Equal
    vectors of a course are near to the same rows, so the first of them stands for all: if it is
    accepted the others match it, and else they match what it matches. A vector whose cosine
    with itself is below least, as a null, zero or non-finite one's is, is near to nothing, and
    so is a row without a course. matched is the earliest accepted row that is near; a pair at
    the threshold shares none of the buckets with a probability below 1e-6. This isn't the same
    as dropping every row with an earlier neighbour. Other columns are not looked at; an empty
    table has no rows."""
    keyed = rows.select("id", "place", "course_id", "embedding", F.xxhash64("course_id", "embedding").alias("v"))
    none = F.lit(None).cast(rows.schema["id"].dataType)
    itself = F.coalesce((cosine(F.col("embedding"), F.col("embedding")) >= least) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.col("course_id").isNotNull(), F.lit(False))
    lone = keyed.filter(~itself).select("id", F.lit(True).alias("accepted"), none.alias("matched"))
    keyed = written(keyed.filter(itself), "stem-rows")
    first = keyed.groupBy("v").agg(F.min(F.struct("place", "id")).alias("f"), F.first("course_id").alias("course_id"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("k"))
    first = written(first.select("v", "f.id", "f.place", "course_id", "embedding", "k"), "stems")
    # Order as numbers that tasks compare: places in the order of (place, id), from partitions by range.
    ordered = first.select("v", "place", "id").repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "place", "id").sortWithinPartitions("place", "id")
    ordered = written(ordered.select("v", "id", F.monotonically_increasing_id().alias("nth")), "stem-order")
    stems = written(first.select("v", "course_id", "embedding").join(ordered.select("v", "nth"), "v"), "stems")
    fate = accept_in_order(stems, least, block, tables)
    heads = ordered.select("nth", F.col("id").alias("matched"))
    fate = fate.join(ordered, "v").join(heads.withColumnRenamed("nth", "match"), "match", "left").join(first.select("v", "k"), "v")
    fate = written(fate.select("v", "k", F.col("id").alias("head"), "accepted", "matched"), "stem-fates")
    every = salted_join(keyed.select("id", "v"), fate.drop("k"), ["v"], ["id"], counts=fate.select("v", "k"))
    is_head = F.col("id") == F.col("head")
    every = every.select("id", (is_head & F.col("accepted")).alias("accepted"), F.when(F.col("accepted"), F.when(is_head, none).otherwise(F.col("head"))).otherwise(F.col("matched")).alias("matched"))
    return every.unionByName(lone)
