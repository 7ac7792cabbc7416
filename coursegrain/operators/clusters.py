"""Average-linkage clustering of each course's vectors by cosine, with the number of clusters asked for.

Two clusters of unit vectors are, on average over their pairs, as similar as their mean vectors'
inner product, so a cluster is its mean and its size. Merges of mutually nearest clusters are
merges of the whole hierarchy, in whatever order they are made. A course of many clusters makes
all of them round by round, where the nearest cluster of each is found in pairs of blocks that
Spark deals out; once a course has few clusters left, one task makes its other merges by chains
of nearest neighbours. Of a course's merges the most similar ones are carried out, as many as
leave the number of clusters asked for: both ways give the same hierarchy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..sources.tables import remove_table, written
from .ranks import ranked

#: Clusters that a task finishes by itself; vectors of a block, numbers in them, and vectors multiplied at a time.
FEW = 2048
BLOCK = 8192
BLOCK_NUMBERS = 1 << 20
TILE = 256
#: Merges of a round that are broadcast.
SENT = 2000
DIGITS = 12


def wanted_clusters(n, per_cluster: int):
    """max(2, min(n, n / per_cluster rounded half to even)); one for one passage."""
    return F.least(n, F.greatest(F.lit(2), F.bround(n / F.lit(per_cluster)))).cast("long")


def _stacked(means) -> np.ndarray:
    """Rows as a matrix; shorter ones end in zeros."""
    rows = [np.zeros(0) if m is None else np.nan_to_num(np.asarray(m, np.float64)) for m in means]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def chain_merges(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(kept, gone, similarity) of all merges, by chains of nearest neighbours; kept < gone.

    The chain goes from a cluster to its nearest one until two are each other's nearest."""
    m, n = means.copy(), sizes.astype(np.float64)
    live = np.ones(len(m), bool)
    chain: list[int] = []
    out = []
    for _ in range(len(m) - 1):
        if not chain:
            chain = [int(np.argmax(live))]
        while True:
            tip = chain[-1]
            near = np.round(m @ m[tip], DIGITS)
            near[~live] = -np.inf
            near[tip] = -np.inf
            best = int(np.argmax(near))
            if len(chain) > 1 and near[chain[-2]] >= near[best]:
                break
            chain.append(best)
        other, tip = chain[-2], chain[-1]
        del chain[-2:]
        kept, gone = min(other, tip), max(other, tip)
        out.append((kept, gone, float(near[other])))
        m[kept] = (n[kept] * m[kept] + n[gone] * m[gone]) / (n[kept] + n[gone])
        n[kept] += n[gone]
        live[gone] = False
    return out


def _cut(n: int, merges: list[tuple[int, int, float]], clusters: int) -> list[int]:
    """Each of n places' cluster, numbered by first place, after the most similar merges."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for kept, gone, _ in sorted(merges, key=lambda x: -x[2])[: n - clusters]:
        a, b = find(kept), find(gone)
        up[max(a, b)] = min(a, b)
    number: dict[int, int] = {}
    return [number.setdefault(find(i), len(number)) for i in range(n)]


def _small_courses(nodes: DataFrame) -> DataFrame:
    """chunk_id, course_id, cluster of courses of FEW vectors at most: a task each."""
    schema = nodes.select("chunk_id", "course_id", F.lit(0).cast("long").alias("cluster")).schema

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk_id")
        means = _stacked(g["mean"])
        labels = _cut(len(g), chain_merges(means, np.ones(len(g))), int(g["wanted"].iloc[0]))
        return pd.DataFrame({"chunk_id": g["chunk_id"], "course_id": g["course_id"], "cluster": np.array(labels, np.int64)})

    return nodes.groupBy("course_id").applyInPandas(one, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones end in zeros."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False))
    wide = int(sizes.max(initial=0))
    if len(flat) == wide * len(sizes):
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def _under(parts: list[np.ndarray], wide: int) -> np.ndarray:
    """Matrices one under the other, of so many columns."""
    return np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in parts])


def _row_best(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first place of the most, in rounded numbers, and the most; only rows with near ties are rounded whole."""
    at = s.argmax(1)
    top = s[np.arange(len(s)), at]
    for i in np.flatnonzero(np.count_nonzero(s >= (top - 2 * 10.0**-DIGITS)[:, None], axis=1) > 1).tolist():
        at[i] = np.round(s[i], DIGITS).argmax()
    return at, np.round(top, DIGITS)


def _met(a: np.ndarray, b: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, similarity) of the nearest of b for each row of a, and of a for each of b; without b of a's others for each of a.

    TILE rows are multiplied at a time."""
    c = a if b is None else b
    own, sims = np.zeros(len(a), np.int64), np.zeros(len(a))
    back, most = np.zeros(len(c), np.int64), np.full(len(c), -np.inf)
    for lo in range(0, len(a), TILE):
        s = a[lo : lo + TILE] @ c.T
        if b is None:
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        own[lo : lo + TILE], sims[lo : lo + TILE] = _row_best(s)
        if b is not None:
            at, top = _row_best(np.ascontiguousarray(s.T))
            more = top > most
            back[more], most[more] = at[more] + lo, top[more]
    return [(own, sims)] if b is None else [(own, sims), (back, most)]


def _nearest_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(course_id, low, high, side, rep, mean), sorted by all but the last, to each row's nearest of the other side."""
    names = ["course_id", "rep", "other", "sim"]
    key, sides = None, ([], [])

    def close():
        if not sides[0] or not sides[1] and sum(len(r) for r, _ in sides[0]) < 2:
            return
        wide = max(m.shape[1] for side in sides for _, m in side)
        reps = [pa.concat_arrays([r for r, _ in side]) for side in sides if side]
        ms = [_under([m for _, m in side], wide) for side in sides if side]
        for rows, cols, (at, sims) in zip(reps, reps[::-1], _met(ms[0], ms[1] if len(ms) > 1 else None)):
            yield pa.record_batch([pa.repeat(key[0], len(rows)), rows, cols.take(pa.array(at)), pa.array(sims)], names=names)

    for b in batches:
        course, low, high, side, reps, means = b.columns
        marks = [pc.dictionary_encode(course).indices.to_numpy(), *(c.to_numpy() for c in (low, high, side))]
        cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1 if len(reps) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(reps)]):
            if lo == hi:
                continue
            now = (course[int(lo)], int(marks[1][lo]), int(marks[2][lo]))
            if now != key:
                yield from close()
                key, sides = now, ([], [])
            n = int(hi - lo)
            sides[marks[3][lo]].append((reps.slice(lo, n), _matrix(means.slice(lo, n))))
    yield from close()


def nearest_clusters(nodes: DataFrame, block: int = BLOCK, known: DataFrame | None = None) -> DataFrame:
    """course_id, rep, other, sim: of each cluster the most similar one of its course.

    Of equally similar ones the pair of the least rep counts, so that some pair is always mutual.
    Of nodes (course_id, rep, mean, fresh) the fresh ones meet all others, and the rest meet only
    these: known has what was nearest to each of the rest, which it is but for what is fresh."""
    number = lambda of: F.ceil(F.count_if(of) / F.lit(block)).cast("int")
    parts = nodes.groupBy("course_id").agg(number(F.col("fresh")).alias("new"), number(~F.col("fresh")).alias("old"))
    pairs = parts.agg(F.sum(F.col("new") * (F.col("new") + F.lit(1)) / F.lit(2) + F.col("new") * F.col("old"))).first()[0] or 0
    d = nodes.join(parts, "course_id").filter("new > 0")
    place = lambda among: F.pmod(F.xxhash64("rep"), F.greatest(among, F.lit(1))).cast("int")
    d = d.withColumn("own", F.when(F.col("fresh"), place(F.col("new"))).otherwise(F.col("new") + place(F.col("old"))))
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("fresh"), F.col("new") + F.col("old")).otherwise(F.col("new")) - F.lit(1))))
    d = d.select("course_id", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), (F.col("own") > F.col("with")).cast("int").alias("side"), "rep", "mean")
    kinds = dict(nodes.dtypes)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = d.repartition(max(1, min(4 * n, int(pairs))), "course_id", "low", "high").sortWithinPartitions("course_id", "low", "high", "side", "rep")
    near = near.mapInArrow(_nearest_in_blocks, f"course_id {kinds['course_id']}, rep {kinds['rep']}, other {kinds['rep']}, sim double")
    if known is not None:
        near = near.unionByName(known)
    best = near.groupBy("course_id", "rep").agg(F.min(F.struct((-F.col("sim")).alias("far"), F.least("rep", "other").alias("low"), F.greatest("rep", "other").alias("high"), "other")).alias("b"))
    return best.select("course_id", "rep", F.col("b.other").alias("other"), (-F.col("b.far")).alias("sim"))


def _large_courses(vectors: DataFrame, few: int, block: int) -> DataFrame:
    """As _small_courses, for courses of any size."""
    dims = vectors.agg(F.max(F.size("mean"))).first()[0] or 1
    block = max(1, min(block, BLOCK_NUMBERS // max(1, dims)))
    nodes = vectors.select("course_id", F.col("chunk_id").alias("rep"), F.lit(1).cast("long").alias("n"), "mean", F.lit(True).alias("fresh"))
    goal = written(vectors.groupBy("course_id").agg((F.count(F.lit(1)) - F.max("wanted")).alias("merges")), "cluster-goals")
    left, merges, turn = written(nodes, "clusters"), None, 0
    rest = known = before = None
    while not left.isEmpty():
        best = written(nearest_clusters(left, block, known), "nearest")
        now = best.groupBy("course_id").agg(F.count(F.lit(1)).alias("open"), F.max("sim").alias("top"))
        if merges is not None:
            sure = merges.join(now, "course_id").filter(F.col("sim") >= F.col("top")).groupBy("course_id").agg(F.count(F.lit(1)).alias("sure"))
            now = now.join(sure, "course_id", "left")
        else:
            now = now.withColumn("sure", F.lit(0).cast("long"))
        # What is left can only merge at less: enough merges above that are all that is asked for.
        state = written(now.join(goal, "course_id").select("course_id", (F.coalesce("sure", F.lit(0)) >= F.col("merges")).alias("ended"), (F.col("open") <= few).alias("few")), "cluster-state")
        if rest is None or not state.filter("few and not ended").isEmpty():
            small = written(left.join(state.filter("few and not ended").select("course_id"), "course_id", "left_semi").select("course_id", "rep", "n", "mean"), "few-clusters")
            rest = small if rest is None else rest.unionByName(small)
        on = state.filter("not few and not ended").select("course_id")
        a = best.join(on, "course_id", "left_semi")
        ends = a.groupBy("course_id", F.least("rep", "other").alias("kept"), F.greatest("rep", "other").alias("gone")).agg(F.count(F.lit(1)).alias("ends"), F.min("sim").alias("sim"))
        pairs = written(ends.filter("ends = 2").select("course_id", "kept", "gone", "sim", F.lit(turn).cast("long").alias("turn")), "merges")
        merges = pairs if merges is None else merges.unionByName(pairs)
        if turn % 8 == 7:
            merges = written(merges, "merges")
        # Many rounds make few merges, which are sent along; tables of many rows don't go by way of the driver.
        beside = F.broadcast if pairs.count() <= SENT else (lambda d: d.hint("merge"))
        kept = pairs.select("course_id", F.col("kept").alias("rep"), "gone")
        both = kept.select("course_id", F.explode(F.array("rep", "gone")).alias("other"))
        # A merged cluster is nobody's nearest if neither of its two was: average linkage has no inversions.
        moved = a.join(beside(both), ["course_id", "other"], "left_semi").select("course_id", "rep").unionByName(kept.select("course_id", "rep")).distinct()
        moved = written(moved.withColumn("fresh", F.lit(True)), "moved")
        moved = moved.hint("merge") if moved.count() > 10 * SENT else F.broadcast(moved)
        known = best.join(moved, ["course_id", "rep"], "left_anti")
        # Of merges only the names are sent along: the means of two meet where their rows are dealt to.
        names = kept.select("course_id", "rep", F.col("rep").alias("into")).unionByName(kept.select("course_id", F.col("gone").alias("rep"), F.col("rep").alias("into")))
        open_ = left.drop("fresh").join(on, "course_id", "left_semi")
        side = lambda stays: F.first(F.when((F.col("rep") == F.col("into")) == F.lit(stays), F.struct("n", "mean")), ignorenulls=True)
        met = open_.join(beside(names), ["course_id", "rep"]).groupBy("course_id", "into").agg(side(True).alias("one"), side(False).alias("two"))
        # Means of different lengths are as if the shorter one ended in zeros.
        n = F.col("one.n") + F.col("two.n")
        blend = F.zip_with("one.mean", "two.mean", lambda x, y: (F.coalesce(x, F.lit(0.0)) * F.col("one.n") + F.coalesce(y, F.lit(0.0)) * F.col("two.n")) / n)
        met = met.select("course_id", F.col("into").alias("rep"), n.alias("n"), blend.alias("mean"))
        live = open_.join(beside(names), ["course_id", "rep"], "left_anti").select("course_id", "rep", "n", "mean").unionByName(met)
        last = left
        left = written(live.join(moved, ["course_id", "rep"], "left").select("course_id", "rep", "n", "mean", F.coalesce("fresh", F.lit(False)).alias("fresh")), "clusters")
        known = known.join(on, "course_id", "left_semi")
        remove_table(last)
        if before is not None:
            remove_table(before)
        before = best
        turn += 1

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep")
        reps = g["rep"].to_numpy()
        made = chain_merges(_stacked(g["mean"]), g["n"].to_numpy())
        return pd.DataFrame({"course_id": [g["course_id"].iloc[0]] * len(made), "kept": [reps[k] for k, _, _ in made], "gone": [reps[x] for _, x, _ in made], "sim": [s for *_, s in made], "turn": np.arange(turn, turn + len(made), dtype=np.int64)})

    if merges is None:
        return vectors.select("chunk_id", "course_id", F.lit(0).cast("long").alias("cluster"))
    every = written(merges.unionByName(rest.groupBy("course_id").applyInPandas(finish, merges.schema)), "merges")
    placed = ranked(every, ["course_id"], [F.desc("sim"), F.asc("turn"), F.asc("gone")])
    up = written(placed.join(goal, "course_id").filter(F.col("place") < F.col("merges")).select("course_id", F.col("gone").alias("rep"), F.col("kept").alias("root")), "pointers")
    while True:
        # Each step doubles how far a pointer reaches.
        ahead = up.select("course_id", F.col("rep").alias("root"), F.col("root").alias("further"))
        more = written(up.join(ahead, ["course_id", "root"], "left").select("course_id", "rep", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "pointers")
        if more.filter("moved").isEmpty():
            break
        up = more.drop("moved")
    every = vectors.select("chunk_id", "course_id").join(up.withColumnRenamed("rep", "chunk_id"), ["course_id", "chunk_id"], "left").withColumn("root", F.coalesce("root", "chunk_id"))
    every = written(every, "cluster-roots")
    number = ranked(every.filter(F.col("root") == F.col("chunk_id")).select("course_id", "root"), ["course_id"], [F.asc("root")], "cluster")
    return every.join(number, ["course_id", "root"]).select("chunk_id", "course_id", "cluster")


def cluster_topics(vectors: DataFrame, t: Tunables = DEFAULTS, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """chunk_id, course_id, cluster: every passage in one cluster of its course.

    A course of n passages has max(2, min(n, round(n / chunks_per_cluster))) clusters, one if it
    has one passage; they are numbered from 0 by their first passage. A null or zero vector is as
    far from all others as an orthogonal one, and so is a null or non-finite entry left out;
    vectors of unlike lengths compare as if the shorter one ended in zeros. chunk_id is unique;
    a null course is no course, and its passages are left out. Of equally similar pairs the one
    of least ids merges first. Other columns are not looked at; no vectors, no rows."""
    good = F.transform(F.coalesce("embedding", F.array().cast(dict(vectors.dtypes)["embedding"])), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    d = vectors.filter("course_id is not null").select("chunk_id", "course_id", good.alias("e")).select("chunk_id", "course_id", F.when(norm > 0, F.transform("e", lambda x: x / norm)).otherwise(F.col("e")).alias("mean"))
    d = written(d, "unit-vectors")
    sizes = d.groupBy("course_id").agg(F.count(F.lit(1)).alias("size")).withColumn("wanted", wanted_clusters(F.col("size"), t.chunks_per_cluster))
    d = d.join(sizes, "course_id")
    small = _small_courses(d.filter(F.col("size") <= few).drop("size"))
    large = d.filter(F.col("size") > few).drop("size")
    if sizes.filter(F.col("size") > few).isEmpty():
        return small
    return small.unionByName(_large_courses(written(large, "large-courses"), few, block))
