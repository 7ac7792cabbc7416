"""Near duplicates by Order MinHash and banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number. Each
of TABLES sketches takes the two labelled shingles of least hash and keeps their text order,
so that agreement follows edit similarity, not only overlap. Texts of equal words are one
node. Nodes that share a sketch are linked through one of them, the leader; a pair counts
if a banded alignment of the two shingle sequences gives SIMILARITY or more. Where a bucket's nodes are in different components
after that, it is parted by other sketches and gets new leaders, as a link may have been missed
because the leader was near to neither text. What is in several components even then is
compared whole: a bucket's nodes are dealt into blocks of bounded size, and each pair of blocks
is a task's group in which every two texts of different components are looked at. So any two
near copies that share a sketch end up in one class; only groups of texts that share sketches
and are no near copies cost the square of their size."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import LOWER, UPPER, table, text_or_empty, written
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 20
PICKED = 2
#: Tables that part a bucket: those after its own.
AHEAD = 4
#: Texts, and shingles of texts, that a block of a bucket has on average at most.
BLOCK = 1024
BLOCK_SHINGLES = 500_000
#: Columns of a matrix of shingles at a time.
COLUMNS = 4096

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BASE = 0x9E3779B97F4A7C15
_SEEDS = np.random.default_rng(20240801).integers(1, 2**63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number mod 2**64 and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            steps = np.full(n, _BASE, np.uint64)
            back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        return self.up, self.down


_powers = _Powers()


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lowered text."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    up, down = _powers.upto(len(b) + 1)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    lo, hi = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return _mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of each run of size words; one of all words where there are fewer, none of none."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + words[j : n - k + 1 + j]
    return _mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles told apart by how often each came before."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    if new.all():
        return s
    at = np.arange(len(s))
    nth = np.zeros(len(s), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.where(nth > 0, _mix(s + nth * np.uint64(_BASE)), s)


def sketches(s: np.ndarray) -> np.ndarray:
    """TABLES sketches of labelled shingles: PICKED of least hash, in text order."""
    if not len(s):
        return np.zeros(0, np.int64)
    h = s[None, :] * _SEEDS[:, None]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    rows = np.arange(TABLES)
    picks = []
    for _ in range(min(PICKED, len(s))):
        at = h.argmin(axis=1)
        picks.append(at)
        h[rows, at] = np.uint64(2**64 - 1)
    out = np.zeros(TABLES, np.uint64)
    for at in np.sort(np.array(picks), axis=0):
        out = _mix(out * np.uint64(_BASE) + s[at])
    return _mix(out + _SEEDS).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (of the words), n shingles and sketches of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, counts, rows = [], [], []
            for t in b.column(2).to_pylist():
                raw = t.encode().translate(_LOWERED)
                w = word_hashes(raw)
                nodes.append(hashlib.blake2b(b" ".join(raw.split()), digest_size=16).digest())
                s = shingles(w)
                counts.append(len(s))
                rows.append(sketches(labelled(s)) if len(s) else s.view(np.int64))
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            ends = np.cumsum([0] + [len(r) for r in rows])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "text_key", "node", "n", "sketches"])

    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, node binary, n long, sketches array<long>")


def aligned(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """Matched places of the best alignment of two sequences, over the longer length.

    Only alignments that could reach least are looked at: their places differ by no more than
    the band (1 - least) * longer. One machine word of Python's integers holds many columns."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    if min(len(a), len(b)) < least * longer:
        return 0.0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    band = int((1 - least) * longer + 1e-9)
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for i, x in enumerate(a):
        hit = places.get(x, 0)
        if hit:
            left = max(0, i - band)
            hit = (hit >> left << left) & ((1 << (i + band + 1)) - 1)
            if hit:
                u = row & hit
                row = ((row + u) | (row - u)) & full
    return (lo + hi + len(b) - row.bit_count()) / longer


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two shingle sequences are near copies: places matched by the best alignment, over the longer length.

    Sequences that have too few shingles in common for any alignment are not aligned."""
    longer = max(len(a), len(b))
    if not longer or min(len(a), len(b)) < least * longer:
        return False
    x, y = a.tolist(), b.tolist()
    if (Counter(x) & Counter(y)).total() < least * longer:
        return False
    return aligned(x, y, least) >= least


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose texts (node, text) are near copies."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by the pair, not by a leader that many pairs share.
    rows = salted_join(pairs, one, ["a"], ["b"]).join(two, "b").repartition(4 * n, "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lambda t: shingles(word_hashes(t.encode().translate(_LOWERED)))
        for batch in batches:
            keep = [similar(cut(x), cut(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _fits(one: str, two: str) -> Column:
    """Lengths that a near copy may have."""
    return F.least(one, two) >= F.lit(SIMILARITY) * F.greatest(one, two)


def _parts(mixed: DataFrame) -> DataFrame:
    """part, node, root, n: rows of buckets (bucket, t, node, root, n, sketches), parted by the AHEAD tables after t.

    Tables go round, so two nodes that agree in TABLES // AHEAD of them are in a part together."""
    ahead = mixed.select("bucket", "t", "node", "root", "n", F.posexplode("sketches").alias("other", "sketch")).filter(F.pmod(F.col("other") - F.col("t"), F.lit(TABLES)).between(1, AHEAD))
    return ahead.select(F.xxhash64("bucket", "other", "sketch").alias("part"), "node", "root", "n")


def _refined(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) across components, from buckets (bucket, t, node, root, n, sketches).

    A bucket of several components is parted by the nodes' sketches, and each part has a leader
    of its own, its least node. Texts that share a passage part ways there, as near copies
    agree in many sketches. A part gives one pair for each node at most, so the pairs are
    AHEAD for each row of the buckets at most, whatever a bucket's size."""
    parts = written(_parts(mixed), "parts")
    leaders = parts.groupBy("part").agg(F.min(F.struct("node", "root", "n")).alias("l"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("k")).filter("r1 <> r2")
    leaders = written(leaders.select("part", "l", "k"), "part-leaders")
    met = salted_join(parts, leaders.drop("k"), ["part"], ["node"], counts=leaders.select("part", "k")).filter((F.col("root") != F.col("l.root")) & _fits("n", "l.n"))
    return met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def _block_pairs(apart: DataFrame) -> DataFrame:
    """pid, side, t, node, root, sketches: pairs of blocks of rows (bucket, t, node, root, n, sketches).

    A component that fills a good part of a block has blocks of its own, which are not paired
    with each other; the others of a bucket are pooled, a component in one block. A block that
    meets itself is there with side 0 only."""
    size = lambda k, n: F.ceil(F.greatest(F.col(k) / F.lit(BLOCK), F.col(n) / F.lit(BLOCK_SHINGLES), F.lit(1e-9)))
    roots = apart.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    roots = written(roots.withColumn("large", (F.col("k") * 4 > BLOCK) | (F.col("s") * 4 > BLOCK_SHINGLES)), "block-roots")
    pool = roots.filter("not large").groupBy("bucket").agg(F.sum("k").alias("pk"), F.sum("s").alias("ps"))
    roots = roots.join(pool.select("bucket", size("pk", "ps").alias("pools")), "bucket", "left")
    roots = roots.select("bucket", "root", F.when(F.col("large"), F.col("root")).alias("own"), F.when(F.col("large"), size("k", "s")).otherwise(F.col("pools")).alias("parts"))
    salt = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("root")).otherwise(F.col("node"))), F.col("parts"))
    rows = salted_join(apart, roots, ["bucket", "root"], ["node"]).withColumn("block", F.xxhash64("own", salt))
    rows = written(rows.select("bucket", "block", "own", "t", "node", "root", "sketches"), "blocks")

    blocks = rows.select("bucket", "block", "own").distinct()
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("own").alias("own2"))
    pairs = blocks.join(other, "bucket").filter((F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)))
    pairs = written(pairs.select(F.xxhash64("bucket", "block", "block2").alias("pid"), "bucket", "block", "block2"), "block-pairs")
    two = pairs.filter("block <> block2").select("pid", "bucket", F.col("block2").alias("block"), F.lit(1).alias("side"))
    sides = pairs.select("pid", "bucket", "block", F.lit(0).alias("side")).unionByName(two)
    return sides.join(rows, ["bucket", "block"]).select("pid", "side", "t", "node", "root", "sketches")


def in_common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of one shares with each of two: products of 0/1 matrices
    over the shingles that more than one text has."""
    cut = one + two if two is not one else one
    flat = np.concatenate(cut)
    owner = np.repeat(np.arange(len(cut)), [len(s) for s in cut])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    owner, column = owner[kept], shared[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = 0 if two is one else len(one)
    out = np.zeros((len(one), len(cut) - first), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        m = np.zeros((len(cut), COLUMNS), np.float32)
        m[owner[part], column[part] - lo] = 1
        out += m[: len(one)] @ m[first:].T
    return out


def _compared(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
    """Links between the components of one pair of blocks, of rows (side, t, node, root, sketches, shingles).

    Two texts are looked at in the first table they share. Links that the others imply are
    left out."""
    t = rows[0][1]
    one = [r for r in rows if r[0] == 0]
    two = [r for r in rows if r[0] == 1] or one
    up: dict[bytes, bytes] = {}

    def find(x):
        while x in up:
            x = up[x]
        return x

    names = {x: i for i, x in enumerate(dict.fromkeys(r[3] for r in rows))}
    part = lambda side: ([np.frombuffer(r[5], np.uint64) for r in side], np.array([names[r[3]] for r in side]), np.array([r[4] for r in side]))
    cut, root, marks = part(one)
    cut2, root2, marks2 = (cut, root, marks) if two is one else part(two)
    n, n2 = np.array([len(s) for s in cut]), np.array([len(s) for s in cut2])
    longer = np.maximum(n[:, None], n2[None, :])
    wanted = (root[:, None] != root2[None, :]) & (np.minimum(n[:, None], n2[None, :]) >= SIMILARITY * longer)
    wanted &= marks[:, None, t] == marks2[None, :, t]
    for k in range(t):
        wanted &= marks[:, None, k] != marks2[None, :, k]
    if two is one:
        wanted = np.triu(wanted, 1)
    if not wanted.any():
        return []
    # No alignment matches more places than there are shingles in common.
    own = [labelled(s) for s in cut]
    both = in_common(own, own if two is one else [labelled(s) for s in cut2])
    links = []
    for i, j in np.argwhere(wanted & (both >= SIMILARITY * longer - 1e-3)):
        x, y = find(one[i][3]), find(two[j][3])
        if x != y and similar(cut[i], cut2[j]):
            up[x] = y
            links.append((one[i][2], two[j][2]))
    return links


def _all_across(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between all near copies of one bucket in different components.

    Takes rows (bucket, t, node, root, n, sketches) and texts (node, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [shingles(word_hashes(t.encode().translate(_LOWERED))).tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary())], names=["node", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out():
            links = _compared(held) if held else []
            return pa.record_batch([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for pid, *row in zip(*(c.to_pylist() for c in b.columns)):
                if pid != at:
                    yield out()
                    at, held = pid, []
                held.append(tuple(row))
        yield out()

    n = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = texts.join(apart.select("node").distinct(), "node", "left_semi").select("node", "text")
    cuts = written(wanted.mapInArrow(cut, "node binary, s binary"), "shingles")
    rows = _block_pairs(apart).join(cuts, "node").select("pid", "side", "t", "node", "root", "sketches", "s")
    return rows.repartition(4 * n, "pid").sortWithinPartitions("pid", "side").mapInArrow(run, "a binary, b binary")


def _undecided(shared: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """bucket, t, node, root, n, sketches of the buckets whose nodes are in several components.

    A leader has been compared with all nodes of its bucket, so it isn't among them."""
    placed = shared.filter(F.col("node") != F.col("leader.node")).select("bucket", "t", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("k")).filter("r1 <> r2")
    mixed = written(mixed.select("bucket", "k"), "mixed")
    inside = salted_join(placed, mixed.select("bucket"), ["bucket"], ["node"], counts=mixed)
    return written(inside.join(nodes.select("node", "n", "sketches"), "node"), "mixed-buckets")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, class_id, kept for each row of docs.

    class_id is the smallest doc_id of the class; kept marks one row of a class: that of
    class_id. Texts of equal words (A-Z lowered) are copies; null and empty texts are texts
    of no words and so copies of each other. Texts of fewer than five words have one shingle
    of all words. A null doc_id is no candidate for class_id unless a class has no other;
    repeated rows are copies, and of rows alike in doc_id and text all are marked as the one.
    Other columns are not looked at; an empty table has no rows."""
    rows = written(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = written(rows.groupBy("node").agg(first, F.min("n").alias("n"), F.min("sketches").alias("sketches")), "nodes")

    # The least node leads, so that the buckets of one large group have few leaders in common.
    members = nodes.select("node", "n", F.posexplode("sketches").alias("t", "sketch")).select("node", "n", "t", F.xxhash64("t", "sketch").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("leader"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    buckets = written(buckets, "bucket-leaders")
    shared = written(salted_join(members, buckets.select("bucket", "leader"), ["bucket"], ["node"], counts=buckets.select("bucket", "k")), "buckets")
    # No near copies have lengths that are further apart.
    pairs = shared.filter((F.col("node") != F.col("leader.node")) & _fits("n", "leader.n")).select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")

    wanted = shared.select("node").distinct().join(nodes.select("node", "first"), "node")
    wanted = wanted.select("node", F.col("first.doc_id").alias("w_id"), F.col("first.text_key").alias("w_key"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    texts = text.join(wanted, (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    links = written(verified(pairs, texts), "near-links")
    found = components(links)

    apart = _undecided(shared, found, nodes)
    more = written(_refined(apart).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    late = written(verified(more, texts), "late-links")
    if not late.isEmpty():
        links = links.unionByName(late)
        found = components(links)
        apart = _undecided(shared, found, nodes)
    last = written(_all_across(apart, texts), "last-links")
    if not last.isEmpty():
        found = components(links.unionByName(last))

    ids = nodes.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(ids, "roots")
    heads = ids.groupBy("root").agg(F.min("first").alias("head"))
    of_node = salted_join(ids, heads, ["root"], ["node"]).select("node", "head")
    # A text of equal words may be a third of all rows.
    out = salted_join(rows.select("doc_id", "text_key", "node"), of_node, ["node"], ["doc_id", "text_key"])
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    return out.select("doc_id", "text_key", "node", F.col("head.doc_id").alias("class_id"), kept.alias("kept"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")
