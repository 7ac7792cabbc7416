"""LM scoring: a hierarchical log-bilinear model trained with noise-contrastive estimation.

Word counts are gathered from all training texts. The words, by falling count, are the leaves
of a tree of ARITY children a node: as many as the corpus has tokens for (TOKENS_PER_LEAF), up
to LEAVES, which bounds what is broadcast. Words beyond that share leaves by their endings, so
that every word, seen or not, has a leaf and a vector. The two words before a token are mapped
to vectors and added up; at each node on the way to the token's leaf that sum is multiplied
with the vectors of the node's children, plus biases, and normalised, so that the leaves' odds
add up to one whatever the size of the vocabulary. Within a shared leaf words have the odds of
their counts.

Training runs in shards of the training texts, dealt by a hash of the document, from one
common start; every token counts in a minibatch step at each of its nodes, against noise from
the node's children by their counts, of which the expectation is taken in place of a sample. The shards'
parameters are averaged by their tokens. Scores come from batched matrix products.

Counts of common words go to the tasks as a table of DICTIONARY words at most; all other words
of a text meet their counts in a shuffle, so that no count is cut off. Words of more than
LONGEST bytes stand as digests throughout, so that a table of words has a bound in bytes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, id_crc, table, text_or_empty, written

ARITY = 32
LEAVES = 262_144
TOKENS_PER_LEAF = 8192
#: One leaf in SHARED is for words without a leaf of their own.
SHARED = 16
DICTIONARY = 200_000
LONGEST = 64
DIM = 16
NOISE = 25
#: Tokens between two steps of the vectors of the words before.
GROUP = 1 << 16
#: Tokens of one node that make a step of its children's vectors, at most.
STEP = 1024
#: Tokens that are scored at a time, and those of one node among them.
SCORED, BATCH = 1 << 18, 8192
SHARD_TOKENS = 8_000_000
RATE = 0.1
SMOOTH = 0.1
HELD_OUT = 0
FOLDS = 10
END = " "
END_LEAF = 0
_FLUSH = 250_000
#: Texts that a task holds as Python strings at a time.
SLICE = 250
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str) -> list[bytes]:
    """The words, lowered; one beyond LONGEST bytes as # and its sha256, which no shorter word equals."""
    words = text.encode().translate(_LOWERED).split()
    if max(map(len, words), default=0) > LONGEST:
        return [w if len(w) <= LONGEST else b"#" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c over all words of docs (text) and one END for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        end = END.encode()

        def out():
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                for t in b.column(0).slice(lo, SLICE).to_pylist():
                    held.update(words_of(t))
                    held[end] += 1
                    if len(held) > _FLUSH:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Tree:
    """Where leaves are: level j has a node for each ARITY**(depth - j) leaves."""

    def __init__(self, leaves: int, arity: int = ARITY):
        self.leaves, self.arity, self.depth = leaves, arity, 1
        while arity**self.depth < leaves:
            self.depth += 1
        self.wide = [arity ** (self.depth - j) for j in range(self.depth)]
        self.nodes = [-(-leaves // w) for w in self.wide]

    def node(self, leaf: np.ndarray, level: int) -> np.ndarray:
        return leaf // self.wide[level]

    def child(self, leaf: np.ndarray, level: int) -> np.ndarray:
        return leaf // (self.wide[level] // self.arity) % self.arity


@dataclass
class Model:
    """Vectors of the two words before, and for each level those and the biases of all children (node, child)."""

    near: np.ndarray
    far: np.ndarray
    out: list[np.ndarray]
    bias: list[np.ndarray]

    def arrays(self) -> list[np.ndarray]:
        return [self.near, self.far, *self.out, *self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Model:
        """A model of this shape with the numbers of flat."""
        parts, at = [], 0
        for x in self.arrays():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        n = len(self.out)
        return Model(parts[0], parts[1], parts[2 : 2 + n], parts[2 + n :])


def shares(tree: Tree, mass: np.ndarray) -> list[np.ndarray]:
    """The share of each child (node, child) in its node, by the leaves' counts; 0 for children without leaves."""
    out = []
    for level in range(tree.depth):
        wide = tree.wide[level] // tree.arity
        full = np.zeros(tree.nodes[level] * tree.arity * wide)
        full[: len(mass)] = mass
        own = full.reshape(tree.nodes[level], tree.arity, wide).sum(2)
        out.append(own / np.maximum(own.sum(1, keepdims=True), 1e-300))
    return out


def initial(tree: Tree, share: list[np.ndarray]) -> Model:
    """Small random vectors, and biases of the children's shares, so that it begins as the unigram model."""
    r = np.random.default_rng(20240803)
    small = lambda *n: (r.standard_normal((*n, DIM)) * 0.05).astype(np.float32)
    bias = [np.where(p > 0, np.log(np.maximum(p, 1e-300)), -1e9).astype(np.float32) for p in share]
    return Model(small(tree.leaves), small(tree.leaves), [np.zeros((n, tree.arity, DIM), np.float32) for n in tree.nodes], bias)


def contexts(leaves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves two and one before each of several texts' leaves; a text begins after two ends."""
    n = len(leaves)
    near, far = np.full(n, END_LEAF, np.int64), np.full(n, END_LEAF, np.int64)
    near[1:], far[2:] = leaves[:-1], leaves[:-2]
    starts = starts[starts < n]
    near[starts] = far[starts] = END_LEAF
    seconds = starts[starts + 1 < n] + 1
    far[seconds] = END_LEAF
    return far, near


def _runs(sorted_nodes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """node, from, to of the runs of equal nodes."""
    if not len(sorted_nodes):
        return
    cut = np.flatnonzero(sorted_nodes[1:] != sorted_nodes[:-1]) + 1
    edges = [0, *cut.tolist(), len(sorted_nodes)]
    for lo, hi in zip(edges, edges[1:]):
        yield int(sorted_nodes[lo]), lo, hi


def _order(ids: np.ndarray) -> np.ndarray:
    """Places of ids in their order, equal ones as they come: a plain sort of ids and places in one number."""
    bits = max(1, len(ids) - 1).bit_length()
    return np.sort(ids << bits | np.arange(len(ids))) & ((1 << bits) - 1)


class Trainer:
    """Steps of noise-contrastive estimation with AdaGrad rates."""

    def __init__(self, tree: Tree, model: Model, share: list[np.ndarray]):
        self.tree, self.m = tree, model
        self.squares = model.like(np.full(model.flat().size, 1e-2, np.float32))
        for x in self.squares.out + self.squares.bias:
            x[:] = 1e-4
        #: Noise times share, and its log, for each child.
        self.weight = [(NOISE * p).astype(np.float32) for p in share]
        self.log_weight = [np.where(p > 0, np.log(np.maximum(NOISE * p, 1e-300)), 1e9).astype(np.float32) for p in share]

    def _step(self, level: int, node: int, q: np.ndarray, child: np.ndarray) -> np.ndarray:
        """One step of a node's children for contexts q; the gradient of q."""
        out, bias = self.m.out[level][node], self.m.bias[level][node]
        x = q @ out.T
        x += bias - self.log_weight[level][node]
        np.clip(x, -60, 60, out=x)
        g = np.exp(-x)
        g += 1
        np.reciprocal(g, out=g)  # the odds that a child is no noise
        at = np.arange(len(q))
        missed = 1 - g[at, child]
        g *= self.weight[level][node]
        g[at, child] -= missed
        dq = g @ out
        for p, s, d in ((out, self.squares.out[level][node], g.T @ q / len(q)), (bias, self.squares.bias[level][node], g.sum(0) / len(q))):
            s += d * d
            p -= RATE * d / np.sqrt(s)
        return dq

    def _context(self, p: np.ndarray, squares: np.ndarray, ids: np.ndarray, dq: np.ndarray) -> None:
        order = _order(ids)
        own = ids[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        d = np.add.reduceat(dq[order], first, axis=0) / np.diff(np.append(first, len(own)))[:, None].astype(np.float32)
        rows = own[first]
        s = squares[rows] + d * d
        squares[rows] = s
        p[rows] -= RATE * d / np.sqrt(s)

    def learn(self, far: np.ndarray, near: np.ndarray, leaf: np.ndarray) -> None:
        """Each token is in one step at each level, with up to STEP - 1 others of its node; the
        vectors of the words before take one step from all tokens given."""
        order = _order(leaf)
        own, a, b = leaf[order], near[order], far[order]
        q = self.m.near[a] + self.m.far[b]
        dq = np.zeros_like(q)
        for level in range(self.tree.depth):
            child = self.tree.child(own, level)
            # Mixed within a node, as its tokens come sorted by child.
            for node, lo, hi in _runs(self.tree.node(own, level)):
                k = -(-(hi - lo) // STEP)
                for i in range(k):
                    part = slice(lo + i, hi, k)
                    dq[part] += self._step(level, node, q[part], child[part])
        self._context(self.m.near, self.squares.near, a, dq)
        self._context(self.m.far, self.squares.far, b, dq)


def log_odds(tree: Tree, model: Model, far: np.ndarray, near: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The natural log of each leaf's probability after its two words: batched products node by node."""
    order = _order(leaf)
    own = leaf[order]
    q = model.near[near[order]] + model.far[far[order]]
    log = np.zeros(len(own), np.float64)
    for level in range(tree.depth):
        child = tree.child(own, level)
        for node, lo, hi in _runs(tree.node(own, level)):
            for i in range(lo, hi, BATCH):
                j = min(i + BATCH, hi)
                x = q[i:j] @ model.out[level][node].T
                x += model.bias[level][node]
                x -= x.max(1, keepdims=True)
                log[i:j] += x[np.arange(j - i), child[i:j]]
                np.exp(x, out=x)
                log[i:j] -= np.log(x.sum(1))
    out = np.empty_like(log)
    out[order] = log
    return out


class Vocabulary:
    """What the tasks need of the corpus counts; words is in the order of the leaves."""

    def __init__(self, leaves: int, words: list[tuple[bytes, int]], common: dict[bytes, int], shared_mass: np.ndarray, ends: int, n_tokens: int, n_words: int):
        self.n_tokens, self.n_words, self.ends = n_tokens, n_words, ends
        self.n_shared = len(shared_mass)
        self.first_shared = 1 + len(words)
        self.tree = Tree(leaves)
        held = dict(words) | common
        self.place = {w: i for i, w in enumerate(held)}
        counts = np.array([*held.values(), 0], np.float64)  # the last is for words that aren't held
        self.log_count = np.log10(counts + SMOOTH)
        self.leaf = np.array([1 + i if i < len(words) else self.shared(w) for i, w in enumerate(held)] + [0], np.int64)
        self.log_shared = np.log10(np.maximum(shared_mass, SMOOTH))
        self.mass = np.concatenate([[ends + SMOOTH], [c + SMOOTH for _, c in words], shared_mass])
        self.log_end = math.log10(ends + SMOOTH)
        self.log_total = math.log10(n_tokens + SMOOTH * (n_words + 1))

    def shared(self, word: bytes) -> int:
        """The leaf of a word that has none of its own: by its last three bytes."""
        return self.first_shared + zlib.crc32(word[-3:]) % self.n_shared


def shared_leaf(word, n_shared: int):
    """Vocabulary.shared of a column, less the first shared leaf."""
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(n_shared))


def vocabulary(counts: DataFrame, leaves: int = LEAVES, tokens_per_leaf: int = TOKENS_PER_LEAF, dictionary: int = DICTIONARY) -> Vocabulary:
    """At most leaves words and shares, and dictionary common words, come to the driver.

    The least count of a common word is the least power of two with few enough words at or
    over it, found from a table of at most 64 rows."""
    level = F.floor(F.log2("c")).cast("int")
    end = F.col("word") == F.lit(END).cast("binary")
    levels = {r["level"]: r for r in counts.groupBy(level.alias("level")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(end, F.col("c"))).alias("ends")).collect()}
    n, v = sum(r["n"] for r in levels.values()), sum(r["v"] for r in levels.values())
    ends = max((r["ends"] or 0 for r in levels.values()), default=0)
    held, least = 0, None
    for k in sorted(levels, reverse=True):
        held += levels[k]["v"]
        if held > dictionary:
            break
        least = 1 << k
    common = [] if least is None else counts.filter((F.col("c") >= least) & ~end).collect()
    n_leaves = max(2 * ARITY, min(leaves, n // tokens_per_leaf, v))
    n_shared = max(1, n_leaves // SHARED)
    top = counts.filter(~end).orderBy(F.desc("c"), "word").limit(n_leaves - 1 - n_shared).collect()
    # Words of the last own count are told apart by name, as in the order above.
    rest = counts.filter(~end)
    if top:
        c, w = top[-1]["c"], F.lit(bytes(top[-1]["word"]))
        rest = rest.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > w)))
    mass = np.full(n_shared, SMOOTH)  # for the words that were never seen
    for r in rest.groupBy(shared_leaf(F.col("word"), n_shared).alias("leaf")).agg(F.sum(F.col("c") + F.lit(SMOOTH)).alias("mass")).collect():
        mass[r["leaf"]] += r["mass"]
    words = [(bytes(r["word"]), r["c"]) for r in top]
    return Vocabulary(1 + len(words) + n_shared, words, {bytes(r["word"]): r["c"] for r in common}, mass, ends, n, v)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs (doc_id, text, learn) as row, doc_id, learn, deal, n_tokens, n_known, sums, extra, tail, n_tail, leaves.

    sums is the base's sum of logs of the words that are held, extra what a shared leaf's words
    add to the leaf's odds, tail the words whose counts are to be met, deal a hash of the row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        get, none = v.place.get, len(v.place)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                ids, learns, deals = (b.column(i).slice(lo, SLICE) for i in (0, 2, 3))
                cols: list[list] = [[] for _ in range(7)]
                leaves, ends = [], [0]
                for t in b.column(1).slice(lo, SLICE).to_pylist():
                    words = words_of(t)
                    place = np.fromiter(map(get, words, repeat(none)), np.int64, len(words))
                    leaf = v.leaf[place]
                    unheld = np.flatnonzero(place == none).tolist()
                    tail = [words[i] for i in unheld]
                    leaf[unheld] = [v.shared(w) for w in tail]
                    logs = v.log_count[place]
                    logs[unheld] = 0.0
                    low = leaf >= v.first_shared
                    extra = logs[low].sum() - v.log_shared[leaf[low] - v.first_shared].sum()
                    leaves += [leaf, [END_LEAF]]
                    ends.append(ends[-1] + len(words) + 1)
                    for c, x in zip(cols, (row, len(words) + 1, len(words) - len(tail) + (v.ends > 0), float(logs.sum()) + v.log_end, float(extra), tail, len(tail))):
                        c.append(x)
                    row += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.int64()]
                own = [pa.array(c, t) for c, t in zip(cols, kinds)]
                flat = pa.array(np.concatenate(leaves).astype(np.int32)) if leaves else pa.array([], pa.int32())
                yield pa.record_batch([own[0], ids, learns, deals, *own[1:], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=names)

    kinds = "row long, doc_id long, learn boolean, deal long, n_tokens long, n_known long, sums double, extra double, tail array<binary>, n_tail long, leaves array<int>"
    names = [k.split()[0] for k in kinds.split(", ")]
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce("learn", F.lit(False)).alias("learn"), F.xxhash64("doc_id", text).alias("deal"))
    return rows.mapInArrow(run, kinds)


def _texts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All leaves of a column of lists, and where each list starts."""
    starts = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), starts[:-1] - starts[0]


def _spread_keys(spark: SparkSession, n: int) -> DataFrame:
    """shard, key for n shards: keys that Spark's hash deals to n partitions one by one."""
    keys = spark.range(0, 32 * n + 1000, 1, 4).select("id", F.pmod(F.hash("id"), F.lit(n)).cast("int").alias("shard"))
    found = keys.groupBy("shard").agg(F.min("id").alias("key"))
    return spark.range(n).select(F.col("id").cast("int").alias("shard")).join(found, "shard", "left").select("shard", F.coalesce("key", -F.col("shard").cast("long")).alias("key"))


def fit(rows: DataFrame, vocab: Vocabulary, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model's parameters: shards of the rows (deal, n_tokens, leaves), averaged by their tokens.

    A shard has about shard_tokens tokens, or 128 for each leaf if that is more, so that what
    shards hand over stays below the input. Which shard a row is in, and its place there, is a
    matter of its hash alone, not of files or partitions."""
    spark = rows.sparkSession
    share = shares(vocab.tree, vocab.mass)
    start = initial(vocab.tree, share)
    n_shards = max(1, round(vocab.n_tokens / max(shard_tokens, 128 * vocab.tree.leaves)))
    sent = spark.sparkContext.broadcast((vocab.tree, start, share))
    piece = 1 << 18

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, start, share = sent.value
        at, trainer, n, held, size = None, None, 0, [], 0

        def flush():
            nonlocal held, size, n
            leaf = np.concatenate([x for x, _ in held])
            base = np.cumsum([0] + [len(x) for x, _ in held])
            far, near = contexts(leaf, np.concatenate([s + o for (_, s), o in zip(held, base)]))
            for lo in range(0, len(leaf), GROUP):
                part = slice(lo, lo + GROUP)
                trainer.learn(far[part], near[part], leaf[part])
            n, held, size = n + len(leaf), [], 0

        def close():
            if held:
                flush()
            flat = trainer.m.flat()
            for i in range(0, len(flat), piece):
                yield pa.record_batch([pa.array([i // piece], pa.int32()), pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([flat[i : i + piece].tobytes()], pa.binary())], names=["piece", "shard", "n", "p"])

        for b in batches:
            shard = b.column(0).to_numpy()
            for s, lo, hi in _runs(shard):
                if s != at:
                    if trainer:
                        yield from close()
                    at, trainer, n, held, size = s, Trainer(tree, start.like(start.flat()), share), 0, [], 0
                held.append(_texts(b.column(1).slice(lo, hi - lo)))
                size += len(held[-1][0])
                if size >= GROUP:
                    flush()
        if trainer:
            yield from close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weight: Counter = Counter()
        for b in batches:
            for k, n, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.float32) * np.float64(n)
                weight[k] += n
        for k, x in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([(x / weight[k]).astype(np.float32).tobytes()], pa.binary())], names=["piece", "p"])

    dealt = rows.select(F.pmod("deal", F.lit(n_shards)).cast("int").alias("shard"), "deal", "n_tokens", "leaves")
    dealt = dealt.join(F.broadcast(_spread_keys(spark, n_shards)), "shard").repartition(n_shards, "key").sortWithinPartitions("shard", "deal", "n_tokens").select("shard", "leaves")
    own = written(dealt.mapInArrow(learn, "piece int, shard int, n long, p binary"), "lm-shards")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = own.repartition(n, "piece").sortWithinPartitions("piece", "shard").select("piece", "n", "p").mapInArrow(merge, "piece int, p binary").collect()  # the parameters, once
    if not got:
        return start
    return start.like(np.concatenate([np.frombuffer(r["p"], np.float32) for r in sorted(got, key=lambda r: r["piece"])]))


def scored(rows: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score for each row of encoded(...), a written table."""
    sent = rows.sparkSession.sparkContext.broadcast((vocab.tree, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, model = sent.value
        for b in batches:
            logs = np.zeros(b.num_rows)
            sizes = np.diff(b.column(1).offsets.to_numpy())
            lo = 0
            while lo < b.num_rows:  # about SCORED tokens at a time, or one text
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SCORED)))
                leaf, starts = _texts(b.column(1).slice(lo, hi - lo))
                logs[lo : lo + len(starts)] = np.add.reduceat(log_odds(tree, model, *contexts(leaf, starts), leaf), starts)
                lo = hi
            yield pa.record_batch([b.column(0), pa.array(logs / math.log(10))], names=["row", "model"])

    # Written, as the tail's words are read from rows and the sums meet them again.
    model_scores = written(rows.select("row", "leaves").mapInArrow(run, "row long, model double"), "lm-scores")
    tail = rows.select("row", F.explode("tail").alias("word"))
    # A word outside the dictionary holds a small part of all tokens only.
    known = tail.join(counts, "word")
    # A tail word without a count has log10(SMOOTH); those with one make up the difference.
    more = known.groupBy("row").agg(F.sum(F.log10(F.col("c") + F.lit(SMOOTH)) - F.lit(math.log10(SMOOTH))).alias("more"), F.count(F.lit(1)).alias("found"))
    out = rows.drop("tail", "leaves", "deal").join(model_scores, "row").join(more, "row", "left")
    rest = F.coalesce("more", F.lit(0.0)) + F.col("n_tail") * F.lit(math.log10(SMOOTH))
    return out.select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.n_tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + rest - F.col("n_tokens") * F.lit(vocab.log_total)).alias("base_score"),
        (F.col("model") + F.col("extra") + rest).alias("score"),
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """Scores docs (doc_id, text, learn) by a model of the texts of those rows whose learn is true.

    One row for each row of docs, repeated or not. Null and empty texts are one end token;
    texts of any length are whole; a null learn is false; a null doc_id stays null. Without
    rows to learn from every word is an unseen one. Other columns are not looked at; an empty
    table has no rows."""
    counts = written(word_counts(docs.filter("learn")), "word-counts")
    vocab = vocabulary(counts)
    rows = written(encoded(docs, vocab), "lm-rows")
    return scored(rows, counts, vocab, fit(rows.filter("learn"), vocab))


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of fold HELD_OUT are scored by a model of all others, as are these."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(id_crc(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    out = train_and_score(docs.withColumn("learn", ~held))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
