"""Phrase collocation mining by HAT-trie counting, level by level.

Texts become blocks of word numbers once. A phrase of k words that is frequent begins and ends
with a frequent phrase of k - 1 words, so level k counts pairs of neighbours among these and
nothing else, which leaves no frequent phrase out. A task counts a block in a HAT-trie: hash
containers under a shallow trie of the number paths, which burst into smaller ones when full;
when all of it holds too much, the largest subtree leaves whole as a sorted run. Runs travel
packed, as differences of their keys, and are merged in partitions of path prefixes (the first
number and the upper part of the second, so that the phrases of one very common word are in
many partitions). What is frequent there goes back to the blocks that have it. No dictionary is
broadcast: each block gets its own share of the frequent words and phrases, so the plan is the
same at every size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import remove_table
from .common import table, written

MOST_WORDS = 5
LEAST = 100
TOP = 2000
#: Words of a block, bytes of text that become words at a time, keys that are sorted at a time.
BLOCK_WORDS = 1_000_000
SLICE_BYTES = 2 << 20
SLICE_KEYS = 1 << 18
#: Entries of a container, and of all containers of a trie.
BURST = 16_384
MOST_ENTRIES = 300_000
#: Keys that are laid together at a time when runs are merged.
MERGE_KEYS = 2_000_000
#: Second numbers that share a path prefix.
PATH_BITS = 8
#: Parts into which a lang's phrases are dealt before the last ranking.
RANK_PARTS = 64
# What ends a piece, as the contract gives it.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes(10 if c in PIECE_ENDS else c for c in range(256))
_END = b"\xff"  # in no UTF-8 text


class HatTrie:
    """Counts 64-bit keys in hash containers under a trie of their bytes; spill gets sorted runs."""

    def __init__(self, spill, burst: int = BURST, most: int = MOST_ENTRIES):
        self.spill, self.burst, self.most = spill, burst, most
        self.root: dict | list = {}
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys ascending, without repeats."""
        if len(keys):
            self.root, grown = self._add(self.root, keys, counts, 56)
            self.size += grown
        while self.size > self.most:
            self._shed()

    def _add(self, node, keys: np.ndarray, counts: np.ndarray, shift: int):
        """The node, which may have burst, and by how many entries it has grown."""
        if isinstance(node, dict):
            before, get = len(node), node.get
            for k, c in zip(keys.tolist(), counts.tolist()):
                node[k] = get(k, 0) + c
            grown = len(node) - before
            return (self._burst(node, shift) if len(node) > self.burst and shift >= 0 else node), grown
        digit = (keys >> np.uint64(shift)).astype(np.uint8)
        cuts = np.concatenate([[0], np.flatnonzero(digit[1:] != digit[:-1]) + 1, [len(keys)]])
        total = 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = int(digit[lo])
            node[at], grown = self._add({} if node[at] is None else node[at], keys[lo:hi], counts[lo:hi], shift - 8)
            total += grown
        return node, total

    def _burst(self, held: dict, shift: int) -> list:
        children: list = [None] * 256
        for k, c in held.items():
            at = k >> shift & 255
            if children[at] is None:
                children[at] = {}
            children[at][k] = c
        return [self._burst(x, shift - 8) if x is not None and len(x) > self.burst and shift > 0 else x for x in children]

    def _gather(self, node, into: dict) -> None:
        if isinstance(node, dict):
            into.update(node)
        elif node is not None:
            for x in node:
                self._gather(x, into)

    def _run(self, node) -> None:
        """Hands a subtree over as a sorted run."""
        held: dict = {}
        self._gather(node, held)
        keys = np.fromiter(held.keys(), np.uint64, len(held))
        order = np.argsort(keys)
        self.spill(keys[order], np.fromiter(held.values(), np.int64, len(held))[order])
        self.size -= len(held)

    def _entries(self, node) -> int:
        return 0 if node is None else len(node) if isinstance(node, dict) else sum(map(self._entries, node))

    def _shed(self) -> None:
        """The largest subtree below the first branching goes."""
        node, parent, at = self.root, None, 0
        while isinstance(node, list) and sum(x is not None for x in node) == 1:
            parent, at = node, next(i for i, x in enumerate(node) if x is not None)
            node = node[at]
        if isinstance(node, list):
            at = max(range(256), key=lambda i: self._entries(node[i]))
            self._run(node[at])
            node[at] = None
        else:
            self._run(node)
            if parent is None:
                self.root = {}
            else:
                parent[at] = None

    def drain(self) -> None:
        """All that is left, subtree by subtree."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [x for x in reversed(node) if x is not None]
            elif node:
                self._run(node)
        self.root = {}


class _Words(dict):
    """Numbers of words in the order of their first use, out of a count that langs share."""

    def __init__(self, names: list):
        super().__init__({_END: -1})
        self.names = names

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.names)
        self.names.append(word)
        return i


def _pieces(texts: list[bytes]) -> Iterator[bytes]:
    """The texts with a line feed for whatever ends a piece, cut into slices at such places."""
    data = b"\n".join(texts).lower().translate(_TO_LINES)
    at = 0
    while at < len(data):
        cut = data.find(b"\n", at + SLICE_BYTES)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut]
        at = cut + 1


# Packed runs: a row holds a block's share of one prefix partition, keys ascending.
RUNS = "part int, block long, lang string, ids binary, keys binary, more binary, k binary"
_RUN_NAMES = ["part", "block", "lang", "ids", "keys", "more", "k"]
#: What the merge of a level says: rows with a block tell it the numbers of its keys, the others are the frequent keys.
MERGED = "part int, block long, lang string, keys binary, more binary, word string, first long, second long, f long, nth long"
_MERGED_NAMES = ["part", "block", "lang", "keys", "more", "word", "first", "second", "f", "nth"]


def _squeezed(x: np.ndarray) -> bytes:
    """Ascending numbers as the zlib of their differences' bytes, plane by plane."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return zlib.compress(d.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _loosened(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def _planes(x: np.ndarray) -> bytes:
    """Numbers of which most are small as the zlib of their bytes, plane by plane; -1 counts as the smallest."""
    return zlib.compress((x + 1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _numbers(b: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel() - 1


def _run_row(part: int | None, block: int, lang: str | None, ids: bytes | None, keys: bytes | None, more: bytes | None, k: bytes | None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], t) for v, t in zip((part, block, lang, ids, keys, more, k), kinds)], names=_RUN_NAMES)


def _paths(keys: np.ndarray, parts: int) -> np.ndarray:
    """The prefix partition of each key: by the first number and the upper bits of the second."""
    h = (keys >> np.uint64(PATH_BITS)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _encode(parts: int):
    """(lang, text) to blocks: one row with the numbers of all its words, -1 between pieces, and
    for each lang and partition the words that it has there, their numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        state: dict = {}

        def reset(no: int) -> None:
            state.update(no=no, names=[], langs={}, arrays=[], size=0)

        def block() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(state["arrays"])
            counts = np.bincount(ids[ids >= 0], minlength=len(state["names"]))
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-counts, kind="stable")
            rank = np.full(len(order) + 1, -1, np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            no = task << 33 | state["no"]
            yield _run_row(None, no, None, _planes(rank[ids]), None, None, None)
            for lang, own in state["langs"].items():
                words = sorted(w for w in own if w != _END)
                of: list[list[bytes]] = [[] for _ in range(parts)]
                for w in words:
                    of[zlib.crc32(w) % parts].append(w)
                for p, some in enumerate(of):
                    if some:
                        local = np.fromiter(map(own.__getitem__, some), np.int32, len(some))
                        yield _run_row(p, no, lang, None, zlib.compress(b"\n".join(some), 1), zlib.compress(rank[local].tobytes(), 1), _planes(counts[local]))
            reset(state["no"] + 1)

        reset(0)
        for b in batches:
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(b.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            texts = b.column(1).cast(pa.binary())
            for lang, at in by_lang.items():
                for piece in _pieces(texts.take(pa.array(at)).to_pylist()):
                    tokens = piece.replace(b"\n", b" " + _END + b" ").split()
                    own = state["langs"].get(lang)
                    if own is None:
                        own = state["langs"][lang] = _Words(state["names"])
                    state["arrays"] += [np.fromiter(map(own.__getitem__, tokens), np.int32, len(tokens)), np.array([-1], np.int32)]
                    state["size"] += len(tokens)
                    if state["size"] >= BLOCK_WORDS:
                        yield from block()
        if state["size"]:
            yield from block()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(part, lang) and the rows (block, keys, more, k) of each, of rows sorted by them."""
    at, held = None, []
    for b in batches:
        for i in range(b.num_rows):
            part, block, lang, _, keys, more, k = (b.column(j)[i].as_py() for j in range(7))
            if (part, lang) != at:
                if held:
                    yield at, held
                at, held = (part, lang), []
            held.append((block, keys, more, k))
    if held:
        yield at, held


def _told(part: int, block: int, lang: str | None, keys: bytes, more: bytes) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string(), *[pa.int64()] * 4]
    return pa.record_batch([pa.array([v], t) for v, t in zip((part, block, lang, keys, more, None, None, None, None, None), kinds)], names=_MERGED_NAMES)


def _frequent_rows(part: int, lang: str | None, nth: np.ndarray, words: pa.Array | None, first: pa.Array | None, second: pa.Array | None, f: np.ndarray) -> pa.RecordBatch:
    n = len(f)
    null = lambda kind: pa.nulls(n, kind)
    columns = [pa.array(np.full(n, part, np.int32)), null(pa.int64()), pa.array([lang] * n, pa.string()), null(pa.binary()), null(pa.binary()), words or null(pa.string()), first or null(pa.int64()), second or null(pa.int64()), pa.array(f.astype(np.int64)), pa.array(nth.astype(np.int64))]
    return pa.record_batch(columns, names=_MERGED_NAMES)


def _merge_words(least: int):
    """The runs of words of a partition and lang: frequent ones get numbers, and their blocks hear of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_of: dict[int, int] = {}
        for (part, lang), rows in _groups(batches):
            total: dict[bytes, int] = {}
            get = total.get
            for _, keys, _, k in rows:
                for w, c in zip(zlib.decompress(keys).split(b"\n"), _numbers(k, np.int64).tolist()):
                    total[w] = get(w, 0) + c
            # The sum over all words, rare ones too, stands in a row of its own, without a word.
            yield _frequent_rows(part, lang, np.array([-1]), None, None, None, np.array([sum(total.values())]))
            some = sorted((w for w, c in total.items() if c >= least), key=lambda w: (-total[w], w))
            if not some:
                continue
            nth = next_of.get(part, 0)
            number = {w: nth + i for i, w in enumerate(some)}
            next_of[part] = nth + len(some)
            yield _frequent_rows(part, lang, np.arange(nth, nth + len(some)), pa.array(some, pa.binary()).cast(pa.string()), None, None, np.array([total[w] for w in some]))
            for block, keys, more, _ in rows:
                of = np.array([number.get(w, -1) for w in zlib.decompress(keys).split(b"\n")], np.int64)
                ok = of >= 0
                if ok.any():
                    yield _told(part, block, lang, np.frombuffer(zlib.decompress(more), np.int32)[ok].astype(np.uint64).tobytes(), of[ok].tobytes())

    return run


def _merge_pairs(least: int):
    """As _merge_words for runs of pairs: sorted runs are laid together and their counts added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, _), rows in _groups(batches):
            keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

            def settle():
                every, at = np.unique(np.concatenate([keys, *(x for x, _ in waiting)]), return_inverse=True)
                return every, np.bincount(at, np.concatenate([counts, *(c for _, c in waiting)]), len(every)).astype(np.int64)

            size = 0
            for _, own, _, k in rows:
                waiting.append((_loosened(own, np.uint64), _numbers(k, np.int64)))
                size += len(waiting[-1][0])
                if size > MERGE_KEYS:
                    keys, counts = settle()
                    waiting, size = [], 0
            keys, counts = settle()
            some, f = keys[counts >= least], counts[counts >= least]
            if not len(some):
                continue
            # Frequent ones get small numbers, which pack well.
            nth = np.empty(len(f), np.int64)
            nth[np.argsort(-f, kind="stable")] = np.arange(len(f))
            yield _frequent_rows(part, None, nth, None, pa.array((some >> np.uint64(32)).astype(np.int64)), pa.array((some & np.uint64(0xFFFFFFFF)).astype(np.int64)), f)
            for block, own, _, _ in rows:
                hit = np.flatnonzero(np.isin(some, _loosened(own, np.uint64), assume_unique=True))
                if len(hit):
                    yield _told(part, block, None, some[hit].tobytes(), nth[hit].tobytes())

    return run


def _merged(runs: DataFrame, merge, name: str) -> DataFrame:
    """What merge tells of the runs, partition by partition."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.filter("part is not null").repartition(n, "part").sortWithinPartitions("part", "lang", "block")
    return written(rows.mapInArrow(merge, MERGED), name)


def _count_blocks(first: bool, parts: int, burst: int, most: int):
    """(block, ids, told) to the block in the new numbers and the packed runs of its neighbours' pairs.

    told lists a block's keys and their numbers by partition. In the first level keys are the
    numbers that words have in the block, later they are pairs; what isn't told becomes -1.
    Numbers without a neighbour on either side make no pair and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, told = b.column(0)[i].as_py(), b.column(2)[i].as_py()
                known = np.concatenate([np.frombuffer(t["keys"], np.uint64) for t in told])
                new = np.concatenate([np.frombuffer(t["more"], np.int64) * parts + t["part"] for t in told])
                grams = _packed(_renamed(_numbers(b.column(1)[i].as_py(), np.int32 if first else np.int64), known, new, first))
                out: list[tuple[np.ndarray, np.ndarray]] = []
                trie = HatTrie(lambda k, n: out.append((k, n)), burst, most)
                keys = _pairs(grams)
                for lo in range(0, len(keys), SLICE_KEYS):
                    trie.add(*np.unique(keys[lo : lo + SLICE_KEYS], return_counts=True))
                trie.drain()
                yield from _packed_runs(block, out, parts)
                if len(keys):
                    yield _run_row(None, block, None, _planes(grams), None, None, None)

    return run


def _renamed(ids: np.ndarray, known: np.ndarray, new: np.ndarray, first: bool) -> np.ndarray:
    """For each place (each pair of neighbours, after the first level) the new number, or -1."""
    if first:
        of = np.full(int(max(ids.max(initial=-1), known.max(initial=0))) + 2, -1, np.int64)
        of[known.astype(np.int64)] = new
        return of[ids]
    order = np.argsort(known)
    known, new = known[order], new[order]
    grams = np.full(max(len(ids) - 1, 0), -1, np.int64)
    pairs = _pairs(ids)
    at = np.searchsorted(known, pairs)
    at[at == len(known)] = 0
    grams[(ids[:-1] >= 0) & (ids[1:] >= 0)] = np.where(known[at] == pairs, new[at], -1)
    return grams


def _pairs(grams: np.ndarray) -> np.ndarray:
    """Neighbours as one key each, where neither is -1."""
    ok = (grams[:-1] >= 0) & (grams[1:] >= 0)
    return grams[:-1][ok].astype(np.uint64) << np.uint64(32) | grams[1:][ok].astype(np.uint64)


def _packed(grams: np.ndarray) -> np.ndarray:
    """Without what has no neighbour; one -1 between runs."""
    ok = np.concatenate([[False], grams >= 0, [False]])
    paired = ok[1:-1] & (ok[:-2] | ok[2:])
    after = np.concatenate([[False], paired[:-1]])
    return np.where(paired, grams, -1)[paired | after]


def _packed_runs(block: int, runs: list[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each prefix partition that the runs of a block reach; runs of one block are sums of one key."""
    if not runs:
        return
    keys, counts = (np.concatenate(x) for x in zip(*runs))
    to = _paths(keys, parts)
    order = np.lexsort((keys, to))
    keys, counts, to = keys[order], counts[order], to[order]
    cuts = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield _run_row(int(to[lo]), block, None, None, _squeezed(keys[lo:hi]), None, _planes(counts[lo:hi]))


def _level(blocks: DataFrame, told: DataFrame, first: bool, parts: int, burst: int, most: int) -> DataFrame:
    """Blocks in the numbers of the frequent keys they have, and the packed runs of their pairs."""
    own = told.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "keys", "more")).alias("told"))
    met = blocks.join(own, "block").select("block", "ids", "told")
    return written(met.mapInArrow(_count_blocks(first, parts, burst, most), RUNS), "phrase-runs", "zstd")


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, burst: int = BURST, most: int = MOST_ENTRIES) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (all word occurrences); and for each length from 1 on: id, lang, words, heads, tails.

    Phrases occur least times or more within pieces. heads are the counts of their first one,
    two, ... words, tails those of their last ones; both end with the phrase's own count."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    runs = written(d.mapInArrow(_encode(parts), RUNS), "phrase-blocks", "zstd")

    def numbered(told: DataFrame) -> DataFrame:
        """The frequent keys with their number id: the partitions take turns."""
        return told.filter("nth >= 0").withColumn("id", F.col("nth") * F.lit(parts) + F.col("part"))

    told = _merged(runs, _merge_words(least), "frequent-words")
    totals = told.filter("nth = -1").groupBy("lang").agg(F.sum("f").alias("n")).filter("n > 0")
    levels = [written(numbered(told).select("id", "lang", F.array("word").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails")), "phrases-1")]
    for k in range(2, most_words + 1):
        last, runs = runs, _level(runs.filter("ids is not null").select("block", "ids"), told, k == 2, parts, burst, most)
        remove_table(last)  # the blocks are in the next table now
        told = _merged(runs, _merge_pairs(least), f"frequent-{k}")
        before = levels[-1]
        p = before.select(F.col("id").alias("first"), F.col("lang").alias("of"), F.col("words").alias("w"), F.col("heads").alias("h"))
        s = before.select(F.col("id").alias("second"), F.element_at("words", -1).alias("last"), F.col("tails").alias("t"))
        grams = numbered(told).select("id", "first", "second", "f").join(p, "first").join(s, "second")
        levels.append(written(grams.select("id", F.col("of").alias("lang"), F.array_append("w", F.col("last")).alias("words"), F.array_append("h", F.col("f")).alias("heads"), F.array_append("t", F.col("f")).alias("tails"), "first", "second"), f"phrases-{k}"))
    remove_table(runs)
    return totals, levels


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, burst: int = BURST, most: int = MOST_ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each lang.

    A phrase has two words or more and occurs least times or more; the cut into two parts with the
    lowest score counts, score being floor(1000 a n / (l r)) in decimals of 38 digits. A phrase in
    a longer one that occurs as often is left out; as counts never rise with length, looking at
    phrases one word longer finds all of these. A null lang is und, a null or empty text has no
    words; repeated rows count each time. A long text is split between pieces only. Other columns
    are not looked at; an empty table has no rows."""
    totals, levels = frequent_phrases(docs, least, most_words, burst, most)
    every = None
    for k, level in enumerate(levels[1:], 2):
        a = F.element_at("heads", -1)
        d = level.select("id", "lang", "words", "heads", "tails", a.alias("a"))
        if k < most_words:
            longer = levels[k].select("first", "second", F.element_at("heads", -1).alias("b"))
            longer = longer.select(F.explode(F.array("first", "second")).alias("id"), "b").groupBy("id").agg(F.max("b").alias("b"))
            d = d.join(longer, "id", "left").filter(F.col("b").isNull() | (F.col("b") < F.col("a")))
        d = d.drop("id", "b")
        every = d if every is None else every.unionByName(d)
    whole = lambda x: f"cast({x} as decimal(19, 0))"
    cut = f"named_struct('score', (1000 * {whole('a')} * {whole('n')}) div ({whole('heads[c - 1]')} * {whole('tails[size(words) - c - 1]')}), 'c', c, 'l', heads[c - 1], 'r', tails[size(words) - c - 1])"
    scored = every.join(totals, "lang").withColumn("best", F.expr(f"array_min(transform(sequence(1, size(words) - 1), c -> {cut}))"))
    scored = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return part.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS MATERIALIZED (
  SELECT lang, m, p, count(*) AS f
  FROM (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p FROM spots, (SELECT unnest(range(1, {MOST_WORDS} + 1)) AS m) WHERE i + m - 1 <= len(w))
  GROUP BY ALL HAVING count(*) >= {LEAST}),
longer AS (
  SELECT lang, m - 1 AS m, p, max(f) AS f
  FROM (SELECT lang, m, f, array_to_string(list_slice(string_split(p, ' '), 1, m - 1), ' ') AS p FROM grams UNION ALL SELECT lang, m, f, array_to_string(list_slice(string_split(p, ' '), 2, m), ' ') FROM grams)
  GROUP BY ALL),
cuts AS (
  SELECT g.lang, g.m, g.p, g.f, unnest(range(1, g.m)) AS k FROM grams g LEFT JOIN longer l ON l.lang = g.lang AND l.m = g.m AND l.p = g.p
  WHERE g.m >= 2 AND (l.f IS NULL OR l.f < g.f)),
scored AS (
  SELECT c.lang, c.p, c.f AS a, x.f AS l, y.f AS r, t.n, c.k, (1000 * c.f::HUGEINT * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams x ON x.lang = c.lang AND x.m = c.k AND x.p = array_to_string(list_slice(string_split(c.p, ' '), 1, c.k), ' ')
  JOIN grams y ON y.lang = c.lang AND y.m = c.m - c.k AND y.p = array_to_string(list_slice(string_split(c.p, ' '), c.k + 1, c.m), ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
