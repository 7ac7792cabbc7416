"""Token ids in compressed files: an adaptive context-mixing range coder.

A segment holds the ids of a run of documents, SEGMENT at most; a longer document goes on in
the next segments, so that no task holds more. Its ids are cut into blocks with models of
their own, reset at each block's start, and with checksums of their bytes and of their ids, so
that a block can be read without any other. A block is cut into lanes of LANE ids, which are
coded side by side in numpy, an id of each at a step. They share the block's models: all see
them as they stood before the step and then teach them what they got.

Three predictions of an id are mixed to one distribution, by which a range coder codes the id
in one go: the id that last followed the same two ids, the id that last followed the same one,
and the block's own distribution of ids so far. The weights are adapted for each confidence of
the first two, and for whether they agree, by how often each of them held.

A range coder has a 64-bit window and gives 32 bits at a time. Lanes have no streams of their
own: a block's words are in the order in which reading asks for them. Ids beyond 16 bits are
coded as two halves.

Segments are rows of a Parquet table in the shared folder: Spark's committer writes them, so
that a lost executor leaves no half-written file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .tokens import MEMO_CHUNKS, encoder, tokenizer_path

MAGIC = b"CGTM"
LANE = 512
BLOCK = 4096 * LANE
SEGMENT = 2 * BLOCK
HEAD = struct.Struct("<4sBxxxIIIIQ")

_OWN = 18  # frequencies of the block's own distribution add up to 2**18
_ALL = _OWN + 6  # those of the mixed one to 2**24: the block's own weighs 1 to 64
_FIRST, _SECOND = 1 << 16, 1 << 18  # slots for one and for two ids before
_WORD, _FULL = np.uint64(32), np.uint64(1 << 32)
# A slot is id * 8 + confidence. What is added to it by confidence, without and with a hit: a miss
# halves the confidence; one of 1 at most puts in the new id.
_CHANGE = np.array([0, 0] + [(c >> 1) - c for c in range(2, 8)] + [1] * 7 + [0], np.int32)
_OVER = np.array([0] + [-(-(1 << 32) // w) for w in range(1, 65)])  # x * _OVER[w] >> 32 is x // w below 2**24


class Writer:
    """Range coders side by side."""

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        # Words as they come, and where the word of the same lane before is; two for each lane stand for its start.
        self.words = np.empty(lanes * (steps + 4), np.uint32)
        self.before = np.empty(lanes * (steps + 4), np.int64)
        self.before[lanes : 2 * lanes] = np.arange(lanes)
        self.last = np.arange(lanes, 2 * lanes)
        self.n = 2 * lanes

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """Codes an interval of 2**_ALL in each of the first lanes."""
        low, range_ = self.low[: len(start)], self.range[: len(start)]
        part = range_ >> np.uint64(_ALL)
        add = part * start.view(np.uint64)
        low += add
        at = self.last.take(np.flatnonzero(low < add))
        while len(at):  # carries
            self.words[at] += np.uint32(1)
            at = self.before[at[self.words[at] == 0]]
        np.multiply(part, size.view(np.uint64), out=range_)
        todo = np.flatnonzero(range_ < _FULL)
        held = low.take(todo)
        self._give(todo, held)
        low[todo] = held << _WORD
        range_[todo] = range_.take(todo) << _WORD

    def _give(self, lanes: np.ndarray, low: np.ndarray) -> None:
        end = self.n + len(lanes)
        self.words[self.n : end] = low >> _WORD
        self.before[self.n : end] = self.last.take(lanes)
        self.last[lanes] = np.arange(self.n, end)
        self.n = end

    def finish(self) -> np.ndarray:
        """All words; reading is two words ahead of writing."""
        for _ in range(2):
            self._give(np.arange(self.lanes), self.low)
            self.low <<= _WORD
        after = np.empty(self.n, np.int64)
        after[self.before[self.lanes : self.n]] = np.arange(self.lanes, self.n)
        return self.words[after[after[: self.n - 2 * self.lanes]]]


class Reader:
    """Reads what a Writer of as many lanes gave."""

    def __init__(self, lanes: int, words: np.ndarray):
        self.words = words.astype(np.uint64)
        self.code = self.words[:lanes] << _WORD | self.words[lanes : 2 * lanes]
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        self.n = 2 * lanes

    def place(self, lanes: int) -> np.ndarray:
        """Where in 2**_ALL the next interval of each of the first lanes lies."""
        self.part = self.range[:lanes] >> np.uint64(_ALL)
        return np.minimum(self.code[:lanes] // self.part, np.uint64((1 << _ALL) - 1)).view(np.int64)

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        code, range_ = self.code[: len(start)], self.range[: len(start)]
        code -= self.part * start.view(np.uint64)
        np.multiply(self.part, size.view(np.uint64), out=range_)
        todo = np.flatnonzero(range_ < _FULL)
        end = self.n + len(todo)
        code[todo] = code.take(todo) << _WORD | self.words[self.n : end]
        range_[todo] = range_.take(todo) << _WORD
        self.n = end


class Models:
    """The adapted tables of a block."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.slots = np.zeros(_FIRST + _SECOND, np.int32)
        self.counts = np.zeros(symbols, np.int64)
        # For confidence of the first, of the second and whether they agree: how often neither, one, two, both held.
        self.held = np.tile([4, 1, 1, 0], (128, 1))
        self.weigh(np.zeros(0, np.int64))
        self.spread(np.zeros(0, np.int64))

    def weigh(self, outcomes: np.ndarray) -> None:
        """Weights of the three predictions; they add up to 2**_ALL with the block's own as 2**_OWN times own."""
        self.held += np.bincount(outcomes, minlength=512).reshape(128, 4)
        neither, first, second = self.held[:, 0], self.held[:, 1], self.held[:, 2] + self.held[:, 3]
        n = neither + first + second
        self.own = np.clip((128 * neither + n) // (2 * n), 1, 64)
        rest = (64 - self.own) << _OWN
        self.second = rest * second // (first + second)
        self.first = rest - self.second

    def spread(self, ids: np.ndarray) -> None:
        """The block's own distribution, with more ids in it; each id has a frequency of 1 at least."""
        self.counts += np.bincount(ids, minlength=self.symbols)
        spare = (1 << _OWN) - self.symbols
        n = int(self.counts.sum())
        self.size = 1 + (self.counts * spare // n if n else np.full(self.symbols, spare // self.symbols))
        self.size[self.counts.argmax()] += (1 << _OWN) - int(self.size.sum())
        self.start = np.cumsum(self.size) - self.size
        self.ids = None

    def expect(self, far: np.ndarray, near: np.ndarray) -> None:
        """Both guesses and the weights for the next id of each lane; far and near are the two ids before."""
        n = len(near)
        self.at = np.empty(2 * n, np.int64)
        self.at[:n] = near
        self.at[n:] = _FIRST + ((near * 0x9E3779B1 + far * 0x85EBCA6B >> 9) & (_SECOND - 1))
        self.slot = self.slots.take(self.at)
        self.trust = self.slot & 7
        guess = self.slot >> 3
        self.guess = guess[:n], guess[n:]
        self.context = self.trust[:n] * 16 + self.trust[n:] * 2 + (self.guess[0] == self.guess[1])
        self.weights = self.own.take(self.context), self.first.take(self.context), self.second.take(self.context)

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold these places of 2**_ALL."""
        (g1, g2), (own, w1, w2) = self.guess, self.weights
        if self.ids is None:
            self.ids = np.repeat(np.arange(self.symbols, dtype=np.uint16), self.size)
        # A guess's weight comes first in its interval; it is taken out, the smaller id's before the other's.
        order = g1 < g2
        for guess, w in ((np.minimum(g1, g2), np.where(order, w1, w2)), (np.maximum(g1, g2), np.where(order, w2, w1))):
            place = place - np.minimum(np.maximum(place - own * self.start.take(guess), 0), w)
        return self.ids.take(place * _OVER.take(own) >> 32).astype(np.int64)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (g1, g2), (own, w1, w2) = self.guess, self.weights
        self.hits = g1 == ids, g2 == ids
        start = own * self.start.take(ids) + w1 * (g1 < ids) + w2 * (g2 < ids)
        return start, own * self.size.take(ids) + w1 * self.hits[0] + w2 * self.hits[1]

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Teaches the slots; where lanes meet in one, the last lane's id stays. Returns what held, by context."""
        hit = np.concatenate(self.hits)
        new = self.slot + _CHANGE.take(self.trust + 8 * hit)
        fresh = (ids * 8 + 1).astype(np.int32)
        self.slots[self.at] = np.where(hit | (self.trust > 1), new, np.concatenate([fresh, fresh]))
        return self.context * 4 + self.hits[0] + 2 * self.hits[1]


def _run(n: int, symbols: int, ids: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """The words of n ids below symbols, or the ids of words. All lanes but the last are of one length."""
    steps = min(n, LANE)
    lanes = -(-n // steps)
    last = n - steps * (lanes - 1)
    grid = np.zeros((steps, lanes), np.uint16)
    if ids is not None:
        grid[:, :-1] = ids[: n - last].reshape(-1, steps).T
        grid[:last, -1] = ids[n - last :]
    coder = Writer(lanes, steps) if words is None else Reader(lanes, words)
    outcomes = np.zeros((steps, lanes), np.int16)
    models = Models(symbols)
    near = far = np.zeros(lanes, np.int64)
    weighed = spread = 0

    def since(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return np.concatenate([rows[lo:hi, :-1].ravel(), rows[lo : min(hi, last), -1]])

    for t in range(steps):
        k = lanes if t < last else lanes - 1
        models.expect(far[:k], near[:k])
        if words is None:
            got = grid[t, :k].astype(np.int64)
            coder.put(*models.interval(got))
        else:
            grid[t, :k] = got = models.find(coder.place(k))
            coder.narrow(*models.interval(got))
        outcomes[t, :k] = models.learn(got)
        far, near = near, got
        done = t + 1
        if done < 16 or done % 8 == 0:
            models.weigh(since(outcomes, weighed, done))
            weighed = done
        if done & (done - 1) == 0 or done % 64 == 0:
            models.spread(since(grid, spread, done))
            spread = done
    return coder.finish() if words is None else grid.T.ravel()[:n]


def pack_segment(documents: list[tuple[int | None, np.ndarray]], block: int = BLOCK) -> bytes:
    """A segment of documents (id, ids): head, directory, table of blocks, blocks."""
    ids = np.concatenate([x for _, x in documents]).astype("<u4") if documents else np.zeros(0, "<u4")
    n_blocks = -(-len(ids) // block)
    halves = 1 if int(ids.max(initial=0)) < 1 << 16 else 2
    flat = ids.astype("<u2") if halves == 1 else ids.view("<u2")
    symbols = int(flat.max(initial=0)) + 1
    head = HEAD.pack(MAGIC, halves, symbols, block, len(documents), n_blocks, len(ids))
    names = np.array([0 if d is None else d for d, _ in documents], "<i8").tobytes()
    known = np.array([d is not None for d, _ in documents], np.uint8).tobytes()
    sizes = np.array([len(x) for _, x in documents], "<u8").tobytes()
    places, coded = [], []
    for lo in range(0, len(ids), block):
        own = flat[lo * halves : (lo + block) * halves]
        data = _run(len(own), symbols, ids=own).astype("<u4").tobytes()
        places.append((len(data), zlib.crc32(data), zlib.crc32(ids[lo : lo + block])))
        coded.append(data)
    return b"".join([head, names, known, sizes, np.array(places, "<u4").tobytes(), *coded])


def unpack_segment(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a segment; a block whose bytes or ids don't have their checksum is an error."""
    magic, halves, symbols, block, n_docs, n_blocks, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    names = np.frombuffer(data, "<i8", n_docs, at)
    known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    places = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).tolist()
    at += 12 * n_blocks
    ids = np.zeros(n_ids, "<u4")
    for i, (size, coded_crc, ids_crc) in enumerate(places):
        coded = np.frombuffer(data, "<u4", size // 4, at)
        own = ids[i * block : (i + 1) * block]
        good = zlib.crc32(coded) == coded_crc
        if good:
            flat = _run(len(own) * halves, symbols, words=coded)
            own[:] = flat if halves == 1 else np.ascontiguousarray(flat, "<u2").view("<u4")
        if not good or zlib.crc32(own) != ids_crc:
            raise ValueError(f"block {i} of a segment is damaged")
        at += size
    edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [(int(d) if k else None, ids[lo:hi]) for d, k, lo, hi in zip(names, known, edges, edges[1:])]


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements, modulo that of crc32; bits reversed, as crc32 has them."""
    out = 0
    for place in range(31, -1, -1):
        if a >> place & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the second one's length."""
    power, square, n = 1 << 31, 1 << 30, 8 * n_bytes  # the constant 1 and x
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


def write_token_files(docs: DataFrame, path: str | None = None, segment_ids: int = SEGMENT) -> DataFrame:
    """The table of segments: part, seq, first_doc, n_ids, data; in doc_id order, a null one first.

    first_doc is the place among its part's documents of the segment's first one, which may
    have begun in the segment before. Null and empty texts are one end token; texts of any
    length are cut into segments of segment_ids at most. Rows of one doc_id follow each other,
    sorted by a hash of the text. Other columns are not looked at; an empty table has no segment.
    A worker keeps its memo of chunks for its next task, until it reads files."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, 2 * MEMO_CHUNKS)
        part, seq, n_docs = TaskContext.get().partitionId(), 0, 0
        held, size, first = [], 0, 0

        def segment():
            row = (part, seq, first, size, pack_segment(held))
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "first_doc", "n_ids", "data"])

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                docs_ = b.column(0).slice(lo, 500).to_pylist()
                for doc, ids in zip(docs_, enc.encode(b.column(1).slice(lo, 500).to_pylist())):
                    while len(ids):
                        own, ids = ids[: segment_ids - size], ids[segment_ids - size :]
                        held.append((doc, own))
                        size += len(own)
                        if size == segment_ids:
                            yield segment()
                            seq, held, size, first = seq + 1, [], 0, n_docs + (not len(ids))
                    n_docs += 1
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    return written(ranged.mapInArrow(run, "part int, seq int, first_doc long, n_ids long, data binary"), "token-files")


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files.

    A document that goes on over segments has its parts' checksums joined; they are a row for
    each segment of it."""
    names = ["part", "seq", "doc", "doc_id", "inner", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        for b in batches:
            for part, seq, first, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                found = unpack_segment(data.as_buffer())
                sizes = np.array([len(x) for _, x in found], np.int64)
                n = len(found)
                yield pa.record_batch(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(np.arange(first, first + n)), pa.array([d for d, _ in found], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(np.ascontiguousarray(x)) for _, x in found], pa.int64())],
                    names=names,
                )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for parts in b.column(3).to_pylist():
                crc = 0
                for p in sorted(parts, key=lambda p: p["seq"]):
                    crc = joined_crc(crc, p["ids_crc32"], 4 * p["n_tokens"])
                crcs.append(crc)
            yield pa.record_batch([*(b.column(i) for i in range(3)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "seq", "first_doc", "data").mapInArrow(run, "part int, seq int, doc long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # Ids before each segment: before its part (a row for each part), then within the part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before_part"))
    order = Window.partitionBy("part").orderBy("seq")
    places = segments.select("part", "seq", "first_doc", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first_doc").over(order).alias("next_doc"), F.lag("seq").over(order).isNotNull().alias("later"))
    places = places.join(parts, "part").select("part", "seq", "first_doc", "next_doc", "later", (F.col("before") + F.col("before_part")).alias("before"))
    placed = written(rows.join(places, ["part", "seq"]).withColumn("start", F.col("before") + F.col("inner")), "token-rows")
    # The first document of a later segment may have begun before it, the last one may go on.
    edge = (F.col("later") & (F.col("doc") == F.col("first_doc"))) | F.coalesce(F.col("doc") == F.col("next_doc"), F.lit(False))
    cut = placed.filter(edge).groupBy("part", "doc").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.collect_list(F.struct("seq", "n_tokens", "ids_crc32")).alias("parts"))
    whole = cut.select("doc_id", "start", "n_tokens", "parts").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return placed.filter(~edge).select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(whole)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text")))
