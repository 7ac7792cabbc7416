"""Packing pieces of documents into sequences by swap-based local search.

Every document is encoded and cut into pieces of SEQ_LEN tokens at most. Pieces are dealt by
a hash of their row into pools of about POOL pieces, so that a pool is a bounded task whatever
the input, and one huge document, or one that is repeated, is spread over all pools; a pool
costs at most a bin or so more than a packing of everything at once. A pool starts from its
pieces in the order they come in, a new bin for each that doesn't fit the last one. A local
search over the bins that are not full does the rest: pieces of the emptiest bin move to
others, or are exchanged one for one or two for one, each step increasing the sum of squared
fills, until bins are empty and no step is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .tokens import encoder, tokenizer_path

SEQ_LEN = 4096
POOL = 50_000

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, seq_len: int = SEQ_LEN, path: str | None = None) -> DataFrame:
    """The pieces of each document: cuts at multiples of seq_len only.

    row_key numbers the rows of docs; the same rows may have other numbers in another run."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                for i, lo in enumerate(range(0, len(ids), seq_len)):
                    part = ids[lo : lo + seq_len]
                    for c, v in zip(out, (doc, row, i, lo, len(part), zlib.crc32(part))):
                        c.append(v)
                row += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)


def next_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of places in lengths, in order; a piece that doesn't fit the last bin opens one."""
    bins: list[list[int]] = []
    room = -1
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


class Search:
    """Bins of pieces, and the steps between those that are not full.

    Two indexes serve the steps, each with one bit of a Python integer for a key that is in use:
    open bins by their room, and the pieces of open bins by what their bin could hold in their
    place (room and length). The bin that gives is in neither."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins = [set(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.home = {i: k for k, b in enumerate(bins) for i in b}
        self.room_bits = self.place_bits = 0
        self.by_room: dict[int, set[int]] = {}
        self.by_place: dict[int, set[int]] = {}
        self.steps = 0
        for k in range(len(bins)):
            self._put(k)

    def _put(self, k: int) -> None:
        """Enters an open bin in the indexes."""
        room = self.size - self.fill[k]
        if not room or not self.bins[k]:
            return
        self.by_room.setdefault(room, set()).add(k)
        self.room_bits |= 1 << room
        for i in self.bins[k]:
            place = room + self.lengths[i]
            self.by_place.setdefault(place, set()).add(i)
            self.place_bits |= 1 << place

    def _take(self, k: int) -> None:
        room = self.size - self.fill[k]
        if not room or not self.bins[k]:
            return
        held = self.by_room[room]
        held.discard(k)
        if not held:
            del self.by_room[room]
            self.room_bits ^= 1 << room
        for i in self.bins[k]:
            place = room + self.lengths[i]
            held = self.by_place[place]
            held.discard(i)
            if not held:
                del self.by_place[place]
                self.place_bits ^= 1 << place

    def _trade(self, b: int, k: int, given: tuple[int, ...], back: int | None) -> None:
        """Gives pieces of b (which is out of the indexes) to k, and one of k's back."""
        self._take(k)
        for i in given:
            self.bins[b].remove(i)
            self.bins[k].add(i)
            self.home[i] = k
            self.fill[b] -= self.lengths[i]
            self.fill[k] += self.lengths[i]
        if back is not None:
            self.bins[k].remove(back)
            self.bins[b].add(back)
            self.home[back] = b
            self.fill[k] -= self.lengths[back]
            self.fill[b] += self.lengths[back]
        self._put(k)
        self.steps += 1

    def _offers(self, own: list[int], two: bool) -> int:
        """A bit for each length of one of the pieces, or of two."""
        single = pairs = 0
        for i in own:
            if two:
                pairs |= single << self.lengths[i]
            single |= 1 << self.lengths[i]
        return pairs if two else single

    def _given(self, own: list[int], total: int, two: bool) -> tuple[int, ...]:
        """Which piece, or which two, are of that length."""
        seen: dict[int, int] = {}
        for i in own:
            n = self.lengths[i]
            if not two and n == total:
                return (i,)
            if two and total - n in seen:
                return (seen[total - n], i)
            seen.setdefault(n, i)
        raise AssertionError("no such offer")

    def _exchange(self, b: int, own: list[int], two: bool, most: int) -> tuple[int, tuple[int, ...], int] | None:
        """The room left, what b gives and the piece that it gets, of the exchange that leaves least room in the
        other bin and at most `most`."""
        offers = self._offers(own, two)
        if not offers or not self.place_bits:
            return None
        for left in range(most + 1):
            hits = (offers << left) & self.place_bits
            while hits:
                low = hits & -hits
                place = low.bit_length() - 1
                for j in self.by_place[place]:
                    if place - self.lengths[j] > left:  # the other bin's room shrinks
                        return left, self._given(own, place - left, two), j
                hits ^= low
        return None

    def give(self, b: int) -> bool:
        """Takes steps with the pieces of b until it is empty or no step is left; whether there was one."""
        before = self.steps
        self._take(b)
        lengths = self.lengths
        while self.bins[b]:
            own = sorted(self.bins[b], key=lambda i: -lengths[i])
            moved = False
            for i in own:  # to the fullest bin with room
                fits = self.room_bits >> lengths[i]
                if fits:
                    room = lengths[i] + (fits & -fits).bit_length() - 1
                    k = min(self.by_room[room])
                    if self.fill[k] + lengths[i] > self.fill[b]:
                        self._trade(b, k, (i,), None)
                        moved = True
            if moved:
                continue
            best, most = None, self.room_bits.bit_length() - 2
            for two in (False, True):
                found = self._exchange(b, own, two, most)
                if found:
                    best, most = found, found[0] - 1
                if most < 0:
                    break
            if best is None:
                break
            _, given, back = best
            k = self.home[back]
            if self.fill[k] + sum(lengths[i] for i in given) - lengths[back] <= self.fill[b]:
                break  # only an emptier bin is left: this one is not to give
            self._trade(b, k, given, back)
        self._put(b)
        return self.steps > before

    def run(self) -> list[list[int]]:
        """Bins give in the order of their fill, the emptiest first, again and again until none has a step.

        It also ends when the total allows no fewer bins."""
        least = -(-sum(self.lengths) // self.size)
        alive = sum(map(bool, self.bins))
        while alive > least:
            any_step = False
            for b in sorted((k for k, f in enumerate(self.fill) if 0 < f < self.size), key=lambda k: (self.fill[k], k)):
                if 0 < self.fill[b] < self.size and self.give(b):
                    any_step = True
                    if not self.bins[b]:
                        alive -= 1
                        if alive <= least:
                            break
            if not any_step:
                break
        return [sorted(b) for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> tuple[list[list[int]], int]:
    """The bins when no step is left, and how many steps were taken."""
    search = Search(bins, lengths, size)
    return search.run(), search.steps


def pack(pieces_: DataFrame, seq_len: int = SEQ_LEN, pool: int = POOL) -> DataFrame:
    """pieces_ (doc_id, row_key, piece, start, length, ids_crc32) with sequence_id and offset, and,
    for the piece's pool, its sequences at the start and at the end and the steps between.

    pieces_ is a written table, as row_key must not change between its count and the packing."""
    n = pieces_.count()
    pools = max(1, -(-n // pool))
    dealt = pieces_.withColumn("pool", F.pmod(F.xxhash64("row_key", "piece"), F.lit(pools)))
    columns = pieces_.columns

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("row_key", "ascending"), ("piece", "ascending")])
        lengths = t.column("length").to_pylist()
        start = next_fit(lengths, seq_len)
        n_start = len(start)
        bins, steps = local_search(start, lengths, seq_len)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                seq[i], off[i] = key[0].as_py() * (1 << 32) + k, at
                at += lengths[i]
        of_pool = [pa.array(np.full(len(lengths), x, np.int64)) for x in (n_start, len(bins), steps)]
        out = t.select(columns).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))
        for name, c in zip(("pool_start", "pool_end", "pool_steps"), of_pool):
            out = out.append_column(name, c)
        return out

    return dealt.groupBy("pool").applyInArrow(run, PIECES + ", sequence_id long, offset long, pool_start long, pool_end long, pool_steps long")


def pack_documents(docs: DataFrame, seq_len: int = SEQ_LEN, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, row_key, piece, start, length, ids_crc32, sequence_id, offset,
    pool_start, pool_end, pool_steps.

    Null and empty texts are one piece of one end token; a null doc_id and repeated rows are
    documents as any others; other columns are not looked at; an empty table has no rows."""
    return pack(written(pieces(docs, seq_len, path), "pieces"), seq_len)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key")
