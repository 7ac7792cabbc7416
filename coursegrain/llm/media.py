"""Media columns: baseline JPEG in numpy.

Payload bytes are kept as quantised DCT coefficients, which baseline JPEG stores without loss:
64 bytes are one 8x8 block, each byte less 128. Files have one grey component, one scan and a
restart marker after every nine blocks (576 bytes). The reader parses the markers of any
baseline JPEG, Huffman-decodes all restart intervals of a batch side by side (one lane each),
and makes a luminance thumbnail of the DC coefficients alone, one pixel for a block."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

UNIT = 576
INTERVAL = UNIT // 64
MOST_ROWS = 8191
CHUNK_BYTES = 1 << 20
#: Bytes that are coded at a time; a whole number of restart intervals.
SLICE_BYTES = UNIT * 2048

# The encoder's code lengths by rule: letters (0,5) first, then the sizes of spaces, capitals and
# the rest of ASCII; all other (run, size) symbols have 12 bits. A count for each of 16 lengths.
_AC_FIRST = [0x05, 0x04, 0x07, 0x06, 0x03, 0x02, 0x01]
_AC_SYMBOLS = _AC_FIRST + [s for s in [0x00, 0xF0, *(r << 4 | z for r in range(16) for z in range(1, 11))] if s not in _AC_FIRST]
_AC_COUNTS = [1, 0, 2, 1, 1, 2, 0, 0, 0, 0, 0, len(_AC_SYMBOLS) - 7, 0, 0, 0, 0]
_DC_SYMBOLS = list(range(12))
_DC_COUNTS = [0, 0, 0, 12] + [0] * 12


def code_book(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """code and length of each symbol, by the standard's rule."""
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    code = at = 0
    for n, k in enumerate(counts, 1):
        for _ in range(k):
            codes[symbols[at]], lengths[symbols[at]] = code, n
            code += 1
            at += 1
        code <<= 1
    return codes, lengths


@lru_cache(maxsize=64)
def look_up(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """length and symbol by the next 16 bits; length 0 where no code begins so."""
    lengths, out = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    codes, sizes = code_book(counts, symbols)
    for s in symbols:
        n = int(sizes[s])
        lo = int(codes[s]) << (16 - n)
        lengths[lo : lo + (1 << (16 - n))] = n
        out[lo : lo + (1 << (16 - n))] = s
    return lengths, out


_AC, _DC = code_book(_AC_COUNTS, _AC_SYMBOLS), code_book(_DC_COUNTS, _DC_SYMBOLS)
#: Size category of a coefficient by its absolute value.
_SIZE = np.array([int(v).bit_length() for v in range(2048)], np.int64)


def shape_of(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks: three columns, or more where the rows would be too many."""
    if n_blocks // 3 <= MOST_ROWS:
        return 3, n_blocks // 3
    wide = INTERVAL * -(-n_blocks // (INTERVAL * MOST_ROWS))
    return wide, -(-n_blocks // wide)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(columns: int, rows: int, n_payload: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + _segment(0xFE, b"payload %d" % n_payload)
        + _segment(0xDB, b"\0" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", INTERVAL))
        + _segment(0xDA, b"\x01\x01\x00\0\x3f\0")
    )


def _entropy(blocks: np.ndarray) -> list[bytes]:
    """The coded bytes of each restart interval of blocks (n, 64), before stuffing."""
    n = len(blocks)
    value = blocks.astype(np.int64)
    dc = value[:, 0].reshape(-1, INTERVAL)
    value[:, 0] = np.diff(dc, axis=1, prepend=0).ravel()
    size = _SIZE[np.abs(value)]
    bits = np.where(value < 0, value + (np.int64(1) << size) - 1, value).astype(np.uint64)
    symbol = size.copy()
    zero = value[:, 1:] == 0
    odd = zero.any()
    run = np.zeros((n, 64), np.int64)
    if odd:  # zeros among the AC coefficients: runs, and an end mark where zeros are last
        place = np.where(zero, 0, np.arange(1, 64))
        before = np.concatenate([np.zeros((n, 1), np.int64), np.maximum.accumulate(place, axis=1)[:, :-1]], axis=1)
        run[:, 1:] = np.where(zero, 0, np.arange(1, 64) - before - 1)
        symbol[:, 1:] |= (run[:, 1:] & 15) << 4
    code, length = _AC[0][symbol], _AC[1][symbol]
    code[:, 0], length[:, 0] = _DC[0][size[:, 0]], _DC[1][size[:, 0]]
    code = (code << size.astype(np.uint64)) | bits
    length = length + size
    if odd:
        length[:, 1:][zero] = 0
        code[:, 1:][zero] = 0
        ends = zero[:, -1]
        code = np.concatenate([code, np.where(ends, _AC[0][0], 0).astype(np.uint64)[:, None]], axis=1)
        length = np.concatenate([length, np.where(ends, _AC[1][0], 0)[:, None]], axis=1)
        wide = code.shape[1]
        code, length = code.ravel(), length.ravel()
        far = np.argwhere(run > 15)
        if len(far):
            times = run[far[:, 0], far[:, 1]] >> 4
            at = np.repeat(far[:, 0] * wide + far[:, 1], times)
            per = np.bincount(at // (wide * INTERVAL), minlength=n // INTERVAL)
            code, length = np.insert(code, at, _AC[0][0xF0]), np.insert(length, at, _AC[1][0xF0])
        else:
            per = 0
        edge = np.concatenate([[0], np.cumsum(wide * INTERVAL + per + np.zeros(n // INTERVAL, np.int64))])
    else:
        code, length = code.ravel(), length.ravel()
        edge = np.arange(0, n * 64 + 1, 64 * INTERVAL)
    upto = np.concatenate([[0], np.cumsum(length)])
    total = np.diff(upto[edge])
    n_bytes = (total + 7) >> 3
    first = np.concatenate([[0], np.cumsum(n_bytes)])
    shift = np.repeat(first[:-1] * 8 - upto[edge[:-1]], np.diff(edge))
    at = upto[:-1] + shift
    # Items that begin in one byte are added up in a window of five bytes; no bits overlap.
    window = code << (40 - length - (at & 7)).astype(np.uint64)
    byte = at >> 3
    starts = np.flatnonzero(np.diff(byte, prepend=-1))
    summed = np.add.reduceat(window, starts)
    byte = byte[starts]
    out = np.zeros(int(first[-1]) + 5, np.uint8)
    for k in range(5):
        out[byte + k] += ((summed >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    free = n_bytes * 8 - total
    out[first[1:] - 1] |= ((1 << free) - 1).astype(np.uint8)
    raw = out.tobytes()
    edges = first.tolist()
    return [raw[lo:hi] for lo, hi in zip(edges, edges[1:])]


def padded(data: bytes) -> bytes:
    """data and bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; lengths are positive multiples of UNIT."""
    shapes = [shape_of(len(p) // 64) for p in payloads]
    joined = b"".join(p + b"\x80" * (c * r * 64 - len(p)) for p, (c, r) in zip(payloads, shapes))
    coded: list[bytes] = []
    for lo in range(0, len(joined), SLICE_BYTES):  # intervals don't depend on each other
        blocks = np.frombuffer(joined, np.uint8, min(SLICE_BYTES, len(joined) - lo), lo).astype(np.int16) - 128
        coded += _entropy(blocks.reshape(-1, 64))
    out, at = [], 0
    for p, (c, r) in zip(payloads, shapes):
        own = coded[at : at + c * r // INTERVAL]
        at += len(own)
        parts = [_head(c, r, len(p))]
        for i, x in enumerate(own):
            parts.append(x.replace(b"\xff", b"\xff\0"))
            if i + 1 < len(own):
                parts.append(bytes((0xFF, 0xD0 + i % 8)))
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class Parsed:
    """The markers of one file."""

    def __init__(self, data: bytes):
        self.quant, self.tables, self.restart, self.comment = {}, {}, 0, b""
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide == 128 else tuple(body[1:65])
                    body = body[1 + wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("samples of 8 bits only")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xFE:
                self.comment = bytes(body)
            elif marker == 0xDA:
                chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                if len(chosen) != len(self.parts):
                    raise ValueError("one scan with all components only")
                break
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("baseline JPEG only")
        if len(self.parts) == 1:  # one component: its blocks follow each other whatever the sampling
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        self.most = max(h for _, h, _, _ in self.parts), max(v for _, _, v, _ in self.parts)
        self.mcu_columns = -(-self.width // (8 * self.most[0]))
        self.mcu_rows = -(-self.height // (8 * self.most[1]))
        #: Component and its two tables for each block of an MCU.
        self.schedule = tuple((i, self.tables[chosen[p[0]] >> 4], self.tables[0x10 | chosen[p[0]] & 15]) for i, p in enumerate(self.parts) for _ in range(p[1] * p[2]))
        raw = np.frombuffer(data, np.uint8)[at:]
        mark = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
        end = int(next((m for m in mark.tolist() if not 0xD0 <= raw[m + 1] <= 0xD7), len(raw)))
        cuts = [int(m) for m in mark if m < end]
        scan = data[at : at + end]
        self.intervals = [scan[lo:hi].replace(b"\xff\0", b"\xff") for lo, hi in zip([0, *(c + 2 for c in cuts)], [*cuts, end])]
        n = self.mcu_columns * self.mcu_rows
        step = self.restart or n
        self.interval_mcus = [min(step, n - i) for i in range(0, n, step)]
        if len(self.interval_mcus) != len(self.intervals):
            raise ValueError("a scan has too few or too many restart markers")


def _lanes(schedule, intervals: list[bytes], mcus: np.ndarray) -> np.ndarray:
    """Coefficients in zigzag order (lane, block, 64) of restart intervals side by side."""
    size = np.array([len(x) for x in intervals], np.int64)
    joined = b"".join(intervals) + b"\xff" * 16
    words = np.ndarray((len(joined) - 8,), ">u8", joined, strides=(1,))
    start = np.concatenate([[0], np.cumsum(size)])[:-1] * 8
    stop = start + size * 8
    pos = start.copy()
    n = len(intervals)
    per_mcu = len(schedule)
    out = np.zeros((n, int(mcus.max()) * per_mcu, 64), np.int16)
    dc = np.zeros((n, max(s[0] for s in schedule) + 1), np.int64)
    one = np.uint64(1)

    def read(p, table):
        """Symbols at p, the bits after them as coefficients of their low four bits, and the end."""
        w = words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        head = (w >> np.uint64(48)).astype(np.int64)
        length, symbol = table[0][head], table[1][head]
        if not length.all():
            raise ValueError("bits that are no code")
        z = (symbol & 15).astype(np.uint64)
        v = ((w << length.astype(np.uint64)) >> one >> (np.uint64(63) - z)).astype(np.int64)
        low = (one << z).astype(np.int64)
        v = np.where(2 * v < low, v - low + 1, v)
        return symbol, v, p + length + (symbol & 15)

    for b in range(out.shape[1]):
        lanes = np.flatnonzero(b < mcus * per_mcu)
        part, dc_table, ac_table = schedule[b % per_mcu]
        dc_table, ac_table = look_up(*dc_table), look_up(*ac_table)
        _, v, p = read(pos[lanes], dc_table)
        dc[lanes, part] += v
        out[lanes, b, 0] = dc[lanes, part]
        k = np.ones(len(lanes), np.int64)
        while True:
            live = np.flatnonzero(k < 64)
            if not len(live):
                break
            whole = len(live) == len(k)
            symbol, v, q = read(p if whole else p[live], ac_table)
            step = (symbol >> 4).astype(np.int64)
            none = (symbol & 15) == 0
            kk = (k if whole else k[live]) + step
            if none.any():
                kk = np.where(none & (step < 15), 64, kk)
                put = np.flatnonzero(~none)
                out[lanes[live[put]], b, kk[put]] = v[put]
            else:
                out[lanes if whole else lanes[live], b, kk] = v
            if whole:
                p, k = q, kk + 1
            else:
                p[live], k[live] = q, kk + 1
        pos[lanes] = p
    if (pos > stop).any() or (stop - pos > 7).any():
        raise ValueError("an interval has too few or too many bits")
    return out


def decode(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Each file's markers and the coefficients of its blocks (n, 64) in scan order."""
    parsed = [Parsed(f) for f in files]
    alike = defaultdict(list)
    for i, p in enumerate(parsed):
        alike[p.schedule].append(i)
    out: list = [None] * len(files)
    for schedule, members in alike.items():
        blocks: dict[int, list[np.ndarray]] = {i: [] for i in members}
        owner = [i for i in members for _ in parsed[i].intervals]
        intervals = [x for i in members for x in parsed[i].intervals]
        mcus = np.concatenate([parsed[i].interval_mcus for i in members])
        for lo, hi in _pieces([64 * len(schedule) * int(m) for m in mcus], SLICE_BYTES):
            got = _lanes(schedule, intervals[lo:hi], mcus[lo:hi])
            for i, x, m in zip(owner[lo:hi], got, mcus[lo:hi].tolist()):
                blocks[i].append(x[: m * len(schedule)])
        for i in members:
            out[i] = (parsed[i], np.concatenate(blocks[i]))
    return out


def thumbnail(p: Parsed, blocks: np.ndarray) -> np.ndarray:
    """Luminance by DC coefficients alone: a pixel for each block of the first component."""
    _, h, v, q = p.parts[0]
    dc = blocks[:, 0].astype(np.int64).reshape(p.mcu_rows, p.mcu_columns, len(p.schedule))[:, :, : h * v]
    grid = dc.reshape(p.mcu_rows, p.mcu_columns, v, h).transpose(0, 2, 1, 3).reshape(p.mcu_rows * v, p.mcu_columns * h)
    pixels = np.clip((grid * p.quant[q][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return pixels[: -(-p.height * v // (8 * p.most[1])), : -(-p.width * h // (8 * p.most[0]))]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8x9 cells of the thumbnail is darker than the next one."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    cells = pixels[np.ix_(rows, columns)].astype(np.int16)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def feature(p: Parsed, blocks: np.ndarray) -> str:
    """Width and height, those of the thumbnail, its difference hash and its crc32."""
    t = thumbnail(p, blocks)
    return f"{p.width}x{p.height} {t.shape[1]}x{t.shape[0]} {difference_hash(t)} {zlib.crc32(np.ascontiguousarray(t)):08x}"


def _pieces(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with most bytes or one row each."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def with_media(docs: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """key, n_bytes and media, a JPEG file that keeps the bytes in column data (null: none).

    One row for each row of docs, repeated or not; a null key stays null. Bytes of any length
    are coded in slices of SLICE_BYTES. Other columns are not looked at, whatever their names;
    an empty table has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            for lo, hi in _pieces([len(x) for x in raw]):
                files = encode([padded(x) for x in raw[lo:hi]])
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in raw[lo:hi]], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    return rows.mapInArrow(run, f"{key} long, n_bytes long, media binary")


def stored_media(docs: DataFrame, key: str = "doc_id", data: str = "data") -> DataFrame:
    """with_media(docs) in a table of the shared folder, read back."""
    return written(with_media(docs, key, data), "media", "zstd")


def media_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored files hold: the payload's digests, sizes and the thumbnail's feature.

    Equal files have equal values; an empty table has no rows."""
    kinds = f"{key} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(2).to_pylist()
            for lo, hi in _pieces([len(x) for x in files]):
                cols: list[list] = [[] for _ in range(6)]
                for f, (p, blocks) in zip(files[lo:hi], decode(files[lo:hi])):
                    payload = (blocks + 128).astype(np.uint8).tobytes()[: int(p.comment.split()[1])]
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(p, blocks))
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types))], names=[x.split()[0] for x in kinds.split(", ")])

    return media.select(key, "n_bytes", "media").mapInArrow(run, kinds)


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are stored in a table of their own, and the features come from what is read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().cast("binary").alias("data"))
    return media_features(stored_media(docs))
