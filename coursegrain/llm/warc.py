"""WARC archives with revisit records and a two-level capture index.

Pages become WARC/1.1 records in gzip members, one record each, packed into archive blobs in
the order of their reversed-host URL keys. The capture index is one table over all archives:
a line for each record (key, id, archive, offset, length), sorted by key and id, BLOCK_LINES
to a compressed block, in parts with key ranges of their own. A sparse directory has the first
key of each block.

A capture is found in three steps: its part by a binary search in the parts' first keys (a row
for each part), its block by one in the part's directory, its line by one in the block. Then
its record is read from the archive by its range.

Archives and blocks are rows of Parquet tables in the shared folder: Spark's committer writes
them, so a lost executor leaves no half-written one. An archive holds ARCHIVE_BYTES at most or
one record."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import table, written

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 1000
WARC_DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = "archive long, data binary"
LINES = "key string, page_id long, archive long, offset int, length int"
BLOCKS = "part int, block int, key string, page_id long, n_lines int, data binary"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, stored_bytes long"
#: Sorts before any page_id; a null page_id comes before all others, as in Spark.
_FIRST, _NULL = -(1 << 63) - 2, -(1 << 63) - 1


def url_key(url):
    """Host with its parts reversed, then the rest: http://www.a.org/x to org,a,www)/x."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    name, port = F.regexp_extract(host, r"^([^:]*)", 1), F.regexp_extract(host, r"(:.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """url_key, page_id, payload_digest, refers_to of each page that is no response.

    Payloads are only digested here, so that no shuffle carries them. The largest page_id of
    each payload is found by an aggregation that combines before its shuffle, and a payload
    that many pages have is spread over tasks where it meets them."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.filter(F.octet_length("html") >= min_bytes).select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("payload_digest"))
    p = written(p, "page-digests")
    groups = p.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    groups = written(groups, "payload-groups")
    j = salted_join(p, groups.drop("k"), ["payload_digest"], ["page_id", "url_key"], counts=groups.select("payload_digest", "k"))
    return j.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("url_key", "page_id", "payload_digest", "refers_to").distinct()


def _header(fields: list[tuple[str, object]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value: no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url, payload, kind, refers_to, digest) -> bytes:
    """One gzip member with one record."""
    n_bytes = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", WARC_DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    fields.append(("X-Payload-Length", n_bytes))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    body = http + (b"" if kind == "revisit" else payload)
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(_header(fields, body)) + pack.flush()


def read_record(data: bytes) -> dict:
    """Headers of a record, and its payload as "payload"."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    out = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(out["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    out["payload"] = body.partition(b"\r\n\r\n")[2]
    return out


def _archives(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An archive and the lines of its records, from rows sorted by url_key and page_id, what a
        page revisits before the page itself."""
        number = TaskContext.get().partitionId() << 33
        parts: list[bytes] = []
        lines: list[dict] = []
        size, place, known = 0, None, {}
        kind_of = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())]))

        def archive():
            return pa.record_batch([pa.array([number]), pa.array([b"".join(parts)], pa.binary()), pa.array([lines], kind_of)], names=["archive", "data", "lines"])

        for b in batches:
            for key, page_id, url, html, digest, refers_to, is_page in zip(*(c.to_pylist() for c in b.columns)):
                if (key, page_id) != place:
                    place, known = (key, page_id), {}
                if not is_page:
                    known[digest] = refers_to
                    continue
                body = (html or "").encode()
                digest = hashlib.sha1(body).hexdigest()
                kind = "revisit" if digest in known else "response"
                r = record_bytes(page_id, url, body, kind, known.get(digest), digest)
                if parts and size + len(r) > archive_bytes:
                    yield archive()
                    number, parts, lines, size = number + 1, [], [], 0
                lines.append({"key": key, "page_id": page_id, "offset": size, "length": len(r)})
                parts.append(r)
                size += len(r)
        if parts:
            yield archive()

    return run


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives' table: archive, data, and lines (key, page_id, offset, length) of its records.

    Payloads are shuffled once, with the few columns of revisits sorted in between. Null urls
    have the key ")/" and no target header; null html is an empty payload; rows of one page_id
    are records of their own (with equal payloads, those of the largest page_id are all
    responses); a null page_id is the smallest. A page of any size is one record. Other columns
    are not looked at; an empty table has no archive."""
    none = F.lit(None)
    later = written(revisits(pages, min_bytes), "revisits").select("url_key", "page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "payload_digest", "refers_to", F.lit(False).alias("is_page"))
    own = pages.select(url_key(F.col("url")).alias("url_key"), F.col("page_id").cast("long").alias("page_id"), "url", "html", none.cast("string").alias("payload_digest"), none.cast("long").alias("refers_to"), F.lit(True).alias("is_page"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.unionByName(later).repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "is_page")
    return written(ranged.mapInArrow(_archives(archive_bytes), ARCHIVES + ", lines array<struct<key:string,page_id:long,offset:int,length:int>>"), "warc")


def _order(page_id: int | None) -> int:
    return _NULL if page_id is None else page_id


def pack_lines(lines: list[tuple]) -> bytes:
    """Sorted lines (key, page_id, archive, offset, length), compressed; line ends and tabs in keys are escaped."""
    escape = {"%": "%25", "\t": "%09", "\n": "%0A"}
    return zlib.compress("\n".join("\t".join([key.translate(str.maketrans(escape)), *map(str, rest)]) for key, *rest in lines).encode())


def unpack_lines(block: bytes) -> list[tuple]:
    """The lines of a block, with keys as bytes."""
    out = []
    for x in zlib.decompress(block).decode().split("\n"):
        key, page_id, *rest = x.split("\t")
        key = key.replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")
        out.append((key.encode(), None if page_id == "None" else int(page_id), *map(int, rest)))
    return out


def _blocks(block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, []

        def out():
            cols = ([part], [block], [held[0][0]], [held[0][1]], [len(held)], [pack_lines(held)])
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["part", "block", "key", "page_id", "n_lines", "data"])

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns)):
                held.append(line)
                if len(held) == block_lines:
                    yield out()
                    block, held = block + 1, []
        if held:
            yield out()

    return run


def capture_index(archives: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The index over all archives: part, block, key and page_id of its first line, n_lines, data.

    part, block, key and page_id are the directory: column pruning reads them without the blocks."""
    lines = archives.select("archive", F.inline("lines")).select("key", "page_id", "archive", "offset", "length")
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "archive", "offset"]
    return written(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(block_lines), BLOCKS), "capture-index")


def _span(firsts: list[tuple[bytes, int]], key: bytes, page_id, exact: bool) -> range:
    """Places in sorted first lines where lines of a key, or of a key and a page_id, may be: by two binary searches."""
    low = (key, _order(page_id)) if exact else (key, _FIRST)
    high = (key, _order(page_id)) if exact else (key, 1 << 64)
    return range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high))


def find_lines(lines: list[tuple], key: bytes, page_id=None, exact: bool = False) -> list[tuple]:
    """The lines of a block that have the key (and the page_id), by binary search."""
    at = bisect_left(lines, ((key, _order(page_id)) if exact else (key, _FIRST)), key=lambda x: (x[0], _order(x[1])))
    out = []
    while at < len(lines) and lines[at][0] == key and (not exact or lines[at][1] == page_id):
        out.append(lines[at])
        at += 1
    return out


def captures(wanted: DataFrame, index: DataFrame, exact: bool = False) -> DataFrame:
    """key, page_id, archive, offset, length of each capture of the keys in wanted (key), or of
    the keys and page_ids in wanted (key, page_id) if exact.

    Keys are looked for once each. They meet their part in one shuffle of keys and compressed
    blocks: a part's blocks, with the directory, come first in its task, then the keys, sorted,
    so that the block that one key has opened serves the next ones."""
    # A row for each part: the first line of its first block.
    bounds = [(r["part"], (r["first"]["key"].encode(), _order(r["first"]["page_id"]))) for r in index.groupBy("part").agg(F.min(F.struct("key", "page_id")).alias("first")).collect()]
    bounds.sort(key=lambda x: x[1])
    parts, firsts = [p for p, _ in bounds], [f for _, f in bounds]
    none = F.lit(None)
    wanted = wanted.select("key", (F.col("page_id") if exact else none.cast("long")).alias("page_id")).distinct()

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (key, page_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                for k in _span(firsts, key.encode(), page_id, exact):
                    at.append(i)
                    out.append(parts[k])
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.record_batch([pa.array(out, pa.int32()), rows.column(0), rows.column(1)], names=["part", "key", "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, blocks, open_part, open_block, lines = [], [], None, None, []
        for b in batches:
            out = []
            for part, block, key, page_id, data in zip(*(c.to_pylist() for c in b.columns)):
                if part != open_part:
                    directory, blocks, open_part, open_block = [], [], part, None
                if block is not None:
                    directory.append((key.encode(), _order(page_id)))
                    blocks.append(data)
                    continue
                for k in _span(directory, key.encode(), page_id, exact):
                    if k != open_block:
                        open_block, lines = k, unpack_lines(blocks[k])
                    out += find_lines(lines, key.encode(), page_id, exact)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([x[i].decode() if i == 0 else x[i] for x in out], t) for i, t in enumerate(kinds)], names=["key", "page_id", "archive", "offset", "length"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = wanted.mapInArrow(to_parts, "part int, key string, page_id long").select("part", none.cast("int").alias("block"), "key", "page_id", none.cast("binary").alias("data"))
    rows = index.select("part", "block", "key", "page_id", "data").unionByName(rows)
    return rows.repartition(n, "part").sortWithinPartitions("part", F.col("block").asc_nulls_last(), "key", "page_id").mapInArrow(search, LINES)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the records of archives (data, ranges) where the index says they are."""
    number = lambda x: None if x == "None" else int(x)
    for b in batches:
        for data, ranges in zip(b.column(0), b.column(1).to_pylist()):
            view = memoryview(data.as_buffer())
            rows = []
            for offset, length in sorted((x["offset"], x["length"]) for x in ranges):
                r = read_record(view[offset : offset + length])
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = r["WARC-Type"]
                if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError("a payload doesn't have its digest")
                page, refers = (r.get(k, "<urn:page:None>")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((number(page), r.get("WARC-Target-URI"), kind, number(refers), digest, int(r["X-Payload-Length"]), len(r["payload"])))
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "stored_bytes"]
            yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)


def read_captures(found: DataFrame, archives: DataFrame) -> DataFrame:
    """One row for each capture of found (archive, offset, length), as the record's headers and payload have it.

    An archive gets the ranges that are wanted from it, no more than it has records, in a hash
    join that they are the small side of."""
    ranges = found.groupBy("archive").agg(F.collect_set(F.struct("offset", "length")).alias("ranges"))
    return archives.select("archive", "data").join(ranges.hint("shuffle_hash"), "archive").select("data", "ranges").mapInArrow(_ranges, RECORDS)


def lookup(urls: DataFrame, index: DataFrame, archives: DataFrame) -> DataFrame:
    """The records of all captures of each row of urls (url), as read_captures has them.

    A url that is there twice is looked for once; null is the key of pages without one."""
    return read_captures(captures(urls.select(url_key(F.col("url")).alias("key")), index), archives)


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is found by its key in the index, and its record read by its range."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = write_archives(pages)
    wanted = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    found = captures(wanted, capture_index(archives), exact=True)
    return read_captures(found, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
