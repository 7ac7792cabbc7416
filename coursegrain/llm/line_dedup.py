"""Line dedup: lines that many documents share stay in one document only.

Lines become (hash, document, position) rows, range-partitioned by hash and document and
sorted by hash, document (largest first) and position. One pass over each sorted partition
streams the rows; of each hash the first document keeps its lines and the others are told to
drop theirs. The range bounds part rows of one hash by document, so a line that a third of
all documents hold is spread over many partitions; the run at either end of a partition may
go on in the next one, so its rows wait for a table with two rows at most for each partition.
The result is a compressed keep bitmap for each document, not its text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, ascii_lower, table, text_or_empty, written

MIN_CHARS = 40
MIN_DOCS = 5

DECISIONS = "kind int, h1 long, h2 long, has_id boolean, doc_id long, text_key long, pos int, n_docs long"
DECIDED, PENDING, TOTAL = 0, 1, 2


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line whose key has min_chars code points at least."""
    text = text_or_empty()
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACE_CHARS)))
    return (
        lines.filter(F.length("line") >= min_chars)
        .select("doc_id", "text_key", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            F.col("doc_id").isNotNull().alias("has_id"),
            F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
            "text_key",
            "pos",
        )
    )


def stream_decisions(min_docs: int):
    """For mapInArrow over a partition of line_rows, sorted by hash and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("has_id", pa.bool_()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("n_docs", pa.int64())])

        def out(kind, rows, n_docs=0):
            n = len(rows[0])
            return pa.record_batch([pa.array(np.full(n, kind, np.int32)), *map(pa.array, rows), pa.array(np.full(n, n_docs, np.int64))], schema=schema)

        held: list[list[np.ndarray]] = []  # rows of the open run while it has too few documents
        run_key = last_doc = None
        first = True  # the open run is the partition's first
        n_docs, top = 0, None

        def close(at_end: bool):
            """Ends the open run."""
            if first or at_end:
                yield out(TOTAL, [np.array([x]) for x in (*run_key, bool(top[0]), int(top[1]), 0)] + [np.array([0], np.int32)], n_docs)
                if held:
                    for rows in held:
                        yield out(PENDING, rows)

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            cols[5] = cols[5].astype(np.int32)
            n = batch.num_rows
            if not n:
                continue
            h1, h2, has, doc = cols[:4]
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [n]])
            changed = np.concatenate([[True], (doc[1:] != doc[:-1]) | (has[1:] != has[:-1])])
            seen = np.cumsum(changed)
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                key = (int(h1[lo]), int(h2[lo]))
                part = None
                if key != run_key:
                    if run_key is not None:
                        yield from close(False)
                        first = False
                    run_key, n_docs, held, last_doc = key, 0, [], None
                    top = (has[lo], doc[lo])
                n_docs += int(seen[hi - 1] - seen[lo]) + ((has[lo], doc[lo]) != last_doc)
                last_doc = (has[hi - 1], doc[hi - 1])
                if hi - lo == 1 and n_docs == 1 and not first and hi < n:
                    continue  # a line of its own
                part = [c[lo:hi] for c in cols]
                if first:
                    yield out(PENDING, part)
                elif n_docs < min_docs:
                    held.append(part)
                else:
                    for rows in [*held, part]:
                        drop = (rows[3] != top[1]) | (rows[2] != top[0])
                        if drop.any():
                            yield out(DECIDED, [r[drop] for r in rows])
                    held = []
        if run_key is not None:
            yield from close(True)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """has_id, doc_id, text_key, pos of each line to drop.

    A task holds the rows of one line only until min_docs documents have it."""
    rows = written(line_rows(docs, min_chars), "line-hashes")  # once: the range bounds are drawn from them, too
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("has_id").desc(), F.col("doc_id").desc()]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text_key", "pos")
    told = written(ranged.mapInArrow(stream_decisions(min_docs), DECISIONS), "line-decisions")
    # Two rows for each partition at most, whatever the input: small enough to broadcast.
    ends = (
        told.filter(F.col("kind") == TOTAL)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("docs"), F.max(F.struct("has_id", "doc_id")).alias("top"))
        .filter(F.col("docs") >= min_docs)
    )
    pending = told.filter(F.col("kind") == PENDING).drop("n_docs", "kind")
    late = pending.join(F.broadcast(ends), ["h1", "h2"]).filter(F.struct("has_id", "doc_id") != F.col("top"))
    columns = ["has_id", "doc_id", "text_key", "pos"]
    return told.filter(F.col("kind") == DECIDED).select(*columns).unionByName(late.select(*columns))


@F.pandas_udf(T.BinaryType())
def keep_bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    """zlib over one bit for each line, 1 for a line that stays; null where all stay."""

    def one(n, gone):
        if gone is None or len(gone) == 0:
            return None
        bits = np.ones(-(-n // 8) * 8, np.uint8)  # what fills the last byte stays
        bits[np.asarray(gone, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(bits).tobytes())

    return pd.Series([one(n, gone) for n, gone in zip(n_lines, dropped)], dtype=object)


def line_keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """has_id, doc_id, text_key, n_dropped and keep_bitmap of each document that loses lines.

    Null texts are empty ones, with one empty line. Rows of one doc_id are one document, as
    are all rows whose doc_id is null (it counts as the smallest); repeated rows share a
    bitmap. Columns other than doc_id and text are not looked at; an empty table has no rows."""
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("has_id", "doc_id", "text_key").agg(F.collect_set("pos").alias("dropped"))
    return gone.select("has_id", "doc_id", "text_key", F.size("dropped").cast("long").alias("n_dropped"), keep_bitmap(F.array_max("dropped") + F.lit(1), "dropped").alias("keep_bitmap"))


@F.pandas_udf(T.StringType())
def kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines that stay, joined by line feeds; lines beyond the bitmap stay."""

    def one(t, bits):
        if bits is None:
            return t
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
        return "\n".join([x for x, k in zip(lines, keep.tolist()) if k] + lines[len(keep) :])

    return pd.Series([one(t, bits) for t, bits in zip(text, bitmap)], dtype=object)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the columns _n_dropped and _keep_bitmap, null where nothing goes."""
    right = bitmaps.select(F.col("has_id").alias("_has_id"), F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), F.col("n_dropped").alias("_n_dropped"), F.col("keep_bitmap").alias("_keep_bitmap"))
    left = docs.withColumns({"_l_has_id": F.col("doc_id").isNotNull(), "_l_doc_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_l_text_key": F.xxhash64(text_or_empty())})
    same = (left["_l_has_id"] == right["_has_id"]) & (left["_l_doc_id"] == right["_doc_id"]) & (left["_l_text_key"] == right["_text_key"])
    return left.join(right, same, "left").select(*[left[f"`{c}`"] for c in docs.columns], "_n_dropped", "_keep_bitmap")


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines gone that bitmaps drop; null texts stay null."""
    joined = with_bitmaps(docs, bitmaps)
    text = F.when(F.col("_keep_bitmap").isNull(), F.col("text")).otherwise(kept_text(text_or_empty(), "_keep_bitmap"))
    return joined.withColumn("text", text).select(*docs.columns)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, bits = b.column(1).to_pylist(), b.column(3).to_pylist()
        lines, digests = [], []
        for t, bit in zip(text, bits):
            lines.append(t.count("\n") + 1)
            if bit is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bit), np.uint8)).tolist()
                own = t.split("\n")
                t = "\n".join([x for x, k in zip(own, keep) if k] + own[len(keep) :])
            digests.append(hashlib.sha256(t.encode()).hexdigest())
        yield pa.record_batch([b.column(0), pa.array(lines, pa.int64()), b.column(2), pa.array(digests, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_bitmaps(docs, line_keep_bitmaps(docs))
    rows = joined.select("doc_id", text_or_empty().alias("text"), F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "_keep_bitmap")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)),
keys AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, keys.k IS NOT NULL AND l.doc_id <> keys.top AS gone
  FROM lines l LEFT JOIN keys ON l.k = keys.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
