"""Corpus discovery, idempotent ingest, and the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables

ERROR_CHARS = 2000
GOLDEN_SCHEMA = "id int, query string, source_section array<string>"


def discover(spark: SparkSession, target: str, suffixes: tuple[str, ...] = (".pdf", ".pptx")) -> DataFrame:
    """path, length, modificationTime, content, sha256 of the files under target, with one of the
    suffixes in any case; lock files that begin with ~$ are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s.lower())
    return f.filter(wanted & ~F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).startswith("~$")).withColumn("sha256", F.sha2("content", 256))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a query and the section that answers it, from JSON lines."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path)


def run_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """A text log cut by the groups of a pattern; lines that don't match are left out."""
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def ingest_plan(incoming: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """document_id, course_id, sha, action of each incoming document.

    skipped: its course has the content as complete; replaced: as something else, or force;
    duplicate: an earlier row of the batch has it; new: none of these."""
    first = F.row_number().over(Window.partitionBy("course_id", "sha").orderBy("document_id"))
    known = registry.groupBy("course_id", "sha").agg(F.bool_or(F.col("status") == "complete").alias("complete"))
    d = incoming.withColumn("nth", first).join(known, ["course_id", "sha"], "left")
    complete = F.coalesce("complete", F.lit(False)) & F.lit(not force)
    action = F.when(complete, "skipped").when(F.col("nth") > 1, "duplicate").when(F.col("complete").isNotNull(), "replaced").otherwise("new")
    return d.select("document_id", "course_id", "sha", action.alias("action"))


def ingest_status(documents: DataFrame, chunk_counts: DataFrame, error: Column) -> DataFrame:
    """document_id, chunks, status, reason: a document without a passage has failed."""
    d = documents.join(chunk_counts, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    failed = F.col("chunks") == 0
    return d.select("document_id", "chunks", F.when(failed, "failed").otherwise("complete").alias("status"), F.when(failed, F.left(error, F.lit(ERROR_CHARS))).alias("reason"))


def low_text(pages: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """document_id, chars_per_page of documents with too little text to be more than scans."""
    d = pages.groupBy("document_id").agg((F.sum(F.length("text")) / F.count(F.lit(1))).alias("chars_per_page"))
    return d.filter(F.col("chars_per_page") < t.scanned_chars_per_page)


def upsert_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing without the documents of incoming, and incoming."""
    return existing.join(incoming.select("document_id").distinct(), "document_id", "left_anti").select(*existing.columns).unionByName(incoming)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Rewrites only the courses that vectors has rows of; a course is a partition."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("course_id").parquet(path)


def vector_contract(vectors: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, chunks, wrong_dim, ok."""
    v = vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size("embedding") != dim).alias("wrong_dim"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return v.join(F.broadcast(c)).withColumn("ok", (F.col("vectors") == F.col("chunks")) & (F.col("wrong_dim") == 0))


def vector_payload(chunks: DataFrame) -> DataFrame:
    level = F.greatest(F.lit(0), F.size("section_path") - 1)
    return chunks.select("chunk_id", "document_id", "course_id", "topic_id", "page_start", "page_end", "section_path", level.alias("heading_level"), "token_count")
