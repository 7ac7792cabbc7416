"""Quality measures: retrieval, citations, groundedness, runs, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..functions.rows import once
from ..functions.text import word_list
from .ranks import quantiles


def retrieval_eval(expected: DataFrame, hits: DataFrame, k: int = DEFAULTS.top_k) -> DataFrame:
    """One row: queries, hits, recall, mrr; a miss adds 0 to both."""
    best = hits.filter(F.col("rank") <= k).join(expected, "query_id").filter(F.col("chunk_id") == F.col("expected_id")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    d = expected.select("query_id").distinct().join(best, "query_id", "left")
    return d.agg(F.count(F.lit(1)).alias("queries"), F.count("rank").alias("hits"), F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def golden_pairs(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, query, expected_id of golden (query_id, query, source_section).

    The passage of a section is the last one by chunk_id that has its path; pairs whose section
    isn't there any more are left out."""
    last = chunks.groupBy(F.col("section_path").alias("source_section")).agg(F.max("chunk_id").alias("expected_id"))
    return golden.join(last, "source_section").select("query_id", "query", "expected_id")


def citation_integrity(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: questions, cited, resolvable, in_range.

    Cited: there are passages and pages; resolvable: every cited passage is there; in range: the
    pages are within the first passage's, and from 1 to the document's page_count, a column of
    chunks (null: not known, and so not in range)."""
    first = F.get("source_chunk_ids", F.lit(0))
    q = questions.select("question_id", "page_refs", "source_chunk_ids", first.alias("first_id"), (F.size("source_chunk_ids") > 0).alias("some"))
    named = q.select("question_id", F.explode("source_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", F.lit(True).alias("found")), "chunk_id", "left")
    found = named.groupBy("question_id").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("resolvable"))
    p = chunks.select(F.col("chunk_id").alias("first_id"), "page_start", "page_end", "page_count")
    q = q.join(found, "question_id", "left").join(p, "first_id", "left")
    low, high = F.array_min("page_refs"), F.array_max("page_refs")
    inside = (low >= F.greatest("page_start", F.lit(1))) & (high <= F.col("page_end")) & (high <= F.col("page_count"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return q.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(yes(F.col("some") & (F.size("page_refs") > 0))).alias("cited"),
        F.count_if(yes(F.col("resolvable"))).alias("resolvable"), F.count_if(yes(F.col("some") & inside & F.col("page_count").isNotNull())).alias("in_range"),
    )


def groundedness(rows: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """question_id, overlap, grounded: the share of the explanation's long words in the passage."""
    e, p = word_list(F.col("explanation"), t.evidence_word_length), word_list(F.col("passage"), t.evidence_word_length)
    d = once(rows, ["question_id"], e=e, p=p).filter(F.size("e") > 0)
    d = d.withColumn("overlap", F.size(F.array_intersect("e", "p")) / F.size("e"))
    return d.select("question_id", F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= t.grounded_overlap).alias("grounded"))


def compare_runs(log: DataFrame) -> DataFrame:
    """label, questions, first_attempt, failures, p50, p95 from log (label, code, attempt, ms).

    p95 is the value sorted[min(n - 1, floor(0.95 n))]. Both are exact, and no task sorts or
    holds a run. A run without any ms has nulls there; a null label is a run."""
    spots = quantiles(log, ["label"], F.col("ms"), {"p50": 0.5, "p95": ("floor", 0.95)})
    spots = spots.select(F.col("label").alias("of"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    d = log.groupBy("label").agg(F.count(F.lit(1)).alias("questions"), F.count_if((F.col("code") == "") & (F.col("attempt") == 1)).alias("first_attempt"), F.count_if(F.col("code") != "").alias("failures"))
    return d.join(spots, d["label"].eqNullSafe(spots["of"]), "left").drop("of")


def failure_histogram(failures: DataFrame, by: str) -> DataFrame:
    """by, code, failures: how often each code is there, of rows (by, codes), codes an array."""
    return failures.select(by, F.explode("codes").alias("code")).filter("code <> ''").groupBy(by, "code").agg(F.count(F.lit(1)).alias("failures"))


def failure_totals(runs: DataFrame) -> DataFrame:
    """course_id, code, failures: sums of the runs' maps failure_codes (code to count)."""
    return runs.select("course_id", F.explode("failure_codes").alias("code", "n")).groupBy("course_id", "code").agg(F.sum("n").cast("long").alias("failures"))


def generation_quality(runs: DataFrame) -> DataFrame:
    """course_id, quizzes, questions, pass_rate weighted by questions, latency p50, p95 and most.

    runs has course_id, question_count, pass_rate, ms and attempts. Quantiles are exact, and no
    task sorts or holds a course; a course without attempts has nulls there."""
    each = F.col("ms") / F.nullif(F.col("attempts"), F.lit(0))
    spots = quantiles(runs, ["course_id"], each, {"latency_p50": 0.5, "latency_p95": 0.95})
    spots = spots.select(F.col("course_id").alias("of"), *[F.round(c, 6).alias(c) for c in ("latency_p50", "latency_p95")])
    d = runs.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("quizzes"), F.sum("question_count").alias("questions"),
        F.round(F.sum(F.col("pass_rate") * F.col("question_count")) / F.sum("question_count"), 6).alias("pass_rate"), F.round(F.max(each), 6).alias("latency_max"),
    )
    return d.join(spots, d["course_id"].eqNullSafe(spots["of"]), "left").drop("of")


def gate(metrics: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """metric, value, bar, passed: each one-row frame has the metric as its column of that name."""
    rows = [d.select(F.lit(name).alias("metric"), F.round(F.col(name), 6).alias("value"), F.lit(float(bar)).alias("bar")) for d, name, bar in metrics]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("value") >= F.col("bar"))
