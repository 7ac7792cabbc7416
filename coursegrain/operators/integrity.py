"""Orphans, cascades and constraints."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written


class Key(NamedTuple):
    """A column of child that names a row of parent by its key, and what becomes of a child whose parent goes."""

    child: str
    column: str
    parent: str
    key: str
    action: str = "delete"


SET_NULL = "set null"
#: What hangs on a course.
STUDY_KEYS = [
    Key("documents", "course_id", "courses", "course_id"),
    Key("topics", "course_id", "courses", "course_id"),
    Key("topics", "parent_topic_id", "topics", "topic_id", SET_NULL),
    Key("chunks", "document_id", "documents", "document_id"),
    Key("chunks", "course_id", "courses", "course_id"),
    Key("chunks", "topic_id", "topics", "topic_id", SET_NULL),
    Key("vectors", "chunk_id", "chunks", "chunk_id"),
    Key("quizzes", "course_id", "courses", "course_id"),
    Key("questions", "quiz_id", "quizzes", "quiz_id"),
    Key("questions", "topic_id", "topics", "topic_id", SET_NULL),
    Key("attempts", "quiz_id", "quizzes", "quiz_id"),
    Key("answers", "attempt_id", "attempts", "attempt_id"),
    Key("answers", "question_id", "questions", "question_id"),
    Key("cards", "course_id", "courses", "course_id"),
    Key("cards", "topic_id", "topics", "topic_id", SET_NULL),
    Key("reviews", "card_id", "cards", "card_id"),
    Key("mastery", "course_id", "courses", "course_id"),
    Key("mastery", "topic_id", "topics", "topic_id"),
]


def reconcile(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, status: orphan (a vector without its passage), missing, or ok."""
    v, c = vectors.select("chunk_id").distinct().withColumn("v", F.lit(True)), chunks.select("chunk_id").withColumn("c", F.lit(True))
    j = v.join(c, "chunk_id", "full_outer")
    return j.select("chunk_id", F.when(F.col("c").isNull(), "orphan").when(F.col("v").isNull(), "missing").otherwise("ok").alias("status"))


def upload_folders(spark: SparkSession, root: str) -> DataFrame:
    """course_id, files: the folders right under root and how many files are in each, at any depth.

    Spark lists the files and reads nothing of them. Folders without a file aren't seen, as in
    stores where a folder is no more than the beginning of names."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    # Paths are urls: names come back as they are on disk.
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/") + "/"
    plain = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    inner = F.substring(plain, F.instr(plain, F.lit(top)) + len(top), F.length(plain))
    return f.select(F.split(inner, "/").alias("names")).filter(F.size("names") > 1).groupBy(F.col("names")[0].alias("course_id")).agg(F.count(F.lit(1)).alias("files"))


def stray_folders(folders: DataFrame, courses: DataFrame) -> DataFrame:
    """course_id, files, status stray: folders of courses that are no longer there."""
    known = courses.select(F.col("course_id").cast("string").alias("course_id")).filter("course_id is not null").distinct()
    return folders.join(known, "course_id", "left_anti").withColumn("status", F.lit("stray"))


def remove_folders(spark: SparkSession, root: str, folders: DataFrame) -> int:
    """Removes the folders named in course_id from root; how many went. One call for each folder, none for its files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(fs.delete(jvm.org.apache.hadoop.fs.Path(top, r["course_id"]), True) for r in folders.select("course_id").toLocalIterator())


def without_orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def dead_keys(tables: dict[str, DataFrame], keys: list[Key], gone: DataFrame, root: str) -> dict[str, DataFrame]:
    """The keys, by parent table, of all rows that go with those of root named in gone.

    A round follows each key from the rows that went in the round before to the rows that name
    them, until a round finds none: a table may hang on itself, to any depth, or on several
    others, and a row that is reached twice goes once. Only keys are kept, as written tables."""
    used = [k for k in keys if k.child in tables and k.parent in tables]
    own = {k.parent: k.key for k in used} | {root: gone.columns[0]}
    follow = [k for k in used if k.action != SET_NULL and k.child in own]
    dead: dict[str, list[DataFrame]] = {}
    fresh = {root: written(tables[root].join(gone, gone.columns, "left_semi").select(own[root]).distinct(), f"gone-{root}")}
    while fresh:
        for name, d in fresh.items():
            dead.setdefault(name, []).append(d)
        found: dict[str, DataFrame] = {}
        for k in follow:
            if k.parent in fresh:
                lost = fresh[k.parent].select(F.col(k.key).alias(k.column))
                also = tables[k.child].join(lost, k.column, "left_semi").select(own[k.child])
                found[k.child] = also if k.child not in found else found[k.child].unionByName(also)
        fresh = {}
        for name, d in found.items():
            d = d.distinct()
            for known in dead.get(name, []):
                d = d.join(known, own[name], "left_anti")
            d = written(d, f"gone-{name}")
            if not d.isEmpty():
                fresh[name] = d
    return {name: reduce(DataFrame.unionByName, parts) for name, parts in dead.items()}


def cascade_delete(tables: dict[str, DataFrame], keys: list[Key], gone: DataFrame, root: str) -> dict[str, DataFrame]:
    """What is left of tables when the rows of root named in gone go, and what hangs on them.

    gone has one column, the key of root. Rows that name a deleted row go too, or have null there
    from then on ("set null"), whatever the order of keys. Rows whose key is null, or names a
    parent that was never there, stay as they are. Keys of tables that aren't given are left out."""
    dead = dead_keys(tables, keys, gone, root)
    left = dict(tables)
    left[root] = tables[root].join(gone, gone.columns, "left_anti")
    for k in keys:
        if k.child not in tables or k.parent not in dead:
            continue
        lost = dead[k.parent].select(F.col(k.key).alias(k.column))
        if k.action == SET_NULL:
            kept = left[k.child].join(lost.withColumn("_lost", F.lit(True)), k.column, "left")
            left[k.child] = kept.withColumn(k.column, F.when(F.col("_lost").isNull(), F.col(k.column))).select(*tables[k.child].columns)
        else:
            left[k.child] = left[k.child].join(lost, k.column, "left_anti").select(*tables[k.child].columns)
    return left


def discard_derived(questions: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions that cite a changed passage, and the quizzes that have no other."""
    cited = questions.select("question_id", "quiz_id", F.explode("source_chunk_ids").alias("chunk_id"))
    gone = cited.join(changed.select("chunk_id"), "chunk_id", "left_semi").select("question_id", "quiz_id").distinct()
    left = questions.join(gone.select("question_id"), "question_id", "left_anti").select("quiz_id").distinct()
    return gone, gone.select("quiz_id").distinct().join(left, "quiz_id", "left_anti")


def audit(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """rule, rows, violations: rows for which a rule doesn't hold (unknown counts as that)."""
    rows = [d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("violations")).withColumn("rule", F.lit(name)) for name, d, ok in checks]
    return reduce(DataFrame.unionByName, rows).select("rule", "rows", "violations")
