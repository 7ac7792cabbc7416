"""Topics from section paths, and clustering where headings don't help."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..functions.text import stripped
from .clusters import cluster_topics


def section_counts(chunks: DataFrame) -> DataFrame:
    """course_id, section_path, chunk_count of the paths that are not empty."""
    return chunks.filter(F.size("section_path") > 0).groupBy("course_id", "section_path").agg(F.count(F.lit(1)).alias("chunk_count"))


def topic_strategy(chunks: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """course_id, paths, singletons, strategy: cluster, unit (headings too fine) or heading."""
    s = section_counts(chunks).groupBy("course_id").agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("chunk_count") == 1).alias("singletons"))
    fine = F.col("singletons") / F.col("paths") >= t.singleton_collapse
    return s.withColumn("strategy", F.when(F.col("paths") < t.min_distinct_paths, "cluster").when(fine, "unit").otherwise("heading"))


def topic_tree(chunks: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """course_id, topic_key, parent_key, name, level, chunk_count, order_index.

    A course of strategy unit has one topic for each unit; one of strategy heading has its units
    as parents, with the sum of their passages, and one topic for each path. A key is the path's
    text. A course of strategy cluster has no tree of headings: see fallback_topics."""
    s = section_counts(chunks).join(topic_strategy(chunks, t).filter("strategy <> 'cluster'").select("course_id", "strategy"), "course_id")
    unit = F.element_at("section_path", 1)
    units = s.groupBy("course_id", "strategy", F.array(unit).alias("path")).agg(F.sum("chunk_count").alias("chunk_count"))
    deep = s.filter((F.col("strategy") != "unit") & (F.size("section_path") > 1)).select("course_id", "strategy", F.col("section_path").alias("path"), "chunk_count")
    d = units.unionByName(deep)
    key = F.array_join("path", " / ")
    parent = F.when(F.size("path") > 1, F.element_at("path", 1))
    order = F.row_number().over(Window.partitionBy("course_id").orderBy("key"))
    d = d.withColumn("key", key)
    return d.select("course_id", F.col("key").alias("topic_key"), parent.alias("parent_key"), F.element_at("path", -1).alias("name"), (F.size("path") - 1).alias("level"), "chunk_count", order.alias("order_index"))


def chunk_topics(chunks: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """chunk_id, course_id, topic_key: by the unit or the whole path.

    It is null for an empty path, and in courses whose headings don't help."""
    d = chunks.select("chunk_id", "course_id", "section_path").join(topic_strategy(chunks, t).select("course_id", "strategy"), "course_id", "left")
    key = F.when(F.col("strategy") == "unit", F.element_at("section_path", 1)).when(F.col("strategy") == "heading", F.array_join("section_path", " / "))
    return d.select("chunk_id", "course_id", F.when(F.size("section_path") > 0, key).alias("topic_key"))


def fallback_topics(chunks: DataFrame, vectors: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """chunk_id, course_id, topic_key, via: every passage under a topic, by headings or by clusters.

    The passages of courses whose headings don't help, those without any path among them, are
    clustered by their vectors (chunk_id, embedding), and their keys are "cluster" and a number; a
    passage without a vector, or without a path in a course of the others, has no topic."""
    strategy = topic_strategy(chunks, t).select("course_id", "strategy")
    d = chunk_topics(chunks, t).join(strategy, "course_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit("cluster")))
    lost = d.filter("strategy = 'cluster'").select("chunk_id", "course_id")
    clusters = cluster_topics(lost.join(vectors.select("chunk_id", "embedding"), "chunk_id"), t)
    by_cluster = lost.join(clusters.select("chunk_id", "cluster"), "chunk_id", "left").select("chunk_id", "course_id", F.concat(F.lit("cluster "), F.col("cluster")).alias("topic_key"), F.lit("cluster").alias("via"))
    return d.filter("strategy <> 'cluster'").select("chunk_id", "course_id", "topic_key", F.lit("headings").alias("via")).unionByName(by_cluster)


def mirror_topics(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """vectors with topic_key set from topics (chunk_id, topic_key); nothing else changes.

    A vector whose passage has no topic has null there, also if it had one before."""
    own = [c for c in vectors.columns if c != "topic_key"]
    return vectors.select(*own).join(topics.select("chunk_id", "topic_key"), "chunk_id", "left").select(*own, "topic_key")


def leaf_topics(tree: DataFrame) -> DataFrame:
    """Topics that are no topic's parent."""
    parents = tree.filter(F.col("parent_key").isNotNull()).select("course_id", F.col("parent_key").alias("topic_key")).distinct()
    return tree.join(parents, ["course_id", "topic_key"], "left_anti")


def clean_label(label):
    """White space around, double quotes, single quotes and full stops at the end go, in this order; then white space again.

    255 characters at most; "Untitled Topic" for nothing and for a null."""
    bare = label
    for step in (stripped, lambda x: F.btrim(x, F.lit('"')), lambda x: F.btrim(x, F.lit("'")), lambda x: F.rtrim(x, F.lit(".")), stripped):
        bare = step(bare)
    return F.coalesce(F.nullif(F.left(bare, F.lit(255)), F.lit("")), F.lit("Untitled Topic"))
