"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursegrain.llm import line_dedup, mixing, near_dup, packing, quality
from coursegrain.llm.common import table, text_or_empty, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null text is scored as an empty one; rows alike are kept or rejected alike."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, labels)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold are left in one of them; n_chars follows the text.

    A document that loses all lines stays with an empty text; a null text stays null."""
    out = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Null and empty texts are one group; rows alike in doc_id and text are one document."""
    keep = near_dup.near_duplicates(docs).filter("kept").select(F.col("doc_id").isNull().alias("_null"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_key").alias("_key")).distinct()
    named = docs.withColumns({"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "_key": F.xxhash64(text_or_empty())})
    return named.join(keep, ["_null", "_id", "_key"], "left_semi").dropDuplicates(["_null", "_id", "_key"]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights: documents left out, taken, or repeated.

    A null source is a source; null and empty texts, which have no words, come as often as
    their source's certain whole copies; rows alike in doc_id and text have the same fate."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens.

    Null and empty texts are one end token; a null doc_id and repeated rows are documents as
    any others."""
    return packing.pack_documents(docs).drop("row_key")


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_shared_lines),
    ("near_dedup", one_of_each_group),
    ("mix", mixed),
    ("packing", packed),
]

#: The classifier, the near copies and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
