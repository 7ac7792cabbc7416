"""Joins of tables in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in SHARE rows, and of more than LEAST, is spread over several tasks.
SHARE = 1000
LEAST = 100


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, on, how) where a key may hold any share of left's rows and few of right's.

    Keys of more than a thousandth of left's rows (so there are fewer than a thousand, which is
    what the broadcast is bounded by) are cut into parts of about a thousandth by a hash of the
    columns spread; right's rows of such a key are there once for each part. how is inner, left,
    left_semi or left_anti. Null keys match nothing. left is read again to count its keys, so let
    it be a written table, unless counts (on, k) has the rows of each key that matters."""
    if counts is None:
        total = left.count()
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        counts = counts.select(*on, F.col("k").alias("_rows"))
        total = counts.agg(F.sum("_rows")).first()[0] or 0
    limit = max(LEAST, total // SHARE)
    hot = counts.filter(F.col("_rows") > limit).select(*on, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_salts"))
    rows = hot.collect()  # fewer than SHARE
    if not rows:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    parts = F.coalesce("_salts", F.lit(1))
    one = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_salts")
    many = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - F.lit(1)))).drop("_salts")
    return one.join(many, [*on, "_salt"], how).drop("_salt")
