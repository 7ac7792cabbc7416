"""Places and quantiles within groups of any size: no task sorts or holds a whole group.

Rows are range-partitioned by group and order, so that a large group lies in many partitions; a
count for each group and partition says where a partition's rows begin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def _ranged(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), name)


def _begins(parted: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """by, _part, _before, _own, _all: the weight before, in and over all of a group's partitions."""
    sums = parted.groupBy(*by, "_part").agg(F.sum(weight).alias("_own"))
    own = Window.partitionBy(*by)
    before = F.sum("_own").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"), "_own", F.sum("_own").over(own).alias("_all"))


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right that it hasn't; null groups are groups."""
    keys = [*by, "_part"]
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    same = left["_part"] == named["_r__part"]
    for c in by:
        same = same & left[c].eqNullSafe(named[f"_r_{c}"])
    return left.join(named, same).drop(*[f"_r_{c}" for c in keys])


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the order within their group; order should leave no ties.

    Rows of a group that tie in the order are in one partition, in any order. rows are read
    twice (once for the range bounds), so let them be a written table if they are dear."""
    d = _ranged(rows, by, order, "ranked")
    nth = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    d = _with(d.withColumn("_nth", nth), _begins(d, by, F.lit(1)).drop("_own", "_all"), by)
    return d.select(*rows.columns, (F.col("_before") + F.col("_nth") - F.lit(1)).cast("long").alias(name))


def _spots(n: Column, p: float) -> tuple[Column, Column]:
    at = (n - F.lit(1)) * F.lit(float(p))
    return F.floor(at), F.ceil(at)


def quantiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float | tuple[str, float]]) -> DataFrame:
    """by and a column for each of wanted: exact quantiles of value within each group.

    wanted has a share p, for the quantile between the two values next to place (n - 1) p, or
    ("floor", p), for the value at place min(n - 1, floor(n p)). Equal values are one row with a
    count before anything is sorted; then only the partitions that hold a wanted place are looked
    into. Null values don't count; a group of nothing else has no row. Results are doubles."""
    counts = rows.select(*by, value.cast("double").alias("_value")).filter("_value is not null").groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_k"))
    d = _ranged(counts, by, [F.col("_value")], "values")
    begins = written(_begins(d, by, F.col("_k")), "value-parts")
    n = F.col("_all")
    spots = []
    for name, how in wanted.items():
        if isinstance(how, tuple):
            spots.append(F.struct(F.lit(f"{name}<").alias("name"), F.least(n - F.lit(1), F.floor(n * F.lit(float(how[1])))).cast("long").alias("at")))
        else:
            spots += [F.struct(F.lit(f"{name}{end}").alias("name"), at.cast("long").alias("at")) for end, at in zip("<>", _spots(n, how))]
    asked = begins.withColumn("_spot", F.explode(F.array(*spots))).filter((F.col("_spot.at") >= F.col("_before")) & (F.col("_spot.at") < F.col("_before") + F.col("_own")))
    asked = asked.select(*by, "_part", "_before", "_all", F.col("_spot.name").alias("_name"), F.col("_spot.at").alias("_at"))
    # Few rows: two for each group and quantile. The partitions named there are the only ones read on.
    some = _with(d, asked.select(*by, "_part", "_before").distinct(), by)
    upto = F.sum("_k").over(Window.partitionBy(*by, "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    some = some.withColumn("_upto", upto)
    hit = _with(some.drop("_before"), asked.drop("_before"), by).filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_k")))
    own = lambda name: F.max(F.when(F.col("_name") == name, F.col("_value")))
    out = []
    for name, how in wanted.items():
        if isinstance(how, tuple):
            out.append(own(f"{name}<").alias(name))
        else:
            at = (F.max("_all") - F.lit(1)) * F.lit(float(how))
            low, high = own(f"{name}<"), own(f"{name}>")
            out.append(F.when(low == high, low).otherwise(low * (F.floor(at) + F.lit(1) - at) + high * (at - F.floor(at))).alias(name))
    return hit.groupBy(*by).agg(*out)
