"""Reading order of positioned boxes: recursive cuts at wide gaps, then rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

# Gutters and row bands in EMU, and the depth of cuts.
COLUMN_GUTTER = ROW_GUTTER = 365760
ROW_BAND = 109728
MAX_DEPTH = 8


def interval_gaps(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, size, middle of each empty interval between the merged spans."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    d = spans.select(*by, F.col(start).alias("s"), F.col(end).alias("e")).withColumn("reach", F.max("e").over(before.orderBy("s", "e"))).filter(F.col("s") > F.col("reach"))
    size = F.col("s") - F.col("reach")
    return d.select(*by, size.alias("size"), (F.col("reach") + F.floor(size / 2)).alias("middle"))


def dominant_gap(gaps: DataFrame, by: list[str], floor: int) -> DataFrame:
    """by, size, middle of the widest gap if it has the floor and is twice the second widest."""
    order = Window.partitionBy(*by).orderBy(F.desc("size"), F.desc("middle"))
    d = gaps.withColumn("nth", F.row_number().over(order)).withColumn("second", F.lead("size").over(order)).filter("nth = 1")
    return d.filter((F.col("size") >= floor) & (F.col("second").isNull() | (F.col("size") >= 2 * F.col("second")))).select(*by, "size", "middle")


def xy_cut(boxes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """boxes (slide, left, top, width, height, text) with block, a path of 0 and 1 in reading order.

    Each round cuts every block once: at a dominant gap between columns, else between rows. Rounds
    are written, so that the plan doesn't grow with them; they end when no block has a gap."""
    d = boxes.withColumn("block", F.lit(""))
    by = ["slide", "block"]
    for _ in range(depth):
        x = dominant_gap(interval_gaps(d.withColumn("right", F.col("left") + F.col("width")), by, "left", "right"), by, COLUMN_GUTTER).select(*by, F.col("middle").alias("x_at"))
        y = dominant_gap(interval_gaps(d.withColumn("bottom", F.col("top") + F.col("height")), by, "top", "bottom"), by, ROW_GUTTER).select(*by, F.col("middle").alias("y_at"))
        cuts = written(x.join(y, by, "full"), "cuts")
        if cuts.isEmpty():
            break
        d = d.join(cuts, by, "left")
        step = F.when(F.col("x_at").isNotNull(), (F.col("left") >= F.col("x_at")).cast("int")).when(F.col("y_at").isNotNull(), (F.col("top") >= F.col("y_at")).cast("int"))
        d = d.withColumn("block", F.concat("block", F.coalesce(step.cast("string"), F.lit("")))).drop("x_at", "y_at")
        d = written(d, "blocks")
    return d


def row_bands(boxes: DataFrame, by: list[str], band: int = ROW_BAND) -> DataFrame:
    """by, row, line: boxes within a band of the row's first top share it; cells left to right.

    Where a row begins depends on the row before: boxes stream in the order of their tops within
    their block, and only the open row's first top is held. A box without a top is a row."""
    kinds = dict(boxes.dtypes)
    columns = [*by, "top", "left", "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = anchor = None
        row = i = -1
        for b in batches:
            out, places = [], []
            for *own, top in zip(*(b.column(j).to_pylist() for j in range(len(by) + 1))):
                if own != key:
                    key, anchor, row, i = own, None, -1, -1
                i += 1
                if anchor is None or top is None or abs(top - anchor) > band:
                    row, anchor = row + 1, top
                out.append(row)
                places.append(i)
            yield pa.record_batch([*b.columns, pa.array(out, pa.int32()), pa.array(places, pa.int64())], names=[*columns, "row", "i"])

    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    cells = boxes.select(*columns).repartition(n, *by).sortWithinPartitions(*columns).mapInArrow(rows, f"{schema}, row int, i long")
    lines = cells.groupBy(*by, "row").agg(F.array_sort(F.collect_list(F.struct("left", "i", "text"))).alias("c"))
    return lines.select(*by, "row", F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("line"))
