"""Columns that are worked out once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(d: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """The columns keep of d, and those made, each of which is worked out once a row.

    Filters and selections that come later read the result: an expression that stands in a plain
    select is copied to each place that names it, by filters above all, and what is copied so
    through several selects is worked out hundreds of times a row."""
    return d.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
