"""What the corpus operators share: written tables and word rules."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import table, written

__all__ = ["ascii_lower", "crc_of_id", "id_crc", "table", "text_or_empty", "word_count", "written"]

# White space between words, as the contracts give it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def word_count(column: Column) -> Column:
    """Number of words; 0 for null and for white space alone."""
    inner = F.btrim(F.coalesce(column, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE + "+"))).cast("long")


def id_crc(column: Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(column.cast("string").cast("binary"))


def crc_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
