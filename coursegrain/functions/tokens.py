"""Token counts by a named counter: words, or a file of the tokenizers library.

A file's path must be one that every executor can open, as a package's data files are. Each
worker process opens it once and keeps its encoder; texts reach it in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import stripped, token_count

WORDS = "words"


@lru_cache(maxsize=4)
def _encoder(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def count_in(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text by the tokenizer of a file, special ones left out."""
    return [len(e.ids) for e in _encoder(path).encode_batch_fast(texts, add_special_tokens=False)]


def _of_file(path: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        out: list[int] = []
        for lo in range(0, len(texts), 256):
            out += count_in(path, texts.iloc[lo : lo + 256].tolist())
        return pd.Series(out, dtype="int32")

    return count


def counter(name: str = WORDS) -> Callable[[Column], Column]:
    """A column function that counts tokens; 0 for a null and for white space alone."""
    if name == WORDS:
        return token_count
    count = _of_file(name)

    def counted(text: Column) -> Column:
        known = F.coalesce(text, F.lit(""))
        return F.when(stripped(known) == "", F.lit(0)).otherwise(count(known))

    return counted
