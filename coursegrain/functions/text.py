"""Column functions on text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# White space of any script, as characters and inside a pattern's brackets, and what ends a line.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\x{d}\x{a}|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def any_script(pattern: str) -> str:
    """A pattern whose white space and digits are those of any script."""
    return pattern.replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]").replace(r"\d", r"\p{Nd}")


WORD = any_script(r"\S+")
#: As WORD, in Java's patterns only: visible ASCII is looked at first, as the other ranges take some twenty tests a character.
FAST_WORD = rf"[!-~[^{BLANK}]]++"
FAST_LINE_END = r"\x{d}\x{a}|[[^ -~]&&[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]]"
#: What a single space doesn't stand for yet: longer runs, and other white space.
FAST_RUN = rf"[[^!-~]&&[{BLANK}]]{{2,}}+|[[^ -~]&&[{BLANK}]]"


@F.pandas_udf(T.IntegerType())
def _runs(text: pd.Series) -> pd.Series:
    """Python splits at the characters of BLANKS."""
    return text.map(lambda x: len(x.split())).astype("int32")


def token_count(text: Column) -> Column:
    """Number of white-space-free runs; 0 for null and blank text.

    A pattern of WORD takes some thirty times as long, as it tests each character against twenty ranges."""
    return _runs(F.coalesce(text, F.lit("")))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def text_lines(text: Column) -> Column:
    """The lines of a text, at line feeds, carriage returns, vertical tabs, form feeds and the other ends of lines."""
    return F.split(text, FAST_LINE_END, -1)


def fingerprint(line: Column) -> Column:
    """Trimmed of any white space, lower case, white space collapsed; digits stay."""
    return F.regexp_replace(F.lower(stripped(line)), FAST_RUN, " ")


def word_list(text: Column, least: int = 1) -> Column:
    """Distinct ASCII words of the lower-cased text with so many letters at least."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= least) if least > 1 else words)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * longest common subsequence / (length + length) of the lower-cased strings; 100 for two empty ones, null for a null."""

    def one(x, y):
        if x is None or y is None:
            return None
        x, y = x.lower(), y.lower()
        if not x and not y:
            return 100.0
        places: dict[str, int] = {}
        for j, c in enumerate(y):
            places[c] = places.get(c, 0) | 1 << j
        full = (1 << len(y)) - 1
        row = full
        for c in x:
            u = row & places.get(c, 0)
            row = ((row + u) | (row - u)) & full
        return 200.0 * (len(y) - row.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
