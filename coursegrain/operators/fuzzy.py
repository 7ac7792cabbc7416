"""A similarity join of short texts by their normalised indel ratio, 200 * LCS / (m + n).

Two texts of a ratio of at least the threshold are a few insertions and deletions apart, at
most (100 - threshold) / 100 of their lengths together. Each of these breaks at most Q of the
Q-grams of either text, so of so many plus one of its grams one at least is left, at a place
that the edits can have moved no farther than their number: it is enough to look texts up by
that many of their rarest grams. Texts too short for that are looked up by their rarest single
characters in the same way. The ratio itself is taken only of texts that meet at places and with
lengths that allow it, and that have enough grams in common."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fuzzy_ratio
from ..sources.tables import written

Q = 2


def most_edits(length: int, threshold: float) -> int:
    """Edits to any text at all that is near enough to one of this length."""
    share = (100.0 - threshold) / 100.0
    # The other text is (1 + share) / (1 - share) times as long at most.
    return math.floor(share * length * (1 + (1 + share) / (1 - share)) + 1e-9) if share < 1 else length


def longest_short(threshold: float, q: int = Q, upto: int = 64) -> int | None:
    """The greatest length, up to upto, at which edits can break every gram; None if that goes on beyond."""
    short = [m for m in range(upto + 1) if m - q + 1 < q * most_edits(m, threshold) + 1]
    return None if short and short[-1] == upto else max(short, default=0)


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """gram, place of each text (course_id, s, size): its runs of q characters, from 0."""
    places = F.sequence(F.lit(0), F.col("size") - F.lit(q))
    return texts.filter(F.col("size") >= q).select("course_id", "s", "size", F.explode(places).alias("place")).withColumn("gram", F.substring(F.col("s"), F.col("place") + 1, F.lit(q)))


def _looked_up(texts: DataFrame, counts: DataFrame, q: int, threshold: float) -> DataFrame:
    """The rarest grams of each text, one more than edits can break."""
    share = (100.0 - threshold) / 100.0
    edits = F.floor(F.lit(share * (1 + (1 + share) / (1 - share))) * F.col("size") + F.lit(1e-9)) if share < 1 else F.col("size")
    order = Window.partitionBy("course_id", "s").orderBy(F.coalesce("seen", F.lit(0)), "gram", "place")
    g = _grams(texts, q).join(counts, "gram", "left").withColumn("nth", F.row_number().over(order))
    return g.filter(F.col("nth") <= edits * F.lit(q) + F.lit(1)).select("course_id", "gram", "s", "size", "place")


def _met(left: DataFrame, right: DataFrame, q: int, threshold: float) -> DataFrame:
    """Texts that share a looked-up gram at places that allow it."""
    # Rarity is counted over the names; a gram that no name has comes first and meets nothing.
    counts = written(_grams(right, q).groupBy("gram").agg(F.count(F.lit(1)).alias("seen")), "gram-counts")
    a = _looked_up(left, counts, q, threshold).select("course_id", "gram", F.col("s").alias("a"), F.col("size").alias("m"), F.col("place").alias("i"))
    b = _looked_up(right, counts, q, threshold).select("course_id", "gram", F.col("s").alias("b"), F.col("size").alias("n"), F.col("place").alias("j"))
    edits = (100.0 - threshold) / 100.0 * (F.col("m") + F.col("n"))
    near = a.join(b, ["course_id", "gram"]).filter((F.abs(F.col("m") - F.col("n")) <= edits + 1e-9) & (F.abs(F.col("i") - F.col("j")) <= edits + 1e-9))
    pairs = near.select("course_id", "a", "b").distinct()
    # Of the different grams of either text the edits leave all but Q for each edit.
    broken = F.floor((100.0 - threshold) / 100.0 * (F.length("a") + F.length("b")) + 1e-9) * q
    x, y = _different(F.col("a"), q), _different(F.col("b"), q)
    return pairs.filter(F.size(F.array_intersect(x, y)) >= F.greatest(F.size(x), F.size(y)) - broken)


def _different(text: Column, q: int) -> Column:
    last = F.length(text) - q + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(q))))).otherwise(F.array().cast("array<string>"))


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """course_id, a, b: pairs of lower-case texts (course_id, s) among which all near ones are."""
    sized = lambda d: d.select("course_id", "s", F.length("s").alias("size"))
    left, right = sized(left), sized(right)
    short = longest_short(threshold)
    share = (100.0 - threshold) / 100.0
    if short is None:
        one_l, one_r = left, right
        met = None
    else:
        most = F.lit(short * (1 + share) / (1 - share) + 1e-9)
        one_l, one_r = left.filter(F.col("size") <= most), right.filter(F.col("size") <= most)
        met = _met(left, right, Q, threshold)
    single = _met(one_l, one_r, 1, threshold)
    met = single if met is None else met.unionByName(single)
    # Two empty texts are alike, and have no grams.
    empty = left.filter("size = 0").join(right.filter("size = 0").select("course_id"), "course_id", "left_semi").select("course_id", F.lit("").alias("a"), F.lit("").alias("b"))
    return met.unionByName(empty).distinct()


def near_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """course_id, a, b, ratio of all pairs of lower-case texts of a course at the threshold or above.

    left and right have course_id and s, each text once; threshold is above 0."""
    pairs = candidate_pairs(left, right, threshold)
    return pairs.withColumn("ratio", fuzzy_ratio("a", "b")).filter(F.col("ratio") >= threshold)


def distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    """course_id, s: the lower-case texts of each course, each once; nulls are left out."""
    return rows.filter(F.col(text).isNotNull() & F.col("course_id").isNotNull()).select("course_id", F.lower(text).alias("s")).distinct()


def fuzzy_matches(queries: DataFrame, topics: DataFrame, threshold: float) -> DataFrame:
    """query_id, topic_id, ratio of the course's topics whose names are near the query's text.

    Texts and names are compared in lower case, each text once however many queries have it. A
    null text, name or course matches nothing; two empty ones match."""
    near = written(near_texts(distinct_texts(queries, "text"), distinct_texts(topics, "name"), threshold), "near-texts")
    lower: Column = F.lower("text")
    q = queries.select("query_id", "course_id", lower.alias("a"))
    t = topics.select("topic_id", "course_id", F.lower("name").alias("b"))
    return q.join(near, ["course_id", "a"]).join(t, ["course_id", "b"]).select("query_id", "topic_id", "ratio")
