"""Filtered cosine search, scope resolution and the expansion of hits to whole topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DEFAULTS, Tunables
from ..sources.tables import written
from .fuzzy import fuzzy_matches
from .vector_index import SHORTLIST, Cells, build_index, candidates, fit_cells

#: Queries and vectors of a block, queries that are scored at a time, and pairs whose scores are summed in order at a time.
BLOCK = (4096, 16384)
SLAB = 256
PAIRS = 1 << 16
#: Scores nearer than this may change places when they are summed in order and rounded to nine digits.
MARGIN = 1e-8


def _unit(c: str):
    """An array scaled to length one in double precision; as it is where that can't be.

    The norm is bound by a list of one, so that it isn't worked out for each entry."""
    x = F.transform(c, lambda v: v.cast("double"))
    bound = F.transform(F.array(x), lambda y: F.struct(y.alias("x"), F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v)).alias("norm")))
    return F.get(F.transform(bound, lambda b: F.when(b["norm"] > 0, F.transform(b["x"], lambda v: v / b["norm"])).otherwise(b["x"])), F.lit(0))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as a matrix, shorter ones ending in zeros, and their lengths; -1 for a null or one that holds a null."""
    lists = column.combine_chunks()
    flat = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and sizes.min() == sizes.max() >= 0 and not flat.null_count:
        return np.asarray(flat, np.float64).reshape(len(sizes), sizes[0]), sizes
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 0)))
    for i, x in enumerate(lists.to_pylist()):
        if x is None or None in x:
            sizes[i] = -1
        else:
            out[i, : len(x)] = x
    return out, sizes


def _allowed(wanted: list, own: list) -> np.ndarray:
    """Of each list in wanted the places in own that it holds; all, for an empty list."""
    return np.stack([np.array([o in w for o in own], bool) if (w := set(x or ()) - {None}) or x else np.ones(len(own), bool) for x in wanted])


def _best(scores: np.ndarray, k: int, exact) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of all that can be among a row's first k by rounded score, then column.

    scores are near the ones that exact(rows, columns) gives, infinite for a score that is no
    number (first) or null (last), and NaN for pairs that don't count. Of equal scores only the
    first k columns can be."""
    if scores.shape[1] > k:
        least = np.partition(np.where(np.isnan(scores), -np.inf, scores), scores.shape[1] - k, axis=1)[:, -k] - MARGIN
    else:
        least = np.full(len(scores), -np.inf)
    rows, cols = np.nonzero(scores >= least[:, None])
    found = scores[rows, cols]
    real = np.nonzero(np.isfinite(found))[0]
    for lo in range(0, len(real), PAIRS):
        at = real[lo : lo + PAIRS]
        found[at] = exact(rows[at], cols[at])
    order = np.lexsort((cols, -found, rows))
    rows, cols, found = rows[order], cols[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    keep = np.arange(len(rows)) - start < k
    return rows[keep], cols[keep], found[keep]


def _block_scores(k: int, schema: pa.Schema):
    """A block of queries and one of vectors to the pairs that can be among a query's first k."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        v = v.sort_by("chunk_id") if len(v) else v
        if not len(q) or not len(v):
            return schema.empty_table()
        (a, na), (b, nb) = _rows(q["query"]), _rows(v["embedding"])
        dim = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))
        odd_a, odd_b = ~np.isfinite(a).all(1), ~np.isfinite(b).all(1)
        hits = []
        for lo in range(0, len(a), SLAB):
            x, some = a[lo : lo + SLAB], slice(lo, lo + SLAB)
            with np.errstate(invalid="ignore"):
                s = x @ b.T
            s[odd_a[some, None] | odd_b] = np.inf
            s[(na[some, None] != nb) | (na[some, None] < 0)] = -np.inf
            for names, own in (("topic_ids", "topic_id"), ("document_ids", "document_id")):
                if names in q.column_names:
                    s[~_allowed(q[names].to_pylist()[some], v[own].to_pylist())] = np.nan
            if "query_keys" in q.column_names:
                s[~_share(q["query_keys"], some, v["keys"])] = np.nan
            # Summed from the first entry to the last, whatever the block: copies have equal scores.
            rows, cols, found = _best(s, k, lambda i, j: np.add.accumulate(x[i] * b[j], axis=1)[:, -1] if dim else np.zeros(len(i)))
            score = pa.array(np.where(np.isposinf(found), np.nan, found), mask=np.isneginf(found))
            hits.append(pa.table([q["query_id"].take(pa.array(rows + lo)), v["chunk_id"].take(pa.array(cols)), v["topic_id"].take(pa.array(cols)), score], schema=schema))
        return pa.concat_tables(hits)

    return run


def _in_blocks(d: DataFrame, name: str, size: int, other: DataFrame, other_size: int, own: str, theirs: str) -> DataFrame:
    """d with its block, once for each of the other's blocks of its course."""
    parts = lambda x, n, to: x.groupBy("course_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(n)).cast("int").alias(to))
    d = d.join(F.broadcast(parts(d, size, "_own")), "course_id").join(F.broadcast(parts(other, other_size, "_theirs")), "course_id")
    d = d.withColumn(own, F.pmod(F.xxhash64(name), F.col("_own")).cast("int"))
    return d.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("_theirs") - F.lit(1)))).drop("_own", "_theirs")


def _scored(queries: DataFrame, vectors: DataFrame, k: int, block: tuple[int, int]) -> DataFrame:
    """query_id, chunk_id, topic_id, score of what can be among a query's first k, by pairs of blocks."""
    q = queries.withColumn("query", _unit("query"))
    v = vectors.withColumn("embedding", _unit("embedding"))
    schema = T.StructType([*(T.StructField(c, (queries if c == "query_id" else vectors).schema[c].dataType) for c in ("query_id", "chunk_id", "topic_id")), T.StructField("score", T.DoubleType())])
    q = _in_blocks(q, "query_id", block[0], vectors, block[1], "_q", "_v")
    v = _in_blocks(v, "chunk_id", block[1], queries, block[0], "_v", "_q")
    on = ("course_id", "_q", "_v")
    q = q.select(*[F.col(c).alias(c) for c in q.columns])  # queries may be made from the vectors: their columns are to be others
    pairs = q.groupBy(*on).cogroup(v.groupBy(*on)).applyInArrow(_block_scores(k, to_arrow_schema(schema)), schema)
    return pairs.withColumn("score", F.round("score", 9))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.top_k, block: tuple[int, int] = BLOCK) -> DataFrame:
    """query_id, chunk_id, topic_id, score, rank: the k nearest of the query's course by cosine.

    queries has query_id, course_id, query and, to restrict, topic_ids and document_ids (empty:
    no restriction). Vectors and queries are scaled once each. Blocks of a course's queries meet
    blocks of its vectors, of at most about so many rows; each pair of blocks gives k rows for a
    query or few more, and these are ranked."""
    return _ranked(_scored(queries, vectors, k, block), k)


def _sign_keys(tables: int, bits: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        """For each table, on which side of its hyperplanes a vector is."""
        out = []
        for v in vectors:
            x = np.zeros(0) if v is None else np.asarray(v, np.float64)
            a = np.random.default_rng([17, len(x)]).standard_normal((len(x), tables * bits))
            sides = (x @ a > 0).reshape(tables, bits)
            out.append(((sides << np.arange(bits)).sum(1) + (np.arange(tables) << bits)).tolist())
        return pd.Series(out)

    return keys


def _share(one: pa.ChunkedArray, some: slice, two: pa.ChunkedArray) -> np.ndarray:
    """Which rows of one, in the range, and of two have a key in common; each has one key for a table."""
    a, b = (np.asarray(x.combine_chunks().flatten(), np.int64).reshape(len(x), -1) for x in (one, two))
    a = a[some]
    out = np.zeros((len(a), len(b)), bool)
    for t in range(a.shape[1]):
        out |= a[:, t, None] == b[:, t]
    return out


def vector_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.top_k, tables: int = 24, bits: int = 4, block: tuple[int, int] = BLOCK) -> DataFrame:
    """As vector_topk without restrictions, among the vectors that share a bucket with the query: hits may be missed.

    A bucket is a course, a table, and a side of each of the table's bits hyperplanes. A vector at
    angle a shares one of the tables with probability 1 - (1 - (1 - a / pi) ** bits) ** tables;
    at cosine 0.4 that is 0.98. With so few sides most pairs share a bucket, so buckets are
    compared in pairs of blocks, where a pair is one bit, and not as rows. Scores are exact. Queries that get fewer than k hits are
    answered by vector_topk."""
    keys = _sign_keys(tables, bits)
    side = lambda d, c, name: d.withColumn(name, keys(F.transform(c, lambda x: x.cast("double"))))
    q = side(queries.select("query_id", "course_id", "query"), "query", "query_keys")
    v = side(vectors.select("chunk_id", "course_id", "topic_id", "embedding"), "embedding", "keys")
    hits = written(_ranked(_scored(q, v, k, block), k), "lsh-hits")
    short = queries.select("query_id", "course_id", "query").join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k), "query_id", "left_anti")
    return hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(vector_topk(short, vectors, k))


def vector_topk_ivf(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.top_k, index: DataFrame | None = None, cells: Cells | None = None, probes: int | None = None) -> DataFrame:
    """As vector_topk without restrictions, by an inverted-file index: hits may be missed.

    Scores are exact, of SHORTLIST * k vectors for each query. index and cells are of
    build_index and fit_cells, and are made here unless given. Queries that find fewer than k
    vectors in the cells they look into are answered by vector_topk."""
    cells = cells or fit_cells(vectors, k=k)
    if cells is None:
        return vector_topk(queries, vectors, k)
    index = build_index(vectors, cells) if index is None else index
    met = written(candidates(queries, index, cells, SHORTLIST * k, probes), "candidates")
    v = met.join(vectors.select("chunk_id", "topic_id", _unit("embedding").alias("embedding")), "chunk_id")
    scored = v.join(queries.select("query_id", _unit("query").alias("query")), "query_id")
    hits = _ranked(scored.select("query_id", "chunk_id", "topic_id", F.round(_dot("query", "embedding"), 9).alias("score")), k)
    enough = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query_id")
    short = written(queries.join(enough, "query_id", "left_anti").select("query_id", "course_id", "query"), "short-queries")
    if short.isEmpty():
        return hits
    return hits.join(enough, "query_id", "left_semi").unionByName(vector_topk(short, vectors, k))


def fuzzy_topics(queries: DataFrame, topics: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """query_id, topic_id, ratio of the course's topics whose names are near the query's text.

    Texts and names meet by their rarest runs of characters, not query by topic."""
    return fuzzy_matches(queries, topics, t.fuzzy_threshold)


def resolve_scope(requests: DataFrame, topics: DataFrame, vectors: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """query_id, via, topic_id, place: the topics a request means; a null topic is the whole course.

    Topics named outright win; no text means the course; then names near the text; then the
    topics of the nearest passages, whole, in the order of their best hit; else the course.
    requests has query_id, course_id, topic_ids, text, query (a vector)."""
    named = requests.filter(F.size("topic_ids") > 0).select("query_id", F.lit("named").alias("via"), F.posexplode("topic_ids").alias("place", "topic_id"))
    rest = requests.filter(F.size("topic_ids") <= 0)
    blank = F.coalesce(F.btrim("text"), F.lit("")) == ""
    course = rest.filter(blank).select("query_id", F.lit("course").alias("via"), F.lit(0).alias("place"), F.lit(None).cast(topics.schema["topic_id"].dataType).alias("topic_id"))
    asked = rest.filter(~blank)
    near = fuzzy_topics(asked, topics, t)
    by_name = near.select("query_id", F.lit("name").alias("via"), (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ratio"), "topic_id")) - 1).alias("place"), "topic_id")
    open_ = asked.join(near.select("query_id").distinct(), "query_id", "left_anti")
    hits = vector_topk(open_.select("query_id", "course_id", "query"), vectors, t.resolver_top_k).filter(F.col("topic_id").isNotNull())
    best = hits.groupBy("query_id", "topic_id").agg(F.min("rank").alias("rank"))
    found = best.select("query_id", F.lit("search").alias("via"), (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).alias("place"), "topic_id")
    nothing = open_.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("course").alias("via"), F.lit(0).alias("place"), F.lit(None).cast(topics.schema["topic_id"].dataType).alias("topic_id"))
    return named.unionByName(course).unionByName(by_name).unionByName(found).unionByName(nothing)


def expand_to_topics(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, chunk_id of every passage of the topics that a query hit."""
    wanted = hits.filter(F.col("topic_id").isNotNull()).select("query_id", "course_id", "topic_id").distinct()
    return vectors.join(wanted, ["course_id", "topic_id"]).select("query_id", "chunk_id")


def context_passages(queries: DataFrame, hits: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, context, sources: the hits numbered by rank; a sentence says so if there is none."""
    j = hits.join(passages, "chunk_id")
    block = F.format_string("[%d] (slide %d-%d, %s)\n%s", F.col("rank"), F.col("page_start"), F.col("page_end"), F.array_join("section_path", " / "), F.col("text"))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), "chunk_id"))).alias("b"))
    g = g.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"), F.transform("b", lambda x: x["chunk_id"]).alias("sources"))
    out = queries.select("query_id").join(g, "query_id", "left")
    return out.select("query_id", F.coalesce("context", F.lit("No passage matches.")).alias("context"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))
