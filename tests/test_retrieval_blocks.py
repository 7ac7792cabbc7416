"""Searches in pairs of blocks give what looking at every pair gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursegrain.operators import retrieval as R

NAN = float("nan")


def _slow(queries, vectors, k):
    out = {}
    for qid, course, q, topics in queries:
        scored = []
        for cid, c, topic, v in vectors:
            if c != course or topics and topic not in topics:
                continue
            if q is None or v is None or len(q) != len(v) or None in v:
                s = None
            else:
                unit = lambda x: [y / n for y in x] if (n := math.sqrt(sum(y * y for y in x))) > 0 or n != n else x
                s = sum(a * b for a, b in zip(unit(q), unit(v)))
            rank = math.inf if s is not None and s != s else -math.inf if s is None else round(s, 9)
            scored.append((-rank, cid))
        for r, (s, cid) in enumerate(sorted(scored)[:k], 1):
            out[qid, r] = (cid, None if s == math.inf else "nan" if s == -math.inf else -s)
    return out


@pytest.mark.parametrize("block", [(2, 3), (4096, 16384)])
def test_topk_in_blocks(spark, block):
    r = np.random.default_rng(3)
    vec = lambda: [float(x) for x in r.standard_normal(6)]
    same = vec()
    vectors = [(i, i % 2, i % 3, vec()) for i in range(30)] + [(100 + i, 0, None if i % 2 else 1, same) for i in range(25)]
    vectors += [(200, 0, 1, None), (201, 0, 1, [0.0] * 6), (202, 0, 1, [1.0, 2.0]), (203, 1, 1, [NAN, *vec()[:5]]), (204, 1, 1, [None, *vec()[:5]]), (300, 2, 1, vec()), (301, 2, 1, None)]
    queries = [(i, i % 2, vec(), [[], [1], [0, 2]][i % 3]) for i in range(7)] + [(50, 0, same, None), (51, 2, vec(), []), (52, 0, None, []), (53, 9, vec(), [])]
    q = spark.createDataFrame(queries, "query_id long, course_id int, query array<double>, topic_ids array<int>")
    v = spark.createDataFrame(vectors, "chunk_id long, course_id int, topic_id int, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["chunk_id"], "nan" if x["score"] is not None and x["score"] != x["score"] else x["score"]) for x in R.vector_topk(q, v, 5, block).collect()}
    want = _slow(queries, vectors, 5)
    assert {x: y[0] for x, y in got.items()} == {x: y[0] for x, y in want.items()}
    assert all(got[x][1] == y[1] or got[x][1] == pytest.approx(y[1], abs=2e-9) for x, y in want.items())


def test_pairs_are_no_rows(spark):
    v = spark.range(40).select(F.col("id").alias("chunk_id"), F.lit(0).alias("course_id"), F.lit(1).alias("topic_id"), F.array(F.col("id") % 7 - 3.0, F.col("id") % 5 + 0.5, F.lit(1.0)).alias("embedding"))
    q = v.select(F.col("chunk_id").alias("query_id"), "course_id", F.col("embedding").alias("query"))
    for search in (R.vector_topk, R.vector_topk_lsh):
        assert "zip_with" not in search(q, v)._jdf.queryExecution().optimizedPlan().toString()
