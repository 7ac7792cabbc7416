import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursegrain.operators import retrieval as R
from coursegrain.operators import vector_index as X
from coursegrain.plans import corpus as C
from coursegrain.sources import views as V


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_share_of_pairs(spark, sf):
    """Over every row whose id is divisible by 20."""
    q, v = C._queries(spark, sf).cache(), V.vectors(spark, sf)
    exact = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.vector_topk(q, v).collect()}
    cells = X.fit_cells(v)
    index = X.build_index(v, cells)
    assert index.select(F.explode("entries")).count() == v.count()
    met = X.candidates(q, index, cells, X.SHORTLIST * 5).count()
    pairs = q.join(v, "course_id").count()
    assert met < pairs / 5
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.vector_topk_ivf(q, v, 5, index, cells).collect()}
    assert len(got) == len(exact) and len(exact.keys() & got.keys()) / len(exact) >= 0.9
    assert all(math.isclose(exact[k], got[k], abs_tol=1e-9) for k in exact.keys() & got.keys())


def test_codes_rank_as_vectors_do_when_all_cells_are_probed(spark):
    v = V.vectors(spark, "/root/testdata/sf0.001")
    q = C._queries(spark, "/root/testdata/sf0.001")
    cells = X.fit_cells(v, cells=7)
    index = X.build_index(v, cells, postings=5)
    assert index.agg(F.max("part")).first()[0] > 0
    exact = {(r["query_id"], r["rank"], r["score"]) for r in R.vector_topk(q, v).collect()}
    got = {(r["query_id"], r["rank"], r["score"]) for r in R.vector_topk_ivf(q, v, 5, index, cells, probes=7).collect()}
    assert len(exact & got) / len(exact) > 0.98


def test_clustered_vectors_need_few_probes():
    r = np.random.default_rng(5)
    x = np.repeat(r.standard_normal((40, 16)), 50, 0) + 0.1 * r.standard_normal((2000, 16))
    assert X.train(X.unit_rows(x, 16), 40, 5).probes <= 4
    flat = X.unit_rows(r.standard_normal((2000, 16)), 16)
    assert X.train(flat, 40, 5).probes > 4


def test_odd_vectors_copies_and_few_hits(spark):
    rows = [(i, 1, i, [1.0, 0.01 * i]) for i in range(4)] + [(10, 1, 0, None), (11, 1, 0, [0.0, 0.0]), (12, 1, 0, [float("nan"), 1.0]), (13, 2, 0, [1.0, 0.0]), (14, None, 0, [1.0, 0.0])] + [(100 + i, 3, 0, [0.5, 0.5]) for i in range(50)]
    v = spark.createDataFrame(rows, "chunk_id long, course_id int, topic_id int, embedding array<double>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 0.0]), (3, 3, [1.0, 1.0]), (4, 9, [1.0, 1.0])], "query_id long, course_id int, query array<double>")
    got = R.vector_topk_ivf(q, v.filter("embedding is not null and not isnan(embedding[0])"), 5).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert by[1][:4] == [0, 1, 2, 3] and by[2] == [13] and len(by[3]) == 5 and 4 not in by
    cells = X.fit_cells(v)
    assert X.build_index(v, cells).select(F.explode("entries.chunk_id")).count() == v.filter("course_id is not null").count()
    assert X.fit_cells(v.limit(0)) is None and R.vector_topk_ivf(q, v.limit(0)).count() == 0
