import numpy as np
import pytest
from pyspark.sql import functions as F

from coursegrain.operators import clusters as G
from coursegrain.sources import views as V

SF = "/root/testdata/sf0.01"
ROWS = "chunk_id long, course_id string, embedding array<double>, n long, mean string"


def _slow(x, k):
    """Average linkage with all pairs of all clusters, one merge at a time."""
    u = np.zeros_like(x)
    size = np.sqrt((x * x).sum(1))
    u[size > 0] = x[size > 0] / size[size > 0, None]
    s = u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = max(((s[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def _found(rows):
    out = {}
    for r in rows:
        out.setdefault((r["course_id"], r["cluster"]), set()).add(r["chunk_id"])
    return out


def _clustered(spark, rows, **more):
    return G.cluster_topics(spark.createDataFrame([(i, c, v, 0, "") for i, c, v in rows], ROWS).repartition(3), **more).collect()


@pytest.mark.parametrize("few", [2048, 25])
def test_agrees_with_slow_average_linkage(spark, few):
    """In one task, and in rounds over blocks of five."""
    r = np.random.default_rng(1)
    data = {"flat": r.standard_normal((55, 6)), "grouped": np.repeat(np.eye(7), 6, 0) + 0.3 * r.standard_normal((42, 7)), "two": r.standard_normal((2, 3)), "one": r.standard_normal((1, 3))}
    rows = [(1000 * i + j, c, v.tolist()) for i, (c, x) in enumerate(data.items()) for j, v in enumerate(x)]
    got = _found(_clustered(spark, rows, few=few, block=5))
    for i, (c, x) in enumerate(data.items()):
        n = len(x)
        k = 1 if n == 1 else max(2, min(n, round(n / 6)))
        own = {k_: v for k_, v in got.items() if k_[0] == c}
        assert sorted(no for _, no in own) == list(range(k))
        assert {frozenset(x - 1000 * i for x in g) for g in own.values()} == _slow(x, k)
        assert [min(own[c, no]) for no in range(k)] == sorted(min(g) for g in own.values())


def test_both_ways_agree_on_the_table(spark):
    v = V.vectors(spark, SF)
    sizes = {r["course_id"]: r["count"] for r in v.groupBy("course_id").count().collect()}
    one, two = (_found(G.cluster_topics(v, few=few, block=64).collect()) for few in (2048, 90))
    assert {frozenset(g) for g in one.values()} == {frozenset(g) for g in two.values()}
    for c, n in sizes.items():
        assert sum(k[0] == c for k in one) == max(2, min(n, round(n / 6)))


def test_copies_zeros_nulls_and_short_vectors(spark):
    copies = [(i, "c", [1.0, 0.0]) for i in range(30)]
    odd = [(100, "o", None), (101, "o", []), (102, "o", [0.0, 0.0]), (103, "o", [float("nan"), 1.0]), (104, "o", [1.0]), (105, "o", [1.0, 0.0, 0.0])]
    lost = [(200, None, [1.0])]
    for few in (2048, 12):
        got = _clustered(spark, copies + odd + lost, few=few, block=4)
        assert len(got) == 36 and sum(1 for k in _found(got) if k[0] == "c") == 5
        of = {r["chunk_id"]: r["cluster"] for r in got}
        assert len({of[i] for i in range(100, 106)}) == 2 and of[104] == of[105]
    assert _clustered(spark, []) == []


def test_halves_to_even(spark):
    n = [1, 2, 3, 9, 15, 21, 27, 33]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(G.wanted_clusters(F.col("n"), 6)).collect()
    assert [r[0] for r in got] == [1] + [max(2, min(x, round(x / 6))) for x in n[1:]]


def test_clusters_that_stay_only_meet_the_fresh_ones(spark):
    """What was nearest among those that stay is taken over, and equals a search among all."""
    r = np.random.default_rng(3)
    x = np.round(r.standard_normal((60, 4)), 1)
    x[50:] = x[:10]
    x /= np.sqrt((x * x).sum(1))[:, None]
    nodes = spark.createDataFrame([(c, i, v.tolist(), i % 7 == 0) for c in "ab" for i, v in enumerate(x)], "course_id string, rep long, mean array<double>, fresh boolean")
    rows = lambda d: sorted((y["course_id"], y["rep"], y["other"], y["sim"]) for y in d.collect())
    known = G.nearest_clusters(nodes.filter("not fresh").withColumn("fresh", F.lit(True)), 9)
    want = []
    for c in "ab":
        for i in range(60):
            s = np.round(x @ x[i], 12)
            s[i] = -np.inf
            j = min(np.flatnonzero(s == s.max()).tolist(), key=lambda j: (min(i, j), max(i, j)))
            want.append((c, i, j, s[j]))
    assert rows(G.nearest_clusters(nodes, 9, known)) == want
    some = nodes.filter("fresh or course_id = 'a'")
    marked = known.filter("course_id = 'a'").withColumn("sim", F.lit(2.0).cast("double"))
    got = {(y["course_id"], y["rep"]): y["sim"] for y in G.nearest_clusters(some, 9, marked).collect()}
    assert all((got[c, i] == 2.0) == (i % 7 != 0) for c, i in got) and len(got) == 60 + 9


def test_only_names_of_merges_are_sent_along(spark, monkeypatch):
    """A course of 60 vectors in rounds: what is broadcast has no means."""
    sent = []
    plain = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda d: sent.append(set(d.columns)) or plain(d))
    x = np.random.default_rng(7).standard_normal((60, 6))
    got = _clustered(spark, [(i, "one", v.tolist()) for i, v in enumerate(x)], few=40, block=32)
    assert {frozenset(g) for g in _found(got).values()} == _slow(x, 10)
    assert {"course_id", "rep", "into"} in sent and not any(c & {"mean", "mean2"} for c in sent)
