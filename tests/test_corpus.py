import math

import numpy as np
from pyspark.sql import functions as F

from coursegrain.operators import evaluation as E
from coursegrain.operators import integrity as I
from coursegrain.operators import retrieval as R
from coursegrain.operators import topics as P
from coursegrain.plans import corpus as C
from coursegrain.sources import ingest as G
from coursegrain.sources import views as V

SF = "/root/testdata/sf0.01"


def test_files_are_found_by_suffix_and_hashed(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    for name, data in (("a.PDF", b"one"), ("sub/b.pptx", b"two"), ("~$b.pptx", b"lock"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in G.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.PDF": hashlib.sha256(b"one").hexdigest(), "b.pptx": hashlib.sha256(b"two").hexdigest()}


def test_golden_pairs_are_read_and_keyed_by_section(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": 1, "query": "q", "source_section": ["u", "a"]}\n{"id": 2, "query": "r", "source_section": ["gone"]}\n')
    golden = G.golden_set(spark, str(tmp_path / "g.jsonl")).withColumnRenamed("id", "query_id")
    chunks = spark.createDataFrame([(3, ["u", "a"]), (8, ["u", "a"]), (9, ["u"])], "chunk_id long, section_path array<string>")
    assert [tuple(r) for r in E.golden_pairs(golden, chunks).collect()] == [(1, "q", 8)]


def test_logs_are_cut_by_a_pattern(spark, tmp_path):
    (tmp_path / "run.log").write_text("run=a ms=5\nnothing\nrun=b ms=7\n")
    got = G.run_log(spark, str(tmp_path / "run.log"), r"^run=(\S+) ms=(\d+)$", ["run", "ms"]).collect()
    assert [tuple(r) for r in got] == [("a", "5"), ("b", "7")]


def test_vectors_are_rewritten_by_course(spark, tmp_path):
    v = spark.createDataFrame([(1, 1, [0.5]), (2, 2, [0.5])], "chunk_id long, course_id int, embedding array<double>")
    G.write_vectors(v, str(tmp_path / "v"))
    G.write_vectors(v.filter("course_id = 2").withColumn("chunk_id", F.col("chunk_id") + 10), str(tmp_path / "v"))
    assert {(r["course_id"], r["chunk_id"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {(1, 1), (2, 12)}


def test_stray_upload_folders_are_found_and_removed(spark, tmp_path):
    top = tmp_path / "up loads" / "uploads"
    for name in ("c1/a.pdf", "c1/deep/b.pdf", "gone one/c.pdf", "gone one/d.pdf", "c+2/e.pdf", "loose.pdf", "was/uploads/f.pdf"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x")
    folders = I.upload_folders(spark, str(top))
    courses = spark.createDataFrame([("c1",), ("c+2",), (None,)], "course_id string")
    strays = I.stray_folders(folders, courses)
    assert {tuple(r) for r in folders.collect()} == {("c1", 2), ("gone one", 2), ("c+2", 1), ("was", 1)}
    assert {tuple(r) for r in strays.collect()} == {("gone one", 2, "stray"), ("was", 1, "stray")}
    assert I.remove_folders(spark, str(top), strays) == 2 and {p.name for p in top.iterdir()} == {"c1", "c+2", "loose.pdf"}


def test_orphans_go(spark):
    v, c = spark.createDataFrame([(1,), (2,), (2,), (None,)], "chunk_id long"), spark.createDataFrame([(2,), (3,)], "chunk_id long")
    assert [r[0] for r in I.without_orphans(v, c).collect()] == [2, 2]


def test_a_cascade_deletes_what_hangs_on_deleted_rows_and_nothing_else(spark):
    t = {
        "courses": spark.createDataFrame([(1,), (2,)], "course_id int"),
        "topics": spark.createDataFrame([(1, 10, None), (2, 20, 10), (2, 21, 20), (2, 22, 404)], "course_id int, topic_id int, parent_topic_id int"),
        "documents": spark.createDataFrame([(1, 5), (2, 6), (None, 7), (9, 8)], "course_id int, document_id int"),
        "chunks": spark.createDataFrame([(5, 50, 10, 1), (6, 60, 20, 2), (6, 61, 10, 2), (None, 70, None, None), (404, 71, 20, 2), (6, 72, 20, 1)], "document_id int, chunk_id int, topic_id int, course_id int"),
        "vectors": spark.createDataFrame([(50,), (60,), (72,), (None,)], "chunk_id int"),
        "quizzes": spark.createDataFrame([(1, 100), (2, 200)], "course_id int, quiz_id int"),
        "questions": spark.createDataFrame([(100, 1000, 20), (200, 2000, 10), (200, 2001, None)], "quiz_id int, question_id int, topic_id int"),
        "attempts": spark.createDataFrame([(100, 1), (200, 2)], "quiz_id int, attempt_id int"),
        "answers": spark.createDataFrame([(1, 1000), (2, 1000), (1, 2000), (2, 2000), (2, None)], "attempt_id int, question_id int"),
        "cards": spark.createDataFrame([(2, 7, 10), (1, 8, 20), (2, 9, 20)], "course_id int, card_id int, topic_id int"),
        "reviews": spark.createDataFrame([(7,), (8,), (9,)], "card_id int"),
        "mastery": spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "course_id int, topic_id int"),
    }
    for keys in (I.STUDY_KEYS, I.STUDY_KEYS[::-1]):
        left = I.cascade_delete(t, keys, t["courses"].filter("course_id = 1"), "courses")
        assert {n: d.columns for n, d in left.items()} == {n: d.columns for n, d in t.items()}
        rows = {n: {tuple(r) for r in d.collect()} for n, d in left.items()}
        assert rows["documents"] == {(2, 6), (None, 7), (9, 8)} and rows["topics"] == {(2, 20, None), (2, 21, 20), (2, 22, 404)}
        assert rows["chunks"] == {(6, 60, 20, 2), (6, 61, None, 2), (None, 70, None, None), (404, 71, 20, 2)} and rows["vectors"] == {(60,), (None,)}
        assert rows["quizzes"] == {(2, 200)} and rows["questions"] == {(200, 2000, None), (200, 2001, None)} and rows["attempts"] == {(200, 2)}
        assert rows["answers"] == {(2, 2000), (2, None)} and rows["cards"] == {(2, 7, None), (2, 9, 20)} and rows["reviews"] == {(7,), (9,)} and rows["mastery"] == {(2, 20)}


def test_a_cascade_follows_a_table_that_hangs_on_itself(spark):
    """A chain of six, a ring of three, and rows that hang on two others."""
    rows = [(i, i - 1 if i else None, None) for i in range(6)] + [(10, 12, None), (11, 10, None), (12, 11, None)] + [(20, None, 3), (21, 20, 404), (22, None, None)]
    t = {"nodes": spark.createDataFrame(rows, "node int, up int, other int")}
    keys = [I.Key("nodes", "up", "nodes", "node"), I.Key("nodes", "other", "nodes", "node")]
    left = lambda gone: {r["node"] for r in I.cascade_delete(t, keys, spark.createDataFrame([(g,) for g in gone], "node int"), "nodes")["nodes"].collect()}
    assert left([2]) == {0, 1, 10, 11, 12, 22} and left([11]) == {0, 1, 2, 3, 4, 5, 20, 21, 22} and left([21, 999]) == {r[0] for r in rows} - {21}
    keep = [I.Key("nodes", "up", "nodes", "node", I.SET_NULL)]
    assert {tuple(r) for r in I.cascade_delete(t, keep, spark.createDataFrame([(0,), (1,)], "node int"), "nodes")["nodes"].collect()} >= {(2, None, None), (3, 2, None)}


def _sections(spark):
    rows = [(i, "plain", ["u", "h%d" % (i % 4)]) for i in range(12)] + [(100 + i, "bare", ["u"]) for i in range(30)] + [(200 + i, "none", []) for i in range(9)] + [(300, "bare", [])]
    return spark.createDataFrame(rows, "chunk_id long, course_id string, section_path array<string>")


def test_courses_without_headings_have_no_tree_of_them(spark):
    s = _sections(spark)
    assert {r["course_id"] for r in P.topic_tree(s).collect()} == {"plain"}
    keys = {r["chunk_id"]: r["topic_key"] for r in P.chunk_topics(s).collect()}
    assert keys[0] == "u / h0" and keys[100] is None and keys[200] is None and keys[300] is None


def test_clusters_are_the_fallback(spark):
    s = _sections(spark)
    r = np.random.default_rng(3)
    base = np.eye(8)
    rows = [(i, [float(x) for x in base[i % 5] + 0.05 * r.standard_normal(8)]) for i in range(100, 130)] + [(i, [0.0] * 8) for i in range(200, 205)] + [(300, [1.0] * 8)]
    out = {x["chunk_id"]: (x["topic_key"], x["via"]) for x in P.fallback_topics(s, spark.createDataFrame(rows, "chunk_id long, embedding array<double>")).collect()}
    assert len(out) == s.count() and out[0] == ("u / h0", "headings") and out[208] == (None, "cluster") and out[200][0].startswith("cluster ")
    of = {}
    for i in range(100, 130):
        of.setdefault(out[i][0], set()).add(i % 5)
    assert 3 <= len(of) <= 10 and all(len(x) <= 2 for x in of.values())
    m = P.mirror_topics(spark.createDataFrame([(100, "old"), (999, "old")], "chunk_id long, topic_key string"), spark.createDataFrame([(100, "new")], "chunk_id long, topic_key string"))
    assert {tuple(x) for x in m.collect()} == {(100, "new"), (999, None)}


def test_clusters_part_each_course(spark):
    v = V.vectors(spark, SF)
    got = P.cluster_topics(v).collect()
    assert len(got) == v.count() and len({(x["chunk_id"]) for x in got}) == v.select("chunk_id").distinct().count()
    sizes = {}
    for x in got:
        sizes.setdefault(x["course_id"], {}).setdefault(x["cluster"], []).append(x["chunk_id"])
    for of in sizes.values():
        n = sum(map(len, of.values()))
        assert sorted(of) == list(range(len(of))) and n / 12 <= len(of) <= n / 3
    assert P.cluster_topics(v.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 1, [0.0, 0.0])], "chunk_id long, course_id int, embedding array<double>")
    assert [tuple(x) for x in P.cluster_topics(one).collect()] == [(1, 1, 0)]


def test_recall_of_the_hashed_search(spark):
    q, v = C._queries(spark, SF), V.vectors(spark, SF)
    exact = {(r["query_id"], r["chunk_id"]) for r in R.vector_topk(q, v).collect()}
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.vector_topk_lsh(q, v).collect()}
    assert len(exact & set(found)) / len(exact) >= 0.9
    assert len(found) == len(exact)  # every query has its k hits
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.vector_topk(q, v, 1000).collect()}
    assert all(math.isclose(scores[k], s, abs_tol=1e-9) for k, s in found.items())


def test_queries_with_few_hits_are_answered_exactly(spark):
    v = spark.createDataFrame([(i, 1, i, [-1.0, float(i)]) for i in range(3)] + [(9, 2, 9, [1.0, 0.0])], "chunk_id long, course_id int, topic_id int, embedding array<double>")
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 0.0])], "query_id long, course_id int, query array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in R.vector_topk_lsh(q, v, 5).collect())
    assert got == sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in R.vector_topk(q, v, 5).collect()) and len(got) == 4


def test_citations_are_held_against_the_document_too(spark):
    q = spark.createDataFrame([(1, [1], [2]), (2, [1], [3]), (3, [2], [1]), (4, [], [1]), (5, [1, 404], [2]), (6, [3], [1]), (7, [1], [])], "question_id int, source_chunk_ids array<long>, page_refs array<int>")
    c = spark.createDataFrame([(1, 2, 3, 2), (2, 1, 1, 5), (3, 1, 1, None)], "chunk_id long, page_start int, page_end int, page_count int")
    assert E.citation_integrity(q, c).first().asDict() == {"questions": 7, "cited": 5, "resolvable": 5, "in_range": 3}


def test_histograms(spark):
    d = spark.createDataFrame([("a", ["X", "Y", ""]), ("a", ["X"]), ("b", []), ("b", None)], "label string, codes array<string>")
    assert {tuple(r) for r in E.failure_histogram(d, "label").collect()} == {("a", "X", 2), ("a", "Y", 1)}
    m = spark.createDataFrame([("c", {"X": 2}), ("c", {"X": 1, "Y": 1}), ("d", None)], "course_id string, failure_codes map<string,int>")
    assert {tuple(r) for r in E.failure_totals(m).collect()} == {("c", "X", 3), ("c", "Y", 1)}
