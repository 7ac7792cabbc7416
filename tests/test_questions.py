import pytest
from pyspark.sql import functions as F

from coursegrain.operators import questions as Q

ROW = f"stem string, options array<{Q.OPTION}>, explanation string, difficulty string, passage string"
GOOD = [("A", "a shared lock", True, None), ("B", "an exclusive one", False, "no"), ("C", "no lock at all", False, "no"), ("D", "a log record", False, "no")]


def _fails(spark, stem="Which lock is taken?", options=GOOD, explanation="It is shared.", difficulty="recall", passage="A shared lock is taken in 8 steps."):
    row = spark.createDataFrame([(stem, options, explanation, difficulty, passage)], ROW)
    return row.select(Q.rule_failures(*[F.col(c) for c in ("stem", "options", "explanation", "difficulty", "passage")])).first()[0]


def _right(text):
    return [("A", text, True, None), *GOOD[1:]]


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []),
        ({"explanation": " "}, ["EMPTY_FIELD"]),
        ({"options": [*GOOD[:3], ("D", "a log record", False, " ")]}, ["SCHEMA"]),
        ({"options": _right("a shared lock that is held until the very end of the transaction")}, ["LENGTH_BIAS"]),
        ({"options": [*GOOD[:3], ("D", "All of the Above.", False, "no")]}, ["BANNED_PHRASE"]),
        ({"stem": "Which is NOT taken?"}, ["NEGATION"]),
        ({"stem": "Which is NOT taken?", "difficulty": "analysis"}, []),
        ({"stem": "Which notation cannot be used, at the last?"}, []),
        ({"stem": "Is it a shared lock or another?"}, ["LEAKAGE"]),
        ({"options": _right("it is of the"), "stem": "What is it, it is of the kind?"}, []),
        ({"stem": "What is the main lock?"}, ["INVENTED_RANKING"]),
        ({"stem": "What is the main lock?", "passage": "The main lock is shared."}, []),
        ({"options": _right("9 steps of it")}, ["NUMERIC_UNSUPPORTED"]),
        ({"options": _right("8 steps of it")}, []),
        ({"options": _right("table E8 of it")}, []),
        ({"options": _right("of O(2^m) size")}, ["NUMERIC_UNSUPPORTED"]),
        ({"options": _right("see sec.9 now")}, ["NUMERIC_UNSUPPORTED"]),
        ({"options": _right("see sec.8 now")}, []),
        ({"options": _right("at 3.5 or 8")}, ["NUMERIC_UNSUPPORTED"]),
        ({"options": _right("é9 steps of it")}, []),
    ],
)
def test_rules(spark, change, want):
    assert _fails(spark, **change) == want


def _greedy(rows, least):
    kept, out = [], {}
    for i, v in rows:
        cos = [(k, sum(a * b for a, b in zip(v, w)) / ((sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5)) for k, w in kept]
        hit = [k for k, c in cos if c >= least]
        out[i] = (not hit, hit[0] if hit else None)
        if not hit:
            kept.append((i, v))
    return out


def test_dedup_is_the_greedy_one(spark):
    import numpy as np

    r = np.random.default_rng(5)
    base = r.standard_normal((6, 16))
    rows = []
    for i in range(40):
        v = base[i % 6] + r.standard_normal(16) * r.choice([0, 0.1, 0.25])
        rows.append((i, [float(np.float32(x)) for x in v]))
    df = spark.createDataFrame([(i, 0, i, v) for i, v in rows], "id long, course_id int, place long, embedding array<float>")
    got = {x["id"]: (x["accepted"], x["matched"]) for x in Q.semantic_dedup(df, 0.92).collect()}
    assert got == _greedy(rows, 0.92)


def test_best_attempts(spark):
    rows = [(1, 1, "rejected"), (1, 2, "passed"), (1, 3, "passed"), (2, 1, "thin"), (2, 2, "passed"), (3, 1, "rejected"), (3, 2, "rejected")]
    got = {tuple(r) for r in Q.best_attempts(spark.createDataFrame(rows, "passage_id int, attempt int, outcome string")).collect()}
    assert got == {(1, 2, "passed"), (2, 1, "thin"), (3, 2, "rejected")}


def test_public_options_have_no_answer(spark):
    row = spark.createDataFrame([("s", GOOD, "e", "recall", "p")], ROW).select(Q.public_options(F.col("options")).alias("o"))
    assert [f.name for f in row.schema["o"].dataType.elementType.fields] == ["id", "text"] and len(row.first()["o"]) == 4


def test_a_template_needs_all_values():
    with pytest.raises(KeyError):
        Q.render("{a} {b}", {})


def test_copies_match_the_first_one_and_are_not_paired(spark, monkeypatch):
    rows = [(i, 0, i, [1.0, 0.0]) for i in range(400)] + [(500, 0, 500, [0.0, 1.0]), (501, 0, 501, [0.0, 0.0]), (502, 0, 502, [0.0, 0.0]), (503, 0, 503, None), (504, 1, 504, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, course_id int, place long, embedding array<double>")
    got = {x["id"]: (x["accepted"], x["matched"]) for x in Q.semantic_dedup(df, 0.92).collect()}
    assert got == {0: (True, None), **{i: (False, 0) for i in range(1, 400)}, **{i: (True, None) for i in range(500, 505)}}


def test_large_buckets_are_cut_into_blocks(spark):
    import numpy as np

    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(np.ones(8) + 0.12 * r.standard_normal(8))]) for i in range(120)]
    df = spark.createDataFrame([(i, 0, i // 2, v) for i, v in rows], "id long, course_id int, place long, embedding array<float>")
    got = {x["id"]: (x["accepted"], x["matched"]) for x in Q.semantic_dedup(df, 0.97, block=7, tables=30).collect()}
    assert got == _greedy(rows, 0.97) and 1 < sum(a for a, _ in got.values()) < 100


def test_chains_take_rounds_and_keep_the_earliest_match(spark):
    """Each vector is near the next one only, so every second one is accepted."""
    import math

    rows = [(i, [math.cos(0.3 * i), math.sin(0.3 * i)]) for i in range(9)]
    df = spark.createDataFrame([(i, "c", i, v) for i, v in rows], "id long, course_id string, place long, embedding array<double>")
    got = {x["id"]: (x["accepted"], x["matched"]) for x in Q.semantic_dedup(df, 0.94, tables=30).collect()}
    assert got == {i: (i % 2 == 0, None if i % 2 == 0 else i - 1) for i, _ in rows}


def test_near_stems_give_rows_in_the_order_of_their_number(spark, monkeypatch):
    import numpy as np

    from coursegrain.operators import stems as S

    r = np.random.default_rng(9)
    rows = [(i, 0, i, [float(x) for x in np.ones(16) + 0.01 * r.standard_normal(16)]) for i in range(5000)]
    made = {}

    def counted(df, name, *more):
        out = written(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    written = S.written
    monkeypatch.setattr(S, "written", counted)
    got = S.semantic_dedup(spark.createDataFrame(rows, "id long, course_id int, place long, embedding array<double>"), 0.92, tables=8).collect()
    assert sorted((x["accepted"], x["matched"]) for x in got if x["id"]) == [(False, 0)] * 4999
    # A row for each table and each of the blocks of its bucket; no pairs, of which there are twelve million.
    assert max(made.values()) <= 8 * 5 * 5000


def test_citations_come_from_the_passage(spark):
    q = spark.createDataFrame([(1, 10, [99], [5]), (2, 77, [10], [1])], "question_id int, chunk_id long, source_chunk_ids array<long>, page_refs array<int>")
    p = spark.createDataFrame([(10, 3, 5)], "chunk_id long, page_start int, page_end int")
    got = {r["question_id"]: (r["source_chunk_ids"], r["page_refs"]) for r in Q.attach_citations(q, p).collect()}
    assert got == {1: ([10], [3, 4, 5]), 2: ([], [])}


def test_quizzes_are_in_order_with_the_first_citations_section(spark):
    q = spark.createDataFrame([(1, 7, 2, "b", [1], [11, 10], None, "recall"), (1, 5, 1, "a", [2], [], None, "recall"), (2, 1, 9, "c", [], [10], None, None)], "quiz_id int, question_id int, order_index int, stem string, page_refs array<int>, source_chunk_ids array<long>, options array<struct<id:string,text:string,is_correct:boolean,why_wrong:string>>, difficulty string")
    p = spark.createDataFrame([(10, ["u", "x"]), (11, ["u", "y"])], "chunk_id long, section_path array<string>")
    got = [(r["quiz_id"], r["place"], r["stem"], r["section_path"]) for r in Q.quiz_view(q, p).sort("quiz_id", "place").collect()]
    assert got == [(1, 0, "a", []), (1, 1, "b", ["u", "y"]), (2, 0, "c", ["u", "x"])]
