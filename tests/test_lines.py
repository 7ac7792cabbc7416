"""Lines and white space of any script, parts of passages, quiz views and token counters."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from coursegrain.config import DEFAULTS
from coursegrain.functions import text as T
from coursegrain.functions.tokens import counter
from coursegrain.operators import chunking as K
from coursegrain.operators import cleaning as C
from coursegrain.operators import questions as Q
from coursegrain.operators import topics as P

PAGE = "document_id long, course_id string, number int, heading string, text string, notes string"


def _pages(spark, rows):
    return spark.createDataFrame([(1, "unit", *r) for r in rows], PAGE)


def test_white_space_and_lines_are_those_of_python(spark):
    chars = [chr(c) for c in range(0x3001) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame([(c, f"{c}x{c}", f"a{c}b") for c in chars], "c string, s string, l string")
    got = d.select("c", T.stripped(F.col("s")).alias("s"), T.text_lines(F.col("l")).alias("l"), F.col("c").rlike(f"^[{T.BLANK}]$").alias("blank")).collect()
    for r in got:
        assert r["s"] == f"{r['c']}x{r['c']}".strip() and r["blank"] == r["c"].isspace()
        assert r["l"] == f"a{r['c']}b".splitlines()
    assert spark.range(1).select(T.text_lines(F.lit("a\r\nb\n\rc"))).first()[0] == ["a", "b", "", "c"]


@pytest.mark.parametrize("end", ["\x0b", "\r", "\x0c", "\x85", " ", "\r\n"])
def test_repeated_lines_go_at_any_end_of_line(spark, end):
    p = _pages(spark, [(i, None, end.join(["Acme Corp", "Fall 2024", f"point {'iii'[:i]}{i}"]), None) for i in range(1, 7)])
    assert {r["text"] for r in C.clean_pages(p).collect()} == {f"point {'iii'[:i]}{i}" for i in range(1, 7)}


def test_blank_lines_of_any_script_are_blank(spark):
    p = _pages(spark, [(i, None, f"\xa0\nbody {chr(96 + i)}\n\xa0Acme  Corp\xa0", None) for i in range(1, 7)])
    assert {r["fingerprint"] for r in C.furniture(p).collect()} == {"acme corp"}
    assert {r["text"] for r in C.clean_pages(p).collect()} == {f"body {chr(96 + i)}" for i in range(1, 7)}
    marks = spark.createDataFrame([("Slide\xa03 of\xa010",), ("page 4",), ("Slide show",)], "line string")
    assert [r[0] for r in marks.select(C.is_page_marker(F.col("line"))).collect()] == [True, True, False]


def test_paragraphs_and_tables_at_any_blank(spark):
    p = _pages(spark, [(1, None, "one\n\x0c\ntwo\n\xa0\nthree\x0b\x0bthree", None)])
    assert [r["block"] for r in K.paragraph_blocks(p).sort("block_no").collect()] == ["one", "two", "three\x0b\x0bthree"]
    kinds = spark.createDataFrame([("| a |\x0b| b |",), ("\xa0| a |\xa0\r | b |",), ("x\x0b\xa0```",), ("| a | b",)], "t string")
    assert [r[0] for r in kinds.select(K.content_type(F.col("t"))).collect()] == ["table", "table", "code", "prose"]


def _parts(spark, text, start=3, end=4):
    d = spark.createDataFrame([(1, 0, text, start, end)], "document_id long, chunk_no int, text string, page_start int, page_end int")
    return [(r["part"], r["heading"], r["body"], r["page"]) for r in Q.split_passage(d).sort("part").collect()]


def test_parts_of_passages_and_their_pages(spark):
    assert _parts(spark, "intro\n### A\n\nx\n\n### B\ny\n### C") == [(0, None, "intro", 3), (1, "A", "x", 3), (2, "B", "y", 4), (3, "C", "", 4)]
    assert _parts(spark, "### A\r\n x \r\n\r\ny\xa0\n") == [(0, "A", "x\ny", 3)]
    assert _parts(spark, " intro\n\n  more ") == [(0, None, "intro\n\n  more", 3)]
    assert _parts(spark, "###  \n B\n\x0b c\x0b\xa0") == [(0, "B", "c", 3)]
    assert _parts(spark, "x ### no heading\n### \t") == [(0, None, "x ### no heading", 3), (1, None, "", 3)]
    assert _parts(spark, " \n") == [] and _parts(spark, "") == []


def test_labels_lose_quotes_and_every_full_stop(spark):
    said = ['"Topic.."', "Topic..", '"Topic".', "'Topic'. ", "\xa0Topic\t", "...", None, '""', "x" * 300, "\"'A. B.'\""]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r[1] for r in d.select("i", P.clean_label(F.col("s"))).sort("i").collect()]
    byhand = [(s or "").strip().strip('"').strip("'").rstrip(".").strip()[:255] or "Untitled Topic" for s in said]
    assert got == byhand and got[:2] == ["Topic.", "Topic"][1:] * 2


def test_a_quiz_is_shown_with_options_and_without_answers(spark):
    option = "array<struct<id:string,text:string,is_correct:boolean,why_wrong:string>>"
    q = spark.createDataFrame([(1, 10, "s", [("A", "a", True, None), ("B", "b", False, "no")], "recall", 2, [7], [1]), (1, 11, "t", None, None, 1, [], [])], f"quiz_id int, question_id int, stem string, options {option}, difficulty string, order_index int, source_chunk_ids array<int>, page_refs array<int>")
    c = spark.createDataFrame([(7, ["u", "h"])], "chunk_id int, section_path array<string>")
    view = Q.quiz_view(q, c)
    assert view.schema["options"].dataType.simpleString() == "array<struct<id:string,text:string>>"
    first, second = view.sort("place").collect()
    assert (first["question_id"], first["options"], first["section_path"]) == (11, [], [])
    assert [tuple(o) for o in second["options"]] == [("A", "a"), ("B", "b")] and second["difficulty"] == "recall"


def _vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counters(spark):
    from tokenizers import Tokenizer

    path = _vocabulary()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = ["two words", "", None, " \xa0\n", "Überraschung, naïve <|endoftext|> über 1234", "x" * 5000]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [tuple(r)[1:] for r in d.select("i", counter(path)("s"), counter()(F.col("s"))).sort("i").collect()]
    assert [a for a, _ in got] == [len(plain.encode(s, add_special_tokens=False).ids) if s and s.strip() else 0 for s in texts]
    assert [b for _, b in got] == [len((s or "").split()) for s in texts]


def test_passages_are_packed_by_the_named_counter(spark):
    path = _vocabulary()
    t = replace(DEFAULTS, token_counter=path, target_tokens=40, min_tokens=12, max_tokens=60)
    words = "antidisestablishmentarianism incomprehensibilities"
    p = _pages(spark, [(i, f"H{i}", f"{words} {i}", None) for i in range(1, 9)])
    chunks = K.chunk_slides(p, t)
    by_words = K.chunk_slides(p, replace(t, token_counter="words"))
    assert chunks.count() > by_words.count()
    count = counter(path)
    assert all(r["token_count"] == r["again"] for r in chunks.withColumn("again", count("text")).collect())
    small = K.merge_undersized(chunks.withColumn("section_path", F.array(F.lit("u"))), replace(t, min_tokens=50, max_tokens=90))
    rows = small.withColumn("again", count("text")).collect()
    assert all(r["token_count"] == r["again"] <= 90 for r in rows) and len(rows) < chunks.count()
