import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from coursegrain.config import DEFAULTS
from coursegrain.functions import text as T
from coursegrain.operators import chunking as K
from coursegrain.operators import cleaning as C
from coursegrain.operators import layout as Y

PAGE = "document_id long, course_id string, number int, heading string, text string, notes string"


def _pages(spark, rows):
    return spark.createDataFrame([(1, "unit", *r) for r in rows], PAGE)


def test_furniture_and_markers_go(spark):
    p = _pages(spark, [(i, None, f"Course footer\nExample {i}\nSlide {i} of 10\n42\nbody {i}", None) for i in range(1, 11)])
    out = {r["number"]: r["text"] for r in C.clean_pages(p).collect()}
    assert out[3] == "Example 3\nbody 3"


def test_short_documents_keep_their_lines(spark):
    p = _pages(spark, [(i, None, "Course footer\nx", None) for i in range(1, 4)])
    assert {r["text"] for r in C.clean_pages(p).collect()} == {"Course footer\nx"}


def test_text_repairs(spark):
    row = spark.createDataFrame([("distrib-\nuted", "  x", "a\n\n\n\nb ")], "h string, s string, b string")
    got = row.select(C.repair_hyphens(F.col("h")), C.restore_symbols(F.col("s")), C.collapse_blank_runs(F.col("b"))).first()
    assert list(got) == ["distributed", "∈ α x", "a\n\nb"]


def test_every_offset_has_a_page(spark):
    p = _pages(spark, [(1, "A", "x" * 50, None), (2, None, "y" * 5000, "n"), (3, None, "", None)])
    spans = C.page_spans(p)
    ends = {r["number"]: (r["start"], r["end"]) for r in spans.collect()}
    assert ends[1][0] == 0 and ends[1][1] == ends[2][0] and ends[2][1] == ends[3][0]
    probes = [0, 49, ends[1][1], ends[2][1] - 1, ends[2][1], 10**6]
    got = {r["offset"]: r["number"] for r in C.pages_at(spark.createDataFrame([(1, o) for o in probes], "document_id long, offset long"), spans).collect()}
    assert [got[o] for o in probes] == [1, 1, 2, 2, 3, 3]


def test_slides_merge_and_outline_breaks(spark):
    t = replace(DEFAULTS, target_tokens=10, min_tokens=3, max_tokens=14)
    p = _pages(spark, [(1, "One", "a b c", None), (2, None, "d e", None), (3, "Outline", "gone", None), (4, "Two", "f g", None), (5, None, "h " * 20, None), (6, None, "i", None)])
    out = [(r["page_start"], r["page_end"], r["section_path"]) for r in K.chunk_slides(p, t).sort("page_start").collect()]
    assert out == [(1, 2, ["unit", "One"]), (4, 4, ["unit", "Two"]), (5, 5, ["unit"]), (6, 6, ["unit"])]
    merged = [(r["page_start"], r["page_end"], r["token_count"]) for r in K.merge_undersized(K.chunk_slides(p, replace(t, max_tokens=30)), replace(t, max_tokens=30)).sort("page_start").collect()]
    assert merged[-1] == (5, 6, 21)


def test_prose_overlaps_and_keeps_fences(spark):
    t = replace(DEFAULTS, target_tokens=10, overlap_ratio=0.3)
    text = "a a a a a\n\nb b b\n\nc c c c\n\n```\nx\n\ny\n```\n\nd"
    p = _pages(spark, [(1, None, text, None)])
    blocks = [r["block"] for r in K.paragraph_blocks(p).sort("block_no").collect()]
    assert blocks == ["a a a a a", "b b b", "c c c c", "```\nx\n\ny\n```", "d"]
    out = [r["text"].split("\n\n")[0] for r in K.chunk_prose(p, t).sort("chunk_no").collect()]
    assert out[:2] == ["a a a a a", "b b b"]  # the second passage begins with the first one's last block
    assert K.chunk_prose(p, t).filter(F.col("content_type") == "code").count() == 1


def test_dispatch_by_shape(spark):
    long = _pages(spark, [(1, "H", "w " * 300 + "\n\n" + "v " * 400, None)])
    assert [r["slide_shaped"] for r in K.doc_shape(long).collect()] == [False]
    assert K.chunk_corpus(long).count() == 2
    short = _pages(spark, [(i, "H", "w " * 20, None) for i in range(12)])
    assert K.chunk_corpus(short).count() == 1


def test_content_types(spark):
    rows = spark.createDataFrame([("| a |\n| b |\nx",), ("x\n```\ny\n```",), ("x",), ("",)], "t string")
    assert [r[0] for r in rows.select(K.content_type(F.col("t"))).collect()] == ["table", "code", "prose", "prose"]


def test_fuzzy_ratio_counts_insertions_and_deletions(spark):
    rows = spark.createDataFrame([("abcd", "abxd"), ("Same", "same"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(T.fuzzy_ratio("a", "b")).collect()] == [75.0, 100.0, 100.0, None]


def test_side_by_side_tables_are_cut(spark):
    box = "slide long, left long, top long, width long, height long, text string"
    rows = [(1, x, y, 400_000, 100_000, f"{c}{r}") for c, x in (("L", 0), ("M", 450_000), ("R", 2_000_000)) for r, y in enumerate((0, 150_000, 300_000))]
    out = Y.xy_cut(spark.createDataFrame(rows, box))
    blocks = {}
    for r in out.collect():
        blocks.setdefault(r["block"], set()).add(r["text"][0])
    assert list(map(blocks.get, sorted(blocks))) == [{"L", "M"}, {"R"}]
    lines = [r["line"] for r in Y.row_bands(out, ["slide", "block"]).sort("block", "row").collect()]
    assert lines == ["L0 | M0", "L1 | M1", "L2 | M2", "R0", "R1", "R2"]


def test_even_columns_are_not_cut(spark):
    box = "slide long, left long, top long, width long, height long, text string"
    rows = [(1, i * 900_000, 0, 400_000, 100_000, str(i)) for i in range(3)]
    assert {r["block"] for r in Y.xy_cut(spark.createDataFrame(rows, box)).collect()} == {""}


def test_lines_and_notes_are_stripped_and_repaired(spark):
    p = _pages(spark, [(1, None, "  a  \n b\t\n\n\n\n\x0b c-\nd ", " distrib-\nuted\n\n\n\nx\n"), (2, "H\uf0ce", "", None)])
    out = {r["number"]: (r["text"], r["notes"], r["heading"]) for r in C.clean_pages(p).collect()}
    assert out == {1: ("a\nb\n\ncd", "distributed\n\nx", None), 2: ("", None, "H∈")}


def test_fingerprints_trim_any_white_space(spark):
    p = _pages(spark, [(i, None, f"Course  footer{end}\nbody {i}", None) for i, end in enumerate(["", " ", "\t", "\x0b", " \r", "\t "])])
    assert [(r["fingerprint"], r["pages"]) for r in C.furniture(p).collect()] == [("course footer", 6)]


def test_blank_lines_are_no_lines_of_a_table(spark):
    rows = spark.createDataFrame([("| a |\n\n| b |\n\nprose\n \t\nmore",), ("| a |\n\n\nx\ny\nz",), ("\n \n",)], "t string")
    assert [r[0] for r in rows.select(K.content_type(F.col("t"))).collect()] == ["table", "prose", "prose"]


def test_a_deck_is_slide_shaped_whatever_its_pages(spark):
    p = _pages(spark, [(1, "H", "w " * 300, None)]).withColumn("kind", F.lit("deck"))
    assert K.doc_shape(p).first()["slide_shaped"] and not K.doc_shape(p.withColumn("kind", F.lit(None).cast("string"))).first()["slide_shaped"]


def test_passage_spans_follow_the_rule():
    """Against the rule said block by block: what is left of a passage goes on while it fits the overlap."""
    r = random.Random(4)
    for _ in range(300):
        tokens = [r.randint(1, 12) for _ in range(r.randint(0, 30))]
        target, overlap = r.randint(5, 30), r.randint(0, 8)
        want, open_ = [], []
        for i, n in enumerate(tokens):
            if open_ and sum(tokens[j] for j in open_) + n > target:
                want.append((open_[0], open_[-1]))
                open_ = [j for j in open_ if sum(tokens[j : open_[-1] + 1]) <= overlap]
            open_.append(i)
        if open_:
            want.append((open_[0], open_[-1]))
        assert K.passage_spans(np.array(tokens, np.int64), target, overlap) == want


def _cut(boxes, name=""):
    """The cuts of one slide, recursively: by columns, then by rows."""
    for axis, size, least in (("left", "width", Y.COLUMN_GUTTER), ("top", "height", Y.ROW_GUTTER)):
        order = sorted(boxes, key=lambda b: b[axis])
        gaps, reach = [], None
        for b in order:
            if reach is not None and b[axis] > reach:
                gaps.append((b[axis] - reach, reach + (b[axis] - reach) // 2))
            reach = max(reach or 0, b[axis] + b[size])
        gaps.sort(reverse=True)
        if gaps and gaps[0][0] >= least and (len(gaps) == 1 or gaps[0][0] >= 2 * gaps[1][0]):
            at = gaps[0][1]
            low, high = [b for b in boxes if b[axis] < at], [b for b in boxes if b[axis] >= at]
            return _cut(low, name + "0") | _cut(high, name + "1")
    return {b["text"]: name for b in boxes}


def test_cuts_are_those_of_the_recursion(spark):
    r = random.Random(9)
    rows = []
    for slide in range(40):
        for i in range(r.randint(1, 9)):
            rows.append((slide, r.randrange(6) * 600_000 + r.randrange(3) * 50_000, r.randrange(6) * 500_000, r.choice([200_000, 500_000, 1_500_000]), r.choice([100_000, 400_000]), f"{slide}-{i}"))
    names = ["slide", "left", "top", "width", "height", "text"]
    want = {}
    for slide in range(40):
        want |= _cut([dict(zip(names, x)) for x in rows if x[0] == slide])
    got = Y.xy_cut(spark.createDataFrame(rows, "slide long, left long, top long, width long, height long, text string"))
    assert {x["text"]: x["block"] for x in got.collect()} == want
    assert len({b for b in want.values()}) > 3


def test_fast_patterns_find_what_the_plain_ones_do(spark):
    """Patterns that look at visible ASCII or at the hyphen first, against those of the SQL, on random texts of odd characters."""
    r = random.Random(5)
    signs = ["a", "B", "é", "\U0001d4b3", "-", "-\n", "-\n", " ", "  ", "\n", "\r\n", "\x0b", "\x85", " ", " ", "　", "7", "٣", "_", "page", "Slide ", " of ", "/", "(", ")", "–", "", "", "|", "```"]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 24)))) for i in range(20000)] + [(-1, None), (-2, "foo-\nb-\nbaz"), (-3, "a -\nb"), (-4, "\U0001d4b3-\n  y-\nz")]
    x = spark.createDataFrame(rows, "id long, x string")
    c = F.col("x")
    bare = T.stripped(c)
    words = F.size(F.regexp_extract_all(c, F.lit(T.WORD), F.lit(0)))
    pairs = {
        "hyphens": (C.repair_hyphens(c), F.regexp_replace(c, C.HYPHEN_BREAK, "$1$2")),
        "lines": (T.text_lines(c), F.split(c, T.LINE_END, -1)),
        "finger": (T.fingerprint(c), F.regexp_replace(F.lower(bare), f"[{T.BLANK}]+", " ")),
        "marker": (C.is_page_marker(c), c.rlike("(?i)" + C.PAGE_NUMBER) | ((words <= C.MARKER_WORDS) & c.rlike("(?i)" + C.PAGE_MARKER))),
        "symbols": (C.restore_symbols(c), F.translate(c, *C.symbol_tables())),
    }
    found = x.select(*[F.count_if(~fast.eqNullSafe(plain)).alias(n) for n, (fast, plain) in pairs.items()], F.count_if(C.is_page_marker(c)).alias("markers")).first().asDict()
    assert found.pop("markers") > 20
    assert found == dict.fromkeys(pairs, 0)


def test_a_line_is_fingerprinted_once(spark):
    """In a plain select, filters copied the fingerprint to three places."""
    p = spark.createDataFrame([(1, n, "Head  er\nbody", None, None) for n in range(6)], "document_id long, number int, text string, heading string, notes string")
    plan = C.furniture(p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_a_passage_of_slides_is_joined_once(spark):
    """In a plain select, the filter and each column that reads the text joined it again."""
    p = spark.createDataFrame([(1, n, "s", "H", f"| a |\n| {n} |", None) for n in range(1, 4)], "document_id long, number int, course_id string, heading string, text string, notes string")
    d = K.chunk_slides(p)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1
    assert [(r["page_end"], r["content_type"]) for r in d.collect()] == [(3, "table")]
