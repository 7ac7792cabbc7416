"""Generated questions: parsing, rules, near-duplicate stems, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..functions.rows import once
from ..functions.text import BLANKS, any_script, cosine, stripped, text_lines
from .stems import semantic_dedup

OPTION = "struct<id:string,text:string,is_correct:boolean,why_wrong:string>"
QUESTION = f"stem string, options array<{OPTION}>, explanation string, difficulty string, _corrupt string"
CARDS = "cards array<struct<front:string,back:string>>, _corrupt string"
DIFFICULTIES = ("recall", "understanding", "analysis")

# The rules' words.
BANNED = ("all of the above", "none of the above", "both a and b", "a and b only", "all of these", "none of these")
NEGATION = r"(?i)(^|[^0-9A-Za-z_])(not|except|least)([^0-9A-Za-z_]|$)"
RANKING = r"(?i)(^|[^0-9A-Za-z_])(primary|primarily|main|chief|most important|foremost)([^0-9A-Za-z_]|$)"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:\.\d+)?(?![\p{L}\p{N}_])"
STOPWORDS = (
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "been", "by", "with", "as", "at",
    "from", "that", "this", "it", "its", "which", "each", "any", "all", "more", "most", "such", "into", "than", "then", "when", "where", "while",
)
LEAK_WORDS = 3


def parse_responses(raw: DataFrame) -> DataFrame:
    """raw (id, raw) with kind (thin, invalid or question) and the parsed question as q."""
    low = F.lower(F.btrim("raw"))
    thin = low.contains('"insufficient"') & low.contains("true")
    q = F.from_json("raw", QUESTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = once(raw, raw.columns, q=q)
    bad = F.col("q").isNull() | F.col("q._corrupt").isNotNull() | F.col("q.stem").isNull() | F.col("q.options").isNull()
    return d.withColumn("kind", F.when(thin, "thin").when(bad, "invalid").otherwise("question"))


def schema_ok(q: str = "q") -> Column:
    """Four options A to D, one right, nothing blank, a known difficulty."""
    c = lambda name: F.col(f"{q}.{name}")
    filled = lambda x: stripped(F.coalesce(x, F.lit(""))) != ""
    ids = F.array_sort(F.transform(c("options"), lambda o: o["id"]))
    one = F.size(F.filter(c("options"), lambda o: o["is_correct"])) == 1
    return (ids == F.array(*map(F.lit, "ABCD"))) & one & filled(c("stem")) & filled(c("explanation")) & c("difficulty").isin(*DIFFICULTIES)


def attach_citations(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """questions (with chunk_id, the passage that each was made from) with source_chunk_ids and page_refs.

    Both come from the passage, whatever a model may have said: its id, and all its pages from
    page_start to page_end. A question without its passage has two empty lists."""
    own = [c for c in questions.columns if c not in ("source_chunk_ids", "page_refs")]
    p = passages.select("chunk_id", F.array("chunk_id").alias("source_chunk_ids"), F.sequence("page_start", "page_end").alias("page_refs"))
    j = questions.select(*own).join(p, "chunk_id", "left")
    kinds = dict(p.dtypes)
    return j.select(*own, *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("source_chunk_ids", "page_refs")])


def quiz_view(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """quiz_id, question_id, place (from 0), stem, options, difficulty, page_refs, section_path: a quiz as students see it.

    Options are ids and texts; what is right, and why, isn't there at all. Questions are in the
    order of order_index; the section is that of the first passage cited, and empty where there
    is none. Null options are none."""
    nth = F.row_number().over(Window.partitionBy("quiz_id").orderBy("order_index", "question_id")) - 1
    q = questions.select("quiz_id", "question_id", nth.alias("place"), "stem", public_options(F.coalesce("options", F.array().cast(f"array<{OPTION}>"))).alias("options"), "difficulty", "page_refs", F.get("source_chunk_ids", F.lit(0)).alias("chunk_id"))
    j = q.join(passages.select("chunk_id", "section_path"), "chunk_id", "left")
    return j.select("quiz_id", "question_id", "place", "stem", "options", "difficulty", "page_refs", F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"))


def parse_cards(raw: DataFrame, most: int) -> DataFrame:
    """id, place, front, back of the first most cards; one blank card makes the batch invalid."""
    c = F.from_json("raw", CARDS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = once(raw, ["id"], c=c).filter(F.col("c._corrupt").isNull() & F.col("c.cards").isNotNull())
    blank = lambda x: stripped(F.coalesce(x, F.lit(""))) == ""
    d = d.filter(~F.exists("c.cards", lambda k: blank(k["front"]) | blank(k["back"])))
    return d.select("id", F.posexplode(F.slice("c.cards", 1, most)).alias("place", "k")).select("id", "place", "k.front", "k.back")


def right_option(options: Column) -> Column:
    return F.get(F.filter(options, lambda o: o["is_correct"]), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def rule_failures(stem: Column, options: Column, explanation: Column, difficulty: Column, passage: Column, t: Tunables = DEFAULTS) -> Column:
    """All codes that a question fails, in the order of the rules."""
    blank = lambda x: stripped(F.coalesce(x, F.lit(""))) == ""
    # The first fault among the options decides between the two codes.
    fault = F.get(F.filter(F.transform(options, lambda o: F.when(blank(o["text"]), F.lit("EMPTY_FIELD")).when(~o["is_correct"] & blank(o["why_wrong"]), F.lit("SCHEMA"))), lambda x: x.isNotNull()), F.lit(0))
    empty = F.when(blank(stem) | blank(explanation), "EMPTY_FIELD").otherwise(fault)
    right = right_option(options)["text"]
    wrong = F.filter(options, lambda o: ~o["is_correct"])
    mean = F.aggregate(wrong, F.lit(0.0), lambda s, o: s + F.length(o["text"])) / F.nullif(F.size(wrong), F.lit(0))
    bias = F.when(F.size(wrong) == 0, "SCHEMA").when(mean == 0, "EMPTY_FIELD").when(F.length(right) > t.length_bias_ratio * mean, "LENGTH_BIAS")
    banned = F.when(F.exists(options, lambda o: F.lower(o["text"]).rlike("|".join(BANNED))), "BANNED_PHRASE")
    negation = F.when((difficulty != "analysis") & stem.rlike(NEGATION), "NEGATION")
    w = _words(right)
    stop = F.array(*map(F.lit, STOPWORDS))
    # A longer run holds a run of three with a word that is no stopword, so threes are enough. The
    # words are bound by a list of one, so that they are found once and not for each run.
    bound = F.array(F.struct(w.alias("w"), F.concat(F.lit(""), F.array_join(_words(stem), " ")).alias("joined")))
    run = lambda b, i: F.slice(b["w"], i, LEAK_WORDS)
    leaks = F.exists(bound, lambda b: F.exists(F.sequence(F.lit(1), F.greatest(F.size(b["w"]) - LEAK_WORDS + 1, F.lit(1))), lambda i: (F.size(F.array_except(run(b, i), stop)) > 0) & F.contains(b["joined"], F.array_join(run(b, i), " "))))
    leakage = F.when((F.size(w) >= LEAK_WORDS) & leaks, "LEAKAGE")
    ranking = F.when(stem.rlike(RANKING) & ~passage.rlike(RANKING), "INVENTED_RANKING")
    numbers = lambda x: F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))
    # Most answers have no number, and then the passage isn't searched.
    numeric = F.when((F.size(numbers(right)) > 0) & (F.size(F.array_except(numbers(right), numbers(passage))) > 0), "NUMERIC_UNSUPPORTED")
    return F.array_compact(F.array(empty, bias, banned, negation, leakage, ranking, numeric))


def option_overlap(options: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """question_id, most, overlap from rows of (question_id, option, embedding): largest cosine of two options."""
    a, b = options.alias("a"), options.alias("b")
    j = a.join(b, (F.col("a.question_id") == F.col("b.question_id")) & (F.col("a.option") < F.col("b.option")))
    g = j.groupBy(F.col("a.question_id").alias("question_id")).agg(F.max(cosine(F.col("a.embedding"), F.col("b.embedding"))).alias("most"))
    return g.withColumn("overlap", F.col("most") >= t.option_cosine)


def recent_stems(quizzes: DataFrame, questions: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """course_id, quiz_id, question_id, stem of each course's last quizzes."""
    order = Window.partitionBy("course_id").orderBy(F.desc("created_at"), F.desc("quiz_id"))
    last = quizzes.select("course_id", "quiz_id", "created_at").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= t.lookback_quizzes)
    return questions.join(last.select("course_id", "quiz_id"), "quiz_id").select("course_id", "quiz_id", "question_id", "stem")


def best_attempts(attempts: DataFrame, most: int = 2) -> DataFrame:
    """passage_id, attempt, outcome: the first that passed, else the last failure.

    attempts has passage_id, attempt (from 1) and outcome (passed, rejected, thin); no attempt
    after the most-th or after a thin one counts."""
    a = attempts.filter(F.col("attempt") <= most)
    stop = F.min(F.when(F.col("outcome") == "thin", F.col("attempt"))).over(Window.partitionBy("passage_id"))
    a = a.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("attempt") <= F.col("stop")))
    passed = F.min(F.when(F.col("outcome") == "passed", F.col("attempt")))
    g = a.groupBy("passage_id").agg(F.coalesce(passed, F.max("attempt")).alias("attempt"))
    return g.join(attempts, ["passage_id", "attempt"]).select("passage_id", "attempt", "outcome")


def accepted_questions(passed: DataFrame, most: int) -> DataFrame:
    """The first most questions of each course that have a citation, numbered from 0."""
    cited = passed.filter(F.size("source_chunk_ids") > 0)
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy("question_id")) - 1
    return cited.withColumn("place", nth).filter(F.col("place") < most)


def public_options(options: Column) -> Column:
    """Ids and texts only: what is right, and why, isn't there at all."""
    return F.transform(options, lambda o: F.struct(o["id"].alias("id"), o["text"].alias("text")))


#: The line that begins a slide in a passage: only line feeds end lines here.
SLIDE_LINE = any_script(r"^###\s+")


def split_passage(passages: DataFrame) -> DataFrame:
    """document_id, chunk_no, part, heading, body, page: a passage cut at its lines "### heading".

    What stands before the first heading is a part without one on the first page, as it is but
    for the white space around it. The headings' pages are counted from the first page on, up to
    the last; their bodies lose blank lines and the white space at the ends of lines. A blank
    heading is null; a passage without headings and text has no part."""
    parts = F.split("text", "(?md)" + SLIDE_LINE, -1)
    p = passages.select("document_id", "chunk_no", "page_start", "page_end", F.posexplode(parts).alias("i", "piece"))
    first = F.substring_index("piece", "\n", 1)
    rest = stripped(F.substring(F.col("piece"), F.length(first) + 1, F.length("piece")))
    lines = F.transform(F.filter(text_lines(rest), lambda x: stripped(x) != ""), lambda x: F.rtrim(x, F.lit(BLANKS)))
    headed = F.col("i") > 0
    p = p.select(
        "document_id", "chunk_no", "i", F.when(headed, F.nullif(stripped(first), F.lit(""))).alias("heading"),
        F.when(headed, F.array_join(lines, "\n")).otherwise(stripped(F.col("piece"))).alias("body"),
        F.when(headed, F.least(F.col("page_start") + F.col("i") - 1, F.col("page_end"))).otherwise(F.col("page_start")).cast("int").alias("page"),
    )
    p = p.filter(headed | (F.col("body") != ""))
    nth = F.row_number().over(Window.partitionBy("document_id", "chunk_no").orderBy("i")) - 1
    return p.withColumn("part", nth).select("document_id", "chunk_no", "part", "heading", "body", "page")


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; a name without a value is an error."""
    import re

    if missing := set(re.findall(r"\{(\w+)\}", template)) - set(values):
        raise KeyError(f"no value for {sorted(missing)}")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(values[x].cast("string"), F.lit("")) for i, x in enumerate(parts)])
