"""The study-material tables, derived from the given ones, in Spark and in DuckDB's SQL.

Each view has a function and a SQL text that give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK, BLANKS, LINE_END, WORD, token_count
from .tables import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages: a document is one passage of its source's course, under topic source/lang."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("course_id"),
        F.concat_ws("/", "source", "lang").alias("topic_id"),
        F.array("source", "lang").alias("section_path"),
        token_count(F.col("text")).alias("token_count"),
        F.lit(1).alias("page_start"),
        F.size(F.split("text", "\n", -1)).alias("page_end"),
        (F.col("doc_id") % 4).cast("int").alias("usage"),
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: a line of a document is a page; markers, breaks and footers are put in by rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    n = (F.col("i") + 1).cast("int")
    footer = F.when(F.col("doc_id") % 4 != 0, "").when(n % 2 == 0, "\x0b\u00a0COURSE\u2003 footer\u00a0").otherwise("\nCourse footer")
    text = F.concat(
        F.when(n % 19 == 0, F.lit(" \t")).otherwise(""),
        "line",
        F.when(n % 7 == 0, F.concat(F.lit("\nSlide "), n, F.lit(" of 40"))).otherwise(""),
        F.when(n % 13 == 0, F.lit("\nfoo-\nbar")).otherwise(""),
        F.when(n % 17 == 0, F.lit("\uf0ce\uf061")).otherwise(""),
        F.when(n % 3 == 0, F.lit("\n\n\n\nafter\t")).otherwise(""),
        F.when(n % 23 == 0, F.lit("\n| a | b |\n\n| c | d |\n")).otherwise(""),
        F.when(n % 10 == 0, F.lit("\x0bsoft\u00a0 break\rof a\u2028line \x0c")).otherwise(""),
        F.when(n % 9 == 0, F.concat(F.lit("\r\nSlide\u00a0"), n, F.lit("\u2003of\u00a040\x85\u3000"))).otherwise(""),
        F.when(n % 14 == 0, F.lit("\n\u00a0\n\x0c\n| a |\x0b\u00a0| b |\x0c")).otherwise(""),
        footer,
    )
    heading = F.when(n % 11 == 0, F.lit("Outline")).when((n - 1) % 5 == 0, F.array_join(F.slice(F.split("line", " ", -1), 1, 3), " "))
    notes = F.when(n % 12 == 0, F.concat(F.lit(" note distrib-\nuted\n\n\n\n"), n)).when(n % 4 == 0, F.concat(F.lit("note "), n))
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("course_id"), n.alias("number"), heading.alias("heading"), text.alias("text"), notes.alias("notes"), F.when(F.col("doc_id") % 9 == 0, "deck").otherwise("paper").alias("kind"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: an event answers question k of its course at its time."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("answer_id"),
        F.concat(F.lit("src"), k % 20).alias("course_id"),
        F.concat(F.lit("src"), k % 20, F.lit("/"), lang).alias("topic_id"),
        k.alias("question_id"),
        (F.col("event_type") != "error").alias("is_correct"),
        F.col("ts").alias("answered_at"),
        F.col("user_id").alias("student_id"),
        F.col("value"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of cards: the view events."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("review_id"),
        (F.col("user_id") * 10 + k % 10).alias("card_id"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("course_id"),
        (k % 4 + 1).alias("rating"),
        F.col("ts").alias("reviewed_at"),
        F.col("value").alias("stability"),
        F.element_at(F.array(*map(F.lit, ("learning", "review", "relearning"))), k % 3 + 1).alias("state"),
        (F.col("ts") + F.make_dt_interval(k % 30 + 1)).alias("due_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of passages; every tenth is there twice, the second with id + 1,000,000."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), (F.col("vec_id") % 5).cast("int").alias("course_id"), F.col("label").alias("topic_id"), "embedding")
    again = v.filter(F.col("chunk_id") % 10 == 0).withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    return v.unionByName(again)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each vector: the sum of it and the next five by id, its expected hit itself."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = v.select(F.explode(F.sequence(F.col("vec_id") - 5, F.col("vec_id"))).alias("query_id"), "embedding", "vec_id")
    parts = near.select("query_id", "vec_id", F.posexplode("embedding").alias("i", "x")).groupBy("query_id", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query")).filter("query_id >= 0")


def quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("quiz_id"), (F.col("o_custkey") % 20).cast("int").alias("course_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("duration_ms"), F.col("o_orderstatus").alias("status"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem")
    return q.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("question_id"),
        F.col("l_orderkey").alias("quiz_id"),
        F.col("l_linenumber").alias("order_index"),
        F.array(F.col("l_partkey")).alias("source_chunk_ids"),
        F.array(F.col("l_linenumber")).alias("page_refs"),
        F.concat_ws(" ", F.lit("stem"), "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("stem"),
        (F.col("l_suppkey") % 10).cast("int").alias("topic_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "analysis").when(F.col("l_linenumber") % 3 == 1, "recall").otherwise("understanding").alias("difficulty"),
        F.when(F.col("l_suppkey") % 11 != 0, F.array(*[F.struct(F.lit(i).alias("id"), F.concat(F.lit(f"{i}: "), F.col(c).cast("string")).alias("text"), (F.col("l_linenumber") % 4 == k).alias("is_correct"), F.lit("why").alias("why_wrong")) for k, (i, c) in enumerate(zip("ABCD", ("l_returnflag", "l_linestatus", "l_partkey", "l_suppkey")))])).alias("options"),
    )


#: What the SQL strips from both ends of a text, and its lines.
BLANK_CHARS = " || ".join(f"chr({ord(c)})" for c in BLANKS)
STRIP = f"trim({{}}, {BLANK_CHARS})"
LINES = f"string_split_regex({{}}, '{LINE_END.replace('{', '{{').replace('}', '}}')}')"
BLANK_RUN = f"[{BLANK}]+"

# DuckDB's text of each view.
SQL_VIEWS = {
    "v_chunk": rf"""SELECT doc_id AS chunk_id, doc_id AS document_id, source AS course_id, source || '/' || lang AS topic_id,
        [source, lang] AS section_path, len(regexp_extract_all(text, '{WORD}')) AS token_count, 1 AS page_start,
        len(string_split(text, chr(10))) AS page_end, CAST(doc_id % 4 AS INT) AS usage, text FROM documents""",
    "v_page": r"""SELECT doc_id AS document_id, source AS course_id, i AS number,
        CASE WHEN i % 11 = 0 THEN 'Outline' WHEN (i - 1) % 5 = 0 THEN array_to_string(list_slice(string_split(line, ' '), 1, 3), ' ') END AS heading,
        CASE WHEN i % 19 = 0 THEN ' ' || chr(9) ELSE '' END || line || CASE WHEN i % 7 = 0 THEN chr(10) || 'Slide ' || i || ' of 40' ELSE '' END
             || CASE WHEN i % 13 = 0 THEN chr(10) || 'foo-' || chr(10) || 'bar' ELSE '' END
             || CASE WHEN i % 17 = 0 THEN chr(61646) || chr(61537) ELSE '' END
             || CASE WHEN i % 3 = 0 THEN chr(10) || chr(10) || chr(10) || chr(10) || 'after' || chr(9) ELSE '' END
             || CASE WHEN i % 23 = 0 THEN chr(10) || '| a | b |' || chr(10) || chr(10) || '| c | d |' || chr(10) ELSE '' END
             || CASE WHEN i % 10 = 0 THEN chr(11) || 'soft' || chr(160) || ' break' || chr(13) || 'of a' || chr(8232) || 'line ' || chr(12) ELSE '' END
             || CASE WHEN i % 9 = 0 THEN chr(13) || chr(10) || 'Slide' || chr(160) || i || chr(8195) || 'of' || chr(160) || '40' || chr(133) || chr(12288) ELSE '' END
             || CASE WHEN i % 14 = 0 THEN chr(10) || chr(160) || chr(10) || chr(12) || chr(10) || '| a |' || chr(11) || chr(160) || '| b |' || chr(12) ELSE '' END
             || CASE WHEN doc_id % 4 <> 0 THEN '' WHEN i % 2 = 0 THEN chr(11) || chr(160) || 'COURSE' || chr(8195) || ' footer' || chr(160) ELSE chr(10) || 'Course footer' END AS text,
        CASE WHEN i % 12 = 0 THEN ' note distrib-' || chr(10) || 'uted' || chr(10) || chr(10) || chr(10) || chr(10) || i WHEN i % 4 = 0 THEN 'note ' || i END AS notes,
        CASE WHEN doc_id % 9 = 0 THEN 'deck' ELSE 'paper' END AS kind
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS i FROM documents)""",
    "v_answer": r"""SELECT event_id AS answer_id, 'src' || (k % 20) AS course_id, 'src' || (k % 20) || '/' || (['en', 'fr', 'de', 'es'])[user_id % 4 + 1] AS topic_id,
        k AS question_id, event_type <> 'error' AS is_correct, ts AS answered_at, user_id AS student_id, value
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "v_review": r"""SELECT event_id AS review_id, user_id * 10 + k % 10 AS card_id, 'src' || (user_id % 20) AS course_id, k % 4 + 1 AS rating, ts AS reviewed_at, value AS stability,
        (['learning', 'review', 'relearning'])[k % 3 + 1] AS state, ts + to_days(k % 30 + 1) AS due_at
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'view')""",
    "v_vector": r"""SELECT vec_id AS chunk_id, vec_id AS document_id, CAST(vec_id % 5 AS INT) AS course_id, label AS topic_id, embedding FROM embeddings
        UNION ALL SELECT vec_id + 1000000, vec_id, CAST(vec_id % 5 AS INT), label, embedding FROM embeddings WHERE vec_id % 10 = 0""",
    "v_query": r"""SELECT query_id, list(x ORDER BY i) AS query FROM (
        SELECT v.vec_id - o.o AS query_id, i, sum(x) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) v, range(0, 6) o(o) GROUP BY ALL)
        WHERE query_id >= 0 GROUP BY query_id""",
    "v_quiz": r"""SELECT o_orderkey AS quiz_id, CAST(o_custkey % 20 AS INT) AS course_id, o_orderdate AS created_at, o_totalprice AS duration_ms, o_orderstatus AS status FROM orders""",
    "v_question": r"""SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS question_id, l_orderkey AS quiz_id, l_linenumber AS order_index, [l_partkey] AS source_chunk_ids,
        [l_linenumber] AS page_refs, 'stem ' || l_returnflag || ' ' || l_linestatus || ' ' || l_partkey AS stem, CAST(l_suppkey % 10 AS INT) AS topic_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'analysis' WHEN 1 THEN 'recall' ELSE 'understanding' END AS difficulty,
        CASE WHEN l_suppkey % 11 <> 0 THEN ['A: ' || l_returnflag, 'B: ' || l_linestatus, 'C: ' || l_partkey, 'D: ' || l_suppkey] ELSE [] END AS option_texts FROM lineitem""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the views that it names, directly or through others, put before it."""
    texts = SQL_VIEWS | (extra or {})
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in texts:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                add(texts[name])
                if name not in wanted:
                    wanted.append(name)

    add(body)
    head = ", ".join(f"{n} AS MATERIALIZED ({texts[n]})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}" if wanted else body
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:].strip()}" if wanted else body
    return f"WITH {head} {body}" if wanted else body
