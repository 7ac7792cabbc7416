"""Queries of question records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rows import once
from ..functions.text import BLANK, FAST_WORD, WORD
from ..operators import chunking as K
from ..operators import questions as Q
from ..sources import views as V
from ..sources.tables import table
from . import documents as D

TEMPLATE = "Write one {difficulty} question on {topic} from this passage:\n{passage}\nUse its words only."

#: The first 40 words of a text, if it has so many.
HEAD = rf"^(?:[{BLANK}]*+{FAST_WORD}){{40}}"


def mcq(spark, sf_dir):
    """A question from each document of 40 words or more, with faults put in by rule.

    Only the first 40 words are made an array of, and each question is made once a row."""
    d = table(spark, sf_dir, "documents").withColumn("head", F.regexp_extract("text", HEAD, 0)).filter(F.col("head") != "")
    d = d.select("doc_id", "source", "text", F.regexp_extract_all("head", F.lit(FAST_WORD), F.lit(0)).alias("w"))
    cut = lambda lo, hi: F.array_join(F.slice("w", lo, hi - lo + 1), " ")
    on = lambda n, yes, no="": F.when(F.col("doc_id") % n == 0, yes).otherwise(no)
    stem = F.concat(cut(1, 12), on(9, " NOT "), on(10, " main "), F.lit("?"))
    right = F.concat(on(3, cut(5, 9), cut(20, 23)), on(8, " 8"), on(6, F.concat(F.lit(" "), cut(1, 30))))
    why = on(12, " ", "it says otherwise")
    texts = [right, cut(24, 27), cut(28, 31), on(7, "All of the above", cut(32, 35))]
    options = F.array(*[F.struct(F.lit("ABCD"[i]).alias("id"), x.alias("text"), F.lit(i == 0).alias("is_correct"), (F.lit(None).cast("string") if i == 0 else F.lit("it says otherwise") if i < 3 else why).alias("why_wrong")) for i, x in enumerate(texts)])
    d = once(d, ["doc_id", "source", "text"], stem=stem, options=options, explanation=cut(10, 25))
    return d.select(F.col("doc_id").alias("question_id"), F.col("source").alias("course_id"), "stem", "options", "explanation", on(5, "analysis", "recall").alias("difficulty"), F.concat("text", on(16, " see sec.8 now")).alias("passage"), F.array("doc_id").alias("source_chunk_ids"))


def responses(spark, sf_dir):
    q = mcq(spark, sf_dir)
    raw = F.to_json(F.struct("stem", "options", "explanation", "difficulty"))
    cut = F.when(F.col("question_id") % 13 == 0, '{"insufficient": true}').when(F.col("question_id") % 11 == 0, F.left(raw, F.length(raw) - 5)).otherwise(raw)
    return q.select(F.col("question_id").alias("id"), cut.alias("raw"))


def parse_responses(spark, sf_dir):
    p = Q.parse_responses(responses(spark, sf_dir))
    return p.select("id", "kind", F.when(F.col("kind") == "question", F.col("q.stem")).alias("stem"))


def schema_check(spark, sf_dir):
    p = Q.parse_responses(responses(spark, sf_dir)).filter(F.col("kind") == "question")
    return p.select("id", Q.schema_ok().alias("ok"))


def parse_cards(spark, sf_dir):
    """A batch of three cards from each question; every 15th has a blank one."""
    q = mcq(spark, sf_dir)
    backs = [F.get("options", F.lit(0))["text"], F.when(F.col("question_id") % 15 == 0, " ").otherwise(F.get("options", F.lit(1))["text"]), F.get("options", F.lit(2))["text"]]
    cards = F.array(*[F.struct(F.concat(F.lit(f"{i} "), F.col("stem")).alias("front"), b.alias("back")) for i, b in enumerate(backs)])
    return Q.parse_cards(q.select(F.col("question_id").alias("id"), F.to_json(F.struct(cards.alias("cards"))).alias("raw")), 2)


def qv_rules(spark, sf_dir):
    q = mcq(spark, sf_dir)
    fails = Q.rule_failures(*[F.col(c) for c in ("stem", "options", "explanation", "difficulty", "passage")])
    return q.select("question_id", F.array_join(fails, ",").alias("failures"), (F.size(fails) == 0).alias("passed"))


def validator_report(spark, sf_dir):
    """The rules' codes and the judge's; the judge's verdicts come from labels of the document."""
    q = mcq(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), "quality", "toxic"), "question_id", "left")
    fails = Q.rule_failures(*[F.col(c) for c in ("stem", "options", "explanation", "difficulty", "passage")])
    judge = F.array_compact(F.array(F.when(F.col("quality") == 0, "GROUNDED"), F.when(F.col("toxic") == 1, "PLAUSIBLE")))
    every = F.concat(fails, judge)
    return q.select("question_id", F.array_join(every, ",").alias("failures"), (F.size(every) == 0).alias("passed"))


def option_overlap(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("question_id"), (F.col("vec_id") % 4).alias("option"), "embedding")
    o = Q.option_overlap(v)
    return o.select("question_id", F.round("most", 6).alias("most"), "overlap")


def recent_stems(spark, sf_dir):
    return Q.recent_stems(V.quizzes(spark, sf_dir), V.questions(spark, sf_dir))


def semantic_dedup(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return Q.semantic_dedup(v.select(F.col("chunk_id").alias("id"), "course_id", F.col("chunk_id").alias("place"), "embedding"))


def attach_citations(spark, sf_dir):
    """Every 17th question has lost its passage."""
    made_from = F.when(F.col("question_id") % 17 == 0, F.col("question_id") + 1_000_000_000).otherwise(F.col("question_id"))
    q = mcq(spark, sf_dir).select("question_id", "source_chunk_ids", made_from.alias("chunk_id"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return Q.attach_citations(q, V.chunks(spark, sf_dir)).select("question_id", text("source_chunk_ids").alias("cites"), text("page_refs").alias("pages"))


def quiz_view(spark, sf_dir):
    v = Q.quiz_view(V.questions(spark, sf_dir), V.chunks(spark, sf_dir))
    options = F.array_join(F.transform("options", lambda o: F.concat_ws("=", o["id"], o["text"])), "|")
    return v.select("quiz_id", "question_id", "place", "stem", options.alias("options"), "difficulty", F.array_join(F.transform("page_refs", lambda x: x.cast("string")), ",").alias("pages"), F.array_join("section_path", "/").alias("section"))


def attempts(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "A", "passed").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "thin").otherwise("rejected")
    return i.select(F.col("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("attempt"), outcome.alias("outcome"), F.concat(F.lit("CODE"), F.col("l_suppkey") % 5).alias("code"))


def best_attempt(spark, sf_dir):
    return Q.best_attempts(attempts(spark, sf_dir))


def generation_metrics(spark, sf_dir):
    a = attempts(spark, sf_dir)
    courses = V.quizzes(spark, sf_dir).select(F.col("quiz_id").alias("passage_id"), "course_id")
    best = Q.best_attempts(a).join(courses, "passage_id").groupBy("course_id").agg(
        F.count_if(F.col("outcome") == "passed").alias("persisted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count_if(F.col("outcome") == "thin").alias("thin"),
        F.count_if((F.col("outcome") == "passed") & (F.col("attempt") > 1)).alias("second_try"),
    )
    codes = a.filter((F.col("outcome") == "rejected") & (F.col("attempt") <= 2)).join(courses, "passage_id").groupBy("course_id", "code").agg(F.count(F.lit(1)).alias("n"))
    codes = codes.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["code"], F.lit("="), x["n"])), ",")
    rate = F.round(F.try_divide(F.col("persisted"), F.col("persisted") + F.col("rejected")), 6)
    return best.join(codes, "course_id", "left").select("course_id", "persisted", "rejected", "thin", "second_try", rate.alias("pass_rate"), text.alias("codes"))


def accepted_questions(spark, sf_dir):
    q = mcq(spark, sf_dir)
    fails = Q.rule_failures(*[F.col(c) for c in ("stem", "options", "explanation", "difficulty", "passage")])
    return Q.accepted_questions(q.filter(F.size(fails) == 0), 10).select("course_id", "question_id", "place")


def public_questions(spark, sf_dir):
    p = mcq(spark, sf_dir).select("question_id", "stem", Q.public_options(F.col("options")).alias("options"))
    return p.select("question_id", "stem", F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"))


def passage_split(spark, sf_dir):
    """Passages of odd documents begin with a line before their headings, and have other ends of lines and blanks."""
    chunks = K.chunk_slides(V.pages(spark, sf_dir), D.SMALL)
    odd = F.concat(F.lit("intro\n\n to it \n"), F.replace("text", F.lit("\n\n"), F.lit(" \u00a0\r\n\n")), F.lit("\n###  \nno heading\x0b\u00a0\x0bends"))
    return Q.split_passage(chunks.withColumn("text", F.when(F.col("document_id") % 2 == 1, odd).otherwise(F.col("text")))).select("document_id", "chunk_no", "part", "heading", F.sha2("body", 256).alias("sha"), "page")


def prompt_table(spark, sf_dir):
    q = mcq(spark, sf_dir)
    text = Q.render(TEMPLATE, {"difficulty": F.col("difficulty"), "topic": F.col("course_id"), "passage": F.col("passage")})
    return q.select("question_id", F.sha2(text, 256).alias("sha"), F.length(text).alias("chars"))


_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_CUT = "array_to_string(w[{}:{}], ' ')"
_NUM = r"regexp_extract_all(regexp_replace({}, '[\p{{L}}_]', 'x', 'g'), '\b\d+(?:\.\d+)?\b')"
_SQL = {
    "v_mcq": f"""SELECT *, [why1, why1, why3] AS whys FROM (SELECT doc_id AS question_id, source AS course_id, text || CASE WHEN doc_id % 16 = 0 THEN ' see sec.8 now' ELSE '' END AS passage,
        {_CUT.format(1, 12)} || CASE WHEN doc_id % 9 = 0 THEN ' NOT ' ELSE '' END || CASE WHEN doc_id % 10 = 0 THEN ' main ' ELSE '' END || '?' AS stem,
        CASE WHEN doc_id % 3 = 0 THEN {_CUT.format(5, 9)} ELSE {_CUT.format(20, 23)} END || CASE WHEN doc_id % 8 = 0 THEN ' 8' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN ' ' || {_CUT.format(1, 30)} ELSE '' END AS o1,
        {_CUT.format(24, 27)} AS o2, {_CUT.format(28, 31)} AS o3, CASE WHEN doc_id % 7 = 0 THEN 'All of the above' ELSE {_CUT.format(32, 35)} END AS o4,
        'it says otherwise' AS why1, CASE WHEN doc_id % 12 = 0 THEN ' ' ELSE 'it says otherwise' END AS why3, {_CUT.format(10, 25)} AS explanation,
        CASE WHEN doc_id % 5 = 0 THEN 'analysis' ELSE 'recall' END AS difficulty
        FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS w FROM documents) WHERE len(w) >= 40)""",
    "q_rule": rf"""SELECT question_id, course_id, list_filter([
        CASE WHEN trim(stem) = '' OR trim(explanation) = '' OR trim(o1) = '' OR trim(o2) = '' OR trim(o3) = '' OR trim(o4) = '' THEN 'EMPTY_FIELD' WHEN trim(why3) = '' THEN 'SCHEMA' END,
        CASE WHEN length(o1) > 1.5 * (length(o2) + length(o3) + length(o4)) / 3 THEN 'LENGTH_BIAS' END,
        CASE WHEN len(list_filter([o1, o2, o3, o4], lambda o: regexp_matches(lower(o), '{"|".join(Q.BANNED)}'))) > 0 THEN 'BANNED_PHRASE' END,
        CASE WHEN difficulty <> 'analysis' AND regexp_matches(stem, '{Q.NEGATION}') THEN 'NEGATION' END,
        CASE WHEN len(list_filter(range(1, len(ow) - 1), lambda i: len(list_filter(ow[i:i+2], lambda x: NOT list_contains([{_LIST(Q.STOPWORDS)}], x))) > 0
            AND contains(array_to_string(sw, ' '), array_to_string(ow[i:i+2], ' ')))) > 0 THEN 'LEAKAGE' END,
        CASE WHEN regexp_matches(stem, '{Q.RANKING}') AND NOT regexp_matches(passage, '{Q.RANKING}') THEN 'INVENTED_RANKING' END,
        CASE WHEN len(list_filter({_NUM.format("o1 || ' '")}, lambda x: NOT list_contains({_NUM.format("passage || ' '")}, x))) > 0 THEN 'NUMERIC_UNSUPPORTED' END
        ], lambda x: x IS NOT NULL) AS fails FROM (SELECT *, regexp_extract_all(lower(o1), '[a-z0-9]+') AS ow, regexp_extract_all(lower(stem), '[a-z0-9]+') AS sw FROM v_mcq)""",
    "q_split_chunk": """SELECT document_id, chunk_no, page_start, page_end, CASE WHEN document_id % 2 = 1 THEN 'intro' || chr(10) || chr(10) || ' to it ' || chr(10) || replace(text, chr(10) || chr(10), ' ' || chr(160) || chr(13) || chr(10) || chr(10))
        || chr(10) || '###  ' || chr(10) || 'no heading' || chr(11) || chr(160) || chr(11) || 'ends' ELSE text END AS text FROM q_slide_chunk""",
    "q_kind": "SELECT question_id AS id, CASE WHEN question_id % 13 = 0 THEN 'thin' WHEN question_id % 11 = 0 THEN 'invalid' ELSE 'question' END AS kind, stem FROM v_mcq",
    "q_attempt": """SELECT l_orderkey AS passage_id, l_linenumber AS attempt, 'CODE' || (l_suppkey % 5) AS code,
        CASE WHEN l_returnflag = 'A' THEN 'passed' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'thin' ELSE 'rejected' END AS outcome FROM lineitem""",
    "q_best": """SELECT passage_id, attempt, outcome FROM q_attempt JOIN (SELECT passage_id, coalesce(min(attempt) FILTER (outcome = 'passed'), max(attempt)) AS attempt FROM (
        SELECT *, min(CASE WHEN outcome = 'thin' THEN attempt END) OVER (PARTITION BY passage_id) AS stop FROM q_attempt WHERE attempt <= 2) WHERE stop IS NULL OR attempt <= stop GROUP BY 1) USING (passage_id, attempt)""",
}


def _sql(body: str) -> str:
    return V.with_views(body, D._SQL | _SQL)


QUERIES = {
    "parse_responses": parse_responses, "schema_check": schema_check, "parse_cards": parse_cards, "qv_rules": qv_rules, "validator_report": validator_report, "option_overlap": option_overlap,
    "recent_stems": recent_stems, "semantic_dedup": semantic_dedup, "best_attempt": best_attempt, "generation_metrics": generation_metrics, "accepted_questions": accepted_questions,
    "public_questions": public_questions, "attach_citations": attach_citations, "quiz_view": quiz_view, "passage_split": passage_split, "prompt_table": prompt_table,
}

ORACLE_SQL = {
    "parse_responses": _sql("SELECT id, kind, CASE WHEN kind = 'question' THEN stem END AS stem FROM q_kind"),
    "schema_check": _sql("SELECT id, true AS ok FROM q_kind WHERE kind = 'question'"),
    "parse_cards": _sql("SELECT question_id AS id, i AS place, i || ' ' || stem AS front, CASE i WHEN 0 THEN o1 ELSE o2 END AS back FROM v_mcq, range(0, 2) r(i) WHERE question_id % 15 <> 0"),
    "qv_rules": _sql("SELECT question_id, array_to_string(fails, ',') AS failures, len(fails) = 0 AS passed FROM q_rule"),
    "validator_report": _sql("""SELECT question_id, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM (SELECT question_id, fails || list_filter([CASE WHEN quality = 0 THEN 'GROUNDED' END,
        CASE WHEN toxic = 1 THEN 'PLAUSIBLE' END], lambda x: x IS NOT NULL) AS f FROM q_rule LEFT JOIN labels ON doc_id = question_id)"""),
    "option_overlap": """WITH v AS (SELECT vec_id // 4 AS q, vec_id % 4 AS o, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT a.q AS question_id, round(max(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) AS most,
        max(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) >= 0.9 AS overlap FROM v a JOIN v b ON a.q = b.q AND a.o < b.o GROUP BY 1""",
    "recent_stems": _sql("""SELECT course_id, quiz_id, question_id, stem FROM v_question JOIN (SELECT course_id, quiz_id, row_number() OVER (PARTITION BY course_id ORDER BY created_at DESC, quiz_id DESC) AS nth FROM v_quiz)
        USING (quiz_id) WHERE nth <= 3"""),
    "semantic_dedup": _sql("""WITH RECURSIVE e AS MATERIALIZED (SELECT chunk_id, course_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY chunk_id) AS rn FROM v_vector),
        b AS MATERIALIZED (SELECT y.rn, y.chunk_id, coalesce(list(x.chunk_id ORDER BY x.chunk_id) FILTER (x.chunk_id IS NOT NULL), []) AS before FROM e y LEFT JOIN e x ON x.course_id = y.course_id AND x.chunk_id < y.chunk_id
            AND list_dot_product(x.v, y.v) >= 0.92 * sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)) GROUP BY ALL),
        f AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS BIGINT) AS matched
            UNION ALL SELECT b.rn, CASE WHEN len(list_intersect(b.before, f.kept)) = 0 THEN list_append(f.kept, b.chunk_id) ELSE f.kept END, b.chunk_id, list_min(list_intersect(b.before, f.kept)) FROM f JOIN b ON b.rn = f.rn + 1)
        SELECT chunk_id AS id, matched IS NULL AS accepted, matched FROM f WHERE rn > 0"""),
    "best_attempt": _sql("SELECT * FROM q_best"),
    "generation_metrics": _sql("""SELECT b.*, c.codes FROM (SELECT course_id, count(*) FILTER (outcome = 'passed') AS persisted, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'thin') AS thin,
        count(*) FILTER (outcome = 'passed' AND attempt > 1) AS second_try, round(count(*) FILTER (outcome = 'passed') / nullif(count(*) FILTER (outcome IN ('passed', 'rejected')), 0), 6) AS pass_rate
        FROM q_best JOIN v_quiz ON quiz_id = passage_id GROUP BY 1) b LEFT JOIN (SELECT course_id, string_agg(code || '=' || n, ',' ORDER BY code) AS codes FROM (
        SELECT course_id, code, count(*) AS n FROM q_attempt JOIN v_quiz ON quiz_id = passage_id WHERE outcome = 'rejected' AND attempt <= 2 GROUP BY ALL) GROUP BY 1) c USING (course_id)"""),
    "accepted_questions": _sql("SELECT * FROM (SELECT course_id, question_id, row_number() OVER (PARTITION BY course_id ORDER BY question_id) - 1 AS place FROM q_rule WHERE len(fails) = 0) WHERE place < 10"),
    "public_questions": _sql("SELECT question_id, stem, 'A=' || o1 || '|B=' || o2 || '|C=' || o3 || '|D=' || o4 AS options FROM v_mcq"),
    "attach_citations": _sql("""SELECT question_id, coalesce(CAST(c.chunk_id AS VARCHAR), '') AS cites, coalesce(array_to_string(range(c.page_start, c.page_end + 1), ','), '') AS pages
        FROM v_mcq LEFT JOIN v_chunk c ON c.chunk_id = question_id AND question_id % 17 <> 0"""),
    "quiz_view": _sql("""SELECT quiz_id, question_id, row_number() OVER (PARTITION BY quiz_id ORDER BY order_index, question_id) - 1 AS place, stem, difficulty,
        array_to_string(list_transform(option_texts, lambda x: left(x, 1) || '=' || x), '|') AS options, array_to_string(page_refs, ',') AS pages,
        coalesce(array_to_string(c.section_path, '/'), '') AS section FROM v_question q LEFT JOIN v_chunk c ON c.chunk_id = q.source_chunk_ids[1]"""),
    "passage_split": _sql(rf"""SELECT document_id, chunk_no, row_number() OVER (PARTITION BY document_id, chunk_no ORDER BY i) - 1 AS part, heading, sha256(body) AS sha, page FROM (
        SELECT document_id, chunk_no, i, CASE WHEN i > 0 THEN nullif({V.STRIP.format("split_part(piece, chr(10), 1)")}, '') END AS heading,
            CASE WHEN i > 0 THEN coalesce(array_to_string(list_transform(list_filter({V.LINES.format("rest")}, lambda x: {V.STRIP.format("x")} <> ''), lambda x: rtrim(x, {V.BLANK_CHARS})), chr(10)), '') ELSE {V.STRIP.format("piece")} END AS body,
            CASE WHEN i > 0 THEN least(page_start + i - 1, page_end) ELSE page_start END AS page
        FROM (SELECT *, {V.STRIP.format("substr(piece, length(split_part(piece, chr(10), 1)) + 1)")} AS rest FROM (
            SELECT document_id, chunk_no, page_start, page_end, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS i FROM (SELECT *, string_split_regex(text, '(?m){Q.SLIDE_LINE}') AS parts FROM q_split_chunk))))
        WHERE i > 0 OR body <> ''"""),
    "prompt_table": _sql("""SELECT question_id, sha256(t) AS sha, length(t) AS chars FROM (SELECT question_id, 'Write one ' || difficulty || ' question on ' || course_id || ' from this passage:' || chr(10) || passage || chr(10) || 'Use its words only.' AS t FROM v_mcq)"""),
}
