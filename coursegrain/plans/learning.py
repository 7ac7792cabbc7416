"""Queries of learning events, evaluation, integrity and layout, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import integrity as I
from ..operators import layout as Y
from ..operators import learning as L
from ..operators import retrieval as R
from ..operators import sampling as S
from ..operators import scheduling as H
from ..sources import views as V
from ..sources.tables import table
from . import corpus as C
from . import documents as D
from . import questions as Q
from . import sampling as P

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _selected(spark, sf_dir):
    a = V.answers(spark, sf_dir)
    return a.withColumn("question_id", F.col("question_id").cast("long")).withColumn("selected", F.get(F.array(*map(F.lit, "ABCDE")), (F.col("student_id") % 5).cast("int")))


def grade_answers(spark, sf_dir):
    return L.graded(_selected(spark, sf_dir), Q.mcq(spark, sf_dir))


def answer_source(spark, sf_dir):
    s = L.answer_source(_selected(spark, sf_dir), Q.mcq(spark, sf_dir), V.chunks(spark, sf_dir))
    return s.select("answer_id", "chunk_id", "page_start", "page_end", F.md5("text").alias("md5"))


def topic_mastery(spark, sf_dir):
    return L.mastery(V.answers(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def weak_topics(spark, sf_dir):
    """By halves of an hour, as whole topics are never weak in the test tables."""
    a = V.answers(spark, sf_dir).withColumn("topic_id", F.concat("topic_id", F.lit("/"), F.date_format("answered_at", "HH")))
    return L.weak_topics(L.mastery(a)).select("course_id", "topic_id", "attempts", F.round("accuracy", 6).alias("accuracy"))


def missed_to_cards(spark, sf_dir):
    """The questions that ask for an analysis have their cards already."""
    q = Q.mcq(spark, sf_dir)
    existing = q.filter(F.col("difficulty") == "analysis").select("course_id", F.col("stem").alias("front"))
    cards = L.missed_cards(_selected(spark, sf_dir), q, existing)
    return cards.select("course_id", "front", "back", F.element_at("source_chunk_ids", 1).alias("cites"))


def _attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("quiz_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderstatus") != "F").alias("open"))


def _given(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").cast("long").alias("question_id"), (F.col("l_returnflag") != "R").alias("is_correct"), (F.col("l_suppkey") % 10).cast("int").alias("topic_id"))


def _totals(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("quiz_id"), F.lit(7).alias("total"))


def resume_attempts(spark, sf_dir):
    r = L.resume_attempts(_attempts(spark, sf_dir), _given(spark, sf_dir), _totals(spark, sf_dir))
    return r.withColumn("answered_ids", F.array_join(F.transform("answered_ids", lambda x: x.cast("string")), ","))


def quiz_progress(spark, sf_dir):
    return L.quiz_progress(_attempts(spark, sf_dir), _given(spark, sf_dir), _totals(spark, sf_dir))


def attempt_results(spark, sf_dir):
    return L.attempt_results(_given(spark, sf_dir)).withColumn("score", F.round("score", 6))


def latest_review(spark, sf_dir):
    return L.latest_review(V.reviews(spark, sf_dir)).select("card_id", "review_id", "rating", "state", "due_at")


def _cards(spark, sf_dir):
    """Ten cards of each user who did anything."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    u = u.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return u.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("course_id"), (F.col("user_id") * 10 + F.col("i")).alias("card_id"))


def due_cards(spark, sf_dir):
    return L.due_cards(_cards(spark, sf_dir), L.latest_review(V.reviews(spark, sf_dir)), _now()).select("course_id", "card_id", "place")


def deck_stats(spark, sf_dir):
    return L.deck_stats(_cards(spark, sf_dir), L.latest_review(V.reviews(spark, sf_dir)), _now())


def review_lapses(spark, sf_dir):
    return L.lapses(V.reviews(spark, sf_dir))


def schedule_replay(spark, sf_dir):
    return H.schedule_replay(V.reviews(spark, sf_dir))


def course_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"))
    return L.course_inventory(docs, V.chunks(spark, sf_dir), _cards(spark, sf_dir))


def retrieval_eval(spark, sf_dir):
    q = C._queries(spark, sf_dir)
    return E.retrieval_eval(q.select("query_id", F.col("query_id").alias("expected_id")), R.vector_topk(q, V.vectors(spark, sf_dir)))


def golden_eval(spark, sf_dir):
    """Pairs keyed by section: two passages, five apart, share one, and every other query's section is gone."""
    q = C._queries(spark, sf_dir)
    section = lambda i: F.when(i % 5 == 0, F.array(F.lit("d"), F.floor(i / 10).cast("string"))).otherwise(F.array(F.lit("x"), i.cast("string")))
    chunks = V.vectors(spark, sf_dir).select("chunk_id", section(F.col("chunk_id")).alias("section_path"))
    golden = q.select("query_id", "query", F.when(F.col("query_id") % 40 == 0, F.array(F.lit("gone"))).otherwise(section(F.col("query_id"))).alias("source_section"))
    pairs = E.golden_pairs(golden, chunks)
    return E.retrieval_eval(pairs.select("query_id", "expected_id"), R.vector_topk(q.join(pairs.select("query_id"), "query_id", "left_semi"), V.vectors(spark, sf_dir)))


def citation_integrity(spark, sf_dir):
    """Every third passage's document is a page shorter than the passage says."""
    short = F.when(F.col("chunk_id") % 3 == 0, 1).otherwise(0)
    return E.citation_integrity(V.questions(spark, sf_dir), V.chunks(spark, sf_dir).withColumn("page_count", F.col("page_end") - short))


def groundedness(spark, sf_dir):
    """Explanations beside the next document's passage, so that not all are grounded."""
    q = Q.mcq(spark, sf_dir)
    other = q.select((F.col("question_id") - 1).alias("question_id"), F.col("passage").alias("other"))
    rows = q.join(other, "question_id", "left").withColumn("passage", F.when(F.col("question_id") % 2 == 0, F.col("passage")).otherwise(F.coalesce("other", F.lit(""))))
    return E.groundedness(rows)


def generation_quality(spark, sf_dir):
    runs = V.questions(spark, sf_dir).groupBy("quiz_id").agg(F.count(F.lit(1)).alias("question_count")).join(V.quizzes(spark, sf_dir), "quiz_id")
    rate = F.when(F.col("status") == "F", 1.0).when(F.col("status") == "O", 0.5).otherwise(0.0)
    return E.generation_quality(runs.select("course_id", "question_count", rate.alias("pass_rate"), F.col("duration_ms").alias("ms"), (F.col("question_count") + 1).alias("attempts")))


def _run_log(spark, sf_dir):
    """Log lines made from the events, cut by a pattern again."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.format_string("run=%s attempt=%d code=%s ms=%.3f", F.col("event_type"), k % 2 + 1, F.when(k % 5 == 0, F.concat(F.lit("C"), k % 7)).otherwise(""), F.col("value"))
    pattern = r"^run=(\S+) attempt=(\d+) code=(\S*) ms=([0-9.]+)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    log = e.select(line.alias("line")).filter(F.col("line").rlike(pattern))
    return log.select(part(1).alias("label"), part(2).cast("int").alias("attempt"), part(3).alias("code"), part(4).cast("double").alias("ms"))


def compare_runs(spark, sf_dir):
    return E.compare_runs(_run_log(spark, sf_dir))


def run_failures(spark, sf_dir):
    return E.failure_histogram(_run_log(spark, sf_dir).select("label", F.array("code").alias("codes")), "label")


def generation_failures(spark, sf_dir):
    """A quiz's failure codes are the return flags of its lines, with their numbers."""
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("quiz_id"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    maps = i.groupBy("quiz_id").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("failure_codes"))
    return E.failure_totals(maps.join(V.quizzes(spark, sf_dir).select("quiz_id", "course_id"), "quiz_id"))


def quality_gate(spark, sf_dir):
    chunks, reqs, m = P._inputs(spark, sf_dir)
    scoped = S.in_scope(chunks, reqs)
    report = S.sampling_report(scoped, S.allocation_for(scoped, m), reqs).agg(F.avg("coverage").alias("coverage"))
    cited = citation_integrity(spark, sf_dir).select((F.col("cited") / F.col("questions")).alias("cited"))
    return E.gate([(report, "coverage", S.DEFAULTS.coverage_bar), (retrieval_eval(spark, sf_dir), "recall", S.DEFAULTS.recall_bar), (cited, "cited", 1.0)])


def reconcile_vectors(spark, sf_dir):
    r = I.reconcile(V.vectors(spark, sf_dir), V.chunks(spark, sf_dir))
    return r.select("chunk_id", "status")


def cascade_delete(spark, sf_dir):
    """Customers of one market segment go, with their orders and lines; parts lose their names only.

    Every 11th order has no customer and every 7th line an order that was never there; both stay.
    Rows left, and null keys among them, by table."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    t = {
        "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
        "orders": orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("c_custkey")),
        "lineitem": lines.select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 1_000_000_000).otherwise(0)).alias("o_orderkey"), "l_linenumber"),
        "part": table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("c_custkey")),
    }
    gone = t["customer"].filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    keys = [I.Key("orders", "c_custkey", "customer", "c_custkey"), I.Key("lineitem", "o_orderkey", "orders", "o_orderkey"), I.Key("part", "c_custkey", "customer", "c_custkey", I.SET_NULL)]
    left = I.cascade_delete(t, keys, gone, "customer")
    key = {"customer": "c_custkey", "orders": "c_custkey", "lineitem": "o_orderkey", "part": "c_custkey"}
    parts = [d.agg(F.count(F.lit(1)).alias("rows_left"), F.count_if(F.col(key[n]).isNull()).alias("nulls")).select(F.lit(n).alias("table_name"), "rows_left", "nulls") for n, d in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def cascade_closure(spark, sf_dir):
    """Parts are a tree by their numbers, each 13th a root of its own; every 97th goes with all below it.

    A line has a part and a stand-in part, which is only forgotten; rows left and nulls by table."""
    k = F.col("p_partkey")
    t = {
        "part": table(spark, sf_dir, "part").select("p_partkey", F.when((k > 1) & (k % 13 != 0), F.floor(k / 2)).alias("whole")),
        "lineitem": table(spark, sf_dir, "lineitem").select("l_partkey", F.floor(F.col("l_partkey") / 3).alias("other")),
    }
    keys = [I.Key("part", "whole", "part", "p_partkey"), I.Key("lineitem", "l_partkey", "part", "p_partkey"), I.Key("lineitem", "other", "part", "p_partkey", I.SET_NULL)]
    left = I.cascade_delete(t, keys, t["part"].filter(k % 97 == 0).select("p_partkey"), "part")
    return _left(left, {"part": ["whole"], "lineitem": ["other"]})


def _left(left, nullable):
    """table_name, rows_left, nulls: the last by column, comma-joined."""
    one = lambda n: F.concat_ws(",", *[F.count_if(F.col(c).isNull()).cast("string") for c in nullable.get(n, [])])
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows_left"), one(n).alias("nulls")).select(F.lit(n).alias("table_name"), "rows_left", "nulls") for n, d in left.items()])


def cascade_course(spark, sf_dir):
    """A course goes, with everything that hangs on it; rows left and nulls by table.

    Topics of the course next to it have parents in it, its passages cite topics of others, and
    questions of other quizzes, cards and answers name what goes."""
    chunks, orders = V.chunks(spark, sf_dir), table(spark, sf_dir, "orders")
    number = F.substring("course_id", 4, 9).cast("int")
    topic_of = lambda n: F.concat(F.lit("src"), n, F.lit("/en"))
    t = {
        "courses": chunks.select("course_id").distinct(),
        "documents": chunks.select("document_id", "course_id"),
        "topics": chunks.select("topic_id", "course_id").distinct().withColumn("parent_topic_id", topic_of(number - 1)),
        "chunks": chunks.select("chunk_id", "document_id", "course_id", F.when(F.col("chunk_id") % 7 == 0, topic_of(F.lit(3))).otherwise(F.col("topic_id")).alias("topic_id")),
        "vectors": V.vectors(spark, sf_dir).select("chunk_id"),
        "quizzes": orders.select(F.col("o_orderkey").alias("quiz_id"), F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("course_id")),
        "questions": V.questions(spark, sf_dir).select("question_id", "quiz_id", topic_of(F.col("question_id") % 20).alias("topic_id")),
        "attempts": orders.select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("quiz_id")),
        "answers": V.questions(spark, sf_dir).select(F.col("quiz_id").alias("attempt_id"), "question_id"),
        "cards": _cards(spark, sf_dir).withColumn("topic_id", topic_of(F.col("card_id") % 20)),
        "reviews": V.reviews(spark, sf_dir).select("review_id", "card_id"),
        "mastery": V.answers(spark, sf_dir).select("course_id", "topic_id").distinct().withColumn("topic_id", F.when(F.col("course_id") == "src5", topic_of(F.lit(3))).otherwise(F.col("topic_id"))),
    }
    left = I.cascade_delete(t, I.STUDY_KEYS, t["courses"].filter("course_id = 'src3'"), "courses")
    return _left(left, {"topics": ["parent_topic_id"], "chunks": ["topic_id"], "questions": ["topic_id"], "cards": ["topic_id"]})


def discard_derived(spark, sf_dir):
    """Passages of the documents that are labelled bad have changed."""
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("chunk_id"))
    gone, empty = I.discard_derived(V.questions(spark, sf_dir), bad)
    return gone.join(empty.withColumn("emptied", F.lit(True)), "quiz_id", "left").select("question_id", "quiz_id", F.coalesce("emptied", F.lit(False)).alias("emptied"))


def constraint_audit(spark, sf_dir):
    c, r = V.chunks(spark, sf_dir), V.reviews(spark, sf_dir)
    return I.audit([
        ("page_start <= page_end", c, F.col("page_start") <= F.col("page_end")),
        ("token_count >= 150", c, F.col("token_count") >= 150),
        ("rating in 1..4", r, F.col("rating").between(1, 4)),
        ("state known", r, F.col("state").isin("new", "learning", "review", "relearning")),
        ("stability >= 1", r, F.col("stability") >= 1),
    ])


def boxes(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("long")
    return i.select(F.col("l_orderkey").alias("slide"), (n % 3 * 1_000_000).alias("left"), (n * 150_000).alias("top"), F.lit(400_000).cast("long").alias("width"), F.lit(100_000).cast("long").alias("height"), F.concat("l_returnflag", n).alias("text"))


def interval_gaps(spark, sf_dir):
    return Y.interval_gaps(boxes(spark, sf_dir).withColumn("right", F.col("left") + F.col("width")), ["slide"], "left", "right")


def dominant_gap(spark, sf_dir):
    return Y.dominant_gap(interval_gaps(spark, sf_dir), ["slide"], Y.COLUMN_GUTTER)


def xy_cut(spark, sf_dir):
    return Y.xy_cut(boxes(spark, sf_dir)).select("slide", "text", "block")


def row_band(spark, sf_dir):
    return Y.row_bands(boxes(spark, sf_dir), ["slide"], 160_000)


_SQL = {
    "q_selected": "SELECT answer_id, CAST(question_id AS BIGINT) AS question_id, is_correct, (['A', 'B', 'C', 'D', 'E'])[student_id % 5 + 1] AS selected FROM v_answer",
    "q_given": "SELECT l_orderkey AS attempt_id, CAST(l_linenumber AS BIGINT) AS question_id, l_returnflag <> 'R' AS is_correct, CAST(l_suppkey % 10 AS INT) AS topic_id FROM lineitem",
    "q_taken": "SELECT o_orderkey AS attempt_id, o_custkey AS quiz_id, o_orderdate AS started_at, o_orderstatus <> 'F' AS open FROM orders",
    "q_last_review": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY reviewed_at DESC, review_id DESC) AS nth FROM v_review) WHERE nth = 1",
    "q_card": "SELECT 'src' || (user_id % 20) AS course_id, user_id * 10 + i AS card_id FROM (SELECT DISTINCT user_id FROM events), range(0, 10) r(i)",
    "q_card_state": f"SELECT c.*, r.state, r.stability, r.due_at, TIMESTAMP '{NOW}' AS now FROM q_card c LEFT JOIN q_last_review r USING (card_id)",
    "q_eval": """SELECT count(*) AS queries, count(r) AS hits, round(count(r) / count(*), 6) AS recall, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM (
        SELECT q.query_id, min(h.rank) AS r FROM (SELECT query_id FROM v_query WHERE query_id % 20 = 0) q LEFT JOIN q_hit h ON h.query_id = q.query_id AND h.chunk_id = q.query_id AND h.rank <= 5 GROUP BY 1)""",
    "q_cite": """SELECT count(*) AS questions, count(*) FILTER (len(source_chunk_ids) > 0 AND len(page_refs) > 0) AS cited, count(*) FILTER (c.chunk_id IS NOT NULL) AS resolvable,
        count(*) FILTER (page_refs[1] >= greatest(c.page_start, 1) AND page_refs[1] <= c.page_end AND page_refs[1] <= c.page_end - CASE WHEN c.chunk_id % 3 = 0 THEN 1 ELSE 0 END) AS in_range
        FROM v_question q LEFT JOIN v_chunk c ON c.chunk_id = q.source_chunk_ids[1]""",
    "v_box": "SELECT l_orderkey AS slide, l_linenumber % 3 * 1000000 AS l, l_linenumber * 150000 AS t, l_returnflag || l_linenumber AS text, l_linenumber FROM lineitem",
    "q_gap": """SELECT slide, l - reach AS size, reach + (l - reach) // 2 AS middle FROM (SELECT *, max(l + 400000) OVER (PARTITION BY slide ORDER BY l, l + 400000 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_box) WHERE l > reach""",
}


def _sql(body: str) -> str:
    return V.with_views(body, P._SQL | C._SQL | Q._SQL | _SQL)


QUERIES = {
    "grade_answers": grade_answers, "answer_source": answer_source, "topic_mastery": topic_mastery, "weak_topics": weak_topics, "missed_to_cards": missed_to_cards, "resume_attempts": resume_attempts,
    "quiz_progress": quiz_progress, "attempt_results": attempt_results, "latest_review": latest_review, "due_cards": due_cards, "deck_stats": deck_stats, "review_lapses": review_lapses,
    "schedule_replay": schedule_replay, "course_inventory": course_inventory, "retrieval_eval": retrieval_eval, "golden_eval": golden_eval, "run_failures": run_failures, "generation_failures": generation_failures, "citation_integrity": citation_integrity, "groundedness": groundedness,
    "generation_quality": generation_quality, "compare_runs": compare_runs, "quality_gate": quality_gate, "reconcile_vectors": reconcile_vectors, "cascade_delete": cascade_delete, "cascade_course": cascade_course, "cascade_closure": cascade_closure,
    "discard_derived": discard_derived, "constraint_audit": constraint_audit, "interval_gaps": interval_gaps, "dominant_gap": dominant_gap, "xy_cut": xy_cut, "row_band": row_band,
}

ORACLE_SQL = {
    "grade_answers": _sql("""SELECT answer_id, question_id, selected = 'A' AS is_correct, 'A' AS correct_option,
        CASE selected WHEN 'B' THEN why1 WHEN 'C' THEN why1 WHEN 'D' THEN why3 END AS why_wrong FROM q_selected JOIN v_mcq USING (question_id)"""),
    "answer_source": _sql("""SELECT answer_id, c.chunk_id, c.page_start, c.page_end, md5(left(c.text, 2000)) AS md5 FROM q_selected s LEFT JOIN v_mcq m USING (question_id) LEFT JOIN v_chunk c ON c.chunk_id = m.question_id"""),
    "topic_mastery": _sql("SELECT course_id, topic_id, attempts, correct, last_practised, round(accuracy, 6) AS accuracy FROM q_mastery"),
    "weak_topics": _sql("""SELECT course_id, topic_id || '/' || strftime(answered_at, '%H') AS topic_id, count(*) AS attempts, round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy FROM v_answer
        GROUP BY ALL HAVING count(*) FILTER (is_correct) / count(*) < 0.6"""),
    "missed_to_cards": _sql("""SELECT course_id, stem AS front, arg_min(o1, question_id) AS back, min(question_id) AS cites FROM v_mcq WHERE question_id IN (SELECT question_id FROM q_selected WHERE NOT is_correct)
        AND NOT EXISTS (SELECT 1 FROM v_mcq x WHERE x.difficulty = 'analysis' AND x.course_id = v_mcq.course_id AND x.stem = v_mcq.stem) GROUP BY ALL"""),
    "resume_attempts": _sql("""SELECT quiz_id, attempt_id, coalesce(answered, 0) AS answered, coalesce(ids, '') AS answered_ids FROM (
        SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY started_at DESC, attempt_id DESC) AS nth FROM q_taken WHERE open) JOIN customer ON c_custkey = quiz_id
        LEFT JOIN (SELECT attempt_id, count(*) AS answered, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) AS ids FROM q_given GROUP BY 1) USING (attempt_id) WHERE nth = 1 AND coalesce(answered, 0) < 7"""),
    "quiz_progress": _sql("""SELECT c_custkey AS quiz_id, 7 AS total, CASE WHEN open THEN coalesce(n, 0) ELSE 0 END AS answered, coalesce(open, false) AND coalesce(n, 0) < 7 AS in_progress FROM customer LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY quiz_id ORDER BY started_at DESC, attempt_id DESC) AS nth FROM q_taken) a ON a.quiz_id = c_custkey AND a.nth = 1
        LEFT JOIN (SELECT attempt_id, count(*) AS n FROM q_given GROUP BY 1) USING (attempt_id)"""),
    "attempt_results": _sql("""SELECT attempt_id, topic_id, answered, correct, CAST(sum(answered) OVER w AS BIGINT) AS attempt_answered, round(sum(correct) OVER w / sum(answered) OVER w, 6) AS score FROM (
        SELECT attempt_id, topic_id, count(*) AS answered, count(*) FILTER (is_correct) AS correct FROM q_given GROUP BY ALL) WINDOW w AS (PARTITION BY attempt_id)"""),
    "latest_review": _sql("SELECT card_id, review_id, rating, state, due_at FROM q_last_review"),
    "due_cards": _sql("""SELECT * FROM (SELECT course_id, card_id, row_number() OVER (PARTITION BY course_id ORDER BY due_at IS NOT NULL, due_at, card_id) AS place FROM q_card_state WHERE due_at IS NULL OR due_at <= now) WHERE place <= 50"""),
    "deck_stats": _sql("""SELECT course_id, count(*) AS total, count(*) FILTER (due_at IS NULL) AS new, count(*) FILTER (state IN ('learning', 'relearning')) AS learning,
        count(*) FILTER (due_at IS NOT NULL AND state NOT IN ('learning', 'relearning')) AS review, count(*) FILTER (stability >= 21) AS mature, count(*) FILTER (due_at IS NULL OR due_at <= now) AS due FROM q_card_state GROUP BY 1"""),
    "review_lapses": _sql("""SELECT review_id, card_id, CAST(sum(CASE WHEN rating = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY card_id ORDER BY reviewed_at, review_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lapses,
        round((floor(epoch(due_at)) - floor(epoch(reviewed_at))) / 86400.0, 6) AS interval_days FROM v_review"""),
    "course_inventory": _sql("""SELECT d.course_id, d.documents, c.topics, c.chunks, coalesce(k.cards, 0) AS cards FROM (SELECT source AS course_id, count(*) AS documents FROM documents GROUP BY 1) d
        LEFT JOIN (SELECT course_id, count(DISTINCT topic_id) AS topics, count(*) AS chunks FROM v_chunk GROUP BY 1) c USING (course_id) LEFT JOIN (SELECT course_id, count(*) AS cards FROM q_card GROUP BY 1) k USING (course_id)"""),
    "retrieval_eval": _sql("SELECT * FROM q_eval"),
    "golden_eval": _sql("""SELECT count(*) AS queries, count(r) AS hits, round(count(r) / count(*), 6) AS recall, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM (
        SELECT q.query_id, min(h.rank) AS r FROM (SELECT g.query_id, max(v.chunk_id) AS expected FROM v_query g JOIN v_vector v ON v.chunk_id % 5 = 0 AND v.chunk_id // 10 = g.query_id // 10 WHERE g.query_id % 20 = 0 AND g.query_id % 40 <> 0 GROUP BY 1) q
        LEFT JOIN q_hit h ON h.query_id = q.query_id AND h.chunk_id = q.expected AND h.rank <= 5 GROUP BY 1)"""),
    "citation_integrity": _sql("SELECT * FROM q_cite"),
    "run_failures": """SELECT event_type AS label, 'C' || (k % 7) AS code, count(*) AS failures FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k % 5 = 0 GROUP BY ALL""",
    "generation_failures": _sql("SELECT course_id, l_returnflag AS code, count(*) AS failures FROM lineitem JOIN v_quiz ON quiz_id = l_orderkey GROUP BY ALL"),
    "groundedness": _sql("""SELECT question_id, round(len(list_intersect(e, p)) / len(e), 6) AS overlap, len(list_intersect(e, p)) / len(e) >= 0.3 AS grounded FROM (
        SELECT m.question_id, list_distinct(list_filter(regexp_extract_all(lower(m.explanation), '[a-z0-9]+'), lambda w: length(w) >= 5)) AS e,
        list_distinct(list_filter(regexp_extract_all(lower(CASE WHEN m.question_id % 2 = 0 THEN m.passage ELSE coalesce(o.passage, '') END), '[a-z0-9]+'), lambda w: length(w) >= 5)) AS p
        FROM v_mcq m LEFT JOIN v_mcq o ON o.question_id = m.question_id + 1) WHERE len(e) > 0"""),
    "generation_quality": _sql("""SELECT course_id, count(*) AS quizzes, CAST(sum(n) AS BIGINT) AS questions, round(sum(rate * n) / sum(n), 6) AS pass_rate, round(quantile_cont(ms, 0.5), 6) AS latency_p50,
        round(quantile_cont(ms, 0.95), 6) AS latency_p95, round(max(ms), 6) AS latency_max FROM (SELECT course_id, n, duration_ms / (n + 1) AS ms, CASE status WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END::DOUBLE AS rate
        FROM v_quiz JOIN (SELECT quiz_id, count(*) AS n FROM v_question GROUP BY 1) USING (quiz_id)) GROUP BY 1"""),
    "compare_runs": """WITH e AS (SELECT event_type AS label, k % 2 + 1 AS attempt, k % 5 = 0 AS bad, CAST(printf('%.3f', value) AS DOUBLE) AS ms FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ms) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM e)
        SELECT label, count(*) AS questions, count(*) FILTER (NOT bad AND attempt = 1) AS first_attempt, count(*) FILTER (bad) AS failures, round(quantile_cont(ms, 0.5), 6) AS p50,
        round(max(ms) FILTER (place = least(n - 1, floor(n * 0.95))), 6) AS p95 FROM r GROUP BY 1""",
    "quality_gate": _sql("""SELECT metric, round(value, 6) AS value, bar, round(value, 6) >= bar AS passed FROM (
        SELECT 'coverage' AS metric, avg(c) AS value, 0.9::DOUBLE AS bar FROM (SELECT r.request_id, coalesce(round(count(DISTINCT a.topic_id) FILTER (a.allocated > 0) / nullif(count(DISTINCT a.topic_id), 0), 6), 0.0) AS c FROM q_request r LEFT JOIN q_alloc a USING (request_id) GROUP BY 1)
        UNION ALL SELECT 'recall', recall, 0.8 FROM q_eval UNION ALL SELECT 'cited', cited / questions, 1.0 FROM q_cite)"""),
    "reconcile_vectors": _sql("""SELECT coalesce(v.chunk_id, c.chunk_id) AS chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'orphan' WHEN v.chunk_id IS NULL THEN 'missing' ELSE 'ok' END AS status
        FROM (SELECT DISTINCT chunk_id FROM v_vector) v FULL JOIN v_chunk c ON c.chunk_id = v.chunk_id"""),
    "cascade_delete": """WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
        o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS c FROM orders), dead AS (SELECT o_orderkey FROM o WHERE c IN (SELECT c_custkey FROM gone)),
        l AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS k FROM lineitem)
        SELECT 'customer' AS table_name, count(*) AS rows_left, 0 AS nulls FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
        UNION ALL SELECT 'orders', count(*), count(*) FILTER (c IS NULL) FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dead)
        UNION ALL SELECT 'lineitem', count(*), 0 FROM l WHERE k NOT IN (SELECT o_orderkey FROM dead)
        UNION ALL SELECT 'part', count(*), count(*) FILTER (p_partkey IN (SELECT c_custkey FROM gone)) FROM part""",
    "cascade_closure": """WITH RECURSIVE t AS (SELECT p_partkey AS p, CASE WHEN p_partkey > 1 AND p_partkey % 13 <> 0 THEN p_partkey // 2 END AS whole FROM part),
        dead AS (SELECT p FROM t WHERE p % 97 = 0 UNION SELECT t.p FROM t JOIN dead ON t.whole = dead.p)
        SELECT 'part' AS table_name, count(*) AS rows_left, CAST(count(*) FILTER (whole IS NULL) AS VARCHAR) AS nulls FROM t WHERE p NOT IN (SELECT p FROM dead)
        UNION ALL SELECT 'lineitem', count(*), CAST(count(*) FILTER (l_partkey // 3 IN (SELECT p FROM dead)) AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p FROM dead)""",
    "cascade_course": _sql("""WITH lost_topic AS (SELECT DISTINCT topic_id FROM v_chunk WHERE course_id = 'src3'), lost_quiz AS (SELECT o_orderkey FROM orders WHERE o_custkey % 20 = 3),
        lost_question AS (SELECT question_id FROM v_question WHERE quiz_id IN (SELECT o_orderkey FROM lost_quiz)), lost_attempt AS (SELECT o_orderkey FROM orders WHERE o_orderkey + o_orderkey % 2 IN (SELECT o_orderkey FROM lost_quiz)),
        left_rows AS (SELECT 'courses' AS table_name, count(DISTINCT course_id) AS rows_left, NULL AS nulls FROM v_chunk WHERE course_id <> 'src3'
        UNION ALL SELECT 'documents', count(*), NULL FROM v_chunk WHERE course_id <> 'src3'
        UNION ALL SELECT 'topics', count(*), count(*) FILTER ('src' || (CAST(substr(course_id, 4) AS INT) - 1) || '/en' IN (SELECT topic_id FROM lost_topic)) FROM (SELECT DISTINCT course_id, topic_id FROM v_chunk WHERE course_id <> 'src3')
        UNION ALL SELECT 'chunks', count(*), count(*) FILTER (CASE WHEN chunk_id % 7 = 0 THEN 'src3/en' ELSE topic_id END IN (SELECT topic_id FROM lost_topic)) FROM v_chunk WHERE course_id <> 'src3'
        UNION ALL SELECT 'vectors', count(*), NULL FROM v_vector WHERE chunk_id NOT IN (SELECT chunk_id FROM v_chunk WHERE course_id = 'src3')
        UNION ALL SELECT 'quizzes', count(*), NULL FROM orders WHERE o_custkey % 20 <> 3
        UNION ALL SELECT 'attempts', count(*), NULL FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lost_attempt)
        UNION ALL SELECT 'questions', count(*), count(*) FILTER ('src' || (question_id % 20) || '/en' IN (SELECT topic_id FROM lost_topic)) FROM v_question WHERE question_id NOT IN (SELECT question_id FROM lost_question)
        UNION ALL SELECT 'answers', count(*), NULL FROM v_question WHERE quiz_id NOT IN (SELECT o_orderkey FROM lost_attempt) AND question_id NOT IN (SELECT question_id FROM lost_question)
        UNION ALL SELECT 'cards', count(*), count(*) FILTER ('src' || (card_id % 20) || '/en' IN (SELECT topic_id FROM lost_topic)) FROM q_card WHERE course_id <> 'src3'
        UNION ALL SELECT 'reviews', count(*), NULL FROM v_review WHERE card_id NOT IN (SELECT card_id FROM q_card WHERE course_id = 'src3')
        UNION ALL SELECT 'mastery', count(*), NULL FROM (SELECT course_id, CASE WHEN course_id = 'src5' THEN 'src3/en' ELSE topic_id END AS topic_id FROM (SELECT DISTINCT course_id, topic_id FROM v_answer))
            WHERE course_id <> 'src3' AND topic_id NOT IN (SELECT topic_id FROM lost_topic))
        SELECT table_name, rows_left, coalesce(CAST(nulls AS VARCHAR), '') AS nulls FROM left_rows"""),
    "discard_derived": _sql("""SELECT q.question_id, q.quiz_id, NOT EXISTS (SELECT 1 FROM v_question x WHERE x.quiz_id = q.quiz_id AND x.source_chunk_ids[1] NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) AS emptied
        FROM v_question q WHERE q.source_chunk_ids[1] IN (SELECT doc_id FROM labels WHERE quality = 0)"""),
    "constraint_audit": _sql("""SELECT 'page_start <= page_end' AS rule, count(*) AS rows, count(*) FILTER (page_start > page_end) AS violations FROM v_chunk
        UNION ALL SELECT 'token_count >= 150', count(*), count(*) FILTER (token_count < 150) FROM v_chunk UNION ALL SELECT 'rating in 1..4', count(*), count(*) FILTER (rating NOT BETWEEN 1 AND 4) FROM v_review
        UNION ALL SELECT 'state known', count(*), count(*) FILTER (state NOT IN ('new', 'learning', 'review', 'relearning')) FROM v_review UNION ALL SELECT 'stability >= 1', count(*), count(*) FILTER (NOT coalesce(stability >= 1, false)) FROM v_review"""),
    "interval_gaps": _sql("SELECT * FROM q_gap"),
    "dominant_gap": _sql("""SELECT slide, size, middle FROM (SELECT *, row_number() OVER w AS nth, lead(size) OVER w AS second FROM q_gap WINDOW w AS (PARTITION BY slide ORDER BY size DESC, middle DESC))
        WHERE nth = 1 AND size >= 365760 AND (second IS NULL OR size >= 2 * second)"""),
    "row_band": _sql("""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY t, l, text) AS rn FROM v_box),
        f AS (SELECT slide, rn, t AS anchor, 0 AS row, l, text FROM b WHERE rn = 1
        UNION ALL SELECT b.slide, b.rn, CASE WHEN abs(b.t - f.anchor) > 160000 THEN b.t ELSE f.anchor END, f.row + CASE WHEN abs(b.t - f.anchor) > 160000 THEN 1 ELSE 0 END, b.l, b.text FROM f JOIN b ON b.slide = f.slide AND b.rn = f.rn + 1)
        SELECT slide, row, string_agg(text, ' | ' ORDER BY l, rn) AS line FROM f GROUP BY ALL"""),
}
