"""Answers, mastery, cards and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables


def mastery(answers: DataFrame) -> DataFrame:
    """course_id, topic_id, attempts, correct, accuracy, last_practised; null topics are left out."""
    a = answers.filter(F.col("topic_id").isNotNull()).groupBy("course_id", "topic_id")
    m = a.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("is_correct").alias("correct"), F.max("answered_at").alias("last_practised"))
    return m.withColumn("accuracy", F.col("correct") / F.col("attempts"))


def weak_topics(m: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    return m.filter(F.col("accuracy") < t.weak_accuracy)


def graded(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answer_id, question_id, is_correct, correct_option, why_wrong (of a wrong choice only).

    questions has options (id, text, is_correct, why_wrong); answers has selected, which may be
    null or name no option: that is wrong."""
    j = answers.select("answer_id", "question_id", "selected").join(questions.select("question_id", "options"), "question_id")
    chosen = F.get(F.filter("options", lambda o: o["id"] == F.col("selected")), F.lit(0))
    right = F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))
    j = j.withColumn("chosen", chosen).withColumn("right", right)
    ok = F.coalesce(F.col("chosen.is_correct"), F.lit(False))
    return j.select("answer_id", "question_id", ok.alias("is_correct"), F.col("right.id").alias("correct_option"), F.when(~ok, F.col("chosen.why_wrong")).alias("why_wrong"))


def missed_cards(answers: DataFrame, questions: DataFrame, existing: DataFrame) -> DataFrame:
    """A card for each wrongly answered question that has a right option and a citation.

    One card for each course and front; those in existing (course_id, front) are left out. The
    card's id is a hash of what it stands for, so that a rerun makes the same card."""
    right = F.get(F.filter("options", lambda o: o["is_correct"]), F.lit(0))
    wrong = answers.filter(~F.col("is_correct")).select("question_id").distinct()
    c = questions.join(wrong, "question_id", "left_semi").filter(right.isNotNull() & (F.size("source_chunk_ids") > 0))
    c = c.groupBy("course_id", F.col("stem").alias("front")).agg(F.min_by(F.struct(right["text"].alias("back"), F.col("source_chunk_ids")), "question_id").alias("q"))
    c = c.join(existing.select("course_id", "front"), ["course_id", "front"], "left_anti")
    key = F.sha2(F.concat_ws("|", "course_id", "front", F.lit("missed_question")), 256)
    return c.select(key.alias("card_id"), "course_id", "front", F.col("q.back").alias("back"), F.col("q.source_chunk_ids").alias("source_chunk_ids"), F.lit("missed_question").alias("origin"))


def latest_review(reviews: DataFrame) -> DataFrame:
    """The last review of each card; of two at one time that of the larger id."""
    rest = [c for c in reviews.columns if c != "card_id"]
    last = reviews.groupBy("card_id").agg(F.max_by(F.struct(*rest), F.struct("reviewed_at", "review_id")).alias("r"))
    return last.select("card_id", "r.*")


def due_cards(cards: DataFrame, latest: DataFrame, now: Column, t: Tunables = DEFAULTS) -> DataFrame:
    """course_id, card_id, place: never reviewed cards first, then those due by now, earliest first."""
    j = cards.select("course_id", "card_id").join(latest.select("card_id", "due_at"), "card_id", "left")
    j = j.filter(F.col("due_at").isNull() | (F.col("due_at") <= now))
    order = Window.partitionBy("course_id").orderBy(F.col("due_at").isNotNull(), "due_at", "card_id")
    return j.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= t.due_limit)


def deck_stats(cards: DataFrame, latest: DataFrame, now: Column, t: Tunables = DEFAULTS) -> DataFrame:
    j = cards.select("course_id", "card_id").join(latest.select("card_id", "state", "stability", "due_at"), "card_id", "left")
    new = F.col("due_at").isNull()
    learning = F.col("state").isin("learning", "relearning")
    return j.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(new).alias("new"), F.count_if(~new & learning).alias("learning"), F.count_if(~new & ~learning).alias("review"),
        F.count_if(~new & (F.col("stability") >= t.mature_stability)).alias("mature"), F.count_if(new | (F.col("due_at") <= now)).alias("due"),
    )


def lapses(reviews: DataFrame) -> DataFrame:
    """review_id, card_id, lapses so far, interval_days to the due time."""
    upto = Window.partitionBy("card_id").orderBy("reviewed_at", "review_id").rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.unix_timestamp(F.col("due_at").cast("timestamp")) - F.unix_timestamp(F.col("reviewed_at").cast("timestamp"))
    return reviews.select("review_id", "card_id", F.sum((F.col("rating") == 1).cast("int")).over(upto).alias("lapses"), F.round(seconds / 86400.0, 6).alias("interval_days"))


def answer_source(answers: DataFrame, questions: DataFrame, chunks: DataFrame, most: int = 2000) -> DataFrame:
    """answer_id, chunk_id, document_id, page_start, page_end, text of the first passage cited."""
    cited = questions.select("question_id", F.get("source_chunk_ids", F.lit(0)).alias("chunk_id"))
    j = answers.select("answer_id", "question_id").join(cited, "question_id", "left").join(chunks.select("chunk_id", "document_id", "page_start", "page_end", "text"), "chunk_id", "left")
    return j.select("answer_id", "chunk_id", "document_id", "page_start", "page_end", F.left("text", F.lit(most)).alias("text"))


def _latest(attempts: DataFrame) -> DataFrame:
    order = Window.partitionBy("quiz_id").orderBy(F.desc("started_at"), F.desc("attempt_id"))
    return attempts.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def resume_attempts(attempts: DataFrame, answers: DataFrame, totals: DataFrame) -> DataFrame:
    """quiz_id, attempt_id, answered, answered_ids of the latest open attempt that isn't complete."""
    last = _latest(attempts.filter("open"))
    given = answers.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("answered"), F.array_sort(F.collect_list("question_id")).alias("answered_ids"))
    j = last.join(given, "attempt_id", "left").join(totals, "quiz_id").withColumn("answered", F.coalesce("answered", F.lit(0)))
    return j.filter(F.col("answered") < F.col("total")).select("quiz_id", "attempt_id", "answered", F.coalesce("answered_ids", F.array().cast("array<long>")).alias("answered_ids"))


def quiz_progress(attempts: DataFrame, answers: DataFrame, totals: DataFrame) -> DataFrame:
    """quiz_id, total, answered (0 where the latest attempt is finished), in_progress."""
    given = answers.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("answered"))
    j = totals.join(_latest(attempts), "quiz_id", "left").join(given, "attempt_id", "left")
    live = F.coalesce("open", F.lit(False))
    n = F.when(live, F.coalesce("answered", F.lit(0))).otherwise(F.lit(0))
    return j.select("quiz_id", "total", n.alias("answered"), (live & (n < F.col("total"))).alias("in_progress"))


def attempt_results(answers: DataFrame) -> DataFrame:
    """attempt_id, topic_id, answered, correct, and the attempt's answered and score."""
    by_topic = answers.groupBy("attempt_id", "topic_id").agg(F.count(F.lit(1)).alias("answered"), F.count_if("is_correct").alias("correct"))
    own = Window.partitionBy("attempt_id")
    total, right = F.sum("answered").over(own), F.sum("correct").over(own)
    return by_topic.select("attempt_id", "topic_id", "answered", "correct", total.alias("attempt_answered"), F.coalesce(F.try_divide(right, total), F.lit(0.0)).alias("score"))


def course_inventory(documents: DataFrame, chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """course_id with its documents, topics, passages and cards."""
    d = documents.groupBy("course_id").agg(F.count(F.lit(1)).alias("documents"))
    c = chunks.groupBy("course_id").agg(F.countDistinct("topic_id").alias("topics"), F.count(F.lit(1)).alias("chunks"))
    k = cards.groupBy("course_id").agg(F.count(F.lit(1)).alias("cards"))
    return d.join(c, "course_id", "left").join(k, "course_id", "left").na.fill(0)
