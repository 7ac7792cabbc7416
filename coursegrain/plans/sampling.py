"""Queries of coverage sampling, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import once
from ..operators import learning as L
from ..operators import sampling as S
from ..sources import views as V

REQUESTED, SEED = 13, 7


def requests(chunks: DataFrame) -> DataFrame:
    """One request for each course; every third asks for topics of one language only."""
    none = F.array().cast("array<string>")
    r = chunks.select("course_id").distinct().withColumn("request_id", F.concat(F.lit("quiz-"), "course_id"))
    only = F.when(F.length("course_id") == 4, none).otherwise(F.array(F.concat("course_id", F.lit("/en")), F.concat("course_id", F.lit("/fr"))))
    return r.select("request_id", "course_id", F.lit(REQUESTED).alias("n"), only.alias("topic_ids"), F.array().cast("array<long>").alias("document_ids"))


def _inputs(spark: SparkSession, sf_dir: str):
    # A passage's words are counted once, not in each filter and column that names their number.
    chunks = once(V.chunks(spark, sf_dir), ["chunk_id", "document_id", "course_id", "topic_id", "usage"], token_count=F.col("token_count"))
    return chunks, requests(chunks), L.mastery(V.answers(spark, sf_dir))


def scope_filter(spark, sf_dir):
    chunks, reqs, _ = _inputs(spark, sf_dir)
    return S.in_scope(chunks, reqs).select("request_id", "chunk_id", "topic_id", "token_count")


def topic_stats(spark, sf_dir):
    chunks, reqs, m = _inputs(spark, sf_dir)
    return S.topic_stats(S.in_scope(chunks, reqs), m).select("request_id", "topic_id", "chunk_count", F.round("mean_usage", 6).alias("mean_usage"), F.round("accuracy", 6).alias("accuracy"))


def topic_weights(spark, sf_dir):
    chunks, reqs, m = _inputs(spark, sf_dir)
    return S.topic_weights(S.topic_stats(S.in_scope(chunks, reqs), m)).select("request_id", "topic_id", F.round("weight", 6).alias("weight"))


def allocate_quota(spark, sf_dir):
    chunks, reqs, m = _inputs(spark, sf_dir)
    return S.allocate_quota(S.topic_weights(S.topic_stats(S.in_scope(chunks, reqs), m))).select("request_id", "topic_id", "capacity", "quota")


def allocate_capped(spark, sf_dir):
    chunks, reqs, m = _inputs(spark, sf_dir)
    return S.allocation_for(S.in_scope(chunks, reqs), m).select("request_id", "topic_id", "capacity", "allocated")


def sample_chunks(spark, sf_dir):
    return S.sample_chunks(*_inputs(spark, sf_dir), SEED)


def sampling_report(spark, sf_dir):
    chunks, reqs, m = _inputs(spark, sf_dir)
    scoped = S.in_scope(chunks, reqs)
    return S.sampling_report(scoped, S.allocation_for(scoped, m), reqs)


def scope_size(spark, sf_dir):
    chunks, reqs, _ = _inputs(spark, sf_dir)
    s = S.in_scope(chunks, reqs).groupBy("request_id").agg(F.count(F.lit(1)).alias("concepts"), F.countDistinct("topic_id").alias("topics"))
    return s.withColumn("seconds", F.col("concepts") * S.DEFAULTS.seconds_per_concept)


def usage_counts(spark, sf_dir):
    """Uses of each passage: its own count and the questions that cite it."""
    cited = V.questions(spark, sf_dir).select(F.explode("source_chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("cited"))
    chunks = V.chunks(spark, sf_dir).select("chunk_id", "usage")
    return chunks.join(cited, "chunk_id", "left").select("chunk_id", (F.col("usage") + F.coalesce("cited", F.lit(0))).alias("usage"))


def coverage_eval(spark, sf_dir):
    return S.coverage_rounds(*_inputs(spark, sf_dir))


_SQL = {
    "q_request": f"""SELECT DISTINCT 'quiz-' || course_id AS request_id, course_id, {REQUESTED} AS n,
        CASE WHEN length(course_id) = 4 THEN [] ELSE [course_id || '/en', course_id || '/fr'] END AS topic_ids FROM v_chunk""",
    "q_scope": """SELECT r.request_id, r.n, c.* FROM v_chunk c JOIN q_request r USING (course_id)
        WHERE c.token_count >= 150 AND c.topic_id IS NOT NULL AND (len(r.topic_ids) = 0 OR list_contains(r.topic_ids, c.topic_id))""",
    "q_mastery": """SELECT course_id, topic_id, count(*) AS attempts, count(*) FILTER (is_correct) AS correct, max(answered_at) AS last_practised,
        count(*) FILTER (is_correct) / count(*) AS accuracy FROM v_answer WHERE topic_id IS NOT NULL GROUP BY ALL""",
    "q_stats": """SELECT s.*, m.accuracy FROM (SELECT request_id, course_id, topic_id, n, count(*) AS chunk_count, avg(usage) AS mean_usage FROM q_scope GROUP BY ALL) s
        LEFT JOIN q_mastery m USING (course_id, topic_id)""",
    "q_weight": """SELECT *, round(chunk_count / sum(chunk_count) OVER (PARTITION BY request_id) * (1.0 / (1.0 + mean_usage))
        * CASE WHEN accuracy IS NULL THEN 1.0 ELSE least(2.0 - accuracy, 2.0) END, 12) AS weight FROM q_stats""",
    "q_exact": """SELECT *, n - sum(first_one) OVER r AS rest, round((n - sum(first_one) OVER r) * weight / sum(weight) OVER r, 9) AS exact
        FROM (SELECT *, CASE WHEN n >= count(*) OVER (PARTITION BY request_id) THEN 1 ELSE 0 END AS first_one FROM q_weight WHERE chunk_count > 0)
        WINDOW r AS (PARTITION BY request_id)""",
    "q_quota": """SELECT request_id, topic_id, weight, chunk_count AS capacity,
        CAST(first_one + floor(exact) + CASE WHEN row_number() OVER (PARTITION BY request_id ORDER BY round(exact - floor(exact), 9) DESC, weight DESC, topic_id)
            <= rest - sum(floor(exact)) OVER (PARTITION BY request_id) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q_exact""",
    "q_slack": """SELECT *, least(quota, capacity) AS taken, capacity - least(quota, capacity) AS slack,
        CAST(sum(quota - least(quota, capacity)) OVER (PARTITION BY request_id) AS BIGINT) AS surplus FROM q_quota""",
    "q_extra": """SELECT request_id, topic_id, count(*) AS extra FROM (
        SELECT request_id, topic_id, surplus, row_number() OVER (PARTITION BY request_id ORDER BY r, weight DESC, topic_id) AS nth
        FROM (SELECT *, unnest(range(1, least(slack, surplus) + 1)) AS r FROM q_slack WHERE slack > 0 AND surplus > 0)) WHERE nth <= surplus GROUP BY ALL""",
    "q_alloc": """SELECT s.request_id, s.topic_id, s.capacity, s.taken + coalesce(e.extra, 0) AS allocated FROM q_slack s LEFT JOIN q_extra e USING (request_id, topic_id)""",
}


_TAKE = """SELECT request_id, topic_id, chunk_id, rank_in_topic FROM (
        SELECT s.request_id, s.topic_id, s.chunk_id, a.allocated,
               row_number() OVER (PARTITION BY s.request_id, s.topic_id ORDER BY s.usage, md5('{seed}|' || s.chunk_id), s.chunk_id) AS rank_in_topic
        FROM q_scope s JOIN q_alloc a USING (request_id, topic_id)) WHERE rank_in_topic <= allocated"""


def _round_views(rounds: int) -> dict[str, str]:
    """The views of each of several samples, w_..._i: what was taken before counts as used."""
    names = [n for n in _SQL if n not in ("q_request", "q_mastery")]
    out: dict[str, str] = {}
    for i in range(rounds):
        own = {n: n.replace("q_", "w_") + f"_{i}" for n in names} | ({"v_chunk": f"w_chunk_{i}"} if i else {})
        here = lambda text: re.sub(r"\b[qv]_[a-z]+\b", lambda m: own.get(m[0], m[0]), text)  # noqa: E731, B023
        if i:
            before = " UNION ALL ".join(f"SELECT chunk_id FROM w_take_{j}" for j in range(i))
            out[f"w_chunk_{i}"] = f"SELECT c.* REPLACE (c.usage + coalesce(t.n, 0) AS usage) FROM v_chunk c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM ({before}) GROUP BY 1) t USING (chunk_id)"
        out |= {own[n]: here(_SQL[n]) for n in names}
        out[f"w_take_{i}"] = here(_TAKE.format(seed=i))
    return out


_ROUNDS = 5
_SEEN = " UNION ALL ".join(f"SELECT {i} AS round, {j} AS drawn, * FROM w_take_{j}" for i in range(_ROUNDS) for j in range(i + 1))


def _sql(body: str) -> str:
    return V.with_views(body, _SQL | _round_views(_ROUNDS))


QUERIES = {
    "sample_chunks": sample_chunks, "scope_filter": scope_filter, "topic_stats": topic_stats, "topic_weights": topic_weights, "allocate_quota": allocate_quota,
    "allocate_capped": allocate_capped, "sampling_report": sampling_report, "scope_size": scope_size, "usage_counts": usage_counts, "coverage_eval": coverage_eval,
}

ORACLE_SQL = {
    "scope_filter": _sql("SELECT request_id, chunk_id, topic_id, token_count FROM q_scope"),
    "topic_stats": _sql("SELECT request_id, topic_id, chunk_count, round(mean_usage, 6) AS mean_usage, round(accuracy, 6) AS accuracy FROM q_stats"),
    "topic_weights": _sql("SELECT request_id, topic_id, round(weight, 6) AS weight FROM q_weight"),
    "allocate_quota": _sql("SELECT request_id, topic_id, capacity, quota FROM q_quota"),
    "allocate_capped": _sql("SELECT request_id, topic_id, capacity, allocated FROM q_alloc"),
    "sample_chunks": _sql(_TAKE.format(seed=SEED)),
    "coverage_eval": _sql(f"""SELECT round, request_id, topics_in_round, topics_covered, chunks_covered, round(topics_covered / topics, 6) AS topic_coverage, round(chunks_covered / chunks, 6) AS chunk_coverage,
        round(topics_covered / nullif(able_topics, 0), 6) AS able_topic_coverage, round(chunks_covered / nullif(able_chunks, 0), 6) AS able_chunk_coverage FROM (
        SELECT round, request_id, nullif(count(DISTINCT topic_id) FILTER (drawn = round), 0) AS topics_in_round, count(DISTINCT topic_id) AS topics_covered, count(DISTINCT chunk_id) AS chunks_covered FROM ({_SEEN}) GROUP BY ALL)
        JOIN q_request USING (request_id) JOIN (SELECT course_id, count(DISTINCT topic_id) AS topics, count(*) AS chunks, count(DISTINCT topic_id) FILTER (token_count >= 150) AS able_topics,
        count(*) FILTER (token_count >= 150) AS able_chunks FROM v_chunk GROUP BY 1) USING (course_id)"""),
    "sampling_report": _sql("""SELECT r.request_id, r.n AS requested, coalesce(s.in_scope, 0) AS in_scope, coalesce(s.topics_in_scope, 0) AS topics_in_scope,
        coalesce(g.delivered, 0) AS delivered, coalesce(g.topics_covered, 0) AS topics_covered,
        CASE WHEN coalesce(s.topics_in_scope, 0) = 0 THEN 0.0 ELSE round(g.topics_covered / s.topics_in_scope, 6) END AS coverage,
        CASE WHEN coalesce(s.in_scope, 0) = 0 THEN 'no passage in scope' WHEN g.delivered < r.n THEN 'scope smaller than request' END AS shortfall
        FROM q_request r LEFT JOIN (SELECT request_id, count(*) AS in_scope, count(DISTINCT topic_id) AS topics_in_scope FROM q_scope GROUP BY 1) s USING (request_id)
        LEFT JOIN (SELECT request_id, CAST(sum(allocated) AS BIGINT) AS delivered, count(*) FILTER (allocated > 0) AS topics_covered FROM q_alloc GROUP BY 1) g USING (request_id)"""),
    "scope_size": _sql("SELECT request_id, count(*) AS concepts, count(DISTINCT topic_id) AS topics, count(*) * 25 AS seconds FROM q_scope GROUP BY 1"),
    "usage_counts": _sql("""SELECT c.chunk_id, c.usage + coalesce(q.cited, 0) AS usage FROM v_chunk c LEFT JOIN (
        SELECT chunk_id, count(*) AS cited FROM (SELECT unnest(source_chunk_ids) AS chunk_id FROM v_question) GROUP BY 1) q USING (chunk_id)"""),
}
