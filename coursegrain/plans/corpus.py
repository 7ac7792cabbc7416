"""Queries of ingest, topics and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import retrieval as R
from ..operators import topics as P
from ..sources import ingest as I
from ..sources import views as V
from ..sources.tables import table


def doc_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


def _incoming(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("course_id"), F.sha2("text", 256).alias("sha"))


def ingest_dedup(spark, sf_dir):
    """The registry holds the labelled documents: quality 1 is complete, 0 has failed."""
    incoming = _incoming(spark, sf_dir)
    status = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "complete").otherwise("failed").alias("status"))
    return I.ingest_plan(incoming, incoming.join(status, "document_id"))


def ingest_status(spark, sf_dir):
    chunks = V.chunks(spark, sf_dir).filter(F.col("token_count") >= DEFAULTS.min_tokens_for_generation)
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return I.ingest_status(docs, counts, F.concat(F.lit("no passage in: "), "text"))


def low_text_documents(spark, sf_dir):
    return I.low_text(V.pages(spark, sf_dir)).withColumn("chars_per_page", F.round("chars_per_page", 6))


def vector_upsert(spark, sf_dir):
    """The documents that have two vectors come again under other topics."""
    v = V.vectors(spark, sf_dir)
    again = v.filter(F.col("chunk_id") >= 1_000_000).select("document_id")
    incoming = v.join(again, "document_id", "left_semi").withColumn("topic_id", F.col("topic_id") + 100)
    return I.upsert_vectors(v, incoming.select(*v.columns)).select("chunk_id", "document_id", "topic_id")


def vector_contract(spark, sf_dir):
    return I.vector_contract(V.vectors(spark, sf_dir), V.chunks(spark, sf_dir), 64)


def vector_payload(spark, sf_dir):
    return I.vector_payload(V.chunks(spark, sf_dir)).withColumn("section_path", F.array_join("section_path", "/"))


def sections(spark, sf_dir):
    """Passages under their source and a heading of language and first letter; sources that end in 9 have no headings."""
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("source").endswith("9"), F.array("source")).otherwise(F.array("source", F.concat("lang", F.lit("-"), F.left("text", F.lit(1)))))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("course_id"), path.alias("section_path"))


def section_counts(spark, sf_dir):
    return P.section_counts(sections(spark, sf_dir)).withColumn("section_path", F.array_join("section_path", " / "))


def topic_strategy(spark, sf_dir):
    return P.topic_strategy(sections(spark, sf_dir))


def topic_map(spark, sf_dir):
    t = P.chunk_topics(sections(spark, sf_dir))
    return t.groupBy("course_id", "topic_key").agg(F.count(F.lit(1)).alias("chunk_count"))


def topic_tree(spark, sf_dir):
    return P.topic_tree(sections(spark, sf_dir))


def chunk_topics(spark, sf_dir):
    return P.chunk_topics(sections(spark, sf_dir))


def leaf_topics(spark, sf_dir):
    return P.leaf_topics(P.topic_tree(sections(spark, sf_dir))).select("course_id", "topic_key", "name")


#: What stands before and after a label, by the size of the part.
_AROUND = [("", ""), ('\u00a0"', '..."\t'), ('"', '"...'), ("'", "'.. "), ("\"'", "'\""), ("'\"", " .")]


def clean_labels(spark, sf_dir):
    """Labels are part names in quotes, single quotes, full stops and white space by their size; size 50 is blank."""
    p = table(spark, sf_dir, "part")
    shaped = F.lit(None).cast("string")
    for i, (before, after) in enumerate(_AROUND):
        shaped = F.when(F.col("p_size") % len(_AROUND) == i, F.concat(F.lit(before), "p_name", F.lit(after))).otherwise(shaped)
    raw = F.when(F.col("p_size") == 50, F.lit(' "" ')).when(F.col("p_size") == 49, F.lit(". . ")).otherwise(shaped)
    return p.select("p_partkey", P.clean_label(raw).alias("label"))


def cluster_topics(spark, sf_dir):
    return P.cluster_topics(V.vectors(spark, sf_dir))


def fallback_topics(spark, sf_dir):
    return P.fallback_topics(sections(spark, sf_dir), V.vectors(spark, sf_dir))


def mirror_topics(spark, sf_dir):
    return P.mirror_topics(V.vectors(spark, sf_dir), P.chunk_topics(sections(spark, sf_dir))).select("chunk_id", "course_id", "topic_key")


def _queries(spark, sf_dir):
    """Every row whose id is divisible by 20, against all rows of its course."""
    q = V.query_vectors(spark, sf_dir).filter(F.col("query_id") % 20 == 0)
    return q.withColumn("course_id", (F.col("query_id") % 5).cast("int"))


def vector_topk(spark, sf_dir):
    hits = R.vector_topk(_queries(spark, sf_dir), V.vectors(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_lsh(spark, sf_dir):
    hits = R.vector_topk_lsh(_queries(spark, sf_dir), V.vectors(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_ivf(spark, sf_dir):
    hits = R.vector_topk_ivf(_queries(spark, sf_dir), V.vectors(spark, sf_dir))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_counts(spark, sf_dir):
    return V.vectors(spark, sf_dir).groupBy("course_id").agg(F.count(F.lit(1)).alias("vectors"))


def _requests(spark, sf_dir):
    """Requests of four kinds in turn: topics named, no text, a misspelt name, other text."""
    kind = (F.col("query_id") / 20).cast("int") % 4
    label = (F.col("query_id") % 7).cast("int")
    ids = F.when(kind == 0, F.array(label)).otherwise(F.array().cast("array<int>"))
    text = F.when(kind == 1, "").when(kind == 2, F.concat(F.lit("topik numbr "), label)).otherwise("zzzz")
    return _queries(spark, sf_dir).withColumn("topic_ids", ids).withColumn("text", text)


def _topics(spark, sf_dir):
    v = V.vectors(spark, sf_dir).select("course_id", "topic_id").distinct()
    return v.withColumn("name", F.concat(F.lit("Topic number "), "topic_id"))


def fuzzy_topic_match(spark, sf_dir):
    return R.fuzzy_topics(_requests(spark, sf_dir), _topics(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def resolve_scope(spark, sf_dir):
    return R.resolve_scope(_requests(spark, sf_dir), _topics(spark, sf_dir), V.vectors(spark, sf_dir))


def expand_to_topics(spark, sf_dir):
    q, v = _queries(spark, sf_dir), V.vectors(spark, sf_dir)
    hits = R.vector_topk(q, v).join(q.select("query_id", "course_id"), "query_id")
    return R.expand_to_topics(hits, v)


def context_passages(spark, sf_dir):
    q = _queries(spark, sf_dir)
    out = R.context_passages(q, R.vector_topk(q, V.vectors(spark, sf_dir)), V.chunks(spark, sf_dir))
    return out.select("query_id", F.sha2("context", 256).alias("sha"), F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


_SQL = {
    "q_section": "SELECT doc_id AS chunk_id, source AS course_id, source AS unit, CASE WHEN source LIKE '%9' THEN source ELSE source || ' / ' || lang || '-' || left(text, 1) END AS path FROM documents",
    "q_strategy": """SELECT *, CASE WHEN paths < 3 THEN 'cluster' WHEN singletons / paths >= 0.8 THEN 'unit' ELSE 'heading' END AS strategy FROM (
        SELECT course_id, count(*) AS paths, count(*) FILTER (n = 1) AS singletons FROM (SELECT course_id, path, count(*) AS n FROM q_section GROUP BY ALL) GROUP BY 1)""",
    "q_chunk_topic": "SELECT chunk_id, course_id, CASE strategy WHEN 'unit' THEN unit WHEN 'heading' THEN path END AS topic_key FROM q_section JOIN q_strategy USING (course_id)",
    "q_tree": """SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY topic_key) AS order_index FROM (
        SELECT course_id, unit AS topic_key, NULL AS parent_key, unit AS name, 0 AS level, count(*) AS chunk_count FROM q_section JOIN q_strategy USING (course_id) WHERE strategy <> 'cluster' GROUP BY ALL
        UNION ALL SELECT course_id, path, unit, split_part(path, ' / ', 2), 1, count(*) FROM q_section JOIN q_strategy USING (course_id) WHERE strategy = 'heading' GROUP BY ALL)""",
    "q_hit": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT q.query_id, v.chunk_id, v.course_id, v.topic_id, round(list_dot_product(q.query, v.e) / (sqrt(list_dot_product(q.query, q.query)) * sqrt(list_dot_product(v.e, v.e))), 9) AS score
        FROM v_query q JOIN (SELECT *, embedding::DOUBLE[] AS e FROM v_vector) v ON v.course_id = q.query_id % 5 WHERE q.query_id % 20 = 0))""",
}


_SQL |= {
    "q_ask": """SELECT query_id, query_id % 5 AS course_id, query_id // 20 % 4 AS kind, query_id % 7 AS label,
        CASE query_id // 20 % 4 WHEN 1 THEN '' WHEN 2 THEN 'topik numbr ' || (query_id % 7) ELSE 'zzzz' END AS text FROM v_query WHERE query_id % 20 = 0""",
    "q_name": "SELECT DISTINCT course_id, topic_id, 'Topic number ' || topic_id AS name FROM v_vector",
    # The table of common subsequences row by row: each cell is the largest of what the row above allows up to it.
    "q_ratio": """SELECT * FROM (WITH RECURSIVE l AS (SELECT *, 0 AS i, list_transform(range(0, length(name) + 1), lambda j: 0) AS r FROM (SELECT DISTINCT text, name FROM q_ask JOIN q_name USING (course_id))
        UNION ALL SELECT text, name, i + 1, list_transform(range(0, length(name) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k:
            greatest(r[k + 1], CASE WHEN k > 0 AND substr(lower(name), CAST(k AS BIGINT), 1) = substr(lower(text), i + 1, 1) THEN r[k] + 1 ELSE 0 END)))) FROM l WHERE i < length(text))
        SELECT text, name, CASE WHEN length(text) + length(name) = 0 THEN 100.0 ELSE 200.0 * r[-1] / (length(text) + length(name)) END AS ratio FROM l WHERE i = length(text))""",
    "q_near": "SELECT query_id, kind, topic_id, ratio FROM q_ask JOIN q_name USING (course_id) JOIN q_ratio USING (text, name) WHERE ratio >= 85",
    "q_found": "SELECT query_id, topic_id, min(rank) AS rank FROM q_hit WHERE rank <= 10 AND topic_id IS NOT NULL GROUP BY ALL",
}


def _sql(body: str) -> str:
    return V.with_views(body, _SQL)


def _quoted(side: int) -> str:
    """The texts before or after labels as a list in SQL."""
    return ", ".join("'" + x[side].replace("'", "''") + "'" for x in _AROUND)


QUERIES = {
    "doc_content_hash": doc_content_hash, "ingest_dedup": ingest_dedup, "ingest_status": ingest_status, "low_text_documents": low_text_documents, "vector_upsert": vector_upsert,
    "vector_contract": vector_contract, "vector_payload": vector_payload, "section_counts": section_counts, "topic_strategy": topic_strategy, "topic_map": topic_map, "topic_tree": topic_tree,
    "chunk_topics": chunk_topics, "leaf_topics": leaf_topics, "clean_labels": clean_labels, "cluster_topics": cluster_topics, "fallback_topics": fallback_topics, "mirror_topics": mirror_topics, "vector_topk": vector_topk, "vector_topk_lsh": vector_topk_lsh, "vector_topk_ivf": vector_topk_ivf,
    "vector_counts": vector_counts, "fuzzy_topic_match": fuzzy_topic_match, "resolve_scope": resolve_scope, "expand_to_topics": expand_to_topics, "context_passages": context_passages,
}

ORACLE_SQL = {
    "doc_content_hash": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "ingest_dedup": """WITH d AS (SELECT doc_id, source, sha256(text) AS sha FROM documents),
        k AS (SELECT source, sha, bool_or(quality = 1) AS complete FROM d JOIN labels USING (doc_id) GROUP BY ALL)
        SELECT d.doc_id AS document_id, d.source AS course_id, d.sha, CASE WHEN k.complete THEN 'skipped'
            WHEN row_number() OVER (PARTITION BY d.source, d.sha ORDER BY d.doc_id) > 1 THEN 'duplicate' WHEN k.complete IS NOT NULL THEN 'replaced' ELSE 'new' END AS action
        FROM d LEFT JOIN k ON k.source = d.source AND k.sha = d.sha""",
    "ingest_status": _sql("""SELECT document_id, CAST(token_count >= 150 AS INT) AS chunks, CASE WHEN token_count >= 150 THEN 'complete' ELSE 'failed' END AS status,
        CASE WHEN token_count < 150 THEN left('no passage in: ' || text, 2000) END AS reason FROM v_chunk"""),
    "low_text_documents": _sql("SELECT document_id, round(sum(length(text)) / count(*), 6) AS chars_per_page FROM v_page GROUP BY 1 HAVING sum(length(text)) / count(*) < 100"),
    "vector_upsert": _sql("SELECT chunk_id, document_id, topic_id + CASE WHEN document_id % 10 = 0 THEN 100 ELSE 0 END AS topic_id FROM v_vector"),
    "vector_contract": _sql("""SELECT v.*, c.chunks, v.vectors = c.chunks AND v.wrong_dim = 0 AS ok FROM (SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64) AS wrong_dim FROM v_vector) v,
        (SELECT count(*) AS chunks FROM v_chunk) c"""),
    "vector_payload": _sql("SELECT chunk_id, document_id, course_id, topic_id, page_start, page_end, array_to_string(section_path, '/') AS section_path, greatest(0, len(section_path) - 1) AS heading_level, token_count FROM v_chunk"),
    "section_counts": _sql("SELECT course_id, path AS section_path, count(*) AS chunk_count FROM q_section GROUP BY ALL"),
    "topic_strategy": _sql("SELECT * FROM q_strategy"),
    "topic_map": _sql("SELECT course_id, topic_key, count(*) AS chunk_count FROM q_chunk_topic GROUP BY ALL"),
    "topic_tree": _sql("SELECT course_id, topic_key, parent_key, name, level, chunk_count, order_index FROM q_tree"),
    "chunk_topics": _sql("SELECT * FROM q_chunk_topic"),
    "leaf_topics": _sql("SELECT course_id, topic_key, name FROM q_tree t WHERE NOT EXISTS (SELECT 1 FROM q_tree c WHERE c.course_id = t.course_id AND c.parent_key = t.topic_key)"),
    "clean_labels": f"""WITH raw AS (SELECT p_partkey, CASE WHEN p_size = 50 THEN ' "" ' WHEN p_size = 49 THEN '. . ' ELSE list_extract([{_quoted(0)}], p_size % {len(_AROUND)} + 1) || p_name
            || list_extract([{_quoted(1)}], p_size % {len(_AROUND)} + 1) END AS label FROM part),
        bare AS (SELECT p_partkey, {V.STRIP.format("rtrim(trim(trim(" + V.STRIP.format("label") + ", chr(34)), chr(39)), '.')")} AS label FROM raw)
        SELECT p_partkey, coalesce(nullif(left(label, 255), ''), 'Untitled Topic') AS label FROM bare""",
    "vector_topk": _sql("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM q_hit WHERE rank <= 5"),
    "mirror_topics": _sql("SELECT v.chunk_id, v.course_id, t.topic_key FROM v_vector v LEFT JOIN q_chunk_topic t USING (chunk_id)"),
    "fuzzy_topic_match": _sql("SELECT query_id, topic_id, round(ratio, 6) AS ratio FROM q_near"),
    "resolve_scope": _sql("""SELECT query_id, 'named' AS via, 0 AS place, CAST(label AS INT) AS topic_id FROM q_ask WHERE kind = 0
        UNION ALL SELECT query_id, 'course', 0, NULL FROM q_ask WHERE kind = 1
        UNION ALL SELECT query_id, 'name', row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, topic_id) - 1, topic_id FROM q_near WHERE kind > 1
        UNION ALL SELECT query_id, 'search', row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1, topic_id FROM q_found WHERE query_id IN (SELECT query_id FROM q_ask WHERE kind > 1) AND query_id NOT IN (SELECT query_id FROM q_near)
        UNION ALL SELECT query_id, 'course', 0, NULL FROM q_ask WHERE kind > 1 AND query_id NOT IN (SELECT query_id FROM q_near) AND query_id NOT IN (SELECT query_id FROM q_found)"""),
    "vector_counts": _sql("SELECT course_id, count(*) AS vectors FROM v_vector GROUP BY 1"),
    "expand_to_topics": _sql("SELECT DISTINCT h.query_id, v.chunk_id FROM q_hit h JOIN v_vector v ON v.course_id = h.course_id AND v.topic_id = h.topic_id WHERE h.rank <= 5"),
    "context_passages": _sql("""SELECT query_id, sha256(coalesce(string_agg('[' || rank || '] (slide ' || page_start || '-' || page_end || ', ' || array_to_string(section_path, ' / ') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank), 'No passage matches.')) AS sha,
        coalesce(string_agg(chunk_id::VARCHAR, ',' ORDER BY rank), '') AS sources FROM (SELECT query_id FROM v_query WHERE query_id % 20 = 0) q
        LEFT JOIN (SELECT h.query_id, h.rank, c.* FROM q_hit h JOIN v_chunk c USING (chunk_id) WHERE h.rank <= 5) USING (query_id) GROUP BY 1"""),
}
