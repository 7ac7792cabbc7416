"""Queries of cleaning and chunking, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions.tokens import counter
from ..operators import chunking as K
from ..operators import cleaning as C
from ..sources import views as V
from ..sources.tables import table

#: Passage sizes at which the test tables pack, overlap and merge.
SMALL = replace(DEFAULTS, target_tokens=120, min_tokens=24, max_tokens=180, slide_median_tokens=60)


def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def token_counts_bpe(spark, sf_dir):
    """By a public tokenizer's vocabulary."""
    import public_tokenizers

    count = counter(public_tokenizers.path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


def hyphen_repair(spark, sf_dir):
    return V.pages(spark, sf_dir).select("document_id", "number", F.sha2(C.repair_hyphens(F.col("text")), 256).alias("sha"))


def page_marker_filter(spark, sf_dir):
    lines = V.pages(spark, sf_dir).select("document_id", "number", F.posexplode(T.text_lines(F.col("text"))).alias("i", "line"))
    return lines.filter(C.is_page_marker(F.col("line"))).select("document_id", "number", "i", "line")


def symbol_restore(spark, sf_dir):
    return V.pages(spark, sf_dir).select("document_id", "number", F.sha2(C.restore_symbols(F.col("text")), 256).alias("sha"))


def content_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.content_type(F.col("text")).alias("content_type"))


def furniture_lines(spark, sf_dir):
    return C.furniture(V.pages(spark, sf_dir))


def clean_pages(spark, sf_dir):
    p = C.clean_pages(V.pages(spark, sf_dir))
    return p.select("document_id", "number", F.sha2("text", 256).alias("sha"), "heading", "notes")


def page_spans(spark, sf_dir):
    return C.page_spans(V.pages(spark, sf_dir))


def offset_to_page(spark, sf_dir):
    spans = C.page_spans(V.pages(spark, sf_dir))
    total = spans.groupBy("document_id").agg(F.max("end").alias("total"))
    probes = total.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") + 500, F.lit(500).cast("long"))).alias("offset"))
    return C.pages_at(probes, spans)


def doc_shape(spark, sf_dir):
    return K.doc_shape(V.pages(spark, sf_dir), SMALL)


def _digest(chunks):
    return chunks.select("document_id", "chunk_no", "page_start", "page_end", F.array_join("section_path", "/").alias("path"), "token_count", "content_type", F.sha2("text", 256).alias("sha"))


def chunk_slides(spark, sf_dir):
    return _digest(K.chunk_slides(V.pages(spark, sf_dir), SMALL))


def prose_pages(spark, sf_dir):
    """A document as one page whose lines are paragraphs."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.col("source").alias("course_id"), F.lit(1).alias("number"), F.lit(None).cast("string").alias("heading"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit(None).cast("string").alias("notes"))


def paragraph_blocks(spark, sf_dir):
    b = K.paragraph_blocks(prose_pages(spark, sf_dir))
    return b.select("document_id", "number", "block_no", F.sha2("block", 256).alias("sha"))


def chunk_prose(spark, sf_dir):
    return _digest(K.chunk_prose(prose_pages(spark, sf_dir), SMALL))


def merge_undersized(spark, sf_dir):
    return _digest(K.merge_undersized(K.chunk_slides(V.pages(spark, sf_dir), SMALL), SMALL))


def chunk_corpus(spark, sf_dir):
    return _digest(K.chunk_corpus(V.pages(spark, sf_dir), SMALL))


_FROM, _TO = C.symbol_tables()
_HYPHEN = "regexp_replace({}, '" + C.HYPHEN_BREAK.replace("{", "{{").replace("}", "}}") + r"', '\1\2', 'g')"
_TOKENS = "len(regexp_extract_all({}, '" + T.WORD.replace("{", "{{").replace("}", "}}") + "'))"
_BLANKS = V.BLANK_CHARS
_FINGER = f"regexp_replace(lower(trim(line, {_BLANKS})), '{V.BLANK_RUN}', ' ', 'g')"
_MARKER = rf"(regexp_matches(line, '(?i){C.PAGE_NUMBER}') OR (len(regexp_extract_all(line, '{T.WORD}')) <= {C.MARKER_WORDS} AND regexp_matches(line, '(?i){C.PAGE_MARKER}')))"
_TRIM = V.STRIP
_CONTENT = "CASE WHEN length(notes) > 0 THEN text || chr(10) || chr(10) || '[notes] ' || notes ELSE text END"
_LINES = f"list_filter({V.LINES.format('text')}, lambda x: trim(x, {_BLANKS}) <> '')"
_TYPE = rf"""CASE WHEN len(list_filter({_LINES}, lambda x: regexp_matches(x, '{K.TABLE_LINE}'))) >= greatest(2, len({_LINES}) // 2) THEN 'table'
    WHEN len(list_filter({_LINES}, lambda x: regexp_matches(x, '{K.FENCE}'))) > 0 THEN 'code' ELSE 'prose' END"""


def _repaired(text: str) -> str:
    """Hyphens mended, blank runs collapsed, ends stripped, symbols restored."""
    return f"translate(trim(regexp_replace({_HYPHEN.format(text)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS}), '{_FROM}', '{_TO}')"


def _block_view(source: str) -> str:
    """Paragraphs of a view of document_id, number, content."""
    return rf"""SELECT document_id, number, row_number() OVER (PARTITION BY document_id, number ORDER BY b) AS block_no, text AS block, {_TOKENS.format("text")} AS tokens FROM (
        SELECT document_id, number, b, {_TRIM.format("string_agg(line, chr(10) ORDER BY i)")} AS text FROM (
        SELECT *, sum(cut) OVER (PARTITION BY document_id, number ORDER BY i) AS b FROM (
        SELECT *, CASE WHEN fences % 2 = 0 AND fence = 0 AND {V.STRIP.format("line")} = '' THEN 1 ELSE 0 END AS cut FROM (
        SELECT *, sum(fence) OVER (PARTITION BY document_id, number ORDER BY i) AS fences FROM (
        SELECT *, CASE WHEN regexp_matches(line, '{K.FENCE}') THEN 1 ELSE 0 END AS fence FROM (
        SELECT document_id, number, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {source}))))) WHERE cut = 0
        GROUP BY ALL) WHERE text <> ''"""


def _pack_view(blocks: str) -> str:
    """Passages of a view of blocks, at the sizes of SMALL."""
    return f"""SELECT * FROM (WITH RECURSIVE p AS MATERIALIZED (SELECT *, sum(tokens) OVER (PARTITION BY document_id, number ORDER BY block_no) AS upto FROM {blocks}),
        t AS MATERIALIZED (SELECT e.document_id, e.number, e.block_no, coalesce(min(j.block_no), e.block_no + 1) AS lo, coalesce(min(j.upto - j.tokens), e.upto) AS base
            FROM p e LEFT JOIN p j ON j.document_id = e.document_id AND j.number = e.number AND j.block_no <= e.block_no AND e.upto - j.upto + j.tokens <= 18 GROUP BY e.document_id, e.number, e.block_no, e.upto),
        f AS (SELECT document_id, number, block_no, CAST(0 AS BIGINT) AS chunk_no, block_no AS lo, upto - tokens AS base FROM p WHERE block_no = 1
        UNION ALL
        SELECT p.document_id, p.number, p.block_no, f.chunk_no + CASE WHEN p.upto - f.base > 120 THEN 1 ELSE 0 END,
            CASE WHEN p.upto - f.base > 120 THEN greatest(f.lo, t.lo) ELSE f.lo END, CASE WHEN p.upto - f.base > 120 THEN greatest(f.base, t.base) ELSE f.base END
        FROM f JOIN p ON p.document_id = f.document_id AND p.number = f.number AND p.block_no = f.block_no + 1 JOIN t ON t.document_id = f.document_id AND t.number = f.number AND t.block_no = f.block_no)
        SELECT document_id, number, chunk_no, min(lo) AS first_block, max(block_no) AS last_block FROM f GROUP BY ALL)"""


def _prose_view(source: str, packs: str, blocks: str) -> str:
    """Passages of prose with their columns; source also has course_id and heading."""
    return rf"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY number, chunk_no) - 1 AS chunk_no, number AS page_start, number AS page_end, path,
        {_TOKENS.format("text")} AS token_count, {_TYPE} AS content_type, text FROM (
        SELECT p.document_id, p.number, p.chunk_no, any_value(concat_ws('/', s.course_id, s.heading)) AS path, string_agg(b.block, chr(10) || chr(10) ORDER BY b.block_no) AS text
        FROM {packs} p JOIN {blocks} b ON b.document_id = p.document_id AND b.number = p.number AND b.block_no BETWEEN p.first_block AND p.last_block
        JOIN {source} s ON s.document_id = p.document_id AND s.number = p.number GROUP BY p.document_id, p.number, p.chunk_no)"""


def _merge_view(chunks: str) -> str:
    """Undersized passages of a view merged, at the sizes of SMALL."""
    return f"""SELECT document_id, merged_no AS chunk_no, min(page_start) AS page_start, max(page_end) AS page_end, arg_min(path, c.chunk_no) AS path, CAST(sum(token_count) AS BIGINT) AS token_count,
        arg_min(content_type, c.chunk_no) AS content_type, sha256(string_agg(text, chr(10) || chr(10) ORDER BY c.chunk_no)) AS sha
        FROM {chunks} c JOIN (WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_no) AS rn FROM {chunks}), f AS (
        SELECT document_id, rn, chunk_no, path, token_count AS size, CAST(0 AS BIGINT) AS merged_no FROM c WHERE rn = 1
        UNION ALL
        SELECT c.document_id, c.rn, c.chunk_no, c.path, CASE WHEN c.token_count < 24 AND f.size + c.token_count <= 180 AND c.path = f.path THEN f.size + c.token_count ELSE c.token_count END,
            f.merged_no + CASE WHEN c.token_count < 24 AND f.size + c.token_count <= 180 AND c.path = f.path THEN 0 ELSE 1 END
        FROM f JOIN c ON c.document_id = f.document_id AND c.rn = f.rn + 1)
        SELECT document_id, chunk_no, merged_no FROM f) m USING (document_id, chunk_no) GROUP BY document_id, merged_no"""

_SQL = {
    "q_line": f"SELECT document_id, number, i - 1 AS i, line FROM (SELECT document_id, number, unnest({V.LINES.format('text')}) AS line, CAST(generate_subscripts({V.LINES.format('text')}, 1) AS INT) AS i FROM v_page)",
    "q_furniture": f"""SELECT s.document_id, s.fingerprint, s.pages FROM (SELECT document_id, fingerprint, count(DISTINCT number) AS pages FROM (SELECT document_id, number, {_FINGER} AS fingerprint FROM q_line)
        WHERE fingerprint <> '' AND length(fingerprint) <= 120 GROUP BY ALL) s JOIN (SELECT document_id, count(*) AS n FROM v_page GROUP BY 1 HAVING count(*) >= 5) USING (document_id) WHERE s.pages > n * 0.6""",
    "q_clean": f"""SELECT p.document_id, p.number, translate(p.heading, '{_FROM}', '{_TO}') AS heading, {_repaired("p.notes")} AS notes, {_repaired("coalesce(k.kept, '')")} AS text
        FROM v_page p LEFT JOIN (SELECT document_id, number, string_agg(trim(line, {_BLANKS}), chr(10) ORDER BY i) AS kept FROM q_line l WHERE trim(line, {_BLANKS}) = '' OR (NOT {_MARKER}
        AND NOT EXISTS (SELECT 1 FROM q_furniture f WHERE f.document_id = l.document_id AND f.fingerprint = {_FINGER})) GROUP BY ALL) k USING (document_id, number)""",
    "q_content": f"""SELECT document_id, course_id, number, kind, CASE WHEN length(heading) > 0 THEN heading END AS heading, {_CONTENT} AS content FROM v_page""",
    "q_span": """SELECT document_id, number, CAST(e - size AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM (SELECT *, sum(size) OVER (PARTITION BY document_id ORDER BY number) AS e
        FROM (SELECT document_id, number, length(CASE WHEN heading IS NULL THEN '' ELSE '## ' || heading || chr(10) || chr(10) END || content || chr(10) || chr(10)) AS size FROM q_content))""",
    "q_slide": rf"""SELECT *, {_TOKENS.format("content")} + {_TOKENS.format("coalesce(heading, '')")} AS tokens, regexp_matches(coalesce(heading, ''), '{K.STRUCTURAL}') AS structural,
        row_number() OVER (PARTITION BY document_id ORDER BY number) AS rn FROM q_content""",
    "q_slide_no": """SELECT * FROM (WITH RECURSIVE f AS (
        SELECT document_id, rn, number, structural, CAST(0 AS BIGINT) AS chunk_no, CASE WHEN structural THEN NULL ELSE tokens END AS size FROM q_slide WHERE rn = 1
        UNION ALL
        SELECT s.document_id, s.rn, s.number, s.structural,
            f.chunk_no + CASE WHEN f.size IS NULL THEN 0 WHEN s.structural OR f.size + s.tokens > 120 THEN 1 ELSE 0 END,
            CASE WHEN s.structural THEN NULL WHEN f.size IS NULL OR f.size + s.tokens > 120 THEN s.tokens ELSE f.size + s.tokens END
        FROM f JOIN q_slide s ON s.document_id = f.document_id AND s.rn = f.rn + 1)
        SELECT document_id, number, chunk_no FROM f WHERE NOT structural)""",
    "q_slide_chunk": rf"""SELECT document_id, chunk_no, page_start, page_end, path, {_TOKENS.format("text")} AS token_count, {_TYPE} AS content_type, text FROM (
        SELECT document_id, chunk_no, min(number) AS page_start, max(number) AS page_end, concat_ws('/', any_value(course_id), arg_min(heading, number) FILTER (heading IS NOT NULL)) AS path,
        {_TRIM.format("string_agg(concat_ws(chr(10) || chr(10), '### ' || heading, CASE WHEN length(content) > 0 THEN content END), chr(10) || chr(10) ORDER BY number)")} AS text
        FROM q_content JOIN q_slide_no USING (document_id, number) GROUP BY ALL) WHERE text <> ''""",
    "q_shape": f"SELECT document_id, m AS median_tokens, deck OR m < 60 AS slide_shaped FROM (SELECT document_id, quantile_cont({_TOKENS.format('content')}, 0.5) AS m, bool_or(kind = 'deck') AS deck FROM q_content GROUP BY 1)",
    "q_merged": _merge_view("q_slide_chunk"),
    "q_prose_page": "SELECT doc_id AS document_id, source AS course_id, 1 AS number, NULL AS heading, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents",
    "q_block": _block_view("q_prose_page"),
    "q_pack": _pack_view("q_block"),
    "q_prose_chunk": _prose_view("q_prose_page", "q_pack", "q_block"),
    "q_page_block": _block_view("q_content"),
    "q_page_pack": _pack_view("q_page_block"),
    "q_page_chunk": _prose_view("q_content", "q_page_pack", "q_page_block"),
    "q_corpus_chunk": """SELECT c.* FROM q_slide_chunk c JOIN q_shape s ON s.document_id = c.document_id AND s.slide_shaped
        UNION ALL SELECT c.* FROM q_page_chunk c JOIN q_shape s ON s.document_id = c.document_id AND NOT s.slide_shaped""",
    "q_corpus_merged": _merge_view("q_corpus_chunk"),
}


def _sql(body: str) -> str:
    return V.with_views(body, _SQL)


QUERIES = {
    "token_counts": token_counts, "token_counts_bpe": token_counts_bpe, "hyphen_repair": hyphen_repair, "page_marker_filter": page_marker_filter, "symbol_restore": symbol_restore, "content_type": content_types,
    "furniture_lines": furniture_lines, "clean_pages": clean_pages, "page_spans": page_spans, "offset_to_page": offset_to_page, "doc_shape": doc_shape, "chunk_slides": chunk_slides,
    "paragraph_blocks": paragraph_blocks, "chunk_prose": chunk_prose, "merge_undersized": merge_undersized, "chunk_corpus": chunk_corpus,
}

ORACLE_SQL = {
    "token_counts": rf"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "hyphen_repair": _sql(f"SELECT document_id, number, sha256({_HYPHEN.format('text')}) AS sha FROM v_page"),
    "page_marker_filter": _sql(f"SELECT document_id, number, i, line FROM q_line WHERE {_MARKER}"),
    "symbol_restore": _sql(f"SELECT document_id, number, sha256(translate(text, '{_FROM}', '{_TO}')) AS sha FROM v_page"),
    "content_type": f"SELECT doc_id, {_TYPE} AS content_type FROM documents",
    "furniture_lines": _sql("SELECT * FROM q_furniture"),
    "clean_pages": _sql("SELECT document_id, number, heading, notes, sha256(text) AS sha FROM q_clean"),
    "page_spans": _sql("SELECT * FROM q_span"),
    "offset_to_page": _sql("""SELECT o.document_id, o."offset", coalesce(s.number, o.last_number) AS number FROM (
        SELECT document_id, last_number, unnest(range(0, total + 501, 500)) AS "offset" FROM (SELECT document_id, max("end") AS total, arg_max(number, "end") AS last_number FROM q_span GROUP BY 1)) o
        LEFT JOIN q_span s ON s.document_id = o.document_id AND s."start" <= o."offset" AND o."offset" < s."end" """),
    "doc_shape": _sql("SELECT * FROM q_shape"),
    "chunk_slides": _sql("SELECT document_id, chunk_no, page_start, page_end, path, token_count, content_type, sha256(text) AS sha FROM q_slide_chunk"),
    "paragraph_blocks": _sql("SELECT document_id, 1 AS number, block_no, sha256(block) AS sha FROM q_block"),
    "chunk_prose": _sql("SELECT document_id, chunk_no, page_start, page_end, path, token_count, content_type, sha256(text) AS sha FROM q_prose_chunk"),
    "merge_undersized": _sql("SELECT * FROM q_merged"),
    "chunk_corpus": _sql("SELECT * FROM q_corpus_merged"),
}
