"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Its ratio r = target / size gives every document
floor(r) certain whole copies; the rest of the target is a sample without replacement in
which a document has inclusion odds p / (1 - p). Documents are ranked by the odds of a
uniform number, drawn from a hash of the document, over their inclusion odds, and taken in
that order until the target is met. A document that would pass the target ends a pass; the
next one goes on with those that still fit, in the same order, so that one long document
doesn't leave a source short, until a pass takes nothing. Then the one document of the size that
is nearest to what is missing is taken if that brings the sum nearer.

No window runs over a whole source: ranks are cut into cells, sums by source and cell give
the cell in which a target is met, and only that cell's documents are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from .common import table, text_or_empty, word_count, written

MAX_COPIES = 3.0
SEED = "mix-1"
CELLS = 4096
FEW_SOURCES = 50_000
#: Passes that the SQL spells out; more than any table needs take nothing, as each one at least halves what is missing.
SQL_PASSES = 16
#: Inclusion odds grow as this power of a document's length.
LENGTH_POWER = 0.25


def source_targets(sizes: DataFrame, max_copies: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target from rows of source, size.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the words of all;
    a target stops at max_copies times its source's size and what is over goes to the other
    sources by weight. That is target = min(max_copies * size, level * weight): the level
    follows from the sources in the order of the level at which each one stops.
    One row for each source goes through one task, not one for each document."""
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = by_source.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(max_copies)))
    w = w.withColumn("stops", F.col("most") / F.col("weight"))
    order = Window.orderBy("stops", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left_words") / F.sum("weight").over(after))
    # The level of the first source that doesn't stop; if all do, none needs it.
    first_free = F.min(F.when(F.col("level") <= F.col("stops"), F.struct("stops", "level"))).over(everything)
    level = first_free["level"]
    target = F.when(level.isNull() | (F.col("most") <= level * F.col("weight")), F.col("most")).otherwise(level * F.col("weight"))
    return w.select("source", "source_size", F.round(target, 6).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def with_source_rows(rows: DataFrame, by_source: DataFrame, few: bool = True) -> DataFrame:
    """rows with the columns of by_source, which has one row for each source (null is one).

    few says that there are FEW_SOURCES at most, which are broadcast. More are joined by a
    shuffle in which the rows of a large source are spread over tasks; rows is read twice then."""
    right = by_source.withColumnRenamed("source", "_source")
    if few:
        return rows.join(F.broadcast(right), rows["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(c, F.lit("")))
    named = rows.withColumn("_key", key("source"))
    spread = [c for c in ("doc_id", "text_key", "rank", "cell") if c in rows.columns]
    return salted_join(named, right.withColumn("_key", key("_source")).drop("_source"), ["_key"], spread or ["source"], "left").drop("_key")


def _ranked(d: DataFrame, seed: str) -> DataFrame:
    """d (doc_id, source, text_key, size, part, ...) with rank and cell; null outside the sample."""
    ratio = F.col("part") / F.greatest(F.lit(1.0) - F.col("part"), F.lit(1e-12))
    # Inclusion odds: those of the part, more for long documents, which leaves short ones to fill up.
    odds = ratio * F.pow(F.greatest(F.col("size"), F.lit(1)).cast("double"), F.lit(LENGTH_POWER))
    u = _uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_key"))
    drawn = (F.col("part") > 1e-9) & (F.col("size") > 0)
    d = d.withColumn("rank", F.when(drawn, u / (F.lit(1.0) - u) / odds))
    # Odds to (0, 1), so that cells of equal width hold like numbers of documents.
    x = F.col("rank") * ratio * F.lit(4.0)
    return d.withColumn("cell", F.floor(x / (x + F.lit(1.0)) * F.lit(CELLS)))


def _cut(d: DataFrame, gaps: DataFrame, few: bool) -> DataFrame:
    """source, room, cut_cell, cut_rank, gap: how far the documents that fit in a source's room are taken.

    d has source, size, rank and cell of the documents that are free; gaps has source and gap,
    which is the room here. A document that is larger than the room is passed over; of the others
    those are taken, in rank order, that come before the sum passes the room."""
    d = with_source_rows(d, gaps.select("source", F.col("gap").alias("room")), few).filter(F.col("size") <= F.col("room"))
    by_cell = d.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.first("room").alias("room"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    by_cell = by_cell.withColumn("reached", F.sum("cell_size").over(upto))
    # The first cell that passes the room; every cell before it is taken whole.
    passed = F.col("reached") > F.col("room")
    cut = by_cell.groupBy("source").agg(F.min(F.when(passed, F.col("cell"))).alias("cut_cell"), F.coalesce(F.max(F.when(~passed, F.col("reached"))), F.lit(0)).alias("reached_before"))
    cut = written(cut, "mix-cells")

    inside = with_source_rows(d, cut, few).filter(F.col("cell") == F.col("cut_cell"))
    ranks = inside.groupBy("source", "rank").agg(F.sum("size").alias("size"), F.first("room").alias("room"), F.first("reached_before").alias("reached_before"))
    order = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranks.withColumn("reached", F.sum("size").over(order) + F.col("reached_before")).filter(F.col("reached") <= F.col("room"))
    ranks = ranks.groupBy("source").agg(F.max("rank").alias("cut_rank"), F.max("reached").alias("reached"))
    cut = with_source_rows(cut, written(ranks, "mix-ranks"), few)
    got = F.coalesce("reached", "reached_before", F.lit(0))
    out = with_source_rows(gaps.select("source", F.col("gap").alias("room")), cut, few)
    # Without a document that fits nothing is taken: no cell comes before the first.
    cell = F.when(F.col("reached_before").isNull(), F.lit(-1)).otherwise(F.col("cut_cell"))
    return written(out.select("source", "room", cell.alias("cut_cell"), "cut_rank", (F.col("room") - got).alias("gap")), "mix-cuts")


def _in_pass(p: Column) -> Column:
    """Whether a document with size, rank and cell is taken by a pass (room, cut_cell, cut_rank)."""
    cell, cut = F.col("cell"), p["cut_cell"]
    before = cut.isNull() | (cell < cut) | ((cell == cut) & (F.col("rank") <= p["cut_rank"]))
    return F.coalesce((F.col("size") <= p["room"]) & before, F.lit(False))


def _taken() -> Column:
    return F.coalesce(F.exists("passes", _in_pass), F.lit(False))


def mixing_plan(sizes: DataFrame, max_copies: float = MAX_COPIES, seed: str = SEED) -> tuple[DataFrame, bool]:
    """What decides about a source's documents, one row for each source; and whether there are few sources.

    certain whole copies; documents that one of the passes takes have one more; and so has the
    document named by last, whose size is nearest to what is then missing, if it brings the sum
    nearer. The documents of the sample are ranked once; a pass reads those that are free."""
    t = source_targets(sizes, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = t.withColumn("certain", F.least(F.floor(ratio + F.lit(1e-9)), F.lit(int(max_copies))).cast("long"))
    t = t.withColumn("part", F.when(F.col("certain") < int(max_copies), F.greatest(ratio - F.col("certain"), F.lit(0.0))).otherwise(F.lit(0.0)))
    t = written(t.withColumn("gap", F.greatest(F.col("target") - F.col("source_size") * F.col("certain"), F.lit(0.0))), "mix-targets")
    few = t.count() <= FEW_SOURCES
    plan = written(t.select("source", "source_size", "target", "certain", "part", "gap", F.array().cast("array<struct<room:double,cut_cell:bigint,cut_rank:double>>").alias("passes")), "mix-plan")
    free = _ranked(with_source_rows(sizes, t.select("source", "part"), few), seed).filter(F.col("rank").isNotNull())
    free = written(free.select("source", "doc_id", "text_key", "size", "rank", "cell"), "mix-free")
    while True:
        cut = _cut(free, plan, few)
        if cut.filter(F.col("gap") < F.col("room")).isEmpty():
            break
        one = F.struct(F.col("room").cast("double").alias("room"), F.col("cut_cell").cast("long").alias("cut_cell"), F.col("cut_rank").cast("double").alias("cut_rank"))
        joined = with_source_rows(plan.drop("gap"), cut, few)
        plan = written(joined.withColumn("passes", F.concat("passes", F.array(one))).drop("room", "cut_cell", "cut_rank"), "mix-plan")
        last = with_source_rows(free, plan.select("source", F.element_at("passes", -1).alias("p")), few)
        free = written(last.filter(~_in_pass(F.col("p"))).drop("p"), "mix-free")
    near = with_source_rows(free, plan.select("source", "gap"), few).filter(F.col("size") < 2 * F.col("gap"))
    last = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "rank", "doc_id", "text_key")).alias("last"))
    return written(with_source_rows(plan, written(last, "mix-last"), few).drop("gap"), "mix-plan"), few


def with_copies(rows: DataFrame, plan: DataFrame, few: bool, seed: str = SEED) -> DataFrame:
    """rows (doc_id, source, text_key, size, ...) with source_size, target and copies."""
    d = _ranked(with_source_rows(rows, plan, few), seed)
    last = (F.col("rank") == F.col("last.rank")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("text_key") == F.col("last.text_key"))
    extra = F.col("rank").isNotNull() & (_taken() | F.coalesce(last, F.lit(False)))
    return d.withColumn("copies", F.col("certain") + extra.cast("int")).drop("certain", "part", "passes", "last", "rank", "cell")


def doc_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.md5(text_or_empty().cast("binary")).alias("text_key"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, max_copies: float = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, copies for each row of docs.

    copies counts the whole copies of a document in the mix, max_copies at most; documents of
    no words have the certain ones only. Null texts have size 0; a null source is a source,
    the last one; rows alike in doc_id and text are taken or left together; other columns are
    not looked at; an empty table has no rows."""
    sizes = written(doc_sizes(docs), "mix-sizes")
    return with_copies(sizes, *mixing_plan(sizes, max_copies, seed), seed)


def mixed_documents(docs: DataFrame, max_copies: float = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; no text is shuffled."""
    sizes = written(doc_sizes(docs), "mix-sizes")
    plan, few = mixing_plan(sizes, max_copies, seed)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(own, "doc_id", "source", F.md5(text_or_empty().cast("binary")).alias("text_key"), word_count(F.col("text")).alias("size"))
    copies = with_copies(rows, plan, few, seed).filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("_row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _passes(n: int) -> str:
    """SQL of the passes: g0 has all documents with their gap, g1 to gn what each pass takes and leaves."""
    out = ["g0 AS (SELECT *, missing AS gap, false AS taken_in FROM r)"]
    for i in range(1, n + 1):
        out.append(f"""c{i} AS (
  SELECT *, rank IS NOT NULL AND NOT taken_in AND size <= gap AS fits,
         sum(size) FILTER (rank IS NOT NULL AND NOT taken_in AND size <= gap) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE UNBOUNDED PRECEDING) AS reached FROM g{i - 1}),
x{i} AS (SELECT *, fits AND reached <= gap AS now_in FROM c{i}),
g{i} AS (
  SELECT * EXCLUDE (fits, reached, now_in, gap, taken_in), gap - coalesce(max(CASE WHEN now_in THEN reached END) OVER (PARTITION BY source), 0) AS gap, taken_in OR now_in AS taken_in FROM x{i})""")
    return ",\n".join(out)


OP4_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
w AS (
  SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS stops FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY stops, source IS NULL, source)),
t AS (
  SELECT source, source_size, round(least(most, coalesce((SELECT arg_min(level, stops) FROM l WHERE level <= stops), 1e300) * weight), 6) AS target FROM l),
p AS (
  SELECT *, least(CAST(floor(ratio + 1e-9) AS BIGINT), 3) AS certain,
            CASE WHEN floor(ratio + 1e-9) < 3 THEN greatest(ratio - floor(ratio + 1e-9), 0) ELSE 0 END AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t)),
d AS (
  SELECT z.doc_id, z.text_key, z.size, p.*, greatest(target - source_size * certain, 0) AS missing,
         (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(z.doc_id AS VARCHAR), 'null') || '|' || z.text_key), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {2**52}::DOUBLE AS u
  FROM sizes z JOIN p ON z.source IS NOT DISTINCT FROM p.source),
r AS (
  SELECT *, CASE WHEN part > 1e-9 AND size > 0 THEN u / (1 - u) / (part / greatest(1 - part, 1e-12) * pow(size::DOUBLE, {LENGTH_POWER})) END AS rank FROM d),
{_passes(SQL_PASSES)},
e AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND NOT taken_in AND size < 2 * gap
                 THEN row_number() OVER (PARTITION BY source, rank IS NOT NULL AND NOT taken_in AND size < 2 * gap ORDER BY abs(gap - size), rank, doc_id, text_key) = 1 ELSE false END AS is_last FROM g{SQL_PASSES})
SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN taken_in OR is_last THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM e
"""
