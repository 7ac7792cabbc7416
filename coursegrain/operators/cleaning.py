"""Cleaning of page text: furniture, markers, hyphens, blank runs, symbol fonts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..functions.rows import once
from ..functions.text import BLANK, FAST_WORD, any_script, fingerprint, stripped, text_lines

# Patterns of page numbers and page markers (case-insensitive, whole line).
PAGE_NUMBER = any_script(r"^\s*(?:page\s*)?[-–—(\[]?\s*\d{1,4}\s*(?:/\s*\d{1,4})?\s*[-–—)\]]?\s*$")
PAGE_MARKER = any_script(r"^\s*\S{0,40}?\s*(?:page|slide|pg\.?|p\.)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$")
HYPHEN_BREAK = any_script(r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)")
MARKER_WORDS = 6
#: What all of these have; texts without it are not searched for words.
HYPHEN_END = rf"-[{BLANK}]*\n"
#: How both kinds of markers end.
MARKER_END = rf"\p{{Nd}}[-–—)\]{BLANK}]*+$"

# The public Symbol font encoding, letters in order and the signs by code.
SYMBOL_CAPITALS = "ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ"
SYMBOL_SMALL = "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
SYMBOL_SIGNS = {
    0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2D: "−", 0x40: "≅", 0x5C: "∴", 0xA3: "≤", 0xA5: "∞", 0xAC: "←", 0xAE: "→", 0xB0: "°", 0xB1: "±",
    0xB3: "≥", 0xB4: "×", 0xB8: "÷", 0xB9: "≠", 0xBB: "≈", 0xC7: "∩", 0xC8: "∪", 0xCC: "⊄", 0xCD: "⊆", 0xCE: "∈", 0xCF: "∉", 0xD0: "∠",
    0xD6: "√", 0xD9: "∧", 0xDA: "∨", 0xDB: "⇔", 0xDC: "⇐", 0xDD: "⇒", 0xDE: "⇑", 0xE0: "◊", 0xE1: "⟨", 0xE5: "Σ", 0xF1: "⟩",
}


def symbol_tables() -> tuple[str, str]:
    """from and to for translate(); private-use characters without a counterpart come last."""
    known = {0x41 + i: c for i, c in enumerate(SYMBOL_CAPITALS)} | {0x61 + i: c for i, c in enumerate(SYMBOL_SMALL)}
    known = SYMBOL_SIGNS | known
    rest = [c for c in range(0x20, 0x100) if c not in known]
    return "".join(chr(0xF000 + c) for c in [*known, *rest]), "".join(known.values())


def restore_symbols(text: Column) -> Column:
    """translate() looks up each character of a text, so texts without private-use characters pass by."""
    return F.when(text.rlike("[\uf020-\uf0ff]"), F.translate(text, *symbol_tables())).otherwise(text)


def repair_hyphens(text: Column) -> Column:
    """Words broken by a hyphen at a line's end are joined."""
    return F.when(text.rlike(HYPHEN_END), F.regexp_replace(text, HYPHEN_BREAK, "$1$2")).otherwise(text)


def collapse_blank_runs(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def is_page_marker(line: Column) -> Column:
    """A page number, or a short line that ends as "Slide 3 of 10" does."""
    words = F.size(F.regexp_extract_all(line, F.lit(FAST_WORD), F.lit(0)))
    return line.rlike(MARKER_END) & (line.rlike("(?i)" + PAGE_NUMBER) | (line.rlike("(?i)" + PAGE_MARKER) & (words <= MARKER_WORDS)))


def page_content(text: Column, notes: Column) -> Column:
    return F.when(F.length(notes) > 0, F.concat(text, F.lit("\n\n[notes] "), notes)).otherwise(text)


def furniture(pages: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """document_id, fingerprint, pages of short lines that repeat on most pages of a document."""
    lines = pages.select("document_id", "number", F.explode(text_lines(F.col("text"))).alias("line"))
    seen = once(lines, ["document_id", "number"], fingerprint=fingerprint(F.col("line"))).filter((F.col("fingerprint") != "") & (F.length("fingerprint") <= t.furniture_max_chars))
    # A page counts once for a line: distinct combines before its shuffle.
    seen = seen.distinct().groupBy("document_id", "fingerprint").agg(F.count(F.lit(1)).alias("pages"))
    size = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= t.furniture_min_pages)
    return seen.join(size, "document_id").filter(F.col("pages") > F.col("n") * t.furniture_ratio).select("document_id", "fingerprint", "pages")


def clean_pages(pages: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """pages with text, heading and notes cleaned; numbers stay as they are.

    Lines end at any end of line and lose the white space of any script around them. Notes are repaired as texts are, but no line of
    them is taken out; null notes stay null. A document's furniture is an array beside each of
    its pages: at most 1 / ratio lines of a page can repeat on so many pages for each line a
    page has, so the array is short."""
    own = furniture(pages, t).groupBy("document_id").agg(F.collect_set("fingerprint").alias("gone"))
    d = pages.join(own, "document_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    lines = F.transform(text_lines(F.col("text")), stripped)
    kept = F.filter(lines, lambda x: (x == "") | (~F.array_contains(F.col("gone"), fingerprint(x)) & ~is_page_marker(x)))
    own_columns = [c for c in pages.columns if c not in ("text", "notes")]
    d = once(d, [*own_columns, "notes"], text=F.array_join(kept, "\n"))
    repaired = lambda c: collapse_blank_runs(repair_hyphens(F.col(c)))
    d = once(d, own_columns, text=repaired("text"), notes=repaired("notes"))
    return d.withColumns({c: restore_symbols(F.col(c)) for c in ("text", "heading", "notes")}).select(*pages.columns)


def page_spans(pages: DataFrame) -> DataFrame:
    """document_id, number, start, end: where each page is in the document's whole text."""
    head = F.when(F.length("heading") > 0, F.concat(F.lit("## "), "heading", F.lit("\n\n"))).otherwise("")
    size = F.length(F.concat(head, page_content(F.col("text"), F.col("notes")), F.lit("\n\n")))
    upto = Window.partitionBy("document_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    d = pages.select("document_id", "number", size.alias("size"))
    return d.withColumn("end", F.sum("size").over(upto)).select("document_id", "number", (F.col("end") - F.col("size")).alias("start"), "end")


def pages_at(offsets: DataFrame, spans: DataFrame, bucket: int = 4096) -> DataFrame:
    """document_id, offset, number: start <= offset < end; past the end it is the last page.

    A range join by buckets of offsets: a span is in each bucket that it touches."""
    cut = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    last = spans.groupBy("document_id").agg(F.max("end").alias("total"), F.max_by("number", "end").alias("last_number"))
    o = offsets.withColumn("bucket", F.floor(F.col("offset") / bucket))
    hit = o.join(cut, ["document_id", "bucket"]).filter((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end"))).select("document_id", "offset", "number")
    past = offsets.join(last, "document_id").filter(F.col("offset") >= F.col("total")).select("document_id", "offset", F.col("last_number").alias("number"))
    return hit.unionByName(past)
