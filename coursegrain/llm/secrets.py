"""Secret scans with multipart credential linking.

One pass over the texts finds parts: the base ones (labelled assignments, access identifiers,
long hex runs), which are reported whatever stands beside them, and weak ones, which mean
little alone: identifiers (user names, short access keys), secrets (passwords under looser
labels, unlabelled tokens of mixed letters and digits, short hex runs) and endpoints (addresses
with a scheme, hosts with a port). Only parts leave the pass, not texts. They meet in an
interval join by document, scope and cell of SPAN characters, where each cell is summed first
to the outermost places of each role, so that a cell costs one row however many parts it has.
A weak part is reported when the roles that complete it lie in its scope within SPAN
characters: a secret beside an identifier, an identifier beside a secret, an endpoint beside
both. Scopes end at blank lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

#: Characters between complementary parts at most.
SPAN = 200

# The base kinds as the contract gives them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Weak parts; the last group is the part itself.
USER = re.compile(r"""\b(user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.ASCII | re.IGNORECASE)
SHORT_ACCESS = re.compile(r"\b(A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{6,})", re.ASCII)
LOOSE = re.compile(r"""\b((?:pass|pwd|passphrase|passcode|auth|bearer|credentials?|private_?key|access_?key|secret_?(?:access_?)?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=@!#$%^&*-]{6,})""", re.ASCII | re.IGNORECASE)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=-])")
SHORT_HEX = re.compile(r"(?<![0-9A-Za-z])([0-9a-f]{16,31})(?![0-9A-Za-z])")
ADDRESS = re.compile(r"\b([a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~:@\[\]-]+)", re.ASCII)
HOST = re.compile(r"""\b(host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z0-9-]{2,}(?::\d{1,5})?)""", re.ASCII | re.IGNORECASE)
#: Kinds in the order in which they are listed, and their roles.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "access": "identifier", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
BASE = 3
_BLANK = re.compile(r"\n[ \t\r]*\n")
_HEX_TO_H = bytes(ord("h") if chr(c) in "0123456789abcdef" else 32 for c in range(256))
#: Bytes of ASCII letters and digits, to find long runs of them before a pattern is tried.
_RUN_TO_R = bytes(ord("r") if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_-") else 32 for c in range(256))


def base_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds; the patterns are tried where plain searches find what they need."""
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(w in low for w in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(_HEX_TO_H):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out)


def _mixed(s: str) -> bool:
    """Letters of both cases and digits, as random tokens have and words haven't."""
    return any(c.isdigit() for c in s) and any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s)


def weak_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of parts that count only beside others."""
    raw = text.encode()
    low = raw.lower()
    out = []
    labels = b":" in raw or b"=" in raw
    if labels and any(w in low for w in (b"user", b"login", b"account", b"client", b"id")):
        out += [(m.start(), m.end(), 3) for m in USER.finditer(text)]
    if any(w in raw for w in (b"AKIA", b"ASIA", b"AROA", b"AIDA")):
        out += [(m.start(), m.end(), 3) for m in SHORT_ACCESS.finditer(text)]
    if labels and any(w in low for w in (b"pass", b"pwd", b"auth", b"bearer", b"credential", b"key")):
        out += [(m.start(), m.end(), 4) for m in LOOSE.finditer(text)]
    if b"r" * 20 in raw.translate(_RUN_TO_R):
        out += [(m.start(), m.end(), 4) for m in BARE.finditer(text) if _mixed(m[1])]
    if b"h" * 16 in raw.translate(_HEX_TO_H):
        out += [(m.start(), m.end(), 4) for m in SHORT_HEX.finditer(text)]
    if b"://" in raw:
        out += [(m.start(), m.end(), 5) for m in ADDRESS.finditer(text)]
    if labels and any(w in low for w in (b"host", b"endpoint", b"server", b"url")):
        out += [(m.start(), m.end(), 5) for m in HOST.finditer(text)]
    return out


def parts_of(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, scope): base parts, and weak ones of which no base part takes anything.

    Of weak parts that overlap, the first of the longest stays."""
    base = base_parts(text)
    weak = weak_parts(text)
    kept: list[tuple[int, int, int]] = []
    if weak:
        taken = sorted((s, e) for s, e, _ in base)
        merged: list[list[int]] = []
        for s, e in taken:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        starts = [s for s, _ in merged]
        last = None
        for s, e, kind in sorted(weak, key=lambda p: (p[0], -p[1], p[2])):
            i = bisect_right(starts, e - 1) - 1
            if i >= 0 and merged[i][1] > s:
                continue
            if last is not None and s < last:
                continue
            kept.append((s, e, kind))
            last = e
    found = sorted(base + kept)
    if not found:
        return []
    out, scope = [], 0
    blanks = iter([m.start() for m in _BLANK.finditer(text)] if kept else [])
    at = next(blanks, None)
    for s, e, kind in found:
        while at is not None and at < s:
            scope, at = scope + 1, next(blanks, None)
        out.append((s, e, kind, scope))
    return out


PARTS = "row long, {id} first boolean, start long, end long, kind int, scope int"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to a row for each part, and one without a part for each document."""
    names = ["row", "doc_id", "first", "start", "end", "kind", "scope"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for b in batches:
        at: list[int] = []
        rest: list[tuple] = []
        for i in range(b.num_rows):
            at.append(i)
            rest.append((True, None, None, None, None))
            for s, e, kind, scope in parts_of(b.column(2)[i].as_py()):
                at.append(i)
                rest.append((False, s, e, kind, scope))
        take = pa.array(at, pa.int64())
        yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, t) for c, t in zip(zip(*rest), kinds))] if at else [b.column(0), b.column(1), *(pa.array([], t) for t in kinds)], names=names)


def found_parts(docs: DataFrame) -> DataFrame:
    """row, doc_id, first, start, end, kind, scope, written: all parts, weak ones among them.

    row numbers the rows of docs, so that rows alike stay apart; a row whose first is true stands
    for the document itself and has no part."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    return written(texts.mapInArrow(_parts, PARTS.format(id=f"doc_id {id_type},")), "secret-parts")


def linked_parts(parts: DataFrame, span: int = SPAN) -> DataFrame:
    """row, start, end, kind of the weak parts (start, end, kind, scope of a row) that others complete.

    Parts in the same scope are near if at most span characters lie between them. A cell is span
    characters wide, so parts near a part start in its end's cell, in the one after, or end in
    the cells before its start; of each of these only the outermost places matter."""
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("kind") + F.lit(1))
    p = parts.filter("not first").select("row", "scope", "start", "end", "kind", role.alias("role"))
    scopes = p.groupBy("row", "scope").agg(F.max((F.col("kind") >= BASE)).alias("weak"), F.count_if(F.col("role") == "secret").alias("secrets"), F.count_if(F.col("role") == "identifier").alias("identifiers"))
    whole = scopes.filter("weak and secrets > 0 and identifiers > 0").select("row", "scope")
    p = p.join(whole, ["row", "scope"], "left_semi")
    # What starts in a cell, and what ends in it.
    cell = lambda c: F.floor(F.col(c) / F.lit(span)).cast("long")
    ahead = p.groupBy("row", "scope", "role", cell("start").alias("cell")).agg(F.min("start").alias("first_start"))
    behind = p.groupBy("row", "scope", "role", cell("end").alias("cell")).agg(F.max("end").alias("last_end"))
    weak = p.filter(F.col("kind") >= BASE)
    # A part ending in cell b is near what starts in b or b + 1; one starting in a, what ends in a - 1 or a.
    # Overlaps count as near: what starts before this part's end and ends after its start.
    after = weak.select("*", F.explode(F.array(cell("end"), cell("end") + 1)).alias("cell")).join(ahead.withColumnRenamed("role", "other"), ["row", "scope", "cell"])
    after = after.filter((F.col("first_start") <= F.col("end") + span) & (F.col("other") != F.col("role")))
    before = weak.select("*", F.explode(F.array(cell("start") - 1, cell("start"))).alias("cell")).join(behind.withColumnRenamed("role", "other"), ["row", "scope", "cell"])
    before = before.filter((F.col("last_end") >= F.col("start") - span) & (F.col("other") != F.col("role")))
    columns = ["row", "start", "end", "kind", "role", "other"]
    near = after.select(*columns).unionByName(before.select(*columns))
    g = near.groupBy("row", "start", "end", "kind", "role").agg(F.max(F.col("other") == "secret").alias("secret"), F.max(F.col("other") == "identifier").alias("identifier"))
    complete = F.when(F.col("role") == "secret", F.col("identifier")).when(F.col("role") == "identifier", F.col("secret")).otherwise(F.col("secret") & F.col("identifier"))
    return g.filter(complete).select("row", "start", "end", "kind")


def secret_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans: a row for each row of docs.

    base_sha256 is the digest of the base spans' list, spans the list of all, base and linked.
    A null text is an empty one, and has no spans. Repeated rows, rows of one doc_id and of a
    null one are documents of their own. Columns other than doc_id and text are not looked at; an
    empty table has no rows."""
    parts = found_parts(docs)
    base = parts.filter(F.col("first") | (F.col("kind") < BASE)).select("row", "doc_id", "first", "start", "end", "kind")
    extra = linked_parts(parts, span).select("row", F.lit(None).cast(parts.schema["doc_id"].dataType).alias("doc_id"), F.lit(False).alias("first"), "start", "end", "kind")
    spot = F.when(~F.col("first"), F.struct("start", "kind", "end"))
    g = base.unionByName(extra).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(spot)).alias("s"))
    name = F.array(*map(F.lit, KINDS))
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + F.lit(1)), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    return g.select(
        "doc_id",
        kinds(0).alias("n_assign"),
        kinds(1).alias("n_access"),
        kinds(2).alias("n_hex"),
        F.sha2(listed(F.filter("s", lambda x: x["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["kind"] >= BASE)).cast("long").alias("n_linked"),
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
