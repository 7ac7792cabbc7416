import hashlib
import random

from coursegrain.llm import line_dedup as D

DOC = "doc_id long, text string, lang string, has_id string, n_chars long"


def _by_hand(rows, least_chars=40, least_docs=5):
    """Lines of each row that stay, by the contract, on the whole table at once."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    docs = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                docs.setdefault(key(x), set()).add(-1 if d is None else d)
    top = {k: max(v) for k, v in docs.items() if len(v) >= least_docs}
    return [[x for x in (t or "").split("\n") if key(x) not in top or top[key(x)] == (-1 if d is None else d)] for d, t in rows]


def _check(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC).repartition(parts)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in D.apply_keep_bitmaps(docs, D.line_keep_bitmaps(docs)).collect())
    want = sorted((-1 if d is None else d, "\n".join(k)) for (d, _), k in zip(rows, _by_hand(rows)))
    assert got == want


def test_matches_the_rule(spark):
    r = random.Random(4)
    shared = [f"A line that many documents have, number {i} of the shared ones" for i in range(12)]
    rows = []
    for d in range(120):
        lines = [r.choice(shared).upper() if r.random() < 0.3 else r.choice(shared) + " \t" if r.random() < 0.5 else f"its own line {d} {r.random()} and a good deal longer than forty" for _ in range(r.randint(0, 9))]
        rows.append((d, "\n".join(lines)))
    _check(spark, rows)


def test_a_line_in_every_document_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    hot = "the very same line of every single document here, long enough"
    _check(spark, [(d, f"{hot}\nshort\n{hot}\n" + "x" * (d % 50)) for d in range(400)])
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_nulls_repeats_ties_and_long_lines(spark):
    line = "ÄÖÜ Straße " * 5
    rows = [(None, line), (None, line + "\n" + line), (1, line), (1, line), (2, line), (3, line), (4, line), (5, None), (6, ""), (7, "z" * 300_000), (8, "\n\n")]
    _check(spark, rows)


def test_empty_table_and_digests(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    assert D.line_keep_bitmaps(docs).count() == 0 and D.apply_keep_bitmaps(docs, D.line_keep_bitmaps(docs)).count() == 0
    rows = [(d, "one line that five documents hold between them, yes\nown %d" % d) for d in range(5)] + [(9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in D.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0] == (2, 1, hashlib.sha256(b"own 0").hexdigest())
    assert got[4] == (2, 0, hashlib.sha256(rows[4][1].encode()).hexdigest())
    assert got[9] == (1, 0, hashlib.sha256(b"").hexdigest())
