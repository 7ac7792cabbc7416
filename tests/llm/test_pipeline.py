import random

from pyspark.sql import functions as F

import corpus_pipeline as P

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark):
    r = random.Random(15)
    words = ["w%d" % i for i in range(800)]
    line = "this very line is held by a good many of the documents here"
    rows = []
    for i in range(80):
        bad = i % 8 == 0
        body = " ".join(r.choice(words) + ("###" if bad else "") for _ in range(r.randint(30, 120)))
        rows.append((i, f"{line}\n{body}", "en", f"s{i % 3}", 0))
    copy = rows[3][1].split("\n")[1]
    rows += [(100, copy, "en", "s1", 0), (101, copy.replace(copy.split()[40], "changed", 1) if len(copy.split()) > 60 else copy, "en", None, 0), (None, "no id at all " + " ".join(words[:30]), None, None, None), (102, None, None, "s0", None), (103, "", "en", "s0", 0)]
    labels = [(i, int(i % 8 != 0), 0) for i in range(80)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_each_stage(spark, tmp_path):
    docs, labels = _docs(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "packing"]

    good = P.written(stages["quality"](spark, docs, sf), "t")
    ids = {r["doc_id"] for r in good.collect()}
    assert not any(i is not None and i < 80 and i % 8 == 0 for i in ids) and {i for i in range(80) if i % 8} <= ids

    lines = P.written(stages["line_dedup"](spark, good, sf), "t")
    assert lines.columns == docs.columns and lines.count() == good.count()
    assert lines.filter(F.col("text").contains("this very line")).count() == 1
    assert lines.filter("n_chars != length(text)").count() == 0

    near = P.written(stages["near_dedup"](spark, lines, sf), "t")
    kept = {r["doc_id"] for r in near.collect()}
    assert 3 in kept and 100 not in kept and {i for i in range(80) if i % 8} <= kept

    mixed = P.written(stages["mix"](spark, near, sf), "t")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept

    packed = P.written(stages["packing"](spark, mixed, sf), "t")
    assert packed.filter("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_stages_take_an_empty_table(spark, tmp_path):
    docs, labels = _docs(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
