from pyspark.sql import functions as F

from coursegrain.llm import mixing as M

DOC = "doc_id long, text string, source string, size string, rank long"


def _targets(sizes, cap=3):
    """Shares by weight, the excess given on until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= cap * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def _rows():
    import random

    r = random.Random(10)
    rows, i = [], 0
    for source, n, most in (("a", 300, 60), ("b", 30, 400), ("c", 5, 40), ("ä", 120, 80), (None, 60, 50)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * r.randint(0, most)), source, None, None))
            i += 1
    return rows + [(7, "x y", "a", None, None), (7, "x y", "a", None, None), (None, "q", "b", None, None), (9999, None, "c", None, None)]


def test_targets_and_taken_words(spark):
    rows = _rows()
    sizes = {}
    for _, t, s, _, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    docs = spark.createDataFrame(rows, DOC)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-4 and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.02 * t), (s, t, taken[s])
    again = {(r["doc_id"], r["text_key"], r["copies"]) for r in M.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["text_key"], r["copies"]) for r in got}


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame(_rows(), DOC)
    copies = M.mix(docs).agg(F.sum("copies")).first()[0]
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == copies


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([], DOC)
    assert M.mix(docs).count() == 0 and M.mixed_documents(docs).count() == 0
    none = spark.createDataFrame([(1, "", "a", None, None), (2, None, None, None, None)], DOC)
    assert {(r["target"], r["copies"]) for r in M.mix(none).collect()} == {(0.0, 0)}


def test_a_long_document_leaves_no_gap(spark):
    """Whatever comes first in rank order, small documents fill up what a long one would pass."""
    for seed in ("a", "b", "c", "d"):
        rows = [(i, "w " * 100, "s1", None, None) for i in range(250)] + [(500, "w " * 20_000, "s1", None, None)] + [(1000 + i, "w " * 50, "s2", None, None) for i in range(400)]
        out = M.mix(spark.createDataFrame(rows, DOC), seed=seed).collect()
        for source in ("s1", "s2"):
            own = [r for r in out if r["source"] == source]
            taken = sum(r["copies"] * r["size"] for r in own)
            assert abs(taken - own[0]["target"]) <= 100, (seed, source, taken, own[0]["target"])


def test_many_sources_and_a_hot_one(spark, monkeypatch):
    """Beyond FEW_SOURCES sources meet their rows in shuffled joins, with the same result."""
    import random

    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice([None, *(f"s{k}" for k in range(40))]), None, None) for i in range(300)] + [(1000 + i, "w " * (i % 25), "hot", None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    few = sorted(map(str, M.mix(docs).collect()))
    monkeypatch.setattr(M, "FEW_SOURCES", 5)
    assert sorted(map(str, M.mix(docs).collect())) == few


def test_the_fill_goes_on_until_nothing_fits(spark):
    """Sizes of powers of two, the largest first in any order: every pass can take one more."""
    rows = [(i, "w " * 2**k, "a", None, None) for i, k in enumerate(range(13))] + [(100, "w " * 6000, "b", None, None)]
    for seed in ("x", "y"):
        out = [r for r in M.mix(spark.createDataFrame(rows, DOC), seed=seed).collect() if r["source"] == "a"]
        missing = out[0]["target"] - sum(r["copies"] * r["size"] for r in out)
        free = [r["size"] for r in out if r["copies"] == min(x["copies"] for x in out)]
        assert missing < 1 or not any(size <= missing for size in free), (seed, missing, free)
