import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from coursegrain.llm import embed_dup as E
from coursegrain.llm import language_model as L
from coursegrain.llm import quality as Q

SF = "/root/testdata/sf0.001"


def test_quality_on_held_out_rows(spark):
    got = Q.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    pos, neg = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97


def test_density_difference_is_the_textbook_one():
    r = np.random.default_rng(12)
    x = {c: r.standard_normal((400, Q.FEATURES)) * (1 + c) + c for c in (0, 1)}
    m = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in x.items()}
    model, probe = Q.Discriminant(m), r.standard_normal((20, Q.FEATURES))
    log = {}
    pooled = np.diag(sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 800) + Q.FLOOR
    for c, v in x.items():
        a = max(Q.SHRINK, Q.FEATURES / (Q.FEATURES + len(v)))
        cov = (1 - a) * np.cov(v.T, bias=True) + a * np.diag(pooled)
        d = probe - v.mean(0)
        log[c] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(0.5)
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(-(log[1] - log[0]) / Q.FEATURES)))


def test_quality_without_labels_and_with_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (3, "x", 0.5), (3, "é" * 100_000, 0.5)], "doc_id long, text string, score double")
    x = Q.features(docs)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in Q.score(x, Q.fit(x, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (1, 1), (1, 0), (9, None)], "doc_id long, label int")
    assert {r["score"] for r in Q.score(x, Q.fit(x, one)).collect()} == {1.0}
    assert Q.keep_good(docs, one).count() == 4 and Q.features(docs.limit(0)).count() == 0
    assert Q.keep_good(docs.limit(0), one).count() == 0 and Q.keep_good(docs, one).columns == docs.columns
    many = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    every = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    assert Q.labelled_documents(every, many).count() == 3000 and 350 < Q.labelled_documents(every, many, 500).count() < 650


def _tokens(text):
    return L.words_of(text or "") + [b" "]


def test_lm_scores(spark):
    got = {r["doc_id"]: r for r in L.op7_log_bilinear(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i, t in docs.items() if i not in held for w in _tokens(t))
    n, total = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    for i, t in docs.items():
        w = _tokens(t)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10(c[x] + 0.1) - total for x in w), rel_tol=1e-9)
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


LONG = "y" * 70 + " "


def _small(spark):
    r = np.random.default_rng(20)
    words = [f"w{i}{'ing' if i % 3 else 'ed'}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    texts = [" ".join(r.choice(words, 60, p=p / p.sum())) + " " + LONG * (i % 3) for i in range(200)]
    rows = [(i, t, i % 10 != 0) for i, t in enumerate(texts)] + [(500, None, True), (501, "", False), (None, "w0ed unseened " + "z" * 100, False), (3, texts[3], True)]
    return rows, spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, learn boolean, tail string")


def test_lm_probabilities_add_up(spark):
    rows, docs = _small(spark)
    counts = L.written(L.word_counts(docs.filter("learn")), "t")
    vocab = L.vocabulary(counts, tokens_per_leaf=100, dictionary=200)
    assert vocab.tree.depth == 2 and vocab.n_shared > 5 and len(vocab.place) > vocab.first_shared - 1
    encoded = L.written(L.encoded(docs, vocab), "t")
    model = L.fit(encoded.filter("learn"), vocab, shard_tokens=3000)
    leaves = np.arange(vocab.tree.leaves)
    for far, near in ((0, 0), (3, 17), (vocab.first_shared, 1)):
        log = L.log_odds(vocab.tree, model, np.full(len(leaves), far), np.full(len(leaves), near), leaves)
        assert math.isclose(np.exp(log).sum(), 1, abs_tol=1e-4)
    # In a shared leaf, the words seen and one that was not add up to the leaf.
    c = Counter(w for _, t, learn in rows if learn for w in _tokens(t))
    own = {w: vocab.leaf[vocab.place[w]] if w in vocab.place else vocab.shared(w) for w in c if w != b" "}
    for k in range(vocab.n_shared):
        total = sum(c[w] + 0.1 for w, leaf in own.items() if leaf == vocab.first_shared + k) + 0.1
        assert math.isclose(total, vocab.mass[vocab.first_shared + k], rel_tol=1e-9)


def test_lm_scores_are_those_of_a_slow_version(spark):
    rows, docs = _small(spark)
    counts = L.written(L.word_counts(docs.filter("learn")), "t")
    vocab = L.vocabulary(counts, tokens_per_leaf=100, dictionary=200)
    encoded = L.written(L.encoded(docs, vocab), "t")
    model = L.fit(encoded.filter("learn"), vocab, shard_tokens=3000)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 4), round(r["base_score"], 6)) for r in L.scored(encoded, counts, vocab, model).collect())
    c = Counter(w for _, t, learn in rows if learn for w in _tokens(t))
    n, tree = sum(c.values()), vocab.tree

    def leaf_of(w):
        return 0 if w == b" " else int(vocab.leaf[vocab.place[w]]) if w in vocab.place else vocab.shared(w)

    def slow(text):
        total, base, far, near = 0.0, 0.0, 0, 0
        for w in _tokens(text):
            base += math.log10(c[w] + 0.1) - math.log10(n + 0.1 * (len(c) + 1))
            leaf = leaf_of(w)
            q = [float(x) + float(y) for x, y in zip(model.near[near], model.far[far])]
            for level in range(tree.depth):
                wide = tree.arity ** (tree.depth - level)
                node, child = leaf // wide, leaf % wide // (wide // tree.arity)
                e = [math.exp(sum(a * float(b) for a, b in zip(q, out)) + float(bias)) for out, bias in zip(model.out[level][node], model.bias[level][node])]
                total += math.log10(e[child] / sum(e))
            if leaf >= vocab.first_shared:
                total += math.log10((c[w] + 0.1) / vocab.mass[leaf])
            far, near = near, leaf
        return total, base

    want = []
    for i, t, _ in rows:
        s, base = slow(t)
        want.append((-1 if i is None else i, s, base))
    want.sort(key=lambda x: (x[0], x[1]))
    assert all(g[0] == w[0] and math.isclose(g[1], w[1], abs_tol=2e-3) and math.isclose(g[2], w[2], abs_tol=1e-5) for g, w in zip(got, want))


def test_lm_of_odd_tables(spark):
    rows, docs = _small(spark)
    assert L.train_and_score(docs.limit(0)).count() == 0
    none = L.train_and_score(docs.withColumn("learn", F.lit(None).cast("boolean"))).collect()
    assert len(none) == len(rows) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
    long = spark.createDataFrame([(1, "a b c " * 100_000, True), (1, "a b c " * 100_000, True)], "doc_id long, text string, learn boolean")
    out = L.train_and_score(long).collect()
    assert [r["n_tokens"] for r in out] == [300_001] * 2 and out[0]["score"] == out[1]["score"] > out[0]["base_score"]


def test_lm_model_does_not_depend_on_partitions(spark):
    _, docs = _small(spark)
    counts = L.written(L.word_counts(docs.filter("learn")), "t")
    vocab = L.vocabulary(counts, tokens_per_leaf=100, dictionary=200)
    models = [L.fit(L.written(L.encoded(d, vocab), "t").filter("learn"), vocab, shard_tokens=3000).flat() for d in (docs.repartition(7), docs.coalesce(1))]
    assert np.array_equal(*models)


def test_nce_learns_what_follows():
    r = np.random.default_rng(13)
    tree = L.Tree(70)
    share = L.shares(tree, np.ones(70))
    model = L.initial(tree, share)
    trainer = L.Trainer(tree, model, share)
    near = r.integers(0, 70, 300_000)
    for lo in range(0, len(near), 50_000):
        part = near[lo : lo + 50_000]
        trainer.learn(r.integers(0, 70, len(part)), part, (part * 3 + 1) % 70)
    leaves = np.arange(70)
    log = np.array([L.log_odds(tree, model, np.zeros(70, int), np.full(70, k), leaves) for k in range(70)])
    assert np.mean(log.argmax(1) == (leaves * 3 + 1) % 70) > 0.9


def test_near_vectors_match_brute_force(spark):
    r = np.random.default_rng(14)
    base = r.standard_normal((12, 16))
    rows = []
    for i in range(200):
        v = base[i % 12] + r.standard_normal(16) * r.choice([0, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, rows[0][1], None), (1004, [None] * 16, 0), (1005, [], 0), (1006, [float("inf")] * 16, 0), (None, rows[1][1], 1), (5, rows[5][1], 1), (1007, [1.0] * 4, 0), (1008, [1.0] * 4, 0)]
    df = spark.createDataFrame([(*x, "n") for x in rows + odd], "vec_id long, embedding array<float>, label int, node string")
    got = sorted((-1 if x["vec_id"] is None else x["vec_id"], x["n_links"], -1 if x["component_id"] is None else x["component_id"]) for x in E.near_vectors(df).collect())
    everything = rows + odd
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in everything]
    links, root = [0] * len(everything), list(range(len(everything)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, v, a) in enumerate(everything):
        for j in range(i + 1, len(everything)):
            _, w, b = everything[j]
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                x, y = np.array(v, np.float64), np.array(w, np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    ids = {}
    for i, (d, _, _) in enumerate(everything):
        ids.setdefault(find(i), []).append(d)
    least = lambda g: min((d for d in g if d is not None), default=-1)
    want = sorted((-1 if d is None else d, links[i], least(ids[find(i)])) for i, (d, _, _) in enumerate(everything))
    assert got == want
    assert E.near_vectors(df.limit(0)).count() == 0


def test_one_group_of_thousands_is_split(spark):
    r = np.random.default_rng(15)
    centre = r.standard_normal(16)
    rows = [(i, [float(x) for x in np.float32(centre + 0.01 * r.standard_normal(16))], 1) for i in range(5000)]
    rows += [(10_000 + i, [float(x) for x in np.float32(r.standard_normal(16))], 1) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in E.near_vectors(df, block=700, tables=8).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= E.MIN_COSINE).sum(1) - 1
    assert all(got[i] == (int(n), 0) for (i, _, _), n in zip(rows[:5000], near))


def test_what_comes_out_of_a_bucket_grows_with_its_vectors():
    x = np.eye(8)[0] + 0.001 * np.random.default_rng(16).standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, 1 + i % 2, v.tobytes()) for i, v in enumerate(x)]
    ids, counts, links = E.linked(rows, None, 0, 4, 0.93)
    assert len(ids) == 300 and len(links) == 299 and all(c == 450 - k for c, (_, k, _) in zip(counts.tolist(), rows))
    ids, counts, links = E.linked(rows[:100], rows[100:], 0, 4, 0.93)
    assert counts[:100].tolist() == [300] * 100 and counts[100:].tolist() == [150] * 200 and len(links) == 299


def _slow_statistics(text):
    """One byte, word and line at a time."""
    import math

    raw = text.encode()
    if not raw:
        return [0.0] * len(Q.NAMES)
    n, words = len(raw), text.split()
    runs, start = [], None
    for i, c in enumerate(raw + b" "):
        if chr(c) in " \t\n\x0b\x0c\r":
            if start is not None:
                runs.append((start, i))
            start = None
        elif start is None:
            start = i
    sizes = [b - a for a, b in runs] or [0]
    mean = sum(sizes) / len(sizes)
    symbols, stops = "#$%&*@^~_=+<>\\/{}[]", ".,;:!?"
    of = lambda test: math.sqrt(sum(bool(test(chr(c))) for c in raw) / n)
    ascii_in = lambda low, high: lambda c: low <= c <= high
    counts = [raw.count(bytes([c])) for c in range(256)]
    upper = lambda c: ord("A") <= c <= ord("Z")
    lines = text.split("\n")
    return [
        math.log(1 + n) / 4, math.log(1 + len(words)) / 4, math.log(1 + mean), math.log(1 + math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes))),
        of(ascii_in("A", "Z")), of(ascii_in("0", "9")), of(lambda c: c in symbols), of(lambda c: c in stops), of(lambda c: c == "|"), of(lambda c: c == "!"),
        of(lambda c: c == "\n"), of(lambda c: c == " "), of(lambda c: c >= "\x80"), len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines),
        -sum(k / n * math.log(k / n) for k in counts if k), math.sqrt(sum(chr(raw[b - 1]) in symbols for _, b in runs) / max(1, len(runs))),
        math.sqrt(sum(upper(raw[a]) and upper(raw[min(a + 1, n - 1)]) for a, _ in runs) / max(1, len(runs))),
    ]


def test_statistics_are_those_counted_one_by_one():
    import random

    r = random.Random(8)
    texts = ["", " \n\t", "A", "ok A", "ÉÉ été naïve", "a\xa0b", "#1 | two|| three!!", "x" * 3000]
    texts += ["".join(r.choice("aB9 é#|!.\n\t@ZZ ") for _ in range(r.randint(1, 120))) for _ in range(300)]
    for t in texts:
        assert np.allclose(Q.statistics(t), _slow_statistics(t), rtol=0, atol=1e-12), t
