import random
from collections import Counter, defaultdict

import numpy as np

from coursegrain.llm import near_dup as N

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_banded_alignment_is_the_full_one_above_the_threshold():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(30) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 8)):
            p = r.randrange(len(b)) if b else 0
            kind = r.randrange(3)
            if kind == 0 and b:
                b[p] = r.randrange(30)
            elif kind == 1 and b:
                del b[p]
            else:
                b.insert(p, r.randrange(30))
        want, got = _lcs(a, b) / max(len(a), len(b)), N.aligned(a, b)
        assert (want >= 0.8) == (got >= 0.8)
        if want >= 0.8:
            assert abs(want - got) < 1e-9


def _shingles(text):
    w = text.lower().split()
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def _row_lcs(a, b):
    """Length of the longest common subsequence, one row of the table at a time."""
    names = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
    b = np.array([names[x] for x in b])
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == names[x])))
    return int(row[-1])


def _near_pairs(texts):
    """All pairs of near copies, from the rule alone: pairs with enough shingles in common are aligned in full."""
    cut = {i: Counter(_shingles(t)) for i, t in texts.items()}
    size = {i: sum(c.values()) for i, c in cut.items()}
    holders = defaultdict(list)
    for i, c in cut.items():
        for x in c:
            holders[x].append(i)
    common = Counter()
    for x, ids in holders.items():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                common[i, j] += min(cut[i][x], cut[j][x])
    maybe = [(i, j) for (i, j), n in common.items() if n >= 0.8 * max(size[i], size[j])]
    words = {i: t.lower().split() for i, t in texts.items()}
    return [(i, j) for i, j in maybe if words[i] == words[j] or _row_lcs(_shingles(texts[i]), _shingles(texts[j])) >= 0.8 * max(size[i], size[j])]


def _brute(texts):
    """Classes from all pairs of near copies."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [i for i, t in texts.items() if not t.split()]
    for i, j in _near_pairs(texts) + [(empty[0], i) for i in empty[1:]]:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return {i: find(i) for i in texts}


def _corpus():
    r = random.Random(2)
    words = ["w%d" % i for i in range(3000)]
    passage = r.choices(words, k=60)
    texts, n = {}, 0
    for _ in range(25):
        base = r.choices(words, k=r.randint(5, 200))
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.005, 0.01, 0.1]))):
                w[r.randrange(len(w))] = r.choice(words)
            texts[n] = " ".join(w)
            n += 1
    for _ in range(20):  # a passage that many share, and little else
        texts[n] = " ".join(passage + r.choices(words, k=60))
        n += 1
    return texts


def test_classes_match_brute_force(spark):
    texts = _corpus()
    texts[900], texts[901], texts[902], texts[903] = "", "  ", "a b c", "A b  c"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOC)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs).collect()}
    assert got == _brute(texts)


def _template_group(n):
    """Pairs of near copies among texts that share most of a long passage, and are no near copies."""
    r = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    passage = r.choices(words, k=160)
    texts = {}
    for i in range(0, n, 2):
        own = r.choices(words, k=42)
        texts[i] = " ".join(passage + own)
        texts[i + 1] = " ".join(passage[:10] + r.choices(words, k=34) + passage[44:] + own)
    return texts


def test_links_between_members_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    texts = _template_group(800)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOC)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs).collect()}
    # Other texts have the passage in common at most: 156 of 198 shingles.
    cut = {i: N.shingles(N.word_hashes(t.encode())) for i, t in texts.items()}
    assert all(N.similar(cut[i], cut[i + 1]) for i in range(0, 800, 2))
    assert not any(N.similar(cut[0], cut[i]) or N.similar(cut[1], cut[i]) for i in range(2, 800))
    assert got == {i: i - i % 2 for i in texts}


def test_buckets_are_parted_by_a_few_tables(spark):
    """Four parts for each row, and one at least in common for nodes that agree in five tables."""
    r = random.Random(24)
    rows, sets = [], [sorted(r.sample(range(20), 5)) for _ in range(40)] + [list(range(0, 20, 4))]
    for i, same in enumerate(sets):
        for side in range(2):
            sketches = [i * 1000 + t if t in same else i * 1000 + 100 * (side + 1) + t for t in range(20)]
            rows += [(i * 100 + t, t, bytes([i, side]), bytes([i, side]), 9, sketches) for t in same]
    mixed = spark.createDataFrame(rows, "bucket long, t int, node binary, root binary, n long, sketches array<long>")
    parts = N._parts(mixed).collect()
    assert len(parts) == 4 * len(rows)
    held = defaultdict(set)
    for x in parts:
        held[x["part"]].add(bytes(x["node"]))
    assert {x for x in map(frozenset, held.values()) if len(x) > 1} == {frozenset({bytes([i, 0]), bytes([i, 1])}) for i in range(len(sets))}
    assert sum(len(x) == 2 for x in map(tuple, N._refined(mixed).collect())) == len(sets)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "x y z", None, None, None), (5, "x y z", None, None, None), (5, "x y z", None, None, None), (7, None, None, None, None), (8, "", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "node")
    out = N.near_duplicates(docs).collect()
    assert len(out) == 6
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in out} == {(None, 5, False), (5, 5, True), (7, 7, True), (8, 7, False), (None, 7, False)}
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_word_hashes_are_those_of_the_words():
    a = N.word_hashes(b"ab  cd\tab\n")
    assert len(a) == 3 and a[0] == a[2] and a[0] != a[1]
    assert len(N.word_hashes(b"")) == 0
    long = N.word_hashes(b"q" * 200_000 + b" ab")
    assert np.array_equal(long[1:], a[:1])


def test_order_counts():
    r = random.Random(21)
    w = [str(r.random()) for _ in range(400)]
    a, b = (N.shingles(N.word_hashes(" ".join(x).encode())) for x in (w, w[200:] + w[:200]))
    assert len(set(a.tolist()) & set(b.tolist())) > 0.8 * len(set(a.tolist()) | set(b.tolist()))
    assert not N.similar(a, b)  # the same passages in another order are no near copy


def test_recall_of_all_near_pairs_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in N.op10_order_minhash(spark, sf).collect()}
    pairs = _near_pairs(texts)
    found = sum(got[i]["class_id"] == got[j]["class_id"] for i, j in pairs)
    assert len(pairs) > 50 and found / len(pairs) >= 0.99
    want = _brute(texts)
    assert sum(got[i]["class_id"] == want[i] for i in texts) / len(texts) >= 0.99
    # Nothing is linked that the rule doesn't link.
    assert all(want[i] == want[r["class_id"]] for i, r in got.items())
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_one_group_of_thousands(spark):
    r = random.Random(22)
    base = r.choices(["w%d" % i for i in range(3000)], k=120)
    rows = []
    for i in range(3000):
        w = list(base)
        if i % 2:
            w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w), None, None, None))
    rows += [(5000 + i, " ".join(r.choices(base, k=80)), None, None, None) for i in range(50)]
    out = N.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {x["class_id"] for x in out if x["doc_id"] < 3000} == {0} and all(x["kept"] for x in out if x["doc_id"] >= 5000)


def test_shingles_in_common_are_counted(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 7)
    r = np.random.default_rng(23)
    cut = [N.labelled(r.integers(0, 40, r.integers(1, 60)).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in cut] for a in cut])
    assert (N.in_common(cut[:5], cut[5:]) == want[:5, 5:]).all()
    got = N.in_common(cut, cut)
    assert (np.triu(got, 1) == np.triu(want, 1)).all()
