import random
import re
import zlib
from collections import Counter

import numpy as np

from coursegrain.llm import phrases as P

DOC = "lang string, text string, block long, word string, n long"
LOWER = {c: c + 32 for c in range(65, 91)}


def _by_hand(rows, least, most_words=5, top=2000):
    """Counts of all runs of words, by the contract."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, most_words + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = set()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= 100 * f[p[i : i + m]]:
                        inside.add(p[i : i + m])
        found = []
        for p, a in some.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _mined(spark, rows, parts=3, **more):
    docs = spark.createDataFrame([(lang, t, 1, "w", 2) for lang, t in rows], DOC).repartition(parts)
    return sorted(tuple(r) for r in P.collocations(docs, **more).collect())


def _texts(seed, n, words=("the", "of", "Big", "red", "fox", "é", "ça", "x\x85y", "a\xa0b", "_", "-")):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        own = [r.choice(words) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            own += ["New", "York", "City", "Hall", "of", "fame"]
        out.append((r.choice(["en", "fr", None]), "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\r\n", " ! "]) for w in own)))
    return out


def test_matches_counting_by_hand(spark):
    rows = _texts(1, 250) + [("en", None), (None, ""), ("de", " ,;. \n")]
    for least in (4, 30):
        assert _mined(spark, rows, least=least) == _by_hand(rows, least)


def test_small_containers_spills_and_blocks(spark, monkeypatch):
    rows = _texts(2, 120)
    monkeypatch.setattr(P, "SLICE_KEYS", 50)
    assert _mined(spark, rows, least=5, burst=3, most=20, top=7) == _by_hand(rows, 5, top=7)


def test_blocks_and_slices_end_between_pieces():
    import pyarrow as pa

    rows = _texts(3, 60)
    before = P.BLOCK_WORDS, P.SLICE_BYTES
    P.BLOCK_WORDS, P.SLICE_BYTES = 40, 64
    try:
        import unittest.mock as mock

        with mock.patch.object(P, "TaskContext") as context:
            context.get.return_value.partitionId.return_value = 2
            got = [b for b in P._encode(3)(iter([pa.record_batch([pa.array([x or "und" for x, _ in rows]), pa.array([t for _, t in rows])], names=["lang", "text"])]))]
    finally:
        P.BLOCK_WORDS, P.SLICE_BYTES = before
    table = pa.Table.from_batches(got).to_pylist()
    words = {}
    for r in table:
        if r["keys"] is not None:
            own = zlib.decompress(r["keys"]).decode().split("\n")
            words.update({(r["block"], int(i)): w for i, w in zip(np.frombuffer(zlib.decompress(r["more"]), np.int32), own)})
    runs = Counter()
    for r in table:
        if r["ids"] is not None:
            run = []
            for i in [*P._numbers(r["ids"], np.int32).tolist(), -1]:
                if i < 0:
                    runs[tuple(run)] += bool(run)
                    run = []
                else:
                    run.append(words[r["block"], i])
    want = Counter(tuple(w) for _, t in rows for w in (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", t.translate(LOWER))) if w)
    assert +runs == want and len({r["block"] for r in table}) > 5


def test_the_trie_counts_as_a_dictionary_does():
    r = np.random.default_rng(4)
    for most in (10**9, 900):
        runs: list = []
        trie, want = P.HatTrie(lambda k, n: runs.append((k, n)), burst=16, most=most), Counter()
        for _ in range(30):
            keys = np.unique(r.integers(0, 4000, 300).astype(np.uint64) << r.choice([0, 33]).astype(np.uint64))
            counts = r.integers(1, 9, len(keys))
            want.update(dict(zip(keys.tolist(), counts.tolist())))
            trie.add(keys, counts)
            assert trie.size <= most
        trie.drain()
        got = Counter()
        for k, n in runs:
            assert (np.diff(k.astype(object)) > 0).all()
            got.update(dict(zip(k.tolist(), n.tolist())))
        assert got == want and trie.size == 0


def test_packed_keys_come_back():
    r = np.random.default_rng(8)
    for kind in (np.int32, np.int64):
        x = np.array([-1, 0, 5, 70_000, -1, 2**31 - 2], kind)
        assert (P._numbers(P._planes(x), kind) == x).all() and P._numbers(P._planes(x[:0]), kind).dtype == kind
    for n in (0, 1, 1000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        assert (P._loosened(P._squeezed(x), np.uint64) == x).all()
    x = np.unique(r.integers(0, 1 << 62, 500).astype(np.uint64))
    rows = [b.to_pylist()[0] for b in P._packed_runs(5, [(x[::2], np.arange(len(x[::2])) + 1), (x[1::2], np.arange(len(x[1::2])) + 1)], 7)]
    assert sorted(k for row in rows for k in P._loosened(row["keys"], np.uint64).tolist()) == x.tolist() and len({row["part"] for row in rows}) == len(rows)


def test_products_beyond_64_bits(spark):
    one = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    levels = [None, spark.createDataFrame([(1, "en", ["a", "b"], [4 * 10**15, 3 * 10**15], [3 * 10**15, 3 * 10**15], 1, 2)], "id long, lang string, words array<string>, heads array<long>, tails array<long>, first long, second long")]
    import unittest.mock as mock

    with mock.patch.object(P, "frequent_phrases", return_value=(one, levels)):
        (r,) = P.collocations(None, most_words=2).collect()
    assert r["score"] == 1000 * 3 * 10**15 * 9 * 10**15 // (4 * 10**15 * 3 * 10**15)


def test_one_pair_everywhere_and_nothing(spark):
    rows = [("en", "very common " * 400)] * 30 + [("en", "very common")] * 50
    assert _mined(spark, rows, least=100) == _by_hand(rows, 100)
    assert _mined(spark, []) == []
    assert _mined(spark, [(None, None), ("en", "a b c")]) == []
