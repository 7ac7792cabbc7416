import random
import zlib

import numpy as np
import pytest

from coursegrain.llm import packing as P
from coursegrain.llm import token_files as W
from coursegrain.llm.tokens import END_ID, ChunkEncoder, tokenizer_path

DOC = "doc_id long, text string, piece string, part string, n_chars long"
ODD = [
    "", "  \n", "a\xa0b 's it's don't,", " x  ́y", "<|endoftext|> z<|startoftext|>q <|ENDoftext|>", "ΑΣ ΟΔΟΣ, straße İI", "x​y 1234,56. $$.. a.b.c, d,, é, é. Ǆ",
    "\x1c\x1dq\x1er \x85v", "I'M we'll, 's.", "ﬁ,Å K Ω. ½,", "日本語。テキスト, 한국어", "WORD!! Word### wörd***\tÀÉ.", "x" * 5000 + " " + "ab" * 300, "µª º ÿ ß ÷×",
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_memo_gives_the_tokenizers_ids(plain):
    r = random.Random(6)
    bits = ["the", "The", "THE,", "it's", "x--y", "1a2", "é", "É.", "naïve,", " ", "\n", "\t", "\xa0", "...", "'", "ll", "#"]
    texts = ODD + ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(30)) for _ in range(300)]
    for memo in (10, 10**6):
        e = ChunkEncoder(tokenizer_path(), memo)
        for t, ids in zip(texts, e.encode(texts)):
            assert ids.tolist() == plain(t), t


def test_a_full_memo_keeps_what_was_met_lately(plain):
    e = ChunkEncoder(tokenizer_path(), 40)
    learnt = []
    learn = e.memo.learn
    e.memo.learn = lambda chunk: learnt.append(chunk) or learn(chunk)
    texts = [f"often. rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    assert [x.tolist() for x in e.encode(texts)] == [plain(t) for t in texts]
    assert learnt.count("often.") == 1 and len(learnt) == 401
    assert len(e.memo) + len(e.memo.before) <= 44
    e.forget()
    assert not e.memo and not e.memo.before and not e.stems.before


def _docs(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(r.choice([3, 200, 1500, 5000])))) for i in range(60)]
    rows += [(None, "no id"), (3, "again"), (3, "again"), (100, None), (101, "")] + [(200 + i, t) for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC)


def test_packing_is_whole_and_gapless(spark, plain):
    rows, docs = _docs(spark)
    got = P.pack_documents(docs, 512).collect()
    by_doc, by_seq = {}, {}
    for x in got:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    total = 0
    for seq in by_seq.values():
        at = 0
        for x in sorted(seq, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 512
        total += at
    assert total == sum(len(plain(t)) for _, t in rows)
    assert len(by_seq) <= 1.02 * total / 512
    for d, t in rows:
        ids = np.array(plain(t), "<u4")
        want = sorted((i, lo, min(512, len(ids) - lo), zlib.crc32(ids[lo : lo + 512])) for i, lo in enumerate(range(0, len(ids), 512)))
        have = sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by_doc[d])
        assert have == want or (d == 3 and all(w in have for w in want))
    assert P.pack_documents(docs.limit(0)).count() == 0


def _squares(bins, n):
    return sum(sum(n[i] for i in b) ** 2 for b in bins)


def test_local_search_empties_bins():
    lengths = [60, 60, 40, 40, 50, 30, 20]  # three full bins of 100, by an exchange and a move
    bins, steps = P.local_search([[0], [1], [2, 3], [4, 5, 6]], lengths, 100)
    assert len(bins) == 3 and steps > 0 and sorted(i for b in bins for i in b) == list(range(7))
    # Two for one: 30 + 40 take the place of 60 in a bin with room 10, and 60 then fits beside 40.
    bins, _ = P.local_search([[0, 1], [2, 3], [4]], [30, 40, 60, 30, 40], 100)
    assert len(bins) == 2
    r = random.Random(8)
    for _ in range(60):
        n = [r.randint(1, 100) for _ in range(r.randint(0, 60))]
        start = P.next_fit(n, 100)
        out, steps = P.local_search([list(b) for b in start], n, 100)
        assert sorted(i for b in out for i in b) == list(range(len(n))) and all(sum(n[i] for i in b) <= 100 for b in out)
        assert len(out) <= len(start) and (_squares(out, n) > _squares(start, n)) == (steps > 0)


def _step_is_left(bins, n, size):
    """Whether a move or an exchange of the emptiest-first kind would still raise the squares."""
    fill = [sum(n[i] for i in b) for b in bins]
    for b, own in enumerate(bins):
        if fill[b] == size:
            continue
        offers = [(n[i], 1) for i in own] + [(n[i] + n[j], 2) for x, i in enumerate(own) for j in own[x + 1 :]]
        for k, other in enumerate(bins):
            if k == b or fill[k] == size or fill[k] < fill[b]:
                continue
            for total, pieces in offers:
                if pieces == 1 and fill[k] + total <= size:
                    return True
                if any(n[j] < total and fill[k] + total - n[j] <= size and fill[k] + total - n[j] > fill[b] for j in other):
                    return True
    return False


def test_local_search_ends_where_no_step_is_left():
    r = random.Random(10)
    ended = 0
    for _ in range(80):
        n = [r.randint(20, 70) for _ in range(r.randint(5, 25))]
        out, _ = P.local_search(P.next_fit(n, 100), n, 100)
        if len(out) > -(-sum(n) // 100):
            ended += 1
            assert not _step_is_left(out, n, 100)
    assert ended > 5


def test_a_pool_of_middle_sized_pieces_and_one_of_repeated_rows(spark):
    r = random.Random(11)
    n = [r.randint(1400, 2700) for _ in range(3000)]
    out, steps = P.local_search(P.next_fit(n, 4096), n, 4096)
    assert len(out) <= 1.02 * -(-sum(n) // 4096) and steps > 1000
    same = spark.createDataFrame([(1, "a few words of text")] * 3000, "doc_id long, text string")
    pieces = P.written(P.pieces(same), "t")
    got = P.pack(pieces, pool=500).selectExpr("sequence_id >> 32 as pool").groupBy("pool").count().collect()
    assert len(got) == 6 and max(x["count"] for x in got) < 700


def test_the_query_packs_the_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    got = P.op2_best_fit_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(d["doc_id"], i): (lo, min(4096, len(ids) - lo), zlib.crc32(ids[lo : lo + 4096])) for d in docs for ids in [np.array(plain(d["text"]), "<u4")] for i, lo in enumerate(range(0, len(ids), 4096))}
    assert {(x["doc_id"], x["piece"]): (x["start"], x["length"], x["ids_crc32"]) for x in got} == want
    assert got[0]["pool_steps"] > 0 and got[0]["pool_end"] < got[0]["pool_start"]
    assert len({x["sequence_id"] for x in got}) == -(-sum(x["length"] for x in got) // 4096)


def test_segments_are_lossless_and_checked():
    r = np.random.default_rng(9)
    for docs in ([], [(1, np.array([1]))], [(None, r.integers(0, 50_000, 9000)), (5, np.array([1]))], [(2, np.full(9000, 7))], [(2, r.integers(0, 2**32 - 1, 5000))]):
        docs = [(d, x.astype("<u4")) for d, x in docs]
        out = W.unpack_segment(W.pack_segment(docs))
        assert [d for d, _ in out] == [d for d, _ in docs] and all((a[1] == b[1]).all() for a, b in zip(docs, out))
    data = bytearray(W.pack_segment([(1, r.integers(0, 40_000, 9000).astype("<u4"))]))
    data[-100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        W.unpack_segment(bytes(data))
    repeated = np.tile(r.integers(0, 40_000, 50), 80).astype("<u4")
    assert len(W.pack_segment([(1, repeated)])) < 4000 * 2 / 4


def test_three_predictions_make_one_distribution():
    r = np.random.default_rng(12)
    models = W.Models(50)
    for t in range(40):  # eight lanes; the guesses are the same, in order and the other way round
        models.expect(r.integers(0, 2, 8), r.integers(0, 4, 8))
        lanes = models.guess, models.weights
        start, size = np.zeros((50, 8), np.int64), np.zeros((50, 8), np.int64)
        for i in range(50):
            start[i], size[i] = models.interval(np.full(8, i))
        assert (start[0] == 0).all() and (start[1:] == start[:-1] + size[:-1]).all() and (start[-1] + size[-1] == 1 << 24).all() and size.min() > 0
        for i in range(50):
            for place in (start[i], start[i] + size[i] - 1, start[i] + size[i] // 2):
                assert (models.find(place) == i).all()
        assert lanes == (models.guess, models.weights)
        ids = np.minimum(r.geometric(0.3, 8), 49)
        models.interval(ids)
        models.weigh(models.learn(ids))
        models.spread(ids)


def test_lanes_and_blocks_of_all_lengths_and_carries():
    r = np.random.default_rng(13)
    for n in (1, 2, 511, 512, 513, 1024, 1537, 40_000):
        for top in (1, 2, 300, 65_536, 65_537, 2**32):
            x = np.minimum(r.geometric(0.01, n) * (top // 300 + 1), top - 1).astype("<u4")
            for block in (W.BLOCK, 700)[: 1 + (n < 2000)]:
                (_, got), = W.unpack_segment(W.pack_segment([(1, x)], block))
                assert (got == x).all(), (n, top, block)
    # 2**64 is passed while a word of all ones waits: both words before take the carry.
    coder = W.Writer(1, 8)
    coder._give(np.array([0]), np.array([7 << 32], np.uint64))
    coder._give(np.array([0]), np.array([2**64 - 1], np.uint64))
    coder.low[:] = 2**64 - 2
    coder.put(np.array([1]), np.array([1]))
    assert coder.words[2:4].tolist() == [8, 0]


def test_an_id_is_coded_in_a_few_array_operations():
    import time

    x = np.minimum(np.random.default_rng(14).zipf(1.3, 500_000), 40_000).astype("<u4")
    before = time.process_time()
    (_, got), = W.unpack_segment(W.pack_segment([(1, x)]))
    assert time.process_time() - before < 2e-6 * len(x)  # nibble by nibble it took more than 5 microseconds an id
    assert (got == x).all()


def _same_files(got, rows, plain):
    at = 0
    got.sort(key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    want = sorted((-1 if d is None else d, len(plain(t)), zlib.crc32(np.array(plain(t), "<u4"))) for d, t in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == want
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]


def test_token_files_in_document_order(spark, plain):
    rows, docs = _docs(spark)
    _same_files(W.read_token_files(W.write_token_files(docs)).collect(), rows, plain)
    assert W.read_token_files(W.write_token_files(docs.limit(0))).count() == 0


def test_documents_go_on_over_segments(spark, plain):
    rows, docs = _docs(spark)
    for size in (20_000, 1):
        if size == 1:
            rows, docs = rows[60:64], docs.filter("doc_id is null or doc_id in (100, 101) or text = 'again'").limit(4)
            rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
        files = W.write_token_files(docs, segment_ids=size)
        counts = [x["n_ids"] for x in files.collect()]
        assert max(counts) <= size and files.filter("seq > 0").count() > 2 and sum(counts) == sum(len(plain(t)) for _, t in rows)
        _same_files(W.read_token_files(files).collect(), rows, plain)


def test_checksums_are_joined():
    a, b = b"some bytes", bytes(range(256)) * 5
    assert W.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert W.joined_crc(zlib.crc32(a), 0, 0) == zlib.crc32(a) and W.joined_crc(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_the_query_reads_back_all_ids(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _same_files(W.op3_token_files(spark, sf).collect(), rows, plain)
