import hashlib
import random
import zlib

import numpy as np
import pytest

from coursegrain.llm import media as M


def _payloads():
    r = random.Random(11)
    out = [b"", b"abc", bytes([128]) * 1000, bytes(r.randrange(256) for _ in range(3000)), b"\x80" * 40 + b"a" + b"\x80" * 700]
    out += [bytes(r.choice([128, 128, 128, 200, 255]) for _ in range(5000)), "Prose, as usual: Ärger & Öl.\n".encode() * 90]
    return [M.padded(x) for x in out]


def _back(file):
    (p, blocks), = M.decode([file])
    return (blocks + 128).astype(np.uint8).tobytes()[: int(p.comment.split()[1])]


def test_payloads_come_back():
    payloads = _payloads()
    files = M.encode(payloads)
    assert [_back(f) for f in files] == payloads
    assert files == [M.encode([p])[0] for p in payloads]  # a file doesn't depend on its batch
    assert all(b"\xff" + bytes([m]) in files[0] for m in (0xD8, 0xDB, 0xC0, 0xC4, 0xDD, 0xDA, 0xD9))
    wide = M.padded(b"x" * 1_700_000)
    assert _back(M.encode([wide])[0]) == wide


def _plain_decode(file):
    """Bit by bit, with the code tables as dictionaries."""
    p = M.Parsed(file)
    books = {}
    for k, (counts, symbols) in p.tables.items():
        codes, sizes = M.code_book(counts, symbols)
        books[k] = {(int(sizes[s]), int(codes[s])): s for s in symbols}
    out = []
    for scan, mcus in zip(p.intervals, p.interval_mcus):
        bits = "".join(f"{b:08b}" for b in scan)
        at, dc = 0, 0

        def take(book):
            nonlocal at
            n = 1
            while (n, int(bits[at : at + n], 2)) not in book:
                n += 1
            s = book[(n, int(bits[at : at + n], 2))]
            at += n
            return s

        def value(n):
            nonlocal at
            v = int(bits[at : at + n] or "0", 2)
            at += n
            return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(mcus):
            block = [0] * 64
            dc += value(take(books[0]))
            block[0] = dc
            k = 1
            while k < 64:
                s = take(books[16])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = value(s & 15)
                k += 1
            out.append(block)
    return np.array(out)


def test_lanes_decode_as_one_by_one():
    for f in M.encode(_payloads()):
        (p, blocks), = M.decode([f])
        assert (blocks == _plain_decode(f)).all()
        t = M.thumbnail(p, blocks)
        assert t.shape == (p.height // 8, p.width // 8)
        want = np.clip((blocks[:, 0].astype(int) + 4) // 8 + 128, 0, 255).reshape(t.shape)
        assert (t == want).all()


def test_other_files_are_refused():
    f = M.encode([M.padded(b"abc")])[0]
    for bad in (b"GIF", f.replace(b"\xff\xc0", b"\xff\xc2"), f[:-40] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            M.decode([bad])


def test_columns(spark):
    rows = [(1, "abc"), (2, "abc"), (None, None), (4, ""), (5, "é" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, data string").selectExpr("doc_id", "cast(data as binary) data", "1 as media")
    got = {r["doc_id"]: r for r in M.media_features(M.with_media(docs)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = M.padded(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1][2:] == got[2][2:] and got[None][2:] == got[4][2:]
    assert M.media_features(M.with_media(docs.limit(0))).count() == 0


def test_a_long_payload_is_coded_in_slices(monkeypatch):
    r = random.Random(16)
    long = M.padded(bytes(r.choice(b"some letters, ") for _ in range(40_000)))
    want = M.encode([long])
    monkeypatch.setattr(M, "SLICE_BYTES", M.UNIT * 3)
    assert M.encode([long]) == want and _back(want[0]) == long
    assert all((a[1] == b).all() for a, b in zip(M.decode([want[0]] * 2), [_plain_decode(want[0])] * 2))


def test_the_query_stores_all_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in M.op8_jpeg_media(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, raw in texts.items():
        payload, file = M.padded(raw), M.encode([M.padded(raw)])[0]
        want = (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
        assert tuple(got[i])[:7] == want
    plan = M.media_features(M.stored_media(spark.createDataFrame([(1, b"x")], "doc_id long, data binary")))._jdf.queryExecution().toString()
    assert "parquet" in plan and "media" in plan
