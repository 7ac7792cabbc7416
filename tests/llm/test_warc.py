import hashlib

from pyspark.sql import functions as F

from coursegrain.llm import warc as W

PAGE = "page_id long, url string, html string, data string"


def _rows():
    big, other = "<p>" + "x" * 1200, "é" * 600
    rows = [(i, f"http://www.Host{i % 3}.org/a/{i % 7}?q={i}", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 2}", None) for i in range(60)]
    return rows + [(60, None, None, None), (61, "no scheme", "", None), (62, "http://h:80", big, None), (7, "http://www.host1.org/a/0?q=7", big, None), (7, "http://www.host1.org/a/0?q=7", big, None), (None, "u", other, None)]


def _all(archives):
    """Every record, found by all lines of the index."""
    index = W.capture_index(archives, 7)
    lines = [x for r in index.collect() for x in W.unpack_lines(r["data"])]
    assert sorted((x[0], W._order(x[1])) for x in lines) == [(x[0], W._order(x[1])) for r in index.orderBy("part", "block").collect() for x in W.unpack_lines(r["data"])]
    found = W.captures(archives.selectExpr("inline(lines)").select("key", "page_id"), index, exact=True)
    assert found.count() == len(lines)
    return W.read_captures(found, archives).collect()


def test_records_by_the_rule(spark):
    rows = _rows()
    pages = spark.createDataFrame(rows, PAGE).repartition(5)
    archives = W.write_archives(pages)
    records = _all(archives)
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["url"] or "", r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] if r["refers_to"] is not None else -1) for r in records)
    top = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            top[b] = max(top.get(b, -1), -1 if i is None else i)
    want = []
    for i, u, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and top[b] != i
        want.append((-1 if i is None else i, u or "", len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else -1))
    assert got == sorted(want)
    # What a revisit stands for isn't stored again.
    assert all((r["stored_bytes"] == 0) == (r["record_type"] == "revisit" or r["payload_bytes"] == 0) for r in records)



def test_lookup_finds_all_captures(spark):
    rows = _rows() + [(300 + i, "http://many.org/", f"capture {i}", None) for i in range(40)]
    archives = W.write_archives(spark.createDataFrame(rows, PAGE), archive_bytes=900)
    assert archives.count() > 10
    index = W.capture_index(archives, 3)  # a key's captures fill blocks and parts
    urls = [rows[5][1], "http://www.host1.org/a/0?q=7", "http://nowhere.org/", "http://many.org/", "http://many.org/", "0", "zz.zz/"]
    got = sorted((r["url"].lower(), r["page_id"]) for r in W.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), index, archives).collect())
    assert got == sorted([(rows[5][1].lower(), 5)] + [("http://www.host1.org/a/0?q=7", 7)] * 3 + [("http://many.org/", 300 + i) for i in range(40)])
    assert [(r["url"], r["page_id"]) for r in W.lookup(spark.createDataFrame([(None,)], "url string"), index, archives).collect()] == [(None, 60)]
    key = spark.createDataFrame([("http://www.a.org/x",), ("https://A.org",), (None,)], "u string").select(W.url_key(F.col("u"))).collect()
    assert [r[0] for r in key] == ["org,a,www)/x", "org,a)/", ")/"]
    wanted = W.captures(archives.selectExpr("inline(lines)").select("key", "page_id"), index, exact=True)
    plan = W.read_captures(wanted, archives)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocks_are_searched():
    lines = sorted([(f"org,a)/{i:05d}", i, 4, i * 10, 10) for i in range(50)] + [("org,b)/\t%", i, 5, i, 1) for i in range(3)])
    back = W.unpack_lines(W.pack_lines(lines))
    assert [(k.decode(), *rest) for k, *rest in back] == lines
    assert [x[1] for x in W.find_lines(back, b"org,a)/00007")] == [7] and len(W.find_lines(back, b"org,b)/\t%")) == 3 and W.find_lines(back, b"zz") == []
    assert [x[3] for x in W.find_lines(back, b"org,b)/\t%", 2, True)] == [2] and W.find_lines(back, b"org,b)/\t%", 9, True) == []
    firsts = [(b"a", 1), (b"b", 1), (b"b", 5), (b"c", 0)]
    assert list(W._span(firsts, b"b", None, False)) == [0, 1, 2] and list(W._span(firsts, b"b", 6, True)) == [2] and list(W._span(firsts, b"b", 5, True)) == [1, 2]


def test_a_page_beyond_an_archive_is_one_record(spark):
    import random

    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    pages = spark.createDataFrame([(1, "a.org", long, None), (2, "b.org", "x", None), (3, "a.org", long, None)], PAGE)
    got = {x["page_id"]: (x["record_type"], x["payload_bytes"], x["stored_bytes"], x["refers_to"]) for x in _all(W.write_archives(pages, archive_bytes=2000))}
    assert got == {1: ("revisit", 60_000, 0, 3), 2: ("response", 1, 1, None), 3: ("response", 60_000, 60_000, None)}


def test_empty_table(spark):
    assert _all(W.write_archives(spark.createDataFrame([], PAGE))) == []
