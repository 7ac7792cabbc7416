import hashlib
import random

from coursegrain.llm import secrets as S

DOC = "doc_id long, text string, start long, kind string"
WORD_CHARS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _assigns(t):
    """Leftmost, non-overlapping, letter by letter."""
    low, out, i = _lower(t), [], 0
    while i < len(t):
        hit = None
        for label in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(label, i):
                j = i + len(label)
                j += j < len(t) and t[j] in "\"'"
                while j < len(t) and t[j] == " ":
                    j += 1
                if j < len(t) and t[j] in ":=":
                    j += 1
                    while j < len(t) and t[j] == " ":
                        j += 1
                    j += j < len(t) and t[j] in "\"'"
                    k = j
                    while k < len(t) and (t[k] in WORD_CHARS or t[k] in "+/_.=-"):
                        k += 1
                    if k > j:
                        hit = (i, k, k - j)
                        break
        if hit:
            if hit[2] >= 8:
                out.append((hit[0], hit[1]))
            i = hit[1]
        else:
            i += 1
    return out


def _runs(t, start, chars, least):
    out, i = [], 0
    while i < len(t):
        if t.startswith(start, i) and i + len(start) < len(t) + (not start):
            k = i + len(start)
            while k < len(t) and t[k] in chars:
                k += 1
            if k > i + len(start):
                if k - i >= least:
                    out.append((i, k))
                i = k
                continue
        i += 1
    return out


def _base(t):
    found = [(s, e, 0) for s, e in _assigns(t)]
    found += [(s, e, 1) for s, e in _runs(t, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16)]
    found += [(s, e, 2) for s, e in _runs(t, "", set("0123456789abcdef"), 32)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def _linked(t, span=S.SPAN):
    """Weak parts by comparing every two parts of a scope."""
    parts = [(*p, S.ROLES[S.KINDS[p[2]]]) for p in S.parts_of(t)]
    out = []
    for s, e, kind, scope, role in parts:
        if kind >= S.BASE:
            near = {r for s2, e2, _, scope2, r in parts if scope2 == scope and s2 <= e + span and e2 >= s - span}
            need = {"secret": {"identifier"}, "identifier": {"secret"}, "endpoint": {"secret", "identifier"}}[role]
            if need <= near:
                out.append((s, e, kind))
    return out


def _listed(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _check(spark, texts, parts=3):
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], DOC).repartition(parts)
    got = {r["doc_id"]: r for r in S.secret_spans(docs).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        base, linked = _base(t or ""), _linked(t or "")
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for *_, k in base) for x in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(_listed(base).encode()).hexdigest(), t
        assert r["spans"] == _listed(base + linked), t
        assert r["n_linked"] == len(linked)
    return got


PIECES = [
    'password = "hunter22-or-so"', "PASSWD:abc", "Secret  =  'aGVsbG8gd29ybGQ='", "api_key=" + "x" * 8, "APIKEY: " + "y" * 7, "token'='tok.en/value", "tokén = abcdefghij", "toKen = abcdefghij",
    "AKIA" + "Z9" * 6, "AKIA" + "Q" * 11, "AKIA" + "Q" * 4, "AKIAAKIAAKIAAKIA", "0123456789abcdef" * 2, "0123456789abcdef" * 3 + "g", "deadbeef" * 3, "é" + "f0" * 17,
    "user = admin_7", "username: 'jo.smith@x.org'", "client_id=4477aa", "pwd = s3cr3t!!", "passphrase: correct-horse", "Zx81aB9dE7fQ2mN4pL6s", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLE0key", "abcdefghijklmnopqrstuvwxyz",
    "https://db.internal:5432", "host = db.example.com:3306", "postgres://u:p@h.example.org", "plain words stand here", "secret:", "= : ''", "Paßwort: geheim123", "x" * 260, "\n\n", "\n \n", "\n", "é" * 30,
]


def test_matches_the_rules_letter_by_letter(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(PIECES) + r.choice(["", " ", " ", ", ", "\n"]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    got = _check(spark, [*texts, None, "", *PIECES])
    assert sum(r["n_linked"] > 0 for r in got.values()) > 50


def test_weak_parts_need_their_complements_in_scope(spark):
    lone = ["user = admin_7 and nothing else", "pwd = s3cr3t!!", "https://db.internal:5432 is a host", "user = admin_7\n\npwd = s3cr3t!!", "user = admin_7 " + "x " * 120 + "pwd = s3cr3t!!", "https://db.internal:5432 user = admin_7"]
    got = _check(spark, lone)
    assert all(r["spans"] == "" for r in got.values())
    both = _check(spark, ["user = admin_7\npwd = s3cr3t!! at https://db.internal:5432", "key_id = 998 token = abcdefgh"])
    assert both[0]["spans"] == "identifier:0:14,secret:15:29,endpoint:33:57"
    assert both[1]["spans"] == "identifier:0:12,assign:13:29"


def test_distances_at_the_edges_of_cells(spark):
    texts = ["." * pad + "user = admin_7" + " " * gap + "pwd = s3cr3t!!" for pad in (0, 1, 150, 186, 187, 199, 200) for gap in (1, 2, 185, 199, 200, 201, 202)]
    got = _check(spark, texts)
    assert [bool(r["n_linked"]) for _, r in sorted(got.items())] == [gap <= S.SPAN for _ in range(7) for gap in (1, 2, 185, 199, 200, 201, 202)]


def test_many_parts_in_one_document(spark):
    _check(spark, ["user = admin_7 pwd = s3cr3t!! " * 1500, " ".join(["deadbeef" * 4] * 1000)])


def test_repeated_rows_null_ids_and_nothing(spark):
    t = 'user = admin_7 token = "abcdefghij"'
    docs = spark.createDataFrame([(1, t, 0, ""), (1, t, 0, ""), (None, t, 0, ""), (None, None, None, None)], DOC)
    got = sorted((str(r["doc_id"]), r["spans"]) for r in S.secret_spans(docs).collect())
    spans = "identifier:0:14,assign:15:34"
    assert got == [("1", spans), ("1", spans), ("None", ""), ("None", spans)]
    assert S.secret_spans(docs.limit(0)).count() == 0
