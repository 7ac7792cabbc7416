import random

import pytest
from pyspark.sql import functions as F

from coursegrain.operators import fuzzy as Z
from coursegrain.operators import retrieval as R
from coursegrain.plans import corpus as C


def _ratio(a, b):
    """By the table of common subsequences."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return 200.0 * row[-1] / (len(a) + len(b))


def _edited(r, s, n):
    for _ in range(n):
        i = r.randint(0, len(s))
        s = s[:i] + r.choice("abcdeé ") + s[i:] if r.random() < 0.5 else s[:i] + s[i + 1 :]
    return s


def _texts(r, alphabet):
    out = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 60]))) for _ in range(60)]
    return sorted(set(out + [_edited(r, r.choice(out), r.randint(1, 6)) for _ in range(60)]))


@pytest.mark.parametrize("threshold", [85.0, 70.0, 40.0])
def test_all_near_pairs_are_found(spark, threshold):
    r = random.Random(int(threshold))
    for alphabet in ("abcdefghijklmnopq rstuvé", "ab"):
        left, right = _texts(r, alphabet), _texts(r, alphabet)
        want = {(a, b): round(_ratio(a, b), 9) for a in left for b in right if _ratio(a, b) >= threshold}
        rows = lambda s: spark.createDataFrame([("c", x) for x in s] + [("other", "zzzz")], "course_id string, s string")
        got = {(x["a"], x["b"]): round(x["ratio"], 9) for x in Z.near_texts(rows(left), rows(right), threshold).filter("course_id = 'c'").collect()}
        assert got == want


def test_candidates_are_far_fewer_than_pairs(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(900)]
    names = sorted({" ".join(r.sample(words, 3)) for _ in range(800)})
    asked = sorted({_edited(r, r.choice(names), r.randint(0, 3)) for _ in range(400)})
    rows = lambda s: spark.createDataFrame([("c", x) for x in s], "course_id string, s string")
    pairs = Z.candidate_pairs(rows(asked), rows(names), 85.0).count()
    assert len(asked) * 0.9 <= pairs < len(asked) * len(names) / 50


def test_matches_by_course_and_case(spark):
    q = spark.createDataFrame([(1, "a", "Horizontal fragmentatoin"), (2, "a", "HORIZONTAL FRAGMENTATION"), (3, "b", "horizontal fragmentation"), (4, "a", None), (5, None, "x"), (6, "a", ""), (7, "a", "x")], "query_id int, course_id string, text string")
    t = spark.createDataFrame([(10, "a", "Horizontal Fragmentation"), (11, "a", "Vertical Fragmentation"), (12, "a", None), (13, None, "x"), (14, "a", ""), (15, "a", "X")], "topic_id int, course_id string, name string")
    got = sorted((r["query_id"], r["topic_id"], round(r["ratio"], 6)) for r in R.fuzzy_topics(q, t).collect())
    assert got == [(1, 10, round(_ratio("horizontal fragmentatoin", "horizontal fragmentation"), 6)), (2, 10, 100.0), (6, 14, 100.0), (7, 15, 100.0)]
    assert R.fuzzy_topics(q.limit(0), t).count() == 0 and R.fuzzy_topics(q, t.limit(0)).count() == 0


def test_no_pair_for_each_query_and_topic(spark):
    """Every row whose id is divisible by 20: texts meet once, however many queries have them."""
    q, t = C._requests(spark, "/root/testdata/sf0.01"), C._topics(spark, "/root/testdata/sf0.01")
    met = Z.candidate_pairs(Z.distinct_texts(q, "text"), Z.distinct_texts(t, "name"), 85.0).count()
    assert met < q.join(t, "course_id").count() / 2
    assert q.filter(F.length("text") > 0).count() > 0
