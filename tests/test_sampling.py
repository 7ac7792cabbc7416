import random

from pyspark.sql import functions as F

from coursegrain.operators import sampling as S
from coursegrain.sources import views as V

SF = "/root/testdata/sf0.001"


def _allocate(spark, weights, caps, n):
    rows = [("r", f"t{i}", float(w), int(c), n) for i, (w, c) in enumerate(zip(weights, caps))]
    t = spark.createDataFrame(rows, "request_id string, topic_id string, weight double, chunk_count int, n int")
    got = {r["topic_id"]: r["allocated"] for r in S.allocate_capped(S.allocate_quota(t)).collect()}
    return [got.get(f"t{i}", 0) for i in range(len(weights))]


def _by_hand(weights, caps, n):
    """Largest remainder, then surplus units one at a time."""
    live = [i for i, c in enumerate(caps) if c > 0]
    out = dict.fromkeys(range(len(caps)), 0)
    if not live:
        return list(out.values())
    first = 1 if n >= len(live) else 0
    rest, total = n - first * len(live), sum(weights[i] for i in live)
    exact = {i: round(rest * weights[i] / total, 9) for i in live}
    quota = {i: first + int(exact[i]) for i in live}
    order = sorted(live, key=lambda i: (-round(exact[i] - int(exact[i]), 9), -weights[i], f"t{i}"))
    for i in order[: rest - sum(int(exact[i]) for i in live)]:
        quota[i] += 1
    surplus = 0
    for i in live:
        out[i] = min(quota[i], caps[i])
        surplus += quota[i] - out[i]
    while surplus and any(out[i] < caps[i] for i in live):
        for i in sorted(live, key=lambda i: (-weights[i], f"t{i}")):
            if surplus and out[i] < caps[i]:
                out[i] += 1
                surplus -= 1
    return list(out.values())


def test_allocation_cases(spark):
    assert _allocate(spark, [1, 1], [1, 20], 10) == [1, 9]
    assert sum(_allocate(spark, [1, 1], [2, 3], 50)) == 5
    assert all(x >= 1 for x in _allocate(spark, [9, 1, 1], [20, 20, 20], 3))
    assert sum(_allocate(spark, [1] * 5, [20] * 5, 13)) == 13
    assert _allocate(spark, [1, 1], [0, 5], 3) == [0, 3]


def test_allocation_is_the_loop(spark):
    r = random.Random(3)
    for _ in range(6):
        k = r.randint(1, 7)
        weights = [r.choice([1, 2, 3, 0.5, 7.25]) for _ in range(k)]
        caps = [r.randint(0, 9) for _ in range(k)]
        n = r.randint(1, 40)
        assert _allocate(spark, weights, caps, n) == _by_hand(weights, caps, n)


def test_a_large_request_needs_no_row_for_each_unit(spark):
    """10 ** 8 passages: two topics fill up, the others share what is over evenly."""
    m = 10**8
    got = _allocate(spark, [50, 30, 1, 1, 2], [10, 1000, 4 * m, 4 * m, 4 * m], m)
    assert got[:2] == [10, 1000] and sum(got) == m and abs(got[2] - got[3]) <= 1
    assert _allocate(spark, [9, 1], [3, 2], m) == [3, 2]


def test_sample_does_not_depend_on_partitions(spark):
    chunks = V.chunks(spark, SF).drop("text")
    none = F.array().cast("array<string>")
    reqs = chunks.select("course_id").distinct().select(F.col("course_id").alias("request_id"), "course_id", F.lit(6).alias("n"), none.alias("topic_ids"), F.array().cast("array<long>").alias("document_ids"))
    m = spark.createDataFrame([], "course_id string, topic_id string, accuracy double")
    one = {tuple(r) for r in S.sample_chunks(chunks, reqs, m, 1).collect()}
    two = {tuple(r) for r in S.sample_chunks(chunks.repartition(13), reqs, m, 1).collect()}
    assert one == two and one != {tuple(r) for r in S.sample_chunks(chunks, reqs, m, 2).collect()}


def test_consecutive_samples_cover_more(spark):
    chunks = V.chunks(spark, SF).drop("text", "section_path")
    none = F.array().cast("array<string>")
    reqs = chunks.filter("course_id = 'src0'").select("course_id").distinct().select(F.lit("q").alias("request_id"), "course_id", F.lit(4).alias("n"), none.alias("topic_ids"), F.array().cast("array<long>").alias("document_ids"))
    m = spark.createDataFrame([], "course_id string, topic_id string, accuracy double")
    rounds = sorted(S.coverage_rounds(chunks, reqs, m, 3).collect(), key=lambda r: r["round"])
    assert [r["chunks_covered"] for r in rounds] == sorted(r["chunks_covered"] for r in rounds)
    assert rounds[-1]["able_topic_coverage"] >= 0.9
