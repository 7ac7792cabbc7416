"""Coverage sampling: every topic in scope is represented, within its capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Tunables
from ..sources.tables import written


def in_scope(chunks: DataFrame, requests: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """Passages of each request: its course, long enough, with a topic, and within its lists.

    requests has request_id, course_id, n and the arrays topic_ids and document_ids; an empty
    or null list restricts nothing."""
    usable = chunks.filter((F.col("token_count") >= t.min_tokens_for_generation) & F.col("topic_id").isNotNull())
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0  # noqa: E731  size(null) is -1 or null
    j = usable.join(requests, "course_id")
    j = j.filter((free("topic_ids") | F.array_contains("topic_ids", F.col("topic_id"))) & (free("document_ids") | F.array_contains("document_ids", F.col("document_id"))))
    return j.drop("topic_ids", "document_ids")


def topic_stats(scoped: DataFrame, mastery: DataFrame) -> DataFrame:
    """request_id, topic_id, n, chunk_count, mean_usage, accuracy (null where never answered)."""
    s = scoped.groupBy("request_id", "course_id", "topic_id", "n").agg(F.count(F.lit(1)).alias("chunk_count"), F.avg("usage").alias("mean_usage"))
    return s.join(mastery.select("course_id", "topic_id", "accuracy"), ["course_id", "topic_id"], "left")


def topic_weights(stats: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """weight = share of passages * freshness * weakness."""
    size = F.col("chunk_count") / F.sum("chunk_count").over(Window.partitionBy("request_id"))
    freshness = F.lit(1.0) / (F.lit(1.0) + F.col("mean_usage"))
    weakness = F.when(F.col("accuracy").isNull(), F.lit(1.0)).otherwise(F.least(F.lit(2.0) - F.col("accuracy"), F.lit(t.weakness_cap)))
    return stats.withColumn("weight", F.round(size * freshness * weakness, 12))


def allocate_quota(topics: DataFrame, capacity: Column | None = None) -> DataFrame:
    """Largest-remainder shares of n by weight, one for each topic first where n allows.

    topics has request_id, topic_id, weight, n; topics of capacity 0 get nothing."""
    cap = F.col("chunk_count") if capacity is None else capacity
    own = Window.partitionBy("request_id")
    d = topics.withColumn("capacity", cap.cast("long")).filter("capacity > 0")
    first = F.when(F.col("n") >= F.count(F.lit(1)).over(own), 1).otherwise(0)
    d = d.withColumn("first", first).withColumn("rest", F.col("n") - F.sum("first").over(own))
    d = d.withColumn("exact", F.round(F.col("rest") * F.col("weight") / F.sum("weight").over(own), 9))
    d = d.withColumn("whole", F.floor("exact")).withColumn("remainder", F.round(F.col("exact") - F.col("whole"), 9))
    order = own.orderBy(F.desc("remainder"), F.desc("weight"), "topic_id")
    d = d.withColumn("left_over", F.col("rest") - F.sum("whole").over(own)).withColumn("nth", F.row_number().over(order))
    quota = F.col("first") + F.col("whole") + (F.col("nth") <= F.col("left_over")).cast("int")
    return d.withColumn("quota", quota.cast("long")).drop("first", "rest", "exact", "whole", "remainder", "left_over", "nth")


def allocate_capped(quotas: DataFrame) -> DataFrame:
    """quota cut to capacity; what is over goes round by weight, one at a time, to who has room.

    No loop, and no row for a unit: the surplus rises like water over the topics' room. After
    level full rounds every topic has got level units or is full. The level is found from the
    rooms in ascending order and their running sums: where i of m topics are full, the others
    share what is left of the surplus evenly. What doesn't make a full round goes to the first
    topics by weight that still have room."""
    own = Window.partitionBy("request_id")
    d = quotas.withColumn("taken", F.least("quota", "capacity"))
    d = d.withColumn("slack", F.col("capacity") - F.col("taken")).withColumn("surplus", F.sum(F.col("quota") - F.col("taken")).over(own))
    up = own.orderBy("slack", "topic_id")
    before = F.coalesce(F.sum("slack").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.count(F.lit(1)).over(own) - F.row_number().over(up) + 1
    # With the smaller rooms full, this topic and those above would be at this height.
    height = F.floor((F.col("surplus") - before) / above)
    d = d.withColumn("height", height).withColumn("level", F.max(F.when(F.col("slack") > F.col("height"), F.col("height"))).over(own))
    # No topic with more room than that: the surplus fills all of them.
    d = d.withColumn("level", F.greatest(F.coalesce("level", F.max("slack").over(own)), F.lit(0)))
    d = d.withColumn("extra", F.least("slack", "level")).withColumn("over", F.col("surplus") - F.sum("extra").over(own))
    room = F.col("slack") > F.col("level")
    nth = F.row_number().over(own.orderBy(room.desc(), F.desc("weight"), "topic_id"))
    one = (room & (nth <= F.col("over"))).cast("long")
    return d.withColumn("allocated", F.col("taken") + F.col("extra") + one).drop("taken", "slack", "surplus", "height", "level", "extra", "over")


def pick(scoped: DataFrame, allocation: DataFrame, seed: Column) -> DataFrame:
    """The allocated passages of each topic: least used first, then by a seeded hash."""
    d = scoped.join(allocation.select("request_id", "topic_id", "allocated"), ["request_id", "topic_id"])
    tie = F.md5(F.concat_ws("|", seed.cast("string"), F.col("chunk_id").cast("string")).cast("binary"))
    order = Window.partitionBy("request_id", "topic_id").orderBy("usage", tie, "chunk_id")
    return d.withColumn("rank_in_topic", F.row_number().over(order)).filter(F.col("rank_in_topic") <= F.col("allocated"))


def allocation_for(scoped: DataFrame, mastery: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    return allocate_capped(allocate_quota(topic_weights(topic_stats(scoped, mastery), t)))


def sample_chunks(chunks: DataFrame, requests: DataFrame, mastery: DataFrame, seed: int = 7, t: Tunables = DEFAULTS) -> DataFrame:
    """request_id, topic_id, chunk_id, rank_in_topic of the passages each request gets."""
    scoped = in_scope(chunks, requests, t)
    return pick(scoped, allocation_for(scoped, mastery, t), F.lit(seed)).select("request_id", "topic_id", "chunk_id", "rank_in_topic")


def sampling_report(scoped: DataFrame, allocation: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request asked for and got, and why it got less."""
    scope = scoped.groupBy("request_id").agg(F.count(F.lit(1)).alias("in_scope"), F.countDistinct("topic_id").alias("topics_in_scope"))
    got = allocation.groupBy("request_id").agg(F.sum("allocated").alias("delivered"), F.count_if(F.col("allocated") > 0).alias("topics_covered"))
    r = requests.select("request_id", F.col("n").alias("requested")).join(scope, "request_id", "left").join(got, "request_id", "left").na.fill(0)
    reason = F.when(F.col("in_scope") == 0, "no passage in scope").when(F.col("delivered") < F.col("requested"), "scope smaller than request")
    coverage = F.when(F.col("topics_in_scope") == 0, 0.0).otherwise(F.round(F.col("topics_covered") / F.col("topics_in_scope"), 6))
    return r.withColumn("coverage", coverage).withColumn("shortfall", reason)


def coverage_rounds(chunks: DataFrame, requests: DataFrame, mastery: DataFrame, rounds: int = 5, t: Tunables = DEFAULTS) -> DataFrame:
    """round, request_id, topics, chunks, and both coverages so far, over consecutive samples.

    Round i is drawn with seed i, and what it took counts as used in the next one; nothing is
    stored back. Scopes, accuracies and counts are taken once. From then on the topics' usage
    follows by what a round has added to it, passages that no round took keep theirs, and only
    topics that get passages are ranked. The denominators are the course's topics and passages
    that can be asked for, and all of them."""
    able = F.col("token_count") >= t.min_tokens_for_generation
    slim = written(chunks.select("chunk_id", "document_id", "course_id", "topic_id", "token_count", "usage"), "passages")
    scoped = written(in_scope(slim, requests, t).select("request_id", "course_id", "topic_id", "chunk_id", "usage", "n"), "scopes")
    stats = scoped.groupBy("request_id", "course_id", "topic_id", "n").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("usage").alias("used"))
    stats = written(stats.join(mastery.select("course_id", "topic_id", "accuracy"), ["course_id", "topic_id"], "left"), "topic-stats")
    seen = None
    for i in range(rounds):
        weights = topic_weights(stats.withColumn("mean_usage", F.col("used") / F.col("chunk_count")), t)
        allocation = allocate_capped(allocate_quota(weights)).filter("allocated > 0")
        now = scoped
        if seen is not None:
            taken = seen.groupBy("chunk_id").agg(F.count(F.lit(1)).cast("int").alias("more"))
            now = scoped.join(taken, "chunk_id", "left").withColumn("usage", F.col("usage") + F.coalesce("more", F.lit(0))).drop("more")
        got = written(pick(now, allocation, F.lit(i)).select("request_id", "topic_id", "chunk_id", F.lit(i).alias("round")), "round")
        seen = got if seen is None else seen.unionByName(got)
        # A passage that one request took is used for every request that has it in scope.
        delta = scoped.join(got.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("more")), "chunk_id").groupBy("request_id", "topic_id").agg(F.sum("more").alias("more"))
        stats = written(stats.join(delta, ["request_id", "topic_id"], "left").withColumn("used", F.col("used") + F.coalesce("more", F.lit(0))).drop("more"), "topic-stats")
    return _coverages(seen, slim, requests, rounds, able)


def _coverages(seen: DataFrame, chunks: DataFrame, requests: DataFrame, rounds: int, able: Column) -> DataFrame:
    """The figures of each round: what came up in it or before, by the round of each first time."""
    new = lambda what, name: seen.groupBy("request_id", what).agg(F.min("round").alias("first")).groupBy("request_id", "first").agg(F.count(F.lit(1)).alias(name))
    first = seen.groupBy("request_id").agg(F.min("round").alias("begins")).withColumn("round", F.explode(F.sequence(F.col("begins"), F.lit(rounds - 1)))).drop("begins")
    out = first.join(seen.groupBy("request_id", "round").agg(F.countDistinct("topic_id").alias("topics_in_round")), ["request_id", "round"], "left")
    for what, name in (("topic_id", "topics_covered"), ("chunk_id", "chunks_covered")):
        upto = first.join(new(what, name), "request_id").filter(F.col("first") <= F.col("round")).groupBy("request_id", "round").agg(F.sum(name).alias(name))
        out = out.join(upto, ["request_id", "round"])
    total = chunks.groupBy("course_id").agg(F.countDistinct("topic_id").alias("topics"), F.count(F.lit(1)).alias("chunks"), F.countDistinct(F.when(able, F.col("topic_id"))).alias("able_topics"), F.count_if(able).alias("able_chunks"))
    d = out.join(requests.select("request_id", "course_id"), "request_id").join(total, "course_id")
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 6)
    return d.select(
        "round", "request_id", "topics_in_round", "topics_covered", "chunks_covered",
        share("topics_covered", "topics").alias("topic_coverage"), share("chunks_covered", "chunks").alias("chunk_coverage"),
        share("topics_covered", "able_topics").alias("able_topic_coverage"), share("chunks_covered", "able_chunks").alias("able_chunk_coverage"),
    )
