"""Streams of answers and reviews: mastery, cards of missed questions, schedules.

State can be rebuilt from the log of events, so a stream and a batch over the same events end
with the same tables. Inputs may come twice and out of order: answers are deduplicated within
the watermark, reviews are put in order within it, and every effect is keyed by what it stands
for and by its batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import learning as L
from ..operators.scheduling import REPLAYED, Card, review
from .tables import BatchTable

LATENESS = "1 day"
SUMS = "course_id string, topic_id string, attempts long, correct long, last_practised timestamp"


def once(answers: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """answers with answered_at as a timestamp, each answer_id once within the lateness."""
    timed = answers.withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    return timed.withWatermark("answered_at", lateness).dropDuplicatesWithinWatermark(["answer_id"])


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("course_id", "topic_id").agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct"), F.max("last_practised").alias("last_practised"))


def mastery_table(path: str) -> BatchTable:
    return BatchTable(path, SUMS, _summed)


def mastery_stream(answers: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS):
    """Starts the query that keeps the sums of each batch in the table at path.

    A batch that is run again replaces its own sums, so its answers count once; mastery_of adds
    the batches up."""
    table = mastery_table(path)

    def save(batch: DataFrame, batch_id: int) -> None:
        sums = batch.filter(F.col("topic_id").isNotNull()).groupBy("course_id", "topic_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("is_correct").alias("correct"), F.max("answered_at").alias("last_practised"))
        table.write(sums, batch_id)

    return once(answers, lateness).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mastery_of(spark, path: str) -> DataFrame:
    return _summed(mastery_table(path).read(spark)).withColumn("accuracy", F.col("correct") / F.col("attempts"))


def cards_table(path: str, schema: str) -> BatchTable:
    """Cards of earlier batches are never written again, so batches are merged as they are."""
    return BatchTable(path, schema, lambda cards: cards)


def missed_cards_stream(answers: DataFrame, questions: DataFrame, path: str, checkpoint: str, lateness: str = LATENESS):
    """Starts the query that promotes wrongly answered questions to cards, each card once.

    A card's id is a hash of its course and front; cards of earlier batches are left out."""

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        none = spark.createDataFrame([], "course_id string, front string")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in L.missed_cards(batch, questions, none).schema)
        table = cards_table(path, schema)
        old = table.read(spark, before=batch_id).select("course_id", "front")
        table.write(L.missed_cards(batch, questions, old), batch_id)

    return once(answers, lateness).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "stability double, difficulty double, state string, lapses int, last double, due double, settled int, times array<long>, ids array<long>, ratings array<int>"


def schedule_stream(reviews: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The state of each card after each batch of its reviews (card_id, review_id, rating, reviewed_at).

    Reviews that come late, up to the lateness, take the place that their time gives them: a
    card's reviews after the watermark are kept beside the state that those before it have led
    to, and its schedule is replayed from there. When the watermark passes a review, by a timer
    if no other comes, it becomes part of that state. A review_id counts once; later repeats of
    settled reviews are older than the watermark, as are all that come later than the lateness,
    and Spark leaves these out. Reviews without a card, a rating or a time are left out, too."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        card, settled, waiting = Card(), 0, []
        if state.exists:
            *parts, settled, times, ids, ratings = state.get
            card = Card(*parts)
            waiting = list(zip(times, ids, ratings))
        new = 0
        if not state.hasTimedOut:
            known = {i for _, i, _ in waiting}
            for rows in batches:
                for at, i, rating in zip(rows["reviewed_at"], rows["review_id"], rows["rating"]):
                    if i not in known:
                        known.add(i)
                        waiting.append((at.value // 1000, int(i), int(rating)))
                        new += 1
        waiting.sort()
        past = state.getCurrentWatermarkMs() * 1000
        n = sum(at <= past for at, *_ in waiting)
        for at, _, rating in waiting[:n]:
            card, settled = review(card, rating, at / 1e6), settled + 1
        waiting = waiting[n:]
        times, ids, ratings = ([w[j] for w in waiting] for j in range(3))
        state.update((card.stability, card.difficulty, card.state, card.lapses, card.last, card.due, settled, times, ids, ratings))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, past // 1000) + 1)
        if new:
            for at, _, rating in waiting:
                card = review(card, rating, at / 1e6)
            spots = [pd.Timestamp(round(x * 1e6), unit="us") for x in (card.last, card.due)]
            yield pd.DataFrame([[key[0], settled + len(waiting), card.stability, card.difficulty, card.state, card.lapses, *spots]], columns=[x.split()[0] for x in REPLAYED.split(", ")])

    rows = reviews.select("card_id", "review_id", "rating", reviews["reviewed_at"].cast("timestamp").alias("reviewed_at")).dropna()
    return rows.withWatermark("reviewed_at", lateness).groupBy("card_id").applyInPandasWithState(fold, REPLAYED, STATE, "update", GroupStateTimeout.EventTimeTimeout)
