"""Spaced repetition: stability, difficulty and the next due time of each card.

The published FSRS description (version 5), without fuzz; weights are configuration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS

# The published default weights.
WEIGHTS = (
    0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192,
    1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621,
)
DECAY, FACTOR = -0.5, 19 / 81
DAY = 86400.0


@dataclass
class Card:
    stability: float = 0.0
    difficulty: float = 0.0
    state: str = "new"
    lapses: int = 0
    last: float = 0.0
    due: float = 0.0


def _bounded(d: float) -> float:
    return min(10.0, max(1.0, d))


def _first_difficulty(rating: int, w=WEIGHTS) -> float:
    return w[4] - math.exp(w[5] * (rating - 1)) + 1


def review(card: Card, rating: int, at: float, retention: float = DEFAULTS.desired_retention, w=WEIGHTS) -> Card:
    """The card after a review (1 again, 2 hard, 3 good, 4 easy) at a time in seconds."""
    if card.state == "new":
        s, d = w[rating - 1], _bounded(_first_difficulty(rating))
    else:
        days = max(0.0, (at - card.last) / DAY)
        recall = (1 + FACTOR * days / card.stability) ** DECAY
        change = -w[6] * (rating - 3)
        d = _bounded(w[7] * _first_difficulty(4) + (1 - w[7]) * (card.difficulty + change * (10 - card.difficulty) / 9))
        if days < 1:
            s = card.stability * math.exp(w[17] * (rating - 3 + w[18]))
        elif rating == 1:
            s = min(card.stability, w[11] * card.difficulty ** -w[12] * ((card.stability + 1) ** w[13] - 1) * math.exp(w[14] * (1 - recall)))
        else:
            grow = math.exp(w[8]) * (11 - card.difficulty) * card.stability ** -w[9] * (math.exp(w[10] * (1 - recall)) - 1)
            s = card.stability * (1 + grow * (w[15] if rating == 2 else 1) * (w[16] if rating == 4 else 1))
    s = max(0.01, s)
    days = max(1, min(36500, round(s / FACTOR * (retention ** (1 / DECAY) - 1))))
    lapse = rating == 1 and card.state == "review"
    state = ("relearning" if lapse or card.state == "relearning" else "learning") if rating == 1 else "review"
    return Card(s, d, state, card.lapses + lapse, at, at + days * DAY)


REPLAYED = "card_id long, reviews int, stability double, difficulty double, state string, lapses int, last_review timestamp, due_at timestamp"


def schedule_replay(reviews: DataFrame, retention: float = DEFAULTS.desired_retention) -> DataFrame:
    """The state of each card after its reviews in order of time and id; a review_id counts once.

    Cards lie in order within partitions, which are streamed over: only the open card's state is
    held. Of a review_id that is there more than once, the earliest counts."""
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC")]
    names = [x.split()[0] for x in REPLAYED.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n, card, out = (), 0, Card(), []

        def row():
            return (*open_, n, card.stability, card.difficulty, card.state, card.lapses, round(card.last * 1e6), round(card.due * 1e6))

        def batch():
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=names)

        for b in batches:
            for card_id, at, rating in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if (card_id,) != open_:
                    if open_:
                        out.append(row())
                    open_, n, card = (card_id,), 0, Card()
                card, n = review(card, rating, at / 1e6, retention), n + 1
            yield batch()
            out.clear()
        if open_:
            out.append(row())
        yield batch()

    at = F.unix_micros(reviews["reviewed_at"].cast("timestamp"))
    rows = reviews.select("card_id", "review_id", F.col("rating").cast("int").alias("rating"), at.alias("at"))
    n = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One shuffle: rows of a card meet, so those of a review do.
    first = rows.repartition(n, "card_id").groupBy("card_id", "review_id").agg(F.min(F.struct("at", "rating")).alias("r"))
    rows = first.select("card_id", F.col("r.at").alias("at"), "review_id", F.col("r.rating").alias("rating"))
    return rows.sortWithinPartitions("card_id", "at", "review_id").mapInArrow(fold, REPLAYED)
