import datetime as dt
import sys
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coursegrain.operators import learning as L
from coursegrain.operators import scheduling as H
from coursegrain.plans import questions as Q
from coursegrain.sources import views as V
from coursegrain.streaming import events as S
from coursegrain.streaming.tables import BatchTable

SF = "/root/testdata/sf0.001"


def _files(df, path, n=3):
    """df as n files, read one by one by the stream."""
    df.repartition(n).write.parquet(path)
    return path


def test_mastery_stream_is_the_batch(spark, tmp_path):
    a = V.answers(spark, SF)
    src = _files(a.unionByName(a.limit(50)), str(tmp_path / "in"))  # some answers come twice
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.mastery_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "400 days").awaitTermination(120)
    got = {(r["course_id"], r["topic_id"]): (r["attempts"], r["correct"]) for r in S.mastery_of(spark, str(tmp_path / "out")).collect()}
    want = {(r["course_id"], r["topic_id"]): (r["attempts"], r["correct"]) for r in L.mastery(a).collect()}
    assert got == want


def test_missed_cards_stream_is_the_batch(spark, tmp_path):
    a = V.answers(spark, SF)
    a = a.withColumn("question_id", a["question_id"].cast("long"))
    q = Q.mcq(spark, SF)
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(_files(a, str(tmp_path / "in")))
    S.missed_cards_stream(stream, q, str(tmp_path / "out"), str(tmp_path / "ck"), "400 days").awaitTermination(120)
    none = spark.createDataFrame([], "course_id string, front string")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in L.missed_cards(a, q, none).schema)
    got = [r["card_id"] for r in S.cards_table(str(tmp_path / "out"), schema).read(spark).collect()]
    assert len(got) == len(set(got)) and set(got) == {r["card_id"] for r in L.missed_cards(a, q, none).collect()}


def _schedules(spark, src, schema, tmp_path, lateness):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.schedule_stream(stream, lateness).writeStream.outputMode("update").format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    # The memory sink keeps every update; the last one of a card has the most reviews, or comes later with as many.
    return spark.sql("select *, monotonically_increasing_id() as at from cards").toPandas().sort_values("at").groupby("card_id", as_index=False).last().drop(columns="at")


def test_a_shuffled_stream_with_repeats_ends_as_the_batch(spark, tmp_path):
    r = V.reviews(spark, SF)
    mixed = r.unionByName(r.filter("review_id % 3 = 0")).orderBy(F.xxhash64("review_id", F.rand(3)))
    src = _files(mixed, str(tmp_path / "in"), 4)
    got = _schedules(spark, src, r.schema, tmp_path, "400 days").sort_values("card_id").reset_index(drop=True)
    want = H.schedule_replay(r).toPandas().sort_values("card_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(want.columns)], want)


def test_reviews_settle_behind_the_watermark(spark, tmp_path):
    """A batch each: late within the day, a repeat of a settled one, one later than a day, and the rest."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    batches = [[(1, 10, 3, day(1)), (2, 90, 3, day(1))], [(1, 12, 4, day(3)), (2, 91, 3, day(4))], [(1, 11, 1, day(3, -12 % 24))], [(1, 10, 3, day(1)), (1, 13, 2, day(2))], [(1, 14, 3, day(9)), (1, 12, 4, day(3))]]
    schema = "card_id long, review_id long, rating int, reviewed_at timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    got = _schedules(spark, str(tmp_path / "in"), schema, tmp_path, "1 day")
    kept = [x for b in batches for x in b if x[1] != 13]
    want = H.schedule_replay(spark.createDataFrame(kept, schema)).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("card_id").reset_index(drop=True)[list(want.columns)], want.sort_values("card_id").reset_index(drop=True))


def _table(path, every=5):
    return BatchTable(path, "k string, n long", lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), every)


def test_folders_stay_few_and_sums_right_over_many_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    most = 0
    for i in range(60):
        _table(path).write(spark.createDataFrame([("a", i), (f"b{i % 3}", 1)], "k string, n long").coalesce(1), i)
        most = max(most, len(_table(path).folders(spark)))
    got = {r["k"]: r["n"] for r in _table(path).read(spark).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert got == {"a": sum(range(60)), "b0": 20, "b1": 20, "b2": 20} and most <= 4 * 5
    before = _table(path).read(spark, before=59).filter("k = 'a'").agg(F.sum("n")).first()[0]
    assert before == sum(range(59))


def test_a_restart_trusts_the_manifest_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda i: spark.createDataFrame([("a", 10**i)], "k string, n long").coalesce(1)
    total = lambda: _table(path).read(spark).agg(F.sum("n")).first()[0]
    for i in range(5):
        _table(path).write(rows(i), i)
    # The job dies after the base is written and before the manifest is.
    fs = BatchTable._fs

    def dies(self, s):
        if sys._getframe(1).f_code.co_name == "_compact":
            raise OSError("gone")
        return fs(self, s)

    monkeypatch.setattr(BatchTable, "_fs", dies)
    with pytest.raises(OSError):
        _table(path).write(rows(5), 5)
    assert any(n.startswith("base-") for n in _table(path).folders(spark)) and total() == 111111
    monkeypatch.setattr(BatchTable, "_fs", fs)
    _table(path).write(rows(5), 5)  # the batch runs again
    assert total() == 111111 and any(n.startswith("manifest-") for n in _table(path).folders(spark))
    _table(path).write(rows(5), 5)  # and once more: its folder is replaced
    assert total() == 111111


def test_intervals_grow_with_the_rating():
    for start in (H.Card(), H.review(H.Card(), 3, 0.0)):
        due = [H.review(start, rating, 5 * H.DAY).due for rating in (1, 2, 3, 4)]
        assert due == sorted(due)
    card = H.review(H.review(H.Card(), 3, 0.0), 1, 5 * H.DAY)
    assert card.lapses == 1 and card.state == "relearning"


def test_many_cards_are_replayed_in_one_pass(spark):
    """A group for each card cost milliseconds a card; cards follow each other in a partition."""
    rows = [(c, 10 * c + k, (c + k) % 4 + 1, dt.datetime(2024, 1, 1) + dt.timedelta(days=(3 * k + c) % 11, hours=c % 5)) for c in range(3000) for k in range(4)]
    rows += [(c, 10 * c, 1, dt.datetime(2025, 1, 1)) for c in range(0, 3000, 3)]
    d = H.schedule_replay(spark.createDataFrame(rows, "card_id long, review_id long, rating int, reviewed_at timestamp").repartition(3))
    assert "FlatMapGroupsInPandas" not in d._jdf.queryExecution().toString()
    got = {r["card_id"]: r for r in d.collect()}
    assert len(got) == 3000
    for c in range(0, 3000, 37):
        card = H.Card()
        for _, _, rating, at in sorted(rows[4 * c : 4 * c + 4], key=lambda r: (r[3], r[1])):
            card = H.review(card, rating, at.replace(tzinfo=dt.timezone.utc).timestamp())
        assert (got[c]["reviews"], got[c]["stability"], got[c]["state"], got[c]["lapses"]) == (4, card.stability, card.state, card.lapses)
