import random

import numpy as np
from pyspark.sql import functions as F

from coursegrain.operators import ranks as R


def test_places_within_groups_of_any_size(spark):
    r = random.Random(2)
    rows = [(r.choice(["a"] * 8 + ["b", None]), r.choice([None, *range(50)]), i) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {x["i"]: x["place"] for x in R.ranked(d, ["g"], [F.desc("v"), F.asc("i")]).collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[x[2]] for x in own] == list(range(len(own)))
    assert R.ranked(d.limit(0), ["g"], [F.asc("i")]).count() == 0


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(3)
    values = {"many": r.standard_normal(700).tolist(), "ties": [1.0] * 300 + [2.0], "one": [5.0], "two": [1.0, 4.0], None: [3.0, 1.0, 2.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("many", None), ("nulls", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x["g"]: x for x in R.quantiles(d, ["g"], F.col("v"), {"p50": 0.5, "p95": 0.95, "p0": 0.0, "top": ("floor", 0.95)}).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert np.allclose([got[g]["p50"], got[g]["p95"], got[g]["p0"]], np.quantile(vs, [0.5, 0.95, 0.0]), rtol=0, atol=1e-12)
        assert got[g]["top"] == sorted(vs)[min(len(vs) - 1, int(0.95 * len(vs)))]


def test_no_task_holds_a_large_group(spark):
    d = spark.range(4000).select(F.lit("all").alias("g"), F.col("id").alias("v"))
    parted = R._ranged(d, ["g"], [F.col("v")], "test")
    assert parted.groupBy("_part").count().agg(F.max("count")).first()[0] < 2500
