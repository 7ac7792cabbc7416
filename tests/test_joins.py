import pytest

from coursegrain.operators.joins import salted_join
from coursegrain.sources import tables


def test_a_hot_key_joins_as_any_other(spark):
    rows = [(1, i) for i in range(3000)] + [(k, k) for k in range(2, 900)] + [(None, 7), (5000, 1)]
    left = spark.createDataFrame(rows, "k long, row long")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(1, 1000)] + [(1, "again"), (None, "none")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        assert sorted(map(str, salted_join(left, right, ["k"], ["row"], how).collect())) == want
    assert salted_join(left.limit(0), right, ["k"], ["row"]).count() == 0


def test_a_cluster_must_name_its_shared_folder(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "app-1"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster)


def test_written_tables_are_removed(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(tables, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert tables.written(spark.range(5), "t", "zstd").count() == 5
    assert os.listdir(tmp_path) == [spark.sparkContext.applicationId]
    tables.remove_written(spark)
    assert os.listdir(tmp_path) == []


def test_a_local_session_without_a_folder_gets_one():
    class Local:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "local[4]", "applicationId": "app-of-the-test"})

    path = tables.shared_dir(Local)
    assert path.startswith("file:///tmp/") and tables.shared_dir(Local) == path
