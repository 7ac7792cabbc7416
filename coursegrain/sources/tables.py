"""The given tables, and tables of our own in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # the temporary folder of a local application that names none


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local session that names none (as in tests) gets a temporary one. On a cluster that is an
    error, as executors would write to disks of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if app in _own:
            return _own[app]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return path.rstrip("/")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; compression is the session's unless given.

    This cuts the lineage: lost executors cost no more than the stage at hand. The
    files of one application are under one folder, to be removed when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Removes one table that written() gave, once no later step reads it: what was made from it has been written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_written(spark: SparkSession) -> None:
    """Removes all tables that this application has written: call it when its results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
