"""Tables that streams write batch by batch, with compaction that a restart can trust.

A batch has a folder of its own, so that running it again replaces what it wrote. Once so many
batches are there, the ones before the batch at hand (which can't run again, as its predecessors
are committed when it starts) are merged into a base, and then a manifest that names the base
and the last batch in it is put in place as one file. What a manifest names is complete; a base
without one, and folders that a manifest has made superfluous, are left out by readers and
removed by the next compaction. The generation before the last stays for readers under way."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Batches that are merged at a time.
EVERY = 20


class BatchTable:
    """A table at path with the columns of schema (DDL); merge sums up rows of several batches."""

    def __init__(self, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], every: int = EVERY):
        self.path, self.schema, self.merge, self.every = path.rstrip("/"), schema, merge, every

    def _fs(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def folders(self, spark: SparkSession) -> list[str]:
        """Names in the table's folder; none if it isn't there yet."""
        fs, path = self._fs(spark)
        return sorted(s.getPath().getName() for s in fs.listStatus(path(self.path))) if fs.exists(path(self.path)) else []

    def _manifests(self, spark: SparkSession, names: list[str]) -> list[dict]:
        """What the manifests say, the newest first."""
        found = [n for n in reversed(names) if n.startswith("manifest-") and n.endswith(".json")]
        return [json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/{n}").collect())) for n in found[:2]]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The batch's rows in its folder; then, where enough are there, what came before it is merged."""
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id:012d}")
        names = self.folders(spark)
        manifests = self._manifests(spark, names)
        upto = manifests[0]["upto"] if manifests else -1
        ready = [n for n in names if n.startswith("batch-") and upto < int(n[6:]) < batch_id]
        if len(ready) >= self.every:
            self._compact(spark, names, manifests, ready)

    def _compact(self, spark: SparkSession, names: list[str], manifests: list[dict], ready: list[str]) -> None:
        upto = max(int(n[6:]) for n in ready)
        base = f"base-{upto:012d}"
        parts = [f"{self.path}/{n}" for n in ready] + [f"{self.path}/{m['base']}" for m in manifests[:1]]
        self.merge(spark.read.schema(self.schema).parquet(*parts)).write.mode("overwrite").parquet(f"{self.path}/{base}")
        fs, path = self._fs(spark)
        # Written aside and renamed: a reader sees a whole manifest or none.
        final, aside = path(f"{self.path}/manifest-{upto:012d}.json"), path(f"{self.path}/.manifest-{upto:012d}")
        out = fs.create(aside, True)
        out.write(json.dumps({"base": base, "upto": upto}).encode())
        out.close()
        fs.delete(final, False)
        if not fs.rename(aside, final):
            raise OSError(f"{final} could not be put in place")
        # Folders of the generation before the last one; the last one's may be read just now.
        kept = {base, *(m["base"] for m in manifests[:1])}
        old = manifests[0]["upto"] if manifests else -1
        for n in names:
            stale = n.startswith("base-") and n not in kept or n.startswith("batch-") and int(n[6:]) <= old or n.startswith("manifest-") and int(n[9:-5]) < old
            if stale:
                fs.delete(path(f"{self.path}/{n}"), True)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows of all batches, or of those before one; as they were written, merged by base only."""
        names = self.folders(spark)
        manifests = self._manifests(spark, names)
        upto = manifests[0]["upto"] if manifests else -1
        parts = [f"{self.path}/{n}" for n in names if n.startswith("batch-") and int(n[6:]) > upto and (before is None or int(n[6:]) < before)]
        parts += [f"{self.path}/{m['base']}" for m in manifests[:1]]
        return spark.read.schema(self.schema).parquet(*parts) if parts else spark.createDataFrame([], self.schema)
