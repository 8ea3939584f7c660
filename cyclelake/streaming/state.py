"""State of foreachBatch streams as versioned tables in a folder all executors share.

A batch reads the newest version before its own number and writes a version under its number. A replayed
batch therefore starts from the same state and overwrites what it had written; versions older than the one
before are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


@dataclass(frozen=True)
class StateTables:
    """Tables below `base`, each with versions by batch number."""

    spark: SparkSession
    base: str

    def versions(self, name: str) -> list[int]:
        fs, path = _filesystem(self.spark, f"{self.base}/{name}")
        if not fs.exists(path):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
        return sorted(int(n.partition("=")[2]) for n in found if n.startswith("version="))

    def read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The newest version, or the newest before a batch; an empty table if there is none."""
        usable = [v for v in self.versions(name) if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/version={usable[-1]}")

    def write(self, name: str, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's version, and return it as a table."""
        path = f"{self.base}/{name}/version={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        for old in [v for v in self.versions(name) if v < batch_id][:-1]:
            fs, folder = _filesystem(self.spark, f"{self.base}/{name}/version={old}")
            fs.delete(folder, True)
        return self.spark.read.schema(rows.schema).parquet(path)


def start_batches(stream: DataFrame, base: str, handle, available_now: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Run `handle(rows, batch number)` on every batch of a stream; progress is kept below `base`."""
    writer = stream.writeStream.option("checkpointLocation", f"{base}/_checkpoint").foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
