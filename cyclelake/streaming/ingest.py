"""Continuous folder ingestion with Structured Streaming.

The file source tracks which paths were read; the manifest table tracks which contents were
completed per site, so a copy under another name is a duplicate. Every batch writes its own
`batch=<id>` folder and overwrites it on a replay, which makes the batch exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from cyclelake.operators.detect import detect_after_import
from cyclelake.session import stored
from cyclelake.sources import lines
from cyclelake.sources.files import with_file_hash, with_route

# --- fixed values: names of files still being written -----------------------------------
PARTIAL_PATTERN = r"(?i)(^|/)\.[^/]*$|\.(part|partial|tmp|lock|crdownload)$"
# --------------------------------------------------------------------------------------
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST_SCHEMA = "site_id bigint, file_hash string, path string, source_kind string, status string, batch bigint"
Importer = Callable[[DataFrame, int], None]


def file_stream(spark: SparkSession, inbox: str, files_per_batch: int = 1000) -> DataFrame:
    """Complete files arriving below the inbox."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(inbox)
        .where(~F.col("path").rlike(PARTIAL_PATTERN))
    )


def read_table(spark: SparkSession, path: str, schema: str, skip_batch: int | None = None) -> DataFrame:
    """A batch-folder table, empty before its first batch; optionally without one batch's rows."""
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows if skip_batch is None else rows.where(F.col("batch") != skip_batch)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def import_batch(
    files: DataFrame, batch_id: int, inbox: str, tables: str, importers: dict[str, Importer]
) -> None:
    """Route one batch of files, import each new content once, and log what happened to each."""
    spark = files.sparkSession
    routed = with_route(with_file_hash(files), inbox)
    done = read_table(spark, f"{tables}/manifest", MANIFEST_SCHEMA, batch_id).where("status = 'completed'")
    first = Window.partitionBy("site_id", "file_hash").orderBy("path")
    known = done.select("site_id", "file_hash", F.lit(True).alias("_done")).distinct()
    claimed = (
        routed.join(known, ["site_id", "file_hash"], "left")
        .withColumn("_copy", F.row_number().over(first))
        .withColumn(
            "status",
            F.when(F.col("route_error").isNotNull(), "rejected")
            .when(~F.col("source_kind").isin(list(importers)), "unsupported")
            .when(F.coalesce("_done", F.lit(False)) | (F.col("_copy") > 1), "duplicate")
            .otherwise("completed"),
        )
        .drop("_done", "_copy")
    )
    # the claim is stored without contents; each importer then opens its own files only
    claim = stored(claimed.drop("content"))
    for kind, run in importers.items():
        own = claim.where((F.col("status") == "completed") & (F.col("source_kind") == kind))
        paths = [r["path"] for r in own.select("path").collect()]  # at most the files of one batch
        if paths:
            contents = spark.read.format("binaryFile").load(paths).select("path", "content")
            run(own.join(contents, "path").select(*claimed.columns), batch_id)
    # the manifest row stands only after the imports of its batch
    write_batch(claim.select("site_id", "file_hash", "path", "source_kind", "status"), f"{tables}/manifest", batch_id)


def table_importer(inbox: str, tables: str, name: str, zone: str = "UTC") -> Importer:
    """An importer that appends the rows of delimited exports to the batch-folder table `name`.

    Rows keep file, line number, cells and time, with site, kind and machine of the file's route. Files
    are read line by line, so a large one is imported by many tasks.
    """

    def run(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        read = lines.read_lines(spark, [r["path"] for r in files.select("path").collect()])  # at most the files of one batch
        rows = lines.read_table(read, stored(lines.profile_lines(read)), zone)
        write_batch(with_route(rows, inbox).drop("route_error"), f"{tables}/{name}", batch_id)

    return run


def start_import(
    spark: SparkSession, inbox: str, tables: str, importers: dict[str, Importer], available_now: bool = False
) -> StreamingQuery:
    """Start the folder import; `available_now` handles what is there and stops."""
    writer = (
        file_stream(spark, inbox)
        .writeStream.option("checkpointLocation", f"{tables}/_checkpoints/import")
        .foreachBatch(lambda df, i: import_batch(df, i, inbox, tables, importers))
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def detect_in_batch(cycles: DataFrame, batch: DataFrame, batch_id: int, incidents: str, schema: str) -> None:
    """Incidents of the machines of a committed batch, each detection key once."""
    known = read_table(cycles.sparkSession, incidents, schema, batch_id)
    write_batch(detect_after_import(cycles, batch, known), incidents, batch_id)
