"""Registered queries that run a stream over the tables to completion and return its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.operators import sinks
from cyclelake.operators.rollups import hourly_rollup
from cyclelake.plans.feature_queries import _volatility_sql
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views
from cyclelake.schema import VOLATILITY_FEATURES
from cyclelake.session import shared_folder
from cyclelake.streaming import ingest, rollups, scoring


STEPS = 3  # restarts of a replayed stream; state is carried over in its checkpoint


def _replay(
    v: Views, table: DataFrame, transform: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None
) -> DataFrame:
    """Stream a table through `transform` in time order, in `STEPS` runs of one stream, and return what was written.

    With keys (update mode) the last version of each key counts, as an upsert into a table leaves it.
    """
    base = f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"
    micros = F.unix_micros("time")
    cuts = table.select(micros.alias("t")).approxQuantile("t", [i / STEPS for i in range(1, STEPS)], 0.01)
    step = sum(((micros > cut).cast("int") for cut in cuts), F.lit(0))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    for i in range(STEPS):
        table.where(F.coalesce(step, F.lit(0)) == i).write.mode("append").parquet(f"{base}/in")
        stream = v.spark.readStream.schema(table.schema).parquet(f"{base}/in")
        started = (
            transform(stream)
            .writeStream.outputMode(mode)
            .option("checkpointLocation", f"{base}/checkpoint")
            .foreachBatch(save)
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
    written = v.spark.read.parquet(f"{base}/out")
    if keys:
        newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        written = written.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return written.drop("batch")


HOURLY_SQL = """SELECT date_trunc('hour', time) AS bucket, site_id, machine_id, production_order_id, count(*) AS cycle_count,
              round(avg(cycle_time_s), 6) AS avg_cycle_time_s, round(stddev_samp(cycle_time_s), 6) AS stddev_cycle_time_s,
              count(*) FILTER (WHERE scrap_flag) AS total_scraps, round(avg(link_confidence), 6) AS avg_link_confidence
       FROM linked GROUP BY 1, 2, 3, 4"""


@query("x5_hourly_stream", HOURLY_SQL)
def hourly_stream(v: Views) -> DataFrame:
    keys = ["bucket", "site_id", "machine_id", "production_order_id"]
    return _replay(v, v.linked_table, rollups.hourly_stream, "update", keys).select(
        "bucket", "site_id", "machine_id", "production_order_id", "cycle_count", "avg_cycle_time_s",
        "stddev_cycle_time_s", "total_scraps", "avg_link_confidence",
    )


@query("x6_backfilled_rollup", HOURLY_SQL)
def backfilled_rollup(v: Views) -> DataFrame:
    """The rollup of the cycles that came in time, after the days of the late ones were computed anew."""
    base = f"{shared_folder(v.spark)}/rollups/{uuid.uuid4().hex}"
    sinks.write_cycles(v.linked, f"{base}/cycles")
    whole = sinks.read_cycles(v.spark, f"{base}/cycles")
    late = F.col("cycle_counter") % 40 == 7
    rollups.write_rollup(hourly_rollup(whole.where(~late), rounded=False), f"{base}/rollup")
    rollups.backfill(whole, whole.where(late), f"{base}/rollup")
    return v.spark.read.parquet(f"{base}/rollup").select(
        "bucket", F.col("site_id").cast("bigint").alias("site_id"), "machine_id", "production_order_id", "cycle_count", "avg_cycle_time_s",
        "stddev_cycle_time_s", "total_scraps", "avg_link_confidence",
    )


DROPS = 3  # deliveries to the inbox, each followed by a run of the import


def _delivered(v: Views, importers: Callable[[str, str], dict[str, ingest.Importer]]) -> str:
    """Tables of the import stream after all deliveries; every delivery meets a newly started stream.

    The cycles arrive as files of a site, a quarter of its machines and 100,000 counter values, a third of them with each
    delivery. The second one also brings copies under other names, one of an earlier file and one of its own, and the
    first part of a file that is complete with the third. A file without a site and one of a kind without importer lie beside.
    """
    base = f"{shared_folder(v.spark)}/imports/{uuid.uuid4().hex}"
    inbox, tables, n = f"{base}/inbox", f"{base}/tables", F.col("cycle_counter")
    rows = v.cycles.select(
        "site_id", (F.col("machine_id") % 4).alias("quarter"), F.floor(n / 100_000).alias("part"), (n % DROPS).alias("delivery"),
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("machine_id").cast("string").alias("Machine"),
        F.col("cycle_time_s").cast("string").alias("t_cycle"), n.alias("n_cycle"),
    )
    keys = ["site_id", "quarter", "part", "delivery"]
    rows.repartition(*keys).write.partitionBy(*keys).option("header", True).option("sep", ";").csv(f"{base}/made")
    jvm = v.spark._jvm.org.apache.hadoop.fs
    at = lambda name: jvm.Path(f"{inbox}/{name}")
    conf = v.spark._jsparkSession.sessionState().newHadoopConf()
    fs = at("").getFileSystem(conf)
    copy = lambda one, name: jvm.FileUtil.copy(fs, one, fs, at(name), False, conf)
    made = [status.getPath() for status in fs.globStatus(jvm.Path(f"{base}/made/*/*/*/*/part-*"))]
    for delivery in range(DROPS):
        for one in made:
            site, quarter, part, own = (piece.partition("=")[2] for piece in one.toString().split("/")[-5:-1])
            name = f"site-{site}/{quarter}/cycles_{part}_{own}"
            if int(own) == delivery:
                copy(one, f"{name}.csv")
            if delivery == 1 and part == "0":
                if (quarter, own) == ("0", "0"):
                    copy(one, f"site-{site}/archive/machine_again.csv")
                if (quarter, own) == ("1", "1"):
                    copy(one, f"site-{site}/{quarter}/cycles_copy.csv")
                if (quarter, own) == ("2", "2"):
                    copy(one, f"{name}.csv.part")
        if delivery == 0 and made:
            copy(made[0], "loose_cycles.csv")
            copy(made[0], "site-1/quality_checks.csv")
        ingest.start_import(v.spark, inbox, tables, importers(inbox, tables), available_now=True).awaitTermination()
    return tables


@query(
    "x1_import_stream",
    """SELECT site_id, CAST(machine_id AS VARCHAR) AS machine, date_trunc('second', time) AS time, cycle_counter,
              round(cycle_time_s, 6) AS cycle_time_s, 'machine_cycle' AS source_kind FROM cycles""",
)
def import_stream(v: Views) -> DataFrame:
    tables = _delivered(v, lambda inbox, tables: {"machine_cycle": ingest.table_importer(inbox, tables, "cycles")})
    cell = lambda name: F.col("cells")[name]
    return v.spark.read.parquet(f"{tables}/cycles").select(
        "site_id", cell("Machine").alias("machine"), "time", cell("n_cycle").cast("bigint").alias("cycle_counter"),
        cell("t_cycle").cast("double").alias("cycle_time_s"), "source_kind",
    )


@query(
    "x2_import_manifest",
    """, f AS (SELECT DISTINCT site_id, machine_id % 4 AS quarter, cycle_counter // 100000 AS part, cycle_counter % 3 AS delivery FROM cycles)
       SELECT site_id, 'completed' AS status, 'machine_cycle' AS source_kind, count(*) AS files FROM f GROUP BY site_id
       UNION ALL SELECT site_id, 'duplicate', 'machine_cycle', count(*) FROM f
         WHERE part = 0 AND ((quarter = 0 AND delivery = 0) OR (quarter = 1 AND delivery = 1)) GROUP BY site_id
       UNION ALL SELECT NULL, 'rejected', 'machine_cycle', 1
       UNION ALL SELECT 1, 'unsupported', 'quality', 1""",
)
def import_manifest(v: Views) -> DataFrame:
    tables = _delivered(v, lambda inbox, tables: {"machine_cycle": lambda files, batch: None})
    manifest = ingest.read_table(v.spark, f"{tables}/manifest", ingest.MANIFEST_SCHEMA)
    return manifest.groupBy("site_id", "status", "source_kind").agg(F.count("*").alias("files"))


def _delivered_rows(v: Views, rows: DataFrame, arrival: Column, start: Callable[[DataFrame], object]) -> None:
    """Write rows to a folder in `STEPS` deliveries by their arrival, each followed by a run of a newly started stream."""
    folder = f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}"
    micros = F.unix_micros(arrival)
    cuts = rows.select(micros.alias("t")).approxQuantile("t", [i / STEPS for i in range(1, STEPS)], 0.01)
    step = sum(((micros > cut).cast("int") for cut in cuts), F.lit(0))
    for i in range(STEPS):
        rows.where(F.coalesce(step, F.lit(0)) == i).write.mode("append").parquet(folder)
        start(v.spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


@query("x8_volatility_stream", _volatility_sql("cycles"))
def volatility_stream(v: Views) -> DataFrame:
    """Cycles reach the stream up to six hours late and out of order; the seven hours of the stream's delay cover that."""
    made = scoring.VolatilityStream(v.spark, f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}", delay_s=7 * 3600)
    arrival = F.timestamp_add("HOUR", (F.col("cycle_counter") % 7).cast("int"), F.col("time"))
    _delivered_rows(v, v.cycles, arrival, lambda stream: made.start(stream, available_now=True))
    made.close()
    return made.features().select("cycle_counter", "source_row_hash", *VOLATILITY_FEATURES)


def _monitored(v: Views) -> scoring.MonitorStream:
    """The monitor after three deliveries of scores and, half an hour later each, the outcomes of three in four."""
    seen = v.scores.where(~F.col("is_reference"))
    none = lambda kind: F.lit(None).cast(kind)
    scores = seen.select("model", "time", "cycle_counter", "score", "threshold", none("int").alias("label"), F.lit("score").alias("kind"))
    told = seen.where(F.col("cycle_counter") % 4 != 0).select(
        "model", F.timestamp_add("MINUTE", F.lit(30), "time").alias("time"), "cycle_counter", "score", none("double").alias("threshold"),
        "label", F.lit("feedback").alias("kind"),
    )
    made = scoring.MonitorStream(v.spark, f"{shared_folder(v.spark)}/streams/{uuid.uuid4().hex}", v.scores.where("is_reference"), window=MONITORED)
    _delivered_rows(v, scores.unionByName(told), F.col("time"), lambda stream: made.start(stream, available_now=True))
    return made


MONITORED = 200  # scores and feedback rows kept per model, fewer than the smallest table has
MONITOR_SQL = f""", ref AS (SELECT model, score, count(*) AS n FROM scores WHERE is_reference GROUP BY 1, 2),
       cdf AS (SELECT model, score, sum(n) OVER (PARTITION BY model ORDER BY score) / sum(n) OVER (PARTITION BY model) AS p FROM ref),
       told AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY time DESC, cycle_counter DESC) AS n FROM scores
                WHERE NOT is_reference AND cycle_counter % 4 <> 0),
       prob AS (SELECT f.model, f.label, coalesce(c.p, 0) AS p FROM (SELECT * FROM told WHERE n <= {MONITORED}) f
                ASOF LEFT JOIN cdf c ON c.model = f.model AND c.score <= f.score)"""


@query(
    "x9_monitor_stream",
    f"""{MONITOR_SQL},
       recent AS (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY time DESC, cycle_counter DESC) AS n FROM scores WHERE NOT is_reference),
       brier AS (SELECT model, round(avg((p - label) * (p - label)), 6) AS brier_score FROM prob GROUP BY model)
       SELECT model, count(*) AS observations_total, count(*) FILTER (WHERE score >= threshold) AS alerts_total,
              count(*) FILTER (WHERE n <= {MONITORED}) AS recent_window,
              round(avg(CAST(score >= threshold AS INTEGER)) FILTER (WHERE n <= {MONITORED}), 6) AS alert_rate,
              round(avg(score) FILTER (WHERE n <= {MONITORED}), 6) AS recent_mean, any_value(brier_score) AS brier_score
       FROM recent LEFT JOIN brier USING (model) GROUP BY model""",
)
def monitor_stream(v: Views) -> DataFrame:
    return _monitored(v).latest("figures")


@query(
    "x9_calibration_stream",
    f"""{MONITOR_SQL},
       bins AS (SELECT DISTINCT model, CAST(b AS INTEGER) AS bin FROM prob, range(5) g(b))
       SELECT b.model, b.bin, b.bin / 5 AS lower, (b.bin + 1) / 5 AS upper, count(p.p) AS count,
              round(avg(p.p), 6) AS mean_predicted, round(avg(p.label), 6) AS observed_rate
       FROM bins b LEFT JOIN prob p ON p.model = b.model AND p.p >= b.bin / 5 AND (p.p < (b.bin + 1) / 5 OR (b.bin = 4 AND p.p = 1))
       GROUP BY b.model, b.bin""",
)
def calibration_stream(v: Views) -> DataFrame:
    return _monitored(v).latest("calibration")


@query(
    "x10_delayed_labels",
    """SELECT site_id, machine_id, cycle_counter, score, label FROM scores WHERE cycle_counter % 4 <> 0""",
)
def delayed_labels(v: Views) -> DataFrame:
    both = v.scores.select("site_id", "machine_id", "cycle_counter", "time", "score", "label")

    def join(stream: DataFrame) -> DataFrame:
        labels = stream.where(F.col("cycle_counter") % 4 != 0).select(
            "site_id", "machine_id", "cycle_counter", F.timestamp_add("MINUTE", F.lit(30), "time").alias("time"), "label"
        )
        return scoring.attach_labels(stream.drop("label"), labels)

    return _replay(v, both, join, "append").select("site_id", "machine_id", "cycle_counter", "score", "label")
