"""Sinks and merge policies as DataFrame functions over the stored and the arriving rows.

Plain Parquet has no MERGE: upserts give the new content of the table, to be written to the
affected partitions; insert-ignore gives only the rows to append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.functions.hashing import row_hash
from cyclelake.operators.lookup import new_rows
from cyclelake.schema import CYCLE_KEY, SITE_MACHINE


def rows_to_append(rows: DataFrame, present: DataFrame | None, keys: list[str] = CYCLE_KEY) -> DataFrame:
    """Insert-ignore: each key once, and only keys not stored yet."""
    once = rows.dropDuplicates(keys)
    return once if present is None else new_rows(once, present, keys)


def stage_rows(rows: DataFrame, kind: str, line_no: str, issue_code: Column) -> DataFrame:
    """Bronze rows: line number, kind, JSON content, content hash, status and error code."""
    columns = [c for c in rows.columns if c != line_no]
    return rows.select(
        F.col(line_no).alias("source_line_no"),
        F.lit(kind).alias("source_kind"),
        F.to_json(F.struct(*columns)).alias("normalized_data"),
        row_hash(rows.drop(line_no)).alias("source_row_hash"),
        F.when(issue_code.isNull(), "accepted").otherwise("rejected").alias("status"),
        issue_code.alias("error_code"),
    )


def last_wins(stored_rows: DataFrame, arriving: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Upsert: of all rows of a key the one with the highest sequence stays.

    Combines map-side, so a key with very many versions is not collected anywhere.
    """
    rows = stored_rows.unionByName(arriving)
    others = [c for c in rows.columns if c not in keys]
    # the row itself breaks a tie of the sequence, so a rerun keeps the same row
    best = rows.groupBy(*keys).agg(F.max(F.struct(sequence, *[c for c in others if c != sequence])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def shifts_from_orders(orders: DataFrame) -> DataFrame:
    """Shift rows of orders that carry a shift number and an end; dated by the UTC start."""
    return orders.where(
        F.col("shift_number").isNotNull() & (F.col("shift_number") != 0) & F.col("ended_at").isNotNull()
    ).select(
        *SITE_MACHINE,
        F.to_date("started_at").alias("shift_date"),
        F.col("shift_number").cast("int").alias("shift_number"),
        F.col("id").alias("production_order_id"),
        F.col("site_id").alias("order_site_id"),
        "started_at",
        "ended_at",
        F.col("erp_available_time_h").alias("planned_duration_h"),
    )


SHIFT_KEY = ["machine_id", "shift_date", "shift_number"]


def import_manifest(staged: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """One row per file: total, accepted and rejected rows, status and mapping confidence."""
    counts = staged.groupBy("site_id", "file_hash").agg(
        F.count("*").alias("row_count_total"),
        F.count_if(F.col("status") == "accepted").alias("row_count_accepted"),
        F.count_if(F.col("status") == "rejected").alias("row_count_rejected"),
    )
    done = counts.withColumn(
        "status", F.when(F.col("row_count_accepted") > 0, "completed").otherwise("failed")
    )
    return done if confidence is None else done.join(confidence, ["site_id", "file_hash"], "left")


def files_to_load(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content is not completed on their site; equal content is loaded once."""
    done = manifest.where(F.col("status") == "completed")
    fresh = new_rows(files, done, ["site_id", "file_hash"])
    return fresh.groupBy("site_id", "file_hash").agg(F.min("path").alias("path"))


def purge_retried(rows: DataFrame, retried: DataFrame) -> DataFrame:
    """Stored machine rows without those of files about to be loaded again."""
    return new_rows(rows, retried, ["site_id", "file_hash"])


def upsert_open_proposals(stored_rows: DataFrame, arriving: DataFrame) -> DataFrame:
    """Proposals keyed by (incident, action): updated only while still `proposed`.

    A proposal that is already decided keeps its label and run.
    """
    keys = ["incident_id", "action_code"]
    latest = last_wins(arriving.limit(0), arriving, keys, "sequence")
    new = latest.select(*keys, F.col("label").alias("_label"), F.col("run_id").alias("_run"))
    joined = stored_rows.join(new, keys, "full_outer")
    fresh = F.col("status").isNull()
    replace = F.coalesce(F.col("status") == "proposed", F.lit(False)) & F.col("_label").isNotNull()
    return joined.select(
        *keys,
        F.when(fresh | replace, F.col("_label")).otherwise(F.col("label")).alias("label"),
        F.when(fresh | replace, F.col("_run")).otherwise(F.col("run_id")).alias("run_id"),
        F.coalesce("status", F.lit("proposed")).alias("status"),
    )


def resolve_decisions(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """First decision per open proposal wins: approved becomes accepted, anything else rejected."""
    first = decisions.groupBy("proposal_id").agg(
        F.min_by("status", F.struct("decided_at", "decision_id")).alias("_decision")
    )
    decided = F.when(F.col("_decision") == "approved", "accepted").otherwise("rejected")
    return (
        proposals.join(first, "proposal_id", "left")
        .withColumn(
            "status",
            F.when((F.col("status") == "proposed") & F.col("_decision").isNotNull(), decided).otherwise(
                F.col("status")
            ),
        )
        .drop("_decision")
    )


def with_output_aliases(cycles: DataFrame) -> DataFrame:
    """Cycle records with the alias columns of the JSON output."""
    names = {
        "timestamp": "time",
        "cycle_time": "cycle_time_s",
        "injection_pressure_max": "peak_pressure_bar",
        "cushion": "cushion_mm",
    }
    return cycles.withColumns({alias: F.col(source) for alias, source in names.items() if source in cycles.columns})


def write_json_records(cycles: DataFrame, path: str) -> None:
    with_output_aliases(cycles).write.mode("append").option("compression", "gzip").json(path)


def week_of(time: Column) -> Column:
    return F.to_date(F.date_trunc("week", time))


def write_cycles(cycles: DataFrame, path: str, files_per_week: int = 8, mode: str = "append") -> None:
    """Cycle table layout: a folder per site and week, files sorted by machine and time.

    Rows of one machine and week are spread over several files by hash, so a machine holding
    most rows of a week does not end in one task.
    """
    placed = cycles.withColumn("week", week_of(F.col("time"))).withColumn(
        "_part", F.pmod(F.xxhash64(*SITE_MACHINE, F.date_trunc("hour", "time")), F.lit(files_per_week))
    )
    (
        placed.repartition("site_id", "week", "_part")
        .drop("_part")
        .sortWithinPartitions("site_id", "week", "machine_id", "time")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site_id", "week")
        .parquet(path)
    )


def read_cycles(spark, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Cycle table with time bounds that also prune the week folders."""
    rows = spark.read.parquet(path)
    if start is not None:
        t = F.lit(start).cast("timestamp")
        rows = rows.where((F.col("time") >= t) & (F.col("week") >= week_of(t)))
    if end is not None:
        t = F.lit(end).cast("timestamp")
        rows = rows.where((F.col("time") <= t) & (F.col("week") <= week_of(t)))
    return rows


def retry_ledger(jobs: DataFrame, now: Column, backoff_s: float = 30.0) -> DataFrame:
    """Next state of failed jobs: wait b·2^(n−1) seconds, or quarantine at the last attempt."""
    terminal = F.col("attempt_count") >= F.col("max_attempts")
    wait = F.lit(backoff_s) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt_count") - 1).cast("double"))
    later = F.timestamp_micros(F.unix_micros(now) + F.round(wait * F.lit(1e6)).cast("long"))
    return jobs.withColumns(
        {
            "status": F.when(terminal, "quarantined").otherwise("retry_wait"),
            "next_attempt_at": F.when(terminal, now).otherwise(later),
        }
    )


def deferred_ledger(jobs: DataFrame, now: Column, backoff_s: float = 30.0) -> DataFrame:
    """Jobs failing after their commit: retried without using up attempts."""
    later = F.timestamp_micros(F.unix_micros(now) + F.lit(int(backoff_s * 1e6)))
    return jobs.withColumns(
        {"status": F.lit("retry_wait"), "attempt_count": F.lit(0), "next_attempt_at": later}
    )


def current_states(events: DataFrame) -> DataFrame:
    """Latest event per job of an append-only history."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("event_time", "event_id")).alias("status"),
        F.max("event_time").alias("changed_at"),
        F.count("*").alias("events"),
    )
