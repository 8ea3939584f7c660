"""Lookups: references, latest rows, existence and anti-joins.

Join sides are left to Catalyst: it broadcasts what its statistics or AQE show to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.functions.times import micros
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, running_sums
from cyclelake.schema import SITE_MACHINE


def latest_key() -> Column:
    """Ordering value of a cycle within its machine: time, counter, row hash."""
    return F.struct("time", "cycle_counter", "source_row_hash")


def machine_candidates(machines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(site, reference, machine) from ERP references and aliases, each once."""
    own = machines.select("site_id", F.col("erp_ref").alias("ref"), "machine_id")
    also = aliases.select("site_id", F.col("alias_value").alias("ref"), "machine_id")
    return own.union(also).where(F.col("ref").isNotNull()).distinct()


def resolve_machines(rows: DataFrame, machines: DataFrame, aliases: DataFrame, ref: str) -> DataFrame:
    """Add `machine_id` and `machine_status`: ok, unknown, or ambiguous (no machine then)."""
    known = (
        machine_candidates(machines, aliases)
        .groupBy("site_id", "ref")
        .agg(F.min("machine_id").alias("_machine"), F.count("*").alias("_n"))
    )
    trimmed = rows.withColumn("_ref", F.trim(F.col(ref)))
    joined = trimmed.join(
        known.withColumnRenamed("ref", "_ref"), ["site_id", "_ref"], "left"
    )
    return joined.withColumns(
        {
            "machine_id": F.when(F.col("_n") == 1, F.col("_machine")),
            "machine_status": F.when(F.col("_n").isNull(), "unknown")
            .when(F.col("_n") > 1, "ambiguous")
            .otherwise("ok"),
        }
    ).drop("_ref", "_machine", "_n")


def latest_cycles(cycles: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns of each machine's latest cycle."""
    picked = cycles.groupBy(*SITE_MACHINE).agg(F.max_by(F.struct(*columns), latest_key()).alias("last"))
    return picked.select(*SITE_MACHINE, *[F.col(f"last.{c}").alias(c) for c in columns])


def site_clock(cycles: DataFrame) -> DataFrame:
    """Latest cycle time of each site: the data's own clock."""
    return cycles.groupBy("site_id").agg(F.max("time").alias("site_time"))


def recent_cycles(cycles: DataFrame, as_of: str | Column, limit: int = 20) -> DataFrame:
    """The newest `limit` (1 to 100) cycles of every machine at or before an instant, oldest first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    instant = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    newest = Window.partitionBy(*SITE_MACHINE).orderBy(
        F.col("time").desc(), F.col("cycle_counter").desc_nulls_last(), F.col("source_row_hash").desc_nulls_last()
    )
    kept = (
        cycles.where(F.col("time") <= instant)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )
    return kept.withColumnRenamed("switchover_position", "switchover_position_mm")


def window_rows(
    table: DataFrame, machine_id: int, start: str, end: str, valid_only: bool, site_id: int | None = None
) -> DataFrame:
    """Rows of one machine with start <= time <= end; the filters reach the Parquet scan."""
    rows = table.where(F.col("machine_id") == machine_id).where(
        F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )
    if site_id is not None:
        rows = rows.where(F.col("site_id") == site_id)
    if valid_only:
        rows = rows.where(F.coalesce(F.col("data_quality_status"), F.lit("valid")) == "valid")
    return rows


def _seen(requests: DataFrame, cycles: DataFrame, budget: Budget) -> DataFrame:
    """Latest cycle at or before each instant, and count and scrap rate of the 24 hours before it.

    Cycles and marks (the instants, and the instants a day earlier) form one ordered row of events per
    machine. Counts at a mark are running sums, so a day is the difference of two marks; the latest cycle is the
    running maximum of the cycles' own order. Only marks leave the window. Rows moved: cycles plus two per request.
    """
    asked = requests.select(*SITE_MACHINE, "as_of").distinct()
    scrap = F.col("scrap_flag").cast("int")
    place = ["counted", "cycle_counter", "hashed", "source_row_hash"]
    own = cycles.where(F.col("time").isNotNull()).select(
        *SITE_MACHINE, "time", F.lit(0).alias("mark"), "cycle_counter", "source_row_hash", "production_order_id", "data_quality_status",
        F.coalesce(scrap, F.lit(0)).alias("scrap"), scrap.isNotNull().cast("int").alias("known"),
        F.lit(None).cast("timestamp").alias("as_of"),
    )
    starts = F.struct((F.col("as_of") - F.expr("INTERVAL 24 HOURS")).alias("time"), F.lit(1).alias("mark"))
    ends = F.struct(F.col("as_of").alias("time"), F.lit(2).alias("mark"))
    marks = asked.select(*SITE_MACHINE, "as_of", F.inline(F.array(starts, ends)))
    events = own.unionByName(marks, allowMissingColumns=True).withColumns(
        {"counted": F.col("cycle_counter").isNotNull(), "hashed": F.col("source_row_hash").isNotNull()}
    )
    is_cycle = F.col("mark") == 0
    sums = {"n": is_cycle.cast("long"), "s": F.coalesce("scrap", F.lit(0)).cast("long"), "k": F.coalesce("known", F.lit(0)).cast("long")}
    last = F.when(is_cycle, F.struct("time", *place, "production_order_id", "data_quality_status"))
    placed = running_sums(events, SITE_MACHINE, ["time", "mark", *place], sums, budget, {"last": last}).where("mark > 0")
    at = lambda name, mark: F.max(F.when(F.col("mark") == mark, F.col(name)))
    days = placed.groupBy(*SITE_MACHINE, "as_of").agg(
        at("last", 2).alias("last"), (at("n", 2) - at("n", 1)).alias("cycle_count_24h"),
        (at("s", 2) - at("s", 1)).alias("_scrap"), (at("k", 2) - at("k", 1)).alias("_known"),
    )
    return days.where(F.col("last").isNotNull()).select(
        *SITE_MACHINE, "as_of", F.col("last.time").alias("last_cycle_at"), "last", "cycle_count_24h",
        F.when(F.col("_known") > 0, F.col("_scrap") / F.col("_known")).alias("scrap_rate_24h"),
    )


def status_as_of(requests: DataFrame, cycles: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Status of machines at given instants; `requests` has site_id, machine_id and as_of.

    Latest cycle at or before the instant, freshness, and count and scrap rate of the 24 hours
    before it. Offline beyond an hour, stopped beyond 15 minutes, warning from 10 % scrap.
    """
    seen = _seen(requests, cycles, budget)
    freshness = F.greatest(
        F.lit(0.0), (micros(F.col("as_of")) - micros(F.col("last_cycle_at"))) / F.lit(1e6)
    )
    return (
        requests.join(seen, [*SITE_MACHINE, "as_of"], "left")
        .withColumn("freshness_s", F.when(F.col("last_cycle_at").isNotNull(), freshness))
        .withColumn(
            "status",
            F.when(F.col("freshness_s").isNull() | (F.col("freshness_s") > 3600), "offline")
            .when(F.col("freshness_s") > 900, "stopped")
            .when(F.col("scrap_rate_24h") >= 0.10, "warning")
            .otherwise("running"),
        )
        .select(
            *SITE_MACHINE,
            "as_of",
            "status",
            "freshness_s",
            "last_cycle_at",
            F.col("last.production_order_id").alias("current_order_id"),
            F.coalesce("cycle_count_24h", F.lit(0)).cast("bigint").alias("cycle_count_24h"),
            "scrap_rate_24h",
            F.col("last.data_quality_status").alias("data_quality_status"),
        )
    )


def affected_history(cycles: DataFrame, batch: DataFrame) -> DataFrame:
    """Cycles of the machines named in a committed batch, up to the batch's last time per machine."""
    affected = batch.groupBy(*SITE_MACHINE).agg(F.max("time").alias("_cutoff"))
    return cycles.join(affected, SITE_MACHINE).where(F.col("time") <= F.col("_cutoff")).drop("_cutoff")


def latest_run_evidence(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of each incident's latest completed run."""
    newest = (
        runs.where(F.col("status") == "completed")
        .groupBy("incident_id")
        .agg(
            # a missing completion time sorts last
            F.max_by("run_id", F.struct(F.col("completed_at").isNotNull(), "completed_at", "started_at", "run_id")).alias(
                "run_id"
            )
        )
    )
    return evidence.join(newest, "run_id")


def new_rows(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present yet."""
    return rows.join(present.select(*keys), keys, "left_anti")


def with_order_known(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Add `order_known`: no order named, or one that exists on the row's site."""
    known = orders.select("site_id", F.col("id").alias("production_order_id"), F.lit(True).alias("_known")).distinct()
    return rows.join(known, ["site_id", "production_order_id"], "left").withColumn(
        "order_known",
        (F.coalesce(F.col("production_order_id"), F.lit("")) == "") | F.coalesce(F.col("_known"), F.lit(False)),
    ).drop("_known")
