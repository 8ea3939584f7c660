"""Rollups, summaries and status lists. Groups combine map-side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.operators.lookup import latest_cycles
from cyclelake.schema import SITE_MACHINE

MINUTE_HOUR = {"minute": "minute", "hour": "hour"}


def scrap_count(column: str = "scrap_flag") -> Column:
    return F.count_if(F.coalesce(F.col(column), F.lit(False)))


def hourly_rollup(cycles: DataFrame, rounded: bool = True) -> DataFrame:
    """Per hour, machine and order: counts, means, spreads and mean link confidence."""
    digits = (lambda c, n: F.round(c, n)) if rounded else (lambda c, n: c)
    return cycles.groupBy(
        F.date_trunc("hour", "time").alias("bucket"), *SITE_MACHINE, "production_order_id"
    ).agg(*hourly_measures(digits))


def hourly_measures(digits=lambda c, n: F.round(c, n)) -> list[Column]:
    return [
        F.count("*").alias("cycle_count"),
        digits(F.avg("cycle_time_s"), 3).alias("avg_cycle_time_s"),
        digits(F.stddev_samp("cycle_time_s"), 3).alias("stddev_cycle_time_s"),
        digits(F.avg("cushion_mm"), 3).alias("avg_cushion_mm"),
        digits(F.stddev_samp("cushion_mm"), 3).alias("stddev_cushion_mm"),
        digits(F.avg("dosing_time_s"), 3).alias("avg_dosing_time_s"),
        digits(F.avg("switchover_pressure_bar"), 2).alias("avg_switchover_pressure_bar"),
        scrap_count().alias("total_scraps"),
        (F.count("*") - scrap_count()).alias("total_good"),
        digits(F.avg("link_confidence"), 3).alias("avg_link_confidence"),
    ]


def timeline(cycles: DataFrame, bucket: str, limit: int | None = None) -> DataFrame:
    """Timeline of every machine by minute, hour, shift or order.

    Shift and order buckets are named by their first cycle's time. A page of a timeline may show
    the first `limit` buckets of a machine.
    """
    if bucket in MINUTE_HOUR:
        keys = [F.date_trunc(MINUTE_HOUR[bucket], "time").alias("bucket")]
        first, order = None, F.min("production_order_id")
    elif bucket in ("shift", "order"):
        column = "shift_id" if bucket == "shift" else "production_order_id"
        keys = [F.col(column).alias("_part")]
        first, order = F.min("time").alias("bucket"), F.min("production_order_id")
    else:
        raise ValueError("bucket must be one of minute, hour, shift or order")
    measures = [
        F.count("*").alias("cycle_count"),
        F.avg("cycle_time_s").alias("avg_cycle_time_s"),
        F.avg(F.col("scrap_flag").cast("int")).alias("scrap_rate"),
        F.avg("barrel_temp_zone2_c").alias("avg_zone2_temperature_c"),
        order.alias("production_order_id"),
    ]
    rows = cycles.groupBy(*SITE_MACHINE, *keys).agg(*([first] if first is not None else []), *measures)
    if limit is not None:
        tie = ["_part"] if first is not None else []
        early = Window.partitionBy(*SITE_MACHINE).orderBy("bucket", *tie)
        rows = rows.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= limit)
    return rows.drop("_n", "_part")


def quality_from_checks(checks: DataFrame) -> DataFrame:
    bad = (F.lower(F.coalesce("part_quality_status", F.lit(""))) == "scrap") | (F.col("defect_count") > 0)
    return checks.groupBy(*SITE_MACHINE).agg(
        F.count("*").alias("check_count"),
        F.coalesce(F.sum("defect_count"), F.lit(0)).cast("bigint").alias("check_defects"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("check_scrap"),
    )


def quality_from_cycles(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy(*SITE_MACHINE).agg(
        F.count("*").alias("cycle_count"),
        scrap_count().alias("cycle_scrap"),
        F.count("defect_type").alias("cycle_defects"),
    )


def defect_breakdown(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows per machine and defect; a missing defect is `unknown`."""
    counted = rows.groupBy(
        *SITE_MACHINE, F.coalesce("defect_type", F.lit("unknown")).alias("defect_type")
    ).agg(F.count("*").alias("count"))
    if limit is None:
        return counted
    top = Window.partitionBy(*SITE_MACHINE).orderBy(F.desc("count"), "defect_type")
    return counted.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= limit).drop("_n")


def quality_summary(checks: DataFrame, cycles: DataFrame) -> DataFrame:
    """Quality figures per machine: cycles are the denominator wherever there are any."""
    both = quality_from_checks(checks).join(quality_from_cycles(cycles), SITE_MACHINE, "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    has_cycles = zero("cycle_count") > 0
    from_cycles = F.when(zero("cycle_defects") > 0, zero("cycle_defects")).otherwise(zero("cycle_scrap"))
    total = F.when(has_cycles, zero("cycle_count")).otherwise(zero("check_count"))
    scrap = F.when(has_cycles, zero("cycle_scrap")).otherwise(zero("check_scrap"))
    return both.select(
        *SITE_MACHINE,
        total.alias("total_checks"),
        F.when(has_cycles, F.greatest(zero("check_defects"), from_cycles))
        .otherwise(zero("check_defects"))
        .alias("total_defects"),
        scrap.alias("scrap_count"),
        F.when(total > 0, scrap / total).alias("scrap_rate"),
        F.greatest(F.lit(0), total - scrap).cast("bigint").alias("good"),
    )


def defect_summary(checks: DataFrame, cycles: DataFrame, limit: int | None = None) -> DataFrame:
    """Defect breakdown from checks; from cycles (the `limit` most frequent) for machines without any check."""
    by_check = defect_breakdown(checks)
    with_defects = cycles.where(F.col("defect_type").isNotNull()).select(*SITE_MACHINE).distinct()
    unchecked = with_defects.join(checks.select(*SITE_MACHINE), SITE_MACHINE, "left_anti")
    by_cycle = defect_breakdown(cycles.join(unchecked, SITE_MACHINE, "left_semi"), limit=limit)
    return by_check.unionByName(by_cycle)


def site_summary(
    sites: DataFrame, machines: DataFrame, incidents: DataFrame, passports: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Machines, open incidents and last import per site; children are aggregated before joining."""
    completed_jobs = jobs.where(F.col("status") == "completed")
    done = completed_jobs.groupBy("site_id").agg(
        F.max("completed_at").alias("_job_time"),
        F.count_if(F.col("completed_at").isNull()).alias("_job_untimed"),
    )
    passed = (
        passports.where(F.col("status") == "completed")
        .groupBy("site_id")
        .agg(F.max("imported_at").alias("_passport_time"))
    )
    owned = machines.groupBy("site_id").agg(F.count_distinct("machine_id").alias("machine_count"))
    open_ones = (
        incidents.where(F.col("status") == "open")
        .groupBy("site_id")
        .agg(F.count_distinct("incident_id").alias("open_incident_count"))
    )
    # a job's completion time stands before the passport's import time
    passport_counts = F.col("_job_untimed").isNull() | (F.col("_job_untimed") > 0)
    return (
        sites.join(owned, "site_id", "left")
        .join(open_ones, "site_id", "left")
        .join(passed, "site_id", "left")
        .join(done, "site_id", "left")
        .select(
            "site_id",
            "name",
            "timezone",
            F.coalesce("machine_count", F.lit(0)).cast("bigint").alias("machine_count"),
            F.coalesce("open_incident_count", F.lit(0)).cast("bigint").alias("open_incident_count"),
            F.greatest(F.col("_job_time"), F.when(passport_counts, F.col("_passport_time"))).alias(
                "last_import_at"
            ),
        )
    )


def machines_per_line(lines: DataFrame, machines: DataFrame) -> DataFrame:
    counted = machines.groupBy("line_id").agg(F.count("*").alias("_n"))
    return lines.join(counted, "line_id", "left").select(
        "line_id", "site_id", "code", "name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("machine_count")
    )


def machine_topology(machines: DataFrame, lines: DataFrame, incidents: DataFrame) -> DataFrame:
    """Machines with their line and open incidents."""
    open_ones = (
        incidents.where(F.col("status") == "open")
        .groupBy(*SITE_MACHINE)
        .agg(F.count("*").alias("_open"))
    )
    named = lines.select("line_id", F.col("code").alias("line_code"))
    return (
        machines.join(named, "line_id", "left")
        .join(open_ones, SITE_MACHINE, "left")
        .select(
            *SITE_MACHINE,
            "erp_ref",
            "brand",
            "line_code",
            F.coalesce("_open", F.lit(0)).cast("bigint").alias("open_incidents"),
        )
    )


def machine_summary(machines: DataFrame, cycles: DataFrame) -> DataFrame:
    """Cycle figures per machine, machines without cycles included."""
    figures = cycles.groupBy(*SITE_MACHINE).agg(
        F.count("time").alias("total_cycles"),
        F.avg("cycle_time_s").alias("avg_cycle_s"),
        F.min("cycle_time_s").alias("min_cycle_s"),
        F.max("cycle_time_s").alias("max_cycle_s"),
        scrap_count().alias("total_scraps"),
        F.avg("link_confidence").alias("avg_confidence"),
    )
    return machines.join(figures, SITE_MACHINE, "left").select(
        *SITE_MACHINE,
        "erp_ref",
        "name",
        "brand",
        F.coalesce("total_cycles", F.lit(0)).cast("bigint").alias("total_cycles"),
        "avg_cycle_s",
        "min_cycle_s",
        "max_cycle_s",
        F.coalesce("total_scraps", F.lit(0)).cast("bigint").alias("total_scraps"),
        "avg_confidence",
    )


def quality_rate(cycles: DataFrame) -> DataFrame:
    good = F.count_if(~F.col("scrap_flag"))
    return cycles.groupBy(*SITE_MACHINE).agg(
        F.count("time").alias("total_cycles"),
        good.alias("good_cycles"),
        F.round(good / F.nullif(F.count("time"), F.lit(0)) * 100, 1).alias("quality_pct"),
        F.avg("cycle_time_s").alias("avg_cycle_s"),
        F.count_if(F.col("quality_flag") != "valid").alias("anomalies"),
    ).where(F.col("total_cycles") > 0)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("issue_count"))


def import_report(passports: DataFrame) -> DataFrame:
    """Per file: accepted of total rows, mapping confidence, newest first."""
    return passports.select(
        "file_name",
        "row_count_accepted",
        (F.coalesce("row_count_accepted", F.lit(0)) + F.coalesce("row_count_rejected", F.lit(0))).alias("row_count"),
        "column_mapping_confidence",
        "imported_at",
    ).orderBy(F.desc("imported_at"))


def cycle_time_spread(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy(*SITE_MACHINE).agg(
        F.count("time").alias("total_cycles"),
        F.avg("cycle_time_s").alias("avg_cycle_s"),
        F.stddev_samp("cycle_time_s").alias("stddev_cycle_s"),
    )


def fleet_status(machines: DataFrame, cycles: DataFrame) -> DataFrame:
    """Status against the site's own data clock: stopped when an hour behind the site's last cycle."""
    last = latest_cycles(cycles, ["time", "scrap_flag"])
    clock = last.groupBy("site_id").agg(F.max("time").alias("site_time"))
    age = F.col("site_time") - F.col("time")
    return (
        machines.join(last, SITE_MACHINE, "left")
        .join(clock, "site_id", "left")
        .select(
            *SITE_MACHINE,
            "erp_ref",
            F.col("time").alias("last_cycle_at"),
            F.when(F.col("time").isNull(), "offline")
            .when(age > F.expr("INTERVAL 1 HOUR"), "stopped")
            .when(F.col("scrap_flag"), "warning")
            .otherwise("running")
            .alias("status"),
        )
    )


def machine_status(machines: DataFrame, cycles: DataFrame, now: str) -> DataFrame:
    """Status against a given clock: offline beyond an hour, stopped beyond 15 minutes."""
    age = F.lit(now).cast("timestamp") - F.col("time")
    return machines.join(latest_cycles(cycles, ["time", "scrap_flag"]), SITE_MACHINE, "left").select(
        *SITE_MACHINE,
        "erp_ref",
        F.col("time").alias("last_cycle_at"),
        F.when(F.col("time").isNull() | (age > F.expr("INTERVAL 1 HOUR")), "offline")
        .when(age > F.expr("INTERVAL 15 MINUTES"), "stopped")
        .when(F.col("scrap_flag"), "warning")
        .otherwise("running")
        .alias("status"),
    )


def planned_vs_measured(orders: DataFrame, cycles: DataFrame) -> DataFrame:
    """Measured against planned cycle time per order that has cycles."""
    measured = (
        cycles.where(F.col("production_order_id").isNotNull())
        .groupBy(*SITE_MACHINE, "production_order_id")
        .agg(F.avg("cycle_time_s").alias("measured_cycle_s"), F.count("time").alias("cycle_count"))
        .withColumnRenamed("production_order_id", "id")
    )
    planned = F.col("erp_cycle_time_s")
    return (
        orders.where(planned.isNotNull())
        .join(measured, [*SITE_MACHINE, "id"])
        .select(
            *SITE_MACHINE,
            "id",
            "product_ref",
            planned.alias("planned_cycle_s"),
            "measured_cycle_s",
            "cycle_count",
            ((F.col("measured_cycle_s") - planned) / F.nullif(planned, F.lit(0.0)) * 100).alias("delta_pct"),
        )
    )


def largest_deviations(comparison: DataFrame, n: int = 15) -> DataFrame:
    """The n orders farthest from their plan."""
    return comparison.orderBy(F.abs("delta_pct").desc_nulls_last(), "site_id", "id").limit(n)


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One offset page; `next_page` is the opaque marker of the following page, null on the last.

    Deep offsets read and drop all earlier rows: walk large lists with `page_after`.
    """
    got = df.orderBy(*order).offset(offset).limit(size + 1)
    numbered = got.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    marker = F.rtrim(F.translate(F.base64(F.lit(str(offset + size)).cast("binary")), "+/=", "-_ "))
    # the window holds one page only
    more = F.max("_n").over(Window.partitionBy()) > size
    return (
        numbered.withColumn("next_page", F.when(more, marker)).where(F.col("_n") <= size).drop("_n")
    )


def page_after(df: DataFrame, key: str, last: object | None, size: int) -> DataFrame:
    """The page following a key value (keyset paging): the filter is pushed to the scan."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)


def newest_first(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(time), tie).limit(n)


def filtered(
    df: DataFrame,
    *,
    site_id: int | None = None,
    allowed_sites: list[int] | None = None,
    machine_id: int | None = None,
    status: str | None = None,
    time: str = "started_at",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Optional conjunctive filters; an empty list of allowed sites gives no rows."""
    rows = df
    if site_id is not None:
        rows = rows.where(F.col("site_id") == site_id)
    if allowed_sites is not None:
        rows = rows.where(F.col("site_id").isin(allowed_sites) if allowed_sites else F.lit(False))
    if machine_id is not None:
        rows = rows.where(F.col("machine_id") == machine_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return rows


def most_common(rows: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """Most frequent value per group; the one seen first wins a tie."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(time).alias("_first")
    )
    # smallest of (-count, first seen, value)
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_m"), "_first", value)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias(value), (-F.col("_b._m")).alias("count"))
