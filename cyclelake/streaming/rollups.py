"""Hourly rollup of a cycle stream and the rewrite of late hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.operators.rollups import hourly_measures, hourly_rollup
from cyclelake.operators.sinks import week_of
from cyclelake.schema import SITE_MACHINE

# --- fixed values: the refresh window reaches three hours back --------------------------
LATE_HOURS = 3
# --------------------------------------------------------------------------------------


def hourly_stream(cycles: DataFrame, late_hours: int = LATE_HOURS) -> DataFrame:
    """Streaming hourly rollup; hours stay open for late cycles until the watermark passes."""
    return (
        cycles.withWatermark("time", f"{late_hours} hours")
        .groupBy(F.window("time", "1 hour").alias("_w"), *SITE_MACHINE, "production_order_id")
        .agg(*hourly_measures(lambda c, n: c))
        .select(F.col("_w.start").alias("bucket"), *SITE_MACHINE, "production_order_id", *MEASURES)
    )


MEASURES = [
    "cycle_count",
    "avg_cycle_time_s",
    "stddev_cycle_time_s",
    "avg_cushion_mm",
    "stddev_cushion_mm",
    "avg_dosing_time_s",
    "avg_switchover_pressure_bar",
    "total_scraps",
    "total_good",
    "avg_link_confidence",
]


def write_rollup(rollup: DataFrame, path: str) -> None:
    """Rollup table with a folder per day; only the days present are replaced."""
    (
        rollup.withColumn("day", F.to_date("bucket"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def backfill(cycles: DataFrame, late: DataFrame, path: str) -> None:
    """Recompute the days that late cycles fall into from the whole cycle table.

    A table laid out by `week` is first joined on the late weeks, which prunes its folders.
    """
    days = late.select(F.to_date("time").alias("_day")).distinct()
    if "week" in cycles.columns:
        weeks = late.select(week_of(F.col("time")).alias("week")).distinct()
        cycles = cycles.join(weeks, "week", "left_semi")
    touched = cycles.withColumn("_day", F.to_date("time")).join(days, "_day", "left_semi").drop("_day")
    write_rollup(hourly_rollup(touched, rounded=False), path)
