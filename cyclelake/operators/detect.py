"""Scrap-burst detection: the strongest rise between 30 cycles and the 30 before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import WindowSpec

from cyclelake.functions.hashing import key_hash
from cyclelake.functions.values import is_detector_scrap, is_valid_data
from cyclelake.operators.lookup import affected_history, new_rows
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, framed, join_null_safe
from cyclelake.operators.rollups import most_common
from cyclelake.schema import CYCLE_ORDER, DETECTOR_VERSION, SITE_MACHINE

# --- fixed values ---------------------------------------------------------------------
WINDOW_CYCLES = 30
MIN_EVENT_RATE = 0.15
MIN_INCREASE = 0.10
CRITICAL_RATE = 0.30
# --------------------------------------------------------------------------------------
GROUP = [*SITE_MACHINE, "production_order_id"]


def scrap_bursts(
    cycles: DataFrame, minimum: int = WINDOW_CYCLES, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """One row per (site, machine, order) whose scrap rate jumps.

    At every position the 30 cycles before are compared with the 30 from it on. Rates are
    compared as counts of scraps in 30, so equal rates are equal. The largest increase wins,
    then the larger event rate, then the earliest position.
    """
    scrap = is_detector_scrap(F.col("scrap_flag"), F.col("part_quality_status")).cast("int")
    rows = cycles.select(*GROUP, *CYCLE_ORDER, "defect_type", scrap.alias("_scrap"))
    key = F.struct(*CYCLE_ORDER)

    def between(w: WindowSpec, name: str) -> tuple[Column, Column]:
        """Differences of a running sum over the `minimum` rows before a row and the `minimum` from it on."""
        past = lambda n: F.coalesce(F.lag(name, n).over(w), F.lit(0))
        return past(1) - past(minimum + 1), F.lead(name, minimum - 1).over(w) - past(1)

    known = lambda w, i: F.when(between(w, "_flags")[i] > 0, between(w, "_scraps")[i])
    swept = framed(
        rows,
        GROUP,
        CYCLE_ORDER,
        {
            "_n_before": lambda w: between(w, "_rows")[0],
            "_before": lambda w: known(w, 0),
            "_n_event": lambda w: between(w, "_rows")[1],
            "_event": lambda w: known(w, 1),
            "_end": lambda w: F.lead(key, minimum - 1).over(w),
        },
        minimum,
        minimum - 1,
        budget,
        {"_rows": F.lit(1).cast("long"), "_flags": F.col("_scrap").isNotNull().cast("long"), "_scraps": F.col("_scrap").cast("long")},
    )
    rise = F.col("_event") - F.col("_before")
    strong = (
        (F.col("_n_before") == minimum)
        & (F.col("_n_event") == minimum)
        & (F.col("_event") / minimum >= MIN_EVENT_RATE)
        & (F.col("_event") / minimum - F.col("_before") / minimum >= MIN_INCREASE)
    )
    best = (
        swept.where(strong)
        .groupBy(*GROUP)
        .agg(
            F.min(
                F.struct(
                    (-rise).alias("neg_rise"),
                    (-F.col("_event")).alias("neg_event"),
                    key.alias("start"),
                    F.col("_before").alias("before"),
                    F.col("_end").alias("end"),
                )
            ).alias("b")
        )
        .select(
            *GROUP,
            F.col("b.start").alias("_start"),
            F.col("b.end").alias("_end"),
            F.col("b.start.time").alias("started_at"),
            F.col("b.end.time").alias("ended_at"),
            (F.col("b.before") / minimum).alias("baseline_rate"),
            (-F.col("b.neg_event") / minimum).alias("incident_rate"),
        )
    )
    cutoffs = rows.groupBy(*GROUP).agg(F.max("time").alias("data_cutoff"))
    # the 30 event rows of each winner, by their unique order keys
    spans = best.select(*[F.col(k).alias(f"_{k}") for k in GROUP], "_start", "_end")
    event = rows.join(
        spans,
        (F.col("site_id") == F.col("_site_id"))
        & (F.col("machine_id") == F.col("_machine_id"))
        & F.col("production_order_id").eqNullSafe(F.col("_production_order_id"))
        & (key >= F.col("_start"))
        & (key <= F.col("_end")),
    )
    defects = most_common(event.select(*GROUP, "time", "defect_type"), GROUP, "defect_type", "time")
    with_cutoff = join_null_safe(best.drop("_start", "_end"), cutoffs, GROUP)
    return join_null_safe(with_cutoff, defects.drop("count"), GROUP, "left")


def _iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def burst_incidents(bursts: DataFrame) -> DataFrame:
    """Incident records of detected bursts with their deterministic detection key."""
    return bursts.select(
        *SITE_MACHINE,
        "production_order_id",
        F.when(F.col("production_order_id").isNotNull(), F.col("site_id")).alias("order_site_id"),
        F.lit("open").alias("status"),
        F.when(F.col("incident_rate") >= CRITICAL_RATE, "critical").otherwise("high").alias("severity"),
        F.concat(F.coalesce("defect_type", F.lit("scrap")), F.lit("_increase")).alias("symptom"),
        "defect_type",
        "started_at",
        "ended_at",
        "data_cutoff",
        F.lit("high").alias("confidence"),
        key_hash(
            F.lit(DETECTOR_VERSION),
            F.col("site_id"),
            F.col("machine_id"),
            F.coalesce("production_order_id", F.lit("none")),
            _iso(F.col("started_at")),
            _iso(F.col("ended_at")),
        ).alias("detection_key"),
    )


def detect_after_import(
    cycles: DataFrame, batch: DataFrame, incidents: DataFrame | None = None, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """New incidents caused by a committed batch: valid history of its machines up to the batch.

    Incidents whose detection key is already present are left out, so a rerun adds nothing.
    """
    history = affected_history(cycles.where(is_valid_data(F.col("data_quality_status"))), batch)
    found = burst_incidents(scrap_bursts(history, budget=budget)).dropDuplicates(["detection_key"])
    return found if incidents is None else new_rows(found, incidents, ["detection_key"])
