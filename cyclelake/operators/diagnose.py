"""Cause ranking for all incidents in one job.

Every incident gets one wide row of statistics over its event window, its baseline and its
context texts; the causes are scored by column arithmetic on that row and ranked within it.
Insufficient data is a status, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.functions.hashing import key_hash
from cyclelake.functions.text import defect_tokens, mentions
from cyclelake.functions.times import HOUR, MINUTE, micros
from cyclelake.functions.values import finite, is_scrap, is_valid_data, order_matches, order_related
from cyclelake.operators.intervals import points_in_windows
from cyclelake.operators.ordered import (
    Budget,
    DEFAULT_BUDGET,
    exact_medians,
    exact_quantiles,
    row_positions,
    running_sums,
)
from cyclelake.schema import CYCLE_ORDER, SITE_MACHINE
from cyclelake.session import stored

# --- fixed values ---------------------------------------------------------------------
BASELINE_ROWS = 2000
CONTEXT_HOURS = 6
TOP_CAUSES = 2
MIN_SCORE = 2.0
TEXT_ROWS = 10
CAUSES = {
    "low_barrel_temperature_zone_2": (
        "Température zone 2 trop basse",
        ["short_shot"],
        "inspect_barrel_zone_2_heating",
    ),
    "high_injection_pressure_low_clamp_force": (
        "Pression d'injection élevée et effort de verrouillage insuffisant",
        ["flash"],
        "compare_peak_pressure_and_clamp_force_to_order_nominal",
    ),
    "unstable_cooling_mold_temperature": (
        "Refroidissement et température du moule instables",
        ["warpage"],
        "trend_cooling_time_and_mold_temperature_by_cycle",
    ),
    "material_change_incomplete_purge": (
        "Changement de matière avec purge ou séchage insuffisant",
        ["bubbles"],
        "verify_material_drying_and_purge_after_lot_change",
    ),
    "restart_thermal_instability": (
        "Redémarrage après arrêt et instabilité thermique transitoire",
        ["multiple", "short_shot", "flash", "sink_mark"],
        "verify_restart_sequence_and_wait_for_thermal_steady_state",
    ),
    "progressive_mold_wear_dimension_drift": (
        "Usure progressive du moule et dérive dimensionnelle",
        ["dimension_out_of_tolerance"],
        "inspect_mold_cavity_dimensions_and_tool_wear",
    ),
}
RESTART, WEAR = "restart_thermal_instability", "progressive_mold_wear_dimension_drift"
RESTART_DEFECTS = ["short_shot", "flash", "sink_mark"]
SYMPTOMS = {
    "short_shot": "short_shot_increase",
    "flash": "flash_increase",
    "bubbles": "bubbles_increase",
    "warpage": "warpage_increase",
    "dimension_out_of_tolerance": "dimension_drift",
    "multiple": "quality_anomaly",
}
# --------------------------------------------------------------------------------------
MEDIANS = ["barrel_temp_zone2_c", "peak_pressure_bar", "clamp_force_kn"]
MEANS = ["injection_time_s", "energy_kwh"]
SPREADS = ["cooling_time_s", "mold_temperature_c", "barrel_temp_zone1_c", "barrel_temp_zone2_c"]
METRICS = list(dict.fromkeys([*MEDIANS, *MEANS, *SPREADS]))

EVENT_COLUMNS = [
    "incident_id",
    *CYCLE_ORDER,
    "scrap_flag",
    "part_quality_status",
    "defect_type",
    "quality_flag",
    *METRICS,
]

# what a baseline is found by, and what its statistics need
BASELINE_KEYS = [*SITE_MACHINE, *CYCLE_ORDER, "production_order_id", "order_site_id", "data_quality_status"]
BASELINE_COLUMNS = [*BASELINE_KEYS, "scrap_flag", "part_quality_status", *METRICS]


@dataclass(frozen=True)
class Policy:
    """Sample minimums and abstention of an investigation."""

    minimum_event: int = 3
    minimum_baseline: int = 3
    minimum_quality: int = 2
    abstain: bool = True
    baseline_multiplier: float = 1.0


def incident_windows(incidents: DataFrame, policy: Policy = Policy(), as_of: str | None = None) -> DataFrame:
    """Event, baseline and context bounds per incident, and `window_status`.

    Needs incident_id, site_id, machine_id, production_order_id, started_at, ended_at,
    data_cutoff and defect_type.
    """
    asked_end = F.coalesce("ended_at", "data_cutoff")
    cutoff = F.lit(as_of).cast("timestamp") if as_of else asked_end
    start, end = F.col("started_at"), F.least(asked_end, cutoff)
    length = F.greatest(micros(end) - micros(start), F.lit(MINUTE))
    back = (length * F.lit(policy.baseline_multiplier)).cast("long")
    return incidents.select(
        "incident_id",
        *SITE_MACHINE,
        F.col("production_order_id").alias("requested_order"),
        F.col("defect_type").alias("requested_defect"),
        start.alias("event_start"),
        end.alias("event_end"),
        F.timestamp_micros(micros(start) - back).alias("baseline_start"),
        F.timestamp_micros(micros(start) - CONTEXT_HOURS * HOUR).alias("context_start"),
        F.least(F.timestamp_micros(micros(end) + CONTEXT_HOURS * HOUR), cutoff).alias("context_end"),
        F.when(cutoff < start, "cutoff_before_start")
        .when(end < start, "end_before_start")
        .otherwise("ok")
        .alias("window_status"),
    )


def first_per_incident(rows: DataFrame, ref: str, n: int) -> DataFrame:
    """The n earliest rows of each incident."""
    early = Window.partitionBy("incident_id").orderBy("time", ref)
    return rows.withColumn("_n", F.row_number().over(early)).where(F.col("_n") <= n).drop("_n")


def event_cycles(windows: DataFrame, cycles: DataFrame) -> DataFrame:
    """Valid cycles inside each incident's window that match its order (or order range)."""
    spans = windows.select("incident_id", *SITE_MACHINE, "requested_order", "event_start", "event_end")
    rows = points_in_windows(
        cycles.where(is_valid_data(F.col("data_quality_status"))), spans, "time", "event_start", "event_end"
    )
    return rows.where(order_matches(F.col("production_order_id"), F.col("requested_order")))


def event_checks(windows: DataFrame, checks: DataFrame) -> DataFrame:
    spans = windows.select("incident_id", *SITE_MACHINE, "requested_order", "event_start", "event_end")
    rows = points_in_windows(
        checks.where(is_valid_data(F.col("data_quality_status"))), spans, "time", "event_start", "event_end"
    )
    return rows.where(order_matches(F.col("production_order_id"), F.col("requested_order")))


def context_rows(windows: DataFrame, table: DataFrame, ref: str) -> DataFrame:
    """The first ten notes or maintenance events around each incident that concern its order."""
    spans = windows.select("incident_id", *SITE_MACHINE, "requested_order", "context_start", "context_end")
    rows = points_in_windows(table, spans, "time", "context_start", "context_end")
    related = rows.where(order_related(F.col("production_order_id"), F.col("requested_order")))
    return first_per_incident(related, ref, TEXT_ROWS)


def window_baseline(windows: DataFrame, cycles: DataFrame) -> DataFrame:
    """Baseline of the same length just before each incident, for sources without order context."""
    spans = windows.select("incident_id", *SITE_MACHINE, "baseline_start", "event_start")
    return points_in_windows(
        cycles.where(is_valid_data(F.col("data_quality_status"))), spans, "time", "baseline_start", "event_start"
    ).drop("baseline_start", "event_start")


def comparable_baseline(
    windows: DataFrame,
    cycles: DataFrame,
    orders: DataFrame,
    minimum: int,
    limit: int = BASELINE_ROWS,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Newest prior cycles in the most specific order context that has enough of them.

    Contexts: same product, tool and material; same tool and material; same product; any.
    Cycles are numbered within each context, so an incident's baseline is a range of numbers
    and is fetched by an equi-join on blocks of `limit` numbers. No incident is paired with
    its whole history. The columns of `cycles` are stored on the way, so give those needed only.
    """
    context = orders.select(
        F.col("site_id").alias("_site"),
        F.col("id").alias("_order"),
        F.col("machine_id").alias("_order_machine"),
        "product_ref",
        "tool_ref",
        "material_ref",
    )
    asked = windows.join(
        context,
        (F.col("site_id") == F.col("_site"))
        & (F.col("requested_order") == F.col("_order"))
        & (F.col("machine_id") == F.col("_order_machine")),
        "left",
    ).select("incident_id", *SITE_MACHINE, F.col("event_start").alias("time"), "product_ref", "tool_ref", "material_ref")
    involved = windows.groupBy(*SITE_MACHINE).agg(F.max("event_start").alias("_last"))
    history = (
        cycles.where(is_valid_data(F.col("data_quality_status")))
        .where(F.col("order_site_id").isNull() | (F.col("order_site_id") == F.col("site_id")))
        .join(involved, SITE_MACHINE)
        .where(F.col("time") < F.col("_last"))
        .drop("_last")
        .join(
            context.drop("_order_machine"),
            (F.col("order_site_id") == F.col("_site")) & (F.col("production_order_id") == F.col("_order")),
            "left",
        )
        .drop("_site", "_order")
    )
    tiers = [["product_ref", "tool_ref", "material_ref"], ["tool_ref", "material_ref"], ["product_ref"], []]
    contexts = []
    for level, keys in enumerate(tiers):
        # null outside the tier's own keys, so that all tiers share one context key
        key = F.struct(*[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in tiers[0]])
        usable = F.lit(True)
        for k in keys:
            usable = usable & F.col(k).isNotNull()
        contexts.append(F.when(usable, F.struct(F.lit(level).alias("_tier"), key.alias("_context"))))
    spread = F.inline(F.array_compact(F.array(*contexts)))
    marks = stored(asked.select("incident_id", *SITE_MACHINE, "time", spread))
    rows = history.select(*cycles.columns, spread)
    group = ["_tier", "_context", *SITE_MACHINE]
    # only the contexts some incident asks for are numbered; most rows of the at most four tiers go before the shuffle
    rows = rows.join(F.broadcast(marks.select("_tier").distinct()), "_tier", "left_semi")
    rows = rows.join(marks.select(*group).distinct(), group, "left_semi")
    # rows to number are counted, and numbered ones read twice
    numbered = stored(rows.unionByName(marks, allowMissingColumns=True))
    # a mark stands before the cycles of its own instant
    counted = stored(running_sums(
        numbered.withColumn("_is_cycle", F.col("incident_id").isNull().cast("long")),
        group,
        ["time", "_is_cycle", *CYCLE_ORDER[1:], "incident_id"],
        {"_number": F.col("_is_cycle")},
        budget,
    ))
    chosen = (
        counted.where(F.col("incident_id").isNotNull() & (F.col("_number") >= minimum))
        .groupBy("incident_id", *SITE_MACHINE)
        .agg(F.min(F.struct("_tier", "_context", "_number")).alias("c"))
        .select("incident_id", *SITE_MACHINE, "c._tier", "c._context", F.col("c._number").alias("_upto"))
    )
    oldest = F.greatest(F.col("_upto") - limit, F.lit(0))
    wanted = chosen.withColumn(
        "_block", F.explode(F.sequence(F.floor(oldest / limit), F.floor((F.col("_upto") - 1) / limit)))
    )
    placed = counted.where(F.col("incident_id").isNull()).drop("incident_id").withColumn(
        "_block", F.floor((F.col("_number") - 1) / limit)
    )
    return (
        placed.join(wanted, ["_tier", "_context", *SITE_MACHINE, "_block"])
        .where((F.col("_number") <= F.col("_upto")) & (F.col("_number") > F.col("_upto") - limit))
        .withColumn("baseline_tier", F.col("_tier") + 1)
        .drop("_tier", "_context", "_block", "_number", "_upto", "_is_cycle")
    )


def side_statistics(event: DataFrame, baseline: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Counts, scrap, means, spreads and medians of both sides, one row per incident.

    Columns are prefixed `ev_` and `bl_`; a population spread needs two values.
    """
    ev, bl = _one_side(event, "ev", budget), _one_side(baseline, "bl", budget)
    counts = [f"{s}_{n}" for s in ("ev", "bl") for n in ("cycles", "scrap", *[f"n_{m}" for m in METRICS])]
    both = ev.join(bl.withColumnRenamed("incident_id", "_other"), F.col("incident_id").eqNullSafe(F.col("_other")), "full")
    both = both.withColumn("incident_id", F.coalesce("incident_id", "_other")).drop("_other")
    rates = {f"{s}_rate": F.when(F.col(f"{s}_cycles") > 0, F.col(f"{s}_scrap") / F.col(f"{s}_cycles")) for s in ("ev", "bl")}
    return both.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}).withColumns(rates)


def _one_side(rows: DataFrame, side: str, budget: Budget) -> DataFrame:
    """The statistics of one side; its rows are stored, as sums and medians are taken in passes of their own."""
    scrap = is_scrap(F.col("scrap_flag"), F.col("part_quality_status")).cast("int").alias("_scrap")
    kept = stored(rows.select("incident_id", *[finite(F.col(m)).alias(m) for m in METRICS], scrap))
    sums = kept.groupBy("incident_id").agg(
        F.count("*").alias(f"{side}_cycles"),
        F.coalesce(F.sum("_scrap"), F.lit(0)).cast("bigint").alias(f"{side}_scrap"),
        *[F.count(m).alias(f"{side}_n_{m}") for m in METRICS],
        *[F.avg(m).alias(f"{side}_mean_{m}") for m in MEANS],
        *[F.when(F.count(m) >= 2, F.stddev_pop(m)).alias(f"{side}_sd_{m}") for m in SPREADS],
    )
    medians = exact_medians(kept, "incident_id", MEDIANS, budget).withColumnsRenamed({m: f"{side}_median_{m}" for m in MEDIANS})
    return sums.join(medians, "incident_id", "left")


def early_late_rates(event: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Scrap rate of the first and of the second half of each incident's cycles."""
    scrap = is_scrap(F.col("scrap_flag"), F.col("part_quality_status")).cast("int")
    rows = event.select("incident_id", *CYCLE_ORDER, scrap.alias("_scrap"))
    sizes = rows.groupBy("incident_id").agg(F.count("*").alias("_n"))
    placed = row_positions(rows, ["incident_id"], CYCLE_ORDER, "_p", budget).join(sizes, "incident_id")
    half = F.floor(F.col("_n") / 2)
    first = F.col("_p") <= F.greatest(F.lit(1), half)
    second = F.col("_p") > half
    return placed.groupBy("incident_id").agg(
        F.avg(F.when(first, F.col("_scrap"))).alias("early_rate"),
        F.avg(F.when(second, F.col("_scrap"))).alias("late_rate"),
        F.count_if(first).alias("early_n"),
        F.count_if(second).alias("late_n"),
    )


def defect_counts(event: DataFrame, checks: DataFrame) -> DataFrame:
    """Defect words per incident with their weight, from cycles and from checks.

    A row without a defect type falls back to its quality flag; a check weighs its defect
    count, where 0 or none counts as 1.
    """
    by_cycle = event.select(
        "incident_id",
        F.lit(False).alias("from_check"),
        _tokens(F.col("defect_type"), F.col("quality_flag")).alias("t"),
        F.lit(1).cast("bigint").alias("w"),
    )
    count = F.coalesce(F.col("defect_count").cast("bigint"), F.lit(0))
    flag = F.col("quality_flag") if "quality_flag" in checks.columns else F.lit(None).cast("string")
    by_check = checks.select(
        "incident_id",
        F.lit(True).alias("from_check"),
        _tokens(F.col("defect_type"), flag).alias("t"),
        F.when(count == 0, 1).otherwise(count).cast("bigint").alias("w"),
    )
    return (
        by_cycle.unionByName(by_check)
        .select("incident_id", "from_check", F.explode("t").alias("defect"), "w")
        .groupBy("incident_id", "from_check", "defect")
        .agg(F.sum("w").alias("weight"))
    )


def _tokens(defect: Column, flag: Column) -> Column:
    own = defect_tokens(defect)
    return F.when(F.size(own) > 0, own).otherwise(defect_tokens(flag))


def trends(checks: DataFrame, values: list[str], budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Per incident and value: slope per day, last-quarter minus first-quarter median, count.

    Slope and difference need three values.
    """
    long = checks.select("incident_id", "time", "quality_check_id", "event_start", *values).unpivot(
        ["incident_id", "time", "quality_check_id", "event_start"], values, "value_name", "value"
    )
    rows = long.withColumn("value", finite(F.col("value"))).where(
        F.col("value").isNotNull() & F.col("time").isNotNull()
    )
    keys = ["incident_id", "value_name"]
    day = (micros(F.col("time")) - micros(F.col("event_start"))) / F.lit(86400e6)
    fits = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("value", day).alias("slope"))
    placed = row_positions(rows, keys, ["time", "quality_check_id"], "_p", budget).join(
        fits.select(*keys, "n"), keys
    )
    quarter = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    parts = F.array_compact(
        F.array(
            F.when(F.col("_p") <= quarter, F.lit("first")),
            F.when(F.col("_p") > F.col("n") - quarter, F.lit("last")),
        )
    )
    ends = placed.where(F.col("n") >= 3).select(*keys, "value", F.explode(parts).alias("part"))
    medians = exact_quantiles(ends, [*keys, "part"], "value", {"median": 0.5}, budget)
    edge = lambda part: F.max(F.when(F.col("part") == part, F.col("median")))
    deltas = medians.groupBy(*keys).agg((edge("last") - edge("first")).alias("delta"))
    return fits.join(deltas, keys, "left").select(
        *keys, "n", F.when(F.col("n") >= 3, F.col("slope")).alias("slope_per_day"), "delta"
    )


def incident_context(incidents: DataFrame, cycles: DataFrame, checks: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Cycle and check figures inside each incident, as differences of running sums.

    Each incident stands as two marks in the ordered rows of its machine, so no incident meets its rows, however many overlap.
    Temperatures are summed as decimals of nine digits, so differences stay exact; values that are not finite are passed over.
    """
    digits = "decimal(38,9)"
    spans = incidents.select("incident_id", *SITE_MACHINE, "started_at", F.coalesce("ended_at", "data_cutoff").alias("_until"))
    spans = spans.where(F.col("_until") >= F.col("started_at"))
    marks = spans.select("incident_id", *SITE_MACHINE, F.inline(F.array(F.struct(F.col("started_at").alias("time"), F.lit(0).alias("_kind")), F.struct(F.col("_until").alias("time"), F.lit(2).alias("_kind")))))
    named = lambda df, **columns: df.where(F.col("time").isNotNull()).select(*SITE_MACHINE, "time", F.lit(1).alias("_kind"), *[c.alias(n) for n, c in columns.items()])
    zone, scrap = finite(F.col("barrel_temp_zone2_c")), F.col("scrap_flag").cast("int")
    rows = named(cycles, cycle=F.lit(1), zone=zone.cast(digits), zones=zone.isNotNull().cast("int"), scrap=F.coalesce(scrap, F.lit(0)), flags=scrap.isNotNull().cast("int"))
    rows = rows.unionByName(named(checks, check=F.col("quality_check_id").isNotNull().cast("int")), allowMissingColumns=True)
    names = ["cycle", "zones", "scrap", "flags", "check"]
    sums = {f"_{n}": F.coalesce(F.col(n), F.lit(0)).cast("long") for n in names} | {"_zone": F.coalesce("zone", F.lit(0).cast(digits))}
    summed = running_sums(rows.unionByName(marks, allowMissingColumns=True), SITE_MACHINE, ["time", "_kind", "incident_id"], sums, budget)
    upto = lambda name, kind: F.max(F.when(F.col("_kind") == kind, F.col(name)))
    made = summed.where(F.col("_kind") != 1).groupBy("incident_id").agg(*[(upto(n, 2) - upto(n, 0)).alias(n) for n in sums])
    share = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0))
    return (
        incidents.select("incident_id", *SITE_MACHINE, "production_order_id", "started_at", "ended_at")
        .join(made, "incident_id", "left")
        .select(
            "incident_id",
            *SITE_MACHINE,
            "production_order_id",
            "started_at",
            "ended_at",
            F.coalesce("_cycle", F.lit(0)).cast("bigint").alias("cycle_count"),
            share("_zone", "_zones").alias("avg_zone2_temp_c"),
            share("_scrap", "_flags").alias("scrap_rate"),
            F.coalesce("_check", F.lit(0)).cast("bigint").alias("quality_check_count"),
        )
    )


def candidate_confidence(score: Column, support: Column, missing: Column) -> Column:
    value = F.least(
        F.lit(0.97),
        F.lit(0.36) + F.lit(0.075) * F.least(score, F.lit(7.0)) + F.lit(0.04) * F.least(support, F.lit(4)),
    )
    return F.round(F.when(missing, F.least(value, F.lit(0.62))).otherwise(value), 4)


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _points(condition: Column, points: float) -> Column:
    return F.when(_holds(condition), F.lit(points)).otherwise(F.lit(0.0))


def collect_facts(
    incidents: DataFrame,
    cycles: DataFrame,
    checks: DataFrame,
    notes: DataFrame,
    maintenance: DataFrame,
    orders: DataFrame | None = None,
    policy: Policy = Policy(),
    as_of: str | None = None,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """One stored wide row per incident with everything the cause rules look at, signals included."""
    # read by every part; the incidents may be views over large tables
    windows = stored(incident_windows(incidents, policy, as_of))
    usable = windows.where(F.col("window_status") == "ok")
    # each side feeds several aggregations
    event = stored(event_cycles(usable, cycles).select(*EVENT_COLUMNS))
    if orders is None:
        baseline = window_baseline(usable, cycles)
    else:
        baseline = comparable_baseline(usable, cycles.select(*BASELINE_COLUMNS), orders, policy.minimum_baseline, budget=budget)
    quality = stored(event_checks(usable, checks))
    words = defect_counts(event, quality)
    observed = words.groupBy("incident_id").agg(
        F.collect_set("defect").alias("observed"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("from_check"), F.struct("defect", "weight")))
        ).alias("check_defects"),
    )
    note_rows = context_rows(usable, notes, "note_id").groupBy("incident_id").agg(
        F.count("*").alias("n_notes"),
        F.sort_array(F.collect_list(F.struct("time", F.col("note_id").alias("ref"), F.col("note_text").alias("excerpt")))).alias(
            "notes"
        ),
    )
    stop_rows = context_rows(usable, maintenance, "event_id").groupBy("incident_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "time",
                    F.col("event_id").alias("ref"),
                    F.col("description").alias("excerpt"),
                    "event_type",
                    "duration_min",
                    "severity",
                )
            )
        ).alias("stops"),
    )
    trend = trends(quality, ["dimension_deviation_mm", "measured_weight_g"], budget)
    shape = trend.groupBy("incident_id").agg(
        *[
            F.max(F.when(F.col("value_name") == source, F.col(column))).alias(f"{short}_{column}")
            for source, short in (("dimension_deviation_mm", "dim"), ("measured_weight_g", "weight"))
            for column in ("slope_per_day", "delta", "n")
        ]
    )
    check_count = quality.groupBy("incident_id").agg(F.count("*").alias("checks"))
    joined = windows
    for part in (
        side_statistics(event, baseline, budget),
        early_late_rates(event, budget),
        check_count,
        observed,
        note_rows,
        stop_rows,
        shape,
    ):
        joined = joined.join(part, "incident_id", "left")
    zero = ["ev_cycles", "bl_cycles", "checks", "n_notes", "dim_n", "weight_n"]
    zero += [f"ev_n_{m}" for m in METRICS]
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zero})
    requested = defect_tokens(F.col("requested_defect"))
    named = F.lower(F.col("requested_defect"))
    facts = filled.withColumns(
        {
            "observed": F.coalesce("observed", F.array().cast("array<string>")),
            "expected": F.when(F.size(requested) > 0, requested)
            .when(F.coalesce(named, F.lit("")) != "", F.array(named))
            .otherwise(F.array().cast("array<string>")),
            "notes": F.coalesce(
                "notes", F.array().cast("array<struct<time:timestamp,ref:string,excerpt:string>>")
            ),
            "stops": F.coalesce(
                "stops",
                F.array().cast(
                    "array<struct<time:timestamp,ref:string,excerpt:string,event_type:string,"
                    "duration_min:double,severity:string>>"
                ),
            ),
        }
    )
    return stored(add_signals(facts, policy))


def add_signals(facts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add the boolean signals, text hit counts, missing fields and outcome of each incident."""
    c = F.col
    hits = lambda rows, group: F.size(F.filter(c(rows), lambda r: mentions(r.excerpt, group)))
    temp, base_temp = c("ev_median_barrel_temp_zone2_c"), c("bl_median_barrel_temp_zone2_c")
    inj, base_inj = c("ev_mean_injection_time_s"), c("bl_mean_injection_time_s")
    press, base_press = c("ev_median_peak_pressure_bar"), c("bl_median_peak_pressure_bar")
    clamp, base_clamp = c("ev_median_clamp_force_kn"), c("bl_median_clamp_force_kn")
    cool, base_cool = c("ev_sd_cooling_time_s"), c("bl_sd_cooling_time_s")
    mold, base_mold = c("ev_sd_mold_temperature_c"), c("bl_sd_mold_temperature_c")
    energy, base_energy = c("ev_mean_energy_kwh"), c("bl_mean_energy_kwh")
    signals = {
        "scrap_up": c("ev_rate").isNotNull() & (c("bl_rate").isNull() | (c("ev_rate") > c("bl_rate"))),
        "has_check_defects": F.size(c("check_defects")) > 0,
        "zone2_cold": temp < 205,
        "zone2_drop": temp - base_temp <= -3,
        "zone2_support": (temp < 205) & (base_temp.isNull() | (temp - base_temp <= -3)),
        "injection_shift": F.abs(inj - base_inj) >= 0.1,
        "pressure_high": (press > 900) | _holds(press > base_press * 1.05),
        "clamp_low": clamp < base_clamp * 0.97,
        "cooling_unstable": cool.isNotNull()
        & (base_cool.isNull() | (cool > F.greatest(F.lit(2.5), base_cool * 1.5))),
        "mold_unstable": mold.isNotNull()
        & (base_mold.isNull() | (mold > F.greatest(F.lit(3.0), base_mold * 1.35))),
        "energy_up": energy > base_energy * 1.05,
        "early_scrap": c("early_rate") > c("late_rate") + 0.05,
        "thermal_unstable": _holds(c("ev_sd_barrel_temp_zone1_c") >= 3)
        | _holds(c("ev_sd_barrel_temp_zone2_c") >= 3),
        "dimension_drift": (c("dim_slope_per_day") > 0.02) & (c("dim_delta") > 0.05),
        "weight_shift": F.abs(c("weight_delta")) > 0.2,
    }
    counts = {
        "n_zone2_notes": hits("notes", "zone_2_note"),
        "n_material_notes": hits("notes", "material_note"),
        "n_wear_notes": hits("notes", "wear_note"),
        "n_material_changes": hits("stops", "material_change"),
        "n_restarts": hits("stops", "restart"),
    }
    few_event = c("ev_cycles") < policy.minimum_event
    few_base = c("bl_cycles") < policy.minimum_baseline
    missing = F.array_compact(
        F.array(
            F.when(few_event, F.lit("event_cycles")),
            F.when(c("checks") < policy.minimum_quality, F.lit("quality_checks")),
            F.when(few_base, F.lit("baseline_cycles")),
        )
    )
    adequate = (
        F.when(c("window_status") != "ok", c("window_status"))
        .when((c("ev_cycles") == 0) & (c("checks") == 0), F.lit("no_data"))
        .when((few_event | few_base) & F.lit(policy.abstain), F.lit("insufficient_samples"))
        .otherwise(F.lit("ok"))
    )
    return facts.withColumns(
        {**{k: _holds(s) for k, s in signals.items()}, **counts, "missing": missing, "adequacy": adequate}
    )


def _candidates() -> Column:
    """Array of the six causes with score, support count and their own missing fields."""
    c = F.col
    seen = lambda defect: F.array_contains(c("observed"), defect)
    asked = lambda defect: F.array_contains(c("expected"), defect)
    support = lambda *flags: sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    absent = lambda *metrics: F.array_compact(
        F.array(*[F.when(c(f"ev_n_{m}") == 0, F.lit(m)) for m in metrics])
    )
    nothing = F.array().cast("array<string>")
    scrap, checked = c("scrap_up"), c("has_check_defects")
    restart_seen = F.size(F.array_intersect(c("observed"), F.array(*[F.lit(d) for d in RESTART_DEFECTS])))
    restart_asked = F.arrays_overlap(c("expected"), F.array(*[F.lit(d) for d in RESTART_DEFECTS]))
    rules = {
        "low_barrel_temperature_zone_2": (
            _points(c("zone2_cold"), 3.0)
            + _points(c("zone2_drop"), 1.5)
            + _points(seen("short_shot"), 1.8)
            + _points(c("n_zone2_notes") > 0, 1.0)
            + _points(asked("short_shot"), 0.8),
            support(c("zone2_support"), c("injection_shift"), scrap, checked) + c("n_notes").cast("int"),
            absent("barrel_temp_zone2_c"),
        ),
        "high_injection_pressure_low_clamp_force": (
            _points(c("pressure_high"), 2.8)
            + _points(c("clamp_low"), 2.2)
            + _points(seen("flash"), 2.0)
            + _points(asked("flash"), 0.8),
            support(c("pressure_high"), c("clamp_low"), scrap, checked),
            absent("peak_pressure_bar", "clamp_force_kn"),
        ),
        "unstable_cooling_mold_temperature": (
            _points(c("cooling_unstable"), 2.4)
            + _points(c("mold_unstable"), 1.8)
            + _points(c("energy_up"), 1.0)
            + _points(seen("warpage"), 2.0)
            + _points(asked("warpage"), 0.8),
            support(c("cooling_unstable"), c("mold_unstable"), c("energy_up"), scrap, checked),
            absent("cooling_time_s", "mold_temperature_c"),
        ),
        "material_change_incomplete_purge": (
            _points(c("n_material_changes") > 0, 3.0)
            + _points(c("n_material_notes") > 0, 1.6)
            + _points(seen("bubbles"), 2.0)
            + _points(asked("bubbles"), 0.8),
            support(scrap, checked) + c("n_material_changes") + c("n_material_notes"),
            nothing,
        ),
        RESTART: (
            _points(c("n_restarts") > 0, 3.2)
            + _points(c("early_scrap"), 1.5)
            + _points(c("thermal_unstable"), 1.2)
            + _points(restart_seen >= 2, 1.8)
            + _points(restart_asked, 0.8),
            support(c("early_scrap"), c("thermal_unstable"), scrap, checked)
            + c("n_restarts")
            + c("n_notes").cast("int"),
            nothing,
        ),
        WEAR: (
            _points(c("dimension_drift"), 3.8)
            + _points(c("weight_shift"), 0.8)
            + _points(c("n_wear_notes") > 0, 1.6)
            + _points(asked("dimension_out_of_tolerance"), 1.2),
            support(c("dimension_drift"), c("weight_shift"), checked) + c("n_wear_notes"),
            F.array_compact(F.array(F.when(c("dim_n") < 3, F.lit("dimension_deviation_mm")))),
        ),
    }
    rows = []
    for code, (score, backing, lacking) in rules.items():
        label, hints, check = CAUSES[code]
        hint_list = F.array(*[F.lit(h) for h in hints])
        gate = (F.size("expected") == 0) | F.arrays_overlap(c("expected"), hint_list)
        if code == RESTART:
            gate = gate & (asked("multiple") | (c("n_restarts") > 0))
        elif code != WEAR:
            gate = gate & F.arrays_overlap(c("observed"), hint_list)
        lacks = F.array_distinct(F.concat(c("missing"), lacking))
        rows.append(
            F.struct(
                F.lit(code).alias("cause_code"),
                F.lit(label).alias("label"),
                F.lit(check).alias("next_check"),
                # scores are sums of tenths
                F.round(score, 1).alias("score"),
                backing.cast("int").alias("support_count"),
                lacks.alias("missing"),
                _holds(gate).alias("relevant"),
            )
        )
    return F.array(*rows)


def score_causes(facts: DataFrame) -> DataFrame:
    """Add `candidates`: the six scored causes of every incident, irrelevant ones included."""
    return facts.withColumn("candidates", _candidates())


def rank_causes(scored: DataFrame) -> DataFrame:
    """Keep the two best relevant causes from score 2.0 on and derive the incident's outcome."""
    ranked = F.slice(
        F.sort_array(
            F.transform(
                F.filter("candidates", lambda x: x.relevant & (x.score >= MIN_SCORE)),
                lambda x: F.struct(
                    (-x.score).alias("neg_score"),
                    x.cause_code.alias("cause_code"),
                    x.label.alias("label"),
                    candidate_confidence(x.score, x.support_count, F.size(x.missing) > 0).alias("confidence"),
                    x.support_count.alias("support_count"),
                    x.missing.alias("missing"),
                    x.next_check.alias("next_check"),
                ),
            )
        ),
        1,
        TOP_CAUSES,
    )
    usable = F.when(F.col("adequacy") == "ok", ranked)
    best = F.array_max(F.transform("hypotheses", lambda h: h.confidence))
    symptom = F.lit("quality_anomaly")
    for defect, name in SYMPTOMS.items():
        symptom = F.when(F.lower("requested_defect") == defect, F.lit(name)).otherwise(symptom)
    return (
        scored.withColumn("hypotheses", usable)
        .withColumns(
            {
                "status": F.when(F.col("adequacy") != "ok", F.col("adequacy"))
                .when(F.size("hypotheses") == 0, "no_hypothesis")
                .otherwise("completed"),
                "data_quality": F.when(F.array_contains("missing", "baseline_cycles"), "insufficient_baseline")
                .when(F.size("missing") > 0, "insufficient_samples")
                .otherwise("sufficient"),
                "severity": F.when(F.col("ev_rate") >= 0.2, "high").otherwise("medium"),
                "symptom": symptom,
                "confidence": F.when(best >= 0.75, "high").when(best >= 0.5, "medium").when(best.isNotNull(), "low"),
            }
        )
    )


def _observation(stat: str, value: Column, unit: str, n: Column) -> Column:
    return F.struct(
        F.lit(stat).alias("stat"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        n.cast("bigint").alias("n"),
    )


def evidence_rows(facts: DataFrame) -> DataFrame:
    """Evidence of every usable incident, one row per (source kind, source, metric).

    Identifiers derive from incident, source and metric, so a rerun gives the same ids.
    """
    c = F.col
    empty = F.lit(None).cast("struct<stat:string,value:double,unit:string,n:bigint>")

    def item(kind, ref, metric, observation, baseline, delta, supports, excerpt=None, keep=None):
        made = F.struct(
            F.lit(kind).alias("source_kind"),
            ref.alias("source_ref"),
            F.lit(metric).alias("metric"),
            observation.alias("observation"),
            baseline.alias("baseline"),
            delta.cast("double").alias("delta"),
            _holds(supports).alias("supports"),
            (excerpt if excerpt is not None else F.lit(None).cast("string")).alias("excerpt"),
        )
        return made if keep is None else F.when(keep, made)

    def aggregate(name, metric, stat, unit, ev, bl, n_ev, n_bl, supports, keep=None):
        ref = F.concat_ws(":", c("machine_id").cast("string"), F.coalesce("requested_order", F.lit("None")), F.lit(name))
        base = F.when(bl.isNotNull(), _observation(stat, bl, unit, n_bl))
        kind = "quality_check" if name in ("quality", "dimension_trend", "weight_trend") else "cycle_aggregate"
        return item(kind, ref, metric, _observation(stat, ev, unit, n_ev), base, ev - bl, supports, keep=keep)

    def two_sided(name, metric, stat, unit, flag, keep=None):
        prefix = {"median": "median", "mean": "mean", "stdev": "sd"}[stat]
        return aggregate(
            name,
            metric,
            stat,
            unit,
            c(f"ev_{prefix}_{metric}"),
            c(f"bl_{prefix}_{metric}"),
            c(f"ev_n_{metric}"),
            c(f"bl_n_{metric}"),
            c(flag),
            keep,
        )

    null = F.lit(None).cast("double")
    single = F.array_compact(
        F.array(
            aggregate("scrap_rate", "scrap_rate", "rate", "fraction", c("ev_rate"), c("bl_rate"), c("ev_cycles"), c("bl_cycles"), c("scrap_up")),
            aggregate(
                "quality",
                "defect_count",
                "count",
                "defects",
                F.coalesce(F.aggregate(F.map_values("check_defects"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)),
                null,
                c("checks"),
                null,
                c("has_check_defects"),
            ),
            two_sided("zone2", "barrel_temp_zone2_c", "median", "C", "zone2_support", c("ev_n_barrel_temp_zone2_c") > 0),
            two_sided("injection_time", "injection_time_s", "mean", "s", "injection_shift", c("ev_n_injection_time_s") > 0),
            two_sided("pressure_clamp", "peak_pressure_bar", "median", "bar", "pressure_high"),
            two_sided("clamp_force", "clamp_force_kn", "median", "kN", "clamp_low"),
            two_sided("cooling", "cooling_time_s", "stdev", "s", "cooling_unstable"),
            two_sided("mold_temperature", "mold_temperature_c", "stdev", "C", "mold_unstable"),
            two_sided("energy", "energy_kwh", "mean", "kWh", "energy_up"),
            aggregate(
                "restart_transition", "early_scrap_rate", "first_half_rate", "fraction",
                c("early_rate"), c("late_rate"), c("early_n"), c("late_n"), c("early_scrap"),
            ),
            aggregate(
                "thermal_stability", "barrel_temperature_stability", "stdev", "C",
                F.greatest(c("ev_sd_barrel_temp_zone1_c"), c("ev_sd_barrel_temp_zone2_c")), null,
                F.least(c("ev_n_barrel_temp_zone1_c"), c("ev_n_barrel_temp_zone2_c")), null, c("thermal_unstable"),
            ),
            aggregate("dimension_trend", "dimension_deviation_mm", "trend", "mm", c("dim_slope_per_day"), null, c("dim_n"), null, c("dimension_drift")),
            aggregate("weight_trend", "measured_weight_g", "trend", "g", c("weight_slope_per_day"), null, c("weight_n"), null, c("weight_shift")),
        )
    )
    # in a lambda the columns of the incident stay visible, the row is the argument
    text = lambda rows, kind, metric: F.transform(
        c(rows),
        lambda r: F.struct(
            F.lit(kind).alias("source_kind"),
            r.ref.alias("source_ref"),
            F.lit(metric).alias("metric"),
            _observation("text", null, "text", F.lit(1)).alias("observation"),
            empty.alias("baseline"),
            null.alias("delta"),
            F.lit(True).alias("supports"),
            r.excerpt.alias("excerpt"),
        ),
    )
    rows = facts.where(F.col("adequacy") == "ok").select(
        "incident_id",
        F.col("event_start").alias("window_start"),
        F.col("event_end").alias("window_end"),
        F.inline(
            F.concat(
                single,
                text("notes", "operator_note", "operator_note"),
                text("stops", "maintenance_event", "maintenance_event"),
            )
        ),
    )
    return rows.withColumn(
        "evidence_id", key_hash(F.col("incident_id"), F.col("source_kind"), F.col("source_ref"), F.col("metric"))
    )


def investigate(
    incidents: DataFrame,
    cycles: DataFrame,
    checks: DataFrame,
    notes: DataFrame,
    maintenance: DataFrame,
    orders: DataFrame | None = None,
    policy: Policy = Policy(),
    as_of: str | None = None,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Ranked causes of all incidents: facts, signals, candidates, hypotheses and outcome."""
    facts = collect_facts(
        incidents, cycles, checks, notes, maintenance, orders, policy, as_of, budget
    )
    return rank_causes(score_causes(facts))


def hypothesis_rows(ranked: DataFrame) -> DataFrame:
    """One row per ranked hypothesis."""
    return ranked.select("incident_id", F.posexplode("hypotheses").alias("_i", "h")).select(
        "incident_id",
        (F.col("_i") + 1).alias("rank"),
        "h.cause_code",
        "h.label",
        (-F.col("h.neg_score")).alias("score"),
        "h.confidence",
        "h.support_count",
        "h.missing",
        "h.next_check",
    )


def run_rows(ranked: DataFrame) -> DataFrame:
    """One run record per incident."""
    return ranked.select(
        "incident_id",
        "site_id",
        "machine_id",
        "status",
        "data_quality",
        "severity",
        "symptom",
        "confidence",
        "event_start",
        "event_end",
    )
