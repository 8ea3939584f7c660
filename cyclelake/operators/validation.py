"""Row validation and data-set invariants.

A check never stops a job: rows carry an `issues` array, and `split_rows` separates the
accepted rows from the dead-letter rows, one per issue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.functions.times import parse_source_time
from cyclelake.functions.values import CYCLE_TIME_RANGE_S, finite
from cyclelake.operators.lookup import with_order_known
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, framed
from cyclelake.schema import (
    CYCLE_ORDER,
    DATE_FIELDS,
    DURATION_FIELDS,
    FEATURE_BOUNDS,
    MAX_PRESSURE_BAR,
    NON_NEGATIVE_FIELDS,
    NUMERIC_FIELDS,
    PRESSURE_FIELDS,
    RAW_FEATURES,
    SITE_MACHINE,
)


def issue(code: str, severity: str, field: str, raw: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("issue_type"),
        F.lit(severity).alias("severity"),
        F.lit(field).alias("field_name"),
        (raw.cast("string") if raw is not None else F.lit(None).cast("string")).alias("raw_value"),
    )


def issue_list(*rules: tuple[Column, Column]) -> Column:
    """Array of the issues whose condition holds."""
    return F.array_compact(F.array(*[F.when(when, what) for when, what in rules]))


def split_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without issues, one dead-letter row per issue with the given key columns)."""
    accepted = rows.where(F.size("issues") == 0).drop("issues")
    rejected = rows.where(F.size("issues") > 0).select(*keys, F.inline("issues"))
    return accepted, rejected


def check_machine_rows(rows: DataFrame) -> DataFrame:
    """Machine rows need a time."""
    return rows.withColumn(
        "issues", issue_list((F.col("time").isNull(), issue("missing_timestamp", "warning", "time")))
    )


def check_cycle_times(rows: DataFrame) -> DataFrame:
    """`quality_flag` outlier and an issue for implausible cycle times; the row is kept."""
    value = F.col("cycle_time_s")
    low, high = CYCLE_TIME_RANGE_S
    odd = F.coalesce((value < low) | (value > high), F.lit(False))
    return rows.withColumns(
        {
            "quality_flag": F.when(odd, "outlier").otherwise("valid"),
            "issues": issue_list((odd, issue("outlier_value", "warning", "cycle_time_s", value))),
        }
    )


def check_orders(rows: DataFrame) -> DataFrame:
    """ERP orders need id, resolved machine and start; a missing end is start plus available hours."""
    hours = F.col("erp_available_time_h")
    end = F.when(
        F.col("started_at").isNotNull() & (F.coalesce(hours, F.lit(0.0)) != 0),
        F.timestamp_micros(F.unix_micros("started_at") + F.round(hours * F.lit(3.6e9)).cast("long")),
    )
    blank = F.coalesce(F.col("id"), F.lit("")) == ""
    invalid = blank | F.col("machine_id").isNull() | F.col("started_at").isNull()
    return rows.withColumns(
        {
            "ended_at": F.coalesce(F.col("ended_at"), end),
            "issues": issue_list(
                (blank, issue("missing_order_id", "warning", "id")),
                (invalid, issue("invalid_erp_order", "error", "machine_erp_ref", F.col("machine_erp_ref"))),
            ),
        }
    )


def check_context(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Context rows need a machine, a time and, where an order is named, one of their site."""
    checked = with_order_known(rows, orders)
    invalid = F.col("machine_id").isNull() | F.col("time").isNull() | ~F.col("order_known")
    return checked.withColumn(
        "issues",
        issue_list((invalid, issue("invalid_context_row", "error", "machine_erp_ref", F.col("machine_erp_ref")))),
    )


def check_export_rows(rows: DataFrame) -> DataFrame:
    """Rows without time or machine are skipped; negative cycle time and extreme pressure are errors."""
    return rows.withColumn(
        "issues",
        issue_list(
            (F.col("time").isNull(), issue("missing_timestamp", "warning", "time")),
            (F.col("machine_id").isNull(), issue("missing_machine", "warning", "machine_id")),
            (
                F.coalesce(F.col("cycle_time_s") < 0, F.lit(False)),
                issue("negative_duration", "error", "cycle_time_s", F.col("cycle_time_s")),
            ),
            (
                F.coalesce(F.col("peak_pressure_bar") > MAX_PRESSURE_BAR, F.lit(False)),
                issue("pressure_out_of_range", "error", "peak_pressure_bar", F.col("peak_pressure_bar")),
            ),
        ),
    )


def _value_code(field: str, text: Column) -> Column:
    trimmed = F.trim(text)
    number = F.replace(trimmed, F.lit(","), F.lit(".")).try_cast("double")
    code = F.when(text.isNotNull() & number.isNull(), F.lit("invalid_numeric")).when(
        number.isNotNull() & finite(number).isNull(), F.lit("non_finite")
    )
    if field in DURATION_FIELDS:
        code = code.when(number < 0, F.lit("negative_duration"))
    if field in PRESSURE_FIELDS:
        code = code.when(number > MAX_PRESSURE_BAR, F.lit("pressure_out_of_range"))
    if field in NON_NEGATIVE_FIELDS:
        code = code.when(number < 0, F.lit("negative_value"))
    if field == "erp_trs":
        code = code.when(~number.between(0, 1), F.lit("ratio_out_of_range"))
    return code


def invalid_values(rows: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """(keys, field, code) of every invalid field of text rows; values are not echoed."""
    found = []
    for field in sorted(required):
        code = "missing_timestamp" if field in ("time", "started_at") else "missing_required_value"
        empty = F.coalesce(F.col(field).cast("string"), F.lit("")) == ""
        found.append(F.when(empty, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))))
    for field in DATE_FIELDS:
        if field in rows.columns:
            text = F.col(field).cast("string")
            bad = (F.coalesce(text, F.lit("")) != "") & parse_source_time(text).isNull()
            found.append(
                F.when(bad, F.struct(F.lit(field).alias("field"), F.lit("invalid_timestamp").alias("code")))
            )
    for field in NUMERIC_FIELDS:
        if field in rows.columns and field not in ("shift_number",):
            code = _value_code(field, F.col(field).cast("string"))
            found.append(F.when(code.isNotNull(), F.struct(F.lit(field).alias("field"), code.alias("code"))))
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("x")).select(
        *keys, "x.field", "x.code"
    )


def missing_in_all_rows(rows: DataFrame, required: list[str]) -> DataFrame:
    """Per required field: rows, filled rows, and whether no row has it."""
    counts = rows.agg(
        F.count("*").alias("rows"),
        *[F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in required],
    )
    return counts.unpivot(["rows"], required, "field", "filled").select(
        "field", "rows", "filled", (F.col("filled") == 0).alias("missing")
    )


def site_mismatches(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """Rows per site whose machine belongs to another site."""
    home = machines.select("machine_id", F.col("site_id").alias("_home"))
    return (
        rows.join(home, "machine_id")
        .groupBy("site_id")
        .agg(F.count_if(F.col("site_id") != F.col("_home")).alias("mismatches"))
    )


def duplicate_hashes(files: DataFrame) -> DataFrame:
    return files.groupBy("site_id", "file_hash").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def ambiguous_aliases(machines: DataFrame, aliases: DataFrame) -> DataFrame:
    """References of a site that name more than one machine."""
    own = machines.select("site_id", F.col("erp_ref").alias("alias_value"), "machine_id")
    return (
        own.unionByName(aliases.select("site_id", "alias_value", "machine_id"))
        .groupBy("site_id", "alias_value")
        .agg(F.count_distinct("machine_id").alias("machines"))
        .where(F.col("machines") > 1)
    )


def missing_orders(cycles: DataFrame, orders: DataFrame) -> DataFrame:
    """Cycles per site that name an order unknown to the site."""
    named = cycles.where(F.col("production_order_id").isNotNull())
    known = orders.select("site_id", F.col("id").alias("production_order_id"))
    return (
        named.join(known, ["site_id", "production_order_id"], "left_anti")
        .groupBy("site_id")
        .agg(F.count("*").alias("unknown_orders"))
    )


def order_coverage(cycles: DataFrame, orders: DataFrame) -> DataFrame:
    """Share of linked cycles that lie inside their order's window, per site."""
    spans = orders.select("site_id", F.col("id").alias("production_order_id"), "started_at", "ended_at")
    inside = (F.col("time") >= F.col("started_at")) & (
        F.col("ended_at").isNull() | (F.col("time") <= F.col("ended_at"))
    )
    return (
        cycles.join(spans, ["site_id", "production_order_id"])
        .groupBy("site_id")
        .agg(F.count("*").alias("linked"), F.avg(inside.cast("int")).alias("inside_share"))
    )


def defect_overlap(cycles: DataFrame, checks: DataFrame) -> DataFrame:
    """Defect types seen both in cycles and in checks, per site: their number and names.

    The types are intersected as rows; only the shared ones are gathered.
    """
    kinds = lambda df: df.where(F.col("defect_type").isNotNull()).select("site_id", "defect_type")
    shared = kinds(cycles).intersect(kinds(checks))
    named = shared.groupBy("site_id").agg(
        F.count("*").cast("int").alias("shared_types"), F.array_join(F.sort_array(F.collect_list("defect_type")), ",").alias("shared")
    )
    sites = cycles.select("site_id").union(checks.select("site_id")).distinct()
    return sites.join(named, "site_id", "left").select(
        "site_id", F.coalesce("shared_types", F.lit(0)).alias("shared_types"), F.coalesce("shared", F.lit("")).alias("shared")
    )


def out_of_bounds(cycles: DataFrame, bounds: dict[str, tuple[float, float]] = FEATURE_BOUNDS) -> DataFrame:
    """Values outside the contract's range, per feature present."""
    present = [f for f in bounds if f in cycles.columns]
    counts = cycles.agg(
        *[F.count_if(~F.col(f).between(*bounds[f])).alias(f) for f in present],
    )
    return counts.unpivot([], present, "feature", "out_of_bounds")


def cadence(cycles: DataFrame, low_s: float, high_s: float, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Per machine: gaps between cycles and how many lie within the expected cadence."""
    timed = framed(
        cycles.select(*SITE_MACHINE, *CYCLE_ORDER),
        SITE_MACHINE,
        CYCLE_ORDER,
        {"_prev": lambda w: F.lag("time").over(w)},
        before=1,
        after=0,
        budget=budget,
    )
    gap = (F.unix_micros("time") - F.unix_micros("_prev")) / F.lit(1e6)
    return timed.groupBy(*SITE_MACHINE).agg(
        F.count(gap).alias("gaps"), F.count_if(gap.between(low_s, high_s)).alias("in_cadence")
    )


def check_feature_contract(rows: DataFrame, label: str) -> DataFrame:
    """Training rows: required columns, times and labels present, labels 0 or 1."""
    missing = sorted({*RAW_FEATURES, "timestamp", "machine_erp_ref", label} - set(rows.columns))
    if missing:
        raise ValueError(f"training data is missing columns: {', '.join(missing)}")
    kept = rows.where(F.col("timestamp").isNotNull() & F.col(label).isNotNull())
    value = F.col(label).cast("int")
    checked = F.when(value.isin(0, 1), value).otherwise(
        F.raise_error(F.lit(f"{label} must contain only 0/1 values")).cast("int")
    )
    return kept.withColumn(label, checked)


def check_score_requests(cycles: DataFrame, request: str, features: list[str]) -> DataFrame:
    """Status of scoring requests: at least 3 cycles, one machine, valid times, some feature value."""
    any_value = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in features])
    seen = cycles.groupBy(request).agg(
        F.count("*").alias("cycles"),
        F.count_if(F.col("time").isNull()).alias("_untimed"),
        F.count_distinct("machine_id").alias("machines"),
        F.count_if(any_value).alias("_valued"),
    )
    return seen.select(
        request,
        "cycles",
        "machines",
        F.when(F.col("cycles") < 3, "too_few_cycles")
        .when(F.col("_untimed") > 0, "timestamps_invalid")
        .when(F.col("machines") != 1, "multiple_machines")
        .when(F.col("_valued") == 0, "raw_features_missing")
        .otherwise("ok")
        .alias("status"),
    )


def session_readiness(files: DataFrame) -> DataFrame:
    """Import sessions whose every file has a hash, a profiled column and a reviewable status."""
    ready = (
        F.col("file_hash").isNotNull()
        & (F.coalesce(F.json_array_length("columns_json"), F.lit(0)) > 0)
        & F.col("status").isin("needs_review", "validated")
    )
    return files.groupBy("session_id").agg(
        F.count("*").alias("files"), F.count_if(F.coalesce(ready, F.lit(False))).alias("ready_files")
    ).withColumn("ready", (F.col("files") > 0) & (F.col("files") == F.col("ready_files")))


