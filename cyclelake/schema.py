"""Canonical schema: column lists, keys, feature lists and declared constants.

Every external id is unique per site only, so `site_id` is part of every key.
Times are `timestamp` in UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

SITE_MACHINE = ["site_id", "machine_id"]
CYCLE_KEY = ["site_id", "machine_id", "time", "source_row_hash"]
# Total order of a machine's cycles: time, then the two tie-breakers.
CYCLE_ORDER = ["time", "cycle_counter", "source_row_hash"]

# --- fixed values: names and limits that must equal the reference's -------------------
RAW_FEATURES = [
    "cycle_time_s",
    "dosing_time_s",
    "injection_time_s",
    "cooling_time_s",
    "cushion_mm",
    "switchover_position_mm",
    "switchover_pressure_bar",
    "peak_pressure_bar",
    "clamp_force_kn",
    "mold_temperature_c",
    "barrel_temp_zone1_c",
    "barrel_temp_zone2_c",
    "barrel_temp_zone3_c",
    "oil_temperature_c",
    "energy_kwh",
]
VOLATILITY_SOURCES = [
    "cycle_time_s",
    "injection_time_s",
    "cooling_time_s",
    "peak_pressure_bar",
    "clamp_force_kn",
    "mold_temperature_c",
    "barrel_temp_zone2_c",
    "energy_kwh",
]
VOLATILITY_FEATURES = [f"{name}_volatility_20" for name in VOLATILITY_SOURCES]
VOLATILITY_WINDOW = 20
VOLATILITY_MIN_VALUES = 3
HORIZON_CYCLES = 20
MIN_FUTURE_SCRAPS = 3
NORMAL_SCORE_QUANTILE = 0.98
DETECTOR_VERSION = "scrap-window-v1"

# Plausible range per feature (contract of a cycle export).
FEATURE_BOUNDS = {
    "cycle_time_s": (10.0, 120.0),
    "dosing_time_s": (1.0, 30.0),
    "injection_time_s": (0.5, 20.0),
    "cooling_time_s": (3.0, 60.0),
    "cushion_mm": (1.0, 15.0),
    "switchover_position_mm": (5.0, 40.0),
    "switchover_pressure_bar": (20.0, 400.0),
    "peak_pressure_bar": (20.0, 2500.0),
    "clamp_force_kn": (100.0, 6000.0),
    "mold_temperature_c": (20.0, 150.0),
    "barrel_temp_zone1_c": (40.0, 300.0),
    "barrel_temp_zone2_c": (40.0, 300.0),
    "barrel_temp_zone3_c": (40.0, 300.0),
    "oil_temperature_c": (20.0, 100.0),
    "energy_kwh": (0.05, 10.0),
}

# Canonical fields whose text is read as a decimal number; all others stay text.
NUMERIC_FIELDS = [
    "cycle_time_s",
    "dosing_time_s",
    "injection_time_s",
    "cooling_time_s",
    "cushion_mm",
    "switchover_pressure_bar",
    "switchover_position",
    "peak_pressure_bar",
    "clamp_force_kn",
    "mold_open_time_s",
    "good_parts",
    "cycle_counter",
    "oil_temperature_c",
    "barrel_temp_zone1_c",
    "barrel_temp_zone2_c",
    "barrel_temp_zone3_c",
    "mold_temperature_c",
    "energy_kwh",
    "shift_number",
    "erp_available_time_h",
    "erp_running_time_h",
    "erp_trs",
    "erp_cycle_time_s",
    "nb_cycles",
    "erp_good_parts",
    "erp_scrap_count",
]
DURATION_FIELDS = ["cycle_time_s", "dosing_time_s", "injection_time_s", "cooling_time_s"]
PRESSURE_FIELDS = ["peak_pressure_bar", "switchover_pressure_bar"]
NON_NEGATIVE_FIELDS = [
    "erp_available_time_h",
    "erp_running_time_h",
    "erp_cycle_time_s",
    "nb_cycles",
    "erp_good_parts",
    "erp_scrap_count",
]
DATE_FIELDS = ["started_at", "ended_at"]
MAX_PRESSURE_BAR = 50000.0
NULL_TOKENS = ["", "nan", "nat", "n/a", "na", "null", "none"]
# --------------------------------------------------------------------------------------

# Our own model contracts.
DRIFT_MODEL_VERSION = "process-drift-iforest-v1"
SCRAP_MODEL_VERSION = "scrap-risk-logistic-v1"

CYCLES = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("machine_id", T.LongType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("cycle_counter", T.LongType()),
        T.StructField("source_row_hash", T.StringType()),
        T.StructField("production_order_id", T.StringType()),
        T.StructField("order_site_id", T.LongType()),
        T.StructField("shift_id", T.StringType()),
        T.StructField("link_confidence", T.DoubleType()),
        T.StructField("scrap_flag", T.BooleanType()),
        T.StructField("good_parts", T.IntegerType()),
        T.StructField("part_quality_status", T.StringType()),
        T.StructField("defect_type", T.StringType()),
        T.StructField("quality_flag", T.StringType()),
        T.StructField("data_quality_status", T.StringType()),
        T.StructField("mold_open_time_s", T.DoubleType()),
        T.StructField("switchover_position", T.DoubleType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in RAW_FEATURES if name != "switchover_position_mm"]
)

QUALITY_CSV = T.StructType(
    [
        T.StructField("quality_check_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("production_order_id", T.StringType()),
        T.StructField("machine_erp_ref", T.StringType()),
        T.StructField("product_ref", T.StringType()),
        T.StructField("sample_size", T.IntegerType()),
        T.StructField("defect_count", T.IntegerType()),
        T.StructField("defect_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("measured_weight_g", T.DoubleType()),
        T.StructField("target_weight_g", T.DoubleType()),
        T.StructField("dimension_deviation_mm", T.DoubleType()),
        T.StructField("visual_result", T.StringType()),
        T.StructField("comment", T.StringType()),
    ]
)
MAINTENANCE_CSV = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("machine_erp_ref", T.StringType()),
        T.StructField("production_order_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("duration_min", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
NOTES_CSV = T.StructType(
    [
        T.StructField("note_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("machine_erp_ref", T.StringType()),
        T.StructField("production_order_id", T.StringType()),
        T.StructField("operator_id", T.StringType()),
        T.StructField("note_text", T.StringType()),
    ]
)
CONTEXT_SCHEMAS = {"quality": QUALITY_CSV, "maintenance": MAINTENANCE_CSV, "notes": NOTES_CSV}
