"""Small canonical tables for tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cyclelake.schema import CYCLES

START = datetime(2026, 7, 9, 8, 0)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def cycles(spark, rows):
    """rows: dicts of canonical fields; site 1, machine 7 and a running counter by default."""
    made = []
    for i, row in enumerate(rows):
        full = {"site_id": 1, "machine_id": 7, "cycle_counter": i, "source_row_hash": f"r{i}", "scrap_flag": False}
        full.update(row)
        made.append(tuple(full.get(f.name) for f in CYCLES.fields))
    return spark.createDataFrame(made, CYCLES)


def orders(spark, rows):
    schema = (
        "site_id bigint, machine_id bigint, id string, started_at timestamp, ended_at timestamp, "
        "product_ref string, tool_ref string, material_ref string"
    )
    return spark.createDataFrame(
        [(r.get("site", 1), r.get("machine", 7), r["id"], r["s"], r.get("e"), *r.get("context", (None,) * 3)) for r in rows],
        schema,
    )


def shifts(spark, rows):
    schema = (
        "site_id bigint, machine_id bigint, id string, production_order_id string, started_at timestamp, ended_at timestamp"
    )
    return spark.createDataFrame([(1, 7, i, o, s, e) for i, o, s, e in rows], schema)


def checks(spark, rows):
    schema = (
        "site_id bigint, machine_id bigint, time timestamp, quality_check_id string, production_order_id string, "
        "defect_count int, defect_type string, dimension_deviation_mm double, measured_weight_g double, data_quality_status string"
    )
    return spark.createDataFrame(rows, schema)


def notes(spark, rows):
    schema = "site_id bigint, machine_id bigint, time timestamp, note_id string, production_order_id string, note_text string"
    return spark.createDataFrame(rows, schema)


def stops(spark, rows):
    schema = (
        "site_id bigint, machine_id bigint, time timestamp, event_id string, production_order_id string, "
        "event_type string, duration_min double, severity string, description string"
    )
    return spark.createDataFrame(rows, schema)


def by_hash(df, *columns):
    return {r["source_row_hash"]: tuple(r[c] for c in columns) for r in df.collect()}


def rounded(df, digits=9):
    """Rows as a sorted list with doubles rounded."""
    names = [F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
