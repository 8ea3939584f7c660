"""Canonical tables over the driver's Parquet tables, as DataFrames and as the same SQL.

`Views` gives the DataFrames used by the registered queries; `VIEW_SQL` states the same
definitions as common table expressions for the DuckDB side of the comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cyclelake.operators import intervals
from cyclelake.session import stored

# --- fixed values of the test views ---------------------------------------------------
DEFECTS = ["short_shot", "flash", "sink_mark", "bubbles", "warpage", "dimension_out_of_tolerance"]
BRANDS = ["arburg", "engel", "haitian"]
DESCRIPTIONS = [
    "Redemarrage apres arret machine",
    "Changement matiere et purge",
    "Maintenance preventive programmee",
    "Material change lot 4",
    "Nettoyage moule",
]
NOTES = [
    "Short shot en zone 2",
    "Bulles apres sechage",
    "Usure du moule, cotes a verifier",
    "Rien a signaler",
]
BASE_TIME = "2024-01-01 00:00:00"
# --------------------------------------------------------------------------------------


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


class Views:
    """Lazily built canonical DataFrames of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            (1 + F.col("user_id") % 3).alias("site_id"),
            F.col("user_id").alias("machine_id"),
            F.col("ts").cast("timestamp").alias("time"),
            "event_id",
            "event_type",
            "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def cycles(self) -> DataFrame:
        k = F.col("k").cast("double")
        e = lambda n: (F.col("event_id") % n).cast("double")
        error = F.col("event_type") == "error"
        none = F.lit(None)
        return self.events.select(
            "site_id",
            "machine_id",
            "time",
            F.col("event_id").alias("cycle_counter"),
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("source_row_hash"),
            none.cast("string").alias("production_order_id"),
            none.cast("bigint").alias("order_site_id"),
            none.cast("string").alias("shift_id"),
            none.cast("double").alias("link_confidence"),
            error.alias("scrap_flag"),
            F.when(error, 0).otherwise(1).alias("good_parts"),
            F.when(error, "scrap").when(F.col("k") == 13, "reject").otherwise("good").alias(
                "part_quality_status"
            ),
            F.when(error, pick(DEFECTS, F.col("k") % 6)).alias("defect_type"),
            F.when((F.col("value") < 0.5) | (F.col("value") > 3600), "outlier")
            .otherwise("valid")
            .alias("quality_flag"),
            F.when(F.col("k") % 50 == 7, "suspect").when(F.col("k") % 2 == 0, "valid").alias(
                "data_quality_status"
            ),
            (k * 0.5).alias("mold_open_time_s"),
            (5 + e(32) * 0.5).alias("switchover_position"),
            F.col("value").alias("cycle_time_s"),
            (F.col("value") * 0.25).alias("dosing_time_s"),
            F.when(F.col("k") % 25 != 0, 1 + e(16) * 0.125).alias("injection_time_s"),
            F.when(F.col("k") % 20 != 3, 10 + e(64) * 0.25).alias("cooling_time_s"),
            (k * 0.0625).alias("cushion_mm"),
            (100 + k * 2.0).alias("switchover_pressure_bar"),
            (700 + e(128) * 4.0).alias("peak_pressure_bar"),
            (1000 - e(64) * 2.0).alias("clamp_force_kn"),
            (50 + e(32) * 0.5).alias("mold_temperature_c"),
            (200 + e(8) * 0.5).alias("barrel_temp_zone1_c"),
            (190 + e(64) * 0.5).alias("barrel_temp_zone2_c"),
            (210 + e(16) * 0.5).alias("barrel_temp_zone3_c"),
            (40 + k * 0.125).alias("oil_temperature_c"),
            (0.5 + e(32) * 0.0625).alias("energy_kwh"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        k = F.col("k")
        minutes = F.floor(F.col("value") * 10).cast("int")
        return self.events.where(F.col("event_type") == "purchase").select(
            "site_id",
            "machine_id",
            F.concat(F.lit("OF-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("id"),
            F.col("time").alias("started_at"),
            F.when(k % 10 != 0, F.timestamp_add("MINUTE", minutes, F.col("time"))).alias("ended_at"),
            F.when(k % 11 != 0, F.concat(F.lit("P"), (k % 3).cast("string"))).alias("product_ref"),
            F.when(k % 13 != 0, F.concat(F.lit("T"), (k % 4).cast("string"))).alias("tool_ref"),
            F.when(k % 17 != 0, F.concat(F.lit("M"), (k % 2).cast("string"))).alias("material_ref"),
            F.when(k % 9 != 0, 1 + k.cast("double") * 0.5).alias("erp_cycle_time_s"),
            (k * 10).alias("target_quantity"),
            (k.cast("double") * 0.25).alias("erp_available_time_h"),
        )

    @cached_property
    def linked(self) -> DataFrame:
        """Cycles with their order and confidence."""
        return intervals.link_orders(self.cycles, self.orders)

    @cached_property
    def linked_table(self) -> DataFrame:
        """The linked cycles as a stored table, as an import leaves them."""
        return stored(self.linked)

    @cached_property
    def shifts(self) -> DataFrame:
        days = self.events.select(
            "site_id", "machine_id", F.date_trunc("day", "time").alias("day")
        ).distinct()
        slot = F.col("n")
        start = F.timestamp_add("HOUR", (6 + 8 * (slot - 1)).cast("int"), F.col("day"))
        return days.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
            "site_id",
            "machine_id",
            F.concat_ws(
                "-", F.col("machine_id").cast("string"), F.date_format("day", "yyyyMMdd"), slot.cast("string")
            ).alias("id"),
            slot.alias("shift_number"),
            F.to_date("day").alias("shift_date"),
            start.alias("started_at"),
            F.timestamp_add("HOUR", F.lit(8), start).alias("ended_at"),
            F.lit(None).cast("string").alias("production_order_id"),
        )

    @cached_property
    def machines(self) -> DataFrame:
        m = F.col("machine_id")
        return (
            self.events.select("site_id", "machine_id")
            .distinct()
            .unionByName(self.idle_machines)
            .select(
                "site_id",
                "machine_id",
                F.concat(F.lit("REF"), (m % 1000).cast("string")).alias("erp_ref"),
                F.concat(F.lit("Presse "), m.cast("string")).alias("name"),
                pick(BRANDS, m % 3).alias("brand"),
                (m % 25).alias("line_id"),
            )
        )

    @cached_property
    def idle_machines(self) -> DataFrame:
        """Machines that have not run any cycle yet, one per supplier."""
        s = F.col("s_suppkey").cast("bigint")
        return self.table("supplier").select((1 + s % 3).alias("site_id"), (1_000_000 + s).alias("machine_id"))

    @cached_property
    def machine_aliases(self) -> DataFrame:
        """Alias = next machine's reference for every tenth machine (ambiguous), own nickname else."""
        m = F.col("machine_id")
        return self.machines.select(
            "site_id",
            "machine_id",
            F.when(m % 10 == 0, F.concat(F.lit("REF"), ((m + 3) % 1000).cast("string")))
            .otherwise(F.concat(F.lit("ALIAS"), m.cast("string")))
            .alias("alias_value"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        return self.table("region").select(
            (F.col("r_regionkey") + 1).cast("bigint").alias("site_id"),
            F.col("r_name").alias("name"),
            F.lit("Europe/Paris").alias("timezone"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("line_id"),
            (F.col("n_regionkey") + 1).cast("bigint").alias("site_id"),
            F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("code"),
            F.col("n_name").alias("name"),
        )

    @cached_property
    def quality_checks(self) -> DataFrame:
        k = F.col("k")
        return self.events.where(F.col("event_type") == "view").select(
            "site_id",
            "machine_id",
            "time",
            F.concat(F.lit("QC-"), F.col("event_id").cast("string")).alias("quality_check_id"),
            F.lit(None).cast("string").alias("production_order_id"),
            (k % 4).alias("defect_count"),
            F.when(k % 3 != 0, pick(DEFECTS, k % 6)).alias("defect_type"),
            (F.col("value") / 100).alias("dimension_deviation_mm"),
            (20 + (F.col("event_id") % 8).cast("double") * 0.25).alias("measured_weight_g"),
            F.when(k % 5 == 0, "scrap").otherwise("conforming").alias("part_quality_status"),
            F.when(k % 40 == 9, "suspect").alias("data_quality_status"),
        )

    @cached_property
    def maintenance_events(self) -> DataFrame:
        k = F.col("k")
        return self.events.where(F.col("event_type") == "signup").select(
            "site_id",
            "machine_id",
            "time",
            F.concat(F.lit("MT-"), F.col("event_id").cast("string")).alias("event_id"),
            F.lit(None).cast("string").alias("production_order_id"),
            pick(["stop", "change", "preventive"], k % 3).alias("event_type"),
            k.cast("double").alias("duration_min"),
            pick(["low", "high"], k % 2).alias("severity"),
            pick(DESCRIPTIONS, k % 5).alias("description"),
            F.col("time").alias("started_at"),
            F.timestamp_add("MINUTE", k, F.col("time")).alias("ended_at"),
        )

    @cached_property
    def operator_notes(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            (1 + (d % 150) % 3).alias("site_id"),
            (d % 150).alias("machine_id"),
            F.timestamp_add("MINUTE", ((d * 40) % 43200).cast("int"), F.lit(BASE_TIME).cast("timestamp")).alias(
                "time"
            ),
            F.concat(F.lit("NT-"), d.cast("string")).alias("note_id"),
            F.lit(None).cast("string").alias("production_order_id"),
            F.concat(pick(NOTES, d % 4), F.lit(". "), F.col("text")).alias("note_text"),
        )

    @cached_property
    def lineitem_cycles(self) -> DataFrame:
        """Bulk cycles: machine = supplier, day-grained time with unique tie-breakers."""
        return self.table("lineitem").select(
            (1 + F.col("l_suppkey") % 3).alias("site_id"),
            F.col("l_suppkey").alias("machine_id"),
            F.col("l_shipdate").cast("timestamp").alias("time"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("cycle_counter"),
            F.concat_ws(
                "-",
                F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
                F.col("l_quantity").cast("bigint").cast("string"),
                F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
            ).alias("source_row_hash"),
            F.col("l_orderkey").cast("string").alias("production_order_id"),
            (F.col("l_returnflag") == "R").alias("scrap_flag"),
            F.lit(None).cast("string").alias("part_quality_status"),
            F.when(F.col("l_returnflag") == "R", pick(DEFECTS, F.col("l_partkey") % 6)).alias("defect_type"),
            F.col("l_quantity").alias("cycle_time_s"),
            (F.col("l_quantity") * 0.25).alias("dosing_time_s"),
            F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("injection_time_s"),
            F.col("l_tax").alias("cooling_time_s"),
            F.col("l_extendedprice").alias("peak_pressure_bar"),
            (F.col("l_partkey") % 50).cast("double").alias("clamp_force_kn"),
            (F.col("l_orderkey") % 20).cast("double").alias("mold_temperature_c"),
            (F.col("l_partkey") % 7).cast("double").alias("barrel_temp_zone2_c"),
            (F.col("l_orderkey") % 11).cast("double").alias("energy_kwh"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        """One incident per error event, half a day to each side; some without an end."""
        k, t = F.col("k"), F.col("time")
        return self.events.where(F.col("event_type") == "error").select(
            F.concat(F.lit("INC-"), F.col("event_id").cast("string")).alias("incident_id"),
            "site_id",
            "machine_id",
            F.lit(None).cast("string").alias("production_order_id"),
            F.when(k % 4 == 0, "closed").otherwise("open").alias("status"),
            F.timestamp_add("HOUR", F.lit(-12) - k % 24, t).alias("started_at"),
            F.when(k % 7 != 0, F.timestamp_add("HOUR", F.lit(12), t)).alias("ended_at"),
            F.timestamp_add("HOUR", F.lit(24), t).alias("data_cutoff"),
            pick(DEFECTS + ["multiple"], k % 7).alias("defect_type"),
        )

    @cached_property
    def import_jobs(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("job_id"),
            (1 + F.col("o_custkey") % 3).alias("site_id"),
            F.concat(F.lit("f"), (o % 5000).cast("string"), F.lit(".csv")).alias("file_name"),
            F.sha2(F.concat(F.lit("h"), (o % 9000).cast("string")), 256).alias("file_hash"),
            F.col("o_orderpriority").alias("source_kind"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "retry_wait")
            .otherwise("failed")
            .alias("status"),
            (1 + o % 6).cast("int").alias("attempt_count"),
            F.lit(4).alias("max_attempts"),
            F.col("o_orderdate").cast("timestamp").alias("discovered_at"),
            F.when(
                F.col("o_orderstatus") == "F",
                F.timestamp_add("MINUTE", (o % 1440).cast("int"), F.col("o_orderdate").cast("timestamp")),
            ).alias("completed_at"),
        )

    @cached_property
    def passports(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("passport_id"),
            (1 + F.col("c_nationkey") % 3).cast("bigint").alias("site_id"),
            F.concat(F.lit("f"), (c % 800).cast("string"), F.lit(".csv")).alias("file_name"),
            F.sha2(F.concat(F.lit("h"), (c % 900).cast("string")), 256).alias("file_hash"),
            F.when(c % 4 == 0, "failed").otherwise("completed").alias("status"),
            F.timestamp_add("MINUTE", c.cast("int"), F.lit(BASE_TIME).cast("timestamp")).alias("imported_at"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Scored cycles: model = machine group, score = value, outcome = scrap."""
        return self.events.select(
            F.concat(F.lit("m"), (F.col("machine_id") % 4).cast("string")).alias("model"),
            "site_id",
            "machine_id",
            "time",
            F.col("event_id").alias("cycle_counter"),
            F.col("value").alias("score"),
            (15 + (F.col("machine_id") % 4).cast("double") * 5).alias("threshold"),
            (F.col("event_type") == "error").cast("int").alias("label"),
            F.col("event_type").isin("click", "view").alias("is_reference"),
        )


VIEW_SQL = f"""
ev AS (
  SELECT 1 + user_id % 3 AS site_id, user_id AS machine_id, ts AS time, event_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
cycles AS (
  SELECT site_id, machine_id, time, event_id AS cycle_counter,
         'r' || CAST(event_id AS VARCHAR) AS source_row_hash,
         event_type = 'error' AS scrap_flag,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS good_parts,
         CASE WHEN event_type = 'error' THEN 'scrap' WHEN k = 13 THEN 'reject' ELSE 'good' END AS part_quality_status,
         CASE WHEN event_type = 'error' THEN ({_sql_list(DEFECTS)})[k % 6 + 1] END AS defect_type,
         CASE WHEN value < 0.5 OR value > 3600 THEN 'outlier' ELSE 'valid' END AS quality_flag,
         CASE WHEN k % 50 = 7 THEN 'suspect' WHEN k % 2 = 0 THEN 'valid' END AS data_quality_status,
         CAST(k AS DOUBLE) * 0.5 AS mold_open_time_s,
         5 + CAST(event_id % 32 AS DOUBLE) * 0.5 AS switchover_position,
         value AS cycle_time_s, value * 0.25 AS dosing_time_s,
         CASE WHEN k % 25 <> 0 THEN 1 + CAST(event_id % 16 AS DOUBLE) * 0.125 END AS injection_time_s,
         CASE WHEN k % 20 <> 3 THEN 10 + CAST(event_id % 64 AS DOUBLE) * 0.25 END AS cooling_time_s,
         CAST(k AS DOUBLE) * 0.0625 AS cushion_mm,
         100 + CAST(k AS DOUBLE) * 2.0 AS switchover_pressure_bar,
         700 + CAST(event_id % 128 AS DOUBLE) * 4.0 AS peak_pressure_bar,
         1000 - CAST(event_id % 64 AS DOUBLE) * 2.0 AS clamp_force_kn,
         50 + CAST(event_id % 32 AS DOUBLE) * 0.5 AS mold_temperature_c,
         200 + CAST(event_id % 8 AS DOUBLE) * 0.5 AS barrel_temp_zone1_c,
         190 + CAST(event_id % 64 AS DOUBLE) * 0.5 AS barrel_temp_zone2_c,
         210 + CAST(event_id % 16 AS DOUBLE) * 0.5 AS barrel_temp_zone3_c,
         40 + CAST(k AS DOUBLE) * 0.125 AS oil_temperature_c,
         0.5 + CAST(event_id % 32 AS DOUBLE) * 0.0625 AS energy_kwh
  FROM ev),
production_orders AS (
  SELECT site_id, machine_id, 'OF-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, time AS started_at,
         CASE WHEN k % 10 <> 0 THEN time + to_minutes(CAST(floor(value * 10) AS INTEGER)) END AS ended_at,
         CASE WHEN k % 11 <> 0 THEN 'P' || CAST(k % 3 AS VARCHAR) END AS product_ref,
         CASE WHEN k % 13 <> 0 THEN 'T' || CAST(k % 4 AS VARCHAR) END AS tool_ref,
         CASE WHEN k % 17 <> 0 THEN 'M' || CAST(k % 2 AS VARCHAR) END AS material_ref,
         CASE WHEN k % 9 <> 0 THEN 1 + CAST(k AS DOUBLE) * 0.5 END AS erp_cycle_time_s,
         k * 10 AS target_quantity, CAST(k AS DOUBLE) * 0.25 AS erp_available_time_h
  FROM ev WHERE event_type = 'purchase'),
candidates AS (
  SELECT c.source_row_hash, o.id, epoch_us(o.started_at) AS s,
         o.started_at <= c.time AND (o.ended_at IS NULL OR o.ended_at >= c.time) AS covering,
         least(abs(epoch_us(c.time) - epoch_us(o.started_at)),
               abs(epoch_us(c.time) - coalesce(epoch_us(o.ended_at), epoch_us(c.time) + 60000000))) AS d
  FROM cycles c JOIN production_orders o
    ON o.site_id = c.site_id AND o.machine_id = c.machine_id
   AND o.started_at <= c.time + INTERVAL 30 MINUTE
   AND (o.ended_at IS NULL OR o.ended_at >= c.time - INTERVAL 30 MINUTE)),
choices AS (
  SELECT source_row_hash, id,
         CASE WHEN n_covering = 1 THEN 1.0 WHEN n_covering > 1 THEN 0.6
              ELSE greatest(0.0, round(1.0 - CAST(d AS DOUBLE) / 1e6 / 1800.0, 3)) END AS link_confidence
  FROM (SELECT *, count(*) FILTER (WHERE covering) OVER (PARTITION BY source_row_hash) AS n_covering,
               row_number() OVER (PARTITION BY source_row_hash
                 ORDER BY covering DESC, CASE WHEN covering THEN -s ELSE d END, s, id) AS choice
        FROM candidates) t
  WHERE choice = 1),
linked AS (
  SELECT c.*, h.id AS production_order_id, CAST(coalesce(h.link_confidence, 0.0) AS DOUBLE) AS link_confidence,
         CASE WHEN h.id IS NOT NULL THEN c.site_id END AS order_site_id
  FROM cycles c LEFT JOIN choices h USING (source_row_hash)),
shift_days AS (SELECT DISTINCT site_id, machine_id, date_trunc('day', time) AS day FROM ev),
shifts AS (
  SELECT site_id, machine_id,
         CAST(machine_id AS VARCHAR) || '-' || strftime(day, '%Y%m%d') || '-' || CAST(n AS VARCHAR) AS id,
         n AS shift_number, CAST(day AS DATE) AS shift_date,
         CAST(day AS TIMESTAMP) + to_hours(CAST(6 + 8 * (n - 1) AS INTEGER)) AS started_at,
         CAST(day AS TIMESTAMP) + to_hours(CAST(14 + 8 * (n - 1) AS INTEGER)) AS ended_at
  FROM shift_days, (VALUES (1), (2), (3)) slots(n)),
machines AS (
  SELECT DISTINCT site_id, machine_id, 'REF' || CAST(machine_id % 1000 AS VARCHAR) AS erp_ref,
         'Presse ' || CAST(machine_id AS VARCHAR) AS name,
         ({_sql_list(BRANDS)})[machine_id % 3 + 1] AS brand, machine_id % 25 AS line_id
  FROM (SELECT site_id, machine_id FROM ev
        UNION ALL SELECT 1 + s_suppkey % 3, 1000000 + s_suppkey FROM supplier)),
machine_aliases AS (
  SELECT site_id, machine_id,
         CASE WHEN machine_id % 10 = 0 THEN 'REF' || CAST((machine_id + 3) % 1000 AS VARCHAR)
              ELSE 'ALIAS' || CAST(machine_id AS VARCHAR) END AS alias_value
  FROM machines),
sites AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS site_id, r_name AS name, 'Europe/Paris' AS timezone FROM region),
lines AS (
  SELECT CAST(n_nationkey AS BIGINT) AS line_id, CAST(n_regionkey + 1 AS BIGINT) AS site_id,
         'L' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation),
quality_checks AS (
  SELECT site_id, machine_id, time, 'QC-' || CAST(event_id AS VARCHAR) AS quality_check_id,
         CAST(NULL AS VARCHAR) AS production_order_id, k % 4 AS defect_count,
         CASE WHEN k % 3 <> 0 THEN ({_sql_list(DEFECTS)})[k % 6 + 1] END AS defect_type,
         value / 100 AS dimension_deviation_mm,
         20 + CAST(event_id % 8 AS DOUBLE) * 0.25 AS measured_weight_g,
         CASE WHEN k % 5 = 0 THEN 'scrap' ELSE 'conforming' END AS part_quality_status,
         CASE WHEN k % 40 = 9 THEN 'suspect' END AS data_quality_status
  FROM ev WHERE event_type = 'view'),
maintenance_events AS (
  SELECT site_id, machine_id, time, 'MT-' || CAST(event_id AS VARCHAR) AS event_id,
         CAST(NULL AS VARCHAR) AS production_order_id,
         (['stop', 'change', 'preventive'])[k % 3 + 1] AS event_type, CAST(k AS DOUBLE) AS duration_min,
         (['low', 'high'])[k % 2 + 1] AS severity, ({_sql_list(DESCRIPTIONS)})[k % 5 + 1] AS description,
         time AS started_at, time + to_minutes(k) AS ended_at
  FROM ev WHERE event_type = 'signup'),
operator_notes AS (
  SELECT 1 + (doc_id % 150) % 3 AS site_id, doc_id % 150 AS machine_id,
         TIMESTAMP '{BASE_TIME}' + to_minutes(CAST((doc_id * 40) % 43200 AS INTEGER)) AS time,
         'NT-' || CAST(doc_id AS VARCHAR) AS note_id, CAST(NULL AS VARCHAR) AS production_order_id,
         ({_sql_list(NOTES)})[doc_id % 4 + 1] || '. ' || text AS note_text
  FROM documents),
lineitem_cycles AS (
  SELECT 1 + l_suppkey % 3 AS site_id, l_suppkey AS machine_id, CAST(l_shipdate AS TIMESTAMP) AS time,
         l_orderkey * 100 + l_linenumber AS cycle_counter,
         lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-'
           || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS source_row_hash,
         CAST(l_orderkey AS VARCHAR) AS production_order_id, l_returnflag = 'R' AS scrap_flag,
         CAST(NULL AS VARCHAR) AS part_quality_status,
         CASE WHEN l_returnflag = 'R' THEN ({_sql_list(DEFECTS)})[l_partkey % 6 + 1] END AS defect_type,
         l_quantity AS cycle_time_s, l_quantity * 0.25 AS dosing_time_s,
         CASE WHEN l_linenumber <> 3 THEN l_discount END AS injection_time_s, l_tax AS cooling_time_s,
         l_extendedprice AS peak_pressure_bar, CAST(l_partkey % 50 AS DOUBLE) AS clamp_force_kn,
         CAST(l_orderkey % 20 AS DOUBLE) AS mold_temperature_c,
         CAST(l_partkey % 7 AS DOUBLE) AS barrel_temp_zone2_c, CAST(l_orderkey % 11 AS DOUBLE) AS energy_kwh
  FROM lineitem),
incidents AS (
  SELECT 'INC-' || CAST(event_id AS VARCHAR) AS incident_id, site_id, machine_id,
         CAST(NULL AS VARCHAR) AS production_order_id,
         CASE WHEN k % 4 = 0 THEN 'closed' ELSE 'open' END AS status,
         time + to_hours(CAST(-12 - k % 24 AS INTEGER)) AS started_at,
         CASE WHEN k % 7 <> 0 THEN time + to_hours(12) END AS ended_at,
         time + to_hours(24) AS data_cutoff,
         ({_sql_list(DEFECTS + ["multiple"])})[k % 7 + 1] AS defect_type
  FROM ev WHERE event_type = 'error'),
import_jobs AS (
  SELECT o_orderkey AS job_id, 1 + o_custkey % 3 AS site_id,
         'f' || CAST(o_orderkey % 5000 AS VARCHAR) || '.csv' AS file_name,
         sha256('h' || CAST(o_orderkey % 9000 AS VARCHAR)) AS file_hash, o_orderpriority AS source_kind,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'retry_wait' ELSE 'failed' END AS status,
         CAST(1 + o_orderkey % 6 AS INTEGER) AS attempt_count, 4 AS max_attempts,
         CAST(o_orderdate AS TIMESTAMP) AS discovered_at,
         CASE WHEN o_orderstatus = 'F'
              THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) END AS completed_at
  FROM orders),
passports AS (
  SELECT c_custkey AS passport_id, CAST(1 + c_nationkey % 3 AS BIGINT) AS site_id,
         'f' || CAST(c_custkey % 800 AS VARCHAR) || '.csv' AS file_name,
         sha256('h' || CAST(c_custkey % 900 AS VARCHAR)) AS file_hash,
         CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status,
         TIMESTAMP '{BASE_TIME}' + to_minutes(CAST(c_custkey AS INTEGER)) AS imported_at
  FROM customer),
scores AS (
  SELECT 'm' || CAST(machine_id % 4 AS VARCHAR) AS model, site_id, machine_id, time,
         event_id AS cycle_counter, value AS score, 15 + CAST(machine_id % 4 AS DOUBLE) * 5 AS threshold,
         CAST(event_type = 'error' AS INTEGER) AS label, event_type IN ('click', 'view') AS is_reference
  FROM ev)
""".strip()
