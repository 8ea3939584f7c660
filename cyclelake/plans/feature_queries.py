"""Registered queries: windows, features, detection, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.operators import detect, features
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views
from cyclelake.schema import SITE_MACHINE, VOLATILITY_FEATURES, VOLATILITY_SOURCES

ORDER = "ORDER BY time, cycle_counter, source_row_hash"
PER_MACHINE = f"PARTITION BY site_id, machine_id {ORDER}"


def _volatility_sql(table: str) -> str:
    parts = ",\n".join(
        f"CASE WHEN count({c}) OVER w >= 3 THEN round(stddev_pop({c}) OVER w, 6) END AS {c}_volatility_20"
        for c in VOLATILITY_SOURCES
    )
    return f"""SELECT cycle_counter, source_row_hash, {parts}
       FROM {table} WINDOW w AS ({PER_MACHINE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query("w1_volatility", _volatility_sql("cycles"))
def volatility(v: Views) -> DataFrame:
    return features.volatility_features(v.cycles).select("cycle_counter", "source_row_hash", *VOLATILITY_FEATURES)


@query("w1_volatility_lineitem", _volatility_sql("lineitem_cycles"))
def volatility_lineitem(v: Views) -> DataFrame:
    return features.volatility_features(v.lineitem_cycles).select(
        "cycle_counter", "source_row_hash", *VOLATILITY_FEATURES
    )


@query("l5_inference_features", _volatility_sql("cycles").replace("cycles WINDOW", "cycles WHERE time IS NOT NULL WINDOW"))
def inference_features(v: Views) -> DataFrame:
    from cyclelake.operators.models import inference_features

    return inference_features(v.cycles).select("cycle_counter", "source_row_hash", *VOLATILITY_FEATURES)


@query(
    "w2_previous_scrap",
    f"""SELECT source_row_hash, lag(CAST(scrap_flag AS INTEGER)) OVER ({PER_MACHINE}) AS previous_scrap_flag
       FROM cycles""",
)
def previous_scrap(v: Views) -> DataFrame:
    return features.scrap_history(v.cycles).select("source_row_hash", "previous_scrap_flag")


@query(
    "w3_rolling_scrap_rate",
    f"""SELECT source_row_hash, round(avg(CAST(scrap_flag AS INTEGER)) OVER ({PER_MACHINE}
              ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS rolling_scrap_rate_20
       FROM cycles""",
)
def rolling_scrap_rate(v: Views) -> DataFrame:
    return features.scrap_history(v.cycles).select("source_row_hash", "rolling_scrap_rate_20")


FUTURE_SQL = f"""
future AS (
  SELECT *, CAST(sum(CAST(scrap_flag AS INTEGER)) OVER f >= 3 AS INTEGER) AS instability_next_20_cycles,
         count(scrap_flag) OVER f AS ahead
  FROM cycles WINDOW f AS ({PER_MACHINE} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
labelled AS (SELECT * FROM future WHERE ahead = 20)"""


@query(
    "w4_future_instability",
    f", {FUTURE_SQL} SELECT source_row_hash, instability_next_20_cycles FROM labelled",
)
def future_instability(v: Views) -> DataFrame:
    return features.future_instability(v.cycles).select("source_row_hash", "instability_next_20_cycles")


def _split_sql(partition: str) -> str:
    return f"""
split AS (
  SELECT source_row_hash, instability_next_20_cycles,
         CASE WHEN row_number() OVER ({partition} {ORDER})
                   <= greatest(1, least(count(*) OVER ({partition}) - 1,
                        CAST(floor(CAST(count(*) OVER ({partition}) AS DOUBLE) * (CAST(2 AS DOUBLE) / 3)) AS BIGINT)))
              THEN 'train' ELSE 'test' END AS split
  FROM labelled)"""


@query(
    "w5_split_per_machine",
    f", {FUTURE_SQL}, {_split_sql('PARTITION BY site_id, machine_id')} SELECT source_row_hash, split FROM split",
)
def split_per_machine(v: Views) -> DataFrame:
    return features.chronological_split(features.future_instability(v.cycles)).select("source_row_hash", "split")


@query(
    "w5_split_global",
    f""", {FUTURE_SQL}, {_split_sql('')}
       SELECT split, count(*) AS rows, CAST(sum(instability_next_20_cycles) AS BIGINT) AS events,
              count(DISTINCT instability_next_20_cycles) >= 2 AS both_classes FROM split GROUP BY split""",
)
def split_global(v: Views) -> DataFrame:
    split = features.chronological_split(features.future_instability(v.cycles), keys=[])
    return features.split_classes(split, "instability_next_20_cycles")


def burst_sql(table: str, order: str) -> str:
    """Bursts per (site, machine, order) of a table, as CTEs ending in `bursts`."""
    group = f"site_id, machine_id, {order}"
    w = f"PARTITION BY {group} {ORDER}"
    return f"""
swept AS (
  SELECT *, {order} AS grp_order, count(*) OVER b AS nb, sum(s) OVER b AS sb, count(*) OVER e AS ne, sum(s) OVER e AS se,
         max(time) OVER (PARTITION BY {group}) AS data_cutoff, last_value(time) OVER e AS ended_at,
         row_number() OVER ({w}) AS pos
  FROM (SELECT *, CAST(scrap_flag OR lower(coalesce(part_quality_status, '')) = 'scrap' AS INTEGER) AS s FROM {table})
  WINDOW b AS ({w} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), e AS ({w} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
winners AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, machine_id, grp_order ORDER BY se - sb DESC, se DESC, pos) AS r
    FROM swept WHERE nb = 30 AND ne = 30 AND CAST(se AS DOUBLE) / 30 >= 0.15
     AND CAST(se AS DOUBLE) / 30 - CAST(sb AS DOUBLE) / 30 >= 0.10)
  WHERE r = 1),
named AS (
  SELECT site_id, machine_id, grp_order, defect_type FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, machine_id, grp_order
                ORDER BY n DESC, first_time, defect_type) AS r
    FROM (SELECT w.site_id, w.machine_id, w.grp_order, t.defect_type, count(*) AS n, min(t.time) AS first_time
          FROM winners w JOIN swept t ON t.site_id = w.site_id AND t.machine_id = w.machine_id
           AND t.grp_order IS NOT DISTINCT FROM w.grp_order AND t.pos BETWEEN w.pos AND w.pos + 29
          WHERE t.defect_type IS NOT NULL GROUP BY 1, 2, 3, 4))
  WHERE r = 1),
bursts AS (
  SELECT w.site_id, w.machine_id, w.grp_order AS production_order_id, w.time AS started_at, w.ended_at, w.data_cutoff,
         CAST(w.sb AS DOUBLE) / 30 AS baseline_rate, CAST(w.se AS DOUBLE) / 30 AS incident_rate, d.defect_type
  FROM winners w LEFT JOIN named d ON d.site_id = w.site_id AND d.machine_id = w.machine_id
   AND d.grp_order IS NOT DISTINCT FROM w.grp_order)"""


BURST_COLUMNS = """SELECT site_id, machine_id, started_at, ended_at, data_cutoff, round(baseline_rate, 6) AS baseline_rate,
       round(incident_rate, 6) AS incident_rate, defect_type FROM bursts"""


@query("w6_scrap_bursts", f", {burst_sql('cycles', 'CAST(NULL AS VARCHAR)')} {BURST_COLUMNS}")
def scrap_bursts(v: Views) -> DataFrame:
    return detect.scrap_bursts(v.cycles).drop("production_order_id")


@query("w6_scrap_bursts_lineitem", f", {burst_sql('lineitem_cycles', 'CAST(NULL AS VARCHAR)')} {BURST_COLUMNS}")
def scrap_bursts_lineitem(v: Views) -> DataFrame:
    unlinked = v.lineitem_cycles.withColumn("production_order_id", F.lit(None).cast("string"))
    return detect.scrap_bursts(unlinked).drop("production_order_id")


ORDER_COLUMNS = BURST_COLUMNS.replace("SELECT site_id, machine_id,", "SELECT site_id, machine_id, production_order_id,")


@query("w6_scrap_bursts_by_order", f", {burst_sql('yearly', 'production_order_id')} {ORDER_COLUMNS}".replace(
    ", ", ", yearly AS (SELECT * REPLACE ('Y' || CAST(year(time) AS VARCHAR) AS production_order_id) FROM lineitem_cycles), ", 1))
def scrap_bursts_by_order(v: Views) -> DataFrame:
    """Bursts within each machine and order; an order spans a year, as long runs do."""
    return detect.scrap_bursts(
        v.lineitem_cycles.withColumn("production_order_id", F.concat(F.lit("Y"), F.year("time").cast("string")))
    )


@query(
    "d13_burst_incidents",
    f""", {burst_sql('cycles', 'CAST(NULL AS VARCHAR)')}
       SELECT site_id, machine_id, started_at, CASE WHEN incident_rate >= 0.30 THEN 'critical' ELSE 'high' END AS severity,
              coalesce(defect_type, 'scrap') || '_increase' AS symptom, 'open' AS status,
              sha256(concat_ws(':', 'scrap-window-v1', site_id, machine_id, 'none',
                strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ'), strftime(ended_at, '%Y-%m-%dT%H:%M:%S.%fZ'))) AS detection_key
       FROM bursts""",
)
def burst_incidents(v: Views) -> DataFrame:
    return detect.burst_incidents(detect.scrap_bursts(v.cycles)).select(
        "site_id", "machine_id", "started_at", "severity", "symptom", "status", "detection_key"
    )


@query(
    "x7_detect_after_import",
    f""", affected AS (
         SELECT site_id, machine_id, max(time) AS cutoff FROM cycles WHERE cycle_counter % 53 = 0
         GROUP BY site_id, machine_id),
       history AS (
         SELECT c.* FROM cycles c JOIN affected a ON a.site_id = c.site_id AND a.machine_id = c.machine_id
          AND c.time <= a.cutoff WHERE coalesce(c.data_quality_status, 'valid') = 'valid'),
       {burst_sql('history', 'CAST(NULL AS VARCHAR)')}
       SELECT site_id, machine_id, started_at, ended_at, data_cutoff, defect_type FROM bursts
       WHERE machine_id % 2 = 0""",
)
def detect_after_import(v: Views) -> DataFrame:
    batch = v.cycles.where(F.col("cycle_counter") % 53 == 0)
    known = detect.detect_after_import(v.cycles, batch).where(F.col("machine_id") % 2 == 1)
    return detect.detect_after_import(v.cycles, batch, known).select(
        "site_id", "machine_id", "started_at", "ended_at", "data_cutoff", "defect_type"
    )


@query(
    "w9_most_recent",
    """SELECT model, cycle_counter, score FROM (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY time DESC, cycle_counter DESC) AS n FROM scores)
       WHERE n <= 10000""",
)
def most_recent(v: Views) -> DataFrame:
    return features.most_recent(v.scores, ["model"]).select("model", "cycle_counter", "score")


@query(
    "w9_most_recent_lineitem",
    """SELECT cycle_counter, cycle_time_s FROM (
         SELECT *, row_number() OVER (ORDER BY time DESC, cycle_counter DESC) AS n FROM lineitem_cycles) WHERE n <= 10000""",
)
def most_recent_lineitem(v: Views) -> DataFrame:
    """All bulk cycles as those of one model, so its newest are found among all rows."""
    whole = v.lineitem_cycles.withColumn("model", F.lit("all"))
    return features.most_recent(whole, ["model"]).select("cycle_counter", "cycle_time_s")


@query(
    "w10_stride_sample",
    """, normal AS (
         SELECT *, row_number() OVER (ORDER BY time, cycle_counter) - 1 AS i, count(*) OVER () AS n
         FROM scores WHERE label = 0)
       SELECT cycle_counter, score FROM normal
       WHERE i % greatest(1, n // 3000) = 0 AND i // greatest(1, n // 3000) < 3000""",
)
def stride_sample(v: Views) -> DataFrame:
    return features.stride_sample(v.scores.where(F.col("label") == 0), ["time", "cycle_counter"], 3000).select(
        "cycle_counter", "score"
    )


SESSION_SQL = f"""
gaps AS (
  SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(0.0, (epoch_us(time) - epoch_us(prev)) / 1e6 - coalesce(cycle_time_s, 0.0))
            END AS idle_s
  FROM (SELECT *, lag(time) OVER ({PER_MACHINE}) AS prev FROM cycles)),
kinds AS (
  SELECT *, CASE WHEN idle_s > 21600 THEN 'downtime' WHEN idle_s > 0 THEN 'micro_stop' END AS stop_kind FROM gaps),
sessions AS (
  SELECT *, CAST(sum(CASE WHEN prev IS NULL OR stop_kind = 'downtime' THEN 1 ELSE 0 END) OVER ({PER_MACHINE}
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no
  FROM kinds)"""


@query(
    "w11_gap_sessions",
    f", {SESSION_SQL} SELECT source_row_hash, round(idle_s, 6) AS idle_s, stop_kind, run_no FROM sessions",
)
def gap_sessions(v: Views) -> DataFrame:
    return features.gap_sessions(v.cycles, 21600.0).select("source_row_hash", "idle_s", "stop_kind", "run_no")


@query(
    "a30_run_report",
    f""", {SESSION_SQL}
       SELECT site_id, machine_id, count(*) AS total_cycles, max(run_no) AS runs,
              count(*) FILTER (WHERE stop_kind = 'downtime') AS downtime_events,
              count(*) FILTER (WHERE stop_kind = 'micro_stop') AS micro_stops,
              round((max(epoch_us(time)) - min(epoch_us(time))) / 1e6, 6) AS duration_s,
              round((max(epoch_us(time)) - min(epoch_us(time))) / 1e6
                - coalesce(sum(idle_s) FILTER (WHERE stop_kind = 'downtime'), 0.0), 6) AS uptime_s
       FROM sessions GROUP BY site_id, machine_id""",
)
def run_report(v: Views) -> DataFrame:
    return features.run_report(features.gap_sessions(v.cycles, 21600.0))


@query(
    "t3_top_signals",
    f""", vol AS ({_volatility_sql('cycles').replace('SELECT cycle_counter', 'SELECT site_id, machine_id, time, cycle_counter')}),
       last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, machine_id
                  ORDER BY time DESC, cycle_counter DESC) AS n FROM vol) WHERE n = 1),
       signals AS ({' UNION ALL '.join(f"SELECT site_id, machine_id, '{f}' AS feature, {f} AS volatility FROM last" for f in VOLATILITY_FEATURES)})
       SELECT site_id, machine_id, CAST(r AS INTEGER) AS rank, feature, volatility FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, machine_id ORDER BY volatility DESC, feature) AS r
         FROM signals WHERE volatility IS NOT NULL) WHERE r <= 3""",
)
def top_signals(v: Views) -> DataFrame:
    return features.top_signals(features.volatility_features(v.cycles), VOLATILITY_FEATURES, 3)


@query(
    "v10_cadence",
    f"""SELECT site_id, machine_id, count(g) AS gaps, count(*) FILTER (WHERE g BETWEEN 3600 AND 36000) AS in_cadence
       FROM (SELECT site_id, machine_id, (epoch_us(time) - epoch_us(lag(time) OVER ({PER_MACHINE}))) / 1e6 AS g FROM cycles)
       GROUP BY site_id, machine_id""",
)
def cadence(v: Views) -> DataFrame:
    from cyclelake.operators.validation import cadence

    return cadence(v.cycles, 3600, 36000).select(*SITE_MACHINE, "gaps", "in_cadence")
