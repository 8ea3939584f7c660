"""Registered queries: incident context, baselines, evidence statistics and cause ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.operators import diagnose
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views
from cyclelake.session import stored

AS_OF = "2024-01-28 00:00:00"
POLICY = diagnose.Policy(minimum_event=2, minimum_baseline=5, minimum_quality=1)

WINDOWS = f"""
win AS (
  SELECT *, CASE WHEN TIMESTAMP '{AS_OF}' < event_start THEN 'cutoff_before_start'
                 WHEN event_end < event_start THEN 'end_before_start' ELSE 'ok' END AS window_status,
         event_start - INTERVAL 6 HOUR AS context_start,
         least(event_end + INTERVAL 6 HOUR, TIMESTAMP '{AS_OF}') AS context_end,
         make_timestamp(CAST(epoch_us(event_start) - greatest(epoch_us(event_end) - epoch_us(event_start), 60000000)
           AS BIGINT)) AS baseline_start
  FROM (SELECT incident_id, site_id, machine_id, production_order_id AS requested_order,
               defect_type AS requested_defect, started_at AS event_start,
               least(coalesce(ended_at, data_cutoff), TIMESTAMP '{AS_OF}') AS event_end
        FROM incidents)),
ok AS (SELECT * FROM win WHERE window_status = 'ok'),
evc AS (
  SELECT w.incident_id, c.*, CAST(c.scrap_flag OR c.part_quality_status IN ('scrap', 'reject') AS INTEGER) AS s,
         row_number() OVER (PARTITION BY w.incident_id ORDER BY c.time, c.cycle_counter) AS p,
         count(*) OVER (PARTITION BY w.incident_id) AS n
  FROM ok w JOIN linked c ON c.site_id = w.site_id AND c.machine_id = w.machine_id
   AND c.time BETWEEN w.event_start AND w.event_end AND coalesce(c.data_quality_status, 'valid') = 'valid'),
blc AS (
  SELECT * FROM (
    SELECT w.incident_id, c.*, CAST(c.scrap_flag OR c.part_quality_status IN ('scrap', 'reject') AS INTEGER) AS s,
           row_number() OVER (PARTITION BY w.incident_id ORDER BY c.time DESC, c.cycle_counter DESC) AS r,
           count(*) OVER (PARTITION BY w.incident_id) AS n
    FROM ok w JOIN linked c ON c.site_id = w.site_id AND c.machine_id = w.machine_id AND c.time < w.event_start
     AND coalesce(c.data_quality_status, 'valid') = 'valid'
     AND (c.order_site_id IS NULL OR c.order_site_id = w.site_id))
  WHERE r <= 2000 AND n >= 5),
qc AS (
  SELECT w.incident_id, w.event_start, q.* FROM ok w JOIN quality_checks q
    ON q.site_id = w.site_id AND q.machine_id = w.machine_id AND q.time BETWEEN w.event_start AND w.event_end
   AND coalesce(q.data_quality_status, 'valid') = 'valid'),
notes AS (
  SELECT * FROM (
    SELECT w.incident_id, n.note_id, lower(n.note_text) AS txt,
           row_number() OVER (PARTITION BY w.incident_id ORDER BY n.time, n.note_id) AS r
    FROM ok w JOIN operator_notes n ON n.site_id = w.site_id AND n.machine_id = w.machine_id
     AND n.time BETWEEN w.context_start AND w.context_end) WHERE r <= 10),
stops AS (
  SELECT * FROM (
    SELECT w.incident_id, m.event_id, lower(m.description) AS txt,
           row_number() OVER (PARTITION BY w.incident_id ORDER BY m.time, m.event_id) AS r
    FROM ok w JOIN maintenance_events m ON m.site_id = w.site_id AND m.machine_id = w.machine_id
     AND m.time BETWEEN w.context_start AND w.context_end) WHERE r <= 10)"""


def _side(table: str, prefix: str) -> str:
    counts = ", ".join(f"count({m}) AS {prefix}_n_{m}" for m in diagnose.METRICS)
    means = ", ".join(f"avg({m}) AS {prefix}_mean_{m}" for m in diagnose.MEANS)
    spreads = ", ".join(
        f"CASE WHEN count({m}) >= 2 THEN stddev_pop({m}) END AS {prefix}_sd_{m}" for m in diagnose.SPREADS
    )
    medians = ", ".join(f"median({m}) AS {prefix}_median_{m}" for m in diagnose.MEDIANS)
    return f"""SELECT incident_id, count(*) AS {prefix}_cycles, CAST(sum(s) AS BIGINT) AS {prefix}_scrap,
         CAST(sum(s) AS DOUBLE) / count(*) AS {prefix}_rate, {counts}, {means}, {spreads}, {medians}
         FROM {table} GROUP BY incident_id"""


TRENDS = """
points AS (
  SELECT incident_id, quality_check_id, time, (epoch_us(time) - epoch_us(event_start)) / 86400e6 AS x,
         'dim' AS v, dimension_deviation_mm AS y FROM qc
  UNION ALL
  SELECT incident_id, quality_check_id, time, (epoch_us(time) - epoch_us(event_start)) / 86400e6, 'weight',
         measured_weight_g FROM qc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id, v ORDER BY time, quality_check_id) AS p,
         count(*) OVER (PARTITION BY incident_id, v) AS n FROM points),
trend AS (
  SELECT incident_id, v, count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_slope(y, x) END AS slope,
         CASE WHEN count(*) >= 3 THEN median(y) FILTER (WHERE p > n - greatest(1, n // 4))
              - median(y) FILTER (WHERE p <= greatest(1, n // 4)) END AS delta
  FROM placed GROUP BY incident_id, v)"""

WORDS = """
words AS (
  SELECT incident_id, FALSE AS from_check, 1 AS w,
         coalesce(defect_type, CASE WHEN quality_flag NOT IN ('good', 'valid', 'none') THEN quality_flag END) AS defect FROM evc
  UNION ALL
  SELECT incident_id, TRUE, CASE WHEN coalesce(defect_count, 0) = 0 THEN 1 ELSE defect_count END, defect_type FROM qc),
defects AS (
  SELECT incident_id, from_check, defect, CAST(sum(w) AS BIGINT) AS weight FROM words
  WHERE defect IS NOT NULL GROUP BY 1, 2, 3)"""

HALVES = """
halves AS (
  SELECT incident_id, avg(s) FILTER (WHERE p <= greatest(1, n // 2)) AS early_rate,
         avg(s) FILTER (WHERE p > n // 2) AS late_rate FROM evc GROUP BY incident_id)"""

FACTS = f"""{WINDOWS}, {TRENDS}, {WORDS}, {HALVES},
ev_side AS ({_side('evc', 'ev')}),
bl_side AS ({_side('blc', 'bl')}),
facts AS (
  SELECT w.*, e.* EXCLUDE (incident_id), b.* EXCLUDE (incident_id), h.early_rate, h.late_rate,
         coalesce(e.ev_cycles, 0) AS nev, coalesce(b.bl_cycles, 0) AS nbl,
         (SELECT count(*) FROM qc WHERE qc.incident_id = w.incident_id) AS checks,
         (SELECT count(*) FROM notes t WHERE t.incident_id = w.incident_id) AS n_notes,
         (SELECT count(*) FROM notes t WHERE t.incident_id = w.incident_id
            AND (txt LIKE '%short shot%' OR txt LIKE '%zone 2%')) AS n_zone2,
         (SELECT count(*) FROM notes t WHERE t.incident_id = w.incident_id AND (txt LIKE '%bulle%'
            OR txt LIKE '%sechage%' OR txt LIKE '%matiere%' OR txt LIKE '%granule%')) AS n_matnote,
         (SELECT count(*) FROM notes t WHERE t.incident_id = w.incident_id AND (txt LIKE '%usure%'
            OR txt LIKE '%cotes%' OR txt LIKE '%derive dimensionnelle%' OR txt LIKE '%moule%')) AS n_wear,
         (SELECT count(*) FROM stops t WHERE t.incident_id = w.incident_id AND (txt LIKE '%changement mat%'
            OR txt LIKE '%material change%' OR txt LIKE '%purge%')) AS n_change,
         (SELECT count(*) FROM stops t WHERE t.incident_id = w.incident_id AND (txt LIKE '%redemarrage%'
            OR txt LIKE '%arrêt machine%' OR txt LIKE '%arret machine%' OR txt LIKE '%restart%')) AS n_restart,
         coalesce((SELECT list(DISTINCT defect) FROM defects d WHERE d.incident_id = w.incident_id), []) AS observed,
         EXISTS (SELECT 1 FROM defects d WHERE d.incident_id = w.incident_id AND from_check) AS check_defects,
         d.slope AS dim_slope, d.delta AS dim_delta, coalesce(d.n, 0) AS dim_n, t.delta AS weight_delta
  FROM win w LEFT JOIN ev_side e ON e.incident_id = w.incident_id
  LEFT JOIN bl_side b ON b.incident_id = w.incident_id LEFT JOIN halves h ON h.incident_id = w.incident_id
  LEFT JOIN trend d ON d.incident_id = w.incident_id AND d.v = 'dim'
  LEFT JOIN trend t ON t.incident_id = w.incident_id AND t.v = 'weight'),
sig AS (
  SELECT *,
    coalesce(ev_rate IS NOT NULL AND (bl_rate IS NULL OR ev_rate > bl_rate), FALSE) AS scrap_up,
    coalesce(ev_median_barrel_temp_zone2_c < 205, FALSE) AS cold,
    coalesce(ev_median_barrel_temp_zone2_c - bl_median_barrel_temp_zone2_c <= -3, FALSE) AS dropped,
    coalesce(ev_median_barrel_temp_zone2_c < 205 AND (bl_median_barrel_temp_zone2_c IS NULL
      OR ev_median_barrel_temp_zone2_c - bl_median_barrel_temp_zone2_c <= -3), FALSE) AS zone2,
    coalesce(abs(ev_mean_injection_time_s - bl_mean_injection_time_s) >= 0.1, FALSE) AS inj,
    coalesce(ev_median_peak_pressure_bar > 900
      OR coalesce(ev_median_peak_pressure_bar > bl_median_peak_pressure_bar * 1.05, FALSE), FALSE) AS press,
    coalesce(ev_median_clamp_force_kn < bl_median_clamp_force_kn * 0.97, FALSE) AS clamp,
    coalesce(ev_sd_cooling_time_s IS NOT NULL AND (bl_sd_cooling_time_s IS NULL
      OR ev_sd_cooling_time_s > greatest(2.5, bl_sd_cooling_time_s * 1.5)), FALSE) AS cool,
    coalesce(ev_sd_mold_temperature_c IS NOT NULL AND (bl_sd_mold_temperature_c IS NULL
      OR ev_sd_mold_temperature_c > greatest(3.0, bl_sd_mold_temperature_c * 1.35)), FALSE) AS mold,
    coalesce(ev_mean_energy_kwh > bl_mean_energy_kwh * 1.05, FALSE) AS energy,
    coalesce(early_rate > late_rate + 0.05, FALSE) AS early,
    coalesce(ev_sd_barrel_temp_zone1_c >= 3, FALSE) OR coalesce(ev_sd_barrel_temp_zone2_c >= 3, FALSE) AS thermal,
    coalesce(dim_slope > 0.02 AND dim_delta > 0.05, FALSE) AS dimd,
    coalesce(abs(weight_delta) > 0.2, FALSE) AS weightd,
    list_filter([CASE WHEN nev < 2 THEN 'event_cycles' END, CASE WHEN checks < 1 THEN 'quality_checks' END,
                 CASE WHEN nbl < 5 THEN 'baseline_cycles' END], lambda x: x IS NOT NULL) AS missing,
    CASE WHEN window_status <> 'ok' THEN window_status WHEN nev = 0 AND checks = 0 THEN 'no_data'
         WHEN nev < 2 OR nbl < 5 THEN 'insufficient_samples' ELSE 'ok' END AS adequacy
  FROM facts),
causes AS (
  SELECT incident_id, 'low_barrel_temperature_zone_2' AS cause_code,
         3.0 * cold::INT + 1.5 * dropped::INT + 1.8 * list_contains(observed, 'short_shot')::INT
           + 1.0 * (n_zone2 > 0)::INT + 0.8 * (requested_defect = 'short_shot')::INT AS score,
         zone2::INT + inj::INT + scrap_up::INT + check_defects::INT + n_notes AS support,
         coalesce(ev_n_barrel_temp_zone2_c, 0) = 0 AS lacking,
         requested_defect = 'short_shot' AND list_contains(observed, 'short_shot') AS relevant FROM sig
  UNION ALL
  SELECT incident_id, 'high_injection_pressure_low_clamp_force',
         2.8 * press::INT + 2.2 * clamp::INT + 2.0 * list_contains(observed, 'flash')::INT + 0.8 * (requested_defect = 'flash')::INT,
         press::INT + clamp::INT + scrap_up::INT + check_defects::INT,
         coalesce(ev_n_peak_pressure_bar, 0) = 0 OR coalesce(ev_n_clamp_force_kn, 0) = 0,
         requested_defect = 'flash' AND list_contains(observed, 'flash') FROM sig
  UNION ALL
  SELECT incident_id, 'unstable_cooling_mold_temperature',
         2.4 * cool::INT + 1.8 * mold::INT + 1.0 * energy::INT + 2.0 * list_contains(observed, 'warpage')::INT
           + 0.8 * (requested_defect = 'warpage')::INT,
         cool::INT + mold::INT + energy::INT + scrap_up::INT + check_defects::INT,
         coalesce(ev_n_cooling_time_s, 0) = 0 OR coalesce(ev_n_mold_temperature_c, 0) = 0,
         requested_defect = 'warpage' AND list_contains(observed, 'warpage') FROM sig
  UNION ALL
  SELECT incident_id, 'material_change_incomplete_purge',
         3.0 * (n_change > 0)::INT + 1.6 * (n_matnote > 0)::INT + 2.0 * list_contains(observed, 'bubbles')::INT
           + 0.8 * (requested_defect = 'bubbles')::INT,
         scrap_up::INT + check_defects::INT + n_change + n_matnote, FALSE,
         requested_defect = 'bubbles' AND list_contains(observed, 'bubbles') FROM sig
  UNION ALL
  SELECT incident_id, 'restart_thermal_instability',
         3.2 * (n_restart > 0)::INT + 1.5 * early::INT + 1.2 * thermal::INT
           + 1.8 * (len(list_intersect(observed, ['short_shot', 'flash', 'sink_mark'])) >= 2)::INT
           + 0.8 * (requested_defect IN ('short_shot', 'flash', 'sink_mark'))::INT,
         early::INT + thermal::INT + scrap_up::INT + check_defects::INT + n_restart + n_notes, FALSE,
         requested_defect IN ('multiple', 'short_shot', 'flash', 'sink_mark')
           AND (requested_defect = 'multiple' OR n_restart > 0) FROM sig
  UNION ALL
  SELECT incident_id, 'progressive_mold_wear_dimension_drift',
         3.8 * dimd::INT + 0.8 * weightd::INT + 1.6 * (n_wear > 0)::INT
           + 1.2 * (requested_defect = 'dimension_out_of_tolerance')::INT,
         dimd::INT + weightd::INT + check_defects::INT + n_wear, dim_n < 3,
         requested_defect = 'dimension_out_of_tolerance' FROM sig),
ranked AS (
  SELECT c.incident_id, c.cause_code, CAST(c.score AS DOUBLE) AS score, c.support, s.missing, c.lacking,
         CAST(round(CASE WHEN len(s.missing) > 0 OR c.lacking THEN least(0.62, conf) ELSE conf END + 1e-9, 4) AS DOUBLE)
           AS confidence,
         row_number() OVER (PARTITION BY c.incident_id ORDER BY c.score DESC, c.cause_code) AS rank
  FROM (SELECT *, least(0.97, 0.36 + 0.075 * least(CAST(score AS DOUBLE), 7.0) + 0.04 * least(support, 4)) AS conf
        FROM causes) c JOIN sig s ON s.incident_id = c.incident_id
  WHERE c.relevant AND c.score >= 2.0 AND s.adequacy = 'ok')"""


def _facts(v: Views) -> DataFrame:
    """The facts table, stored by `collect_facts`."""
    return diagnose.collect_facts(
        v.incidents,
        v.linked_table,
        v.quality_checks,
        v.operator_notes,
        v.maintenance_events,
        v.orders,
        POLICY,
        AS_OF,
    )


def _ranked(v: Views) -> DataFrame:
    return diagnose.rank_causes(diagnose.score_causes(_facts(v)))


def _windows(v: Views) -> DataFrame:
    return diagnose.incident_windows(v.incidents, POLICY, AS_OF).where(F.col("window_status") == "ok")


@query(
    "d1_incident_windows",
    f""", {WINDOWS}
       SELECT incident_id, event_start, event_end, baseline_start, context_start, context_end, window_status FROM win""",
)
def incident_windows(v: Views) -> DataFrame:
    return diagnose.incident_windows(v.incidents, POLICY, AS_OF).select(
        "incident_id", "event_start", "event_end", "baseline_start", "context_start", "context_end", "window_status"
    )


@query(
    "j9_incident_context",
    """, spans AS (SELECT *, coalesce(ended_at, data_cutoff) AS until FROM incidents)
       SELECT i.incident_id, i.machine_id, i.started_at, c.n AS cycle_count, round(c.t, 6) AS avg_zone2_temp_c,
              round(c.r, 6) AS scrap_rate, q.n AS quality_check_count
       FROM spans i,
       LATERAL (SELECT count(*) AS n, avg(barrel_temp_zone2_c) AS t, avg(CAST(scrap_flag AS INTEGER)) AS r FROM cycles c
                WHERE c.site_id = i.site_id AND c.machine_id = i.machine_id AND c.time BETWEEN i.started_at AND i.until) c,
       LATERAL (SELECT count(*) AS n FROM quality_checks q WHERE q.site_id = i.site_id
                AND q.machine_id = i.machine_id AND q.time BETWEEN i.started_at AND i.until) q""",
)
def incident_context(v: Views) -> DataFrame:
    return diagnose.incident_context(v.incidents, v.cycles, v.quality_checks).select(
        "incident_id", "machine_id", "started_at", "cycle_count", "avg_zone2_temp_c", "scrap_rate", "quality_check_count"
    )


@query(
    "j10_event_window_rows",
    f""", {WINDOWS}
       SELECT incident_id, 'cycle' AS kind, source_row_hash AS ref FROM evc
       UNION ALL SELECT incident_id, 'check', quality_check_id FROM qc
       UNION ALL SELECT incident_id, 'note', note_id FROM notes
       UNION ALL SELECT incident_id, 'maintenance', event_id FROM stops""",
)
def event_window_rows(v: Views) -> DataFrame:
    windows = _windows(v)
    row = lambda df, kind, ref: df.select("incident_id", F.lit(kind).alias("kind"), F.col(ref).alias("ref"))
    return (
        row(diagnose.event_cycles(windows, v.linked_table), "cycle", "source_row_hash")
        .unionByName(row(diagnose.event_checks(windows, v.quality_checks), "check", "quality_check_id"))
        .unionByName(row(diagnose.context_rows(windows, v.operator_notes, "note_id"), "note", "note_id"))
        .unionByName(row(diagnose.context_rows(windows, v.maintenance_events, "event_id"), "maintenance", "event_id"))
    )


def _ordered_incidents(v: Views) -> DataFrame:
    """Incidents carrying the order of the cycle they stem from."""
    linked = v.linked_table.select(
        F.concat(F.lit("INC-"), F.col("cycle_counter").cast("string")).alias("incident_id"),
        F.col("production_order_id"),
    )
    return v.incidents.drop("production_order_id").join(linked, "incident_id")


J11_SQL = f""", asked AS (
         SELECT i.incident_id, i.site_id, i.machine_id, i.started_at, o.product_ref, o.tool_ref, o.material_ref
         FROM incidents i JOIN linked l ON 'INC-' || CAST(l.cycle_counter AS VARCHAR) = i.incident_id
         LEFT JOIN production_orders o ON o.site_id = i.site_id AND o.machine_id = i.machine_id
          AND o.id = l.production_order_id
         WHERE i.started_at <= TIMESTAMP '{AS_OF}'),
       prior AS (
         SELECT a.incident_id, c.source_row_hash, c.time, c.cycle_counter,
                a.product_ref IS NOT NULL AND a.tool_ref IS NOT NULL AND a.material_ref IS NOT NULL
                  AND o.product_ref = a.product_ref AND o.tool_ref = a.tool_ref AND o.material_ref = a.material_ref AS t1,
                a.tool_ref IS NOT NULL AND a.material_ref IS NOT NULL
                  AND o.tool_ref = a.tool_ref AND o.material_ref = a.material_ref AS t2,
                a.product_ref IS NOT NULL AND o.product_ref = a.product_ref AS t3
         FROM asked a JOIN linked c ON c.site_id = a.site_id AND c.machine_id = a.machine_id AND c.time < a.started_at
          AND coalesce(c.data_quality_status, 'valid') = 'valid'
         LEFT JOIN production_orders o ON o.site_id = c.order_site_id AND o.id = c.production_order_id),
       tiers AS (
         SELECT incident_id, CASE WHEN count(*) FILTER (WHERE t1) >= 3 THEN 1 WHEN count(*) FILTER (WHERE t2) >= 3 THEN 2
                  WHEN count(*) FILTER (WHERE t3) >= 3 THEN 3 WHEN count(*) >= 3 THEN 4 END AS tier
         FROM prior GROUP BY incident_id)
       SELECT incident_id, baseline_tier, source_row_hash FROM (
         SELECT p.incident_id, CAST(t.tier AS INTEGER) AS baseline_tier, p.source_row_hash,
                row_number() OVER (PARTITION BY p.incident_id ORDER BY p.time DESC, p.cycle_counter DESC) AS r
         FROM prior p JOIN tiers t USING (incident_id)
         WHERE (t.tier = 1 AND t1) OR (t.tier = 2 AND t2) OR (t.tier = 3 AND t3) OR t.tier = 4) WHERE r <= 25"""


@query("j11_comparable_baseline", J11_SQL)
def comparable_baseline(v: Views) -> DataFrame:
    windows = diagnose.incident_windows(_ordered_incidents(v), POLICY, AS_OF).where(F.col("window_status") == "ok")
    return diagnose.comparable_baseline(windows, v.linked_table.select(*diagnose.BASELINE_KEYS), v.orders, minimum=3, limit=25).select(
        "incident_id", "baseline_tier", "source_row_hash"
    )


# The same with the service's own bounds: 30 comparable cycles make a tier, the newest 2,000 are taken.
@query("j11_service_baseline", J11_SQL.replace(">= 3 ", ">= 30 ").replace("r <= 25", "r <= 2000"))
def service_baseline(v: Views) -> DataFrame:
    windows = diagnose.incident_windows(_ordered_incidents(v), POLICY, AS_OF).where(F.col("window_status") == "ok")
    return diagnose.comparable_baseline(windows, v.linked_table.select(*diagnose.BASELINE_KEYS), v.orders, minimum=30, limit=2000).select(
        "incident_id", "baseline_tier", "source_row_hash"
    )


@query(
    "j12_window_baseline",
    f""", {WINDOWS}
       SELECT w.incident_id, c.source_row_hash FROM ok w JOIN cycles c ON c.site_id = w.site_id
        AND c.machine_id = w.machine_id AND c.time BETWEEN w.baseline_start AND w.event_start
        AND coalesce(c.data_quality_status, 'valid') = 'valid'""",
)
def window_baseline(v: Views) -> DataFrame:
    return diagnose.window_baseline(_windows(v), v.cycles).select("incident_id", "source_row_hash")


def _a16_columns() -> list[str]:
    names = []
    for side in ("ev", "bl"):
        names += [f"{side}_median_{m}" for m in diagnose.MEDIANS] + [f"{side}_mean_{m}" for m in diagnose.MEANS]
        names += [f"{side}_sd_{m}" for m in diagnose.SPREADS] + [f"{side}_rate"]
    return names


@query(
    "a16_side_statistics",
    f""", {FACTS} SELECT incident_id, nev AS ev_cycles, nbl AS bl_cycles,
       {', '.join(f'round({c}, 6) AS {c}' for c in _a16_columns())} FROM facts WHERE nev > 0 OR nbl > 0""",
)
def side_statistics(v: Views) -> DataFrame:
    windows = stored(_windows(v))
    return diagnose.side_statistics(
        diagnose.event_cycles(windows, v.linked_table),
        diagnose.comparable_baseline(windows, v.linked_table.select(*diagnose.BASELINE_COLUMNS), v.orders, POLICY.minimum_baseline),
    ).select("incident_id", "ev_cycles", "bl_cycles", *_a16_columns())


@query(
    "a17_trends",
    f""", {WINDOWS}, {TRENDS}
       SELECT incident_id, CASE v WHEN 'dim' THEN 'dimension_deviation_mm' ELSE 'measured_weight_g' END AS value_name, n,
              round(slope, 6) AS slope_per_day, round(delta, 6) AS delta FROM trend""",
)
def trends(v: Views) -> DataFrame:
    return diagnose.trends(
        diagnose.event_checks(_windows(v), v.quality_checks), ["dimension_deviation_mm", "measured_weight_g"]
    )


@query("a18_defect_counts", f", {WINDOWS}, {WORDS} SELECT incident_id, from_check, defect, weight FROM defects")
def defect_counts(v: Views) -> DataFrame:
    windows = _windows(v)
    return diagnose.defect_counts(
        diagnose.event_cycles(windows, v.linked_table), diagnose.event_checks(windows, v.quality_checks)
    )


@query(
    "a19_early_late_rates",
    f""", {WINDOWS}, {HALVES}
       SELECT incident_id, round(early_rate, 6) AS early_rate, round(late_rate, 6) AS late_rate FROM halves""",
)
def early_late_rates(v: Views) -> DataFrame:
    return diagnose.early_late_rates(diagnose.event_cycles(_windows(v), v.linked_table)).select(
        "incident_id", "early_rate", "late_rate"
    )


@query(
    "d2_sample_adequacy",
    f", {FACTS} SELECT incident_id, adequacy, array_to_string(missing, ',') AS missing FROM sig",
)
def sample_adequacy(v: Views) -> DataFrame:
    return _facts(v).select(
        "incident_id", "adequacy", F.array_join("missing", ",").alias("missing")
    )


@query(
    "d3_evidence_rows",
    f""", {FACTS}
       SELECT incident_id, 'scrap_rate' AS metric, round(ev_rate, 6) AS value, round(bl_rate, 6) AS baseline, scrap_up AS supports
       FROM sig WHERE adequacy = 'ok'
       UNION ALL SELECT incident_id, 'barrel_temp_zone2_c', round(ev_median_barrel_temp_zone2_c, 6),
              round(bl_median_barrel_temp_zone2_c, 6), zone2 FROM sig WHERE adequacy = 'ok' AND ev_n_barrel_temp_zone2_c > 0
       UNION ALL SELECT incident_id, 'peak_pressure_bar', round(ev_median_peak_pressure_bar, 6),
              round(bl_median_peak_pressure_bar, 6), press FROM sig WHERE adequacy = 'ok'
       UNION ALL SELECT incident_id, 'operator_note', NULL, NULL, TRUE FROM notes JOIN sig USING (incident_id) WHERE adequacy = 'ok'
       UNION ALL SELECT incident_id, 'maintenance_event', NULL, NULL, TRUE FROM stops JOIN sig USING (incident_id)
              WHERE adequacy = 'ok'""",
)
def evidence_rows(v: Views) -> DataFrame:
    rows = diagnose.evidence_rows(_facts(v))
    shown = ["scrap_rate", "barrel_temp_zone2_c", "peak_pressure_bar", "operator_note", "maintenance_event"]
    return rows.where(F.col("metric").isin(shown)).select(
        "incident_id",
        "metric",
        F.col("observation.value").alias("value"),
        F.col("baseline.value").alias("baseline"),
        "supports",
    )


def _cause(v: Views, code: str) -> DataFrame:
    scored = diagnose.score_causes(_facts(v)).where(F.col("adequacy") == "ok")
    return scored.select("incident_id", F.inline("candidates")).where(F.col("cause_code") == code).select(
        "incident_id", "score", F.col("support_count").cast("bigint").alias("support_count"), "relevant"
    )


def _cause_sql(code: str) -> str:
    return f""", {FACTS} SELECT c.incident_id, round(CAST(c.score AS DOUBLE), 6) AS score,
       CAST(c.support AS BIGINT) AS support_count, c.relevant
       FROM causes c JOIN sig s USING (incident_id) WHERE s.adequacy = 'ok' AND c.cause_code = '{code}'"""


@query("d4_low_zone2_temperature", _cause_sql("low_barrel_temperature_zone_2"))
def low_zone2_temperature(v: Views) -> DataFrame:
    return _cause(v, "low_barrel_temperature_zone_2")


@query("d5_high_pressure_low_clamp", _cause_sql("high_injection_pressure_low_clamp_force"))
def high_pressure_low_clamp(v: Views) -> DataFrame:
    return _cause(v, "high_injection_pressure_low_clamp_force")


@query("d6_unstable_cooling", _cause_sql("unstable_cooling_mold_temperature"))
def unstable_cooling(v: Views) -> DataFrame:
    return _cause(v, "unstable_cooling_mold_temperature")


@query("d7_material_change", _cause_sql("material_change_incomplete_purge"))
def material_change(v: Views) -> DataFrame:
    return _cause(v, "material_change_incomplete_purge")


@query("d8_restart_instability", _cause_sql("restart_thermal_instability"))
def restart_instability(v: Views) -> DataFrame:
    return _cause(v, "restart_thermal_instability")


@query("d9_mold_wear", _cause_sql("progressive_mold_wear_dimension_drift"))
def mold_wear(v: Views) -> DataFrame:
    return _cause(v, "progressive_mold_wear_dimension_drift")


@query(
    "d10_relevant_candidates",
    f""", {FACTS} SELECT incident_id, cause_code FROM causes JOIN sig USING (incident_id)
       WHERE adequacy = 'ok' AND relevant""",
)
def relevant_candidates(v: Views) -> DataFrame:
    scored = diagnose.score_causes(_facts(v)).where(F.col("adequacy") == "ok")
    return scored.select("incident_id", F.inline("candidates")).where("relevant").select("incident_id", "cause_code")


@query(
    "d11_candidate_confidence",
    f", {FACTS} SELECT incident_id, cause_code, confidence FROM ranked",
)
def confidence(v: Views) -> DataFrame:
    scored = diagnose.score_causes(_facts(v)).where(F.col("adequacy") == "ok")
    return (
        scored.select("incident_id", F.inline("candidates"))
        .where(F.col("relevant") & (F.col("score") >= 2.0))
        .select(
            "incident_id",
            "cause_code",
            diagnose.candidate_confidence(F.col("score"), F.col("support_count"), F.size("missing") > 0).alias(
                "confidence"
            ),
        )
    )


@query(
    "d12_investigation_result",
    f""", {FACTS}
       SELECT s.incident_id,
              CASE WHEN s.adequacy <> 'ok' THEN s.adequacy WHEN b.conf IS NULL THEN 'no_hypothesis' ELSE 'completed' END AS status,
              CASE WHEN list_contains(s.missing, 'baseline_cycles') THEN 'insufficient_baseline'
                   WHEN len(s.missing) > 0 THEN 'insufficient_samples' ELSE 'sufficient' END AS data_quality,
              CASE WHEN s.ev_rate >= 0.2 THEN 'high' ELSE 'medium' END AS severity,
              CASE s.requested_defect WHEN 'short_shot' THEN 'short_shot_increase' WHEN 'flash' THEN 'flash_increase'
                WHEN 'bubbles' THEN 'bubbles_increase' WHEN 'warpage' THEN 'warpage_increase'
                WHEN 'dimension_out_of_tolerance' THEN 'dimension_drift' ELSE 'quality_anomaly' END AS symptom,
              CASE WHEN b.conf >= 0.75 THEN 'high' WHEN b.conf >= 0.5 THEN 'medium' WHEN b.conf IS NOT NULL THEN 'low' END
                AS confidence
       FROM sig s LEFT JOIN (SELECT incident_id, max(confidence) AS conf FROM ranked WHERE rank <= 2 GROUP BY 1) b
         ON b.incident_id = s.incident_id""",
)
def investigation_result(v: Views) -> DataFrame:
    return _ranked(v).select("incident_id", "status", "data_quality", "severity", "symptom", "confidence")


@query(
    "t2_top_hypotheses",
    f", {FACTS} SELECT incident_id, CAST(rank AS INTEGER) AS rank, cause_code, score FROM ranked WHERE rank <= 2",
)
def top_hypotheses(v: Views) -> DataFrame:
    return diagnose.hypothesis_rows(_ranked(v)).select("incident_id", "rank", "cause_code", "score")


@query(
    "k12_investigation_tables",
    f""", {FACTS}
       SELECT 'run' AS kind, incident_id AS ref FROM sig
       UNION ALL SELECT 'hypothesis', incident_id || ':' || cause_code FROM ranked WHERE rank <= 2""",
)
def investigation_tables(v: Views) -> DataFrame:
    ranked = _ranked(v)
    runs = diagnose.run_rows(ranked).select(F.lit("run").alias("kind"), F.col("incident_id").alias("ref"))
    hypotheses = diagnose.hypothesis_rows(ranked).select(
        F.lit("hypothesis").alias("kind"), F.concat_ws(":", "incident_id", "cause_code").alias("ref")
    )
    return runs.unionByName(hypotheses)
