"""Registered queries: rollups, status lists, top-k, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.functions import values
from cyclelake.operators import rollups
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views
from cyclelake.schema import SITE_MACHINE


@query(
    "a1_hourly_rollup",
    """SELECT date_trunc('hour', time) AS bucket, site_id, machine_id, production_order_id, count(*) AS cycle_count,
              round(avg(cycle_time_s), 6) AS avg_cycle_time_s, round(stddev_samp(cycle_time_s), 6) AS stddev_cycle_time_s,
              round(avg(cushion_mm), 6) AS avg_cushion_mm, round(stddev_samp(cushion_mm), 6) AS stddev_cushion_mm,
              round(avg(dosing_time_s), 6) AS avg_dosing_time_s,
              round(avg(switchover_pressure_bar), 6) AS avg_switchover_pressure_bar,
              count(*) FILTER (WHERE scrap_flag) AS total_scraps,
              count(*) - count(*) FILTER (WHERE scrap_flag) AS total_good,
              round(avg(link_confidence), 6) AS avg_link_confidence
       FROM linked GROUP BY 1, 2, 3, 4""",
)
def hourly_rollup(v: Views) -> DataFrame:
    return rollups.hourly_rollup(v.linked, rounded=False)


def _timeline_sql(select: str, group: str) -> str:
    return f"""SELECT c.site_id, c.machine_id, {select}, count(*) AS cycle_count,
              round(avg(c.cycle_time_s), 6) AS avg_cycle_time_s,
              round(avg(CAST(c.scrap_flag AS INTEGER)), 6) AS scrap_rate,
              round(avg(c.barrel_temp_zone2_c), 6) AS avg_zone2_temperature_c,
              min(c.production_order_id) AS production_order_id
       FROM linked c {group}"""


@query("a2_timeline_minute", _timeline_sql("date_trunc('minute', c.time) AS bucket", "GROUP BY 1, 2, 3"))
def timeline_minute(v: Views) -> DataFrame:
    return rollups.timeline(v.linked, "minute", limit=None)


@query("a2_timeline_hour", _timeline_sql("date_trunc('hour', c.time) AS bucket", "GROUP BY 1, 2, 3"))
def timeline_hour(v: Views) -> DataFrame:
    return rollups.timeline(v.linked, "hour", limit=None)


@query(
    "a2_timeline_order",
    _timeline_sql("min(c.time) AS bucket", "GROUP BY c.site_id, c.machine_id, c.production_order_id"),
)
def timeline_order(v: Views) -> DataFrame:
    return rollups.timeline(v.linked, "order", limit=None)


@query(
    "a2_timeline_shift",
    _timeline_sql(
        "min(c.time) AS bucket",
        """LEFT JOIN shifts s ON s.site_id = c.site_id AND s.machine_id = c.machine_id
             AND s.started_at <= c.time AND s.ended_at > c.time
           GROUP BY c.site_id, c.machine_id, s.id""",
    ),
)
def timeline_shift(v: Views) -> DataFrame:
    from cyclelake.operators import intervals

    return rollups.timeline(intervals.link_shifts(v.linked, v.shifts), "shift", limit=None)


@query(
    "a2_timeline_first_buckets",
    """SELECT site_id, machine_id, bucket, cycle_count FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, machine_id ORDER BY bucket) AS n FROM (
           SELECT site_id, machine_id, date_trunc('hour', time) AS bucket, count(*) AS cycle_count
           FROM cycles GROUP BY 1, 2, 3)) WHERE n <= 20""",
)
def timeline_first_buckets(v: Views) -> DataFrame:
    return rollups.timeline(v.cycles, "hour", limit=20).select("site_id", "machine_id", "bucket", "cycle_count")


CHECKS_SQL = """
checks AS (
  SELECT site_id, machine_id, count(*) AS check_count, CAST(coalesce(sum(defect_count), 0) AS BIGINT) AS check_defects,
         count(*) FILTER (WHERE lower(coalesce(part_quality_status, '')) = 'scrap' OR defect_count > 0) AS check_scrap
  FROM quality_checks GROUP BY site_id, machine_id),
by_cycle AS (
  SELECT site_id, machine_id, count(*) AS cycle_count, count(*) FILTER (WHERE scrap_flag) AS cycle_scrap,
         count(defect_type) AS cycle_defects
  FROM cycles GROUP BY site_id, machine_id)"""


@query("a3_quality_from_checks", "," + CHECKS_SQL + " SELECT * FROM checks")
def quality_from_checks(v: Views) -> DataFrame:
    return rollups.quality_from_checks(v.quality_checks)


@query("a4_quality_from_cycles", "," + CHECKS_SQL + " SELECT * FROM by_cycle")
def quality_from_cycles(v: Views) -> DataFrame:
    return rollups.quality_from_cycles(v.cycles)


@query(
    "a5_defect_breakdown",
    """SELECT site_id, machine_id, coalesce(defect_type, 'unknown') AS defect_type, count(*) AS count
       FROM quality_checks GROUP BY 1, 2, 3""",
)
def defect_breakdown(v: Views) -> DataFrame:
    return rollups.defect_breakdown(v.quality_checks)


@query(
    "a5_defect_breakdown_cycles",
    """SELECT site_id, machine_id, defect_type, count FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, machine_id ORDER BY count DESC, defect_type) AS n FROM (
           SELECT site_id, machine_id, coalesce(defect_type, 'unknown') AS defect_type, count(*) AS count
           FROM cycles GROUP BY 1, 2, 3)) WHERE n <= 3""",
)
def defect_breakdown_cycles(v: Views) -> DataFrame:
    return rollups.defect_breakdown(v.cycles, limit=3)


@query(
    "a5_defect_summary",
    """, checked AS (SELECT DISTINCT site_id, machine_id FROM quality_checks),
       moved AS (SELECT * REPLACE (machine_id + 100 AS machine_id) FROM lineitem_cycles)
       SELECT site_id, machine_id, coalesce(defect_type, 'unknown') AS defect_type, count(*) AS count
       FROM quality_checks GROUP BY 1, 2, 3
       UNION ALL
       SELECT c.site_id, c.machine_id, coalesce(c.defect_type, 'unknown'), count(*) FROM moved c
       WHERE EXISTS (SELECT 1 FROM moved d WHERE d.site_id = c.site_id AND d.machine_id = c.machine_id
                      AND d.defect_type IS NOT NULL)
         AND NOT EXISTS (SELECT 1 FROM checked k WHERE k.site_id = c.site_id AND k.machine_id = c.machine_id)
       GROUP BY 1, 2, 3""",
)
def defect_summary(v: Views) -> DataFrame:
    """Checks of the event machines; suppliers, numbered from 101 on, partly lie beyond them."""
    return rollups.defect_summary(v.quality_checks, v.lineitem_cycles.withColumn("machine_id", F.col("machine_id") + 100))


@query(
    "a6_quality_summary",
    ","
    + CHECKS_SQL
    + """,
       both_sides AS (
         SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.machine_id, b.machine_id) AS machine_id,
                coalesce(check_count, 0) AS kc, coalesce(check_defects, 0) AS kd, coalesce(check_scrap, 0) AS ks,
                coalesce(cycle_count, 0) AS cc, coalesce(cycle_scrap, 0) AS cs, coalesce(cycle_defects, 0) AS cd
         FROM checks a FULL JOIN by_cycle b ON a.site_id = b.site_id AND a.machine_id = b.machine_id)
       SELECT site_id, machine_id, CASE WHEN cc > 0 THEN cc ELSE kc END AS total_checks,
              CASE WHEN cc > 0 THEN greatest(kd, CASE WHEN cd > 0 THEN cd ELSE cs END) ELSE kd END AS total_defects,
              CASE WHEN cc > 0 THEN cs ELSE ks END AS scrap_count,
              round(CASE WHEN cc > 0 THEN cs / cc WHEN kc > 0 THEN ks / kc END, 6) AS scrap_rate,
              greatest(0, CASE WHEN cc > 0 THEN cc - cs ELSE kc - ks END) AS good
       FROM both_sides""",
)
def quality_summary(v: Views) -> DataFrame:
    return rollups.quality_summary(v.quality_checks, v.cycles)


@query(
    "a7_site_summary",
    """SELECT s.site_id, s.name, s.timezone,
              (SELECT count(DISTINCT machine_id) FROM machines m WHERE m.site_id = s.site_id) AS machine_count,
              (SELECT count(DISTINCT incident_id) FROM incidents i WHERE i.site_id = s.site_id AND i.status = 'open')
                AS open_incident_count,
              (SELECT max(coalesce(j.completed_at, p.imported_at))
               FROM (SELECT 1) one
               LEFT JOIN (SELECT max(imported_at) AS imported_at FROM passports
                          WHERE site_id = s.site_id AND status = 'completed') p ON TRUE
               LEFT JOIN import_jobs j ON j.site_id = s.site_id AND j.status = 'completed') AS last_import_at
       FROM sites s""",
)
def site_summary(v: Views) -> DataFrame:
    return rollups.site_summary(v.sites, v.machines, v.incidents, v.passports, v.import_jobs)


@query(
    "a8_machines_per_line",
    """SELECT l.line_id, l.site_id, l.code, l.name, count(m.machine_id) AS machine_count
       FROM lines l LEFT JOIN machines m ON m.line_id = l.line_id GROUP BY 1, 2, 3, 4""",
)
def machines_per_line(v: Views) -> DataFrame:
    return rollups.machines_per_line(v.lines, v.machines)


@query(
    "a9_machine_summary",
    """SELECT m.site_id, m.machine_id, m.erp_ref, m.name, m.brand, count(c.time) AS total_cycles,
              round(avg(c.cycle_time_s), 6) AS avg_cycle_s, min(c.cycle_time_s) AS min_cycle_s,
              max(c.cycle_time_s) AS max_cycle_s, count(*) FILTER (WHERE c.scrap_flag) AS total_scraps,
              round(avg(c.link_confidence), 6) AS avg_confidence
       FROM machines m LEFT JOIN linked c ON c.site_id = m.site_id AND c.machine_id = m.machine_id
       GROUP BY 1, 2, 3, 4, 5""",
)
def machine_summary(v: Views) -> DataFrame:
    return rollups.machine_summary(v.machines, v.linked)


@query(
    "a10_quality_rate",
    """SELECT site_id, machine_id, count(time) AS total_cycles, count(*) FILTER (WHERE NOT scrap_flag) AS good_cycles,
              round(CAST(count(*) FILTER (WHERE NOT scrap_flag) AS DOUBLE) / count(time) * 100, 1) AS quality_pct,
              round(avg(cycle_time_s), 6) AS avg_cycle_s,
              count(*) FILTER (WHERE quality_flag <> 'valid') AS anomalies
       FROM cycles GROUP BY site_id, machine_id HAVING count(time) > 0""",
)
def quality_rate(v: Views) -> DataFrame:
    return rollups.quality_rate(v.cycles)


@query(
    "a11_issue_counts",
    """, issues AS (
         SELECT 'outlier_value' AS issue_type, 'warning' AS severity FROM cycles WHERE quality_flag <> 'valid'
         UNION ALL SELECT 'suspect_data', 'error' FROM cycles WHERE data_quality_status = 'suspect')
       SELECT issue_type, severity, count(*) AS issue_count FROM issues GROUP BY issue_type, severity""",
)
def issue_counts(v: Views) -> DataFrame:
    issue = lambda kind, severity: F.struct(
        F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("quality_flag") != "valid", issue("outlier_value", "warning")),
            F.when(F.col("data_quality_status") == "suspect", issue("suspect_data", "error")),
        )
    )
    return rollups.issue_counts(v.cycles.select(F.inline(found)))


@query(
    "a11_cycle_time_spread",
    """SELECT site_id, machine_id, count(time) AS total_cycles, round(avg(cycle_time_s), 6) AS avg_cycle_s,
              round(stddev_samp(cycle_time_s), 6) AS stddev_cycle_s
       FROM cycles GROUP BY site_id, machine_id""",
)
def cycle_time_spread(v: Views) -> DataFrame:
    return rollups.cycle_time_spread(v.cycles)


LATEST_SQL = """, last AS (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, machine_id
                  ORDER BY time DESC, cycle_counter DESC) AS n FROM cycles) WHERE n = 1)"""


@query(
    "a12_fleet_status",
    LATEST_SQL
    + """, clock AS (SELECT site_id, max(time) AS site_time FROM last GROUP BY site_id)
       SELECT m.site_id, m.machine_id, m.erp_ref, l.time AS last_cycle_at,
              CASE WHEN l.time IS NULL THEN 'offline' WHEN k.site_time - l.time > INTERVAL 1 HOUR THEN 'stopped'
                   WHEN l.scrap_flag THEN 'warning' ELSE 'running' END AS status
       FROM machines m LEFT JOIN last l ON l.site_id = m.site_id AND l.machine_id = m.machine_id
       LEFT JOIN clock k ON k.site_id = m.site_id""",
)
def fleet_status(v: Views) -> DataFrame:
    return rollups.fleet_status(v.machines, v.cycles)


@query(
    "a13_machine_status",
    LATEST_SQL
    + """ SELECT m.site_id, m.machine_id, m.erp_ref, l.time AS last_cycle_at,
              CASE WHEN l.time IS NULL OR TIMESTAMP '2024-01-30 23:58:00' - l.time > INTERVAL 1 HOUR THEN 'offline'
                   WHEN TIMESTAMP '2024-01-30 23:58:00' - l.time > INTERVAL 15 MINUTE THEN 'stopped'
                   WHEN l.scrap_flag THEN 'warning' ELSE 'running' END AS status
       FROM machines m LEFT JOIN last l ON l.site_id = m.site_id AND l.machine_id = m.machine_id""",
)
def machine_status(v: Views) -> DataFrame:
    return rollups.machine_status(
        v.machines, v.cycles, "2024-01-30 23:58:00"
    )


@query(
    "a14_status_as_of_one_instant",
    """, past AS (SELECT * FROM linked WHERE time <= TIMESTAMP '2024-01-15 06:00:00'),
       seen AS (
         SELECT site_id, machine_id, max(time) AS last_cycle_at, arg_max(production_order_id, time) FILTER (WHERE TRUE) AS o,
                count(*) FILTER (WHERE time > TIMESTAMP '2024-01-14 06:00:00') AS n,
                avg(CASE WHEN time > TIMESTAMP '2024-01-14 06:00:00' THEN CAST(scrap_flag AS INTEGER) END) AS r
         FROM past GROUP BY site_id, machine_id),
       f AS (
         SELECT m.site_id, m.machine_id, s.last_cycle_at, coalesce(s.n, 0) AS cycle_count_24h, s.r,
                (epoch_us(TIMESTAMP '2024-01-15 06:00:00') - epoch_us(s.last_cycle_at)) / 1e6 AS age
         FROM machines m LEFT JOIN seen s ON s.site_id = m.site_id AND s.machine_id = m.machine_id)
       SELECT site_id, machine_id, last_cycle_at, cycle_count_24h, round(r, 6) AS scrap_rate_24h,
              CASE WHEN age IS NULL OR age > 3600 THEN 'offline' WHEN age > 900 THEN 'stopped'
                   WHEN r >= 0.10 THEN 'warning' ELSE 'running' END AS status
       FROM f""",
)
def status_as_of_one_instant(v: Views) -> DataFrame:
    from cyclelake.operators.lookup import status_as_of

    requests = v.machines.select(
        *SITE_MACHINE, F.lit("2024-01-15 06:00:00").cast("timestamp").alias("as_of")
    )
    return status_as_of(requests, v.linked).select(
        *SITE_MACHINE, "last_cycle_at", "cycle_count_24h", "scrap_rate_24h", "status"
    )


PLAN_SQL = """, plan AS (
         SELECT o.site_id, o.id, o.erp_cycle_time_s AS planned_cycle_s, avg(c.cycle_time_s) AS m
         FROM production_orders o JOIN linked c
           ON c.site_id = o.site_id AND c.machine_id = o.machine_id AND c.production_order_id = o.id
         WHERE o.erp_cycle_time_s IS NOT NULL GROUP BY o.site_id, o.id, o.erp_cycle_time_s)"""


@query(
    "a15_plan_deviation",
    PLAN_SQL + " SELECT site_id, id, round((m - planned_cycle_s) / nullif(planned_cycle_s, 0) * 100, 6) AS delta_pct FROM plan",
)
def plan_deviation(v: Views) -> DataFrame:
    return rollups.planned_vs_measured(v.orders, v.linked).select("site_id", "id", "delta_pct")


@query(
    "t4_largest_deviations",
    PLAN_SQL
    + """ SELECT site_id, id, round((m - planned_cycle_s) / nullif(planned_cycle_s, 0) * 100, 6) AS delta_pct FROM plan
         ORDER BY abs((m - planned_cycle_s) / nullif(planned_cycle_s, 0) * 100) DESC NULLS LAST, site_id, id LIMIT 15""",
)
def largest_deviations(v: Views) -> DataFrame:
    return rollups.largest_deviations(rollups.planned_vs_measured(v.orders, v.linked)).select(
        "site_id", "id", "delta_pct"
    )


@query(
    "t1_page",
    """SELECT machine_id, erp_ref, CASE WHEN (SELECT count(*) FROM machines) > 40 THEN to_base64('40'::BLOB).rtrim('=') END AS next_page
       FROM machines ORDER BY machine_id LIMIT 20 OFFSET 20""",
)
def page(v: Views) -> DataFrame:
    return rollups.page(v.machines.select("machine_id", "erp_ref"), ["machine_id"], 20, 20)


@query("t1_page_after_key", "SELECT job_id, file_name FROM import_jobs WHERE job_id > 1000 ORDER BY job_id LIMIT 50")
def page_after_key(v: Views) -> DataFrame:
    return rollups.page_after(v.import_jobs.select("job_id", "file_name"), "job_id", 1000, 50)


@query(
    "t5_most_common_defect",
    """, counted AS (
         SELECT site_id, machine_id, defect_type, count(*) AS n, min(time) AS first_seen FROM cycles
         WHERE defect_type IS NOT NULL GROUP BY 1, 2, 3)
       SELECT site_id, machine_id, defect_type, n AS count FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, machine_id ORDER BY n DESC, first_seen, defect_type) AS r
         FROM counted) WHERE r = 1""",
)
def most_common_defect(v: Views) -> DataFrame:
    return rollups.most_common(v.cycles, SITE_MACHINE, "defect_type", "time")


@query(
    "t6_first_notes",
    """SELECT incident_id, note_id FROM (
         SELECT i.incident_id, n.note_id, row_number() OVER (PARTITION BY i.incident_id ORDER BY n.time, n.note_id) AS r
         FROM incidents i JOIN operator_notes n ON n.site_id = i.site_id AND n.machine_id = i.machine_id
          AND n.time BETWEEN i.started_at AND coalesce(i.ended_at, i.data_cutoff)) WHERE r <= 10""",
)
def first_notes(v: Views) -> DataFrame:
    from cyclelake.operators.diagnose import first_per_incident
    from cyclelake.operators.intervals import points_in_windows

    windows = v.incidents.select(
        *SITE_MACHINE, "incident_id", "started_at", F.coalesce("ended_at", "data_cutoff").alias("until")
    )
    notes = points_in_windows(v.operator_notes.drop("note_text"), windows, "time", "started_at", "until")
    return first_per_incident(notes, "note_id", 10).select("incident_id", "note_id")


@query(
    "t7_newest_jobs",
    "SELECT job_id, site_id, discovered_at FROM import_jobs ORDER BY discovered_at DESC, job_id LIMIT 100",
)
def newest_jobs(v: Views) -> DataFrame:
    return rollups.newest_first(v.import_jobs, "discovered_at", "job_id", 100).select(
        "job_id", "site_id", "discovered_at"
    )


@query(
    "u1_machine_candidates",
    """SELECT site_id, erp_ref AS ref, machine_id FROM machines
       UNION SELECT site_id, alias_value, machine_id FROM machine_aliases""",
)
def machine_candidates(v: Views) -> DataFrame:
    from cyclelake.operators.lookup import machine_candidates

    return machine_candidates(v.machines, v.machine_aliases)


@query(
    "u2_union_by_name",
    """SELECT source, count(*) AS n, round(avg(cycle_time_s), 6) AS avg_cycle_time_s FROM (
         SELECT 'events' AS source, cycle_time_s FROM cycles
         UNION ALL SELECT 'lineitem', cycle_time_s FROM lineitem_cycles) GROUP BY source""",
)
def union_by_name(v: Views) -> DataFrame:
    both = v.cycles.select(F.lit("events").alias("source"), "cycle_time_s").unionByName(
        v.lineitem_cycles.select("cycle_time_s", F.lit("lineitem").alias("source"))
    )
    return both.groupBy("source").agg(F.count("*").alias("n"), F.avg("cycle_time_s").alias("avg_cycle_time_s"))


@query(
    "u3_set_algebra",
    """, sets AS (
         SELECT event_id, CASE WHEN k % 2 = 0 THEN ['short_shot', 'flash'] ELSE ['bubbles'] END AS expected,
                [(['short_shot', 'flash', 'bubbles'])[k % 3 + 1], (['flash', 'warpage'])[k % 2 + 1]] AS observed FROM ev)
       SELECT event_id, CAST(len(list_intersect(expected, observed)) AS INTEGER) AS shared,
              list_has_any(expected, observed) AS related,
              CAST(len(list_distinct(list_concat(expected, observed))) AS INTEGER) AS named
       FROM sets""",
)
def set_algebra(v: Views) -> DataFrame:
    from cyclelake.plans.views import pick

    k = F.col("k")
    expected = F.when(k % 2 == 0, F.array(F.lit("short_shot"), F.lit("flash"))).otherwise(F.array(F.lit("bubbles")))
    observed = F.array(pick(["short_shot", "flash", "bubbles"], k % 3), pick(["flash", "warpage"], k % 2))
    return v.events.select(
        "event_id",
        F.size(F.array_intersect(expected, observed)).alias("shared"),
        F.arrays_overlap(expected, observed).alias("related"),
        F.size(F.array_distinct(F.concat(expected, observed))).alias("named"),
    )


@query(
    "m27_filtered_incidents",
    """SELECT incident_id, site_id, machine_id, started_at FROM incidents
       WHERE site_id IN (1, 3) AND status = 'open' AND started_at >= TIMESTAMP '2024-01-05'
         AND started_at <= TIMESTAMP '2024-01-25'""",
)
def filtered_incidents(v: Views) -> DataFrame:
    return rollups.filtered(
        v.incidents, allowed_sites=[1, 3], status="open", start="2024-01-05", end="2024-01-25"
    ).select("incident_id", "site_id", "machine_id", "started_at")


@query("m27_no_site_allowed", "SELECT incident_id, site_id FROM incidents WHERE FALSE")
def no_site_allowed(v: Views) -> DataFrame:
    return rollups.filtered(v.incidents, allowed_sites=[]).select("incident_id", "site_id")


@query(
    "m29_impact_estimate",
    """SELECT site_id, machine_id, count(*) FILTER (WHERE scrap_flag) AS avoidable_scrap,
              round(CAST(1.25 AS DOUBLE) * count(*) FILTER (WHERE scrap_flag) + 80.0 * (sum(CASE WHEN quality_flag <> 'valid'
                THEN 1 ELSE 0 END) * 0.5), 6) AS impact
       FROM cycles GROUP BY site_id, machine_id""",
)
def impact_estimate(v: Views) -> DataFrame:
    figures = v.cycles.groupBy(*SITE_MACHINE).agg(
        rollups.scrap_count().alias("avoidable_scrap"),
        (F.count_if(F.col("quality_flag") != "valid") * F.lit(0.5)).alias("hours"),
    )
    return figures.select(
        *SITE_MACHINE,
        "avoidable_scrap",
        values.impact_estimate(F.lit(1.25), F.col("avoidable_scrap"), F.lit(80.0), F.col("hours")).alias("impact"),
    )
