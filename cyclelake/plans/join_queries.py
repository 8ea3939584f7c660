"""Registered queries: interval joins, lookups and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.functions.times import micros
from cyclelake.operators import intervals, lookup, rollups
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views

AS_OF = "2024-01-20 12:00:00"


@query(
    "j1_order_link",
    """SELECT site_id, machine_id, time, source_row_hash, production_order_id, order_site_id, link_confidence
       FROM linked""",
)
def order_link(v: Views) -> DataFrame:
    return v.linked.select(
        "site_id", "machine_id", "time", "source_row_hash", "production_order_id", "order_site_id", "link_confidence"
    )


@query(
    "j2_shift_link",
    """SELECT c.source_row_hash, c.machine_id, s.id AS shift_id
       FROM linked c LEFT JOIN (
         SELECT c.source_row_hash, s.id,
                row_number() OVER (PARTITION BY c.source_row_hash ORDER BY s.started_at DESC, s.id) AS n
         FROM cycles c JOIN shifts s ON s.site_id = c.site_id AND s.machine_id = c.machine_id
          AND s.started_at <= c.time AND (s.ended_at IS NULL OR s.ended_at >= c.time)) s
       ON s.source_row_hash = c.source_row_hash AND s.n = 1""",
)
def shift_link(v: Views) -> DataFrame:
    return intervals.link_shifts(v.linked, v.shifts).select("source_row_hash", "machine_id", "shift_id")


@query(
    "j2_shift_link_prefers_order",
    """, order_shifts AS (
         SELECT site_id, machine_id, 'S' || id AS id, id AS production_order_id, started_at, ended_at
         FROM production_orders WHERE ended_at IS NOT NULL)
       SELECT c.source_row_hash, s.id AS shift_id
       FROM linked c LEFT JOIN (
         SELECT c.source_row_hash, s.id, row_number() OVER (
                  PARTITION BY c.source_row_hash
                  ORDER BY CASE WHEN s.production_order_id = c.production_order_id THEN 0 ELSE 1 END,
                           s.started_at DESC, s.id) AS n
         FROM linked c JOIN order_shifts s ON s.site_id = c.site_id AND s.machine_id = c.machine_id
          AND s.started_at <= c.time AND s.ended_at >= c.time) s
       ON s.source_row_hash = c.source_row_hash AND s.n = 1""",
)
def shift_link_prefers_order(v: Views) -> DataFrame:
    shifts = v.orders.where(F.col("ended_at").isNotNull()).select(
        "site_id",
        "machine_id",
        F.concat(F.lit("S"), "id").alias("id"),
        F.col("id").alias("production_order_id"),
        "started_at",
        "ended_at",
    )
    return intervals.link_shifts(v.linked, shifts).select("source_row_hash", "shift_id")


@query(
    "j3_relink_missing",
    """SELECT source_row_hash,
              CASE WHEN cycle_counter % 3 = 0 THEN 'KEPT' ELSE production_order_id END AS production_order_id,
              CASE WHEN cycle_counter % 3 = 0 THEN 0.5 ELSE link_confidence END AS link_confidence
       FROM linked""",
)
def relink_missing(v: Views) -> DataFrame:
    third = F.col("cycle_counter") % 3 == 0
    partly = v.cycles.withColumns(
        {
            "production_order_id": F.when(third, F.lit("KEPT")),
            "link_confidence": F.when(third, F.lit(0.5)),
            "order_site_id": F.when(third, F.col("site_id")),
        }
    )
    return intervals.relink_missing(partly, v.orders, v.shifts).select(
        "source_row_hash", "production_order_id", "link_confidence"
    )


@query(
    "j4_overlapping_orders",
    """SELECT a.site_id, a.machine_id, count(b.id) AS overlapping_pairs
       FROM production_orders a LEFT JOIN production_orders b
         ON b.site_id = a.site_id AND b.machine_id = a.machine_id AND b.id > a.id
        AND a.started_at < coalesce(b.ended_at, TIMESTAMP '9999-01-01')
        AND b.started_at < coalesce(a.ended_at, TIMESTAMP '9999-01-01')
       GROUP BY a.site_id, a.machine_id""",
)
def overlapping_orders(v: Views) -> DataFrame:
    return intervals.overlapping_order_pairs(v.orders)


@query(
    "j5_resolve_machine_refs",
    """, refs AS (
         SELECT site_id, event_id, 'REF' || CAST((machine_id + event_id % 4) % 1000 AS VARCHAR) AS ref FROM ev),
       known AS (
         SELECT site_id, ref, min(machine_id) AS machine_id, count(*) AS n FROM (
           SELECT site_id, erp_ref AS ref, machine_id FROM machines
           UNION SELECT site_id, alias_value, machine_id FROM machine_aliases) GROUP BY site_id, ref)
       SELECT r.event_id, r.ref, CASE WHEN k.n = 1 THEN k.machine_id END AS machine_id,
              CASE WHEN k.n IS NULL THEN 'unknown' WHEN k.n > 1 THEN 'ambiguous' ELSE 'ok' END AS machine_status
       FROM refs r LEFT JOIN known k ON k.site_id = r.site_id AND k.ref = r.ref""",
)
def resolve_machine_refs(v: Views) -> DataFrame:
    refs = v.events.select(
        "site_id",
        "event_id",
        F.concat(F.lit("REF"), ((F.col("machine_id") + F.col("event_id") % 4) % 1000).cast("string")).alias("ref"),
    )
    return lookup.resolve_machines(refs, v.machines, v.machine_aliases, "ref").drop("site_id")


@query(
    "j6_latest_cycle",
    """SELECT site_id, machine_id, time, cycle_time_s, scrap_flag FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, machine_id ORDER BY time DESC, cycle_counter DESC) AS n
         FROM cycles) WHERE n = 1""",
)
def latest_cycle(v: Views) -> DataFrame:
    return lookup.latest_cycles(v.cycles, ["time", "cycle_time_s", "scrap_flag"])


@query("j7_site_clock", "SELECT site_id, max(time) AS site_time FROM cycles GROUP BY site_id")
def site_clock(v: Views) -> DataFrame:
    return lookup.site_clock(v.cycles)


@query(
    "j8_status_as_of",
    """, req AS (
         SELECT site_id, machine_id, TIMESTAMP '2024-01-20 12:00:00' - to_minutes(CAST(machine_id % 7 AS INTEGER) * 15) AS as_of
         FROM machines),
       last AS (
         SELECT * FROM (
           SELECT r.as_of, c.*, row_number() OVER (PARTITION BY c.site_id, c.machine_id
                    ORDER BY c.time DESC, c.cycle_counter DESC) AS n
           FROM req r JOIN linked c ON c.site_id = r.site_id AND c.machine_id = r.machine_id AND c.time <= r.as_of)
         WHERE n = 1),
       recent AS (
         SELECT r.site_id, r.machine_id, count(c.time) AS n, avg(CAST(c.scrap_flag AS INTEGER)) AS scrap_rate
         FROM req r LEFT JOIN linked c ON c.site_id = r.site_id AND c.machine_id = r.machine_id
          AND c.time <= r.as_of AND c.time > r.as_of - INTERVAL 24 HOUR GROUP BY r.site_id, r.machine_id),
       joined AS (
         SELECT r.*, (epoch_us(r.as_of) - epoch_us(l.time)) / 1e6 AS freshness_s, l.time AS last_cycle_at,
                l.production_order_id AS current_order_id, c.n AS cycle_count_24h, c.scrap_rate,
                l.data_quality_status
         FROM req r LEFT JOIN last l ON l.site_id = r.site_id AND l.machine_id = r.machine_id
         JOIN recent c ON c.site_id = r.site_id AND c.machine_id = r.machine_id)
       SELECT site_id, machine_id, as_of,
              CASE WHEN freshness_s IS NULL OR freshness_s > 3600 THEN 'offline' WHEN freshness_s > 900 THEN 'stopped'
                   WHEN scrap_rate >= 0.10 THEN 'warning' ELSE 'running' END AS status,
              round(freshness_s, 6) AS freshness_s, last_cycle_at, current_order_id, cycle_count_24h,
              round(scrap_rate, 6) AS scrap_rate_24h, data_quality_status
       FROM joined""",
)
def status_as_of(v: Views) -> DataFrame:
    back = -(F.col("machine_id") % 7 * 15).cast("int")
    requests = v.machines.select(
        "site_id", "machine_id", F.timestamp_add("MINUTE", back, F.lit(AS_OF).cast("timestamp")).alias("as_of")
    )
    return lookup.status_as_of(requests, v.linked)


@query(
    "j8_status_many_instants",
    """, req AS (SELECT DISTINCT site_id, machine_id, started_at AS as_of FROM production_orders),
       seen AS (
         SELECT r.site_id, r.machine_id, r.as_of, max(c.time) AS last_cycle_at,
                arg_max(c.cycle_counter, (c.time, c.cycle_counter)) AS last_counter,
                count(*) FILTER (WHERE c.time > r.as_of - INTERVAL 24 HOUR) AS cycle_count_24h,
                avg(CAST(c.scrap_flag AS INTEGER)) FILTER (WHERE c.time > r.as_of - INTERVAL 24 HOUR) AS scrap_rate
         FROM req r JOIN linked c ON c.site_id = r.site_id AND c.machine_id = r.machine_id AND c.time <= r.as_of
         GROUP BY r.site_id, r.machine_id, r.as_of)
       SELECT s.site_id, s.machine_id, s.as_of, s.last_cycle_at, l.production_order_id AS current_order_id,
              s.cycle_count_24h, round(s.scrap_rate, 6) AS scrap_rate_24h
       FROM seen s JOIN linked l ON l.site_id = s.site_id AND l.machine_id = s.machine_id AND l.cycle_counter = s.last_counter""",
)
def status_many_instants(v: Views) -> DataFrame:
    """Status of each machine at the start of every order."""
    requests = v.orders.select("site_id", "machine_id", F.col("started_at").alias("as_of")).distinct()
    return lookup.status_as_of(requests, v.linked).select(
        "site_id", "machine_id", "as_of", "last_cycle_at", "current_order_id", "cycle_count_24h", "scrap_rate_24h"
    )


@query(
    "j13_affected_history",
    """, affected AS (
         SELECT site_id, machine_id, max(time) AS cutoff FROM cycles WHERE cycle_counter % 997 = 0
         GROUP BY site_id, machine_id)
       SELECT c.site_id, c.machine_id, c.time, c.source_row_hash
       FROM cycles c JOIN affected a ON a.site_id = c.site_id AND a.machine_id = c.machine_id AND c.time <= a.cutoff""",
)
def affected_history(v: Views) -> DataFrame:
    batch = v.cycles.where(F.col("cycle_counter") % 997 == 0)
    return lookup.affected_history(v.cycles, batch).select("site_id", "machine_id", "time", "source_row_hash")


@query(
    "j14_latest_run_evidence",
    """, runs AS (
         SELECT job_id AS run_id, job_id % 700 AS incident_id, status, discovered_at AS started_at, completed_at
         FROM import_jobs),
       newest AS (
         SELECT incident_id, run_id FROM (
           SELECT *, row_number() OVER (PARTITION BY incident_id
                     ORDER BY completed_at DESC NULLS LAST, started_at DESC, run_id DESC) AS n
           FROM runs WHERE status = 'completed') WHERE n = 1)
       SELECT l_orderkey AS run_id, n.incident_id, l_linenumber AS evidence_no, l_quantity AS delta
       FROM lineitem JOIN newest n ON n.run_id = l_orderkey""",
)
def latest_run_evidence(v: Views) -> DataFrame:
    runs = v.import_jobs.select(
        F.col("job_id").alias("run_id"),
        (F.col("job_id") % 700).alias("incident_id"),
        "status",
        F.col("discovered_at").alias("started_at"),
        "completed_at",
    )
    evidence = v.table("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_linenumber").alias("evidence_no"),
        F.col("l_quantity").alias("delta"),
    )
    return lookup.latest_run_evidence(runs, evidence)


@query(
    "j15_planned_vs_measured",
    """SELECT site_id, machine_id, id, product_ref, planned_cycle_s, round(m, 6) AS measured_cycle_s, cycle_count,
              round((m - planned_cycle_s) / nullif(planned_cycle_s, 0) * 100, 6) AS delta_pct
       FROM (SELECT o.site_id, o.machine_id, o.id, o.product_ref, o.erp_cycle_time_s AS planned_cycle_s,
                    avg(c.cycle_time_s) AS m, count(c.time) AS cycle_count
             FROM production_orders o LEFT JOIN linked c
               ON c.site_id = o.site_id AND c.machine_id = o.machine_id AND c.production_order_id = o.id
             WHERE o.erp_cycle_time_s IS NOT NULL
             GROUP BY o.site_id, o.machine_id, o.id, o.product_ref, o.erp_cycle_time_s)
       WHERE cycle_count > 0""",
)
def planned_vs_measured(v: Views) -> DataFrame:
    return rollups.planned_vs_measured(v.orders, v.linked)


@query(
    "j16_topology",
    """SELECT m.site_id, m.machine_id, m.erp_ref, m.brand, l.code AS line_code,
              (SELECT count(*) FROM incidents i WHERE i.site_id = m.site_id AND i.machine_id = m.machine_id
                 AND i.status = 'open') AS open_incidents
       FROM machines m LEFT JOIN lines l ON l.line_id = m.line_id""",
)
def topology(v: Views) -> DataFrame:
    return rollups.machine_topology(v.machines, v.lines, v.incidents)


@query(
    "j17_new_files",
    """SELECT j.job_id, j.site_id, j.file_hash FROM import_jobs j
       WHERE NOT EXISTS (SELECT 1 FROM passports p WHERE p.site_id = j.site_id AND p.file_hash = j.file_hash
                           AND p.status = 'completed')""",
)
def new_files(v: Views) -> DataFrame:
    done = v.passports.where(F.col("status") == "completed")
    return lookup.new_rows(v.import_jobs.select("job_id", "site_id", "file_hash"), done, ["site_id", "file_hash"])


@query(
    "j18_order_exists",
    """, rows AS (
         SELECT site_id, event_id, CASE WHEN k % 4 <> 0 THEN 'OF-' || lpad(CAST(event_id % 5000 AS VARCHAR), 10, '0') END
                  AS production_order_id
         FROM ev)
       SELECT r.event_id, r.production_order_id,
              r.production_order_id IS NULL OR EXISTS (
                SELECT 1 FROM production_orders o WHERE o.site_id = r.site_id AND o.id = r.production_order_id)
                AS order_known
       FROM rows r""",
)
def order_exists(v: Views) -> DataFrame:
    number = F.lpad((F.col("event_id") % 5000).cast("string"), 10, "0")
    rows = v.events.select(
        "site_id",
        "event_id",
        F.when(F.col("k") % 4 != 0, F.concat(F.lit("OF-"), number)).alias("production_order_id"),
    )
    return lookup.with_order_known(rows, v.orders).drop("site_id")


@query(
    "w12_downtime_segments",
    """SELECT c.source_row_hash,
              EXISTS (SELECT 1 FROM maintenance_events m WHERE m.site_id = c.site_id AND m.machine_id = c.machine_id
                        AND m.started_at <= c.time AND m.ended_at >= c.time) AS in_downtime,
              (SELECT count(*) FROM maintenance_events m WHERE m.site_id = c.site_id
                 AND m.machine_id = c.machine_id AND m.started_at <= c.time) AS segment_no
       FROM cycles c""",
)
def downtime_segments(v: Views) -> DataFrame:
    return intervals.split_by_downtime(v.cycles, v.maintenance_events).select(
        "source_row_hash", "in_downtime", "segment_no"
    )


@query(
    "s9_window_rows",
    """SELECT time, source_row_hash, cycle_time_s, scrap_flag FROM cycles
       WHERE machine_id = 7 AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
         AND coalesce(data_quality_status, 'valid') = 'valid'""",
)
def window_rows(v: Views) -> DataFrame:
    return lookup.window_rows(v.cycles, 7, "2024-01-05", "2024-01-25", valid_only=True).select(
        "time", "source_row_hash", "cycle_time_s", "scrap_flag"
    )


@query(
    "s10_recent_cycles",
    """SELECT site_id, machine_id, time, cycle_counter, switchover_position AS switchover_position_mm, cycle_time_s
       FROM (SELECT *, row_number() OVER (PARTITION BY site_id, machine_id
                        ORDER BY time DESC, cycle_counter DESC NULLS LAST, source_row_hash DESC NULLS LAST) AS n
             FROM cycles WHERE time <= TIMESTAMP '2024-01-20 12:00:00') WHERE n <= 20""",
)
def recent_cycles(v: Views) -> DataFrame:
    return lookup.recent_cycles(v.cycles, AS_OF, 20).select(
        "site_id", "machine_id", "time", "cycle_counter", "switchover_position_mm", "cycle_time_s"
    )
