"""Registered queries: scalar functions, row validation, merge policies and ledgers."""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import DataFrame, functions as F

from cyclelake.functions import text, times, values
from cyclelake.operators import sinks, validation
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views, _sql_list, pick
from cyclelake.schema import FEATURE_BOUNDS, SITE_MACHINE
from cyclelake.session import shared_folder


@query(
    "m1_normalised_labels",
    r"""SELECT c_custkey, translate(regexp_replace(trim(lower(c_name || ' É-Cycle.Temps_ù ' || c_mktsegment)), '[\s_\-.]+', '', 'g'),
              'éèêàâùôîç', 'eeeaauoic') AS label FROM customer""",
)
def normalised_labels(v: Views) -> DataFrame:
    label = F.concat("c_name", F.lit(" É-Cycle.Temps_ù "), "c_mktsegment")
    return v.table("customer").select("c_custkey", text.normalise_label(label).alias("label"))


RAW_TEXT_SQL = """
raw AS (
  SELECT event_id, CASE k % 6 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'null' WHEN 2 THEN replace(CAST(k / 4.0 AS VARCHAR), '.', ',')
           WHEN 3 THEN ' ' || CAST(k AS VARCHAR) WHEN 4 THEN 'abc' ELSE '' END AS t FROM ev)"""


def _raw_text(v: Views) -> DataFrame:
    k = F.col("k")
    quarter = F.replace((k.cast("double") / 4.0).cast("string"), F.lit("."), F.lit(","))
    word = (
        F.when(k % 6 == 0, F.lit(" N/A "))
        .when(k % 6 == 1, F.lit("null"))
        .when(k % 6 == 2, quarter)
        .when(k % 6 == 3, F.concat(F.lit(" "), k.cast("string")))
        .when(k % 6 == 4, F.lit("abc"))
        .otherwise(F.lit(""))
    )
    return v.events.select("event_id", word.alias("t"))


# Characters with names of the Latin, Greek, full-width, superscript, letter-like and squared-unit blocks.
_BLOCKS = [(0xA1, 0x250), (0x1E00, 0x1F00), (0x370, 0x400), (0x1F00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFF01, 0xFF5F), (0x3371, 0x33E0)]
FOLDED = [chr(p) for low, high in _BLOCKS for p in range(low, high) if unicodedata.name(chr(p), "") and not chr(p).isspace()]


def _plain(label: str) -> str:
    decomposed = unicodedata.normalize("NFKD", label).casefold()
    return re.sub(r"[\s_.\-/\\]+", "", "".join(c for c in decomposed if not unicodedata.combining(c)))


@query(
    "m1_structural_labels",
    f"""SELECT event_id, ({_sql_list([_plain("Zone_" + c + " No. É" + c) for c in FOLDED])})[event_id % {len(FOLDED)} + 1] AS label FROM ev""",
)
def structural_labels(v: Views) -> DataFrame:
    from cyclelake.functions.text import fold_label

    char = F.substring(F.lit("".join(FOLDED)), (F.col("event_id") % len(FOLDED) + 1).cast("int"), F.lit(1))
    return v.events.select("event_id", fold_label(F.concat(F.lit("Zone_"), char, F.lit(" No. É"), char)).alias("label"))


@query(
    "m5_null_tokens",
    f""", {RAW_TEXT_SQL} SELECT event_id, CASE WHEN lower(trim(t)) NOT IN ('', 'nan', 'nat', 'n/a', 'na', 'null', 'none')
         THEN trim(t) END AS value FROM raw""",
)
def null_tokens(v: Views) -> DataFrame:
    return _raw_text(v).select("event_id", text.null_if_token(F.col("t")).alias("value"))


@query(
    "m6_decimal_text",
    f", {RAW_TEXT_SQL} SELECT event_id, TRY_CAST(replace(trim(t), ',', '.') AS DOUBLE) AS value FROM raw",
)
def decimal_text(v: Views) -> DataFrame:
    return _raw_text(v).select("event_id", values.decimal_text(F.col("t")).alias("value"))


@query(
    "m7_scaled_values",
    """SELECT event_id, round(value * 0.001, 6) AS seconds, round(value * CAST(0.0689475729 AS DOUBLE), 6) AS bar FROM ev""",
)
def scaled_values(v: Views) -> DataFrame:
    factor = lambda a, b: values.unit_factor(F.lit(a), F.lit(b))
    return v.events.select(
        "event_id",
        (F.col("value") * factor("ms", "s")).alias("seconds"),
        (F.col("value") * factor("psi", "bar")).alias("bar"),
    )


@query(
    "m10_mapping_confidence",
    """SELECT site_id, machine_id, round(avg(CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 ELSE 0.0 END), 6) AS confidence
       FROM ev GROUP BY site_id, machine_id""",
)
def mapping_confidence(v: Views) -> DataFrame:
    per_column = F.when(F.col("k") % 3 == 0, 1.0).when(F.col("k") % 3 == 1, 0.75).otherwise(0.0)
    return v.events.groupBy(*SITE_MACHINE).agg(F.avg(per_column).alias("confidence"))


TIME_TEXT_SQL = """
tt AS (
  SELECT event_id, date_trunc('second', time) AS s, date_trunc('minute', time) AS m,
         CASE k % 7 WHEN 0 THEN CAST(epoch_us(date_trunc('second', time)) // 1000000 AS VARCHAR)
           WHEN 1 THEN strftime(time, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(time, '%d/%m/%Y %H:%M:%S')
           WHEN 3 THEN strftime(time, '%d.%m.%Y %H:%M') WHEN 4 THEN strftime(time, '%Y-%m-%d %H:%M:%S')
           WHEN 5 THEN 'not a time' ELSE strftime(time, '%d.%m.%y %H:%M:%S') END AS t, k FROM ev)"""


@query(
    "m11_parsed_times",
    f", {TIME_TEXT_SQL} SELECT event_id, CASE WHEN k % 7 = 3 THEN m WHEN k % 7 <> 5 THEN s END AS parsed FROM tt",
)
def parsed_times(v: Views) -> DataFrame:
    k, t = F.col("k"), F.col("time")
    word = (
        F.when(k % 7 == 0, F.unix_seconds("time").cast("string"))
        .when(k % 7 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k % 7 == 2, F.date_format(t, "dd/MM/yyyy HH:mm:ss"))
        .when(k % 7 == 3, F.date_format(t, "dd.MM.yyyy HH:mm"))
        .when(k % 7 == 4, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 7 == 5, F.lit("not a time"))
        .otherwise(F.date_format(t, "dd.MM.yy HH:mm:ss"))
    )
    return v.events.select("event_id", times.parse_source_time(word).alias("parsed"))


@query(
    "m13_day_fraction",
    """SELECT event_id, TIMESTAMP '2025-02-11' + to_seconds(CAST(floor((k * 0.0078125) * 86400) AS BIGINT)) AS t FROM ev""",
)
def day_fraction(v: Views) -> DataFrame:
    word = F.replace((F.col("k") * F.lit(0.0078125)).cast("string"), F.lit("."), F.lit(","))
    return v.events.select(
        "event_id", times.day_fraction_time(F.lit("2025-02-11").cast("date"), word).alias("t")
    )


@query(
    "m14_local_to_utc",
    "SELECT event_id, time - INTERVAL 1 HOUR AS utc FROM ev",
)
def local_to_utc(v: Views) -> DataFrame:
    # the view covers January only: Europe/Paris is one hour ahead
    return v.events.select("event_id", times.local_to_utc(F.col("time"), "Europe/Paris").alias("utc"))


@query(
    "m15_flags",
    """, f AS (SELECT event_id, (['true', '1', 'Yes', 'oui', '0', 'no', '2.5', NULL, ''])[k % 9 + 1] AS t FROM ev)
       SELECT event_id, CASE WHEN t IS NULL OR t = '' THEN FALSE ELSE lower(t) IN ('true', '1', 'yes', 'y', 'oui')
                OR coalesce(TRY_CAST(t AS DOUBLE), 0) <> 0 END AS flag,
              CASE WHEN t IS NULL OR t = '' OR lower(t) IN ('true', '1', 'yes', 'y', 'oui')
                OR coalesce(TRY_CAST(t AS DOUBLE), 0) <> 0 THEN 1 ELSE 0 END AS good_parts FROM f""",
)
def flags(v: Views) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("true", "1", "Yes", "oui", "0", "no", "2.5")], F.lit(None), F.lit(""))
    word = F.element_at(words, F.col("k") % 9 + 1)
    return v.events.select(
        "event_id", values.flag(word).alias("flag"), values.good_part_count(word).alias("good_parts")
    )


@query(
    "m16_part_quality",
    """SELECT source_row_hash, CASE WHEN scrap_flag THEN 'scrap' ELSE 'good' END AS status,
              CASE WHEN lower(trim(coalesce(defect_type, 'good'))) NOT IN ('', 'good', 'ok', 'valid') THEN trim(defect_type) END
                AS defect FROM cycles""",
)
def part_quality(v: Views) -> DataFrame:
    return v.cycles.select(
        "source_row_hash",
        values.part_status(F.col("scrap_flag")).alias("status"),
        values.part_defect(F.col("defect_type")).alias("defect"),
    )


@query(
    "m17_raw_fallback",
    "SELECT event_id, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'raw' || CAST(k AS VARCHAR) END AS value FROM ev",
)
def raw_fallback(v: Views) -> DataFrame:
    k = F.col("k")
    raw = F.create_map(F.lit("cushion_mm"), F.concat(F.lit("raw"), k.cast("string")))
    canonical = F.when(k % 2 == 0, k.cast("string"))
    return v.events.select("event_id", values.canonical_or_raw(canonical, raw, "cushion_mm").alias("value"))


@query(
    "m19_plausibility",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.5 OR l_discount * 10 > 3600 THEN 'outlier' ELSE 'valid' END
                AS quality_flag FROM lineitem""",
)
def plausibility(v: Views) -> DataFrame:
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", values.plausibility(F.col("l_discount") * 10).alias("quality_flag")
    )


ORDER_REQUEST_SQL = """
asked AS (
  SELECT source_row_hash, production_order_id, (['OF-0000000100', 'OF-0000002000 to OF-0000005000', NULL, ''])[cycle_counter % 4 + 1]
           AS requested FROM linked)"""


def _order_requests(v: Views) -> DataFrame:
    words = F.array(F.lit("OF-0000000100"), F.lit("OF-0000002000 to OF-0000005000"), F.lit(None), F.lit(""))
    return v.linked.select(
        "source_row_hash",
        "production_order_id",
        F.element_at(words, (F.col("cycle_counter") % 4 + 1).cast("int")).alias("requested"),
    )


@query(
    "m20_order_matches",
    f""", {ORDER_REQUEST_SQL} SELECT source_row_hash, CASE WHEN requested IS NULL THEN TRUE WHEN production_order_id IS NULL THEN FALSE
         WHEN requested LIKE '% to %' THEN production_order_id BETWEEN 'OF-0000002000' AND 'OF-0000005000'
         ELSE production_order_id = requested END AS matches FROM asked""",
)
def order_matches(v: Views) -> DataFrame:
    return _order_requests(v).select(
        "source_row_hash", values.order_matches(F.col("production_order_id"), F.col("requested")).alias("matches")
    )


@query(
    "m21_order_related",
    f""", {ORDER_REQUEST_SQL} SELECT source_row_hash, CASE WHEN coalesce(requested, '') = '' OR production_order_id IS NULL THEN TRUE
         WHEN requested LIKE '% to %' THEN production_order_id IN ('OF-0000002000', 'OF-0000005000')
         ELSE production_order_id = requested END AS related FROM asked""",
)
def order_related(v: Views) -> DataFrame:
    return _order_requests(v).select(
        "source_row_hash", values.order_related(F.col("production_order_id"), F.col("requested")).alias("related")
    )


@query(
    "m22_first_finite",
    """, f AS (SELECT event_id, k, (['nan', 'inf', '', 'x', '1.5'])[k % 5 + 1] AS a FROM ev)
       SELECT event_id, CASE WHEN k % 5 = 4 THEN 1.5 ELSE CAST(k AS DOUBLE) END AS value FROM f""",
)
def first_finite(v: Views) -> DataFrame:
    word = pick(["nan", "inf", "", "x", "1.5"], F.col("k") % 5)
    return v.events.select("event_id", values.first_finite(word, F.col("k")).alias("value"))


@query(
    "m23_scrap_predicates",
    """SELECT source_row_hash, scrap_flag OR part_quality_status IN ('scrap', 'reject') AS scrap,
              scrap_flag OR part_quality_status = 'scrap' AS detector_scrap FROM cycles""",
)
def scrap_predicates(v: Views) -> DataFrame:
    args = F.col("scrap_flag"), F.col("part_quality_status")
    return v.cycles.select(
        "source_row_hash",
        values.is_scrap(*args).alias("scrap"),
        values.is_detector_scrap(*args).alias("detector_scrap"),
    )


@query(
    "m24_defect_tokens",
    """, d AS (SELECT event_id, (['Short_Shot; flash', 'good', 'a|b,c', '', NULL])[k % 5 + 1] AS t FROM ev)
       SELECT event_id, CASE t WHEN 'Short_Shot; flash' THEN 'short_shot/flash' WHEN 'a|b,c' THEN 'a/b/c' ELSE '' END AS tokens FROM d""",
)
def defect_tokens(v: Views) -> DataFrame:
    words = F.array(F.lit("Short_Shot; flash"), F.lit("good"), F.lit("a|b,c"), F.lit(""), F.lit(None))
    word = F.element_at(words, F.col("k") % 5 + 1)
    return v.events.select("event_id", F.array_join(text.defect_tokens(word), "/").alias("tokens"))


@query(
    "m25_keyword_evidence",
    """, n AS (SELECT note_id, lower(note_text) AS t FROM operator_notes)
       SELECT note_id, t LIKE '%short shot%' OR t LIKE '%zone 2%' AS zone_2,
              t LIKE '%bulle%' OR t LIKE '%sechage%' OR t LIKE '%matiere%' OR t LIKE '%granule%' AS material,
              t LIKE '%usure%' OR t LIKE '%cotes%' OR t LIKE '%derive dimensionnelle%' OR t LIKE '%moule%' AS wear FROM n""",
)
def keyword_evidence(v: Views) -> DataFrame:
    note = F.col("note_text")
    return v.operator_notes.select(
        "note_id",
        text.mentions(note, "zone_2_note").alias("zone_2"),
        text.mentions(note, "material_note").alias("material"),
        text.mentions(note, "wear_note").alias("wear"),
    )


@query(
    "m26_valid_data",
    "SELECT source_row_hash FROM cycles WHERE coalesce(data_quality_status, 'valid') = 'valid'",
)
def valid_data(v: Views) -> DataFrame:
    return v.cycles.where(values.is_valid_data(F.col("data_quality_status"))).select("source_row_hash")


@query(
    "m28_machine_state",
    """SELECT event_id, CASE WHEN k % 4 = 0 THEN 'offline' WHEN k % 4 = 1 THEN 'stopped' WHEN event_type = 'error' THEN 'warning'
              ELSE 'running' END AS state FROM ev""",
)
def machine_state(v: Views) -> DataFrame:
    k = F.col("k")
    return v.events.select(
        "event_id",
        F.when(k % 4 == 0, "offline")
        .when(k % 4 == 1, "stopped")
        .when(F.col("event_type") == "error", "warning")
        .otherwise("running")
        .alias("state"),
    )


@query(
    "v1_missing_times",
    """SELECT event_id, 'missing_timestamp' AS issue_type, 'warning' AS severity FROM ev WHERE k % 11 = 0""",
)
def missing_times(v: Views) -> DataFrame:
    rows = v.events.withColumn("time", F.when(F.col("k") % 11 != 0, F.col("time")))
    _, rejected = validation.split_rows(validation.check_machine_rows(rows), ["event_id"])
    return rejected.select("event_id", "issue_type", "severity")


@query(
    "v2_invalid_orders",
    """, o AS (
         SELECT event_id, CASE WHEN k % 9 <> 0 THEN 'OF' || event_id END AS id, CASE WHEN k % 8 <> 0 THEN machine_id END AS machine_id,
                CASE WHEN k % 7 <> 0 THEN time END AS started_at FROM ev WHERE event_type = 'purchase')
       SELECT event_id, 'missing_order_id' AS issue_type FROM o WHERE id IS NULL
       UNION ALL SELECT event_id, 'invalid_erp_order' FROM o WHERE id IS NULL OR machine_id IS NULL OR started_at IS NULL""",
)
def invalid_orders(v: Views) -> DataFrame:
    k = F.col("k")
    rows = v.events.where(F.col("event_type") == "purchase").select(
        "event_id",
        F.when(k % 9 != 0, F.concat(F.lit("OF"), F.col("event_id").cast("string"))).alias("id"),
        F.when(k % 8 != 0, F.col("machine_id")).alias("machine_id"),
        F.col("machine_id").cast("string").alias("machine_erp_ref"),
        F.when(k % 7 != 0, F.col("time")).alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        F.lit(8.0).alias("erp_available_time_h"),
    )
    _, rejected = validation.split_rows(validation.check_orders(rows), ["event_id"])
    return rejected.select("event_id", "issue_type")


@query(
    "v2_order_end_default",
    """SELECT event_id, time + to_microseconds(CAST(k * CAST(900000000 AS BIGINT) AS BIGINT)) AS ended_at FROM ev
       WHERE event_type = 'purchase' AND k > 0""",
)
def order_end_default(v: Views) -> DataFrame:
    rows = v.events.where((F.col("event_type") == "purchase") & (F.col("k") > 0)).select(
        "event_id",
        F.lit("x").alias("id"),
        "machine_id",
        F.lit("x").alias("machine_erp_ref"),
        F.col("time").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
        (F.col("k") * 0.25).alias("erp_available_time_h"),
    )
    accepted, _ = validation.split_rows(validation.check_orders(rows), ["event_id"])
    return accepted.select("event_id", "ended_at")


@query(
    "v3_invalid_context",
    """, c AS (SELECT event_id, site_id, CASE WHEN k % 12 <> 0 THEN machine_id END AS machine_id,
                CASE WHEN k % 4 <> 0 THEN 'OF-' || lpad(CAST(event_id % 5000 AS VARCHAR), 10, '0') END AS oid FROM ev)
       SELECT event_id, 'invalid_context_row' AS issue_type FROM c WHERE machine_id IS NULL OR (oid IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM production_orders o WHERE o.site_id = c.site_id AND o.id = c.oid))""",
)
def invalid_context(v: Views) -> DataFrame:
    k = F.col("k")
    rows = v.events.select(
        "event_id",
        "site_id",
        "time",
        F.when(k % 12 != 0, F.col("machine_id")).alias("machine_id"),
        F.col("machine_id").cast("string").alias("machine_erp_ref"),
        F.when(
            k % 4 != 0, F.concat(F.lit("OF-"), F.lpad((F.col("event_id") % 5000).cast("string"), 10, "0"))
        ).alias("production_order_id"),
    )
    _, rejected = validation.split_rows(validation.check_context(rows, v.orders), ["event_id"])
    return rejected.select("event_id", "issue_type")


EXPORT_SQL = """
ex AS (
  SELECT event_id, CASE WHEN k % 13 <> 0 THEN time END AS time, CASE WHEN k % 17 <> 0 THEN machine_id END AS machine_id,
         CASE WHEN k % 19 = 0 THEN -value ELSE value END AS cycle_time_s, CASE WHEN k % 23 = 0 THEN 999999.0 ELSE 100.0 END AS p FROM ev)"""


@query(
    "v4_export_rows",
    f""", {EXPORT_SQL}
       SELECT event_id, 'missing_timestamp' AS issue_type FROM ex WHERE time IS NULL
       UNION ALL SELECT event_id, 'missing_machine' FROM ex WHERE machine_id IS NULL
       UNION ALL SELECT event_id, 'negative_duration' FROM ex WHERE cycle_time_s < 0
       UNION ALL SELECT event_id, 'pressure_out_of_range' FROM ex WHERE p > 50000""",
)
def export_rows(v: Views) -> DataFrame:
    k = F.col("k")
    rows = v.events.select(
        "event_id",
        F.when(k % 13 != 0, F.col("time")).alias("time"),
        F.when(k % 17 != 0, F.col("machine_id")).alias("machine_id"),
        F.when(k % 19 == 0, -F.col("value")).otherwise(F.col("value")).alias("cycle_time_s"),
        F.when(k % 23 == 0, 999999.0).otherwise(100.0).alias("peak_pressure_bar"),
    )
    _, rejected = validation.split_rows(validation.check_export_rows(rows), ["event_id"])
    return rejected.select("event_id", "issue_type")


@query(
    "v5_invalid_values",
    """, t AS (
         SELECT event_id, k, (['12,5', 'abc', '-3', 'inf', NULL])[k % 5 + 1] AS cycle_time_s,
                (['100', '60000'])[k % 2 + 1] AS peak_pressure_bar, (['0.5', '1.5', '-0.1'])[k % 3 + 1] AS erp_trs,
                (['10', '-1'])[k % 2 + 1] AS nb_cycles, (['2024-01-01 10:00:00', 'soon', ''])[k % 3 + 1] AS started_at FROM ev)
       SELECT event_id, 'cycle_time_s' AS field, CASE k % 5 WHEN 1 THEN 'invalid_numeric' WHEN 2 THEN 'negative_duration'
                ELSE 'non_finite' END AS code FROM t WHERE k % 5 IN (1, 2, 3)
       UNION ALL SELECT event_id, 'peak_pressure_bar', 'pressure_out_of_range' FROM t WHERE k % 2 = 1
       UNION ALL SELECT event_id, 'erp_trs', 'ratio_out_of_range' FROM t WHERE k % 3 IN (1, 2)
       UNION ALL SELECT event_id, 'nb_cycles', 'negative_value' FROM t WHERE k % 2 = 1
       UNION ALL SELECT event_id, 'started_at', 'invalid_timestamp' FROM t WHERE k % 3 = 1
       UNION ALL SELECT event_id, 'started_at', 'missing_timestamp' FROM t WHERE k % 3 = 2""",
)
def invalid_values(v: Views) -> DataFrame:
    k = F.col("k")
    words = F.array(F.lit("12,5"), F.lit("abc"), F.lit("-3"), F.lit("inf"), F.lit(None))
    rows = v.events.select(
        "event_id",
        F.element_at(words, k % 5 + 1).alias("cycle_time_s"),
        pick(["100", "60000"], k % 2).alias("peak_pressure_bar"),
        pick(["0.5", "1.5", "-0.1"], k % 3).alias("erp_trs"),
        pick(["10", "-1"], k % 2).alias("nb_cycles"),
        pick(["2024-01-01 10:00:00", "soon", ""], k % 3).alias("started_at"),
    )
    return validation.invalid_values(rows, ["started_at"], ["event_id"])


@query(
    "v6_missing_in_all_rows",
    """SELECT 'production_order_id' AS field, count(*) AS rows, 0 AS filled, TRUE AS missing FROM cycles
       UNION ALL SELECT 'defect_type', count(*), count(defect_type), count(defect_type) = 0 FROM cycles
       UNION ALL SELECT 'time', count(*), count(time), count(time) = 0 FROM cycles""",
)
def missing_in_all_rows(v: Views) -> DataFrame:
    return validation.missing_in_all_rows(v.cycles, ["production_order_id", "defect_type", "time"])


@query(
    "v7_site_mismatches",
    """, r AS (SELECT CASE WHEN k % 10 = 0 THEN 1 ELSE site_id END AS site_id, machine_id FROM ev)
       SELECT r.site_id, count(*) FILTER (WHERE r.site_id <> m.site_id) AS mismatches
       FROM r JOIN machines m ON m.machine_id = r.machine_id GROUP BY r.site_id""",
)
def site_mismatches(v: Views) -> DataFrame:
    rows = v.events.select(
        F.when(F.col("k") % 10 == 0, F.lit(1).cast("bigint")).otherwise(F.col("site_id")).alias("site_id"),
        "machine_id",
    )
    return validation.site_mismatches(rows, v.machines)


@query(
    "v8_duplicate_hashes",
    "SELECT site_id, file_hash, count(*) AS copies FROM import_jobs GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_hashes(v: Views) -> DataFrame:
    return validation.duplicate_hashes(v.import_jobs)


@query(
    "v8_ambiguous_aliases",
    """SELECT site_id, alias_value, count(DISTINCT machine_id) AS machines FROM (
         SELECT site_id, erp_ref AS alias_value, machine_id FROM machines
         UNION ALL SELECT site_id, alias_value, machine_id FROM machine_aliases)
       GROUP BY 1, 2 HAVING count(DISTINCT machine_id) > 1""",
)
def ambiguous_aliases(v: Views) -> DataFrame:
    return validation.ambiguous_aliases(v.machines, v.machine_aliases)


@query(
    "v9_order_coverage",
    """SELECT c.site_id, count(*) AS linked, round(avg(CAST(c.time >= o.started_at AND (o.ended_at IS NULL OR c.time <= o.ended_at)
                AS INTEGER)), 6) AS inside_share
       FROM linked c JOIN production_orders o ON o.site_id = c.site_id AND o.id = c.production_order_id GROUP BY c.site_id""",
)
def order_coverage(v: Views) -> DataFrame:
    return validation.order_coverage(v.linked, v.orders)


@query(
    "v9_missing_orders",
    """, claimed AS (SELECT site_id, 'OF-' || lpad(CAST(cycle_counter AS VARCHAR), 10, '0') AS production_order_id FROM cycles)
       SELECT site_id, count(*) AS unknown_orders FROM claimed c WHERE NOT EXISTS (
         SELECT 1 FROM production_orders o WHERE o.site_id = c.site_id AND o.id = c.production_order_id) GROUP BY site_id""",
)
def missing_orders(v: Views) -> DataFrame:
    own = F.concat(F.lit("OF-"), F.lpad(F.col("cycle_counter").cast("string"), 10, "0"))
    return validation.missing_orders(v.cycles.withColumn("production_order_id", own), v.orders)


@query(
    "v9_defect_overlap",
    """, a AS (SELECT site_id, list(DISTINCT defect_type) AS d FROM cycles WHERE defect_type IS NOT NULL GROUP BY site_id),
       b AS (SELECT site_id, list(DISTINCT defect_type) AS d FROM quality_checks WHERE defect_type IS NOT NULL GROUP BY site_id)
       SELECT a.site_id, CAST(len(list_intersect(a.d, b.d)) AS INTEGER) AS shared_types,
              array_to_string(list_sort(list_intersect(a.d, b.d)), ',') AS shared FROM a JOIN b USING (site_id)""",
)
def defect_overlap(v: Views) -> DataFrame:
    return validation.defect_overlap(v.cycles, v.quality_checks)


_BOUNDED = [f for f in FEATURE_BOUNDS if f != "switchover_position_mm"]


@query(
    "v10_out_of_bounds",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} NOT BETWEEN {FEATURE_BOUNDS[f][0]} AND {FEATURE_BOUNDS[f][1]})"
        f" AS out_of_bounds FROM cycles"
        for f in _BOUNDED
    ),
)
def out_of_bounds(v: Views) -> DataFrame:
    return validation.out_of_bounds(v.cycles)


@query(
    "v12_score_requests",
    """, r AS (SELECT event_id // 3 + (CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS request, CASE WHEN k % 20 <> 0 THEN time END AS time,
                CASE WHEN k % 3 = 0 THEN machine_id ELSE 1 END AS machine_id, CASE WHEN k % 2 = 0 THEN value END AS value FROM ev)
       SELECT request, count(*) AS cycles, count(DISTINCT machine_id) AS machines,
              CASE WHEN count(*) < 3 THEN 'too_few_cycles' WHEN count(time) < count(*) THEN 'timestamps_invalid'
                   WHEN count(DISTINCT machine_id) <> 1 THEN 'multiple_machines' WHEN count(value) = 0 THEN 'raw_features_missing'
                   ELSE 'ok' END AS status FROM r GROUP BY request""",
)
def score_requests(v: Views) -> DataFrame:
    k = F.col("k")
    rows = v.events.select(
        (F.floor(F.col("event_id") / 3) + F.when(k % 9 == 0, 1).otherwise(0)).alias("request"),
        F.when(k % 20 != 0, F.col("time")).alias("time"),
        F.when(k % 3 == 0, F.col("machine_id")).otherwise(1).alias("machine_id"),
        F.when(k % 2 == 0, F.col("value")).alias("value"),
    )
    return validation.check_score_requests(rows, "request", ["value"])


@query(
    "v13_session_readiness",
    """, f AS (SELECT o_custkey AS session_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'h' END AS h, o_orderkey % 17 <> 0 AS cols,
                o_orderstatus <> 'P' OR o_orderkey % 2 = 0 AS okay FROM orders)
       SELECT session_id, count(*) AS files, count(*) FILTER (WHERE h IS NOT NULL AND cols AND okay) AS ready_files,
              count(*) = count(*) FILTER (WHERE h IS NOT NULL AND cols AND okay) AS ready FROM f GROUP BY session_id""",
)
def session_readiness(v: Views) -> DataFrame:
    o = F.col("o_orderkey")
    files = v.table("orders").select(
        F.col("o_custkey").alias("session_id"),
        F.when(o % 13 != 0, F.lit("h")).alias("file_hash"),
        F.when(o % 17 != 0, F.lit('["time","cycle"]')).otherwise(F.lit("[]")).alias("columns_json"),
        F.when((F.col("o_orderstatus") != "P") | (o % 2 == 0), "validated").otherwise("received").alias("status"),
    )
    return validation.session_readiness(files)


@query(
    "k1_rows_to_append",
    """SELECT DISTINCT site_id, machine_id, time, source_row_hash FROM cycles WHERE cycle_counter % 3 <> 0""",
)
def rows_to_append(v: Views) -> DataFrame:
    arriving = v.cycles.unionByName(v.cycles.where(F.col("cycle_counter") % 5 == 0))
    present = v.cycles.where(F.col("cycle_counter") % 3 == 0)
    return sinks.rows_to_append(arriving, present).select("site_id", "machine_id", "time", "source_row_hash")


@query(
    "k2_staged_rows",
    """SELECT event_id AS source_line_no, 'machine_cycle' AS source_kind, CASE WHEN k % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
              CASE WHEN k % 11 = 0 THEN 'missing_timestamp' END AS error_code FROM ev""",
)
def staged_rows(v: Views) -> DataFrame:
    rows = v.events.withColumn("time", F.when(F.col("k") % 11 != 0, F.col("time")))
    code = F.when(F.col("time").isNull(), F.lit("missing_timestamp"))
    return sinks.stage_rows(rows, "machine_cycle", "event_id", code).select(
        "source_line_no", "source_kind", "status", "error_code"
    )


@query(
    "k3_dead_letters",
    """SELECT source_row_hash, 'outlier_value' AS issue_type, 'warning' AS severity, 'cycle_time_s' AS field_name
       FROM cycles WHERE cycle_time_s < 0.5 OR cycle_time_s > 3600""",
)
def dead_letters(v: Views) -> DataFrame:
    _, rejected = validation.split_rows(validation.check_cycle_times(v.cycles), ["source_row_hash"])
    return rejected.drop("raw_value")


@query(
    "k4_upserted_orders",
    """, versions AS (SELECT 1 + user_id % 3 AS site_id, 'OF' || CAST(event_id % 700 AS VARCHAR) AS id, event_id AS load_sequence, value FROM events)
       SELECT site_id, id, load_sequence, value FROM (
         SELECT *, row_number() OVER (PARTITION BY site_id, id ORDER BY load_sequence DESC) AS n FROM versions) WHERE n = 1""",
)
def upserted_orders(v: Views) -> DataFrame:
    versions = v.events.select(
        "site_id",
        F.concat(F.lit("OF"), (F.col("event_id") % 700).cast("string")).alias("id"),
        F.col("event_id").alias("load_sequence"),
        "value",
    )
    old, new = versions.where(F.col("load_sequence") % 2 == 0), versions.where(F.col("load_sequence") % 2 == 1)
    return sinks.last_wins(old, new, ["site_id", "id"], "load_sequence")


@query(
    "k5_upserted_shifts",
    """, sh AS (
         SELECT machine_id, CAST(started_at AS DATE) AS shift_date, 1 + target_quantity // 10 % 3 AS shift_number, id AS production_order_id,
                ended_at FROM production_orders WHERE ended_at IS NOT NULL)
       SELECT machine_id, shift_date, CAST(shift_number AS INTEGER) AS shift_number, production_order_id, ended_at FROM (
         SELECT *, row_number() OVER (PARTITION BY machine_id, shift_date, shift_number ORDER BY production_order_id DESC) AS n
         FROM sh) WHERE n = 1""",
)
def upserted_shifts(v: Views) -> DataFrame:
    rows = sinks.shifts_from_orders(
        v.orders.withColumn("shift_number", (1 + F.floor(F.col("target_quantity") / 10) % 3).cast("int"))
    )
    return sinks.last_wins(rows.limit(0), rows, sinks.SHIFT_KEY, "production_order_id").select(
        *sinks.SHIFT_KEY, "production_order_id", "ended_at"
    )


@query(
    "k6_import_manifest",
    """, st AS (SELECT site_id, 'h' || CAST(machine_id AS VARCHAR) AS file_hash, k % 11 = 0 AS bad FROM ev)
       SELECT site_id, file_hash, count(*) AS row_count_total, count(*) FILTER (WHERE NOT bad) AS row_count_accepted,
              count(*) FILTER (WHERE bad) AS row_count_rejected,
              CASE WHEN count(*) FILTER (WHERE NOT bad) > 0 THEN 'completed' ELSE 'failed' END AS status
       FROM st GROUP BY site_id, file_hash""",
)
def import_manifest(v: Views) -> DataFrame:
    staged = v.events.select(
        "site_id",
        F.concat(F.lit("h"), F.col("machine_id").cast("string")).alias("file_hash"),
        F.when(F.col("k") % 11 == 0, "rejected").otherwise("accepted").alias("status"),
    )
    return sinks.import_manifest(staged)


@query(
    "k7_files_to_load",
    """SELECT j.site_id, j.file_hash, min(j.file_name) AS path FROM import_jobs j
       WHERE NOT EXISTS (SELECT 1 FROM passports p WHERE p.site_id = j.site_id AND p.file_hash = j.file_hash AND p.status = 'completed')
       GROUP BY j.site_id, j.file_hash""",
)
def files_to_load(v: Views) -> DataFrame:
    return sinks.files_to_load(v.import_jobs.withColumnRenamed("file_name", "path"), v.passports)


@query(
    "k8_open_proposals",
    """, arriving AS (
         SELECT event_id % 900 AS incident_id, 'a' || CAST(event_id % 3 AS VARCHAR) AS action_code, max_by('L' || CAST(event_id AS VARCHAR), event_id) AS l
         FROM ev WHERE event_type = 'click' GROUP BY 1, 2),
       old AS (SELECT DISTINCT event_id % 900 AS incident_id, 'a' || CAST(event_id % 3 AS VARCHAR) AS action_code,
                 CASE WHEN event_id % 2 = 0 THEN 'proposed' ELSE 'accepted' END AS status FROM ev WHERE event_type = 'purchase')
       SELECT coalesce(o.incident_id, n.incident_id) AS incident_id, coalesce(o.action_code, n.action_code) AS action_code,
              CASE WHEN o.status IS NULL OR (o.status = 'proposed' AND n.l IS NOT NULL) THEN n.l ELSE 'old' END AS label,
              coalesce(o.status, 'proposed') AS status
       FROM old o FULL JOIN arriving n ON n.incident_id = o.incident_id AND n.action_code = o.action_code""",
)
def open_proposals(v: Views) -> DataFrame:
    e = F.col("event_id")
    action = F.concat(F.lit("a"), (e % 3).cast("string")).alias("action_code")
    arriving = v.events.where(F.col("event_type") == "click").select(
        (e % 900).alias("incident_id"),
        action,
        F.concat(F.lit("L"), e.cast("string")).alias("label"),
        F.lit(None).cast("string").alias("run_id"),
        e.alias("sequence"),
    )
    old = v.events.where(F.col("event_type") == "purchase").select(
        (e % 900).alias("incident_id"),
        action,
        F.lit("old").alias("label"),
        F.lit(None).cast("string").alias("run_id"),
        F.when(e % 2 == 0, "proposed").otherwise("accepted").alias("status"),
    ).dropDuplicates(["incident_id", "action_code"])
    return sinks.upsert_open_proposals(old, arriving).drop("run_id")


@query(
    "k9_decisions",
    """, d AS (SELECT event_id % 500 AS proposal_id, event_id, time, CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'declined' END AS s FROM ev),
       f AS (SELECT proposal_id, s FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY time, event_id) AS n FROM d) WHERE n = 1)
       SELECT p.proposal_id, CASE WHEN p.proposal_id % 3 = 0 THEN 'accepted' WHEN f.s IS NULL THEN 'proposed'
                WHEN f.s = 'approved' THEN 'accepted' ELSE 'rejected' END AS status
       FROM (SELECT c_custkey AS proposal_id FROM customer) p LEFT JOIN f ON f.proposal_id = p.proposal_id""",
)
def decisions(v: Views) -> DataFrame:
    e = F.col("event_id")
    made = v.events.select(
        (e % 500).alias("proposal_id"),
        e.alias("decision_id"),
        F.col("time").alias("decided_at"),
        F.when(F.col("k") % 2 == 0, "approved").otherwise("declined").alias("status"),
    )
    proposals = v.table("customer").select(
        F.col("c_custkey").alias("proposal_id"),
        F.when(F.col("c_custkey") % 3 == 0, "accepted").otherwise("proposed").alias("status"),
    )
    return sinks.resolve_decisions(proposals, made)


@query(
    "k10_new_incidents",
    """SELECT incident_id FROM incidents WHERE machine_id % 2 = 0""",
)
def new_incidents(v: Views) -> DataFrame:
    found = v.incidents.withColumn("detection_key", F.sha2(F.concat_ws(":", "site_id", "machine_id", "incident_id"), 256))
    known = found.where(F.col("machine_id") % 2 == 1)
    return sinks.rows_to_append(found, known, ["detection_key"]).select("incident_id")


@query(
    "k11_output_aliases",
    """SELECT source_row_hash, time AS timestamp, cycle_time_s AS cycle_time, peak_pressure_bar AS injection_pressure_max,
              cushion_mm AS cushion FROM cycles""",
)
def output_aliases(v: Views) -> DataFrame:
    return sinks.with_output_aliases(v.cycles).select(
        "source_row_hash", "timestamp", "cycle_time", "injection_pressure_max", "cushion"
    )


@query(
    "x3_retry_ledger",
    """SELECT job_id, CASE WHEN attempt_count >= max_attempts THEN 'quarantined' ELSE 'retry_wait' END AS status,
              CASE WHEN attempt_count >= max_attempts THEN discovered_at
                   ELSE discovered_at + to_seconds(CAST(30 * pow(2, greatest(0, attempt_count - 1)) AS BIGINT)) END AS next_attempt_at
       FROM import_jobs WHERE status = 'failed'""",
)
def retry_ledger(v: Views) -> DataFrame:
    failed = v.import_jobs.where(F.col("status") == "failed")
    return sinks.retry_ledger(failed, F.col("discovered_at")).select("job_id", "status", "next_attempt_at")


@query(
    "x3_deferred_ledger",
    """SELECT job_id, 'retry_wait' AS status, 0 AS attempt_count, discovered_at + INTERVAL 30 SECOND AS next_attempt_at
       FROM import_jobs WHERE status = 'completed'""",
)
def deferred_ledger(v: Views) -> DataFrame:
    done = v.import_jobs.where(F.col("status") == "completed")
    return sinks.deferred_ledger(done, F.col("discovered_at")).select(
        "job_id", "status", "attempt_count", "next_attempt_at"
    )


@query(
    "x4_job_states",
    """SELECT event_id % 800 AS job_id, max_by(event_type, ROW(time, event_id)) AS status, max(time) AS changed_at, count(*) AS events
       FROM ev GROUP BY 1""",
)
def job_states(v: Views) -> DataFrame:
    history = v.events.select(
        (F.col("event_id") % 800).alias("job_id"),
        "event_id",
        F.col("event_type").alias("status"),
        F.col("time").alias("event_time"),
    )
    return sinks.current_states(history)


@query(
    "k13_cycle_layout",
    """SELECT site_id, machine_id, source_row_hash FROM cycles
       WHERE time BETWEEN TIMESTAMP '2024-01-08 12:00:00' AND TIMESTAMP '2024-01-17 06:00:00'""",
)
def cycle_layout(v: Views) -> DataFrame:
    """A time range of the cycle table as written by site and week; the bounds prune its folders."""
    path = f"{shared_folder(v.spark)}/cycles/{uuid.uuid4().hex}"
    sinks.write_cycles(v.cycles, path)
    rows = sinks.read_cycles(v.spark, path, "2024-01-08 12:00:00", "2024-01-17 06:00:00")
    return rows.select(F.col("site_id").cast("bigint").alias("site_id"), "machine_id", "source_row_hash")


@query(
    "v11_training_contract",
    """SELECT CAST(scrap_flag AS INTEGER) AS scrap_flag, count(*) AS rows FROM cycles
       WHERE data_quality_status IS NOT NULL GROUP BY 1""",
)
def training_contract(v: Views) -> DataFrame:
    """Training rows that keep the contract: all columns present, a time, and a label of 0 or 1."""
    rows = v.cycles.withColumnRenamed("switchover_position", "switchover_position_mm").withColumns(
        {
            "timestamp": F.when(F.col("data_quality_status").isNotNull(), F.col("time")),
            "machine_erp_ref": F.col("machine_id").cast("string"),
            "scrap_flag": F.col("scrap_flag").cast("int"),
        }
    )
    return validation.check_feature_contract(rows, "scrap_flag").groupBy("scrap_flag").agg(F.count("*").alias("rows"))
