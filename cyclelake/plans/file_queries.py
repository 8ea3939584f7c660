"""Registered queries over files that Spark writes from the tables, and over the document texts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cyclelake.dictionary import label_dictionary
from cyclelake.operators import features, models
from cyclelake.plans.feature_queries import FUTURE_SQL, _split_sql
from cyclelake.plans.registry import query
from cyclelake.plans.structure_sql import STRUCTURE_SQL, folded, quoted
from cyclelake.plans.views import Views
from cyclelake.schema import CYCLE_ORDER, SITE_MACHINE
from cyclelake.session import shared_folder, spread, stored
from cyclelake.sources import files, lines, mapping, probe, profiling


def _written(v: Views, rows: DataFrame, delimiter: str = ",") -> str:
    """Folder of delimited text files holding the rows, at most 5,000 per file."""
    path = f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"
    rows.write.option("header", True).option("sep", delimiter).option("maxRecordsPerFile", 5000).csv(path)
    return path


def _export(v: Views) -> DataFrame:
    """Cycles as a machine would export them."""
    return v.cycles.select(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("machine_id").cast("string").alias("Machine"),
        F.col("cycle_time_s").cast("string").alias("t_cycle"),
        F.replace(F.col("dosing_time_s").cast("string"), F.lit("."), F.lit(",")).alias("t_dos"),
        F.coalesce(F.col("injection_time_s").cast("string"), F.lit("N/A")).alias("t_inj"),
        F.col("cycle_counter").cast("string").alias("n_cycle"),
    )


EXPORT_SQL = """SELECT cycle_counter, date_trunc('second', time) AS time, CAST(machine_id AS VARCHAR) AS machine,
       round(cycle_time_s, 6) AS cycle_time_s, round(dosing_time_s, 6) AS dosing_time_s,
       round(injection_time_s, 6) AS injection_time_s FROM cycles"""


@query("s2_delimited_scan", EXPORT_SQL)
def delimited_scan(v: Views) -> DataFrame:
    from cyclelake.functions.times import parse_source_time
    from cyclelake.functions.values import decimal_text

    rows = files.read_delimited(v.spark, _written(v, _export(v), ";"), ";")
    number = lambda c: decimal_text(F.col(c))
    return rows.select(
        F.col("n_cycle").cast("bigint").alias("cycle_counter"),
        parse_source_time(F.col("Timestamp")).alias("time"),
        F.col("Machine").alias("machine"),
        number("t_cycle").alias("cycle_time_s"),
        number("t_dos").alias("dosing_time_s"),
        number("t_inj").alias("injection_time_s"),
    )


@query("m4_mapped_rows", EXPORT_SQL)
def mapped_rows(v: Views) -> DataFrame:
    read = lines.read_lines(v.spark, _written(v, _export(v), ";"), "*.csv")
    profiles = stored(lines.profile_lines(read))
    mapped = mapping.apply_unit_row(mapping.column_map(mapping.file_headers(profiles), label_dictionary(v.spark)))
    fields = ["cycle_counter", "cycle_time_s", "dosing_time_s", "injection_time_s"]
    rows = mapping.typed(mapping.map_rows(lines.read_table(read, profiles), mapped), fields)
    return rows.select(
        F.col("cycle_counter").cast("bigint").alias("cycle_counter"),
        "time",
        F.col("raw_data")["Machine"].alias("machine"),
        "cycle_time_s",
        "dosing_time_s",
        "injection_time_s",
    )


def _protocols(v: Views) -> str:
    """Folder of protocol texts: metadata, header and unit rows, then the cycles of one machine in time order.

    A file takes 20,000 counter values of a machine. Some rows are short, some long, some clocks cannot be read and
    some lines are blank.
    """
    k, part = F.col("k"), F.floor(F.col("cycle_counter") / 20_000)
    clock = F.when(k % 9 == 0, "--:--").otherwise(F.date_format("time", "HH:mm:ss"))
    number = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    row = F.concat_ws(
        ";", F.col("cycle_counter").cast("string"), clock, number("cycle_time_s"), number("dosing_time_s"),
        F.when(k % 5 != 0, F.coalesce(number("injection_time_s"), F.lit(""))), F.when(k % 11 == 0, F.lit("beyond")),
    )
    data = v.cycles.join(v.events.select(F.col("event_id").alias("cycle_counter"), "k"), "cycle_counter").select(
        "machine_id", part.alias("part"), "time", F.col("cycle_counter").alias("n"),
        F.explode(F.when(k % 7 == 0, F.array(row, F.lit(""))).otherwise(F.array(row))).alias("line"),
    )
    head = ["Protocole Arburg", "Machine: ", "Date; 11.02.2025 06:00:00", "f1403;t007;t4012;t4015;t4018", "-;h:min;s;s;s"]
    named = F.transform(F.array(*[F.lit(h) for h in head]), lambda h: F.when(h == "Machine: ", F.concat(h, F.col("machine_id").cast("string"))).otherwise(h))
    heads = data.select("machine_id", "part").distinct().select(
        "machine_id", "part", F.lit(None).cast("timestamp").alias("time"), F.posexplode(named).alias("n", "line")
    )
    # sorted downwards, so with every part of the order but the line turned: the blank line follows its row
    place = F.struct(F.col("time").isNull(), F.bitwise_not(F.unix_micros("time")), F.bitwise_not(F.col("n")), F.coalesce("line", F.lit("")).alias("line"))
    listed = F.sort_array(F.collect_list(place), asc=False)  # of 20,000 counter values
    whole = spread(heads.unionByName(data), "machine_id", "part").groupBy("machine_id", "part").agg(listed.alias("lines"))
    path = f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"
    # a row is a file; a folder for each would take most of the time
    rows = whole.select("part", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    rows.write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "p11_profile_match",
    """, reg AS (SELECT p_partkey AS p, sha256('structure' || CAST(p_partkey % 1000 AS VARCHAR)) AS digest, (p_partkey // 3 + p_partkey // 1000 * 2) % 7 AS c FROM part),
       usable AS (SELECT *, c IN (0, 1) AS approved FROM reg WHERE c IN (0, 1, 2)),
       counts AS (SELECT digest, count(*) FILTER (WHERE approved) AS a, count(*) FILTER (WHERE NOT approved) AS n,
                         min(p) FILTER (WHERE approved) AS pa, min(p) FILTER (WHERE NOT approved) AS pn FROM usable GROUP BY digest)
       SELECT job_id, CASE WHEN a > 1 OR (a = 0 AND n > 1) THEN 'duplicate' WHEN a = 1 THEN 'approved' WHEN n = 1 THEN 'candidate' ELSE 'none' END AS profile_status,
              CASE WHEN a = 1 THEN 'p' || CAST(pa AS VARCHAR) WHEN a = 0 AND n = 1 THEN 'p' || CAST(pn AS VARCHAR) END AS profile_id
       FROM import_jobs LEFT JOIN counts ON digest = sha256('structure' || CAST(job_id % 1000 AS VARCHAR))""",
)
def profile_match(v: Views) -> DataFrame:
    """Files whose structures are among a thousand, against a registry with approved, candidate, doubled, disabled and faulty profiles."""
    files_ = v.import_jobs.select("job_id", F.sha2(F.concat(F.lit("structure"), (F.col("job_id") % 1000).cast("string")), 256).alias("fingerprint"))
    return profiling.match_profiles(files_, _registry(v)).select("job_id", "profile_status", "profile_id")


def _registry(v: Views) -> DataFrame:
    p = F.col("p_partkey")
    c = (F.floor(p / 3) + F.floor(p / 1000) * 2) % 7  # 0, 1 approved; 2 candidate; 3 disabled; 4 to 6 faulty
    return v.table("part").select(
        F.when(c == 4, F.concat(F.lit("../p"), p)).otherwise(F.concat(F.lit("p"), p)).alias("profile_id"),
        F.lit("1.0").alias("profile_version"),
        F.when(c.isin(0, 1, 5), "approved").otherwise("candidate").alias("status"),
        F.when(c == 3, False).when(c == 1, None).otherwise(True).alias("match_enabled"),
        F.sha2(F.concat(F.lit("structure"), (p % 1000).cast("string")), 256).alias("digest"),
        F.when(c == 6, "tabular-fingerprint/v0").otherwise(profiling.FINGERPRINT_VERSION).alias("fingerprint_version"),
        F.lit("v1").alias("parser_version"),
        F.when(c != 5, F.lit("2026-01-01")).alias("approved_at"),
        F.lit("someone").alias("approved_by"),
        F.lit(True).alias("field_validated"),
    )


@query(
    "p11_registry_errors",
    """SELECT CASE (p_partkey // 3 + p_partkey // 1000 * 2) % 7 WHEN 4 THEN 'identifier_invalid' WHEN 5 THEN 'approval_without_evidence'
              WHEN 6 THEN 'fingerprint_version_unsupported' END AS registry_error, count(*) AS profiles FROM part GROUP BY 1""",
)
def registry_errors(v: Views) -> DataFrame:
    return profiling.check_profiles(_registry(v)).groupBy("registry_error").agg(F.count("*").alias("profiles"))


@query(
    "m3_versioned_map",
    """, f AS (SELECT *, 'v' || CAST(machine_id % 2 AS VARCHAR) AS version FROM machines),
       s AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM machines o WHERE o.site_id = f.site_id AND o.erp_ref = f.erp_ref AND o.machine_id % 10 = 0
                                           AND o.machine_id % 2 = f.machine_id % 2) THEN 0
                     WHEN site_id <= 2 AND version = 'v0' THEN 1
                     WHEN EXISTS (SELECT 1 FROM machines o WHERE o.erp_ref = f.erp_ref AND o.machine_id % 5 = 0 AND version = 'v1') THEN 2
                     WHEN version = 'v0' THEN 3 END AS rank FROM f)
       SELECT site_id, machine_id, label,
              CASE WHEN label = 't4012' AND brand = 'arburg' THEN 'cycle_time_s'
                   WHEN label = 'ZZ-1' AND rank = 0 AND brand = 'arburg' THEN 'cushion_mm' WHEN label = 'ZZ-1' AND rank = 1 AND brand = 'engel' THEN 'clamp_force_kn'
                   WHEN label = 'ZZ-1' AND rank = 2 AND brand = 'haitian' THEN 'oil_temperature_c'
                   WHEN label = 'Own é.Label' AND rank = 3 AND brand = 'arburg' THEN 'energy_kwh' END AS canonical,
              CAST(CASE WHEN label = 't4012' AND brand = 'arburg' THEN 1 WHEN label = 'ZZ-1' AND rank = 0 AND brand = 'arburg' THEN 0.9
                   WHEN label = 'ZZ-1' AND rank = 1 AND brand = 'engel' THEN 0.8 WHEN label = 'ZZ-1' AND rank = 2 AND brand = 'haitian' THEN 1
                   WHEN label = 'Own é.Label' AND rank = 3 AND brand = 'arburg' THEN 0.7 ELSE 0 END AS DOUBLE) AS confidence
       FROM s, (VALUES ('t4012'), ('ZZ-1'), ('Own é.Label')) l(label)""",
)
def versioned_map(v: Views) -> DataFrame:
    """Headers of a file per machine, under version sets for a machine of a site, a site, a machine and any."""
    m = F.col("machine_id")
    owner = v.machines.select(
        F.concat_ws("/", "site_id", "machine_id").alias("path"), F.col("site_id").cast("string").alias("site"), F.col("erp_ref").alias("machine"),
        F.concat(F.lit("v"), m % 2).alias("parser_version"), "brand", "site_id", "machine_id",
    )
    headers = owner.select("path", "brand", F.posexplode(F.array(*[F.lit(x) for x in ("t4012", "ZZ-1", "Own é.Label")])).alias("position", "label"), F.lit(None).cast("string").alias("unit_cell"))
    alias = lambda site, machine, version, brand, label, canonical, confidence: [
        site.alias("site"), machine.alias("machine"), version.alias("parser_version"), F.lit(brand).alias("mapping_brand"), F.lit(label).alias("alias_label"),
        F.lit(canonical).alias("canonical"), F.lit("x").alias("unit"), F.lit(None).cast("string").alias("source_unit"),
        F.lit(1.0).alias("scale"), F.lit(confidence).cast("double").alias("confidence"),
    ]
    any_, own = F.lit(None).cast("string"), F.concat(F.lit("v"), m % 2)
    ref, site = F.col("erp_ref"), F.col("site_id").cast("string")
    versions = (
        v.machines.where(m % 10 == 0).select(*alias(site, ref, own, "arburg", "zz_1", "cushion_mm", 0.9))
        .union(v.sites.where("site_id <= 2").select(*alias(site, any_, F.lit("v0"), "engel", "zz 1", "clamp_force_kn", 0.8)))
        .union(v.machines.where(m % 5 == 0).select(*alias(any_, ref, F.lit("v1"), "haitian", "zz1", "oil_temperature_c", None)))
        .union(v.sites.limit(1).select(*alias(any_, any_, F.lit("v0"), "arburg", "own_elabel", "energy_kwh", 0.7)))
    )
    mapped = mapping.apply_versions(mapping.column_map(headers, label_dictionary(v.spark)), owner, versions)
    return mapped.join(owner.select("path", "site_id", "machine_id"), "path").select("site_id", "machine_id", "label", "canonical", "confidence")


@query(
    "s1_protocol_scan",
    """, t AS (SELECT machine_id, event_id // 20000 AS part, event_id, time, k, time_bucket(INTERVAL 1 DAY, time) AS day,
              CASE WHEN k % 9 <> 0 THEN (epoch_us(time) // 1000000) % 86400 END AS clock FROM ev),
       n AS (SELECT *, row_number() OVER w AS i, CAST(coalesce(sum(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
               AND 1 PRECEDING), 0) AS BIGINT) AS blanks, last_value(clock IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
             FROM t WINDOW w AS (PARTITION BY machine_id, part ORDER BY time, event_id)),
       d AS (SELECT *, CAST(sum(CASE WHEN clock < before THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id, part ORDER BY i) AS INTEGER) AS days FROM n)
       SELECT d.event_id AS cycle_counter, 4 + i + blanks AS line_no, CAST(d.machine_id AS VARCHAR) AS machine_ref,
              TIMESTAMP '2025-02-11' + to_days(days) + clock * INTERVAL 1 SECOND AS time, round(c.cycle_time_s, 6) AS cycle_time_s,
              round(c.dosing_time_s, 6) AS dosing_time_s, CASE WHEN k % 5 <> 0 THEN round(c.injection_time_s, 6)
              WHEN k % 11 = 0 THEN NULL END AS injection_time_s
       FROM d JOIN cycles c ON c.cycle_counter = d.event_id""",
)
def protocol_scan(v: Views) -> DataFrame:
    from cyclelake.functions.values import decimal_text

    read = lines.read_lines(v.spark, _protocols(v))
    rows = lines.read_protocol(read, stored(lines.profile_lines(read)))
    cell = lambda c: F.col("cells")[c]
    return rows.select(
        cell("f1403").cast("bigint").alias("cycle_counter"),
        "line_no",
        "machine_ref",
        "time",
        decimal_text(cell("t4012")).alias("cycle_time_s"),
        decimal_text(cell("t4015")).alias("dosing_time_s"),
        decimal_text(cell("t4018")).alias("injection_time_s"),
    )


@query(
    "m2_column_map",
    """SELECT * FROM (VALUES ('Timestamp', CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE)), ('Machine', NULL, 0.0), ('t_cycle', 'cycle_time_s', 0.75),
         ('t_dos', 'dosing_time_s', 0.75), ('t_inj', 'injection_time_s', 0.75), ('n_cycle', 'cycle_counter', 1.0))
         t(label, canonical, confidence) WHERE EXISTS (SELECT 1 FROM cycles)""",
)
def column_map(v: Views) -> DataFrame:
    path = _written(v, _export(v), ";")
    profiles = stored(profiling.profile_files(files.read_files(v.spark, path, "*.csv")))
    mapped = mapping.column_map(mapping.file_headers(profiles), label_dictionary(v.spark))
    return mapped.select("label", "canonical", "confidence").distinct()


@query(
    "s4_erp_orders",
    """SELECT id, CAST(machine_id AS VARCHAR) AS machine_erp_ref, date_trunc('second', started_at) AS started_at,
              date_trunc('second', ended_at) AS ended_at, product_ref FROM production_orders WHERE machine_id % 10 <> 0""",
)
def erp_orders(v: Views) -> DataFrame:
    export = v.orders.select(
        F.col("id").alias("Réf OF"),
        F.when(F.col("machine_id") % 10 != 0, F.col("machine_id").cast("string")).alias("Réf. Machine"),
        F.date_format("started_at", "dd.MM.yyyy HH:mm:ss").alias("Début Equipe"),
        F.date_format("ended_at", "dd/MM/yyyy HH:mm:ss").alias("Fin Equipe"),
        F.lit(None).cast("string").alias("Réf. produit"),
        "product_ref",
    )
    return files.read_erp_orders(v.spark, _written(v, export)).select(
        "id", "machine_erp_ref", "started_at", "ended_at", "product_ref"
    )


@query(
    "s5_context_scan",
    """SELECT note_id, date_trunc('second', time) AS time, CAST(machine_id AS VARCHAR) AS machine_erp_ref, length(note_text) AS chars
       FROM operator_notes""",
)
def context_scan(v: Views) -> DataFrame:
    export = v.operator_notes.select(
        "note_id",
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("machine_id").cast("string").alias("machine_erp_ref"),
        F.lit(None).cast("string").alias("production_order_id"),
        F.lit("OP").alias("operator_id"),
        "note_text",
    )
    path = f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"
    export.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_context(v.spark, path, "notes").select(
        "note_id", "time", "machine_erp_ref", F.length("note_text").cast("bigint").alias("chars")
    )


@query(
    "s8_content_hash",
    "SELECT doc_id, sha256(text) AS file_hash FROM documents",
)
def content_hash(v: Views) -> DataFrame:
    contents = v.table("documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.with_file_hash(contents).select("doc_id", "file_hash")


@query(
    "w7_midnight_rollover",
    """, t AS (SELECT machine_id, event_id // 2000 AS part, event_id, time FROM ev),
       m AS (SELECT *, lag(date_trunc('minute', time)::TIME) OVER (PARTITION BY machine_id, part ORDER BY time, event_id) AS before,
               date_trunc('minute', time)::TIME AS c FROM t),
       d AS (SELECT *, CAST(sum(CASE WHEN c < before THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id, part ORDER BY time, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS days FROM m)
       SELECT event_id, DATE '2025-02-11' + to_days(days) + (epoch_us(c) // 60000000) * INTERVAL 1 MINUTE AS time FROM d""",
)
def midnight_rollover(v: Views) -> DataFrame:
    # a file holds one machine's lines of 2,000 consecutive ids
    lines = v.events.select(
        "machine_id",
        F.floor(F.col("event_id") / 2000).alias("part"),
        "event_id",
        F.struct("time", "event_id").alias("line"),
        F.date_format("time", "HH:mm").alias("clock"),
        F.lit("2025-02-11").cast("timestamp").alias("day"),
    )
    return files.roll_over_midnight(lines, ["machine_id", "part"], "line", "clock", "day").select("event_id", "time")


def _profiles(v: Views) -> DataFrame:
    """Stored profiles of the document texts, each taken as a file."""
    texts = spread(v.table("documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("length"),
    )
    return stored(
        profiling.guard_files(
            profiling.with_balance(
                profiling.with_classification(
                    profiling.with_fingerprint(profiling.with_metadata(profiling.profile_files(texts)))
                )
            )
        )
    )


@query(
    "p1_encoding",
    "SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, 'UTF-8' AS encoding, FALSE AS is_binary FROM documents",
)
def encoding(v: Views) -> DataFrame:
    return _profiles(v).select("path", "encoding", "is_binary")


def _delimiter_sql() -> str:
    marks = {"semi": ";", "comma": ",", "tab": "\t", "space": " "}
    count = lambda m: f"length(x) - length(replace(x, '{m}', ''))"
    repeated = ", ".join(f"len(list_filter(h, lambda x: {count(m)} >= 2)) AS r_{n}" for n, m in marks.items())
    total = ", ".join(f"list_sum(list_transform(h, lambda x: {count(m)})) AS t_{n}" for n, m in marks.items())
    best = lambda p: "CASE greatest({}) {} END".format(
        ", ".join(f"{p}_{n}" for n in marks), " ".join(f"WHEN {p}_{n} THEN '{m}'" for n, m in marks.items())
    )
    return f""", heads AS (
         SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10))[1:20] AS h FROM documents),
       counts AS (SELECT doc_id, {repeated}, {total} FROM heads)
       SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path,
              CASE WHEN greatest(r_semi, r_comma, r_tab, r_space) > 0 THEN {best('r')} ELSE {best('t')} END AS delimiter
       FROM counts"""


@query("p3_delimiter", _delimiter_sql())
def delimiter(v: Views) -> DataFrame:
    return _profiles(v).select("path", "delimiter")


@query(
    "p4_orientation",
    f", {STRUCTURE_SQL} SELECT path, is_transposed FROM turned",
)
def orientation(v: Views) -> DataFrame:
    return _profiles(v).select("path", "is_transposed")


@query(
    "p5_brand",
    f""", {STRUCTURE_SQL}
       SELECT path, CASE WHEN greatest(n_arburg, n_engel, n_haitian) = 0 THEN 'generic' WHEN n_arburg >= greatest(n_engel, n_haitian) THEN 'arburg'
                         WHEN n_engel >= n_haitian THEN 'engel' ELSE 'haitian' END AS brand,
              round(CAST(least(greatest(n_arburg, n_engel, n_haitian) / 4, 1.0) AS DOUBLE), 2) AS brand_confidence FROM turned""",
)
def brand(v: Views) -> DataFrame:
    return _profiles(v).select("path", "brand", "brand_confidence")


@query(
    "p6_header_rows",
    f""", {STRUCTURE_SQL} SELECT path, CAST(header_row AS INTEGER) AS header_row, CAST(unit_row AS INTEGER) AS unit_row,
       CAST(data_start AS INTEGER) AS data_start, CAST(len(headers) AS INTEGER) AS column_count FROM structured""",
)
def header_rows(v: Views) -> DataFrame:
    return _profiles(v).select("path", "header_row", "unit_row", "data_start", "column_count")


@query(
    "p7_metadata_keys",
    f""", {STRUCTURE_SQL} SELECT path, array_to_string(metadata_keys, ',') AS metadata_keys, regexp_split_to_array(dated[1][2], '\\s+')[1] AS reference_date FROM keyed""",
)
def metadata_keys(v: Views) -> DataFrame:
    return _profiles(v).select("path", F.array_join("metadata_keys", ",").alias("metadata_keys"), "reference_date")


@query("p8_fingerprint")
def fingerprint(v: Views) -> DataFrame:
    return _profiles(v).select("path", "fingerprint")


@query(
    "p9_classification",
    f""", {STRUCTURE_SQL},
       own AS (SELECT path, list_transform(headers, lambda x: {folded('x')}) AS h, metadata_keys FROM keyed),
       hinted AS (SELECT *, CASE WHEN len(list_distinct(list_intersect(list_concat(h, metadata_keys), {quoted(profiling.BRAND_HINT_LABELS)}))) >= 2 THEN 'arburg'
                WHEN len(list_filter(list_concat(h, metadata_keys), lambda x: contains(x, 'kistler'))) > 0 THEN 'kistler'
                WHEN list_has_any(list_concat(h, metadata_keys), ['tcycle', 'activeplastificationtime', 'cc300']) THEN 'engel' ELSE 'generic' END AS brand_hint FROM own),
       scored AS (SELECT path, brand_hint, round(0.4 * CAST(list_has_any(h, {quoted(profiling.TIME_LABELS)}) AS INTEGER)
                  + 0.4 * CAST(list_has_any(h, {quoted(profiling.PROCESS_LABELS)}) AS INTEGER)
                  + 0.2 * CAST(list_has_any(h, {quoted(profiling.MACHINE_LABELS)}) OR brand_hint <> 'generic' AS INTEGER), 2) AS score FROM hinted)
       SELECT path, brand_hint, CAST(score AS DOUBLE) AS structure_score, CASE WHEN score >= 0.8 THEN 'machine_export' ELSE 'tabular_unknown' END AS structure_label FROM scored""",
)
def classification(v: Views) -> DataFrame:
    return _profiles(v).select("path", "brand_hint", "structure_score", "structure_label")


@query("p10_fingerprint_groups")
def fingerprint_groups(v: Views) -> DataFrame:
    return profiling.fingerprint_groups(_profiles(v))


@query(
    "p10_class_sizes",
    f""", {STRUCTURE_SQL},
       shaped AS (SELECT path, (is_transposed, d, header_row, unit_row, data_start, list_transform(headers, lambda x: {folded('x')}),
                    list_transform(list_resize(coalesce(units, []), len(headers)), lambda x: coalesce({folded('x')}, '')), metadata_keys) AS shape FROM keyed)
       SELECT path, count(*) OVER (PARTITION BY shape) AS files FROM shaped""",
)
def class_sizes(v: Views) -> DataFrame:
    """How many files share each file's structure: the classes of the fingerprints, without their digests."""
    return profiling.fingerprint_groups(_profiles(v)).select("path", "files")


@query(
    "s6_cycle_corpus",
    """SELECT CAST(cycle_counter AS VARCHAR) AS n_cycle, CAST(machine_id AS VARCHAR) AS "Machine", strftime(time, '%Y-%m-%d %H:%M:%S') AS "Timestamp" FROM cycles""",
)
def cycle_corpus(v: Views) -> DataFrame:
    """All `machine_cycles_*.csv` of a folder with other files beside them."""
    base = f"{shared_folder(v.spark)}/files/{uuid.uuid4().hex}"
    made = v.cycles.select(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("machine_id").cast("string").alias("Machine"), F.col("cycle_counter").cast("string").alias("n_cycle"),
        F.floor(F.col("cycle_counter") / 100_000).alias("part"),
    )
    made.repartition("part").write.partitionBy("part").option("header", True).csv(f"{base}/made")
    hadoop = v.spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(v.spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(hadoop.Path(f"{base}/corpus"))
    for i, status in enumerate(fs.globStatus(hadoop.Path(f"{base}/made/*/part-*"))):
        if i == 0:
            hadoop.FileUtil.copy(fs, status.getPath(), fs, hadoop.Path(f"{base}/corpus/cycles_of_another_name.csv"), False, v.spark._jsparkSession.sessionState().newHadoopConf())
        fs.rename(status.getPath(), hadoop.Path(f"{base}/corpus/machine_cycles_{i}.csv"))
    return files.read_cycle_corpus(v.spark, f"{base}/corpus").select("n_cycle", "Machine", "Timestamp")


@query(
    "p12_unbalanced_rows",
    f", {STRUCTURE_SQL} SELECT path, coalesce(len(list_distinct(list_transform(full_lines[1:10], lambda x: len(string_split(x, d))))), 0) > 1 AS unbalanced FROM cut",
)
def unbalanced_rows(v: Views) -> DataFrame:
    return _profiles(v).select("path", "unbalanced")


@query(
    "p13_reading_guards",
    f""", {STRUCTURE_SQL} SELECT path, length, CASE WHEN length = 0 THEN 'INGEST_EMPTY_FILE' WHEN length > {profiling.MAX_FILE_BYTES} THEN 'INGEST_FILE_TOO_LARGE'
       WHEN list_max(list_transform(lines, lambda x: len(string_split(x, d)))) > {profiling.MAX_COLUMNS} THEN 'INGEST_TOO_MANY_COLUMNS'
       WHEN list_max(list_transform(lines, lambda x: list_max(list_transform(string_split(x, d), lambda c: length(c))))) > {profiling.MAX_CELL_CHARS} THEN 'INGEST_CELL_TOO_LARGE'
       END AS guard_code FROM cut""",
)
def reading_guards(v: Views) -> DataFrame:
    return _profiles(v).select("path", "length", "guard_code")


@query("p14_probe_reports")
def probe_reports(v: Views) -> DataFrame:
    found = files.read_files(v.spark, _written(v, _export(v), ";"), "*.csv")
    report = probe.probe_files(found, label_dictionary(v.spark))
    return report.groupBy("delimiter", "brand", "structure_label", "confidence", "valid").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows")
    )


# ---------------------------------------------------------------------------------------
# Models: random forests and solvers differ between engines, so only row counts compare.

KEYS = [*SITE_MACHINE, *CYCLE_ORDER]


_TRAINED: dict[tuple[str, str], str] = {}


def _drift_folder(v: Views) -> str:
    """Folder of the drift model of the bulk cycles' suppliers; it is trained and stored once per session and input."""
    key = (v.spark.sparkContext.applicationId, v.folder)
    if key not in _TRAINED:
        folder = f"{shared_folder(v.spark)}/models/{uuid.uuid4().hex}"
        models.save_drift_model(models.train_drift(v.lineitem_cycles), folder)
        _TRAINED[key] = folder
    return _TRAINED[key]


def _drift_model(v: Views) -> dict[str, DataFrame]:
    return models.load_drift_model(v.spark, _drift_folder(v))


@query("l1_drift_training")
def drift_training(v: Views) -> DataFrame:
    return v.spark.read.parquet(f"{_drift_folder(v)}/metrics")


@query("l3_drift_scores")
def drift_scores(v: Views) -> DataFrame:
    return models.predict_drift(v.lineitem_cycles, _drift_model(v)).drop("model_version")


@query("l8_reference_scores")
def reference_scores(v: Views) -> DataFrame:
    return models.reference_scores(v.lineitem_cycles, _drift_model(v))


DRIFT_MACHINES_SQL = """placed AS (
         SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY site_id, machine_id) - 20 AS n FROM lineitem_cycles
         WINDOW w AS (PARTITION BY site_id, machine_id ORDER BY time, cycle_counter, source_row_hash)),
       normal AS (SELECT * FROM placed WHERE i <= greatest(1, least(n - 1, CAST(floor(n * 2.0 / 3) AS BIGINT))) AND i <= n AND NOT scrap_flag),
       counts AS (SELECT count(DISTINCT (site_id, machine_id)) AS machines FROM normal)"""


@query(
    "l1_training_rows",
    f""", {FUTURE_SQL}, {_split_sql('PARTITION BY site_id, machine_id')}
       SELECT split, count(*) AS rows, CAST(sum(instability_next_20_cycles) AS BIGINT) AS events, round(avg(instability_next_20_cycles), 6) AS prevalence
       FROM split GROUP BY split""".replace("FROM cycles", "FROM lineitem_cycles"),
)
def training_rows(v: Views) -> DataFrame:
    """Rows, events and prevalence of the drift model's training and test rows."""
    split = features.chronological_split(features.training_features(v.lineitem_cycles))
    label = "instability_next_20_cycles"
    return split.groupBy("split").agg(F.count("*").alias("rows"), F.sum(label).cast("bigint").alias("events"), F.avg(label).alias("prevalence"))


NEAR = 1e-6  # scores are rounded to six digits


@query(
    "l3_score_rows",
    "SELECT site_id, machine_id, time, cycle_counter, source_row_hash, TRUE AS score_is_share, TRUE AS alert_follows FROM lineitem_cycles",
)
def score_rows(v: Views) -> DataFrame:
    """Every cycle has a score between 0 and 1 and an alert where it reaches the threshold."""
    scored = models.predict_drift(v.lineitem_cycles, _drift_model(v))
    score, limit, alert = F.col("anomaly_score"), F.col("threshold"), F.col("predicted_instability_next_20_cycles")
    follows = (alert == (score >= limit)) | (F.abs(score - limit) < NEAR)
    return scored.select(*KEYS, score.between(0, 1).alias("score_is_share"), follows.alias("alert_follows"))


@query(
    "l7_score_rows",
    "SELECT site_id, machine_id, time, cycle_counter, source_row_hash, TRUE AS risk_is_share, TRUE AS flag_follows FROM cycles",
)
def risk_rows(v: Views) -> DataFrame:
    """Every cycle has a risk between 0 and 1 and a flag where it reaches one half."""
    rows = stored(models.scrap_features(v.cycles))
    scored = models.predict_scrap(models.fit_scrap_risk(rows), rows)
    risk, limit = F.col("risk_probability"), F.col("threshold")
    follows = (F.col("predicted_scrap") == (risk >= limit)) | (F.abs(risk - limit) < NEAR)
    return scored.select(*KEYS, risk.between(0, 1).alias("risk_is_share"), follows.alias("flag_follows"))


@query(
    "l8_reference_rows",
    """, n AS (SELECT count(*) AS n, greatest(1, count(*) // 5000) AS step FROM lineitem_cycles WHERE NOT scrap_flag)
       SELECT least(5000, (n + step - 1) // step) AS scores, TRUE AS all_shares FROM n""",
)
def reference_rows(v: Views) -> DataFrame:
    """Size of a reference distribution of evenly spaced cycles; its scores lie between 0 and 1."""
    found = models.reference_scores(v.lineitem_cycles, _drift_model(v), 5000)
    return found.agg(F.count("*").alias("scores"), F.bool_and(F.col("score").between(0, 1)).alias("all_shares"))


@query(
    "l2_model_checks",
    f""", {DRIFT_MACHINES_SQL}
       SELECT model, status, CASE WHEN status <> 'tables_missing' THEN machines END AS machines FROM counts, (VALUES
         ('stored', 'usable'), ('of another version', 'model_version_unsupported'), ('with other features', 'features_mismatch'),
         ('with another horizon', 'horizon_mismatch'), ('without limit', 'thresholds_invalid'), ('nowhere', 'tables_missing')) t(model, status)""",
)
def model_checks(v: Views) -> DataFrame:
    """The stored model beside copies that break one part of its contract each, with the machines they have a threshold for."""
    stored_at = _drift_folder(v)
    model = models.load_drift_model(v.spark, stored_at)
    version, features, horizon = models.drift_contract()
    base = f"{shared_folder(v.spark)}/models/{uuid.uuid4().hex}"
    folders = {"stored": stored_at, "nowhere": f"{base}/nowhere"}
    for name, contract in {
        "of another version": ("drift-0", features, horizon),
        "with other features": (version, "cycle_time_s", horizon),
        "with another horizon": (version, features, horizon + 1),
        "without limit": (version, features, horizon),
    }.items():
        folders[name] = f"{base}/{name.replace(' ', '-')}"
        endless = model["global_threshold"].withColumn("threshold", F.lit(float("inf")))
        models.save_drift_model(model | ({"global_threshold": endless} if name == "without limit" else {}), folders[name], contract)
    checked = models.check_drift_models(v.spark, folders)
    counted = [
        v.spark.read.parquet(f"{folder}/thresholds").agg(F.count("*").alias("machines")).select(F.lit(name).alias("model"), "machines")
        for name, folder in folders.items()
        if name != "nowhere"
    ]
    return checked.join(reduce(DataFrame.unionByName, counted), "model", "left")


@query(
    "l6_scrap_preprocessing",
    """, named AS (
         SELECT *, switchover_position AS switchover_position_mm, CAST(lag(scrap_flag) OVER w AS DOUBLE) AS previous_scrap_flag,
                avg(CAST(scrap_flag AS DOUBLE)) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rolling_scrap_rate_20
         FROM cycles WINDOW w AS (PARTITION BY site_id, machine_id ORDER BY time, cycle_counter, source_row_hash)),
       long AS (UNPIVOT (SELECT """
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in models.SCRAP_NUMERIC)
    + """ FROM named) ON """
    + ", ".join(models.SCRAP_NUMERIC)
    + """ INTO NAME feature VALUE x),
       n AS (SELECT count(*) AS n FROM cycles),
       m AS (SELECT feature, quantile_cont(x, 0.5) AS median, count(*) AS filled, sum(x) AS s FROM long GROUP BY feature),
       d AS (SELECT feature, median, (s + (n - filled) * median) / n AS mean, filled, n FROM m, n),
       v AS (SELECT d.feature, d.median, d.mean, sqrt((sum((x - d.mean) * (x - d.mean)) + any_value(n - filled) * any_value(power(d.median - d.mean, 2)))
               / any_value(n)) AS spread FROM d JOIN long USING (feature) GROUP BY d.feature, d.median, d.mean)
       SELECT feature, round(median, 6) AS median, round(mean, 6) AS mean, round(CASE WHEN spread > 0 THEN spread ELSE 1 END, 6) AS spread FROM v""",
)
def scrap_preprocessing(v: Views) -> DataFrame:
    return models.scrap_statistics(models.scrap_features(v.cycles))


@query("l6_scrap_risk_training")
def scrap_risk_training(v: Views) -> DataFrame:
    return models.train_scrap_risk(v.cycles)[1]


@query("l7_scrap_risk_scores")
def scrap_risk_scores(v: Views) -> DataFrame:
    rows = stored(models.scrap_features(v.cycles))
    return models.predict_scrap(models.fit_scrap_risk(rows), rows).drop("model_version", "label")


# ---------------------------------------------------------------------------------------
# Routing, units and shapes


@query(
    "s7_routes",
    """SELECT job_id, CASE job_id % 5 WHEN 0 THEN 'quality' WHEN 1 THEN 'maintenance' WHEN 2 THEN 'operator_note' WHEN 3 THEN 'erp_order'
              ELSE 'machine_cycle' END AS source_kind, CASE WHEN job_id % 7 <> 0 THEN site_id END AS site_id,
              CASE WHEN job_id % 7 = 0 THEN 'site_id_invalid_in_path' END AS route_error,
              CAST(job_id % 900 AS VARCHAR) AS machine_ref
       FROM import_jobs""",
)
def routes(v: Views) -> DataFrame:
    from cyclelake.plans.views import pick

    j = F.col("job_id")
    names = ["quality_checks", "maint_log", "operator_notes", "erp_orders", "machine_export"]
    site = F.when(j % 7 == 0, F.lit("unnamed")).otherwise(F.col("site_id").cast("string"))
    path = F.concat_ws("/", F.lit("file:/inbox"), site, (j % 900).cast("string"), F.concat(pick(names, j % 5), F.lit(".csv")))
    return files.with_route(v.import_jobs.select("job_id", path.alias("path")), "/inbox").select(
        "job_id", "source_kind", "site_id", "route_error", "machine_ref"
    )


@query(
    "m8_unit_rows",
    """, u AS (SELECT event_id, value, k % 6 AS c FROM ev)
       SELECT event_id, round(CASE c WHEN 0 THEN value * 0.001 WHEN 1 THEN value * 60.0 WHEN 2 THEN value WHEN 3 THEN value * 10.0
                WHEN 4 THEN value ELSE value END, 6) AS value, c <> 5 AS unit_compatible FROM u""",
)
def unit_rows(v: Views) -> DataFrame:
    from cyclelake.plans.views import pick

    k = F.col("k") % 6
    mapped = v.events.select(
        "event_id",
        "value",
        F.lit("x").alias("canonical"),
        pick(["ms", "min", "s", "MPa", "cm³", "kN"], k).alias("unit_cell"),
        pick(["s", "s", "s", "bar", "mm_or_cm3", "s"], k).alias("unit"),
        pick(["s", "s", "s", "bar", "mm_or_cm3", "s"], k).alias("source_unit"),
        F.lit(1.0).alias("scale"),
    )
    return mapping.apply_unit_row(mapped).select(
        "event_id", (F.col("value") * F.col("scale")).alias("value"), "unit_compatible"
    )


@query(
    "m12_time_columns",
    """SELECT event_id, (['Timestamp', 'Time', 'Machine Datetime', NULL])[k % 4 + 1] AS time_column FROM ev""",
)
def time_columns(v: Views) -> DataFrame:
    k = F.col("k") % 4
    words = [["Cycle", "Time", "Timestamp"], ["Cycle", "Time", "Machine"], ["Cycle", "Machine Datetime", "x"], ["a", "b", "c"]]
    headers = F.element_at(F.array(*[F.array(*[F.lit(w) for w in ws]) for ws in words]), k + 1)
    return v.events.select("event_id", headers.alias("h")).select(
        "event_id", mapping.time_column(F.col("h")).alias("time_column")
    )


@query("m18_row_hashes", "SELECT count(DISTINCT (user_id, event_type, value, props)) AS contents FROM events")
def row_hashes(v: Views) -> DataFrame:
    from cyclelake.functions.hashing import row_hash

    content = v.table("events").select("user_id", "event_type", "value", "props")
    return content.select(row_hash(content).alias("h")).agg(F.count_distinct("h").alias("contents"))


@query(
    "s3_transposed_scan",
    """, c AS (SELECT machine_id, cycle_counter // 2000 AS part, row_number() OVER (
                PARTITION BY machine_id, cycle_counter // 2000 ORDER BY time, cycle_counter) - 1 AS i, cycle_counter, cycle_time_s
              FROM cycles)
       SELECT 'm/' || CAST(machine_id AS VARCHAR) || '/' || CAST(part AS VARCHAR) AS path, CAST(i AS INTEGER) AS line_no, cycle_counter,
              round(cycle_time_s, 6) AS cycle_time_s, TIMESTAMP '2026-02-11 12:00:00' AS time FROM c""",
)
def transposed_scan(v: Views) -> DataFrame:
    """Machine exports turned into files with a column per cycle, at most 2,000 cycles each.

    The counter is unique, so 2,000 counter values bound a file whatever the machine's share.
    """
    from cyclelake.functions.values import decimal_text

    ordered = F.sort_array(
        F.collect_list(F.struct("time", "cycle_counter", F.col("cycle_time_s").cast("string").alias("t")))
    )
    row = lambda name, cell: F.concat(F.lit(name + "\t"), F.array_join(F.transform("c", cell), "\t"))
    text = F.concat_ws(
        "\n",
        row("Date", lambda c: F.lit("11.02.26")),
        row("Heure", lambda c: F.lit("0,5")),
        row("Num Cycle", lambda c: c.cycle_counter.cast("string")),
        row("CycleTime", lambda c: F.replace(c.t, F.lit("."), F.lit(","))),
    )
    part = F.floor(F.col("cycle_counter") / 2000).alias("part")
    exports = v.cycles.groupBy("machine_id", part).agg(ordered.alias("c")).select(
        F.concat_ws("/", F.lit("m"), F.col("machine_id").cast("string"), F.col("part").cast("string")).alias("path"),
        text.alias("text"),
    )
    shaped = exports.select(
        "path", F.lit(True).alias("is_transposed"), F.lit("\t").alias("delimiter"), profiling.text_lines(F.col("text")).alias("lines")
    )
    return files.read_transposed(shaped).select(
        "path", "line_no", "cycle_counter", decimal_text(F.col("cells")["CycleTime"]).alias("cycle_time_s"), "time"
    )
