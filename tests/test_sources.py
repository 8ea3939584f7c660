"""Profiling, mapping and file scans on small files."""

import pytest
from pyspark.sql import functions as F

from cyclelake.dictionary import label_dictionary
from cyclelake.functions import text, times
from cyclelake.sources import files, mapping, probe, profiling

PROTOCOL = """Machine;\t1003 - NOYAUX
Moule;\tM1
Date début;\t11.02.2025 08:00

t007;t4015;t4012;V4062;p4072;f077
h:min;s;s;cm³;bar;-
23:58;7,862;29.059;4.038;1013.51;1
23:59;8.905;28.178;4.17;1105.502
00:01;8.905;N/A;4.17;1105.502;1;extra

"""


def frame(spark, rows):
    made = spark.createDataFrame(
        [(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in rows], "path string, content binary"
    )
    return made.withColumn("length", F.length("content").cast("long"))


def test_encodings(spark):
    rows = {
        r["path"]: (r["encoding"], r["is_binary"])
        for r in profiling.with_encoding(
            frame(
                spark,
                [
                    ("utf8", "a;é;b\n1;2;3"),
                    ("bom16", "a;b\n1;2".encode("utf-16")),
                    ("le", "abc;def\n1;2;3;4\n".encode("utf-16-le")),
                    ("be", "abc;def\n1;2;3;4\n".encode("utf-16-be")),
                    ("latin", "a;é\n".encode("latin-1")),
                    ("sig", b"\xef\xbb\xbfa;b"),
                    ("bin", bytes(range(32)) * 20),
                ],
            )
        ).collect()
    }
    assert rows["utf8"] == ("UTF-8", False)
    assert rows["bom16"] == ("UTF-16", False)
    assert rows["le"] == ("UTF-16LE", False)
    assert rows["be"] == ("UTF-16BE", False)
    assert rows["latin"] == ("ISO-8859-1", False)
    assert rows["sig"] == ("UTF-8", False)
    assert rows["bin"][1] is True


def test_protocol_profile_and_rows(spark):
    profiles = profiling.profile_files(frame(spark, [("p.txt", PROTOCOL)])).cache()
    p = profiles.first()
    assert (p["delimiter"], p["brand"], p["header_row"], p["unit_row"], p["data_start"]) == (";", "arburg", 4, 5, 6)
    rows = files.read_protocol(profiles).orderBy("line_no").collect()
    assert [str(r["time"]) for r in rows] == ["2025-02-11 23:58:00", "2025-02-11 23:59:00", "2025-02-12 00:01:00"]
    assert rows[0]["machine_ref"] == "1003 - NOYAUX"
    assert rows[1]["cells"]["f077"] == ""  # short row padded
    assert len(rows[2]["cells"]) == 6  # long row cut
    mapped = mapping.apply_unit_row(
        mapping.column_map(mapping.file_headers(profiles), label_dictionary(spark))
    )
    by_label = {r["label"]: r for r in mapped.collect()}
    # the generic entry comes after the brand's and lowers the confidence
    assert (by_label["p4072"]["canonical"], by_label["p4072"]["confidence"]) == ("switchover_pressure_bar", 0.75)
    assert (by_label["t4012"]["canonical"], by_label["t4012"]["confidence"]) == ("cycle_time_s", 1.0)
    assert by_label["V4062"]["unit_compatible"] and by_label["t007"]["canonical"] is None
    canonical = mapping.typed(
        mapping.map_rows(files.read_protocol(profiles), mapped), ["dosing_time_s", "cycle_time_s"]
    ).orderBy("line_no").collect()
    assert canonical[0]["dosing_time_s"] == 7.862 and canonical[2]["cycle_time_s"] is None
    assert canonical[0]["raw_data"] == {"t007": "23:58"}


def test_delimiters_and_balance(spark):
    rows = {
        r["path"]: r
        for r in profiling.with_balance(
            profiling.profile_files(
                frame(
                    spark,
                    [
                        ("comma", "Time,Machine,Cycle\n1,2,3\n"),
                        ("semi", "Time;Machine;Cycle\n1;2;3\n"),
                        ("tab", "Time\tMachine\tCycle\n1\t2\t3\n"),
                        ("uneven", "a,b,c\n1,2\n1,2,3,4\n"),
                    ],
                )
            )
        ).collect()
    }
    assert [rows[k]["delimiter"] for k in ("comma", "semi", "tab")] == [",", ";", "\t"]
    assert rows["uneven"]["unbalanced"] and not rows["comma"]["unbalanced"]
    assert rows["comma"]["headers"] == ["Time", "Machine", "Cycle"]


def test_units_and_identifiers(spark):
    content = "Time,Machine,Cycle_Time_ms,Inj_Pres_psi\n2026-07-09T12:00:00Z,000123,2500,2617\n"
    profiles = profiling.profile_files(frame(spark, [("u.csv", content)])).cache()
    mapped = mapping.column_map(mapping.file_headers(profiles), label_dictionary(spark))
    row = mapping.typed(
        mapping.map_rows(files.read_table(profiles), mapping.apply_unit_row(mapped)),
        ["cycle_time_s", "peak_pressure_bar"],
    ).first()
    assert row["cycle_time_s"] == pytest.approx(2.5)
    assert row["peak_pressure_bar"] == pytest.approx(180.43, abs=0.01)
    assert row["raw_data"]["Machine"] == "000123"
    assert str(row["time"]) == "2026-07-09 12:00:00"
    # an explicit unit row removes the scale inferred from the header
    explicit = mapped.withColumn("unit_cell", F.when(F.col("label") == "Cycle_Time_ms", "s"))
    scales = {r["label"]: r["scale"] for r in mapping.apply_unit_row(explicit).collect()}
    assert scales["Cycle_Time_ms"] == 1.0


def test_transposed_file(spark):
    lines = [
        "Date\t11.02.26\t11.02.26\t11.02.26",
        "Heure\t0,488518519\t0,5\t0,75",
        "Num Cycle\t824\t823\tx",
        "CycleTime\t28,5\t29,1\t30",
        "DosingTime\t7\t\t8",
    ]
    profiles = profiling.profile_files(frame(spark, [("t.txt", "\n".join(lines).encode("utf-16"))]))
    rows = files.read_transposed(profiles.withColumn("is_transposed", F.lit(True)).withColumn("delimiter", F.lit("\t")))
    got = rows.orderBy("line_no").collect()
    assert [str(r["time"]) for r in got] == ["2026-02-11 11:43:28", "2026-02-11 12:00:00", "2026-02-11 18:00:00"]
    assert [r["cycle_counter"] for r in got] == [824, 823, None]
    assert got[0]["cells"] == {"CycleTime": "28,5", "DosingTime": "7"}


def test_small_transposed_is_detected(spark):
    content = "Variable,Cycle1,Cycle2\nTime,1,2\nCycle_Time,3,4\n"
    assert profiling.profile_files(frame(spark, [("v.csv", content)])).first()["is_transposed"]


def test_routes(spark):
    paths = [
        "file:/inbox/1/152/machine_cycles_152.csv",
        "file:/inbox/site-2/quality_checks.csv",
        "file:/inbox/3/export_machine_1003.txt",
        "file:/inbox/readme.csv",
        "file:/inbox/x/erp_orders.csv",
    ]
    got = files.with_route(spark.createDataFrame([(p,) for p in paths], "path string"), "/inbox").collect()
    assert [(r["source_kind"], r["site_id"], r["machine_ref"], r["route_error"]) for r in got] == [
        ("machine_cycle", 1, "152", None),
        ("quality", 2, None, None),
        ("machine_cycle", 3, "1003", None),
        ("machine_cycle", None, None, "site_id_missing_from_path"),
        ("erp_order", None, None, "site_id_invalid_in_path"),
    ]


def test_erp_labels(spark):
    french = spark.createDataFrame(
        [("OF1", "152", "09.07.2026 06:00", "09/07/2026 14:00:00", "P1", None), (None, "152", None, None, None, "x")],
        "`Réf OF` string, `Réf. Machine` string, `Début Equipe` string, `Fin Equipe` string, `Réf. produit` string, product_ref string",
    )
    rows = files.erp_orders(french, "Europe/Paris").collect()
    assert len(rows) == 1
    assert (rows[0]["id"], rows[0]["product_ref"]) == ("OF1", "P1")
    assert (str(rows[0]["started_at"]), str(rows[0]["ended_at"])) == ("2026-07-09 04:00:00", "2026-07-09 12:00:00")


def test_fingerprints_ignore_values_and_paths(spark):
    a = "Time,Machine,Cycle_Time\n2026-01-01 10:00:00,1,20\n"
    b = "Time,Machine,Cycle_Time\n2026-05-01 11:00:00,7,33\n"
    c = "Time,Machine,Cushion\n2026-05-01 11:00:00,7,33\n"
    profiles = profiling.with_fingerprint(
        profiling.with_metadata(profiling.profile_files(frame(spark, [("a", a), ("b", b), ("c", c)])))
    ).cache()
    groups = {r["path"]: r["files"] for r in profiling.fingerprint_groups(profiles).collect()}
    assert groups == {"a": 2, "b": 2, "c": 1}
    digest = profiles.where("path = 'a'").first()["fingerprint"]
    registry = spark.createDataFrame(
        [("p1", "1.0.0", "candidate", True, digest, profiling.FINGERPRINT_VERSION, "v1"),
         ("p2", "1.0.0", "approved", True, digest, profiling.FINGERPRINT_VERSION, "v1")],
        "profile_id string, profile_version string, status string, match_enabled boolean, digest string, "
        "fingerprint_version string, parser_version string",
    )
    got = {r["path"]: (r["profile_status"], r["profile_id"]) for r in profiling.match_profiles(profiles, registry).collect()}
    assert got == {"a": ("approved", "p2"), "b": ("approved", "p2"), "c": ("none", None)}
    twice = registry.withColumn("status", F.lit("candidate"))
    assert profiling.match_profiles(profiles, twice).where("path = 'a'").first()["profile_status"] == "duplicate"


def test_versioned_aliases(spark):
    headers = spark.createDataFrame(
        [("f", "arburg", 0, "t4012", None), ("f", "arburg", 1, "zz1", None)],
        "path string, brand string, position int, label string, unit_cell string",
    )
    mapped = mapping.column_map(headers, label_dictionary(spark))
    versions = spark.createDataFrame(
        [
            (None, None, "v1", "arburg", "zz1", "cushion_mm", "mm_or_cm3", "mm", 1.0, 0.9),
            ("1", None, "v1", "arburg", "zz1", "clamp_force_kn", "kn", "kn", 1.0, 0.8),
        ],
        "site string, machine string, parser_version string, mapping_brand string, alias_label string, canonical string, "
        "unit string, source_unit string, scale double, confidence double",
    )
    owner = lambda site: spark.createDataFrame([("f", site, None, "v1")], "path string, site string, machine string, parser_version string")
    at = lambda site: {r["label"]: r["canonical"] for r in mapping.apply_versions(mapped, owner(site), versions).collect()}
    assert at("1") == {"t4012": "cycle_time_s", "zz1": "clamp_force_kn"}
    assert at("2") == {"t4012": "cycle_time_s", "zz1": "cushion_mm"}


def test_probe_report(spark):
    content = "Time,Machine,Cycle_Time,Foo\n2026-07-09T12:00:00Z,1,20,x\n,1,-3,y\n"
    report = probe.probe_files(frame(spark, [("a.csv", content)]), label_dictionary(spark)).first()
    assert report["recognised"] == ["cycle_time_s"] and report["rows"] == 2
    assert report["invalid_count"] == 2 and report["rows_with_invalid_values"] == 1 and not report["valid"]
    assert report["missing_required"] == []


def test_source_times(spark):
    texts = ["1781006400", "09/07/2026 12:00:00", "11.02.25 08:00", "2026-07-09T12:00:00+02:00", "28,500", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(times.parse_source_time(F.col("t")).cast("string")).collect()]
    assert got == ["2026-06-09 12:00:00", "2026-07-09 12:00:00", "2025-02-11 08:00:00", "2026-07-09 10:00:00", None, None]


def test_labels(spark):
    df = spark.createDataFrame([("Matelas de matière, valeur réelle",), (" Cycle_Time.ms ",)], "t string")
    got = [r[0] for r in df.select(text.normalise_label(F.col("t"))).collect()]
    assert got == ["matelasdematiere,valeurreelle", "cycletimems"]


def test_labels_fold_like_compatibility_decomposition(spark):
    import unicodedata

    points = [p for low, high in [(0x20, 0x600), (0x1E00, 0x2200), (0x2460, 0x2500), (0x3300, 0x3400), (0xFB00, 0xFB50), (0xFF00, 0xFFF0), (0x1D400, 0x1D800)] for p in range(low, high)]
    labels = ["".join(map(chr, points[i : i + 30])) + " t_0" for i in range(0, len(points), 30)] + ["", None]

    def plain(label):
        decomposed = unicodedata.normalize("NFKD", (label or "").replace("﻿", "")).casefold()
        return "".join(c for c in decomposed if not unicodedata.combining(c) and not c.isspace() and c not in "_.-/\\")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.fold_label(F.col("t"))).collect()]
    assert got == [plain(t) for t in labels]
    assert plain("cm³ ＴＥＭＰ ﬁn Straße") == "cm3tempfinstrasse"


def test_registry_rows_are_checked(spark):
    digest, version = "a" * 64, profiling.FINGERPRINT_VERSION
    good = ("p1", "1.0.0", "approved", True, digest, version, "v1", "2026", "me", True)
    cases = {
        None: good, "status_invalid": (*good[:2], "draft", *good[3:]), "approval_without_evidence": (*good[:9], False),
        "identifier_invalid": ("a b", *good[1:]), "version_invalid": (good[0], None, *good[2:]), "parser_version_invalid": (*good[:6], "/x", *good[7:]),
        "fingerprint_version_unsupported": (*good[:5], None, *good[6:]), "digest_invalid": (*good[:4], "A" * 64, *good[5:]),
    }
    off = ("p9", "1.0.0", "candidate", False, None, None, None, None, None, None)
    schema = (
        "profile_id string, profile_version string, status string, match_enabled boolean, digest string, fingerprint_version string, "
        "parser_version string, approved_at string, approved_by string, field_validated boolean"
    )
    registry = spark.createDataFrame([*cases.values(), off], schema)
    assert [r["registry_error"] for r in profiling.check_profiles(registry).collect()] == [*cases, None]
    profiles = spark.createDataFrame([("a", digest), ("b", "b" * 64)], "path string, fingerprint string")
    got = {r["path"]: (r["profile_status"], r["profile_id"]) for r in profiling.match_profiles(profiles, registry).collect()}
    assert got == {"a": ("approved", "p1"), "b": ("none", None)}


def test_the_most_specific_version_set_counts(spark):
    versions = [(s, m, "v1", "arburg", "zz", f"{s}-{m}", "u", None, None, None) for s, m in [("1", "7"), ("1", None), (None, "7"), (None, None)]]
    schema = (
        "site string, machine string, parser_version string, mapping_brand string, alias_label string, canonical string, "
        "unit string, source_unit string, scale double, confidence double"
    )
    paths = [("1", "7"), ("1", "8"), ("2", "7"), ("2", "8"), (None, None), ("", "7"), ("../x", "7"), ("*", "7")]
    owner = spark.createDataFrame([(str(i), s, m, "v1") for i, (s, m) in enumerate(paths)] + [("8", "1", "7", "v2")], "path string, site string, machine string, parser_version string")
    headers = owner.select("path", F.lit("arburg").alias("brand"), F.lit(0).alias("position"), F.lit("Z-Z").alias("label"), F.lit(None).cast("string").alias("unit_cell"))
    mapped = mapping.column_map(headers, label_dictionary(spark))
    every = spark.createDataFrame(versions, schema)
    got = {r["path"]: r["canonical"] for r in mapping.apply_versions(mapped, owner, every).collect()}
    assert got == {"0": "1-7", "1": "1-None", "2": "None-7", "3": "None-None", "4": "None-None", "5": "None-7", "6": None, "7": None, "8": None}
    other = every.withColumn("mapping_brand", F.when(F.col("canonical") == "1-7", "engel").otherwise("arburg"))
    assert mapping.apply_versions(mapped, owner, other).where("path = '0'").first()["canonical"] is None


def test_texts_of_one_row_group_are_profiled_by_many_tasks(spark, tmp_path):
    from cyclelake.plans import file_queries
    from cyclelake.plans.views import Views

    spark.createDataFrame([(i, f"a;b;c\n{i};2;3\n") for i in range(400)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = file_queries._profiles(Views(spark, str(tmp_path)))
    assert found.count() == 400 and len(found.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert found.select("delimiter", "header_row", "column_count").distinct().collect() == [(";", 0, 3)]


def test_a_value_is_computed_once(spark):
    """An expression bound by `let` stands once in the plan, however often it is used."""
    from pyspark.sql import functions as F

    from cyclelake.sources.profiling import looks_like_header

    plan = spark.createDataFrame([("a;b;c", ";")], "line string, d string").select(looks_like_header(F.col("line"), F.col("d")).alias("h"))
    assert plan.first().h and plan._jdf.queryExecution().analyzed().toString().count("split(") == 1
