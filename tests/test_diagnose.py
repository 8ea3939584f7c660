"""Detection and cause ranking on known cases."""

from datetime import timedelta

from pyspark.sql import functions as F

from cyclelake.operators.ordered import Budget
from cyclelake.operators import detect, diagnose
from helpers import at, checks, cycles, notes, orders, stops


def bursts(spark, flags):
    rows = [
        {
            "time": at(i / 60),
            "production_order_id": "OF-1",
            "scrap_flag": s,
            "part_quality_status": "scrap" if s else "good",
            "defect_type": "short_shot" if s else None,
        }
        for i, s in enumerate(flags)
    ]
    return cycles(spark, rows)


def test_burst_cases(spark):
    assert detect.scrap_bursts(bursts(spark, [i >= 29 for i in range(59)])).count() == 0
    assert detect.scrap_bursts(bursts(spark, [i % 25 == 0 for i in range(90)])).count() == 0
    found = detect.scrap_bursts(bursts(spark, [False] * 30 + [i < 20 for i in range(30)])).collect()
    assert len(found) == 1
    assert (found[0]["baseline_rate"], found[0]["defect_type"]) == (0.0, "short_shot")
    assert found[0]["incident_rate"] > 0.6


def test_detection_is_idempotent(spark):
    rows = bursts(spark, [False] * 30 + [i < 20 for i in range(30)])
    first = detect.detect_after_import(rows, rows).cache()
    assert first.count() == 1 and first.first()["severity"] == "critical"
    assert detect.detect_after_import(rows, rows, first).count() == 0


def incident(spark, order="OF-2025-0012", start=0.0, end=90.0, defect="short_shot"):
    return spark.createDataFrame(
        [("I1", 1, 7, order, at(start), at(end), at(end), defect)],
        "incident_id string, site_id bigint, machine_id bigint, production_order_id string, started_at timestamp, "
        "ended_at timestamp, data_cutoff timestamp, defect_type string",
    )


def zone2_case(spark):
    of = "OF-2025-0012"
    rows = [{"time": at(-10), "barrel_temp_zone2_c": 210.0}, {"time": at(-5), "barrel_temp_zone2_c": 211.0}]
    rows += [
        {"time": at(m), "barrel_temp_zone2_c": t, "scrap_flag": s, "defect_type": "short_shot" if s else None,
         "production_order_id": of}
        for m, t, s in ((10, 195.0, True), (20, 194.0, True), (30, 196.0, False))
    ]
    return (
        cycles(spark, rows),
        checks(spark, [(1, 7, at(30), "QC-1", of, 2, "short_shot", None, None, None)]),
        notes(spark, [(1, 7, at(20), "NOTE-1", of, "Zone 2 sous le seuil nominal")]),
        stops(spark, []),
    )


def test_cold_zone_two(spark):
    ranked = diagnose.investigate(
        incident(spark), *zone2_case(spark), policy=diagnose.Policy(abstain=False)
    ).cache()
    row = ranked.first()
    assert (row["status"], row["symptom"]) == ("completed", "short_shot_increase")
    top = diagnose.hypothesis_rows(ranked).where("rank = 1").first()
    assert top["cause_code"] == "low_barrel_temperature_zone_2" and top["score"] == 8.1
    evidence = {r["metric"]: r for r in diagnose.evidence_rows(ranked).collect()}
    assert evidence["barrel_temp_zone2_c"]["baseline"]["value"] == 210.5
    assert evidence["operator_note"]["excerpt"].startswith("Zone 2")


def test_missing_baseline_is_named(spark):
    of = "OF-2025-0012"
    rows = cycles(
        spark,
        [{"time": at(5), "barrel_temp_zone2_c": 195.0, "scrap_flag": True, "defect_type": "short_shot", "production_order_id": of}],
    )
    empty = checks(spark, []), notes(spark, []), stops(spark, [])
    ranked = diagnose.investigate(incident(spark), rows, *empty, policy=diagnose.Policy(abstain=False)).cache()
    row = ranked.first()
    assert row["data_quality"] == "insufficient_baseline"
    top = diagnose.hypothesis_rows(ranked).first()
    assert "baseline_cycles" in top["missing"] and top["confidence"] <= 0.62
    zone2 = diagnose.evidence_rows(ranked).where("metric = 'barrel_temp_zone2_c'").first()
    assert zone2["baseline"] is None
    # the strict policy abstains instead
    strict = diagnose.investigate(incident(spark), rows, *empty)
    assert strict.first()["status"] == "insufficient_samples"


def test_baseline_prefers_the_matching_context(spark):
    rows = [{"time": at(-500 + i), "production_order_id": "OF-MATCH", "order_site_id": 1} for i in range(30)]
    rows += [{"time": at(-100 + i), "production_order_id": "OF-OTHER", "order_site_id": 1} for i in range(40)]
    given = [
        {"id": "OF-NOW", "s": at(0), "e": at(90), "context": ("P1", "T1", "M1")},
        {"id": "OF-MATCH", "s": at(-500), "e": at(-400), "context": ("P1", "T1", "M1")},
        {"id": "OF-OTHER", "s": at(-100), "e": at(-50), "context": ("P9", "T9", "M9")},
    ]
    windows = diagnose.incident_windows(incident(spark, order="OF-NOW"))
    pick = lambda minimum, **kw: diagnose.comparable_baseline(
        windows, cycles(spark, rows), orders(spark, given), minimum, **kw
    )
    exact = pick(30).collect()
    assert len(exact) == 30 and {r["production_order_id"] for r in exact} == {"OF-MATCH"}
    assert {r["baseline_tier"] for r in exact} == {1}
    any_context = pick(31).collect()
    assert len(any_context) == 70 and {r["baseline_tier"] for r in any_context} == {4}
    newest = pick(31, limit=45)
    assert newest.count() == 45 and newest.agg(F.min("time")).first()[0] == at(-475)
    assert pick(71).count() == 0


def test_true_counts_in_context(spark):
    inc = incident(spark, order=None)
    made = diagnose.incident_context(
        inc,
        cycles(spark, [{"time": at(i), "barrel_temp_zone2_c": 200.0} for i in range(3)]),
        checks(spark, [(1, 7, at(i), f"q{i}", None, 0, None, None, None, None) for i in range(4)]),
    ).first()
    assert (made["cycle_count"], made["quality_check_count"]) == (3, 4)


def test_wear_trend(spark):
    rows = [(1, 7, at(0) + timedelta(days=i), f"q{i}", None, 0, None, 0.1 * i, 20.0 + i, None) for i in range(8)]
    spans = incident(spark, order=None, start=0, end=60 * 24 * 10)
    found = {
        r["value_name"]: r
        for r in diagnose.trends(
            diagnose.event_checks(diagnose.incident_windows(spans), checks(spark, rows)),
            ["dimension_deviation_mm", "measured_weight_g"],
        ).collect()
    }
    assert abs(found["dimension_deviation_mm"]["slope_per_day"] - 0.1) < 1e-9
    assert abs(found["dimension_deviation_mm"]["delta"] - 0.6) < 1e-9
    assert found["measured_weight_g"]["n"] == 8


def test_overlapping_incidents_make_no_pairs(spark):
    """10,000 month-long incidents of one machine over its cycles and checks."""
    from datetime import timedelta

    n, step = 3_000, 30
    rows = cycles(spark, [{"time": at(step * i), "scrap_flag": i % 7 == 0, "barrel_temp_zone2_c": None if i % 11 == 0 else 190 + i % 32 * 0.1} for i in range(n)])
    seen = checks(spark, [(1, 7, at(step * i + 1), f"q{i}", None, 1, None, None, None, None) for i in range(0, n, 3)])
    table = [(f"i{k:05}", 1, 7, None, at(k), at(k) + timedelta(days=30), None) for k in range(10_000)]
    table += [("late", 1, 7, None, at(5), at(4), None), ("open", 1, 7, None, at(60), None, at(120)), ("none", 1, 9, None, at(0), at(9), None), ("ends", 1, 7, None, at(30), None, None)]
    incidents = spark.createDataFrame(
        table, "incident_id string, site_id bigint, machine_id bigint, production_order_id string, started_at timestamp, ended_at timestamp, data_cutoff timestamp"
    )
    made = diagnose.incident_context(incidents, rows, seen)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Generate explode(sequence" not in plan
    got = {r["incident_id"]: r for r in made.collect()}
    assert len(got) == len(table)
    for k in (0, 1, 29, 30, 31, 4_567, 9_999):
        inside = [i for i in range(n) if k <= step * i <= k + 30 * 24 * 60]
        row = got[f"i{k:05}"]
        zone = [190 + i % 32 * 0.1 for i in inside if i % 11]
        assert row["cycle_count"] == len(inside) and row["quality_check_count"] == sum(1 for i in range(0, n, 3) if k <= step * i + 1 <= k + 43_200)
        assert abs(row["avg_zone2_temp_c"] - sum(zone) / len(zone)) < 1e-6 and abs(row["scrap_rate"] - sum(i % 7 == 0 for i in inside) / len(inside)) < 1e-12
    assert got["late"]["cycle_count"] == 0 and got["none"]["cycle_count"] == 0 and got["ends"]["avg_zone2_temp_c"] is None
    assert (got["open"]["cycle_count"], got["open"]["quality_check_count"]) == (3, 1)


def test_medians_of_both_sides_make_no_row_per_metric(spark):
    schema = "incident_id string, scrap_flag boolean, part_quality_status string, " + ", ".join(f"{m} double" for m in diagnose.METRICS)
    place = diagnose.METRICS.index("barrel_temp_zone2_c")

    def rows(incident, values):
        made = []
        for i, x in enumerate(values):
            metrics = [float(i)] * len(diagnose.METRICS)
            metrics[place] = x
            made.append((incident, i % 3 == 0, None, *metrics))
        return made

    nan, inf = float("nan"), float("inf")
    event = spark.createDataFrame(rows("A", [5.0, None, 1.0, nan, 2.0, inf, 9.0]) + rows("B", [None, None]), schema)
    baseline = spark.createDataFrame(rows("A", [3.0, 1.0, 2.0]) + rows("C", [-4.0, 4.0, 1.0, 1.5]), schema)
    near = lambda x: round(x, 9) if isinstance(x, float) else x
    one = lambda df: {r["incident_id"]: {k: near(x) for k, x in r.asDict().items()} for r in df.collect()}
    found = diagnose.side_statistics(event, baseline)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "percentile" not in plan
    got = one(found)
    assert sorted(got) == ["A", "B", "C"]
    medians = {i: (r["ev_median_barrel_temp_zone2_c"], r["bl_median_barrel_temp_zone2_c"]) for i, r in got.items()}
    assert medians == {"A": (3.5, 2.0), "B": (None, None), "C": (None, 1.25)}
    assert {i: (r["ev_cycles"], r["bl_cycles"], r["ev_n_barrel_temp_zone2_c"]) for i, r in got.items()} == {"A": (7, 3, 4), "B": (2, 0, 0), "C": (0, 4, 0)}
    assert got["A"]["ev_rate"] == near(3 / 7) and got["C"]["ev_rate"] is None and got["C"]["ev_scrap"] == 0
    assert one(diagnose.side_statistics(event, baseline, Budget(2))) == got  # incidents beyond the budget
