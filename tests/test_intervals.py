"""Known answers and a brute-force check of the cycle links."""

import random
from datetime import datetime, timedelta

from cyclelake.operators import intervals
from helpers import at, by_hash, cycles, orders, shifts


def link(spark, cycle_rows, order_rows, **kw):
    made = intervals.link_orders(cycles(spark, cycle_rows), orders(spark, order_rows), **kw)
    return by_hash(made, "production_order_id", "link_confidence")


def test_inside_one_order(spark):
    got = link(spark, [{"time": at(60 + i)} for i in range(10)], [{"id": "OF1", "s": at(0), "e": at(240)}])
    assert set(got.values()) == {("OF1", 1.0)}


def test_near_and_far(spark):
    order = [{"id": "OF1", "s": at(0), "e": at(240)}]
    got = link(spark, [{"time": at(-15)}, {"time": at(360)}, {"time": at(-30)}, {"time": at(270)}], order)
    assert got == {"r0": ("OF1", 0.5), "r1": (None, 0.0), "r2": ("OF1", 0.0), "r3": ("OF1", 0.0)}


def test_no_order(spark):
    assert link(spark, [{"time": at(0)}], [{"id": "X", "machine": 9, "s": at(0), "e": at(9)}]) == {"r0": (None, 0.0)}


def test_machines_and_sites_do_not_mix(spark):
    rows = [{"time": at(5)}, {"time": at(5), "machine_id": 8}, {"time": at(5), "site_id": 2}]
    given = [
        {"id": "A", "s": at(0), "e": at(9)},
        {"id": "A", "machine": 8, "s": at(1), "e": at(9)},
        {"id": "B", "site": 2, "s": at(0), "e": at(9)},
    ]
    assert link(spark, rows, given) == {"r0": ("A", 1.0), "r1": ("A", 1.0), "r2": ("B", 1.0)}


def test_open_order_ahead_counts_as_close(spark):
    # no end: taken as one minute after the cycle
    assert link(spark, [{"time": at(-20)}], [{"id": "A", "s": at(0)}]) == {"r0": ("A", 0.967)}


def brute_force(time, rows):
    """The rule applied to one cycle by a plain loop."""
    tol = timedelta(minutes=30)
    near = [o for o in rows if o["s"] <= time + tol and (o.get("e") is None or o["e"] >= time - tol)]
    inside = [o for o in near if o["s"] <= time and (o.get("e") is None or time <= o["e"])]
    if inside:
        last = max(o["s"] for o in inside)
        return min(o["id"] for o in inside if o["s"] == last), 1.0 if len(inside) == 1 else 0.6
    if not near:
        return None, 0.0

    def key(o):
        end = o.get("e") or time + timedelta(minutes=1)
        d = min(abs((time - o["s"]).total_seconds()), abs((time - end).total_seconds()))
        return d, o["s"], o["id"]

    best = min(near, key=key)
    return best["id"], max(0.0, round(1 - key(best)[0] / 1800 + 1e-12, 3))


def test_against_brute_force(spark):
    rng = random.Random(11)
    for trial in range(3):
        given = []
        for i in range(60):
            s = at(rng.randint(0, 6000) / 2)
            length = rng.choice([0, 7, 45, 200, 900, 4000])
            given.append({"id": f"o{i:03}", "s": s, "e": None if rng.random() < 0.06 else s + timedelta(minutes=length)})
        if trial == 0:
            given = [o for o in given if o["e"] is not None][:25]
        rows = [{"time": at(rng.randint(-200, 7000) / 2)} for _ in range(300)]
        expected = {f"r{i}": brute_force(r["time"], given) for i, r in enumerate(rows)}
        assert link(spark, rows, given) == expected
        assert link(spark, rows, given, width=3600 * 1_000_000) == expected


def test_shifts(spark):
    day = datetime(2026, 7, 9)
    given = [
        ("S1", None, day + timedelta(hours=6), day + timedelta(hours=14)),
        ("S2", None, day + timedelta(hours=14), day + timedelta(hours=22)),
        ("S3", None, day + timedelta(hours=22), day + timedelta(hours=30)),
        ("OWN", "OF1", day + timedelta(hours=5), day + timedelta(hours=15)),
        ("OPEN", None, day + timedelta(hours=40), None),
    ]
    rows = [
        {"time": day + timedelta(hours=13, minutes=50)},
        {"time": day + timedelta(hours=14, minutes=10)},
        {"time": day + timedelta(hours=23)},
        {"time": day + timedelta(hours=29)},
        {"time": day + timedelta(hours=13, minutes=50), "production_order_id": "OF1"},
        {"time": day + timedelta(hours=60)},
        {"time": day + timedelta(hours=35)},
    ]
    got = by_hash(intervals.link_shifts(cycles(spark, rows), shifts(spark, given)), "shift_id")
    assert [got[f"r{i}"][0] for i in range(7)] == ["S1", "S2", "S3", "S3", "OWN", "OPEN", None]


def test_relink_keeps_linked_cycles(spark):
    rows = [{"time": at(5), "production_order_id": "KEEP", "link_confidence": 0.9}, {"time": at(5)}]
    made = intervals.relink_missing(
        cycles(spark, rows), orders(spark, [{"id": "A", "s": at(0), "e": at(9)}]), shifts(spark, [("S", None, at(0), at(9))])
    )
    assert by_hash(made, "production_order_id", "link_confidence", "shift_id") == {
        "r0": ("KEEP", 0.9, None),
        "r1": ("A", 1.0, "S"),
    }


def test_identical_orders_overlap_once(spark):
    given = [{"id": "A", "s": at(0), "e": at(9)}, {"id": "B", "s": at(0), "e": at(9)}, {"id": "C", "s": at(9), "e": at(12)}]
    assert intervals.overlapping_order_pairs(orders(spark, given)).first()["overlapping_pairs"] == 1


def test_many_orders_in_one_bucket(spark):
    """10,000 short and long orders within six hours, some open, some until the end of the calendar, some that end before they start."""
    rng = random.Random(5)
    given = []
    for i in range(10_000):
        s = at(rng.random() * 350)
        length = rng.choice([0.1, 0.5, 2, 20]) if i % 500 else None
        e = None if length is None and i % 1000 else datetime(9999, 12, 31) if length is None else s + timedelta(minutes=length)
        given.append({"id": f"o{i:05}", "s": s, "e": e})
    given = given[:9_990] + [{"id": f"x{i}", "s": at(100 + i), "e": at(99 + i)} for i in range(10)]
    given += [{"id": "old", "s": datetime(1, 1, 2), "e": at(1)}, {"id": "long", "s": datetime(1, 1, 2), "e": at(5_000)}]
    rows = [{"time": at(rng.random() * 900 - 100)} for _ in range(400)]
    expected = {f"r{i}": brute_force(r["time"], given) for i, r in enumerate(rows)}
    linked = intervals.link_orders(cycles(spark, rows), orders(spark, given))
    assert by_hash(linked, "production_order_id", "link_confidence") == expected
    machine = cycles(spark, rows)
    spans = intervals._spans(orders(spark, given), [], intervals.cycle_buckets(machine))
    dense = intervals.dense_buckets(spans)
    assert dense.agg({"cells": "max"}).first()[0] >= 256
    placed = intervals.with_cell(machine, intervals.micros(intervals.F.col("time")), dense, intervals.BUCKET)
    calendar = intervals.covering_calendar(spans, placed.select("site_id", "machine_id", "bucket", "cell").distinct(), dense, intervals.BUCKET, ["site_id", "machine_id"], 1)
    assert calendar.select(intervals.F.max(intervals.F.size("near"))).first()[0] < 400


def test_many_shifts_in_one_bucket(spark):
    rng = random.Random(6)
    given = []
    for i in range(4_000):
        s = at(rng.random() * 350)
        e = s + timedelta(minutes=rng.choice([0.2, 3, 60])) if i % 300 else None
        given.append((f"s{i:04}", f"OF{i % 50}" if i % 3 == 0 else None, s, e))
    given.append(("ever", None, datetime(1, 1, 2), datetime(9999, 1, 1)))
    rows = [{"time": at(rng.random() * 400 - 20), "production_order_id": rng.choice([None, f"OF{rng.randrange(60)}"])} for _ in range(300)]

    def choice(row):
        inside = [g for g in given if g[2] <= row["time"] and (g[3] is None or row["time"] <= g[3])]
        key = lambda g: (g[1] is None or g[1] != row["production_order_id"], datetime(9999, 1, 1) - g[2], g[0])
        return min(inside, key=key)[0] if inside else None

    got = by_hash(intervals.link_shifts(cycles(spark, rows), shifts(spark, given)), "shift_id")
    assert got == {f"r{i}": (choice(r),) for i, r in enumerate(rows)}


def test_overlapping_stops(spark):
    rng = random.Random(7)
    given = [(at(a := rng.randrange(400)), at(a + rng.choice([-3, 0, 1, 50]))) for _ in range(300)] + [(at(390), datetime(9999, 1, 1)), (None, at(3)), (at(4), None)]
    rows = [{"time": at(rng.randrange(-10, 420))} for _ in range(200)]
    table = spark.createDataFrame([(1, 7, s, e) for s, e in given], "site_id bigint, machine_id bigint, started_at timestamp, ended_at timestamp")
    got = by_hash(intervals.split_by_downtime(cycles(spark, rows), table), "in_downtime", "segment_no")
    for i, row in enumerate(rows):
        t = row["time"]
        inside = any(s and e and s <= t <= e for s, e in given)
        assert got[f"r{i}"] == (inside, sum(1 for s, _ in given if s and s <= t)), i
    assert by_hash(intervals.flag_downtime(cycles(spark, rows), table), "in_downtime") == {k: v[:1] for k, v in got.items()}


def test_windows_are_laid_out_where_points_are(spark):
    points = cycles(spark, [{"time": at(i)} for i in range(50)])
    windows = spark.createDataFrame(
        [(1, 7, datetime(1, 1, 2), datetime(9999, 1, 1)), (1, 7, at(10), at(12)), (1, 8, at(0), at(9)), (1, 7, at(12), at(10))],
        "site_id bigint, machine_id bigint, a timestamp, b timestamp",
    )
    met = intervals.points_in_windows(points, windows, "time", "a", "b")
    assert met.count() == 53
