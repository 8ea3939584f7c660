"""Hot groups are cut into buckets: results must equal the plain windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from cyclelake.operators import features, intervals, monitor
from cyclelake.operators.detect import scrap_bursts
from cyclelake.operators.ordered import (
    Budget,
    _bucketed,
    exact_quantiles,
    framed,
    row_positions,
    running_sums,
    split_hot,
)
from helpers import at, cycles, orders, rounded

TIGHT = Budget(group_rows=7)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, null keys, equal order values, clustered values."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, *map(str, range(40))])
        rows.append((key, rng.choice([1, 1, 1, 2, 50, 1000, i]), i, rng.choice([None, 1.0, 2.5, rng.random()])))
    return spark.createDataFrame(rows, "k string, o bigint, i bigint, x double").cache()


def test_hot_groups_are_found(skewed):
    plain, hot = split_hot(skewed, ["k"], TIGHT)
    assert hot is not None and hot.select("k").distinct().count() >= 1
    assert plain.count() + hot.count() == 300
    assert split_hot(skewed, ["k"], Budget())[1] is None


def test_one_machine_on_one_timestamp_is_cut_apart(spark):
    rows = spark.range(400).selectExpr("7 AS k", "timestamp'2026-01-01' AS o", "(id * 37) % 400 AS i")
    kept = _bucketed(rows.withColumn("_group", F.struct("k")), ["o", "i"], TIGHT)
    sizes = [r["count"] for r in kept.groupBy("_bucket").count().collect()]
    assert len(sizes) > 100 and max(sizes) <= TIGHT.group_rows
    placed = row_positions(rows, ["k"], ["o", "i"], "p", TIGHT).collect()
    assert [r.p for r in sorted(placed, key=lambda r: r.i)] == list(range(1, 401))


def test_buckets_have_no_upper_bound(spark):
    rows = spark.range(3000).selectExpr("1 AS k", "id AS i")
    tiny = Budget(group_rows=4)
    kept = _bucketed(rows.withColumn("_group", F.struct("k")), ["i"], tiny)
    assert kept.select("_bucket").distinct().count() > 1024


def test_hot_groups_are_counted_not_estimated(spark):
    """The rows come out of an explode, whose size Catalyst cannot know."""
    rows = spark.range(1).selectExpr("1 AS k", "explode(sequence(1, 50)) AS i")
    assert split_hot(rows, ["k"], Budget(group_rows=49))[1].count() == 50
    assert split_hot(rows, ["k"], Budget(group_rows=50))[1] is None


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums_and_positions(skewed, keys):
    sums = {"n": F.lit(1).cast("long"), "s": F.col("i")}
    assert rounded(running_sums(skewed, keys, ["o", "i"], sums, TIGHT)) == rounded(
        running_sums(skewed, keys, ["o", "i"], sums)
    )
    placed = row_positions(skewed, keys, ["o", "i"], "p", TIGHT)
    w = Window.partitionBy(*keys).orderBy("o", "i")
    assert rounded(placed) == rounded(skewed.withColumn("p", F.row_number().over(w).cast("long")))


@pytest.mark.parametrize("before,after", [(3, 0), (0, 4), (6, 6), (9, 9)])
def test_bounded_frames(skewed, before, after):
    columns = {
        "a": lambda w: F.avg("x").over(w.rowsBetween(-before, after)),
        "c": lambda w: F.count("x").over(w.rowsBetween(-before, after)),
        "l": lambda w: F.lag("i", before).over(w) if before else F.lead("i", after).over(w),
    }
    assert rounded(framed(skewed, ["k"], ["o", "i"], columns, before, after, TIGHT)) == rounded(
        framed(skewed, ["k"], ["o", "i"], columns, before, after)
    )


@pytest.mark.parametrize("keys", [["k"], []])
def test_exact_quantiles(skewed, keys):
    q = {"median": 0.5, "high": 0.98, "low": 0.0, "top": 1.0}
    assert rounded(exact_quantiles(skewed, keys, "x", q, TIGHT)) == rounded(exact_quantiles(skewed, keys, "x", q))


@pytest.fixture(scope="module")
def long_history(spark):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        scrap = rng.random() < (0.6 if 120 < i < 170 else 0.05)
        rows.append(
            {
                "machine_id": 7 if i % 4 else 8,
                "time": at(i * rng.choice([1, 1, 2])),
                "scrap_flag": scrap,
                "defect_type": rng.choice(["flash", "bubbles"]) if scrap else None,
                "cycle_time_s": rng.choice([None, 20.0, 21.5, rng.random()]),
                "production_order_id": None,
            }
        )
    return cycles(spark, rows).cache()


def test_features_on_hot_machines(long_history):
    budget = Budget(group_rows=25)
    sources = ["cycle_time_s"]
    assert rounded(features.volatility_features(long_history, sources, budget)) == rounded(
        features.volatility_features(long_history, sources)
    )
    assert rounded(features.scrap_history(long_history, budget)) == rounded(features.scrap_history(long_history))
    assert rounded(features.future_instability(long_history, budget)) == rounded(
        features.future_instability(long_history)
    )
    for keys in (["site_id", "machine_id"], []):
        assert rounded(features.chronological_split(long_history, keys, budget=budget)) == rounded(
            features.chronological_split(long_history, keys)
        )
    assert rounded(features.gap_sessions(long_history, 90, budget)) == rounded(features.gap_sessions(long_history, 90))
    assert rounded(features.stride_sample(long_history, ["time", "cycle_counter"], 40, budget)) == rounded(
        features.stride_sample(long_history, ["time", "cycle_counter"], 40)
    )


def test_bursts_on_hot_machines(long_history):
    found = rounded(scrap_bursts(long_history))
    assert found
    assert rounded(scrap_bursts(long_history, budget=Budget(group_rows=40))) == found


def test_monitor_on_hot_models(spark):
    rng = random.Random(9)
    rows = [("m", round(rng.gauss(0, 1), 2), i % 2, int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, score double, side int, label int")
    ref, obs = df.where("side = 0"), df.where("side = 1")
    for keys in (["model"], []):
        for run in (
            lambda b: monitor.stability_index(ref, obs, keys, budget=b),
            lambda b: monitor.ks_test(ref, obs, keys, budget=b),
            lambda b: monitor.brier_scores(monitor.rank_probabilities(ref, obs, keys, b), keys),
            lambda b: monitor.classifier_metrics(df.withColumn("predicted", F.col("score") > 1), keys, b),
        ):
            assert rounded(run(TIGHT)) == rounded(run(Budget()))


def test_overlaps_on_hot_machines(spark):
    rng = random.Random(2)
    rows = [
        {"id": f"o{i:03}", "s": at(s := rng.randint(0, 300)), "e": None if i % 9 == 0 else at(s + rng.randint(0, 60))}
        for i in range(80)
    ]
    df = orders(spark, rows)
    pairs = sum(
        a["s"] < (b["e"] or at(1e6)) and b["s"] < (a["e"] or at(1e6)) for i, a in enumerate(rows) for b in rows[i + 1 :]
    )
    for budget in (TIGHT, Budget()):
        assert intervals.overlapping_order_pairs(df, budget).first()["overlapping_pairs"] == pairs


def test_newest_rows_of_a_hot_group_come_from_few_candidates(spark):
    from pyspark.sql import Window

    hot = spark.range(200_000).select(F.lit("hot").alias("model"), F.timestamp_micros(F.col("id") * F.col("id") % 999_983 * 1000).alias("time"), "id")
    same = spark.range(30_000).select(F.lit("same").alias("model"), F.timestamp_micros(F.lit(5).cast("bigint")).alias("time"), (F.col("id") + 10**6).alias("id"))
    rest = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("model"),
        F.when(F.col("id") % 5 != 0, F.timestamp_micros(F.col("id") % 50)).alias("time"),
        (F.col("id") + 10**7).alias("id"),
    )
    rows = hot.union(same).union(rest).cache()
    newest = Window.partitionBy("model").orderBy(F.col("time").desc_nulls_last(), F.desc("id"))
    for n in (1, 100, 700):
        want = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")
        assert rounded(features.most_recent(rows, ["model"], n, ["time", "id"])) == rounded(want)
        found = features.recent_candidates(rows.withColumn("_group", F.struct("model")), n, "time", bins=16)
        held = {r["model"]: r["count"] for r in found.groupBy("model").count().collect()}
        assert n <= held["hot"] <= 4 * n + 1 and held["same"] == 30_000
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "1000"


def test_running_maxima_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i, rng.choice([None, rng.randrange(100)])) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, t int, i int, x int")
    largest = {"top": F.when(F.col("x").isNotNull(), F.struct("x", "i"))}
    made = [
        sorted(map(tuple, running_sums(df, ["g"], ["t", "i"], {"n": F.lit(1)}, budget, largest).select("i", "n", "top.x", "top.i").collect()))
        for budget in (Budget(), Budget(60))
    ]
    assert made[0] == made[1] and len(made[0]) == 800
    held: dict = {}
    for g, t, i, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        held[g] = max(held.get(g, (-1, -1)), (-1, -1) if x is None else (x, i))
        assert (made[0][i][2], made[0][i][3]) == (held[g] if held[g][0] >= 0 else (None, None))


def test_small_inputs_are_not_counted(spark):
    from cyclelake.operators.ordered import is_small

    df = spark.range(1000)
    assert is_small(df, Budget()) and not is_small(df, Budget(100))


def test_differences_of_running_sums_equal_sliding_sums(spark):
    """The same in ordinary groups and in blocks of a group beyond its budget."""
    from pyspark.sql import functions as F

    from cyclelake.operators.ordered import Budget, framed

    rows = spark.createDataFrame([(i % 2, i, (i * 7919) % 13) for i in range(200)], "g long, t long, v long")
    past = lambda w, n: F.coalesce(F.lag("_sum", n).over(w), F.lit(0))
    columns = {"new": lambda w: past(w, 1) - past(w, 6), "old": lambda w: F.coalesce(F.sum("v").over(w.rowsBetween(-5, -1)), F.lit(0))}
    for budget in (Budget(1000), Budget(16)):
        found = framed(rows, ["g"], ["t"], columns, 5, 0, budget, {"_sum": F.col("v")})
        assert found.columns == ["g", "t", "v", "new", "old"] and found.count() == 200 and found.where("new != old").isEmpty()
