"""Causal features, labels, chronological splits, recent windows and gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.functions.values import finite
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, framed, join_null_safe, row_positions, running_sums
from cyclelake.schema import (
    CYCLE_ORDER,
    HORIZON_CYCLES,
    MIN_FUTURE_SCRAPS,
    SITE_MACHINE,
    VOLATILITY_MIN_VALUES,
    VOLATILITY_SOURCES,
    VOLATILITY_WINDOW,
)
from cyclelake.session import stored

SCRAP_HISTORY = 20


def _volatility(name: str):
    def make(window):
        last = window.rowsBetween(1 - VOLATILITY_WINDOW, 0)
        return F.when(
            F.count(name).over(last) >= VOLATILITY_MIN_VALUES, F.stddev_pop(name).over(last)
        )

    return make


def volatility_features(
    cycles: DataFrame, sources: list[str] = VOLATILITY_SOURCES, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Rolling population spread of the last 20 cycles per machine, from 3 values on."""
    columns = {f"{name}_volatility_20": _volatility(name) for name in sources}
    return framed(cycles, SITE_MACHINE, CYCLE_ORDER, columns, VOLATILITY_WINDOW - 1, 0, budget)


def _scrap(name: str) -> Column:
    return F.col(name).cast("int")


def scrap_history(cycles: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Previous scrap flag and scrap rate of the previous 20 cycles (the current one excluded)."""
    columns = {
        "previous_scrap_flag": lambda w: F.lag(_scrap("scrap_flag")).over(w),
        "rolling_scrap_rate_20": lambda w: F.avg(_scrap("scrap_flag")).over(w.rowsBetween(-SCRAP_HISTORY, -1)),
    }
    return framed(cycles, SITE_MACHINE, CYCLE_ORDER, columns, SCRAP_HISTORY, 0, budget)


def _future_label(window) -> Column:
    ahead = window.rowsBetween(1, HORIZON_CYCLES)
    scraps = F.sum(_scrap("scrap_flag")).over(ahead)
    complete = F.count(_scrap("scrap_flag")).over(ahead) == HORIZON_CYCLES
    return F.when(complete, (scraps >= MIN_FUTURE_SCRAPS).cast("int"))


def future_instability(cycles: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Label: at least 3 scraps in the next 20 cycles; rows without 20 following cycles are dropped."""
    labelled = framed(
        cycles, SITE_MACHINE, CYCLE_ORDER, {"instability_next_20_cycles": _future_label}, 0, HORIZON_CYCLES, budget
    )
    return labelled.where(F.col("instability_next_20_cycles").isNotNull())


def training_features(
    cycles: DataFrame, sources: list[str] = VOLATILITY_SOURCES, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Volatility features and the future label in one pass over each machine."""
    columns = {f"{name}_volatility_20": _volatility(name) for name in sources}
    columns["instability_next_20_cycles"] = _future_label
    prepared = framed(
        cycles, SITE_MACHINE, CYCLE_ORDER, columns, VOLATILITY_WINDOW - 1, HORIZON_CYCLES, budget
    )
    return prepared.where(F.col("instability_next_20_cycles").isNotNull())


def chronological_split(
    rows: DataFrame,
    keys: list[str] = SITE_MACHINE,
    train_fraction: float = 2 / 3,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Add `split` train/test: the first two thirds of each group in time order train.

    An empty key list splits globally.
    """
    if not 0.5 <= train_fraction < 1:
        raise ValueError("train_fraction must be in [0.5, 1)")
    placed = row_positions(rows, keys, CYCLE_ORDER, "_position", budget)
    if keys:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
        sized = join_null_safe(placed, sizes, keys)
    else:
        sized = placed.crossJoin(rows.agg(F.count("*").alias("_size")))  # one row
    cut = F.greatest(
        F.lit(1), F.least(F.col("_size") - 1, F.floor(F.col("_size") * F.lit(train_fraction)))
    )
    return sized.withColumn("split", F.when(F.col("_position") <= cut, "train").otherwise("test")).drop(
        "_position", "_size"
    )


def split_classes(split: DataFrame, label: str) -> DataFrame:
    """Rows, events and whether both classes occur, per side of the split."""
    return split.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(label).cast("bigint").alias("events"),
        (F.count_distinct(label) >= 2).alias("both_classes"),
    )


RECENT_BINS = 4096


def recent_candidates(rows: DataFrame, n: int, first: str, bins: int = RECENT_BINS) -> DataFrame:
    """Rows (with `_group`) among which each group's newest n are, about n of a large group.

    `first`, the leading order column, is a time or a whole number. Groups of more than 4n rows are narrowed: counts per bin of `first`
    tell the bin that holds the n-th newest row, which is cut into bins again until it holds at most 3n rows or one
    value. Each step moves counts only.
    """
    kind = rows.schema[first].dataType.simpleString()
    value = F.unix_micros(first) if kind == "timestamp" else F.col(first).cast("bigint")
    slim = rows.select("_group", value.alias("_x")).where("_x IS NOT NULL")
    sizes = slim.groupBy("_group").agg(F.count("*").alias("_size"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    state = sizes.where(F.col("_size") > 4 * n).withColumn("_need", F.lit(n).cast("bigint"))
    if state.isEmpty():
        return rows
    state = stored(state)
    open_ = (F.col("_size") > 3 * n) & (F.col("_low") < F.col("_high"))
    while not state.where(open_).isEmpty():
        step = F.expr(f"(_high - _low) div {bins} + 1")
        own = slim.join(state.where(open_), "_group").where((F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high")))
        counted = own.withColumn("_step", step).groupBy("_group", "_high", "_low", "_need", "_step", F.expr("(_high - _x) div _step").alias("_bin")).count()
        before = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
        passed = counted.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        chosen = passed.where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("count") >= F.col("_need")))
        high = F.col("_high") - F.col("_bin") * F.col("_step")
        narrowed = chosen.select(
            "_group", F.col("count").alias("_size"), F.greatest("_low", high - F.col("_step") + 1).alias("_low"), high.alias("_high"), (F.col("_need") - F.col("_before")).alias("_need")
        )
        state = stored(state.where(~open_).select(*narrowed.columns).unionByName(narrowed))
    kept = rows.join(state.select("_group", "_low"), "_group", "left")
    return kept.where(F.col("_low").isNull() | (value >= F.col("_low"))).drop("_low")


def most_recent(rows: DataFrame, keys: list[str], n: int = 10_000, order: list[str] = CYCLE_ORDER[:2], parts: int = 64) -> DataFrame:
    """The newest n rows of each group, whatever its size: large groups are narrowed to few candidates first.

    Candidates of equal leading order value may still be many; they are cut down in `parts` before the last sort.
    """
    grouped = rows.withColumn("_group", F.struct(*keys))
    found = recent_candidates(grouped, n, order[0]).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    newest = [F.col(o).desc_nulls_last() for o in order]
    for window in (Window.partitionBy("_group", "_part"), Window.partitionBy("_group")):
        found = found.withColumn("_n", F.row_number().over(window.orderBy(*newest))).where(F.col("_n") <= n)
    return found.select(*rows.columns)


def stride_sample(
    rows: DataFrame, order: list[str], max_rows: int = 5000, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Every step-th row in order, at most max_rows, with step = count // max_rows."""
    total = rows.agg(F.count("*").alias("_total"))
    placed = row_positions(rows, [], order, "_position", budget).crossJoin(total)
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / max_rows))
    index = F.col("_position") - 1
    return placed.where((index % step == 0) & (index / step < max_rows)).drop("_position", "_total")


def top_signals(cycles: DataFrame, features: list[str], n: int = 3) -> DataFrame:
    """The n highest finite volatilities of each machine's latest cycle, names breaking ties."""
    latest = cycles.groupBy(*SITE_MACHINE).agg(
        F.max_by(F.struct(*features), F.struct(*CYCLE_ORDER)).alias("last")
    )
    signals = F.array(
        *[
            F.struct((-F.col(f"last.{f}")).alias("neg"), F.lit(f).alias("feature"), F.col(f"last.{f}").alias("volatility"))
            for f in features
        ]
    )
    usable = F.filter(signals, lambda s: finite(s.volatility).isNotNull())
    return latest.select(
        *SITE_MACHINE, F.posexplode(F.slice(F.sort_array(usable), 1, n)).alias("i", "s")
    ).select(*SITE_MACHINE, (F.col("i") + 1).alias("rank"), "s.feature", "s.volatility")


def gap_sessions(
    cycles: DataFrame, threshold_s: float = 120.0, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Add `idle_s`, `stop_kind` and `run_no` to every cycle.

    Idle time is the gap to the previous cycle beyond the cycle's own duration. Up to the
    threshold it is a micro-stop within the run; beyond it a downtime that starts a new run.
    """
    timed = framed(
        cycles, SITE_MACHINE, CYCLE_ORDER, {"_prev": lambda w: F.lag("time").over(w)}, 1, 0, budget
    )
    gap = (F.unix_micros("time") - F.unix_micros("_prev")) / F.lit(1e6)
    idle = F.greatest(F.lit(0.0), gap - F.coalesce("cycle_time_s", F.lit(0.0)))
    marked = timed.withColumn("idle_s", F.when(F.col("_prev").isNotNull(), idle)).withColumn(
        "stop_kind",
        F.when(F.col("idle_s") > threshold_s, "downtime").when(F.col("idle_s") > 0, "micro_stop"),
    )
    new_run = F.when(F.col("_prev").isNull() | (F.col("stop_kind") == "downtime"), 1).otherwise(0)
    return running_sums(
        marked.withColumn("_new", new_run),
        SITE_MACHINE,
        CYCLE_ORDER,
        {"run_no": F.col("_new").cast("long")},
        budget,
    ).drop("_prev", "_new")


def run_report(sessions: DataFrame) -> DataFrame:
    """Per machine: cycles, runs, stops, uptime (span without downtime) and whole span."""
    span = (F.max(F.unix_micros("time")) - F.min(F.unix_micros("time"))) / F.lit(1e6)
    down = F.coalesce(F.sum(F.when(F.col("stop_kind") == "downtime", F.col("idle_s"))), F.lit(0.0))
    return sessions.groupBy(*SITE_MACHINE).agg(
        F.count("*").alias("total_cycles"),
        F.max("run_no").alias("runs"),
        F.count_if(F.col("stop_kind") == "downtime").alias("downtime_events"),
        F.count_if(F.col("stop_kind") == "micro_stop").alias("micro_stops"),
        span.alias("duration_s"),
        (span - down).alias("uptime_s"),
    )
