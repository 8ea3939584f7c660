"""Ordered operators that stay exact and spread out when one group holds most rows.

A window partitioned by machine sorts a whole machine in one task. That is right for
ordinary groups and wrong for a machine holding a third of all rows. Where the optimizer's estimate of the
input leaves room for a group beyond its row budget, groups are counted
exactly, by a map-side combined count of the key columns alone. Groups within their row
budget take the plain window. Rows of groups beyond it are stored and range-partitioned
by group and the whole order key, so even rows with one equal time are cut apart:

* the number of ranges (buckets) is rows / budget, without an upper bound;
* running sums and maxima add the totals of the earlier buckets (one small row per group and bucket);
* bounded frames are computed on blocks of consecutive positions, each with copies of the
  few neighbouring rows its frames reach into.

The bucketed rows are stored before they are used twice, so a lost task sees the same buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from cyclelake.session import stored


@dataclass(frozen=True)
class Budget:
    """Rows of one group that one task may sort."""

    group_rows: int = 4_000_000


DEFAULT_BUDGET = Budget()
LEAST_ROW_BYTES = 16  # of a stored row, for the estimate
LIST_ROWS = 500_000  # of one group gathered as a list
WindowExpr = Callable[[WindowSpec], Column]


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join whose null keys match each other; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matched = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, matched, how).drop(*[f"_right_{k}" for k in keys])


def _with_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One never-null group column: joins and windows then treat null keys as equal.
    return df.withColumn("_group", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def is_small(df: DataFrame, budget: Budget) -> bool:
    """Whether the whole input is estimated at less than a group's budget, so that counting its groups would cost more than it saves.

    Plans with steps that make rows (explode, expand, Python) have no useful estimate. The answer only chooses the
    plan; both plans give equal results."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(step in plan.toString() for step in ("Generate ", "Expand ", "MapIn", "FlatMap", "LogicalRDD")):
        return False
    return int(str(plan.stats().sizeInBytes())) <= budget.group_rows * LEAST_ROW_BYTES


def split_hot(df: DataFrame, keys: Sequence[str], budget: Budget) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, rows of groups above the row budget or None); both carry `_group`.

    Hot groups number at most rows / group_rows. Where there are any, the input is stored once.
    """
    grouped = _with_group(df, keys)
    if is_small(df, budget):
        return grouped, None
    hot = grouped.groupBy("_group").count().where(F.col("count") > budget.group_rows).select("_group")
    if hot.isEmpty():
        return grouped, None
    kept, hot = stored(grouped), stored(hot)
    return kept.join(hot, "_group", "left_anti"), kept.join(hot, "_group", "left_semi")


def _bucketed(df: DataFrame, order: Sequence[str], budget: Budget) -> DataFrame:
    """Stored rows with `_bucket`, increasing along the order within every group."""
    rows = stored(df)
    ranges = max(2, -(-4 * rows.count() // budget.group_rows))
    cut = rows.repartitionByRange(ranges, "_group", *ascending(order))
    return stored(cut.withColumn("_bucket", F.spark_partition_id()))


def _running_hot(
    df: DataFrame, order: Sequence[str], sums: dict[str, Column], budget: Budget, largest: dict[str, Column] | None = None
) -> DataFrame:
    largest = largest or {}
    rows = _bucketed(df, order, budget).withColumns({f"_v_{n}": c for n, c in (sums | largest).items()})
    totals = rows.groupBy("_group", "_bucket").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums], *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in largest]
    )
    earlier = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_group",
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_s_{n}") for n in largest],
    )
    inside = (
        Window.partitionBy("_group", "_bucket")
        .orderBy(*ascending(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = rows.join(starts, ["_group", "_bucket"])
    done = joined.withColumns(
        {n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
        | {n: F.greatest(F.col(f"_s_{n}"), F.max(f"_v_{n}").over(inside)) for n in largest}
    )
    return done.drop("_bucket", *[f"_{p}_{n}" for n in [*sums, *largest] for p in "vs"])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    budget: Budget = DEFAULT_BUDGET,
    largest: dict[str, Column] | None = None,
) -> DataFrame:
    """Add per-group running sums, and running maxima of `largest`, along a total order (current row included)."""
    plain, hot = split_hot(df, keys, budget)
    window = (
        Window.partitionBy("_group").orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    result = plain.withColumns(
        {n: F.coalesce(F.sum(c).over(window), F.lit(0)) for n, c in sums.items()} | {n: F.max(c).over(window) for n, c in (largest or {}).items()}
    )
    if hot is not None:
        result = result.unionByName(_running_hot(hot, order, sums, budget, largest))
    return result.drop("_group")


def row_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Add the 1-based position of each row within its group."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, budget)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, WindowExpr],
    before: int,
    after: int,
    budget: Budget = DEFAULT_BUDGET,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` ahead.

    `running` are sums up to each row that the columns may take differences of, a step a row where a sliding sum takes
    its whole frame; where they start is not defined, and they are dropped.

    Each column is a function of the ordered window spec, e.g.
    ``lambda w: F.avg("x").over(w.rowsBetween(-19, 0))``.
    """
    plain, hot = split_hot(df, keys, budget)
    window = Window.partitionBy("_group").orderBy(*ascending(order))
    running = running or {}
    upto = lambda spec: {name: F.coalesce(F.sum(c).over(spec.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) for name, c in running.items()}
    result = plain.withColumns(upto(window)).withColumns({name: make(window) for name, make in columns.items()})
    if hot is not None:
        size = max(budget.group_rows, before, after, 1)
        placed = _running_hot(hot, order, {"_pos": F.lit(1).cast("long")}, budget)
        index = F.col("_pos") - 1
        own = F.floor(index / size)
        inner = index % size
        homes = F.array_compact(
            F.array(
                own,
                F.when(inner >= size - before, own + 1),
                F.when((inner < after) & (own > 0), own - 1),
            )
        )
        blocks = placed.withColumn("_own", own).withColumn("_block", F.explode(homes))
        inside = Window.partitionBy("_group", "_block").orderBy(*ascending(order))
        done = blocks.withColumns(upto(inside)).withColumns({name: make(inside) for name, make in columns.items()})
        done = done.where(F.col("_block") == F.col("_own")).drop("_pos", "_own", "_block")
        result = result.unionByName(done)
    return result.drop("_group", *running)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Exact quantiles per group with linear interpolation; nulls ignored.

    Ordinary groups use the built-in `percentile`; hot groups pick rows by position, because
    `percentile` keeps every distinct value of a group in one task.
    """
    rows = df.where(F.col(value).isNotNull())
    plain, hot = split_hot(rows, keys, budget)
    result = plain.groupBy("_group").agg(
        *[F.percentile(F.col(value), q).alias(name) for name, q in quantiles.items()]
    )
    if hot is not None:
        slim = hot.select("_group", F.col(value).cast("double").alias("_x"))
        counted = slim.groupBy("_group", "_x").count()
        totals = slim.groupBy("_group").agg(F.count("*").alias("_n"))
        placed = _running_hot(counted, ["_x"], {"_last": F.col("count")}, budget).join(totals, "_group")
        picks = []
        for name, q in quantiles.items():
            rank = F.lit(q) * (F.col("_n") - 1)
            first = F.col("_last") - F.col("count")
            at = lambda pos: F.max(F.when((pos >= first) & (pos < F.col("_last")), F.col("_x")))
            low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
            picks.append((low + (high - low) * part).alias(name))
        result = result.unionByName(placed.groupBy("_group").agg(*picks))
    return result.select(*[F.col(f"_group.{k}").alias(k) for k in keys], *quantiles)


def exact_medians(df: DataFrame, key: str, values: Sequence[str], budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """The exact medians of several columns per key, under their names; nulls ignored. `df` is a stored table.

    The values of an ordinary group are gathered as one sorted list a column, in one pass; hot groups are left to `exact_quantiles`.
    """
    plain, hot = split_hot(df.select(key, *values), [key], Budget(min(budget.group_rows, LIST_ROWS)))
    lists = plain.groupBy(key).agg(*[F.sort_array(F.collect_list(F.col(v).cast("double"))).alias(v) for v in values])
    at = lambda v, place: F.get(F.col(v), F.floor(place).cast("int"))
    middle = lambda v: at(v, (F.size(v) - 1) / 2) * 0.5 + at(v, F.size(v) / 2) * 0.5
    result = lists.select(key, *[F.when(F.size(v) > 0, middle(v)).alias(v) for v in values])
    if hot is not None:
        long = hot.drop("_group").unpivot([key], list(values), "_column", "_value")
        medians = exact_quantiles(long, [key, "_column"], "_value", {"_median": 0.5}, budget)
        result = result.unionByName(medians.groupBy(key).agg(*[F.max(F.when(F.col("_column") == v, F.col("_median"))).alias(v) for v in values]))
    return result
