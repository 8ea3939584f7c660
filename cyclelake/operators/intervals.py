"""Interval joins: cycles to orders, shifts and downtime.

All joins are equi-joins on (site, machine, time cell). Instead of pairing every cycle with every interval, the
intervals are folded into one calendar row per cell that holds cycles:

* intervals covering the whole cell only matter by their count and their best member;
* open-ended intervals, the last one that ended before and the next one to start are carried along the
  cells by running aggregates;
* only intervals that start or end within the cell stay as a list and are tested per cycle.

A cell is a six-hour bucket. Buckets in which many intervals start or end are cut into as many cells as keeps the
lists short, and nothing is laid out beyond the buckets that hold a machine's cycles. A cycle
therefore meets exactly one row, however many intervals overlap, and the cycles are shuffled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.functions.times import HOUR, MINUTE, micros, time_bucket
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, running_sums
from cyclelake.schema import SITE_MACHINE
from cyclelake.session import stored

# --- fixed values ---------------------------------------------------------------------
TOLERANCE_MIN = 30
CONFIDENCE_SPAN_S = 1800.0
AMBIGUOUS_CONFIDENCE = 0.6
# --------------------------------------------------------------------------------------
BUCKET = 6 * HOUR
CELL_INTERVALS, MOST_CELLS = 32, 4096  # starts and ends aimed at in a cell, and the most cells of a bucket


def _bucket_range(low: Column, high: Column) -> Column:
    """Bucket numbers from low to high; empty when high is below low."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def cycle_buckets(cycles: DataFrame, width: int = BUCKET) -> DataFrame:
    """The (site, machine, bucket) triples that hold cycles."""
    return cycles.select(
        *SITE_MACHINE, time_bucket(micros(F.col("time")), width).alias("bucket")
    ).distinct()


def _spans(intervals: DataFrame, extra: list[str], skeleton: DataFrame) -> DataFrame:
    """Intervals in microseconds with the first and last bucket of their machine's cycles."""
    limits = skeleton.groupBy(*SITE_MACHINE).agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    spans = intervals.where(F.col("started_at").isNotNull()).select(
        *SITE_MACHINE, "id", *extra, micros(F.col("started_at")).alias("s"), micros(F.col("ended_at")).alias("e")
    )
    return spans.join(limits, SITE_MACHINE)


def dense_buckets(spans: DataFrame, width: int = BUCKET, target: int = CELL_INTERVALS) -> DataFrame | None:
    """(site, machine, bucket, cells) of the buckets with many starts and ends, None if there are none."""
    ends = spans.select(*SITE_MACHINE, "first", "last", F.explode(F.array_compact(F.array("s", "e"))).alias("at"))
    counted = (
        ends.withColumn("bucket", time_bucket(F.col("at"), width))
        .where(F.col("bucket").between(F.col("first"), F.col("last")))
        .groupBy(*SITE_MACHINE, "bucket")
        .count()
        .where(F.col("count") > 2 * target)
    )
    cells = F.least(F.lit(MOST_CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("count") / target)))).cast("bigint")
    dense = counted.select(*SITE_MACHINE, "bucket", cells.alias("cells"))
    return None if dense.isEmpty() else stored(dense)


def with_cell(rows: DataFrame, time: Column, dense: DataFrame | None, width: int, prefix: str = "") -> DataFrame:
    """Add `bucket`, its number of `cells` and the `cell` of a time."""
    bucket, cells, cell = (f"{prefix}{n}" for n in ("bucket", "cells", "cell"))
    placed = rows.withColumn(bucket, time_bucket(time, width))
    if dense is None:
        return placed.withColumns({cells: F.lit(1).cast("bigint"), cell: F.lit(0).cast("bigint")})
    named = dense.withColumnsRenamed({"bucket": bucket, "cells": cells})
    found = placed.join(named, [*SITE_MACHINE, bucket], "left").withColumn(cells, F.coalesce(cells, F.lit(1).cast("bigint")))
    return found.withColumn(cell, F.floor((time - F.col(bucket) * width) * F.col(cells) / width))


def covering_calendar(
    spans: DataFrame, skeleton: DataFrame, dense: DataFrame | None, width: int, keys: list[str], tolerance: int | None = None
) -> DataFrame:
    """One row per key, bucket and cell of the skeleton with what a cycle in it needs to find its interval.

    `near` lists the intervals that start or end in the cell and, with a tolerance, the nearest ones before and after it;
    `n_covering` and `best_covering` describe those that cover it whole.
    """
    spans = with_cell(with_cell(spans, F.col("s"), dense, width, "s_"), F.col("e"), dense, width, "e_")
    reach = 0 if tolerance is None else -(-tolerance // width)
    item, rank = F.struct("s", "e", "id"), F.struct((-F.col("s")).alias("neg_start"), F.col("id"))
    kinds = {
        "near": "struct<s:bigint,e:bigint,id:string>",
        "full": "struct<neg_start:bigint,id:string>",
        "opened": "struct<neg_start:bigint,id:string>",
        "ended": "struct<neg_end:bigint,s:bigint,id:string,e:bigint>",
        "closed_ahead": "struct<s:bigint,id:string,e:bigint>",
        "open_ahead": "struct<s:bigint,id:string,e:bigint>",
    }

    def laid(df: DataFrame, cell: Column | None = None, **values: Column) -> DataFrame:
        """Rows of (keys, bucket, cell) with some of the values."""
        filled = [values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
        return df.select(*keys, "bucket", (F.col("cell") if cell is None else cell).cast("bigint").alias("cell"), *filled)

    closed, upright = F.col("e").isNotNull(), F.col("e").isNull() | (F.col("e") >= F.col("s"))
    inside = F.col("bucket").between(F.col("first"), F.col("last"))
    start, end = F.struct(F.col("s_bucket").alias("bucket"), F.col("s_cell").alias("cell")), F.struct(F.col("e_bucket").alias("bucket"), F.col("e_cell").alias("cell"))
    ends = F.when(closed, F.array_distinct(F.array(start, end))).otherwise(F.array(start))
    at = lambda which: spans.where(upright).withColumns({"bucket": F.col(f"{which}_bucket"), "cell": F.col(f"{which}_cell")})
    parts = [laid(spans.where(upright).withColumn("p", F.explode(ends)).withColumns({"bucket": F.col("p.bucket"), "cell": F.col("p.cell")}).where(inside), near=item)]
    if dense is not None:
        # cells between the ends in the buckets of the ends
        same = F.col("s_bucket") == F.col("e_bucket")
        rest = at("s").where(closed & inside).withColumn("to", F.when(same, F.col("e_cell")).otherwise(F.col("s_cells")) - 1)
        head = at("e").where(closed & inside & ~same)
        parts.append(laid(rest.withColumn("c", F.explode(_bucket_range(F.col("s_cell") + 1, F.col("to")))), F.col("c"), full=rank))
        parts.append(laid(head.withColumn("c", F.explode(_bucket_range(F.lit(0).cast("bigint"), F.col("e_cell") - 1))), F.col("c"), full=rank))
    opened = at("s").where(~closed & (F.col("bucket") <= F.col("last")))
    early = F.col("bucket") < F.col("first")
    parts.append(
        laid(opened.withColumns({"cell": F.when(early, 0).otherwise(F.col("cell")), "bucket": F.greatest("bucket", F.col("first") - 1)}), opened=rank)
    )
    if tolerance is not None:
        near_by = F.col("bucket").between(F.col("first") - reach, F.col("last") + reach)
        parts.append(laid(at("e").where(closed & near_by), ended=F.struct((-F.col("e")).alias("neg_end"), "s", "id", "e")))
        ahead = F.struct("s", "id", "e")
        parts.append(laid(at("s").where(near_by), closed_ahead=F.when(closed, ahead), open_ahead=F.when(~closed, ahead)))
    parts.append(laid(skeleton))
    folded = reduce(DataFrame.unionByName, parts).groupBy(*keys, "bucket", "cell").agg(
        F.collect_list("near").alias("near"),
        F.count("full").alias("n_full"),
        F.min("full").alias("best_full"),
        F.count("opened").alias("n_opened"),
        *[F.min(n).alias(n) for n in ("opened", "ended", "closed_ahead", "open_ahead")],
    )
    # rows per machine are bounded by the number of calendar cells, not by its cycles
    before = Window.partitionBy(*keys).orderBy("bucket", "cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("bucket", "cell").rowsBetween(1, Window.unboundedFollowing)
    last, closed_next, open_next = F.min("ended").over(before), F.min("closed_ahead").over(after), F.min("open_ahead").over(after)
    plain = lambda x: F.when(x.isNotNull(), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["id"].alias("id")))
    carried = folded.select(
        *keys,
        "bucket",
        "cell",
        F.concat("near", F.array_compact(F.array(*[plain(x) for x in (last, closed_next, open_next)]))).alias("near"),
        (F.col("n_full") + F.coalesce(F.sum("n_opened").over(before), F.lit(0))).alias("n_cells"),
        F.least("best_full", F.min("opened").over(before)).alias("best_cells"),
    )
    # buckets between those of the ends are covered whole; intervals that end before they start only lie within tolerance
    low, high = F.greatest(F.col("s_bucket") + 1, F.col("first")), F.least(F.col("e_bucket") - 1, F.col("last"))
    whole = spans.where(closed & upright).select(*keys, F.explode(_bucket_range(low, high)).alias("bucket"), rank.alias("full"), F.lit(None).cast(kinds["near"]).alias("odd"))
    if tolerance is not None:
        low = F.greatest(time_bucket(F.col("s") - tolerance, width), F.col("first"))
        high = F.least(time_bucket(F.col("e") + tolerance, width), F.col("last"))
        odd = spans.where(~upright).select(*keys, F.explode(_bucket_range(low, high)).alias("bucket"), F.lit(None).cast(kinds["full"]).alias("full"), item.alias("odd"))
        whole = whole.unionByName(odd)
    covered = whole.groupBy(*keys, "bucket").agg(F.count("full").alias("n_whole"), F.min("full").alias("best_whole"), F.collect_list("odd").alias("odd"))
    return carried.join(covered, [*keys, "bucket"], "left").select(
        *keys,
        "bucket",
        "cell",
        F.concat("near", F.coalesce("odd", F.array().cast(f"array<{kinds['near']}>"))).alias("near"),
        (F.col("n_cells") + F.coalesce("n_whole", F.lit(0))).alias("n_covering"),
        F.least("best_cells", "best_whole").alias("best_covering"),
    )


def _order_choice(time: Column, tolerance: int) -> tuple[Column, Column]:
    """(order id, confidence) of a cycle from its calendar row."""
    near = F.coalesce(F.col("near"), F.array().cast("array<struct<s:bigint,e:bigint,id:string>>"))
    strict = F.filter(near, lambda o: (o.s <= time) & (o.e.isNull() | (o.e >= time)))
    n_strict = F.size(strict) + F.coalesce(F.col("n_covering"), F.lit(0))
    best = F.least(
        F.array_min(F.transform(strict, lambda o: F.struct((-o.s).alias("neg_start"), o.id.alias("id")))),
        F.col("best_covering"),
    )
    # an order without an end counts as ending one minute after the cycle
    distance = lambda o: F.least(
        F.abs(time - o.s), F.abs(time - F.coalesce(o.e, time + MINUTE))
    )
    reachable = F.filter(
        near, lambda o: (o.s <= time + tolerance) & (o.e.isNull() | (o.e >= time - tolerance))
    )
    nearest = F.array_min(
        F.transform(reachable, lambda o: F.struct(distance(o).alias("d"), o.s.alias("s"), o.id.alias("id")))
    )
    fading = F.greatest(
        F.lit(0.0), F.round(F.lit(1.0) - nearest.d / F.lit(1e6) / F.lit(CONFIDENCE_SPAN_S), 3)
    )
    order_id = F.when(n_strict > 0, best.id).otherwise(nearest.id)
    confidence = (
        F.when(n_strict == 1, F.lit(1.0))
        .when(n_strict > 1, F.lit(AMBIGUOUS_CONFIDENCE))
        .otherwise(F.coalesce(fading, F.lit(0.0)))
    )
    return order_id, confidence


def link_orders(
    cycles: DataFrame, orders: DataFrame, tolerance_min: int = TOLERANCE_MIN, width: int = BUCKET
) -> DataFrame:
    """Set `production_order_id`, `order_site_id` and `link_confidence` of every cycle.

    One covering order: confidence 1.0. Several: the latest start, 0.6. None covering but
    one within the tolerance: the nearest end (earliest start, then id on ties) with
    confidence falling to 0 at 30 minutes. Otherwise no order and 0.0.
    """
    tolerance = tolerance_min * MINUTE
    spans = _spans(orders, [], cycle_buckets(cycles, width))
    dense = dense_buckets(spans, width)
    time = micros(F.col("time"))
    rows = with_cell(cycles.drop("production_order_id", "order_site_id", "link_confidence"), time, dense, width)
    skeleton = rows.select(*SITE_MACHINE, "bucket", "cell").distinct()
    calendar = covering_calendar(spans, skeleton, dense, width, SITE_MACHINE, tolerance)
    order_id, confidence = _order_choice(time, tolerance)
    linked = rows.join(calendar, [*SITE_MACHINE, "bucket", "cell"], "left").withColumns(
        {"production_order_id": order_id, "link_confidence": confidence}
    )
    return linked.withColumn(
        "order_site_id", F.when(F.col("production_order_id").isNotNull(), F.col("site_id"))
    ).drop("bucket", "cells", "cell", "near", "n_covering", "best_covering")


def _latest_covering(time: Column) -> Column:
    """Id of the covering interval with the latest start, from a calendar row."""
    covering = F.filter("near", lambda x: (x.s <= time) & (x.e.isNull() | (x.e >= time)))
    listed = F.array_min(F.transform(covering, lambda x: F.struct((-x.s).alias("neg_start"), x.id.alias("id"))))
    return F.least(listed, F.col("best_covering"))["id"]


def link_shifts(cycles: DataFrame, shifts: DataFrame, width: int = BUCKET) -> DataFrame:
    """Set `shift_id`: a covering shift, first that of the cycle's order, then the latest start."""
    spans = _spans(shifts, [F.col("production_order_id").alias("production_order_id")], cycle_buckets(cycles, width))
    dense = dense_buckets(spans, width)
    time = micros(F.col("time"))
    rows = with_cell(cycles.drop("shift_id"), time, dense, width)
    chosen = []
    own = shifts.where(F.col("production_order_id").isNotNull())
    for keys, name in [([*SITE_MACHINE, "production_order_id"], "_own"), (SITE_MACHINE, "_any")]:
        if name == "_own" and own.isEmpty():
            continue
        skeleton = rows.select(*keys, "bucket", "cell").distinct()
        calendar = covering_calendar(spans.dropna(subset=keys), skeleton.dropna(subset=keys), dense, width, keys)
        rows = rows.join(calendar, [*keys, "bucket", "cell"], "left").withColumn(name, _latest_covering(time)).drop("near", "n_covering", "best_covering")
        chosen.append(name)
    return rows.withColumn("shift_id", F.coalesce(*chosen)).drop("bucket", "cells", "cell", *chosen)


def relink_missing(
    cycles: DataFrame, orders: DataFrame, shifts: DataFrame, site_id: int | None = None
) -> DataFrame:
    """Link again only the cycles without an order, optionally of one site; others stay as they are."""
    pending = F.col("production_order_id").isNull()
    if site_id is not None:
        pending = pending & (F.col("site_id") == site_id)
    redone = link_shifts(link_orders(cycles.where(pending), orders), shifts)
    return cycles.where(~pending).unionByName(redone.select(*cycles.columns))


def overlapping_order_pairs(orders: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Number of overlapping order pairs per machine, counted without forming a pair.

    Per order: orders starting before its end, minus orders ended by its start. Summed over
    all orders every overlapping pair appears twice and each order meets itself once.
    Intervals that end before they start overlap nothing and are left out.
    """
    forever = F.lit(2**62).cast("long")
    spans = orders.select(
        *SITE_MACHINE,
        F.col("id"),
        micros(F.col("started_at")).alias("s"),
        F.coalesce(micros(F.col("ended_at")), forever).alias("e"),
    ).where(F.col("s") <= F.col("e"))
    # at equal instants ends come first: touching orders do not overlap
    ends = spans.select(*SITE_MACHINE, "id", F.col("e").alias("at"), F.lit(0).alias("kind"), "s", "e")
    starts = spans.select(*SITE_MACHINE, "id", F.col("s").alias("at"), F.lit(1).alias("kind"), "s", "e")
    counted = running_sums(
        ends.unionByName(starts),
        SITE_MACHINE,
        ["at", "kind", "id"],
        {"n_started": F.col("kind").cast("long"), "n_ended": (1 - F.col("kind")).cast("long")},
        budget,
    )
    itself = F.when(F.col("s") < F.col("e"), 1).otherwise(-1)
    meetings = F.when(F.col("kind") == 0, F.col("n_started") - itself).otherwise(-F.col("n_ended"))
    return counted.groupBy(*SITE_MACHINE).agg(
        (F.sum(meetings) / 2).cast("long").alias("overlapping_pairs")
    )


def points_in_windows(
    points: DataFrame,
    windows: DataFrame,
    time: str,
    start: str,
    end: str,
    width: int = BUCKET,
    keys: list[str] = SITE_MACHINE,
) -> DataFrame:
    """Inner join of points to the windows [start, end] holding them, by bucket equi-join.

    A point lies in one bucket, so a pair appears once. Windows are laid out only where their machine has points.
    """
    placed = points.withColumn("_bucket", time_bucket(micros(F.col(time)), width))
    limits = placed.groupBy(*keys).agg(F.min("_bucket").alias("_first"), F.max("_bucket").alias("_last"))
    low = F.greatest(time_bucket(micros(F.col(start)), width), F.col("_first"))
    high = F.least(time_bucket(micros(F.col(end)), width), F.col("_last"))
    known = windows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).join(limits, keys)
    spread = known.withColumn("_bucket", F.explode(_bucket_range(low, high))).drop("_first", "_last")
    return (
        placed.join(spread, [*keys, "_bucket"])
        .where(F.col(time).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )


def split_by_downtime(
    cycles: DataFrame, downtime: DataFrame, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Add `in_downtime` and `segment_no`: whether a known stop [started_at, ended_at] of the machine holds the cycle, and how
    many of its stops began by then.

    Starts and ends stand as marks in the ordered rows of the machine; a cycle lies in a stop where more of them have started than ended.
    """
    lasting = F.col("ended_at") >= F.col("started_at")
    marks = downtime.select(*SITE_MACHINE, "started_at", F.when(lasting, F.col("ended_at")).alias("ended_at"), F.coalesce(lasting, F.lit(False)).alias("_lasts"))
    starts = marks.where(F.col("started_at").isNotNull()).select(*SITE_MACHINE, F.col("started_at").alias("time"), F.lit(0).alias("_kind"), "_lasts")
    ends = marks.where("_lasts").select(*SITE_MACHINE, F.col("ended_at").alias("time"), F.lit(2).alias("_kind"), "_lasts")
    rows = cycles.withColumns({"_kind": F.lit(1), "_lasts": F.lit(False)})
    timeline = rows.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    counted = running_sums(
        timeline,
        SITE_MACHINE,
        ["time", "_kind", "cycle_counter", "source_row_hash"],  # at one instant starts come first and ends last
        {
            "segment_no": (F.col("_kind") == 0).cast("long"),
            "_active": F.when(F.col("_lasts"), F.when(F.col("_kind") == 0, 1).otherwise(-1)).otherwise(0).cast("long"),
        },
        budget,
    )
    timed = F.col("time").isNotNull()
    return (
        counted.where(F.col("_kind") == 1)
        .withColumn("in_downtime", timed & (F.col("_active") > 0))
        .drop("_kind", "_lasts", "_active")
    )


def flag_downtime(cycles: DataFrame, downtime: DataFrame, budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Add `in_downtime`: the cycle lies in a known stop of its machine."""
    return split_by_downtime(cycles, downtime, budget).drop("segment_no")
