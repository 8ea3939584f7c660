"""Stateful stream operators: causal features in event time, score monitoring with feedback, delayed labels.

Both stateful operators are batch operators over a batch and a small stored state: rows that wait for the
watermark and the last cycles of each machine, or the newest scores of each model. Nothing
runs in Python, no group holds a batch, and a replayed batch gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cyclelake.functions.values import finite
from cyclelake.operators import monitor
from cyclelake.operators.features import most_recent, volatility_features
from cyclelake.operators.ordered import Budget, DEFAULT_BUDGET, join_null_safe
from cyclelake.schema import CYCLE_ORDER, SITE_MACHINE, VOLATILITY_FEATURES, VOLATILITY_SOURCES, VOLATILITY_WINDOW
from cyclelake.session import stored
from cyclelake.streaming.state import StateTables, start_batches

HISTORY = VOLATILITY_WINDOW - 1
KEY_SCHEMA = "site_id bigint, machine_id bigint, time timestamp, cycle_counter bigint, source_row_hash string"
CYCLE_SCHEMA = f"{KEY_SCHEMA}, {', '.join(f'{c} double' for c in VOLATILITY_SOURCES)}"
FEATURE_SCHEMA = f"{KEY_SCHEMA}, {', '.join(f'{f} double' for f in VOLATILITY_FEATURES)}"


@dataclass(frozen=True)
class VolatilityStream:
    """Volatility of every cycle in event time; cycles may arrive up to `delay_s` seconds late.

    A cycle waits until the newest time seen is `delay_s` past it. Then all cycles of its time are there, and it gets the
    values of the batch operator over its machine's history. Cycles that come later still are kept in
    the table `late` and change nothing. Tables below `base`: features and late (a folder per batch), pending, tail, clock.
    """

    spark: SparkSession
    base: str
    delay_s: float = 3600.0
    budget: Budget = DEFAULT_BUDGET

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*SITE_MACHINE, *CYCLE_ORDER, *[F.col(c).cast("double").alias(c) for c in VOLATILITY_SOURCES])
        self._advance(rows, batch_id, close=False)

    def close(self) -> None:
        """Release what still waits, as at the end of all input."""
        done = StateTables(self.spark, self.base).versions("clock")
        if done:
            self._advance(self.spark.createDataFrame([], CYCLE_SCHEMA), done[-1] + 1, close=True)

    def _advance(self, rows: DataFrame, batch_id: int, close: bool) -> None:
        state = StateTables(self.spark, self.base)
        clock = state.read("clock", "newest timestamp", batch_id)
        passed = clock.agg(F.max("newest")).first()[0]
        limit = F.lit(passed) - F.expr(f"INTERVAL {self.delay_s} SECONDS")
        late = F.coalesce(F.col("time") <= limit, F.lit(False)) if passed is not None else F.lit(False)
        rows = stored(rows)
        rows.where(late).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch_id}")
        waiting = stored(state.read("pending", CYCLE_SCHEMA, batch_id).unionByName(rows.where(~late)))
        newest = waiting.agg(F.max("time")).first()[0]
        newest = max((t for t in (passed, newest) if t is not None), default=None)
        ready = F.lit(True)
        if not close:
            ready = F.coalesce(F.col("time") <= F.lit(newest) - F.expr(f"INTERVAL {self.delay_s} SECONDS"), F.lit(newest is None))
        tail = state.read("tail", CYCLE_SCHEMA, batch_id)
        history = stored(tail.withColumn("_new", F.lit(False)).unionByName(waiting.where(ready).withColumn("_new", F.lit(True))))
        made = volatility_features(history, budget=self.budget).where("_new")
        made.select(*SITE_MACHINE, *CYCLE_ORDER, *VOLATILITY_FEATURES).write.mode("overwrite").parquet(f"{self.base}/features/batch={batch_id}")
        state.write("tail", most_recent(history, SITE_MACHINE, HISTORY, CYCLE_ORDER).drop("_new"), batch_id)
        state.write("pending", waiting.where(~ready), batch_id)
        state.write("clock", self.spark.createDataFrame([(newest,)] if newest else [], "newest timestamp"), batch_id)

    def start(self, cycles: DataFrame, available_now: bool = False) -> StreamingQuery:
        return start_batches(cycles, self.base, self.handle, available_now)

    def features(self) -> DataFrame:
        return self.spark.read.schema(FEATURE_SCHEMA).parquet(f"{self.base}/features").drop("batch")

    def late(self) -> DataFrame:
        return self.spark.read.schema(CYCLE_SCHEMA).parquet(f"{self.base}/late").drop("batch")


SCORE_SCHEMA = "model string, time timestamp, cycle_counter bigint, score double, threshold double"
LABEL_SCHEMA = "model string, time timestamp, cycle_counter bigint, score double, label int"
TOTAL_SCHEMA = "model string, observations_total bigint, alerts_total bigint"
MODEL = ["model"]


@dataclass(frozen=True)
class MonitorStream:
    """Monitoring figures of each model after every batch, against its reference scores.

    Rows have `kind`: `score` (with score and threshold; non-finite scores are ignored), `feedback` (score and label 0 or 1)
    or `reset`, which forgets what its model had up to then. State below `base`: the newest `window` scores and
    feedback rows of each model, and lifetime totals; both only ever shrink to `window` rows per model.
    """

    spark: SparkSession
    base: str
    reference: DataFrame
    window: int = monitor.RECENT_WINDOW

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        state = StateTables(self.spark, self.base)
        columns = ["model", "time", "cycle_counter", "score", "threshold", F.col("label").cast("int").alias("label"), "kind"]
        rows = stored(batch.select(*columns))
        moment = F.struct("time", "cycle_counter")
        resets = stored(rows.where("kind = 'reset'").groupBy("model").agg(F.max(moment).alias("_reset")))
        fresh = join_null_safe(rows, resets, MODEL, "left").where(F.col("_reset").isNull() | (moment > F.col("_reset"))).drop("_reset")
        usable = fresh.where(finite(F.col("score")).isNotNull())

        def kept(name: str, schema: str, new: DataFrame) -> DataFrame:
            old = join_null_safe(state.read(name, schema, batch_id), resets, MODEL, "left_anti")
            return state.write(name, most_recent(old.unionByName(new), MODEL, self.window), batch_id)

        scores = kept("scores", SCORE_SCHEMA, usable.where("kind = 'score'").drop("kind", "label"))
        labels = kept("labels", LABEL_SCHEMA, usable.where("kind = 'feedback' AND label IN (0, 1)").drop("kind", "threshold"))
        alert = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
        counted = usable.where("kind = 'score'").groupBy("model").agg(
            F.count("*").alias("observations_total"), F.count_if(alert).alias("alerts_total")
        )
        before = join_null_safe(state.read("totals", TOTAL_SCHEMA, batch_id), resets, MODEL, "left_anti")
        named = resets.select("model", F.lit(0).cast("bigint").alias("observations_total"), F.lit(0).cast("bigint").alias("alerts_total"))
        totals = before.unionByName(counted).unionByName(named).groupBy("model").agg(
            F.sum("observations_total").alias("observations_total"), F.sum("alerts_total").alias("alerts_total")
        )
        totals = state.write("totals", totals, batch_id)

        now = scores.groupBy("model").agg(
            F.count("*").alias("recent_window"), F.avg(alert.cast("int")).alias("alert_rate"), F.avg("score").alias("recent_mean")
        )
        chances = stored(monitor.rank_probabilities(self.reference, labels, MODEL))
        figures = totals
        for part in (now, monitor.brier_scores(chances, MODEL)):
            figures = join_null_safe(figures, part, MODEL, "left")
        figures = figures.withColumns({"recent_window": F.coalesce("recent_window", F.lit(0)), "alert_rate": F.coalesce("alert_rate", F.lit(0.0))})
        figures.write.mode("overwrite").parquet(f"{self.base}/figures/batch={batch_id}")
        monitor.calibration_table(chances, MODEL).write.mode("overwrite").parquet(f"{self.base}/calibration/batch={batch_id}")

    def start(self, events: DataFrame, available_now: bool = False) -> StreamingQuery:
        return start_batches(events, self.base, self.handle, available_now)

    def latest(self, name: str) -> DataFrame:
        """The rows of `figures` or `calibration` after the last batch."""
        rows = self.spark.read.parquet(f"{self.base}/{name}")
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")


def attach_labels(scores: DataFrame, labels: DataFrame, delay_hours: int = 24) -> DataFrame:
    """Scores joined with the label that follows within the delay; works on streams and tables.

    On streams both sides are watermarked, so the state is bounded by the delay.
    """
    delay = f"{delay_hours} hours"
    left = scores.withWatermark("time", delay) if scores.isStreaming else scores
    right = labels.select(
        F.col("site_id").alias("_site"),
        F.col("machine_id").alias("_machine"),
        F.col("cycle_counter").alias("_cycle"),
        F.col("time").alias("label_time"),
        "label",
    )
    right = right.withWatermark("label_time", delay) if labels.isStreaming else right
    return left.join(
        right,
        (F.col("site_id") == F.col("_site"))
        & (F.col("machine_id") == F.col("_machine"))
        & (F.col("cycle_counter") == F.col("_cycle"))
        & (F.col("label_time") >= F.col("time"))
        & (F.col("label_time") <= F.col("time") + F.expr(f"INTERVAL {delay_hours} HOURS")),
    ).drop("_site", "_machine", "_cycle")
