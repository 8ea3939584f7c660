"""Score monitoring and classifier metrics.

Score distributions are first reduced to counts per distinct score; ordered sums over those
use the skew-safe running sums, so nothing is sorted in a single task at scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.functions.values import finite
from cyclelake.operators.ordered import (
    Budget,
    DEFAULT_BUDGET,
    exact_quantiles,
    join_null_safe,
    running_sums,
)
from cyclelake.schema import NORMAL_SCORE_QUANTILE

# --- fixed values ---------------------------------------------------------------------
SCORE_BINS = 10
CALIBRATION_BINS = 5
EPSILON = 1e-6
RECENT_WINDOW = 10_000
HISTOGRAM_BUCKETS = [0.0, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 1.0, 1.5, 2.0, 5.0, 10.0]
# --------------------------------------------------------------------------------------
KS_TERMS = 100


def _clean(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    return scores.select(*keys, finite(F.col(score)).alias("score")).where(F.col("score").isNotNull())


def stability_index(
    reference: DataFrame,
    observed: DataFrame,
    keys: list[str],
    score: str = "score",
    bins: int = SCORE_BINS,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Population stability index of observed against reference scores per group.

    Bins are the reference's quantiles (equal edges collapse); observed scores are clipped to
    the reference's range. 0 where a side is empty or the reference has a single value.
    """
    ref, obs = _clean(reference, keys, score), _clean(observed, keys, score)
    names = {f"_q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(ref, keys, "score", names, budget).select(
        *keys, F.array_distinct(F.array(*names)).alias("edges")
    )
    both = ref.withColumn("ref", F.lit(1)).unionByName(obs.withColumn("ref", F.lit(0)))
    placed = join_null_safe(both, edges, keys) if keys else both.crossJoin(edges)  # one row of edges
    last = F.size("edges") - 1
    # the last bin includes its upper edge; lower and higher scores belong to the end bins
    inner = F.slice("edges", 2, F.greatest(last - 1, F.lit(0)))
    bin_no = F.size(F.filter(inner, lambda e: e <= F.col("score")))
    counts = placed.groupBy(*keys, "edges", bin_no.alias("bin")).agg(
        F.sum("ref").alias("n_ref"), F.sum(1 - F.col("ref")).alias("n_obs")
    )
    wide = counts.groupBy(*keys, "edges").agg(
        F.sum("n_ref").alias("total_ref"),
        F.sum("n_obs").alias("total_obs"),
        # at most `bins` entries
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n_ref", "n_obs")))).alias("by_bin"),
    )
    share = lambda n, total: F.greatest(n / total, F.lit(EPSILON))

    def term(b: Column) -> Column:
        entry = F.try_element_at(F.col("by_bin"), b)
        expected = share(F.coalesce(entry["n_ref"], F.lit(0)), F.col("total_ref"))
        actual = share(F.coalesce(entry["n_obs"], F.lit(0)), F.col("total_obs"))
        return (actual - expected) * F.log(actual / expected)

    total = F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0.0), lambda acc, b: acc + term(b))
    return wide.select(
        *keys,
        F.when((F.size("edges") < 2) | (F.col("total_obs") == 0), F.lit(0.0)).otherwise(total).alias("psi"),
    )


def ks_test(
    reference: DataFrame,
    observed: DataFrame,
    keys: list[str],
    score: str = "score",
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per group."""
    both = (
        _clean(reference, keys, score)
        .withColumn("ref", F.lit(1))
        .unionByName(_clean(observed, keys, score).withColumn("ref", F.lit(0)))
    )
    counts = both.groupBy(*keys, "score").agg(
        F.sum("ref").cast("bigint").alias("n_ref"), F.sum(1 - F.col("ref")).cast("bigint").alias("n_obs")
    )
    totals = counts.groupBy(*keys).agg(F.sum("n_ref").alias("t_ref"), F.sum("n_obs").alias("t_obs"))
    summed = running_sums(
        counts, keys, ["score"], {"c_ref": F.col("n_ref"), "c_obs": F.col("n_obs")}, budget
    )
    placed = join_null_safe(summed, totals, keys) if keys else summed.crossJoin(totals)
    gap = F.abs(F.col("c_ref") / F.nullif("t_ref", F.lit(0)) - F.col("c_obs") / F.nullif("t_obs", F.lit(0)))
    result = placed.groupBy(*keys).agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("ks_statistic"),
        F.first("t_ref").alias("n_ref"),
        F.first("t_obs").alias("n_obs"),
    )
    size = F.sqrt(F.col("n_ref") * F.col("n_obs") / (F.col("n_ref") + F.col("n_obs")))
    x = F.col("ks_statistic") * size
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * x * x),
    )
    p = F.when((F.col("n_obs") == 0) | (F.col("n_ref") == 0) | (x < 0.1), F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * terms))
    )
    return result.withColumn("ks_pvalue", p)


def alert_rates(recent: DataFrame, keys: list[str]) -> DataFrame:
    """Scores, alerts and alert rate; a score without a threshold raises no alert."""
    alert = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    return (
        recent.where(finite(F.col("score")).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("observations"),
            F.count_if(alert).alias("alerts"),
            F.avg(alert.cast("int")).alias("alert_rate"),
        )
    )


def rank_probabilities(
    reference: DataFrame, feedback: DataFrame, keys: list[str], budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Feedback counts per (group, score, label) with p = share of reference scores at or below.

    Works on distinct scores; `n` tells how many feedback rows a result row stands for.
    """
    ref = _clean(reference, keys, "score").groupBy(*keys, "score").agg(F.count("*").alias("n_ref"))
    pairs = (
        feedback.where(finite(F.col("score")).isNotNull() & F.col("label").isin(0, 1))
        .groupBy(*keys, "score", "label")
        .agg(F.count("*").alias("n"))
    )
    totals = ref.groupBy(*keys).agg(F.sum("n_ref").alias("t_ref"))
    # reference counts of a score stand before the feedback on it
    both = ref.select(*keys, "score", F.lit(0).alias("kind"), "n_ref").unionByName(
        pairs.select(*keys, "score", F.lit(1).alias("kind"), "label", "n", F.lit(0).cast("bigint").alias("n_ref")),
        allowMissingColumns=True,
    )
    summed = running_sums(both, keys, ["score", "kind", "label"], {"below": F.col("n_ref")}, budget)
    placed = summed.where(F.col("kind") == 1)
    placed = join_null_safe(placed, totals, keys) if keys else placed.crossJoin(totals)
    return placed.select(*keys, "score", "label", "n", (F.col("below") / F.col("t_ref")).alias("p"))


def brier_scores(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    miss = F.pow(F.col("p") - F.col("label"), F.lit(2.0)) * F.col("n")
    return probabilities.groupBy(*keys).agg((F.sum(miss) / F.sum("n")).alias("brier_score"))


def calibration_table(
    probabilities: DataFrame, keys: list[str], bins: int = CALIBRATION_BINS
) -> DataFrame:
    """Equal-width bins of p against observed rates; the last bin includes 1, empty bins stay."""
    # compare with i / bins as written, so an edge value falls where the comparison says
    bin_no = sum(((F.col("p") >= i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    filled = probabilities.groupBy(*keys, bin_no.alias("bin")).agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("observed_rate"),
    )
    every = F.explode(F.array(*[F.lit(i) for i in range(bins)]))
    grid = probabilities.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, every.alias("bin"))
    return join_null_safe(grid, filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / bins).alias("lower"),
        ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        "mean_predicted",
        "observed_rate",
    )


def score_thresholds(
    scored: DataFrame, keys: list[str], quantile: float = NORMAL_SCORE_QUANTILE, budget: Budget = DEFAULT_BUDGET
) -> DataFrame:
    """Alert threshold: the 98 % quantile of normal scores, per group or global."""
    return exact_quantiles(scored, keys, "score", {"threshold": quantile}, budget)


def classifier_metrics(scored: DataFrame, keys: list[str], budget: Budget = DEFAULT_BUDGET) -> DataFrame:
    """Average precision (step form), ROC-AUC, precision, recall, prevalence, lift, alert rate.

    Needs score, label (0/1) and predicted (boolean). Equal scores count as one step.
    """
    steps = scored.groupBy(*keys, (-F.col("score")).alias("down")).agg(
        F.sum("label").cast("bigint").alias("tp"),
        F.sum(1 - F.col("label")).cast("bigint").alias("fp"),
        F.count_if("predicted").alias("flagged"),
        F.count_if(F.col("predicted") & (F.col("label") == 1)).alias("hits"),
    )
    totals = steps.groupBy(*keys).agg(
        F.sum("tp").alias("pos"),
        F.sum("fp").alias("neg"),
        F.sum("flagged").alias("positive_predictions"),
        F.sum("hits").alias("hits"),
    )
    summed = running_sums(steps.drop("flagged", "hits"), keys, ["down"], {"ctp": F.col("tp"), "cfp": F.col("fp")}, budget)
    placed = join_null_safe(summed, totals, keys) if keys else summed.crossJoin(totals)
    precision = F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    # pairs ranked right: negatives below each positive, ties counting half
    below = F.col("neg") - F.col("cfp") + F.col("fp") / 2
    rows = F.col("pos") + F.col("neg")
    return (
        placed.groupBy(*keys, "pos", "neg", "positive_predictions", "hits")
        .agg(
            F.sum(F.col("tp") / F.col("pos") * precision).alias("average_precision"),
            (F.sum(F.col("tp") * below) / F.nullif(F.first(F.col("pos") * F.col("neg")), F.lit(0))).alias("roc_auc"),
        )
        .withColumn("prevalence", F.col("pos") / rows)
        .select(
            *keys,
            F.when(F.col("pos") > 0, F.col("average_precision")).alias("average_precision"),
            "prevalence",
            F.when(F.col("pos") > 0, F.col("average_precision") / F.col("prevalence")).otherwise(0.0).alias("lift"),
            "roc_auc",
            F.coalesce(F.col("hits") / F.nullif("positive_predictions", F.lit(0)), F.lit(0.0)).alias("precision"),
            F.coalesce(F.col("hits") / F.nullif("pos", F.lit(0)), F.lit(0.0)).alias("recall"),
            (F.col("positive_predictions") / rows).alias("alert_rate"),
            "positive_predictions",
        )
    )


def score_histogram(scores: DataFrame, keys: list[str], buckets: list[float] = HISTOGRAM_BUCKETS) -> DataFrame:
    """Cumulative histogram: scores at or below each bucket bound."""
    counts = scores.groupBy(*keys).agg(*[F.count_if(F.col("score") <= le).alias(str(i)) for i, le in enumerate(buckets)])
    bounds = F.array(*[F.struct(F.lit(le).alias("le"), F.col(str(i)).alias("count")) for i, le in enumerate(buckets)])
    return counts.select(*keys, F.inline(bounds))


def export_summary(scored: DataFrame) -> DataFrame:
    """Summary of a scored export (its machines are listed by `export_machines`)."""
    return scored.agg(
        F.count("*").alias("cycles"),
        F.count_if(F.col("score") >= F.col("threshold")).alias("alerts"),
        F.avg((F.col("score") >= F.col("threshold")).cast("int")).alias("alert_rate"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.avg("score").alias("score_mean"),
        F.min("threshold").alias("threshold_min"),
        F.max("threshold").alias("threshold_max"),
        F.count_distinct("machine_id").alias("machines"),
    )


def export_machines(scored: DataFrame) -> DataFrame:
    """One row per machine of a scored export, with its cycles."""
    return scored.groupBy("site_id", "machine_id").agg(F.count("*").alias("cycles"))


def snapshot(
    reference: DataFrame,
    scores: DataFrame,
    feedback: DataFrame,
    keys: list[str],
    window: int = RECENT_WINDOW,
    budget: Budget = DEFAULT_BUDGET,
) -> DataFrame:
    """Monitoring figures of each model in one row: recent window, totals, shift, calibration."""
    from cyclelake.operators.features import most_recent

    recent = most_recent(scores.where(finite(F.col("score")).isNotNull()), keys, window)
    latest_feedback = most_recent(feedback, keys, window)
    lifetime = alert_rates(scores, keys).select(
        *keys, F.col("observations").alias("observations_total"), F.col("alerts").alias("alerts_total")
    )
    now = alert_rates(recent, keys).select(*keys, F.col("observations").alias("recent_window"), "alert_rate")
    size = _clean(reference, keys, "score").groupBy(*keys).agg(F.count("*").alias("reference_size"))
    result = size
    parts = [
        lifetime,
        now,
        stability_index(reference, recent, keys, budget=budget),
        ks_test(reference, recent, keys, budget=budget).select(*keys, "ks_statistic", "ks_pvalue"),
        brier_scores(rank_probabilities(reference, latest_feedback, keys, budget), keys),
    ]
    for part in parts:
        result = join_null_safe(result, part, keys, "left")
    return result


def fallback_reference(spark, threshold: float, n: int = 5000) -> DataFrame:
    """Exponential reference with 2 % of its mass from the threshold on, as an even quantile grid."""
    import math

    usable = threshold if math.isfinite(threshold) and threshold > 0 else 1.0
    rate = -math.log(1.0 - NORMAL_SCORE_QUANTILE) / usable
    u = (F.col("id") + 0.5) / F.lit(float(n))
    return spark.range(n).select("id", (-F.log1p(-u) / F.lit(rate)).alias("score"))
