"""Registered queries: score monitoring and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cyclelake.operators import monitor
from cyclelake.plans.registry import query
from cyclelake.plans.views import Views

KEYS = ["model"]


def _reference(v: Views) -> DataFrame:
    return v.scores.where("is_reference")


def _observed(v: Views) -> DataFrame:
    return v.scores.where(~F.col("is_reference"))


EDGES = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(11))
PSI_SQL = f"""
edges AS (SELECT model, list_sort(list_distinct([{EDGES}])) AS e FROM scores WHERE is_reference GROUP BY model),
binned AS (
  SELECT s.model, s.is_reference,
         len(list_filter(e.e[2:len(e.e) - 1], lambda x: x <= s.score)) AS bin, len(e.e) - 1 AS bins
  FROM scores s JOIN edges e USING (model)),
shares AS (
  SELECT b.model, g.bin,
         greatest(count(*) FILTER (WHERE is_reference AND b.bin = g.bin) / count(*) FILTER (WHERE is_reference), 1e-6) AS x,
         greatest(count(*) FILTER (WHERE NOT is_reference AND b.bin = g.bin) / count(*) FILTER (WHERE NOT is_reference), 1e-6) AS y
  FROM binned b, range(10) g(bin) WHERE g.bin < b.bins GROUP BY b.model, g.bin)"""


@query("a20_stability_index", f", {PSI_SQL} SELECT model, round(sum((y - x) * ln(y / x)), 6) AS psi FROM shares GROUP BY model")
def stability_index(v: Views) -> DataFrame:
    return monitor.stability_index(_reference(v), _observed(v), KEYS)


KS_SQL = """
steps AS (
  SELECT model, score, sum(count(*) FILTER (WHERE is_reference)) OVER w / sum(count(*) FILTER (WHERE is_reference)) OVER t AS fr,
         sum(count(*) FILTER (WHERE NOT is_reference)) OVER w / sum(count(*) FILTER (WHERE NOT is_reference)) OVER t AS fo
  FROM scores GROUP BY model, score
  WINDOW w AS (PARTITION BY model ORDER BY score), t AS (PARTITION BY model))"""


@query("a21_ks_statistic", f", {KS_SQL} SELECT model, round(max(abs(fr - fo)), 6) AS ks_statistic FROM steps GROUP BY model")
def ks_statistic(v: Views) -> DataFrame:
    return monitor.ks_test(_reference(v), _observed(v), KEYS).select("model", "ks_statistic")


@query(
    "a21_ks_global",
    """, steps AS (
         SELECT score, sum(count(*) FILTER (WHERE is_reference)) OVER w / sum(count(*) FILTER (WHERE is_reference)) OVER () AS fr,
                sum(count(*) FILTER (WHERE NOT is_reference)) OVER w / sum(count(*) FILTER (WHERE NOT is_reference)) OVER () AS fo
         FROM scores GROUP BY score WINDOW w AS (ORDER BY score))
       SELECT round(max(abs(fr - fo)), 6) AS ks_statistic FROM steps""",
)
def ks_global(v: Views) -> DataFrame:
    return monitor.ks_test(_reference(v), _observed(v), []).select("ks_statistic")


@query(
    "a22_alert_rate",
    """SELECT model, count(*) AS observations, count(*) FILTER (WHERE score >= threshold) AS alerts,
              round(avg(CAST(score >= threshold AS INTEGER)), 6) AS alert_rate FROM (
         SELECT *, row_number() OVER (PARTITION BY model ORDER BY time DESC, cycle_counter DESC) AS n FROM scores)
       WHERE n <= 1000 GROUP BY model""",
)
def alert_rate(v: Views) -> DataFrame:
    from cyclelake.operators.features import most_recent

    return monitor.alert_rates(most_recent(v.scores, KEYS, 1000), KEYS)


PROBABILITY_SQL = """
ref AS (SELECT model, score, count(*) AS n FROM scores WHERE is_reference GROUP BY 1, 2),
cdf AS (
  SELECT model, score, sum(n) OVER (PARTITION BY model ORDER BY score) / sum(n) OVER (PARTITION BY model) AS p FROM ref),
prob AS (
  SELECT f.model, f.label, coalesce(c.p, 0) AS p FROM (SELECT * FROM scores WHERE NOT is_reference) f
  ASOF LEFT JOIN cdf c ON c.model = f.model AND c.score <= f.score)"""


@query(
    "a23_brier_score",
    f", {PROBABILITY_SQL} SELECT model, round(avg((p - label) * (p - label)), 6) AS brier_score FROM prob GROUP BY model",
)
def brier_score(v: Views) -> DataFrame:
    return monitor.brier_scores(monitor.rank_probabilities(_reference(v), _observed(v), KEYS), KEYS)


@query(
    "a24_calibration",
    f""", {PROBABILITY_SQL},
       bins AS (SELECT DISTINCT model, CAST(b AS INTEGER) AS bin FROM prob, range(5) g(b))
       SELECT b.model, b.bin, b.bin / 5 AS lower, (b.bin + 1) / 5 AS upper, count(p.p) AS count,
              round(avg(p.p), 6) AS mean_predicted, round(avg(p.label), 6) AS observed_rate
       FROM bins b LEFT JOIN prob p ON p.model = b.model AND p.p >= b.bin / 5 AND (p.p < (b.bin + 1) / 5 OR (b.bin = 4 AND p.p = 1))
       GROUP BY b.model, b.bin""",
)
def calibration(v: Views) -> DataFrame:
    return monitor.calibration_table(monitor.rank_probabilities(_reference(v), _observed(v), KEYS), KEYS)


@query(
    "a25_machine_thresholds",
    """SELECT site_id, machine_id, round(quantile_cont(score, 0.98), 6) AS threshold FROM scores WHERE label = 0
       GROUP BY site_id, machine_id
       UNION ALL SELECT NULL, NULL, round(quantile_cont(score, 0.98), 6) FROM scores WHERE label = 0""",
)
def machine_thresholds(v: Views) -> DataFrame:
    normal = v.scores.where(F.col("label") == 0)
    return monitor.score_thresholds(normal, ["site_id", "machine_id"]).unionByName(
        monitor.score_thresholds(normal, []), allowMissingColumns=True
    )


METRIC_SQL = """
lv AS (
  SELECT model, score, sum(label) AS tp, count(*) - sum(label) AS fp,
         count(*) FILTER (WHERE score >= threshold) AS fl, count(*) FILTER (WHERE score >= threshold AND label = 1) AS h
  FROM scores GROUP BY model, score),
cum AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER t AS pos, sum(fp) OVER t AS neg,
         sum(fl) OVER t AS pp, sum(h) OVER t AS hits
  FROM lv WINDOW w AS (PARTITION BY model ORDER BY score DESC), t AS (PARTITION BY model)),
m AS (
  SELECT model, pos, neg, pp, hits, sum(CAST(tp AS DOUBLE) / pos * (CAST(ctp AS DOUBLE) / (ctp + cfp))) AS ap,
         sum(tp * (neg - cfp + CAST(fp AS DOUBLE) / 2)) / (CAST(pos AS DOUBLE) * neg) AS auc
  FROM cum GROUP BY model, pos, neg, pp, hits)"""


@query(
    "a26_classifier_metrics",
    f""", {METRIC_SQL}
       SELECT model, round(ap, 6) AS average_precision, round(pos / (pos + neg), 6) AS prevalence,
              round(ap / (pos / (pos + neg)), 6) AS lift, round(auc, 6) AS roc_auc, round(hits / pp, 6) AS precision,
              round(hits / pos, 6) AS recall, round(pp / (pos + neg), 6) AS alert_rate, CAST(pp AS BIGINT) AS positive_predictions
       FROM m""",
)
def classifier_metrics(v: Views) -> DataFrame:
    return monitor.classifier_metrics(
        v.scores.withColumn("predicted", F.col("score") >= F.col("threshold")), KEYS
    )


@query(
    "a27_score_histogram",
    f"""SELECT s.model, CAST(b.le AS DOUBLE) AS le, count(*) FILTER (WHERE s.score / 10 <= b.le) AS count
       FROM scores s, (SELECT unnest({monitor.HISTOGRAM_BUCKETS}) AS le) b GROUP BY s.model, b.le""",
)
def score_histogram(v: Views) -> DataFrame:
    return monitor.score_histogram(v.scores.withColumn("score", F.col("score") / 10), KEYS)


@query(
    "a28_export_summary",
    """SELECT count(*) AS cycles, count(*) FILTER (WHERE score >= threshold) AS alerts,
              round(avg(CAST(score >= threshold AS INTEGER)), 6) AS alert_rate, min(score) AS score_min,
              max(score) AS score_max, round(avg(score), 6) AS score_mean, min(threshold) AS threshold_min,
              max(threshold) AS threshold_max, count(DISTINCT machine_id) AS machines FROM scores""",
)
def export_summary(v: Views) -> DataFrame:
    return monitor.export_summary(v.scores)


@query(
    "a28_export_machines",
    "SELECT site_id, machine_id, count(*) AS cycles FROM scores GROUP BY site_id, machine_id",
)
def export_machines(v: Views) -> DataFrame:
    return monitor.export_machines(v.scores)


RECENT = 500  # fewer than a model has observed, so that the window matters
RECENT_SQL = f"{PSI_SQL}, {KS_SQL}, {PROBABILITY_SQL}".replace("scores", "latest")


@query(
    "a29_monitor_snapshot",
    f""", seen AS (
         SELECT *, row_number() OVER (PARTITION BY model, is_reference ORDER BY time DESC, cycle_counter DESC) AS age FROM scores),
       latest AS (SELECT * FROM seen WHERE is_reference OR age <= {RECENT}),
       {RECENT_SQL},
       gaps AS (
         SELECT model, max(abs(fr - fo)) AS d FROM steps GROUP BY model),
       sizes AS (
         SELECT model, count(*) FILTER (WHERE is_reference) AS m, count(*) FILTER (WHERE NOT is_reference) AS n FROM latest GROUP BY model),
       pvalues AS (
         SELECT model, CASE WHEN x < 0.1 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(
                  range(1, {monitor.KS_TERMS} + 1), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * x * x))))) END AS p
         FROM (SELECT model, d * sqrt(m * n / (m + n)) AS x FROM gaps JOIN sizes USING (model)))
       SELECT s.model, count(*) FILTER (WHERE is_reference) AS reference_size,
              count(*) FILTER (WHERE NOT is_reference) AS observations_total,
              count(*) FILTER (WHERE NOT is_reference AND score >= threshold) AS alerts_total,
              count(*) FILTER (WHERE NOT is_reference AND age <= {RECENT}) AS recent_window,
              round(avg(CAST(score >= threshold AS INTEGER)) FILTER (WHERE NOT is_reference AND age <= {RECENT}), 6) AS alert_rate,
              round((SELECT sum((y - x) * ln(y / x)) FROM shares h WHERE h.model = s.model), 6) AS psi,
              round((SELECT max(abs(fr - fo)) FROM steps k WHERE k.model = s.model), 6) AS ks_statistic,
              round((SELECT p FROM pvalues k WHERE k.model = s.model), 6) AS ks_pvalue,
              round((SELECT avg((p - label) * (p - label)) FROM prob b WHERE b.model = s.model), 6) AS brier_score
       FROM seen s GROUP BY s.model""",
)
def monitor_snapshot(v: Views) -> DataFrame:
    return monitor.snapshot(_reference(v), _observed(v), _observed(v), KEYS, window=RECENT)


@query(
    "l9_fallback_reference",
    """, t AS (SELECT quantile_cont(score, 0.98) AS threshold FROM scores WHERE label = 0),
       n AS (SELECT count(*) AS n FROM scores)
       SELECT CAST(i AS BIGINT) AS id, round(-ln(1 - (i + 0.5) / n) / (-ln(1 - 0.98) / t.threshold), 6) AS score
       FROM n, t, LATERAL (SELECT unnest(range(n.n)) AS i)""",
)
def fallback_reference(v: Views) -> DataFrame:
    normal = v.scores.where(F.col("label") == 0)
    # one value each: the threshold and the sample size
    threshold = monitor.score_thresholds(normal, []).first()["threshold"]
    return monitor.fallback_reference(v.spark, threshold, v.scores.count())


@query(
    "l4_prediction_output",
    """, t AS (SELECT machine_id, quantile_cont(score, 0.98) AS threshold FROM scores WHERE label = 0 AND machine_id % 3 <> 0
                GROUP BY machine_id),
       g AS (SELECT quantile_cont(score, 0.98) AS threshold FROM scores WHERE label = 0)
       SELECT s.cycle_counter, s.score AS anomaly_score,
              s.score >= coalesce(t.threshold, g.threshold) AS predicted_instability_next_20_cycles,
              round(coalesce(t.threshold, g.threshold), 6) AS threshold, 20 AS horizon_cycles,
              'process-drift-iforest-v1' AS model_version
       FROM scores s LEFT JOIN t ON t.machine_id = s.machine_id, g""",
)
def prediction_output(v: Views) -> DataFrame:
    from cyclelake.operators.models import prediction_output

    normal = v.scores.where(F.col("label") == 0)
    own = monitor.score_thresholds(normal.where(F.col("machine_id") % 3 != 0), ["site_id", "machine_id"])
    overall = monitor.score_thresholds(normal, [])
    return prediction_output(v.scores.drop("threshold"), own, overall).select(
        "cycle_counter",
        "anomaly_score",
        "predicted_instability_next_20_cycles",
        "threshold",
        "horizon_cycles",
        "model_version",
    )
