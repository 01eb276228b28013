"""Drift and monitoring queries with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import drift as d
from cohortry.plans.visits import table

EVENT_FEATURES = ["value", "user_id", "is_click"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def event_halves(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "is_click", (F.col("event_type") == "click").cast("int"))
    middle = F.lit("2024-01-16").cast("timestamp")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


def line_periods(spark, sf):
    lines = table(spark, sf, "lineitem")
    border = F.lit("1998-01-01").cast("timestamp")
    return lines.where(F.col("l_shipdate") < border), lines.where(F.col("l_shipdate") >= border)


def event_records(spark, sf):
    """Events seen as logged predictions; some values are not finite."""
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").select(
        F.col("ts").alias("timestamp_utc"),
        (value >= 50.0).cast("int").alias("binary_prediction"),
        F.when(kind == "error", F.lit(float("nan"))).otherwise(value / F.lit(1000.0))
         .alias("binary_probability"),
        F.when(kind == "click", F.lit("<30")).when(kind == "view", F.lit("NO"))
         .when(kind == "error", F.lit(None)).otherwise(F.lit(">30")).alias("multiclass_prediction"),
        F.when(kind == "click", F.lit("NO")).alias("true_label"),
        F.when(kind == "view", F.lit(1)).alias("true_label_30d"),
        F.map_from_arrays(
            F.array(F.lit("binary_model"), F.lit("multiclass_model")),
            F.array(F.struct(F.when(kind == "click", F.lit("cpu")).alias("device"),
                             F.lit(False).alias("used_fallback")),
                    F.struct(F.lit(None).cast("string").alias("device"),
                             F.lit(None).cast("boolean").alias("used_fallback"))))
         .alias("inference_runtime"),
        "value", "user_id")


def model_versions(spark):
    return spark.createDataFrame(
        [("binary_model", "auto", "cuda", "cpu", None), ("multiclass_model", "cuda", "cpu", "cpu", None)],
        "model string, device_requested string, training_device string, "
        "inference_device string, fallback_path boolean")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def psi_events(spark, sf):
    return _rounded(d.psi(*event_halves(spark, sf), EVENT_FEATURES), "psi")


def psi_five_bins(spark, sf):
    return _rounded(d.psi(*line_periods(spark, sf), LINE_FEATURES, bins=5), "psi")


def drift_by_feature(spark, sf):
    found = d.drift_summary(*line_periods(spark, sf), LINE_FEATURES)
    return _rounded(found, "psi", "reference_mean", "current_mean", "absolute_mean_shift")


def drift_small_sample(spark, sf):
    """A minimum no table reaches: counts only."""
    return d.drift_summary(*event_halves(spark, sf), EVENT_FEATURES, min_sample_size=10**15)


def feature_bins(spark, sf):
    counts = d.feature_bins(*line_periods(spark, sf), LINE_FEATURES)
    return counts.where("bin IS NOT NULL").select("feature", "bin", "reference_n", "current_n")


def probability_summary(spark, sf):
    return _rounded(d.probability_summary(event_records(spark, sf)),
                    "mean", "std", "min", "max", "p10", "p50", "p90")


def probability_drift(spark, sf):
    records = event_records(spark, sf)
    middle = F.lit("2024-01-16").cast("timestamp")
    return _rounded(d.probability_drift(records.where(F.col("timestamp_utc") < middle),
                                        records.where(F.col("timestamp_utc") >= middle)), "psi")


def prediction_distribution(spark, sf):
    return _rounded(d.prediction_distribution(event_records(spark, sf)), "rate")


def label_availability(spark, sf):
    return d.label_availability(event_records(spark, sf))


def inference_runtime(spark, sf):
    return d.inference_runtime(event_records(spark, sf), model_versions(spark))


def monitoring_summary(spark, sf):
    before, after = event_halves(spark, sf)
    records = event_records(spark, sf)
    found = d.monitoring_summary(records, before, after, model_versions(spark),
                                 ["value", "user_id", "not_there"], records)
    return _rounded(found, "value")


QUERIES = {f.__name__: f for f in (
    psi_events, psi_five_bins, drift_by_feature, drift_small_sample, feature_bins,
    probability_summary, probability_drift, prediction_distribution, label_availability,
    inference_runtime, monitoring_summary)}

_EVENTS = """ev AS (SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click FROM events),
old AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-16'),
new AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-16')"""
_LINES = """old AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
new AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""
_RECORDS = """rec AS (SELECT ts, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS binary_prediction,
CASE WHEN event_type <> 'error' THEN value / 1000.0 END AS binary_probability,
CASE event_type WHEN 'click' THEN '<30' WHEN 'view' THEN 'NO' WHEN 'error' THEN NULL
ELSE '>30' END AS multiclass_prediction,
CASE WHEN event_type = 'click' THEN 'NO' END AS true_label,
CASE WHEN event_type = 'view' THEN 1 END AS true_label_30d FROM events)"""


def _bins_sql(base: str, features: list[str], bins: int, old: str = "old", new: str = "new") -> str:
    """CTEs up to ``counted`` (feature, bin, reference_n, current_n, n_edges)."""
    shares = ", ".join(f"{j * (1.0 / bins) if j < bins else 1.0!r}::DOUBLE" for j in range(bins + 1))
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {side} AS cur, {f}::DOUBLE AS x FROM {name} WHERE {f} IS NOT NULL"
        for f in features for name, side in ((old, "false"), (new, "true")))
    return f"""WITH {base}, cells AS ({cells}),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{shares}]))) AS e
          FROM cells WHERE NOT cur GROUP BY 1),
binned AS (SELECT feature, cur, x, len(list_filter(e[2:len(e) - 1], lambda c: x >= c)) AS bin
           FROM cells JOIN edges USING (feature)),
grid AS (SELECT feature, len(e) AS n_edges,
         unnest(range(greatest(len(e) - 1, 1))) AS bin FROM edges),
counted AS (SELECT g.feature, g.bin, g.n_edges, count(b.x) FILTER (WHERE NOT cur) AS reference_n,
  count(b.x) FILTER (WHERE cur) AS current_n FROM grid g LEFT JOIN binned b
  ON g.feature = b.feature AND g.bin = b.bin GROUP BY ALL),
shares AS (SELECT feature, n_edges,
  greatest(reference_n / sum(reference_n) OVER (PARTITION BY feature), 1e-6) AS r,
  greatest(current_n / sum(current_n) OVER (PARTITION BY feature), 1e-6) AS c FROM counted),
psis AS (SELECT feature, sum(CASE WHEN n_edges > 1 THEN (c - r) * ln(c / r) ELSE 0 END) AS psi
         FROM shares GROUP BY 1),
sizes AS (SELECT feature, count(*) FILTER (WHERE NOT cur) AS reference_count,
  count(*) FILTER (WHERE cur) AS current_count, avg(x) FILTER (WHERE NOT cur) AS reference_mean,
  avg(x) FILTER (WHERE cur) AS current_mean FROM cells GROUP BY 1)"""


_BAND = ("CASE WHEN psi IS NULL THEN 'unavailable' WHEN psi < 0.1 THEN 'stable' "
         "WHEN psi < 0.2 THEN 'moderate' ELSE 'high' END")
_SUMMARY_COLUMNS = """count(p) AS count, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std,
round(min(p), 6) AS min, round(max(p), 6) AS max, round(quantile_cont(p, 0.1), 6) AS p10,
round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.9), 6) AS p90"""
_DISTRIBUTION = """dist AS (SELECT model_output, label, count(*) AS n,
round(count(*) / (SELECT count(*) FROM rec), 6) AS rate FROM (
SELECT 'binary_prediction' AS model_output, coalesce(CAST(binary_prediction AS VARCHAR), 'unknown')
  AS label FROM rec UNION ALL
SELECT 'multiclass_prediction', coalesce(multiclass_prediction, 'unknown') FROM rec) GROUP BY ALL)"""


def _monitoring_sql() -> str:
    def unpivoted(section: str, subject: str, source: str, names: list[str], text=()) -> str:
        numbers = [f"SELECT '{section}' AS section, {subject} AS subject, '{n}' AS metric, "
                   f"round({n}::DOUBLE, 6) AS value, CAST(NULL AS VARCHAR) AS text FROM {source}"
                   for n in names]
        texts = [f"SELECT '{section}', {subject}, '{n}', CAST(NULL AS DOUBLE), CAST({n} AS VARCHAR) "
                 f"FROM {source}" for n in text]
        return " UNION ALL ".join(numbers + texts)

    stats = ["count", "mean", "std", "min", "max", "p10", "p50", "p90"]
    runtime = {"binary_model": ("auto", "cuda", "cpu", "false"),
               "multiclass_model": ("cuda", "cpu", "cpu", "false")}
    fixed = [("inference_runtime", m, k, v) for m, row in runtime.items() for k, v in zip(
        ("device_requested", "training_device", "inference_device", "used_fallback"), row)]
    fixed += [
        ("warning", "not_there", "missing_feature", "missing from reference or current table"),
        ("warning", "multiclass_model", "device_not_used", "training used cpu"),
        ("label_monitoring", "*", "labels_available", "true"),
        ("label_monitoring", "*", "performance_monitoring",
         "labels_present_but_not_scored_in_this_report"),
        ("binary_probability_drift", "*", "status", "stable")]
    base = f"{_EVENTS}, {_RECORDS}, {_DISTRIBUTION}"
    return f"""{_bins_sql(base, ['value', 'user_id'], 10)},
probs AS (SELECT binary_probability AS p FROM rec WHERE binary_probability IS NOT NULL),
stats AS (SELECT {_SUMMARY_COLUMNS} FROM probs),
shifts AS (SELECT *, abs(current_mean - reference_mean) AS absolute_mean_shift, {_BAND} AS status
           FROM sizes JOIN psis USING (feature)),
row_counts AS (SELECT 'prediction_records' AS what, count(*) AS n FROM rec
  UNION ALL SELECT 'reference_rows', count(*) FROM old
  UNION ALL SELECT 'current_feature_rows', count(*) FROM new),
same AS (SELECT 0.0::DOUBLE AS psi, count(p) AS reference_count, count(p) AS current_count FROM probs),
given AS (SELECT count(true_label) AS true_label_count,
          count(true_label_30d) AS true_label_30d_count FROM rec)
{unpivoted('binary_probability_summary', "'*'", 'stats', stats)}
UNION ALL {unpivoted('prediction_distribution', "model_output || ':' || label", 'dist', ['n', 'rate'])}
UNION ALL {unpivoted('binary_probability_drift', "'*'", 'same', ['psi', 'reference_count',
                                                              'current_count'])}
UNION ALL {unpivoted('sample_sizes', 'what', 'row_counts', ['n'])}
UNION ALL {unpivoted('feature_drift', 'feature', 'shifts', ['psi', 'reference_count',
  'current_count', 'reference_mean', 'current_mean', 'absolute_mean_shift'], ['status'])}
UNION ALL {unpivoted('label_monitoring', "'*'", 'given', ['true_label_count',
                                                        'true_label_30d_count'])}
UNION ALL SELECT section, subject, metric, CAST(NULL AS DOUBLE), text FROM (VALUES
{', '.join(str(f) for f in fixed)}) t(section, subject, metric, text)"""


ORACLES = {
    "psi_events": f"{_bins_sql(_EVENTS, EVENT_FEATURES, 10)} "
                  "SELECT feature, round(psi, 6) AS psi FROM psis",
    "psi_five_bins": f"{_bins_sql(_LINES, LINE_FEATURES, 5)} "
                     "SELECT feature, round(psi, 6) AS psi FROM psis",
    "drift_by_feature": f"""{_bins_sql(_LINES, LINE_FEATURES, 10)}
SELECT feature, {_BAND} AS status, round(psi, 6) AS psi, reference_count, current_count,
round(reference_mean, 6) AS reference_mean, round(current_mean, 6) AS current_mean,
round(abs(current_mean - reference_mean), 6) AS absolute_mean_shift
FROM psis JOIN sizes USING (feature)""",
    "drift_small_sample": f"""{_bins_sql(_EVENTS, EVENT_FEATURES, 10)}
SELECT feature, 'insufficient_data' AS status, CAST(NULL AS DOUBLE) AS psi, reference_count,
current_count, CAST(NULL AS DOUBLE) AS reference_mean, CAST(NULL AS DOUBLE) AS current_mean,
CAST(NULL AS DOUBLE) AS absolute_mean_shift FROM sizes""",
    "feature_bins": f"""{_bins_sql(_LINES, LINE_FEATURES, 10)}
SELECT feature, CAST(bin AS INTEGER) AS bin, reference_n, current_n FROM counted""",
    "probability_summary": f"""WITH {_RECORDS} SELECT {_SUMMARY_COLUMNS} FROM (SELECT
binary_probability AS p FROM rec) WHERE p IS NOT NULL""",
    "probability_drift": f"""{_bins_sql(
        _RECORDS + ", old AS (SELECT * FROM rec WHERE ts < TIMESTAMP '2024-01-16'), "
        "new AS (SELECT * FROM rec WHERE ts >= TIMESTAMP '2024-01-16')",
        ['binary_probability'], 10)}
SELECT {_BAND} AS status, round(psi, 6) AS psi, reference_count, current_count
FROM psis JOIN sizes USING (feature)""",
    "prediction_distribution": f"WITH {_RECORDS}, {_DISTRIBUTION} SELECT * FROM dist",
    "label_availability": f"""WITH {_RECORDS} SELECT count(*) AS n_records,
count(true_label) AS true_label_count, count(true_label_30d) AS true_label_30d_count,
count(true_label) + count(true_label_30d) > 0 AS labels_available,
CASE WHEN count(true_label) + count(true_label_30d) > 0
THEN 'labels_present_but_not_scored_in_this_report' ELSE 'unavailable' END
AS performance_monitoring FROM rec""",
    "inference_runtime": """WITH click AS (SELECT count(*) > 0 AS there FROM events
WHERE event_type = 'click')
SELECT 'binary_model' AS model, 'auto' AS device_requested, 'cuda' AS training_device,
'cpu' AS inference_device, NOT there AS used_fallback, CASE WHEN there THEN 'cpu' END AS record_device,
CASE WHEN there THEN false END AS record_fallback, 'cpu' AS metadata_device,
true AS metadata_fallback FROM click
UNION ALL SELECT 'multiclass_model', 'cuda', 'cpu', 'cpu', false, NULL, NULL, 'cpu', false""",
    "monitoring_summary": _monitoring_sql(),
}
