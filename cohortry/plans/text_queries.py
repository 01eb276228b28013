"""Explanation, log, payload and run-table queries with their SQL texts."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions import scoring as sx
from cohortry.functions import text as tx
from cohortry.operators import explain, runs
from cohortry.operators import metrics as m
from cohortry.operators.split import split_by_entity
from cohortry.plans.metric_queries import CLASSES_SQL, line_classes
from cohortry.plans.split_queries import engineered
from cohortry.plans.visits import FEATURES_SQL, INTAKE_SQL, intake, split_sql, table
from cohortry.sources import predictions as pr
from cohortry.sources import raw, store
from cohortry.sources.scratch import scratch_path, settle

# ------------------------------------------------------------------ explanations


def scored_visits(spark, sf):
    """Feature rows with stand-in scores that are plain functions of the row."""
    rows = engineered(spark, sf)
    share = F.pmod(F.col("charge"), F.lit(1000.0)) / F.lit(1000.0)
    return rows.withColumns({
        "binary_probability": share, "binary_prediction": (share >= 0.5).cast("int"),
        "multiclass_prediction": F.trim("readmitted"),
        "multiclass_probabilities": F.map_from_arrays(
            F.array(*[F.lit(x) for x in presets.CLASS_LABELS]),
            F.array((F.lit(1.0) - share) / 2, (F.lit(1.0) - share) / 2, share))})


def explained_rows(spark, sf):
    return explain.explain_rows(scored_visits(spark, sf), top_n=2).select(
        "encounter_id", "prediction_summary", "explanation_text", "explanation_mode", "risk_band",
        F.array_join("raising_factors", "|").alias("raising_factors"),
        F.array_join("lowering_factors", "|").alias("lowering_factors"))


def ranked_probabilities(spark, sf):
    rows = scored_visits(spark, sf)
    return rows.select("encounter_id", F.posexplode(
        tx.ranked_entries(F.col("multiclass_probabilities"))).alias("place", "e")).select(
        "encounter_id", "place", F.col("e.key").alias("label"), F.round("e.value", 6).alias("share"))


_NAMES = ["l_quantity", "l_discount", "l_tax"]
_COEFFICIENTS = [0.02, -3.0, 2.5]
_MEANS = [25.0, 0.05, 0.04]


def line_contributions(spark, sf):
    lines = table(spark, sf, "lineitem")
    vectors = VectorAssembler(inputCols=_NAMES, outputCol="features").transform(lines)
    return explain.linear_contributions(vectors, _COEFFICIENTS, _MEANS, _NAMES)


def mean_abs_contributions(spark, sf):
    found = explain.mean_abs_contributions(line_contributions(spark, sf))
    return found.withColumn("mean_abs_contribution", F.round("mean_abs_contribution", 9))


def contribution_factors(spark, sf):
    rows = line_contributions(spark, sf)
    top = explain.top_contributions(F.col("contributions"), 2)
    up, down = tx.contribution_factors(top, 2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.array_join(up, "|").alias("raising"),
                       F.array_join(down, "|").alias("lowering"))


def formatted_values(spark, sf):
    """Percent and metric texts, bands and readable names."""
    value = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", tx.percent_or_zero(value / F.lit(800.0)).alias("percent"),
        tx.metric_text(F.when(F.col("event_type") != "error", value / F.lit(128.0)), 4)
         .alias("metric"),
        tx.psi_band(F.when(F.col("event_type") != "error", value / F.lit(1000.0))).alias("band"),
        tx.risk_band(value / F.lit(100.0)).alias("risk"),
        tx.readable_name(F.concat(F.lit("max_"), "event_type", F.lit("-value"))).alias("name"))


def numeric_map_entries(spark, sf):
    """Entries of a text map that are numbers, as rows."""
    events = table(spark, sf, "events")
    mapped = F.create_map(F.lit("value"), F.col("value").cast("string"),
                          F.lit("kind"), F.col("event_type"))
    return events.select("event_id", F.explode(sx.numeric_entries(mapped)).alias("name", "number"))


# ----------------------------------------------------------------- logs, payloads


def _records(spark, sf):
    scored = scored_visits(spark, sf).withColumn("binary_raw", F.col("binary_prediction"))
    return pr.prediction_records(
        scored, selected_inputs=("recurrency", "patient_severity", "charge", "gender", "absent"),
        true_label="readmitted",
        versions={"binary_model": {"model_family": "logistic_regression", "feature_count": 6}})


_LOG_INPUTS = {"recurrency": "double", "patient_severity": "double", "charge": "double",
               "gender": "string"}


def prediction_log(spark, sf):
    """Records written, appended once more, and read back."""
    path = scratch_path(spark, "log")
    # Written twice, so made once: both writes must hold the same records.
    records = settle(_records(spark, sf))
    pr.write_log(records, path)
    pr.write_log(records, path, append=True)
    back = pr.read_log(spark, path, pr.log_schema(_LOG_INPUTS))
    return (back.groupBy("multiclass_prediction", "binary_prediction", "true_label",
                         F.col("model_version.binary_model.model_family").alias("family"))
            .agg(F.count(F.lit(1)).alias("n"), F.count("timestamp_utc").alias("n_stamped"),
                 F.round(F.sum("binary_probability"), 4).alias("probability_sum"),
                 F.round(F.sum(F.col("multiclass_probabilities")["<30"]), 4).alias("class_sum")))


def logged_inputs(spark, sf):
    path = scratch_path(spark, "log")
    pr.write_log(_records(spark, sf), path)
    back = pr.selected_inputs(pr.read_log(spark, path, pr.log_schema(_LOG_INPUTS)))
    return back.select(F.col("recurrency").cast("int").alias("recurrency"),
                       F.round("patient_severity", 5).alias("patient_severity"), "charge", "gender")


def payload_rows(spark, sf):
    """Single and batch request payloads made of the event properties."""
    events = table(spark, sf, "events")
    single = F.concat(F.lit('{"features": '), "props", F.lit("}"))
    batch = F.concat(F.lit('{"rows": ['), "props", F.lit(', {"k": -1}]}'))
    payload = (F.when(F.col("event_type") == "click", batch)
               .when(F.col("event_type") == "error", F.lit("{}")).otherwise(single))
    return pr.payload_rows(events.select("event_id", payload.alias("payload")), "payload",
                           {"k": "bigint"}).select("event_id", "k")


def typed_inputs(spark, sf):
    rows = intake(spark, sf).select(
        "encounter_id", "discharge_disposition_id",
        F.when(F.col("gender") == "Male", F.lit(" (missing) ")).otherwise(F.col("race")).alias("race"),
        F.col("charge").cast("string").alias("patient_severity"))
    return pr.typed_inputs(rows)


def csv_scan(spark, sf):
    """Visits written as CSV and scanned again with declared types."""
    path = scratch_path(spark, "csv")
    rows = intake(spark, sf)
    raw.write_csv(rows.withColumn("race", F.when(F.col("race") != "", F.col("race"))
                                  .otherwise(F.lit("None"))), path)
    return raw.read_csv(spark, path, rows.schema)


def split_store(spark, sf):
    """Split tables written once, one split read back."""
    path = scratch_path(spark, "splits")
    raw.write_splits(split_by_entity(intake(spark, sf), seed=42), path)
    return raw.read_split(spark, path, "val").select("encounter_id", "patient_nbr", "split", "charge")


def bounded_scan(spark, sf):
    return raw.read_bounded(spark, f"{sf}/lineitem.parquet", "l_extendedprice", 100).select(
        F.round("l_extendedprice", 2).alias("l_extendedprice"))


def json_document(spark, sf):
    """Result rows written as JSON and read back."""
    path = scratch_path(spark, "rows")
    store.write_rows(table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")), path)
    return store.read_rows(spark, path, "o_orderstatus string, n long")


# ------------------------------------------------------------------- run tables


def event_runs(spark, sf):
    """Event groups seen as training runs: type as family, source as sampling."""
    half = F.when(F.col("user_id") < 50, F.lit("none")).when(F.col("user_id") < 100, F.lit("over")) \
        .otherwise(F.lit("under"))
    groups = table(spark, sf, "events").groupBy("event_type", half.alias("sampling")).agg(
        F.round(F.avg("value"), 4).alias("a"), F.round(F.max("value"), 4).alias("b"),
        F.round(F.avg(F.col("user_id")), 4).alias("c"))
    pair = lambda x, y: F.create_map(F.lit("f1"), x, F.lit("roc_auc"), y, F.lit("per_class.<30.f1"),
                                     y, F.lit("per_class.>30#f1"), x)
    return groups.select(
        F.ascii("event_type").alias("run_order"),
        F.concat_ws("-", "event_type", "sampling").alias("run_name"), F.lit("binary").alias("task"),
        F.col("event_type").alias("family"), "sampling", F.lit("none").alias("selection"),
        pair(F.col("a"), F.col("b")).alias("val"), pair(F.col("c"), F.col("b")).alias("test"))


def run_selection(spark, sf):
    best = runs.best_run(event_runs(spark, sf), "binary")
    return best.select("run_name", "family", "sampling", F.col("val")["f1"].alias("val_f1"))


def run_sampling_groups(spark, sf):
    return runs.best_by_sampling(event_runs(spark, sf))


def run_sampling_impact(spark, sf):
    return runs.sampling_impact(event_runs(spark, sf))


def run_metrics_long(spark, sf):
    return runs.long_metrics(event_runs(spark, sf))


def run_comparison(spark, sf):
    return runs.comparison(event_runs(spark, sf))


def model_version_rows(spark, sf):
    """Brands seen as models; devices are given for some of them only."""
    brand = F.col("p_brand")
    models = table(spark, sf, "part").groupBy(brand).agg(
        F.sort_array(F.collect_set("p_type")).alias("feature_columns"),
        F.max("p_size").alias("size"))
    device = lambda cond, name: F.when(cond, F.lit(name))
    return runs.model_versions(models.select(
        brand.alias("model"), F.lit("boosted_trees").alias("model_family"),
        F.lit(None).cast("string").alias("training_timestamp_utc"), "feature_columns",
        F.lit("auto").alias("device_requested"), F.lit(None).cast("boolean").alias("fallback_path"),
        device(F.col("size") >= 50, "cuda").alias("device_used_for_training"),
        F.lit("cpu").alias("device_used"),
        device(F.col("size") >= 49, "cpu").alias("device_used_for_inference"))).select(
        "model", "model_family", "feature_count", "device_requested", "training_device",
        "inference_device")


def metadata_tables(spark, sf):
    """Nested class metrics and matrix of one metadata row, back as rows."""
    rows = line_classes(spark, sf)
    labels = ["A", "N", "R"]
    nested = m.class_report(rows, labels).agg(F.map_from_entries(F.collect_list(F.struct(
        "class_label", F.struct("precision", "recall", "f1", "support")))).alias("per_class"))
    per_class = runs.per_class_rows(nested)
    return per_class.select("class_label", "support", F.round("precision", 6).alias("precision"),
                            F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def matrix_table(spark, sf):
    labels = ["A", "N", "R"]
    cells = m.confusion_matrix(line_classes(spark, sf), labels)
    by_row = cells.groupBy("row_index").agg(F.array_sort(F.collect_list(
        F.struct("column_index", "n"))).alias("r"))
    nested = by_row.agg(F.array_sort(F.collect_list(F.struct("row_index", "r"))).alias("m")).select(
        F.transform("m", lambda x: x["r"]["n"]).alias("confusion_matrix"))
    return runs.matrix_rows(nested, labels)


QUERIES = {f.__name__: f for f in (
    explained_rows, ranked_probabilities, mean_abs_contributions, contribution_factors,
    formatted_values, numeric_map_entries, prediction_log, logged_inputs, payload_rows,
    typed_inputs, csv_scan, split_store, bounded_scan, json_document, run_selection,
    run_sampling_groups, run_sampling_impact, run_metrics_long, run_comparison,
    model_version_rows, metadata_tables, matrix_table)}

_SCORED = FEATURES_SQL + """,
scored AS (SELECT *, fmod(charge, 1000.0) / 1000.0 AS p, trim(readmitted) AS mc FROM features)"""


def _pct(share: str) -> str:
    return f"format('{{:.1f}}%', ({share}) * 100)"


def _factors_sql() -> str:
    up = """list_filter([
 CASE WHEN recurrency >= 1 THEN 'Repeated encounter burden (recurrency=' || recurrency || ')' END,
 CASE WHEN sev >= 0.4 THEN format('Higher severity index (patient_severity={:.2f})', sev) END,
 CASE WHEN util >= 3 THEN format('Higher utilization intensity ({:.0f})', util) END,
 CASE WHEN med >= 0.2 THEN format('More medication changes (medication_change_ratio={:.2f})', med) END,
 CASE WHEN complex_discharge_flag >= 1 THEN 'Complex discharge disposition signal present' END,
 CASE WHEN age_bucket_risk >= 7 THEN 'Higher age-risk bucket (age_bucket_risk=' || age_bucket_risk || ')' END
 ], lambda x: x IS NOT NULL)"""
    down = """list_filter([
 CASE WHEN recurrency < 1 THEN 'No repeated encounter signal (recurrency near 0)' END,
 CASE WHEN sev <= 0.2 THEN format('Lower severity index (patient_severity={:.2f})', sev) END,
 CASE WHEN util <= 1 THEN format('Lower utilization intensity ({:.0f})', util) END,
 CASE WHEN med <= 0.05 THEN format('Limited medication changes (medication_change_ratio={:.2f})', med) END,
 CASE WHEN complex_discharge_flag < 1 THEN 'Home-like discharge disposition signal present' END,
 CASE WHEN age_bucket_risk BETWEEN 0 AND 4 THEN 'Lower age-risk bucket (age_bucket_risk=' || age_bucket_risk || ')' END
 ], lambda x: x IS NOT NULL)"""
    return f"""WITH {_SCORED}, num AS (SELECT *, patient_severity::DOUBLE AS sev,
utilization_intensity::DOUBLE AS util, medication_change_ratio::DOUBLE AS med FROM scored),
f AS (SELECT encounter_id, p, mc, {up}[1:2] AS u0, {down}[1:2] AS d0 FROM num),
g AS (SELECT *, CASE WHEN len(u0) > 0 THEN u0 ELSE ['{tx.NO_RAISING}'] END AS u,
  CASE WHEN len(d0) > 0 THEN d0 ELSE ['{tx.NO_LOWERING}'] END AS d,
  CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS bp FROM f),
s AS (SELECT *, 'Binary early-readmission prediction=' || bp || ' (' || {_pct('p')} ||
  ' probability). Multiclass prediction=' || mc || '. Multiclass probabilities: ' ||
  CASE WHEN p > (1 - p) / 2 THEN '<30:' || {_pct('p')} || ', NO:' || {_pct('(1 - p) / 2')} ||
    ', >30:' || {_pct('(1 - p) / 2')}
  ELSE 'NO:' || {_pct('(1 - p) / 2')} || ', >30:' || {_pct('(1 - p) / 2')} || ', <30:' ||
    {_pct('p')} END || '.' AS prediction_summary FROM g)
SELECT encounter_id, prediction_summary, 'fallback' AS explanation_mode,
CASE WHEN p >= 0.6 THEN 'Higher relative risk' WHEN p >= 0.35 THEN 'Moderate relative risk'
  ELSE 'Lower relative risk' END AS risk_band,
array_to_string(u, '|') AS raising_factors, array_to_string(d, '|') AS lowering_factors,
prediction_summary || ' Risk-increasing factors: ' || array_to_string(u, '; ') ||
'. Risk-decreasing factors: ' || array_to_string(d, '; ') || '. {tx.CLOSING}' AS explanation_text
FROM s"""


_CONTRIB = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
(l_quantity - 25.0::DOUBLE) * 0.02::DOUBLE AS a, (l_discount - 0.05::DOUBLE) * -3.0::DOUBLE AS b,
(l_tax - 0.04::DOUBLE) * 2.5::DOUBLE AS t FROM lineitem)"""
_RUNS = """g AS (SELECT event_type, CASE WHEN user_id < 50 THEN 'none' WHEN user_id < 100 THEN 'over'
ELSE 'under' END AS sampling, round(avg(value), 4) AS a, round(max(value), 4) AS b,
round(avg(user_id), 4) AS c FROM events GROUP BY ALL)"""
_CLASS_ROWS = f"""WITH {CLASSES_SQL}, l AS (SELECT DISTINCT label AS class_label FROM cls),
c AS (SELECT class_label,
  (SELECT count(*) FROM cls WHERE label = class_label AND prediction = class_label) AS hit,
  (SELECT count(*) FROM cls WHERE label = class_label) AS support,
  (SELECT count(*) FROM cls WHERE prediction = class_label) AS pred FROM l)
SELECT class_label, support, round(coalesce(hit / nullif(pred, 0), 0), 6) AS precision,
round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
round(coalesce(2 * hit / nullif(pred + support, 0), 0), 6) AS f1 FROM c"""

ORACLES = {
    "explained_rows": _factors_sql(),
    "ranked_probabilities": f"""WITH {_SCORED}, e AS (
SELECT encounter_id, 'NO' AS label, (1 - p) / 2 AS share, 1 AS o FROM scored
UNION ALL SELECT encounter_id, '>30', (1 - p) / 2, 2 FROM scored
UNION ALL SELECT encounter_id, '<30', p, 3 FROM scored)
SELECT encounter_id, CAST(row_number() OVER (PARTITION BY encounter_id ORDER BY share DESC, o) - 1
AS INTEGER) AS place, label, round(share, 6) AS share FROM e""",
    "mean_abs_contributions": f"""WITH {_CONTRIB}
SELECT 'l_quantity' AS feature, round(avg(abs(a)), 9) AS mean_abs_contribution FROM c
UNION ALL SELECT 'l_discount', round(avg(abs(b)), 9) FROM c
UNION ALL SELECT 'l_tax', round(avg(abs(t)), 9) FROM c""",
    "contribution_factors": f"""WITH {_CONTRIB}, parts AS (
SELECT *, list_sort([{{'k': -abs(a), 'o': 1, 'n': 'l_quantity', 'v': a}},
 {{'k': -abs(b), 'o': 2, 'n': 'l_discount', 'v': b}},
 {{'k': -abs(t), 'o': 3, 'n': 'l_tax', 'v': t}}])[1:2] AS top FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
array_to_string(list_transform(list_filter(top, lambda x: x.v > 0),
  lambda x: x.n || format(' ({{:+.3f}})', x.v)), '|') AS raising,
array_to_string(list_transform(list_filter(top, lambda x: x.v < 0),
  lambda x: x.n || format(' ({{:+.3f}})', x.v)), '|') AS lowering FROM parts""",
    "formatted_values": """SELECT event_id, format('{:.1f}%', coalesce(value / 800.0, 0) * 100)
AS percent, CASE WHEN event_type <> 'error' THEN format('{:.4f}', value / 128.0) ELSE 'n/a' END
AS metric, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN value / 1000.0 < 0.1 THEN 'stable'
WHEN value / 1000.0 < 0.2 THEN 'moderate' ELSE 'high' END AS band,
CASE WHEN value / 100.0 >= 0.6 THEN 'Higher relative risk' WHEN value / 100.0 >= 0.35
THEN 'Moderate relative risk' ELSE 'Lower relative risk' END AS risk,
'Max ' || upper(event_type[1]) || event_type[2:] || ' Value' AS name FROM events""",
    "numeric_map_entries": "SELECT event_id, 'value' AS name, value AS number FROM events",
    "prediction_log": f"""WITH {_SCORED} SELECT mc AS multiclass_prediction,
CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS binary_prediction, readmitted AS true_label,
'logistic_regression' AS family, 2 * count(*) AS n, 2 * count(*) AS n_stamped,
round(2 * sum(p), 4) AS probability_sum, round(2 * sum(p), 4) AS class_sum
FROM scored GROUP BY ALL""",
    "logged_inputs": f"""WITH {FEATURES_SQL} SELECT recurrency,
round(patient_severity::DOUBLE, 5) AS patient_severity, charge, gender FROM features""",
    "payload_rows": """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events
WHERE event_type <> 'error' UNION ALL SELECT event_id, -1 FROM events WHERE event_type = 'click'""",
    "typed_inputs": f"""WITH {INTAKE_SQL} SELECT encounter_id,
try_cast(discharge_disposition_id AS BIGINT) AS discharge_disposition_id,
CASE WHEN gender = 'Male' OR trim(race) = '' THEN NULL ELSE trim(race) END AS race,
charge AS patient_severity FROM intake""",
    "csv_scan": f"""WITH {INTAKE_SQL} SELECT * REPLACE (CASE WHEN race <> '' THEN race END AS race)
FROM intake""",
    "split_store": f"""WITH {INTAKE_SQL}, s AS (SELECT encounter_id, patient_nbr, charge,
{split_sql('patient_nbr')} AS split FROM intake) SELECT * FROM s WHERE split = 'val'""",
    "bounded_scan": """SELECT round(l_extendedprice, 2) AS l_extendedprice FROM lineitem
ORDER BY l_extendedprice LIMIT 100""",
    "json_document": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "run_selection": f"""WITH {_RUNS} SELECT event_type || '-' || sampling AS run_name,
event_type AS family, sampling, a AS val_f1 FROM g ORDER BY a DESC, b DESC, ascii(event_type) LIMIT 1""",
    "run_sampling_groups": f"""WITH {_RUNS} SELECT CASE WHEN sampling = 'none' THEN 'none'
ELSE 'sampled' END AS sampling_group, max(c) AS best_value FROM g GROUP BY 1""",
    "run_sampling_impact": f"""WITH {_RUNS}, x AS (SELECT
max(c) FILTER (WHERE sampling = 'none') AS best_plain,
max(c) FILTER (WHERE sampling <> 'none') AS best_sampled FROM g)
SELECT *, best_sampled > best_plain AS improved FROM x""",
    "run_metrics_long": f"""WITH {_RUNS}, n AS (SELECT *, event_type || '-' || sampling AS run_name
FROM g) {' UNION ALL '.join(f"SELECT run_name, '{k}' AS metric, {v} AS value FROM n" for k, v in (
        ('val.f1', 'a'), ('val.roc_auc', 'b'), ('val.per_class.lt30.f1', 'b'),
        ('val.per_class.gt30_f1', 'a'), ('test.f1', 'c'), ('test.roc_auc', 'b'),
        ('test.per_class.lt30.f1', 'b'), ('test.per_class.gt30_f1', 'c')))}""",
    "run_comparison": f"""WITH {_RUNS} SELECT 'binary' AS task, event_type AS best_model,
'F1' AS primary_metric, c AS value FROM g ORDER BY a DESC, b DESC, ascii(event_type) LIMIT 1""",
    "model_version_rows": """WITH x AS (SELECT p_brand, count(DISTINCT p_type) AS k,
max(p_size) AS size FROM part GROUP BY 1), y AS (SELECT *, CASE WHEN size >= 50 THEN 'cuda'
ELSE 'cpu' END AS training_device FROM x)
SELECT p_brand AS model, 'boosted_trees' AS model_family, CAST(k AS INTEGER) AS feature_count,
'auto' AS device_requested, training_device, CASE WHEN size >= 49 THEN 'cpu'
ELSE training_device END AS inference_device FROM y""",
    "metadata_tables": _CLASS_ROWS,
    "matrix_table": f"""WITH {CLASSES_SQL}, l AS (SELECT DISTINCT label AS c FROM cls)
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM cls WHERE label = a.c
AND prediction = b.c) AS n FROM l a, l b""",
}
