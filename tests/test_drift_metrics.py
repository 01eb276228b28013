import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import drift as d
from cohortry.operators import metrics as m


def column(spark, values, name="value"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("bins,current,want", [
    # Reference 0..9 in two bins of five rows; shares 0.5 and 0.5.
    (2, [0] * 8 + [9] * 2, 0.3 * math.log(1.6) + 0.3 * math.log(2.5)),
    # Five bins of two rows each against shares .6, .1, .1, .1, .1.
    (5, [1] * 6 + [3, 5, 7, 9], 0.4 * math.log(3) + 4 * 0.1 * math.log(2)),
    # An empty bin counts as one millionth.
    (2, [9] * 4, 0.499999 * math.log(5e5) + 0.5 * math.log(2)),
])
def test_psi_by_hand(spark, bins, current, want):
    got = d.psi(column(spark, range(10)), column(spark, current), ["value"], bins).first().psi
    assert got == pytest.approx(want, rel=1e-9)


def test_psi_special_cases(spark):
    two = column(spark, [0] * 65 + [1] * 35)
    other = column(spark, [0] * 10 + [1] * 90)
    assert d.psi(two, other, ["value"]).first().psi == 0.0
    assert d.psi(column(spark, [3] * 9), other, ["value"]).first().psi == 0.0
    assert d.psi(column(spark, [float("nan")]), other, ["value"]).first().psi is None
    assert d.psi(two, other.limit(0), ["value"]).first().psi is None


def test_infinite_values_count_but_have_no_bin(spark):
    a = column(spark, list(range(100)))
    b = column(spark, [*range(100), float("inf")])
    row = d.drift_summary(a, b, ["value"]).first()
    assert row.current_count == 101 and row.psi == pytest.approx(0.0, abs=1e-12)


def small_tables(spark):
    reference = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "patient_severity double")
    current = spark.createDataFrame([(0.2,), (0.25,), (0.4,)], "patient_severity double")
    records = spark.createDataFrame(
        [(0, 0.21, "NO"), (1, 0.77, "<30")],
        "binary_prediction int, binary_probability double, multiclass_prediction string")
    scores = spark.createDataFrame([(0.1,), (0.4,), (0.2,)], "binary_probability double")
    return records, reference, current, scores


def test_small_samples_are_reported(spark):
    records, reference, current, scores = small_tables(spark)
    rows = d.monitoring_summary(records, reference, current, None, ["patient_severity"], scores,
                                min_sample_size=5, bins=5).collect()
    warned = {(r.metric, r.subject) for r in rows if r.section == "warning"}
    assert {("insufficient_sample", "patient_severity"),
            ("insufficient_sample", "binary_probability"), ("no_labels", "*"),
            ("few_records", "*")} == warned
    status = {(r.section, r.metric): r.text for r in rows if r.text}
    assert status["feature_drift", "status"] == "insufficient_data"
    assert status["label_monitoring", "performance_monitoring"] == "unavailable"


def test_summary_without_reference(spark):
    records, *_ = small_tables(spark)
    rows = d.monitoring_summary(records, None, None).collect()
    warned = {r.metric for r in rows if r.section == "warning"}
    assert {"no_reference_scores", "no_feature_table"} <= warned
    empty = records.limit(0).select(F.col("binary_probability").alias("x"))
    rows = d.monitoring_summary(records, empty, empty, features=["x"]).collect()
    assert "empty_feature_table" in {r.metric for r in rows}


def test_probability_summary_matches_numpy(spark):
    values = np.random.default_rng(1).random(333)
    row = d.probability_summary(column(spark, [*values, float("nan")], "binary_probability")).first()
    want = [333, values.mean(), values.std(), values.min(), values.max(),
            *np.quantile(values, [0.1, 0.5, 0.9])]
    assert list(row) == pytest.approx(want)


def test_runtime_falls_back_to_the_model_row(spark):
    records = spark.createDataFrame(
        [(2, {"binary_model": ("gpu", True)}), (1, {"binary_model": ("cpu", False)}),
         (0, {"binary_model": (None, None)})],
        "timestamp_utc int, inference_runtime map<string,struct<device:string,used_fallback:boolean>>")
    versions = spark.createDataFrame(
        [("binary_model", "auto", "cuda", "cpu", None), ("multiclass_model", "cuda", "cuda", "cpu", None)],
        "model string, device_requested string, training_device string, inference_device string, "
        "fallback_path boolean")
    rows = {r.model: r for r in d.inference_runtime(records, versions).collect()}
    assert (rows["binary_model"].inference_device, rows["binary_model"].used_fallback) == ("cpu", False)
    assert rows["multiclass_model"].used_fallback and rows["multiclass_model"].record_device is None


def test_binary_metrics_by_hand(spark):
    rows = list(zip([0, 1, 0, 1, 1, 0, 0, 1], [0, 1, 0, 0, 1, 0, 1, 1],
                    [.12, .85, .30, .40, .76, .22, .63, .88]))
    df = spark.createDataFrame(rows, "label int, prediction int, score double")
    row = m.binary_metrics(df).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (3, 1, 1, 3)
    assert (row.precision, row.recall, row.f1) == (0.75, 0.75, 0.75)
    assert m.roc_auc(df).first()[0] == 0.9375


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    row = m.binary_metrics(df).first()
    assert (row.precision, row.recall, row.f1, row.positive_rate) == (0.0, 0.0, 0.0, 0.0)


LABELS = ("NO", ">30", "<30")


def test_multiclass_metrics_by_hand(spark):
    truth = ["NO", ">30", "<30", "NO", "<30", ">30", "NO"]
    guess = ["NO", ">30", "NO", "NO", "<30", ">30", "<30"]
    df = spark.createDataFrame(list(zip(truth, guess)), "label string, prediction string")
    row = m.multiclass_metrics(df).first()
    assert row.accuracy == pytest.approx(5 / 7) and row.macro_f1 == pytest.approx(13 / 18)
    f1 = [r.f1 for r in m.class_report(df, LABELS).orderBy("class_index").collect()]
    assert f1 == pytest.approx([2 / 3, 1.0, 0.5])


# Published figures: a test-split matrix and the metrics derived from it.
MATRIX = [[7484, 718, 7], [1682, 3440, 57], [373, 1180, 68]]


def test_published_matrix_gives_published_metrics(spark):
    pairs = spark.createDataFrame(
        [(a, b, MATRIX[i][j]) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)],
        "label string, prediction string, n int")
    df = pairs.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))
    row = m.multiclass_metrics(df).first()
    assert row.accuracy == pytest.approx(0.7323605836498102)
    assert row.macro_f1 == pytest.approx(0.5250409566656916) and row.n_samples == 15009
    report = {r.class_label: r for r in m.class_report(df, LABELS).collect()}
    assert report["<30"].precision == pytest.approx(0.5151515151515151)
    assert report[">30"].f1 == pytest.approx(0.6541789483693068)
    cells = m.confusion_matrix(df, LABELS).collect()
    assert {(r.row_index, r.column_index): r.n for r in cells}[2, 1] == 1180
