import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.functions import scoring as sx
from cohortry.functions import text as tx
from cohortry.operators import explain
from cohortry.sources import predictions as pr
from cohortry.sources import raw, store
from cohortry.streaming.append_log import append_scored, stream_rows


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e4, 1e4), st.integers(-4000, 4000).map(lambda i: i / 40)),
                min_size=1, max_size=200), st.sampled_from([0, 1, 2, 3, 4]))
def test_fixed_digits_equals_python(spark, values, digits):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(tx.fixed_digits(F.col("x"), digits).alias("a"),
                    tx.fixed_digits(F.col("x"), digits, signed=True).alias("b")).collect()
    assert [r.a for r in got] == [f"{v:.{digits}f}" for v in values]
    assert [r.b for r in got] == [f"{v:+.{digits}f}" for v in values]


def test_bands_and_texts(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (None,)], "x double")
    rows = df.select(tx.psi_band(F.col("x")), tx.metric_text(F.col("x"), 2),
                     tx.percent_or_zero(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [
        ("stable", "0.05", "5.0%"), ("moderate", "0.10", "10.0%"), ("high", "0.20", "20.0%"),
        ("unavailable", "n/a", "0.0%")]
    bands = spark.createDataFrame([(0.6,), (0.35,), (0.1,)], "p double").select(
        tx.risk_band(F.col("p"))).collect()
    assert [r[0].split()[0] for r in bands] == ["Higher", "Moderate", "Lower"]
    name = spark.range(1).select(tx.readable_name(F.lit("_age-bucket_risk"))).first()[0]
    assert name == "Age Bucket Risk"


def explained(spark, **kwargs):
    row = (2, 0.52, 4.0, 0.24, 1, 8, 1, 0.73, "<30", {"NO": 0.12, ">30": 0.15, "<30": 0.73},
           [("age", 0.0004), ("stay", -0.5), ("meds", 1.25)])
    df = spark.createDataFrame([row], (
        "recurrency int, patient_severity double, utilization_intensity double, "
        "medication_change_ratio double, complex_discharge_flag int, age_bucket_risk int, "
        "binary_prediction int, binary_probability double, multiclass_prediction string, "
        "multiclass_probabilities map<string,double>, "
        "contributions array<struct<feature:string,contribution:double>>"))
    return explain.explain_rows(df, **kwargs).first()


def test_rule_explanation(spark):
    row = explained(spark, top_n=3)
    assert row.explanation_mode == "fallback"
    assert row.raising_factors == [
        "Repeated encounter burden (recurrency=2)",
        "Higher severity index (patient_severity=0.52)", "Higher utilization intensity (4)"]
    assert row.lowering_factors == [tx.NO_LOWERING]
    assert row.prediction_summary == (
        "Binary early-readmission prediction=1 (73.0% probability). Multiclass prediction=<30. "
        "Multiclass probabilities: <30:73.0%, >30:15.0%, NO:12.0%.")
    assert "not medical advice" in row.explanation_text
    assert len(explained(spark, top_n=99).raising_factors) == 6


def test_contribution_explanation(spark):
    row = explained(spark, contributions="contributions")
    assert row.raising_factors == ["meds (+1.250)", "age (+0.000)"]
    assert row.lowering_factors == ["stay (-0.500)"]


def test_empty_probabilities(spark):
    text = spark.range(1).select(tx.prediction_summary(
        F.lit(0), F.lit(0.25), F.lit(None).cast("string"),
        F.create_map().cast("map<string,double>"))).first()[0]
    assert text.endswith("Multiclass prediction=unknown. Multiclass probabilities: unavailable.")


def test_decoding(spark):
    df = spark.createDataFrame([(0, "1"), (2, " TRUE"), (7, "<30"), (1, "no")], "i int, t string")
    rows = df.select(sx.decode_label(F.col("i"), ["a", "b", "c"]).alias("l"),
                     sx.prediction_to_int(F.col("t")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("c", 1), ("7", 1), ("b", 0)]
    kept = spark.range(1).select(sx.numeric_entries(F.create_map(
        F.lit("a"), F.lit("0.5"), F.lit("b"), F.lit("x")))).first()[0]
    assert kept == {"a": 0.5}
    share = spark.range(1).select(sx.positive_share_of_map(F.create_map(F.lit("<30"), F.lit(0.7))))
    assert share.first()[0] == 0.7


def scored(spark, n=3):
    return spark.range(n).select(
        "id", (F.col("id") / 10.0).alias("patient_severity"), F.lit("x").alias("gender"),
        F.when(F.col("id") == 0, F.lit(float("nan"))).otherwise(F.col("id") / 4.0).alias("ratio"),
        F.lit("1").alias("binary_raw"), F.lit(0.9).alias("binary_probability"),
        F.lit("NO").alias("multiclass_prediction"),
        F.create_map(F.lit("NO"), F.lit(0.8)).alias("multiclass_probabilities"),
        F.lit("NO").alias("readmitted"))


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = pr.log_schema({"patient_severity": "double", "ratio": "double"})
    assert pr.read_log(spark, path, schema).count() == 0
    records = pr.prediction_records(scored(spark), ("patient_severity", "ratio", "absent"),
                                    true_label="readmitted",
                                    versions={"binary_model": {"model_family": "lr"}})
    pr.write_log(records, path)
    pr.write_log(records, path, append=True)
    back = pr.read_log(spark, path, schema)
    assert back.count() == 6
    row = back.where("selected_inputs.patient_severity = 0").first()
    assert row.binary_prediction == 1 and row.selected_inputs.ratio is None
    assert row.model_version.binary_model.model_family == "lr"
    assert row.multiclass_probabilities == {"NO": 0.8} and row.true_label == "NO"
    assert isinstance(row.timestamp_utc, dt.datetime)
    assert pr.selected_inputs(back).columns == ["patient_severity", "ratio"]
    pr.write_log(records, path)
    assert pr.read_log(spark, path, schema).count() == 3


def test_blank_log_lines_are_skipped(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"binary_prediction": 1}\n\n   \n{"binary_prediction": 0}\n')
    rows = pr.read_log(spark, str(tmp_path / "log.json")).where("binary_prediction IS NOT NULL")
    assert rows.count() == 2


def test_streamed_log(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = scored(spark)
    rows.write.parquet(source)
    shape = lambda df: pr.prediction_records(df, ("patient_severity",), "stream")
    for _ in range(2):
        stream = stream_rows(spark, source, rows.schema, max_files=1)
        append_scored(stream, shape, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    back = pr.read_log(spark, str(tmp_path / "log"), pr.log_schema({"patient_severity": "double"}))
    assert back.count() == 3 and {r.prediction_source for r in back.collect()} == {"stream"}


def test_payloads_and_typed_inputs(spark):
    df = spark.createDataFrame(
        [(1, '{"features": {"age": "x", "recurrency": "3"}}'),
         (2, '{"rows": [{"age": " (missing)"}, {"recurrency": "bad"}]}'), (3, "{}"), (4, "no json")],
        "id int, body string")
    rows = pr.payload_rows(df, "body", {"age": "string", "recurrency": "string"})
    typed = pr.typed_inputs(rows).orderBy("id").collect()
    assert [(r.id, r.age, r.recurrency) for r in typed] == [
        (1, "x", 3), (2, None, None), (2, None, None)]


def test_json_store(spark, tmp_path):
    assert store.read_rows(spark, str(tmp_path / "absent")) is None
    doc = tmp_path / "d.json"
    doc.write_text('{\n "f1": 0.5,\n "runs": [1, 2]\n}')
    assert store.read_json_document(spark, str(doc)).first().runs == [1, 2]


def test_bounded_read(spark, tmp_path):
    path = str(tmp_path / "t")
    assert raw.read_bounded(spark, path, "id", 3) is None
    spark.range(10).repartition(4).write.parquet(path)
    assert [r.id for r in raw.read_bounded(spark, path, "id", 3).collect()] == [0, 1, 2]
    assert raw.read_bounded(spark, path, "id", 0).count() == 10


def test_contributions_pick_the_largest(spark):
    df = spark.createDataFrame([([("a", 1.0), ("b", -3.0), ("c", 2.0)],)],
                               "contributions array<struct<feature:string,contribution:double>>")
    top = df.select(explain.top_contributions(F.col("contributions"), 2)).first()[0]
    assert [t.feature for t in top] == ["b", "c"]
    means = explain.mean_abs_contributions(df).collect()
    assert [(r.feature, r.mean_abs_contribution) for r in means] == [("b", 3.0), ("c", 2.0), ("a", 1.0)]
    assert np.isclose(means[0].mean_abs_contribution, 3.0)
