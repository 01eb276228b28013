"""Hand-made fixtures for null tokens, labels, profiling and roles."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions.features import binary_target, class_index
from cohortry.functions.tokens import parse_number
from cohortry.operators import quality as q
from cohortry.operators import schema as sc
from cohortry.sources import raw


def test_tokens_become_null(spark):
    df = spark.createDataFrame(
        [("Caucasian", "Female"), ("?", "Male"), ("  ", "")], "race string, gender string")
    rows = q.replace_null_tokens(df).collect()
    assert [tuple(r) for r in rows] == [("Caucasian", "Female"), (None, "Male"), (None, None)]


def test_unicode_white_space_and_padded_question_mark(spark):
    df = spark.createDataFrame(
        [("  ",), ("\t? ",), ("",), (None,), (" a　",), ("?x",)], "c string")
    row = q.missingness(df).first()
    assert (row.whitespace_only_count, row.question_mark_count, row.empty_string_count,
            row.standard_null_count, row.missing_count) == (1, 1, 1, 1, 4)
    assert row.missing_rate == pytest.approx(4 / 6)
    assert [r.c for r in q.replace_null_tokens(df).collect()] == [
        None, None, None, None, " a　", "?x"]


def test_nan_is_a_standard_null(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), None)], "x double, n int")
    counts = {r.column: r.standard_null_count for r in q.missingness(df).collect()}
    assert counts == {"x": 1, "n": 1}


def test_missingness_of_an_empty_table(spark):
    row = q.missingness(spark.createDataFrame([], "a string")).first()
    assert (row.rows, row.missing_count, row.missing_rate) == (0, 0, 0.0)


def test_rate_ties_keep_column_order(spark):
    df = spark.createDataFrame([("?", "?", "x")], "b string, a string, c string")
    assert [r.column for r in q.missingness(df).collect()] == ["b", "a", "c"]


LABELS = [("NO",), (">30",), ("<30",), ("NO",)]


def test_binary_and_class_labels(spark):
    df = spark.createDataFrame(LABELS, "readmitted string")
    rows = df.select(binary_target("readmitted").alias("b"), class_index("readmitted").alias("c"))
    assert [r.b for r in rows.collect()] == [0, 0, 1, 0]
    assert [r.c for r in rows.collect()] == [0.0, 1.0, 2.0, 0.0]
    assert rows.schema["b"].dataType.simpleString() == "tinyint"


def test_bad_labels_raise(spark):
    with pytest.raises(ValueError, match="Unexpected labels.*INVALID"):
        q.require_labels(spark.createDataFrame([("NO",), ("INVALID",)], "readmitted string"))
    with pytest.raises(ValueError, match="1 missing"):
        q.require_labels(spark.createDataFrame([("NO",), (None,)], "readmitted string"))
    with pytest.raises(KeyError):
        q.require_labels(spark.createDataFrame([("NO",)], "other string"))


def test_candidacy(spark):
    df = spark.createDataFrame(
        [(1, 10, "NO", 0, 5), (2, 10, "<30", 1, 6)],
        "encounter_id long, patient_nbr long, readmitted string, readmitted_30d int, "
        "num_medications long")
    found = sc.feature_candidacy(df)
    assert found.excluded == ["encounter_id", "patient_nbr"]
    assert found.candidates == ["num_medications"]


VISIT = ("encounter_id long, patient_nbr long, readmitted string, age string, race string, "
         "gender string, time_in_hospital long, num_lab_procedures long, num_medications long, "
         "number_outpatient long, number_emergency long, number_inpatient long")


def visit_rows(spark, labels=("NO", ">30", "<30"), race="x", gender="Male"):
    return spark.createDataFrame(
        [(1, 10, labels[0], "[30-40)", "Caucasian", "Female", 1, 2, 3, 0, 0, 0),
         (2, 10, labels[1], "[40-50)", race, "Male", 2, 3, 4, 0, 1, 0),
         (3, 11, labels[2], "[50-60)", "Other", gender, 3, 4, 5, 1, 0, -1)], VISIT)


def rules(df):
    return {(r.rule, r.subject): r for r in q.validation_report(df).collect()}


def test_validation_of_a_sound_table(spark):
    found = rules(visit_rows(spark))
    assert not any(r.violated for k, r in found.items() if k[0] != "negative_values")
    assert found["negative_values", "number_inpatient"].violated
    assert found["negative_values", "number_inpatient"].value == 1


def test_validation_names_what_is_wrong(spark):
    assert rules(visit_rows(spark).drop("age"))["required_column", "age"].violated
    found = rules(visit_rows(spark, labels=("INVALID", ">30", "<30")))
    assert found["target_labels", "unexpected:INVALID"].violated
    assert found["target_labels", "absent:NO"].violated
    found = rules(visit_rows(spark, race="?", gender="   "))
    assert found["question_mark_tokens", "*"].value == 1
    assert found["high_missingness", "race"].violated
    twice = visit_rows(spark).union(visit_rows(spark))
    assert rules(twice)["duplicate_rows", "*"].value == 3
    assert rules(twice)["id_not_unique", "encounter_id"].violated


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)],
                               "x string, y string")
    assert q.duplicate_row_count(df).first()[0] == 1
    assert q.duplicate_row_count(df.limit(0)).first()[0] == 0


def test_identifiers_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, None), (None, None), (2, 6)],
                               "encounter_id long, patient_nbr long")
    row = q.identifier_summary(df).first()
    assert (row.id_non_null_count, row.id_unique_count, row.id_duplicate_count) == (3, 2, 2)
    assert not row.id_unique
    assert (row.entity_unique_count, row.entity_repeated_row_count) == (2, 4)
    assert [tuple(r) for r in q.top_repeated_entities(df).collect()] == [(5, 2)]


def test_absent_keys_give_null_facts(spark):
    df = spark.createDataFrame([(1,), (1,)], "encounter_id long")
    row = q.identifier_summary(df).first()
    assert (row.id_duplicate_count, row.id_unique, row.entity_unique_count) == (1, False, None)
    row = q.identifier_summary(df.withColumnRenamed("encounter_id", "x")).first()
    assert row.id_unique is None and row.id_non_null_count is None
    rows = q.preprocessing_summary(df, df, sc.feature_candidacy(df)).collect()
    assert any(r.section == "warning" and "patient_nbr" in r.subject for r in rows)


def test_dictionary_roles(spark):
    df = spark.createDataFrame(
        [(1, 10, "NO", "Up", "250", 1, 5, "?"), (2, 10, "<30", "No", "401", 0, 6, "Asian")],
        "encounter_id long, patient_nbr long, readmitted string, metformin string, diag_1 string, "
        "number_emergency long, num_medications long, race string")
    rows = {r.column_name: r for r in q.data_dictionary(df, "encounter_id").collect()}
    assert {k: rows[k].role for k in ("encounter_id", "readmitted", "metformin", "diag_1",
                                      "num_medications", "race")} == {
        "encounter_id": "identifier", "readmitted": "target", "metformin": "medication-status",
        "diag_1": "diagnosis-like", "num_medications": "numeric", "race": "categorical"}
    assert rows["number_emergency"].is_utilization
    assert rows["race"].example_values == ["Asian"]
    assert rows["race"].missing_token_rate == 0.5 and rows["race"].non_null_count == 2
    assert rows["metformin"].example_values == ["Up", "No"]


def test_csv_header_and_reader_nulls(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("encounter_id,Medication Flag,score\n1,None,2\n2,?,x\n3, a ,NaN\n")
    df = raw.read_csv(spark, str(path))
    assert df.columns == ["encounter_id", "Medication Flag", "score"]
    assert [r["Medication Flag"] for r in df.collect()] == [None, "?", " a "]
    numbers = df.select(parse_number(df, "score").alias("n")).collect()
    assert [r.n for r in numbers] == [2.0, None, None]
    with pytest.raises(FileNotFoundError):
        raw.read_csv(spark, str(tmp_path / "absent.csv"))


def test_numbers_that_only_java_would_take(spark):
    df = spark.createDataFrame([("1d",), ("0x1p3",), (" 1e2 ",), ("-inf",), (".5",), ("nan",)],
                               "x string")
    assert [r[0] for r in df.select(parse_number(df, "x")).collect()] == [
        None, None, 100.0, float("-inf"), 0.5, None]


def test_visit_schema_has_the_declared_columns():
    schema = raw.visit_schema()
    assert len(schema) == 50
    assert sum(f.dataType.simpleString() == "bigint" for f in schema) == 13


def test_model_inputs(spark):
    df = spark.createDataFrame([(1, 2, "NO", 3)], "encounter_id int, a int, readmitted string, b int")
    assert sc.model_inputs(df, ["b", "b", "readmitted", "absent"]) == ["b"]
    assert sc.model_inputs(df) == ["a", "b"]
    with pytest.raises(ValueError):
        sc.model_inputs(df, ["readmitted"])
    with pytest.raises(KeyError, match="absent"):
        sc.select_listed(df, ["a", "absent"])
    assert sc.numeric_and_categorical(df) == (["encounter_id", "a", "b"], ["readmitted"])
    assert [r.present for r in sc.required_column_status(df, ["a", "z"]).collect()] == [True, False]
    assert sc.drop_present(df, ["a", "zzz"]).columns == ["encounter_id", "readmitted", "b"]
    assert [sc.clamp_top_n(n) for n in (0, 3, 99)] == [1, 3, 10]
    assert {r.column: r.role for r in sc.column_roles(df).collect()}["a"] == "numeric"


def test_numeric_summary_matches_pandas(spark):
    df = spark.range(0, 101).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    want = df.toPandas()["x"].describe()
    got = q.numeric_summary(df).first()
    assert [got[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == (
        pytest.approx(want.tolist()))
