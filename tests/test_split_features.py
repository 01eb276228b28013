import pytest
from pyspark.sql import functions as F

from cohortry.operators import features as fe
from cohortry.operators import split as sp


def entity_rows(spark, entities, visits):
    return spark.createDataFrame(
        [(10 * i + j, 1000 + i, "<30" if (i + j) % 5 == 0 else "NO", int((i + j) % 5 == 0), 5 + j)
         for i in range(entities) for j in range(visits)],
        "encounter_id long, patient_nbr long, readmitted string, readmitted_30d int, "
        "num_medications long")


@pytest.mark.parametrize("entities,visits", [(60, 2), (80, 3), (30, 2)])
@pytest.mark.parametrize("exact", [False, True])
def test_no_entity_in_two_splits(spark, entities, visits, exact):
    df = sp.split_by_entity(entity_rows(spark, entities, visits), exact=exact)
    assert tuple(sp.entity_overlap(df).first()) == (0, 0, 0)
    sp.require_no_overlap(df)
    assert df.count() == entities * visits


def test_split_shares(spark):
    df = sp.split_by_entity(entity_rows(spark, 80, 3), exact=True)
    n = {r.split: r["count"] / 240 for r in df.groupBy("split").count().collect()}
    assert 0.60 <= n["train"] <= 0.80 and 0.08 <= n["val"] <= 0.25 and 0.08 <= n["test"] <= 0.25
    entities = {r.split: r.n for r in df.groupBy("split").agg(
        F.count_distinct("patient_nbr").alias("n")).collect()}
    assert entities == {"train": 56, "val": 12, "test": 12}


def test_seed_decides_the_split(spark):
    df = entity_rows(spark, 60, 2)
    one, again, other = (sp.split_by_entity(df, seed=s).orderBy("encounter_id").collect()
                         for s in (1, 1, 2))
    assert one == again and one != other


def test_bad_split_requests(spark):
    df = entity_rows(spark, 5, 1)
    with pytest.raises(ValueError):
        sp.split_by_entity(df, train=0.9)
    with pytest.raises(ValueError):
        sp.split_by_entity(df, train=1.0, val=0.0, test=0.0)
    with pytest.raises(ValueError, match="missing"):
        sp.split_by_entity(df.withColumn("patient_nbr", F.nullif("patient_nbr", F.lit(1000))))
    with pytest.raises(ValueError, match="empty"):
        sp.split_by_entity(df.limit(0))
    with pytest.raises(KeyError):
        sp.split_by_entity(df, entity="absent")


def test_leakage_is_found(spark):
    df = entity_rows(spark, 60, 4)
    leaky = sp.split_by_entity(df, entity="encounter_id")
    with pytest.raises(ValueError, match="shared"):
        sp.require_no_overlap(leaky)


def test_manifest(spark):
    df = sp.split_by_entity(entity_rows(spark, 80, 3), exact=True)
    rows = {(r.section, r.split, r.key): r.value for r in sp.split_manifest(df).collect()}
    assert rows["size", "total", "rows"] == 240 and rows["size", "total", "entities"] == 80
    assert rows["leakage", "total", "shared_entities"] == 0
    assert sum(v for k, v in rows.items() if k[0] == "readmitted_30d") == 240


FEATURE_SCHEMA = (
    "encounter_id long, patient_nbr long, readmitted string, readmitted_30d int, "
    "time_in_hospital long, num_diagnoses long, number_inpatient long, number_outpatient long, "
    "number_emergency long, discharge_disposition_id long, age string, metformin string, "
    "insulin string, num_medications long")
FEATURE_ROWS = [
    (1, 100, "NO", 0, 2, 4, 0, 1, 0, 1, "[30-40)", "No", "No", 8),
    (2, 100, "<30", 1, 6, 9, 2, 2, 1, 2, "[70-80)", "Up", "Down", 15),
    (3, 101, ">30", 0, 3, 6, 1, 0, 0, 6, "[80-90)", "Steady", "No", 11),
    (4, 102, "NO", 0, 5, 7, 0, 0, 2, 99, "bad", None, None, 9)]


def feature_rows(spark):
    return spark.createDataFrame(FEATURE_ROWS, FEATURE_SCHEMA)


def test_features(spark):
    built = fe.engineer_features(feature_rows(spark))
    rows = built.frame.orderBy("encounter_id").collect()
    assert [r.recurrency for r in rows] == [1, 1, 0, 0]
    assert [r.complex_discharge_flag for r in rows] == [0, 1, 0, 1]
    assert [r.medication_change_ratio for r in rows] == [0.0, 1.0, 0.0, 0.0]
    assert [r.age_bucket_risk for r in rows] == [3, 7, 8, -1]
    assert [r.utilization_intensity for r in rows] == [1.0, 5.0, 1.0, 2.0]
    want = 0.30 * 2 / 14 + 0.25 * 4 / 16 + 0.15 * 1 / 10
    assert rows[0].patient_severity == pytest.approx(want, rel=1e-6)
    types = {f.name: f.dataType.simpleString() for f in built.frame.schema}
    assert [types[c] for c in ("recurrency", "patient_severity", "medication_change_ratio",
                               "utilization_intensity", "complex_discharge_flag",
                               "age_bucket_risk")] == [
        "int", "float", "float", "float", "tinyint", "smallint"]
    assert built.status_columns == ["metformin", "insulin"]
    assert built.source_map["medication_change_ratio"] == ["metformin", "insulin"]


def test_fallbacks(spark):
    row = fe.fallback_counts(feature_rows(spark), ["metformin", "insulin"]).first()
    assert tuple(row) == (1, 0, 1)
    blank = feature_rows(spark).withColumns(
        {c: F.lit(None).cast("string") for c in ("metformin", "insulin")})
    assert fe.fallback_counts(blank, ["metformin", "insulin"]).first()[0] == 4
    assert fe.detect_status_columns(blank) == []
    ratio = fe.engineer_features(blank).frame.select("medication_change_ratio").collect()
    assert [r[0] for r in ratio] == [0.0] * 4


def test_alias_and_absent_columns(spark):
    renamed = feature_rows(spark).withColumnRenamed("num_diagnoses", "number_diagnoses")
    assert fe.engineer_features(renamed).source_map["patient_severity"][1] == "number_diagnoses"
    with pytest.raises(KeyError):
        fe.engineer_features(feature_rows(spark).drop("num_diagnoses"))
    built = fe.engineer_features(feature_rows(spark), status_columns=["insulin", "acarbose"])
    assert built.ignored_columns == ["acarbose"]


def test_recurrency_needs_entities(spark):
    with pytest.raises(ValueError):
        fe.with_recurrency(feature_rows(spark).withColumn("patient_nbr", F.lit(None).cast("long")))


def test_lineage(spark):
    rows = {r.column: r for r in fe.engineer_features(feature_rows(spark)).lineage().collect()}
    assert rows["patient_nbr"].origin == "identifier" and not rows["patient_nbr"].model_candidate
    assert rows["age_bucket_risk"].origin == "engineered"
    assert rows["age_bucket_risk"].sources == ["age"]
    assert not rows["readmitted_30d"].model_candidate and rows["num_medications"].model_candidate
