"""Training, scoring and the jobs from a raw file to a monitoring summary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.operators import explain, learn, runs, shadow
from cohortry.plans import jobs
from cohortry.sources import predictions, raw, store

BRIEF = {"logistic_regression": {"maxIter": 10}, "random_forest": {"numTrees": 5, "maxDepth": 3},
         "boosted_trees": {"maxIter": 2, "maxDepth": 2}}
INPUTS = ["num_feature", "util_feature", "cat_feature"]


def training_rows(spark, n=60):
    rows = []
    for split, seed in (("train", 7), ("val", 11), ("test", 13)):
        rng = np.random.default_rng(seed)
        for i in range(n):
            label = str(rng.choice(["NO", ">30", "<30"], p=[0.55, 0.25, 0.20]))
            cat = rng.choice(["A", "B", "C", None])
            rows.append((seed * 1000 + i, seed * 1000 + i // 2, split, label, int(label == "<30"),
                         float(rng.normal() + 2 * (label == "<30")), int(rng.integers(0, 5)), cat))
    return spark.createDataFrame(rows, (
        "encounter_id long, patient_nbr long, split string, readmitted string, readmitted_30d int, "
        "num_feature double, util_feature long, cat_feature string"))


def sweep(rows, task, families, **kwargs):
    target = "readmitted_30d" if task == "binary" else "readmitted"
    return learn.train_sweep(rows, task, INPUTS, "encounter_id", target, families,
                             params=BRIEF, **kwargs)


def test_binary_sweep(spark, tmp_path):
    rows = training_rows(spark)
    found, best = sweep(rows, "binary", ("logistic_regression", "random_forest"),
                        samplings=("none", "over", "under"))
    assert [r.name for r in found][:2] == ["binary_logistic_regression_sampling-none_fs-none",
                                           "binary_logistic_regression_sampling-over_fs-none"]
    assert len(found) == 6 and best.val["f1"] == max(r.val["f1"] for r in found)
    assert found[0].test["roc_auc"] > 0.7
    table = runs.run_table(spark, found)
    assert runs.best_run(table, "binary").first().run_name == best.name
    assert not {"encounter_id", "patient_nbr"} & set(best.inputs)
    assert found[0].slots == ["numeric__num_feature", "numeric__util_feature",
                              "categorical__cat_feature_A", "categorical__cat_feature_B",
                              "categorical__cat_feature_C"]
    store.save_model(spark, best, str(tmp_path / "m"))
    model, meta = store.load_model(spark, str(tmp_path / "m"))
    scored = learn.score(model, rows.limit(8), "binary").collect()
    assert len(scored) == 8 and all(0 <= r.positive_share <= 1 for r in scored)
    assert meta["inputs"] == INPUTS and meta["class_labels"] == ["0", "1"]
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, str(tmp_path / "absent"))


@pytest.mark.parametrize("family", learn.FAMILIES)
def test_multiclass_families(spark, family):
    rows = training_rows(spark)
    found, best = sweep(rows, "multiclass", (family,), samplings=("over", "under"))
    assert [r.sampling for r in found] == ["none"]
    scored = learn.score(best.model, rows, "multiclass", list(presets.CLASS_LABELS)).collect()
    assert len(scored) == 180
    for r in scored:
        assert sum(r.class_shares.values()) == pytest.approx(1.0)
        assert r.class_shares[r.predicted_label] == pytest.approx(max(r.class_shares.values()))


def test_preprocessor_statistics(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (2.0, "b"), (4.0, "b"), (None, None), (float("nan"), "a")], "x double, c string")
    model = learn.fit_preprocessor(df, ["x", "c"])
    rows = model.transform(df)
    filled = np.array([1.0, 2.0, 4.0, 2.0, 2.0])
    want = (filled - filled.mean()) / filled.std()
    got = [r.features.toArray() for r in rows.collect()]
    assert [g[0] for g in got] == pytest.approx(want.tolist())
    assert [g[1] for g in got] == [1, 0, 0, 1, 1]
    unknown = model.transform(spark.createDataFrame([(1.0, "zzz")], "x double, c string")).first()
    assert unknown.features.toArray()[1:].tolist() == [0.0, 0.0]
    hashed = learn.fit_preprocessor(df, ["x", "c"], hashed={"c": 8}).transform(df)
    vectors = [r.features.toArray()[1:].tolist() for r in hashed.collect()]
    assert all(sum(v) <= 1.0 for v in vectors) and vectors[0] != vectors[1]


def test_awkward_names_and_values(spark):
    df = spark.createDataFrame([(1.0, "it's"), (2.0, "b\\c"), (3.0, "it's")],
                               "`a-b` double, `glyburide-metformin` string")
    rows = learn.fit_preprocessor(df, df.columns).transform(df)
    assert learn.slot_names(rows)[0] == "numeric__a-b"
    assert rows.first().features.size == 3


def test_resampling_sizes(spark):
    df = spark.range(100).select("id", (F.col("id") < 20).cast("int").alias("label"))
    size = lambda t: {r.label: r["count"] for r in t.groupBy("label").count().collect()}
    over = learn.oversample(df, "id")
    assert size(over) == {0: 80, 1: 80} and over.select("id").distinct().count() == 100
    under = learn.undersample(df, "id")
    assert size(under) == {0: 20, 1: 20} and under.distinct().count() == 40
    with pytest.raises(ValueError):
        learn.resample(df, "sideways", "id")


def test_shadow_selection_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    signal, noise = rng.normal(size=400), rng.normal(size=(400, 3))
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame(
        [(i, float(signal[i] > 0), Vectors.dense([signal[i], *noise[i]])) for i in range(400)],
        ["row_key", "label", "features"])
    chosen, note = shadow.select_features(df, 4, rounds=8, trees=10, max_depth=3)
    assert chosen == [0] and note is None
    mixed = shadow.with_shadow(df, "row_key", 1, digits=1).collect()
    assert len(mixed) == 400
    assert sorted(r.features[0] for r in mixed) == sorted(r.shadow[0] for r in mixed)


def test_sweep_with_selection(spark):
    rows = training_rows(spark, 120)
    found, best = sweep(rows, "binary", ("logistic_regression",), select="shadow",
                        selection={"rounds": 8, "trees": 10, "max_depth": 3})
    assert best.slots == ["numeric__num_feature"] and best.name.endswith("_fs-shadow")
    scored = learn.score(best.model, rows, "binary")
    assert scored.where("positive_share BETWEEN 0 AND 1").count() == 360


def test_permutation_importance(spark):
    rows = training_rows(spark, 100)
    _, best = sweep(rows, "binary", ("logistic_regression",))
    table = explain.permutation_importance(
        best.model, learn.labelled(rows, "binary", "readmitted_30d"), ["num_feature", "util_feature"],
        "encounter_id", lambda m, df: learn.score(m, df, "binary")).collect()
    assert table[0].feature == "num_feature" and table[0].auc_loss > 0.05


def test_binary_labels_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "y string")
    assert [r.label for r in learn.labelled(df, "binary", "y").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="unexpected label"):
        learn.labelled(df, "multiclass", "y")


def test_run_tables(spark):
    rows = [(0, "a", "binary", "lr", "none", "none", {"f1": 0.5, "roc_auc": 0.7},
             {"f1": 0.4, "per_class.<30.f1": 0.1}, {"k": "v"}, []),
            (1, "b", "binary", "rf", "over", "none", {"f1": 0.5, "roc_auc": 0.7}, {"f1": 0.6}, {}, []),
            (2, "c", "multiclass", "lr", "none", "none", {"macro_f1": 0.3}, {"macro_f1": 0.2}, {}, [])]
    table = spark.createDataFrame(rows, runs.RUN_SCHEMA)
    assert runs.best_run(table, "binary").first().run_name == "a"
    impact = runs.sampling_impact(table.where("task = 'binary'")).first()
    assert (impact.best_plain, impact.best_sampled, impact.improved) == (0.4, 0.6, True)
    names = {r.metric for r in runs.long_metrics(table).collect()}
    assert "test.per_class.lt30.f1" in names
    assert [(r.task, r.value) for r in runs.comparison(table).collect()] == [
        ("binary", 0.4), ("multiclass", 0.2)]
    assert runs.run_settings(table).collect()[0].setting == "k"


def visit_csv(spark, path, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        row = {name: int(rng.integers(0, 9)) for name in presets.LONG_FIELDS}
        row.update({name: str(rng.choice(["No", "Up", "Steady", "?"])) for name in presets.TEXT_FIELDS})
        row.update(encounter_id=i, patient_nbr=i // 2, readmitted=str(rng.choice(["NO", ">30", "<30"])),
                   age=f"[{10 * (i % 9)}-{10 * (i % 9) + 10})", weight="?", race=f"r{i % 3}")
        rows.append(tuple(row[f.name] for f in raw.visit_schema()))
    raw.write_csv(spark.createDataFrame(rows, raw.visit_schema()), path)


def test_jobs_from_file_to_monitoring(spark, tmp_path):
    csv, out, log = (str(tmp_path / n) for n in ("raw", "out", "log"))
    visit_csv(spark, csv)
    jobs.profile_raw(spark, csv, out)
    checks = store.read_rows(spark, f"{out}/validation")
    assert checks.where("rule = 'high_missingness' AND subject = 'weight' AND violated").count() == 1
    splits = jobs.build_splits(spark, csv, out)
    assert splits.count() == 240 and "weight" in splits.columns
    features = jobs.build_features(spark, out)
    assert set(presets.ENGINEERED_FEATURES) <= set(features.columns)
    keep = ["encounter_id", "patient_nbr", "readmitted", "readmitted_30d", "split", "race",
            *presets.MONITORED_COLUMNS]
    slim = str(tmp_path / "slim")
    raw.write_splits(features.select(*keep), f"{slim}/features")
    table = jobs.train_models(spark, slim, ("logistic_regression",), ("none",), params=BRIEF)
    assert table.count() == 2
    summary = jobs.monitor(spark, slim, log)
    assert summary.where("section = 'sample_sizes' AND subject = 'prediction_records'").first().value == (
        features.where("split = 'test'").count())
    drifted = summary.where("section = 'feature_drift' AND metric = 'status'").count()
    assert drifted == len(presets.MONITORED_COLUMNS)
    again = jobs.monitor(spark, slim, log, append=True)
    tested = features.where("split = 'test'").count()
    assert again.where("subject = 'prediction_records'").first().value == tested
    assert predictions.read_log(spark, log).count() == 2 * tested
    from_log = jobs.monitor(spark, slim, log, current_split="none")
    assert from_log.where("subject = 'prediction_records'").first().value == 2 * tested
    assert jobs.final_comparison(spark, slim).count() == 2
    rows = jobs.explain_split(spark, slim).collect()
    assert len(rows) == tested
    assert all(r.raising_factors and "not medical advice" in r.explanation_text for r in rows)
    assert any("numeric__" in f for r in rows for f in r.raising_factors)
    jobs.evaluation_tables(spark, slim)
    base = f"{slim}/evaluation/binary/test"
    cells = store.read_rows(spark, f"{base}/confusion_matrix")
    assert cells.agg(F.sum("n")).first()[0] == tested
    assert store.read_rows(spark, f"{base}/pr_curve").count() > 1


def test_resampling_with_repeated_and_null_keys(spark):
    repeated = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") < 900).cast("int")
                                        .alias("label"))
    size = lambda t: {r.label: r["count"] for r in t.groupBy("label").count().collect()}
    assert size(learn.undersample(repeated, "k")) == {0: 100, 1: 100}
    assert size(learn.oversample(repeated, "k")) == {0: 900, 1: 900}
    empty = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), "id",
        (F.col("id") < 900).cast("int").alias("label"))
    assert size(learn.undersample(empty, "k")) == {0: 100, 1: 100}
    assert size(learn.oversample(empty, "k")) == {0: 900, 1: 900}
    drawn_often = spark.range(5003).select("id", (F.col("id") < 5000).cast("int").alias("label"))
    assert size(learn.oversample(drawn_often, "id")) == {0: 5000, 1: 5000}


def test_selection_of_more_slots_than_a_dense_matrix_bears(spark):
    from pyspark.ml.linalg import Vectors
    wide = 6000
    df = spark.createDataFrame(
        [(i, float(i % 2), Vectors.sparse(wide, {0: float(i % 2 + 1), 1 + i % (wide - 1): 1.0}))
         for i in range(300)], ["row_key", "label", "features"])
    # Two rounds cannot prove a slot; what counts is that they were run.
    assert shadow.select_features(df, wide, rounds=2, trees=5, max_depth=2) == (
        [], "selection skipped: no slot was chosen")


@pytest.mark.parametrize("name", ["forest_scores", "boosted_scores", "boosted_multiclass_scores",
                                  "training_sweep", "forest_importances"])
def test_tree_queries_run_default_settings(monkeypatch, name):
    from cohortry.plans import model_queries

    class Asked(Exception):
        pass

    def sweep(*args, params=None, **kwargs):
        raise Asked(params)

    monkeypatch.setattr(model_queries, "prepared", lambda spark, sf: None)
    monkeypatch.setattr(model_queries, "_inputs", lambda rows: [])
    monkeypatch.setattr(learn, "train_sweep", sweep)
    with pytest.raises(Asked) as asked:
        model_queries.QUERIES[name](None, None)
    assert asked.value.args == (None,)
