"""Work of sweeps: what is read, written and fitted once."""

from cohortry.operators import learn
from cohortry.plans import jobs, model_queries
from cohortry.sources import raw
from test_learn import BRIEF, INPUTS, training_rows


def test_both_tasks_share_one_preprocessor_and_one_table_of_vectors(spark, tmp_path, monkeypatch):
    raw.write_splits(training_rows(spark), f"{tmp_path}/features")
    fitted, whole = [], learn.fit_preprocessor
    monkeypatch.setattr(learn, "fit_preprocessor", lambda *a, **k: fitted.append(1) or whole(*a, **k))
    table = jobs.train_models(spark, str(tmp_path), ("logistic_regression",), ("none",), params=BRIEF)
    assert len(fitted) == 1
    test = {r["task"]: r["test"] for r in table.collect()}
    assert test["binary"]["roc_auc"] > 0.7 and 0 <= test["multiclass"]["macro_f1"] <= 1
    # A sweep alone finds the same numbers, so the shared labels are those of the task.
    rows = raw.read_splits(spark, f"{tmp_path}/features")
    for task, target in (("binary", "readmitted_30d"), ("multiclass", "readmitted")):
        inputs = jobs.model_inputs(rows.drop("split"))
        found, _ = learn.train_sweep(rows, task, inputs, "encounter_id", target, ("logistic_regression",), params=BRIEF)
        assert all(abs(v - test[task][name]) < 1e-9 for name, v in found[0].test.items())


def test_drawn_rows_and_scores_are_written_once_without_what_is_not_read(spark, monkeypatch):
    written, whole = [], learn.settle
    monkeypatch.setattr(learn, "settle", lambda df: written.append(df.columns) or whole(df))
    learn.train_sweep(training_rows(spark), "binary", INPUTS, "encounter_id", "readmitted_30d",
                      ("random_forest",), ("over",), params=BRIEF)
    # The vectors, the drawn rows, and no vector or share beyond them.
    assert sum("features" in columns for columns in written) == 2
    assert not any("class_shares" in columns for columns in written)


def test_facts_of_scores_leave_the_inputs_unwritten(spark, monkeypatch):
    rows = training_rows(spark)
    _, best = learn.train_sweep(rows, "binary", INPUTS, "encounter_id", "readmitted_30d",
                                ("logistic_regression",), params=BRIEF)
    written, whole = [], model_queries.settle
    monkeypatch.setattr(model_queries, "settle", lambda df: written.append(df.columns) or whole(df))
    facts = model_queries._scored_facts(rows, best, "binary").collect()
    assert {r.split: r.n_rows for r in facts} == {"train": 60, "val": 60, "test": 60}
    assert all(r.n_proper == r.n_rows and r.metric_confirmed for r in facts)
    assert len(written) == 1 and not {*INPUTS, "encounter_id"} & set(written[0])
