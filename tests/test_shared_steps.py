"""What model queries work out once, and what they leave out because no result needs it."""

from cohortry.operators import learn
from cohortry.plans import job_queries, model_queries
from cohortry.plans.split_queries import engineered

SF = "/root/testdata/sf0.001"


def _refuse(*args, **kwargs):
    raise AssertionError("not needed")


def test_orders_and_lines_are_joined_once(spark):
    files = engineered(spark, SF, once=True).inputFiles()
    # Every check and count over the visits used to join them again.
    assert files and not any("lineitem" in f or "orders" in f for f in files)


def test_importances_measure_no_model_and_make_vectors_of_train_alone(spark, monkeypatch):
    monkeypatch.setattr(learn, "FOREST_TREES", 3)
    monkeypatch.setattr(learn, "score", _refuse)
    seen = []
    prepare = learn.prepare_vectors
    monkeypatch.setattr(learn, "prepare_vectors", lambda rows, *a, **k: seen.append(
        {r["split"] for r in rows.select("split").distinct().collect()}) or prepare(rows, *a, **k))
    assert tuple(model_queries.forest_importances(spark, SF).first()) == (True,) * 4
    assert seen == [{"train"}]


def test_boosted_explanations_measure_no_model(spark, monkeypatch):
    monkeypatch.setattr(learn, "BOOST_ROUNDS", 3)
    monkeypatch.setattr(learn, "score", _refuse)
    rows = model_queries.boosted_explanations(spark, SF).collect()
    assert {r["split"] for r in rows} == {"train", "val", "test"}
    assert all(r["n_rows"] == r["n_adding_up"] for r in rows)


def test_stored_and_fitted_model_score_the_same_rows_without_a_join(spark):
    found = model_queries.model_store(spark, SF)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    n_rows, n_same = found.first()
    assert n_rows == n_same == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_scores_of_the_binary_model_train_no_other(spark, monkeypatch):
    tasks, sweep = [], learn.train_sweep
    monkeypatch.setattr(learn, "train_sweep", lambda rows, task, *a, **k: tasks.append(task) or sweep(rows, task, *a, **k))
    n, n_proper = job_queries.reference_score_rows(spark, SF).first()
    assert n == n_proper > 0 and tasks == ["binary"]
