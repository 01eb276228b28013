"""Training and scoring queries.

Model weights have no SQL form, so results here are facts that must hold for a
fitted model, and SQL gives what they must be: every row scored with proper
probabilities, metrics that plain counts confirm, a model that has learned what
the classes differ in. All columns that a model may read go in.

Every family runs with its default settings in every query, so that the sweep compares
like with like.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.features import binary_target
from cohortry.operators import explain, learn, metrics, runs, shadow
from cohortry.operators.schema import model_inputs
from cohortry.plans.split_queries import engineered
from cohortry.plans.visits import FEATURES_SQL
from cohortry.sources import store
from cohortry.sources.scratch import scratch_path, settle


def prepared(spark, sf):
    rows = engineered(spark, sf, once=True).withColumn(
        presets.BINARY_TARGET_COLUMN, binary_target("readmitted"))
    return settle(rows)


def _inputs(rows) -> list[str]:
    return model_inputs(rows.drop("split"))


def _target(task: str) -> str:
    return presets.BINARY_TARGET_COLUMN if task == "binary" else presets.TARGET_COLUMN


def _labels(task: str):
    return None if task == "binary" else list(presets.CLASS_LABELS)


def _sweep(rows, task, families, samplings=("none",), **more):
    return learn.train_sweep(rows, task, _inputs(rows), "encounter_id", _target(task), families,
                             samplings, **more)


def _fitted(rows, task, family):
    """Vectors of the rows and a family's model, for queries that ask for no metric."""
    shared = learn.prepare_sweep(rows, task, _inputs(rows), "encounter_id", _target(task), "none",
                                 presets.CLASS_LABELS, 42, None, False)
    return shared, learn.fit_model(shared, family)[0].stages[-1]


def _scored_facts(rows, best, task):
    """Per split: rows, rows with proper probabilities whose class is the most
    probable one, and whether plain counts give the run's own test metric."""
    table = learn.labelled(rows, task, _target(task))
    # The facts need these columns alone; the inputs are not written again.
    scored = settle(learn.score(best.model, table, task, _labels(task)).select(
        "split", "label", "prediction", "predicted_label", "class_shares",
        *(["positive_share"] if task == "binary" else [])))
    shares = F.map_values("class_shares")
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    proper = (F.abs(total - 1.0) < 1e-9) & F.forall(shares, lambda p: (p >= 0) & (p <= 1))
    named = F.col("class_shares")[F.col("predicted_label")] >= F.array_max(shares) - 1e-9
    right = F.col("prediction") == F.col("label")
    yes, said = F.col("label") == 1, F.col("prediction") == 1
    test = scored.where("split = 'test'").agg(
        F.avg(right.cast("double")).alias("accuracy"),
        (F.lit(2.0) * F.count_if(yes & said) / F.nullif(
            F.count_if(yes) + F.count_if(said), F.lit(0))).alias("f1")).first()
    counted = (test["f1"] or 0.0) if task == "binary" else test["accuracy"]
    own = best.test["f1" if task == "binary" else "accuracy"]
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(proper & named).alias("n_proper"),
    ).withColumns({"metric_confirmed": F.lit(abs(counted - own) < 1e-9),
                   "beats_chance": F.lit(_beats_chance(scored, task))})


def _beats_chance(scored, task) -> bool:
    """On the rows of the fit: positives score higher than others (binary), or the
    classes are told apart better than by their shares."""
    train = scored.where("split = 'train'")
    if task == "binary":
        return metrics.roc_auc(train.select(F.col("label").cast("int").alias("label"),
                                            F.col("positive_share").alias("score"))).first()[0] > 0.55
    names = F.array(*[F.lit(x) for x in presets.CLASS_LABELS])
    own = F.col("class_shares")[F.get(names, F.col("label").cast("int"))]
    loss = train.agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-12))))).first()[0]
    counts = [r["count"] for r in train.groupBy("label").count().collect()]
    chance = -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    return loss < chance


def _scores(family: str, task: str, name: str):
    def query(spark, sf):
        rows = prepared(spark, sf)
        _, best = _sweep(rows, task, (family,))
        return _scored_facts(rows, best, task)

    query.__name__ = name
    return query


def training_sweep(spark, sf):
    """Every family with every sampling: the run table, with the rows measured
    and whether all metrics are there and lie between 0 and 1."""
    found, best = _sweep(prepared(spark, sf), "binary", learn.FAMILIES, learn.SAMPLINGS)
    table = runs.run_table(spark, found)
    shares = F.array(*[F.col(part)[m] for part in ("val", "test")
                       for m in ("precision", "recall", "f1", "roc_auc")])
    return table.select(
        "run_order", "run_name", "family", "sampling",
        F.col("val")["n_samples"].cast("long").alias("val_rows"),
        F.col("test")["n_samples"].cast("long").alias("test_rows"),
        F.coalesce(F.forall(shares, lambda m: (m >= 0) & (m <= 1)), F.lit(False)).alias("measured"),
        (F.max(F.col("val")["f1"]).over(Window.partitionBy()) == best.val["f1"]).alias("best_named"))


def model_store(spark, sf):
    """A saved and loaded model scores every row as the model in memory does."""
    rows = prepared(spark, sf)
    _, best = _sweep(rows, "multiclass", ("logistic_regression",))
    path = scratch_path(spark, "model")
    store.save_model(spark, best, path)
    model, meta = store.load_model(spark, path)
    # One after the other on the same rows: no row has to find its own again.
    before = learn.score(best.model, rows, "multiclass", list(presets.CLASS_LABELS)).select(
        *rows.columns, F.col("class_shares").alias("a"))
    pair = learn.score(model, before, meta["task"], meta["class_labels"]).select(
        "a", F.col("class_shares").alias("b"))
    same = F.forall(F.map_keys("a"), lambda k: F.abs(F.col("a")[k] - F.col("b")[k]) < 1e-12)
    return pair.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(same).alias("n_same"))


def _linear(spark, sf):
    rows = prepared(spark, sf)
    table = learn.labelled(rows, "binary", _target("binary"))
    pre = learn.fit_preprocessor(table.where("split = 'train'"), _inputs(rows))
    vectors = settle(pre.transform(table).select("encounter_id", "split", "label", "features"))
    names = learn.slot_names(pre.transform(table))
    train = vectors.where("split = 'train'")
    fitted = learn.build_estimator("logistic_regression", "binary", float(train.count())).fit(
        train.select("label", "features"))
    return vectors, fitted, names


def logistic_optimum(spark, sf):
    """At the optimum the penalised loss has no slope: for every slot the mean of
    residual * value is the penalty times the weight. Also the mean residual is 0."""
    vectors, fitted, names = _linear(spark, sf)
    train = fitted.transform(vectors.where("split = 'train'"))
    off = vector_to_array("probability")[1] - F.col("label")
    slope = array_to_vector(F.transform(vector_to_array("features"), lambda x: x * off))
    means, residual, n = train.select(slope.alias("s"), off.alias("r")).agg(
        Summarizer.mean(F.col("s")), F.avg("r"), F.count(F.lit(1))).first()
    steep = [abs(m + w / n) for m, w in zip(means.toArray(), fitted.coefficients.toArray())]
    return spark.createDataFrame([(n, bool(max(steep) < 1e-4), bool(abs(residual) < 1e-4))],
                                 "n_rows long, flat boolean, centred boolean")


def linear_explanations(spark, sf):
    """Contributions of a fitted model add up to its margin, row by row."""
    vectors, fitted, names = _linear(spark, sf)
    means = explain.slot_means(vectors.where("split = 'train'"))
    weights = fitted.coefficients.toArray().tolist()
    base = fitted.intercept + sum(m * w for m, w in zip(means, weights))
    rows = explain.linear_contributions(fitted.transform(vectors), weights, means, names)
    total = F.aggregate(F.col("contributions")["contribution"], F.lit(0.0), lambda a, b: a + b)
    margin = vector_to_array("rawPrediction")[1]
    fits = F.abs(total + F.lit(base) - margin) < 1e-6
    top = explain.top_contributions(F.col("contributions"), 3)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(fits).alias("n_adding_up"),
        F.sum(F.size(top)).alias("n_top"))


def boosted_explanations(spark, sf):
    """Changes of value on the paths of boosted trees add up to the margin, row by row."""
    rows = prepared(spark, sf)
    shared, trees = _fitted(rows, "binary", "boosted_trees")
    explained = trees.transform(trees.contributions(shared.ready.select("split", "features"), shared.slots))
    total = F.aggregate(F.col("contributions")["contribution"], F.lit(0.0), lambda a, b: a + b)
    fits = F.abs(total + F.lit(trees.base()) - vector_to_array("rawPrediction")[1]) < 1e-4
    top = explain.top_contributions(F.col("contributions"), 3)
    return explained.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(fits).alias("n_adding_up"),
        F.sum(F.size(top)).alias("n_top"))


def top_linear_features(spark, sf):
    """The tree aggregation of vectors and the mean over exploded rows agree, and
    the order is by size. One row, so that it can be checked."""
    vectors, fitted, names = _linear(spark, sf)
    weights = fitted.coefficients.toArray().tolist()
    means = explain.slot_means(vectors.where("split = 'train'"))
    quick = explain.mean_abs_linear(vectors, weights, means, names)
    slow = explain.mean_abs_contributions(explain.linear_contributions(vectors, weights, means, names))
    pairs = quick.join(slow.select("feature", F.col("mean_abs_contribution").alias("other")), "feature")
    close = F.abs(F.col("mean_abs_contribution") - F.col("other")) < 1e-9
    return pairs.agg((F.count_if(close) == F.lit(min(25, len(names)))).alias("all_agree"))


def forest_importances(spark, sf):
    """Importances of all slots: none negative, together 1, largest first, and only
    slots of the model."""
    # Importances come from the fit, which reads rows of train alone.
    _, run = _sweep(prepared(spark, sf), "binary", ("random_forest",), measured=False)
    found = explain.tree_importances(run.model.stages[-1], run.slots, spark, len(run.slots))
    values = [r["importance"] for r in found.collect()]
    return spark.createDataFrame(
        [(len(values) == len(run.slots), min(values) >= 0, abs(sum(values) - 1) < 1e-9,
          values == sorted(values, reverse=True))],
        "all_slots boolean, none_negative boolean, sum_to_one boolean, ordered boolean")


def column_permutation_loss(spark, sf):
    """With a planted label, the loss of its column is the largest of all columns."""
    rows = prepared(spark, sf).withColumn(presets.BINARY_TARGET_COLUMN,
                                          (F.col("charge") > 250000.0).cast("int"))
    inputs = [c for c in _inputs(rows) if c not in ("gender", "age", "age_bucket_risk")]
    _, best = learn.train_sweep(rows, "binary", inputs, "encounter_id", _target("binary"),
                                ("logistic_regression",))
    held_out = settle(learn.labelled(rows.where("split = 'test'"), "binary", _target("binary")))
    losses = explain.permutation_importance(
        best.model, held_out, inputs, "encounter_id",
        lambda model, df: learn.score(model, df, "binary")).collect()
    return spark.createDataFrame(
        [(losses[0]["feature"], losses[0]["auc_loss"] > 0.3,
          all(abs(r["auc_loss"]) < 0.05 for r in losses[1:]))],
        "feature string, large boolean, others_small boolean")


def feature_selection(spark, sf):
    """Vector slots that pass the shadow test.

    The label is planted: whether the charge lies above its middle. Columns that
    say the same in other words are left out, so exactly the charge's slot can win.
    """
    rows = prepared(spark, sf)
    inputs = [c for c in _inputs(rows) if c not in ("gender", "age", "age_bucket_risk")]
    planted = rows.withColumn("label", (F.col("charge") > 250000.0).cast("double"))
    pre = learn.fit_preprocessor(planted, inputs)
    vectors = pre.transform(planted)
    names = learn.slot_names(vectors)
    train = settle(vectors.select(F.col("encounter_id").alias("row_key"), "label", "features"))
    chosen, note = shadow.select_features(train, len(names))
    return spark.createDataFrame([(names[i], note or "chosen") for i in chosen],
                                 "slot string, outcome string")


def resample_under_repeated_keys(spark, sf):
    """Lines by order: a key has several rows, and each class gets the size of the
    smallest. Rows are whole rows of the table."""
    lines = engineered_lines(spark, sf)
    return learn.undersample(lines, "l_orderkey").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def resample_over_null_keys(spark, sf):
    """Lines whose key is null for a third of them: each class gets the size of the
    largest, and all rows stay."""
    key = F.when(F.col("l_partkey") % 3 != 0, F.col("l_orderkey"))
    lines = engineered_lines(spark, sf).withColumn("l_orderkey", key)
    return learn.oversample(lines, "l_orderkey").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_linekey").alias("n_distinct"))


def engineered_lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_returnflag",
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("l_linekey"),
        F.col("l_returnflag").alias("label"))


QUERIES = {
    "logistic_scores": _scores("logistic_regression", "binary", "logistic_scores"),
    "logistic_multiclass_scores": _scores("logistic_regression", "multiclass",
                                          "logistic_multiclass_scores"),
    "forest_scores": _scores("random_forest", "multiclass", "forest_scores"),
    "boosted_scores": _scores("boosted_trees", "binary", "boosted_scores"),
    "boosted_multiclass_scores": _scores("boosted_trees", "multiclass",
                                         "boosted_multiclass_scores"),
    **{f.__name__: f for f in (training_sweep, model_store, linear_explanations,
                               boosted_explanations,
                               logistic_optimum, top_linear_features, forest_importances,
                               column_permutation_loss, feature_selection,
                               resample_under_repeated_keys, resample_over_null_keys)},
}

_PER_SPLIT = f"""WITH {FEATURES_SQL} SELECT split, count(*) AS n_rows, count(*) AS n_proper,
true AS metric_confirmed, true AS beats_chance FROM features GROUP BY 1"""
_RUN_NAMES = [(i, f, s) for i, (f, s) in enumerate(
    (f, s) for f in ("logistic_regression", "random_forest", "boosted_trees")
    for s in ("none", "over", "under"))]

ORACLES = {
    **{name: _PER_SPLIT for name in (
        "logistic_scores", "logistic_multiclass_scores", "forest_scores", "boosted_scores",
        "boosted_multiclass_scores")},
    "training_sweep": f"""WITH {FEATURES_SQL}, n AS (SELECT
count(*) FILTER (WHERE split = 'val') AS val_rows,
count(*) FILTER (WHERE split = 'test') AS test_rows FROM features)
SELECT run_order, 'binary_' || family || '_sampling-' || sampling || '_fs-none' AS run_name,
family, sampling, val_rows, test_rows, true AS measured, true AS best_named FROM n, (VALUES {', '.join(map(str, _RUN_NAMES))})
t(run_order, family, sampling)""",
    "model_store": f"WITH {FEATURES_SQL} SELECT count(*) AS n_rows, count(*) AS n_same FROM features",
    "linear_explanations": f"""WITH {FEATURES_SQL} SELECT split, count(*) AS n_rows,
count(*) AS n_adding_up, 3 * count(*) AS n_top FROM features GROUP BY 1""",
    "boosted_explanations": f"""WITH {FEATURES_SQL} SELECT split, count(*) AS n_rows,
count(*) AS n_adding_up, 3 * count(*) AS n_top FROM features GROUP BY 1""",
    "logistic_optimum": f"""WITH {FEATURES_SQL} SELECT count(*) AS n_rows, true AS flat,
true AS centred FROM features WHERE split = 'train'""",
    "top_linear_features": "SELECT count(*) > 0 AS all_agree FROM orders",
    "forest_importances": """SELECT count(*) > 0 AS all_slots, true AS none_negative,
true AS sum_to_one, true AS ordered FROM orders""",
    "column_permutation_loss": """SELECT DISTINCT 'charge' AS feature, true AS large,
true AS others_small FROM orders""",
    "resample_under_repeated_keys": """WITH n AS (SELECT l_returnflag AS label, count(*) AS n
FROM lineitem GROUP BY 1) SELECT label, (SELECT min(n) FROM n) AS n FROM n""",
    "resample_over_null_keys": """WITH n AS (SELECT l_returnflag AS label, count(*) AS n,
count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct FROM lineitem GROUP BY 1)
SELECT label, (SELECT max(n) FROM n) AS n, n_distinct FROM n""",
    "feature_selection": """SELECT DISTINCT 'numeric__charge' AS slot, 'chosen' AS outcome
FROM orders""",
}
