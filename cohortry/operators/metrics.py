"""Classification metrics on a table of (label, score, prediction) columns.

Counts come from partial aggregation. Metrics that need an order over scores
(ROC AUC, precision-recall) use a bucketed running sum: scores are counted
first, buckets of about equal size are summed each in its own task, and the
totals of earlier buckets - a table with one row per bucket - are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.tokens import quoted
from cohortry.operators.quantiles import add_bucket, bucket_borders


def _ratio(top: Column, bottom: Column) -> Column:
    """A share that is 0 when undefined."""
    return F.coalesce(top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 buckets: int | None = None) -> DataFrame:
    """One row per distinct score: positives and negatives at it and below it."""
    pairs = df.select(quoted(score).cast("double").alias("score"),
                      (quoted(label) == 1).alias("positive")).where("score IS NOT NULL")
    bucketed = add_bucket(pairs, "score", bucket_borders(pairs, "score", buckets))
    # The filter keeps the two uses of ``counts`` alike, so it is computed once.
    counts = bucketed.where("bucket IS NOT NULL").groupBy("bucket", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    # One row per bucket, so neither the plain ordering nor the broadcast grows.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    zero = F.lit(0)
    starts = (counts.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
              .select("bucket", F.coalesce(F.sum("p").over(earlier), zero).alias("pos_start"),
                      F.coalesce(F.sum("n").over(earlier), zero).alias("neg_start"),
                      F.sum("p").over(whole).alias("all_pos"),
                      F.sum("n").over(whole).alias("all_neg")))
    inside = (Window.partitionBy("bucket").orderBy("score")
              .rowsBetween(Window.unboundedPreceding, -1))
    return counts.join(F.broadcast(starts), "bucket").select(
        "score", "pos", "neg", "all_pos", "all_neg",
        (F.col("pos_start") + F.coalesce(F.sum("pos").over(inside), zero)).alias("pos_below"),
        (F.col("neg_start") + F.coalesce(F.sum("neg").over(inside), zero)).alias("neg_below"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null for one class only."""
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return score_counts(df, label, score, buckets).agg(
        (F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score",
             buckets: int | None = None) -> DataFrame:
    """Precision and recall when predicting 1 at ``score >= threshold``, for
    every threshold, and the closing point (1, 0) with a null threshold."""
    tp = F.col("all_pos") - F.col("pos_below")
    fp = F.col("all_neg") - F.col("neg_below")
    curve = score_counts(df, label, score, buckets).select(
        F.col("score").alias("threshold"), _ratio(tp, tp + fp).alias("precision"),
        F.when(F.col("all_pos") == 0, F.lit(1.0)).otherwise(_ratio(tp, F.col("all_pos")))
         .alias("recall"))
    end = df.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return curve.unionByName(end)


def calibration_curve(df: DataFrame, label: str = "label", score: str = "score",
                      bins: int = 10) -> DataFrame:
    """Mean score and share of positives per uniform bin; empty bins left out."""
    edges = [i / bins for i in range(1, bins)]
    inner = sum(((quoted(score) > F.lit(e)).cast("int") for e in edges), F.lit(0))
    return (df.groupBy(inner.alias("bin")).agg(
        F.avg(quoted(score)).alias("mean_score"),
        F.avg((quoted(label) == 1).cast("double")).alias("positive_rate"),
        F.count(F.lit(1)).alias("n")))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1, confusion counts, size and positive rate; one row."""
    y, p = quoted(label), quoted(prediction)
    cells = df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n_samples"), F.count_if(y == 1).alias("n_positive"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "tn", "fp", "fn", "tp", "n_samples",
        _ratio(F.col("n_positive"), F.col("n_samples")).alias("positive_rate"))


def confusion_matrix(df: DataFrame, labels, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """Cell counts for a fixed label order, zero cells included."""
    labels = list(labels)
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(i, j, a, b) for i, a in enumerate(labels) for j, b in enumerate(labels)],
        "row_index int, column_index int, label string, prediction string")
    cells = df.groupBy(quoted(label).cast("string").alias("label"),
                       quoted(prediction).cast("string").alias("prediction")).count()
    return (grid.join(cells, ["label", "prediction"], "left")
            .select("row_index", "column_index", "label", "prediction",
                    F.coalesce("count", F.lit(0)).cast("long").alias("n")))


def _class_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row per label seen in either column; its size follows the label set."""
    cells = df.groupBy(quoted(label).cast("string").alias("y"),
                       quoted(prediction).cast("string").alias("p")).count()
    ends = F.array(
        F.struct(F.col("y").alias("class_label"), F.col("count").alias("true_n"),
                 F.lit(0).cast("long").alias("pred_n"),
                 F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(F.lit(0)).alias("hit_n")),
        F.struct(F.col("p").alias("class_label"), F.lit(0).cast("long").alias("true_n"),
                 F.col("count").alias("pred_n"), F.lit(0).cast("long").alias("hit_n")))
    return (cells.select(F.inline(ends)).where("class_label IS NOT NULL").groupBy("class_label")
            .agg(*[F.sum(c).alias(c) for c in ("true_n", "pred_n", "hit_n")]))


def _score_columns() -> list[Column]:
    hit, true, pred = F.col("hit_n"), F.col("true_n"), F.col("pred_n")
    return [_ratio(hit, pred).alias("precision"), _ratio(hit, true).alias("recall"),
            _ratio(2 * hit, true + pred).alias("f1"),
            F.coalesce(true, F.lit(0)).cast("long").alias("support")]


def class_report(df: DataFrame, labels, label: str = "label",
                 prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support for each listed class."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(labels)),
                                             "class_index int, class_label string")
    joined = wanted.join(_class_counts(df, label, prediction), "class_label", "left")
    return joined.select("class_index", "class_label", *_score_columns())


def multiclass_metrics(df: DataFrame, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro F1 over the labels seen in either column, and size."""
    counts = _class_counts(df, label, prediction)
    scored = counts.select("hit_n", "true_n", *_score_columns()[2:3])
    return scored.agg(
        (F.sum("hit_n") / F.sum("true_n")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.sum("true_n").alias("n_samples"))
