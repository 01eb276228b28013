"""Metric, weighting and resampling queries with their SQL texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry.functions import scoring as sx
from cohortry.operators import learn
from cohortry.operators import metrics as m
from cohortry.plans.visits import VISITS_SQL, table, visits


def document_scores(spark, sf):
    """Label: document quality; score: its length; prediction: longer than 2000."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"),
                       (F.col("n_chars") > 2000).cast("int").alias("prediction"))


def line_scores(spark, sf):
    """Label: returned; score: a share of the highest possible price."""
    lines = table(spark, sf, "lineitem")
    share = F.least(F.col("l_extendedprice") / F.lit(110000.0), F.lit(1.0))
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                        share.alias("score"), (share >= 0.5).cast("int").alias("prediction"))


def line_classes(spark, sf):
    """Three classes against a rule on quantity."""
    quantity = F.col("l_quantity")
    guess = (F.when(quantity < 17, F.lit("A")).when(quantity < 34, F.lit("N"))
             .otherwise(F.lit("R")))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"),
                                               guess.alias("prediction"))


LINES_SQL = """lines AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
least(l_extendedprice / 110000.0, 1.0) AS score,
CASE WHEN least(l_extendedprice / 110000.0, 1.0) >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM lineitem)"""
DOCS_SQL = """docs AS (SELECT quality AS label, n_chars::DOUBLE AS score,
CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS prediction FROM documents JOIN labels USING (doc_id))"""
CLASSES_SQL = """cls AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 17 THEN 'A'
WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"""


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


def roc_auc_documents(spark, sf):
    return _rounded(m.roc_auc(document_scores(spark, sf)), "roc_auc")


def roc_auc_lines(spark, sf):
    return _rounded(m.roc_auc(line_scores(spark, sf)), "roc_auc")


def roc_auc_one_class(spark, sf):
    return m.roc_auc(document_scores(spark, sf).withColumn("label", F.lit(1)))


def pr_curve(spark, sf):
    return _rounded(m.pr_curve(document_scores(spark, sf)), "precision", "recall")


def pr_curve_lines(spark, sf):
    return _rounded(m.pr_curve(line_scores(spark, sf)), "threshold", "precision", "recall", places=9)


def calibration_curve(spark, sf):
    return _rounded(m.calibration_curve(line_scores(spark, sf)), "mean_score", "positive_rate")


def binary_metrics(spark, sf):
    return _rounded(m.binary_metrics(line_scores(spark, sf)),
                    "precision", "recall", "f1", "positive_rate")


def confusion_matrix(spark, sf):
    return m.confusion_matrix(line_classes(spark, sf), ("A", "N", "R", "X"))


def class_report(spark, sf):
    return _rounded(m.class_report(line_classes(spark, sf), ("A", "N", "R", "X")),
                    "precision", "recall", "f1")


def multiclass_metrics(spark, sf):
    return _rounded(m.multiclass_metrics(line_classes(spark, sf)), "accuracy", "macro_f1")


def class_weights(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"))
    return _rounded(learn.class_weights(rows), "balanced_weight", "others_ratio")


def _priorities(spark, sf):
    """Orders by urgency: two classes of unequal size."""
    return table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))


def resample_under(spark, sf):
    return learn.undersample(_priorities(spark, sf), "o_orderkey")


def resample_over(spark, sf):
    """Class sizes after oversampling, and how many different rows are in each."""
    return (learn.oversample(_priorities(spark, sf), "o_orderkey")
            .groupBy("label", "o_orderkey").count().groupBy("label")
            .agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_different")))


PREPARED = ["number_emergency", "num_medications", "gender", "insulin"]


def preprocessed_vectors(spark, sf):
    """Standardized numbers and one-hot slots of every visit, by slot name."""
    rows = visits(spark, sf)
    vectors = learn.fit_preprocessor(rows, PREPARED).transform(rows)
    names = [F.lit(n) for n in learn.slot_names(vectors)]
    pairs = F.arrays_zip(F.array(*names).alias("slot"), vector_to_array("features").alias("x"))
    return vectors.select("encounter_id", F.inline(pairs)).select(
        "encounter_id", "slot", F.round("x", 6).alias("x"))


def column_modes(spark, sf):
    return learn.most_frequent(visits(spark, sf), ["race", "age", "insulin", "glipizide"])


def decoded_predictions(spark, sf):
    """Index to name with a fallback, margin to probability, text to 0/1."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        sx.decode_label(F.col("l_linenumber") - 1, ["one", "two", "three"]).alias("label"),
        F.round(sx.sigmoid(F.col("l_tax") - F.col("l_discount")), 9).alias("probability"),
        sx.prediction_to_int(F.when(F.col("l_returnflag") == "R", F.lit(" Yes"))
                             .when(F.col("l_returnflag") == "A", F.lit("<30"))
                             .otherwise(F.lit("no"))).alias("as_int"))


QUERIES = {f.__name__: f for f in (
    roc_auc_documents, roc_auc_lines, roc_auc_one_class, pr_curve, pr_curve_lines,
    calibration_curve, binary_metrics, confusion_matrix, class_report, multiclass_metrics,
    class_weights, resample_under, resample_over, preprocessed_vectors, column_modes,
    decoded_predictions)}


def _auc_sql(cte: str, name: str) -> str:
    return f"""WITH {cte}, g AS (SELECT score, sum(label)::DOUBLE AS pos,
sum(1 - label)::DOUBLE AS neg FROM {name} GROUP BY 1),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM w"""


def _pr_sql(cte: str, name: str, threshold: str, places: int) -> str:
    return f"""WITH {cte}, g AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n
FROM {name} GROUP BY 1),
w AS (SELECT score, sum(pos) OVER d AS tp, sum(n) OVER d AS p, sum(pos) OVER () AS total FROM g
WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT {threshold} AS threshold, round(tp / p, {places}) AS precision,
round(tp / total, {places}) AS recall FROM w UNION ALL SELECT NULL, 1.0, 0.0"""


_REPORT_SQL = f"""WITH {CLASSES_SQL}, l AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R'),
(3, 'X')) t(class_index, class_label)),
c AS (SELECT class_index, class_label,
  (SELECT count(*) FROM cls WHERE label = class_label AND prediction = class_label) AS hit,
  (SELECT count(*) FROM cls WHERE label = class_label) AS support,
  (SELECT count(*) FROM cls WHERE prediction = class_label) AS pred FROM l)"""


def _slots_sql() -> str:
    number = lambda c: (f"SELECT encounter_id, 'numeric__{c}' AS slot, round((coalesce({c}, "
                        f"(SELECT median({c}) FROM visits)) - avg_{c}) / sd_{c}, 6) AS x "
                        "FROM visits, moments")
    moment = lambda c: (f"avg(coalesce({c}, (SELECT median({c}) FROM visits))) AS avg_{c}, "
                        f"stddev_pop(coalesce({c}, (SELECT median({c}) FROM visits))) AS sd_{c}")
    one_hot = lambda c: (f"SELECT encounter_id, 'categorical__{c}_' || v, CASE WHEN "
                         f"coalesce({c}, mode_{c}) = v THEN 1.0 ELSE 0.0 END FROM visits, modes, "
                         f"(SELECT DISTINCT {c} AS v FROM visits WHERE {c} IS NOT NULL)")
    mode = lambda c: (f"(SELECT {c} FROM visits WHERE {c} IS NOT NULL GROUP BY 1 "
                      f"ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_{c}")
    return (f"WITH {VISITS_SQL}, moments AS (SELECT {moment('number_emergency')}, "
            f"{moment('num_medications')} FROM visits), "
            f"modes AS (SELECT {mode('gender')}, {mode('insulin')}) "
            + " UNION ALL ".join([number("number_emergency"), number("num_medications"),
                                  one_hot("gender"), one_hot("insulin")]))


ORACLES = {
    "roc_auc_documents": _auc_sql(DOCS_SQL, "docs"),
    "roc_auc_lines": _auc_sql(LINES_SQL, "lines"),
    "roc_auc_one_class": "SELECT CAST(NULL AS DOUBLE) AS roc_auc",
    "pr_curve": _pr_sql(DOCS_SQL, "docs", "score", 6),
    "pr_curve_lines": _pr_sql(LINES_SQL, "lines", "round(score, 9)", 9),
    "calibration_curve": f"""WITH {LINES_SQL} SELECT CAST(greatest(ceil(round(score * 10, 9)) - 1, 0)
AS INTEGER) AS bin, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate,
count(*) AS n FROM lines GROUP BY 1""",
    "binary_metrics": f"""WITH {LINES_SQL}, c AS (SELECT
count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
count(*) AS n_samples, avg(label) AS positive_rate FROM lines)
SELECT tn, fp, fn, tp, n_samples, round(positive_rate, 6) AS positive_rate,
round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "confusion_matrix": f"""WITH {CLASSES_SQL}, l AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'),
(2, 'R'), (3, 'X')) t(i, c))
SELECT a.i AS row_index, b.i AS column_index, a.c AS label, b.c AS prediction,
(SELECT count(*) FROM cls WHERE label = a.c AND prediction = b.c) AS n FROM l a, l b""",
    "class_report": f"""{_REPORT_SQL} SELECT class_index, class_label, support,
round(coalesce(hit / nullif(pred, 0), 0), 6) AS precision,
round(coalesce(hit / nullif(support, 0), 0), 6) AS recall,
round(coalesce(2 * hit / nullif(pred + support, 0), 0), 6) AS f1 FROM c""",
    "multiclass_metrics": f"""{_REPORT_SQL} SELECT
round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM cls), 6) AS accuracy,
round(avg(coalesce(2 * hit / nullif(pred + support, 0), 0)), 6) AS macro_f1,
CAST(sum(support) AS BIGINT) AS n_samples FROM c WHERE pred + support > 0""",
    "class_weights": """WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem
GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT label, n, round(total / (k * n), 6) AS balanced_weight,
round((total - n) / n, 6) AS others_ratio FROM c, t""",
    "resample_under": """WITH r AS (SELECT o_orderkey,
CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' ||
CAST(o_orderkey AS VARCHAR))) AS place FROM r),
s AS (SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM r GROUP BY label))
SELECT o_orderkey, label FROM p, s WHERE place <= smallest""",
    "resample_over": """WITH r AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END
AS label, count(*) AS n_different FROM orders GROUP BY 1)
SELECT label, (SELECT max(n_different) FROM r) AS n, n_different FROM r""",
    "preprocessed_vectors": _slots_sql(),
    "column_modes": f"""WITH {VISITS_SQL} {' UNION ALL '.join(
        f"SELECT '{c}' AS column, (SELECT {c} FROM visits WHERE {c} IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, count(DISTINCT {c}) AS n_distinct FROM visits"
        for c in ('race', 'age', 'insulin', 'glipizide'))}""".replace("AS column", 'AS "column"'),
    "decoded_predictions": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three'
  ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS label,
round(1.0 / (1.0 + exp(-(l_tax - l_discount))), 9) AS probability,
CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END AS as_int FROM lineitem""",
}
