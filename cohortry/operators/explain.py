"""Feature contributions and explanations of scored rows."""

from __future__ import annotations

from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions import text as tx
from cohortry.functions.tokens import quoted
from cohortry.operators.metrics import roc_auc
from cohortry.operators.schema import clamp_top_n
from cohortry.operators.hashrank import prefix_digits
from cohortry.operators.shadow import with_shadow
from cohortry.sources.scratch import settle


#: Said of a row whose contributions cannot be used.
UNAVAILABLE = "Per-row contribution analysis unavailable"


def slot_means(vectors: DataFrame, column: str = "features") -> list[float]:
    """Mean of every vector slot: one row, as long as the vector."""
    return vectors.select(Summarizer.mean(F.col(column))).first()[0].toArray().tolist()


def linear_contributions(vectors: DataFrame, coefficients: list[float], means: list[float],
                         names: list[str], column: str = "features") -> DataFrame:
    """Per row the contribution coefficient * (value - mean) of every slot, an
    array of (feature, contribution) in slot order. Exact for linear models."""
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    centred = F.zip_with(vector_to_array(column), numbers(means), lambda x, m: x - m)
    parts = F.zip_with(centred, numbers(coefficients), lambda x, c: x * c)
    named = F.zip_with(F.array(*[F.lit(n) for n in names]), parts, lambda n, p: F.struct(
        n.alias("feature"), p.alias("contribution")))
    return vectors.withColumn("contributions", named)


def top_contributions(contributions: Column, n: int = 10) -> Column:
    """The n contributions largest by absolute value, per row; the earlier slot
    wins a tie. Structs are sorted by their fields, without a comparator."""
    keyed = F.transform(contributions, lambda c, i: F.struct(
        (-F.abs(c["contribution"])).alias("size"), i.alias("slot"), c.alias("part")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k["part"])


def mean_abs_contributions(rows: DataFrame, top_n: int = 25) -> DataFrame:
    """Mean absolute contribution per feature over all rows, largest first; for
    contributions that exist as an array per row."""
    return (rows.select(F.inline("contributions")).groupBy("feature")
            .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), "feature").limit(top_n))


def mean_abs_linear(vectors: DataFrame, coefficients: list[float], means: list[float],
                    names: list[str], top_n: int = 25, column: str = "features") -> DataFrame:
    """``mean_abs_contributions`` of a linear model in one tree aggregation of
    vectors: nothing is exploded and nothing is sent but one vector per task."""
    shift = array_to_vector(F.zip_with(vector_to_array(column), F.array(*[
        F.lit(float(m)) for m in means]), lambda x, m: x - m))
    centre = vectors.select(shift.alias("_centred"))
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(coefficients), inputCol="_centred",
                               outputCol="_parts")
    norm, n = weigh.transform(centre).select(
        Summarizer.metrics("normL1", "count").summary(F.col("_parts")).alias("s")
    ).select("s.normL1", "s.count").first()
    table = vectors.sparkSession.createDataFrame(
        [(name, float(v) / max(n, 1)) for name, v in zip(names, norm)],
        "feature string, mean_abs_contribution double")
    return table.orderBy(F.desc("mean_abs_contribution"), "feature").limit(top_n)


def tree_importances(model, names: list[str], spark, top_n: int = 25) -> DataFrame:
    """Impurity importances of a fitted tree model."""
    values = model.featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top_n)


def permutation_importance(model, df: DataFrame, columns: list[str], key: str,
                           score_rows, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Loss of ROC AUC when a column takes the values of other rows.

    ``score_rows(model, df)`` gives rows with ``label`` and ``positive_share``.
    Works for any model; one scoring pass per column.
    """
    def auc(table: DataFrame) -> float:
        scored = score_rows(model, table)
        rows = settle(scored.select("label", F.col("positive_share").alias("score")))
        return roc_auc(rows).first()["roc_auc"]

    digits = digits or prefix_digits(df.count())
    whole = auc(df)
    losses = []
    for i, name in enumerate(columns):
        mixed = with_shadow(df, key, seed + i, name, digits)
        swapped = mixed.withColumn(name, F.col("shadow")).drop("shadow")
        losses.append((name, whole - auc(swapped)))
    table = df.sparkSession.createDataFrame(losses, "feature string, auc_loss double")
    return table.orderBy(F.desc("auc_loss"), "feature")


def explain_rows(df: DataFrame, top_n: int = 3, contributions: str | None = None,
                 features=presets.ENGINEERED_FEATURES) -> DataFrame:
    """Scored rows with summary, raising and lowering factors, text and mode.

    Needs ``binary_prediction``, ``binary_probability``, ``multiclass_prediction``
    and ``multiclass_probabilities``. Signed contributions are used where a row
    has any; otherwise threshold rules on the engineered features are. The row's
    ``warnings`` say where its contributions are absent or not finite.
    """
    n = clamp_top_n(top_n)
    present = {f: quoted(f).cast("double") for f in features if f in df.columns}
    raising, lowering = tx.rule_factors(present, n)
    warnings = F.array().cast("array<string>")
    if contributions:
        parts = quoted(contributions)
        broken = F.exists(parts, lambda c: F.isnan(c["contribution"])
                          | (F.abs(c["contribution"]) == float("inf")))
        usable = parts.isNotNull() & ~broken
        warnings = F.when(usable, warnings).otherwise(F.array(F.lit(UNAVAILABLE)))
        df = df.withColumn(contributions, F.when(usable, parts))
        # Only the strongest contributions of a row are looked at.
        strongest = top_contributions(quoted(contributions), 2 * n)
        up, down = tx.contribution_factors(strongest, n)
        any_sign = F.coalesce((F.size(up) > 0) | (F.size(down) > 0), F.lit(False))
        or_note = lambda xs, note: F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit(note)))
        raising = F.when(any_sign, or_note(up, tx.NO_POSITIVE)).otherwise(raising)
        lowering = F.when(any_sign, or_note(down, tx.NO_NEGATIVE)).otherwise(lowering)
    summary = tx.prediction_summary(
        F.col("binary_prediction"), F.col("binary_probability"),
        F.col("multiclass_prediction"), F.col("multiclass_probabilities"))
    named = df.withColumns({"prediction_summary": summary, "raising_factors": raising,
                            "lowering_factors": lowering})
    return named.withColumns({
        "explanation_text": tx.explanation_text(
            F.col("prediction_summary"), F.col("raising_factors"), F.col("lowering_factors")),
        "explanation_mode": F.lit("fallback"), "warnings": warnings,
        "risk_band": tx.risk_band(F.col("binary_probability"))})
