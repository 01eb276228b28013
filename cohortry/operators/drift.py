"""Drift between a reference and a current table, and the monitoring summary.

Quantile borders of the reference are a few constants; both tables are then
read once, every row is binned by comparisons with those constants, and counts
per (feature, bin) are combined before the shuffle. The result tables have one
row per feature and bin, whatever the tables hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.text import psi_band
from cohortry.functions.tokens import finite, finite_sql, number_sql, quoted, sql_double
from cohortry.operators.quantiles import exact_quantiles
from cohortry.sources.scratch import settle

SMALLEST_SHARE = 1e-6


def quantile_edges(reference: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantile borders of each reference column."""
    step = 1.0 / bins
    shares = [j * step for j in range(bins)] + [1.0]
    return {c: sorted(set(q)) if q else []
            for c, q in exact_quantiles(reference, columns, shares).items()}


def _bin_sql(value: str, edges: list[float]) -> str:
    """Bin number; the outermost bins are open, so no value falls outside."""
    steps = [f"CAST({value} >= {sql_double(e)} AS INT)" for e in edges[1:-1]]
    return f"CASE WHEN {finite_sql(value)} IS NOT NULL THEN {' + '.join(steps or ['0'])} END"


def _numbers(df: DataFrame, features: list[str], current: bool) -> DataFrame:
    return df.selectExpr(f"{current} AS is_current",
                         *[f"{number_sql(df, f)} AS x{i}" for i, f in enumerate(features)])


def value_edges(reference: DataFrame, columns: list[str], most: int = 50) -> dict[str, list[float]]:
    """Borders that give every reference value a bin of its own, for columns of
    few values such as 0 and 1. A column with more than ``most`` values is an
    error: quantile bins are for those."""
    out = {}
    for c in columns:
        found = sorted(r[0] for r in reference.selectExpr(f"{finite_sql(c)} AS v")
                       .where("v IS NOT NULL").distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"more than {most} values; use quantile bins")
        middles = [(a + b) / 2 for a, b in zip(found, found[1:])]
        out[c] = [found[0], *middles, found[-1]] if len(found) > 1 else found
    return out


def feature_bins(reference: DataFrame, current: DataFrame, features: list[str],
                 bins: int | None = 10) -> DataFrame:
    """Counts and sums per feature and bin of both tables; empty bins included.

    ``bin`` is null for values that are infinite: they count, but have no bin.
    Without ``bins`` every value of the reference has its own.
    """
    spark = reference.sparkSession
    base, new = _numbers(reference, features, False), _numbers(current, features, True)
    columns = base.columns[1:]
    edges = quantile_edges(base, columns, bins) if bins else value_edges(base, columns)
    structs = [f"struct({i} AS feature_index, {c} AS x, {_bin_sql(c, edges[c])} AS bin)"
               for i, c in enumerate(columns)]
    cells = base.unionByName(new).selectExpr(
        "is_current", f"inline(array({', '.join(structs)}))").where("x IS NOT NULL")
    now, then = F.col("is_current"), ~F.col("is_current")
    # Everything after this is some rows per feature: written once, read often.
    counted = settle(cells.groupBy("feature_index", "bin").agg(
        F.count_if(then).alias("reference_n"), F.count_if(now).alias("current_n"),
        F.sum(F.when(then, F.col("x"))).alias("reference_sum"),
        F.sum(F.when(now, F.col("x"))).alias("current_sum")))
    places = [(i, features[i], b, len(edges[c])) for i, c in enumerate(columns)
              for b in [None, *range(max(1, len(edges[c]) - 1))]]
    grid = spark.createDataFrame(places, "feature_index int, feature string, bin int, n_edges int")
    same = (F.col("g.feature_index") == F.col("c.feature_index")) & F.col("g.bin").eqNullSafe(
        F.col("c.bin"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return grid.alias("g").join(counted.alias("c"), same, "left").select(
        "feature", "g.bin", "n_edges", n("reference_n"), n("current_n"),
        "reference_sum", "current_sum")


def _psi_per_feature(counts: DataFrame) -> DataFrame:
    binned = F.col("bin").isNotNull()
    in_bins = lambda c: F.sum(F.when(binned, F.col(c)).otherwise(F.lit(0)))
    totals = counts.groupBy("feature").agg(
        in_bins("reference_n").alias("reference_finite"),
        in_bins("current_n").alias("current_finite"),
        F.sum("reference_n").alias("reference_count"), F.sum("current_n").alias("current_count"),
        F.sum("reference_sum").alias("reference_total"),
        F.sum("current_sum").alias("current_total"))
    share = lambda n, total: F.greatest(
        F.col(n) / F.greatest(F.col(total), F.lit(1)), F.lit(SMALLEST_SHARE))
    r, c = share("reference_n", "reference_finite"), share("current_n", "current_finite")
    term = F.when(binned & (F.col("n_edges") > 1), (c - r) * F.ln(c / r))
    one_side_empty = (F.col("reference_finite") == 0) | (F.col("current_finite") == 0)
    summed = counts.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.coalesce(F.sum(term), F.lit(0.0)).alias("raw_psi"))
    return (summed.join(totals, "feature")
            .withColumn("psi", F.when(~one_side_empty, F.col("raw_psi"))))


def psi(reference: DataFrame, current: DataFrame, features: list[str],
        bins: int | None = 10) -> DataFrame:
    """Population stability index per feature, null when a side has no value."""
    counts = feature_bins(reference, current, features, bins)
    return _psi_per_feature(counts).select("feature", "psi")


def drift_summary(reference: DataFrame, current: DataFrame, features=presets.MONITORED_COLUMNS,
                  min_sample_size: int = 50, bins: int = 10) -> DataFrame:
    """Status, PSI, counts, means and mean shift per feature, highest PSI first.

    Features that a table lacks are left out; ``drift_warnings`` names them.
    """
    shared = [f for f in features if f in reference.columns and f in current.columns]
    if not shared:
        return reference.sparkSession.createDataFrame([], (
            "feature string, status string, psi double, reference_count long, "
            "current_count long, reference_mean double, current_mean double, "
            "absolute_mean_shift double"))
    found = _psi_per_feature(feature_bins(reference, current, shared, bins))
    enough = F.least("reference_count", "current_count") >= min_sample_size
    when_enough = lambda c: F.when(enough, c)
    before = F.col("reference_total") / F.nullif(F.col("reference_count"), F.lit(0))
    after = F.col("current_total") / F.nullif(F.col("current_count"), F.lit(0))
    return found.select(
        "feature",
        F.when(enough, psi_band(F.col("psi"))).otherwise(F.lit("insufficient_data"))
         .alias("status"),
        when_enough(F.col("psi")).alias("psi"), "reference_count", "current_count",
        when_enough(before).alias("reference_mean"), when_enough(after).alias("current_mean"),
        when_enough(F.abs(after - before)).alias("absolute_mean_shift"),
    ).orderBy(F.desc_nulls_last("psi"), "feature")


def drift_warnings(summary: DataFrame, features, reference: DataFrame,
                   current: DataFrame) -> DataFrame:
    """Rows (warning, subject, detail) on absent columns and small samples."""
    absent = [("missing_feature", f, "missing from reference or current table")
              for f in features if f not in reference.columns or f not in current.columns]
    shape = "warning string, subject string, detail string"
    small = summary.where("status = 'insufficient_data'").select(
        F.lit("insufficient_sample").alias("warning"), F.col("feature").alias("subject"),
        F.format_string("reference=%d, current=%d", "reference_count", "current_count")
         .alias("detail"))
    return summary.sparkSession.createDataFrame(absent, shape).unionByName(small)


def probability_summary(df: DataFrame, column: str = "binary_probability") -> DataFrame:
    """count, mean, population std, min, max, p10, p50, p90; non-finite left out."""
    from_number = finite(quoted(column).cast("double"))
    values = df.select(from_number.alias("p"))
    p10, p50, p90 = exact_quantiles(values, ["p"], (0.1, 0.5, 0.9))["p"] or (None, None, None)
    cut = lambda v, s: F.lit(v).cast("double").alias(s)
    return values.agg(
        F.count("p").alias("count"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"),
        F.min("p").alias("min"), F.max("p").alias("max")).select(
        "*", cut(p10, "p10"), cut(p50, "p50"), cut(p90, "p90"))


def probability_drift(reference: DataFrame | None, current: DataFrame,
                      column: str = "binary_probability", min_sample_size: int = 50,
                      bins: int = 10) -> DataFrame:
    """Status and PSI of the scores, in the shape of ``drift_summary``."""
    if reference is None:
        return current.sparkSession.createDataFrame(
            [("unavailable", None, None, None)],
            "status string, psi double, reference_count long, current_count long")
    only = lambda df: df.select(finite(quoted(column).cast("double")).alias(column))
    return drift_summary(only(reference), only(current), [column], min_sample_size, bins).select(
        "status", "psi", "reference_count", "current_count")


def prediction_distribution(records: DataFrame, columns=(
        "binary_prediction", "multiclass_prediction")) -> DataFrame:
    """Count and rate per predicted class and model; a missing one is ``unknown``."""
    cells = F.array(*[F.struct(F.lit(c).alias("model_output"), F.coalesce(
        quoted(c).cast("string"), F.lit("unknown")).alias("label")) for c in columns])
    counts = settle(records.select(F.inline(cells)).groupBy("model_output", "label").agg(
        F.count(F.lit(1)).alias("n")))
    # One row per output: every record has a label for each of them.
    totals = counts.groupBy("model_output").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "model_output").select(
        "model_output", "label", "n", (F.col("n") / F.col("total")).alias("rate"))


def label_availability(records: DataFrame, label: str = "true_label",
                       binary_label: str = "true_label_30d") -> DataFrame:
    count = lambda c: F.count(quoted(c)) if c in records.columns else F.lit(0).cast("long")
    none = (F.col("true_label_count") == 0) & (F.col("true_label_30d_count") == 0)
    return records.agg(F.count(F.lit(1)).alias("n_records"), count(label).alias("true_label_count"),
                       count(binary_label).alias("true_label_30d_count")).select(
        "n_records", "true_label_count", "true_label_30d_count",
        (~none).alias("labels_available"),
        F.when(none, F.lit("unavailable"))
         .otherwise(F.lit("labels_present_but_not_scored_in_this_report"))
         .alias("performance_monitoring"))


def inference_runtime(records: DataFrame, versions: DataFrame,
                      order_by: str = "timestamp_utc") -> DataFrame:
    """Runtime per model: from the earliest record that has one, else from the
    model's own row.

    ``records.inference_runtime`` maps a model name to a struct (device,
    used_fallback); ``versions`` has one row per model.
    """
    # The log's model names are free text: only those of known models count, so
    # the table of first records is as small as that of the models.
    per_model = records.select(F.col(order_by).alias("_at"), F.explode("inference_runtime")
                               .alias("model", "runtime")).join(
        versions.select("model"), "model", "left_semi")
    first = per_model.where("runtime.device IS NOT NULL").groupBy("model").agg(
        F.min_by("runtime", F.struct("_at", "runtime")).alias("runtime"))
    moved = (F.col("training_device") == "cuda") & (F.col("inference_device") == "cpu")
    stored = F.coalesce("fallback_path", moved, F.lit(False))
    return versions.join(first, "model", "left").select(
        "model", "device_requested", "training_device",
        F.coalesce("runtime.device", "inference_device").alias("inference_device"),
        F.coalesce("runtime.used_fallback", stored).alias("used_fallback"),
        F.col("runtime.device").alias("record_device"),
        F.col("runtime.used_fallback").alias("record_fallback"),
        F.col("inference_device").alias("metadata_device"), stored.alias("metadata_fallback"))


def _facts(table: DataFrame, section: str, subject: str | None, numbers: list[str],
           texts: list[str] = ()) -> DataFrame:
    """A wide result as rows (section, subject, metric, value, text)."""
    cells = [f"struct('{c}' AS metric, CAST({c} AS DOUBLE) AS value, CAST(NULL AS STRING) AS text)"
             for c in numbers]
    cells += [f"struct('{c}' AS metric, CAST(NULL AS DOUBLE) AS value, CAST({c} AS STRING) AS text)"
              for c in texts]
    name = f"CAST({subject} AS STRING)" if subject else "'*'"
    return table.selectExpr(f"'{section}' AS section", f"{name} AS subject",
                            f"inline(array({', '.join(cells)}))")


def monitoring_summary(records: DataFrame, reference: DataFrame | None,
                       current: DataFrame | None, versions: DataFrame | None = None,
                       features=presets.MONITORED_COLUMNS,
                       reference_scores: DataFrame | None = None,
                       min_sample_size: int = 50, bins: int = 10) -> DataFrame:
    """The whole monitoring result as rows (section, subject, metric, value, text)."""
    spark = records.sparkSession
    warnings = []
    shape = "warning string, subject string, detail string"
    one = lambda *row: spark.createDataFrame([row], shape)
    parts = [
        _facts(probability_summary(records), "binary_probability_summary", None,
               ["count", "mean", "std", "min", "max", "p10", "p50", "p90"]),
        _facts(prediction_distribution(records).select(
            F.concat_ws(":", "model_output", "label").alias("class"), "n", "rate"),
            "prediction_distribution", "class", ["n", "rate"]),
    ]
    score_drift = settle(probability_drift(reference_scores, records,
                                           min_sample_size=min_sample_size, bins=bins))
    parts.append(_facts(score_drift, "binary_probability_drift", None,
                        ["psi", "reference_count", "current_count"], ["status"]))
    if reference_scores is None:
        warnings.append(one("no_reference_scores", "*", "probability drift skipped"))
    else:
        warnings.append(score_drift.where("status = 'insufficient_data'").select(
            F.lit("insufficient_sample").alias("warning"),
            F.lit("binary_probability").alias("subject"),
            F.format_string("reference=%d, current=%d", "reference_count", "current_count")
             .alias("detail")))
    sizes = [("prediction_records", records), ("reference_rows", reference),
             ("current_feature_rows", current)]
    for name, table in sizes:
        count = (table.agg(F.count(F.lit(1)).alias("n")) if table is not None
                 else spark.createDataFrame([(0,)], "n long"))
        parts.append(_facts(count.withColumn("what", F.lit(name)), "sample_sizes", "what", ["n"]))
    if reference is None or current is None:
        warnings.append(one("no_feature_table", "*", "feature drift checks skipped"))
    elif reference.isEmpty() or current.isEmpty():
        warnings.append(one("empty_feature_table", "*", "feature drift checks skipped"))
    else:
        drift = settle(drift_summary(reference, current, features, min_sample_size, bins))
        parts.append(_facts(drift, "feature_drift", "feature",
                            ["psi", "reference_count", "current_count", "reference_mean",
                             "current_mean", "absolute_mean_shift"], ["status"]))
        warnings.append(drift_warnings(drift, features, reference, current))
    labels = settle(label_availability(records))
    parts.append(_facts(labels, "label_monitoring", None,
                        ["true_label_count", "true_label_30d_count"],
                        ["labels_available", "performance_monitoring"]))
    warnings.append(labels.where(~F.col("labels_available")).select(
        F.lit("no_labels").alias("warning"), F.lit("*").alias("subject"),
        F.lit("live performance monitoring is not computed").alias("detail")))
    warnings.append(labels.where(F.col("n_records") < min_sample_size).select(
        F.lit("few_records").alias("warning"), F.lit("*").alias("subject"),
        F.format_string("records=%d, recommended=%d", "n_records", F.lit(min_sample_size))
         .alias("detail")))
    if versions is not None:
        runtime = settle(inference_runtime(records, versions))
        parts.append(_facts(runtime, "inference_runtime", "model", [],
                            ["device_requested", "training_device", "inference_device",
                             "used_fallback"]))
        warnings.append(runtime.where("used_fallback").select(
            F.lit("fallback_inference").alias("warning"), F.col("model").alias("subject"),
            F.lit("inference uses the CPU-compatible path").alias("detail")))
        warnings.append(runtime.where(
            "device_requested = 'cuda' AND training_device IS DISTINCT FROM 'cuda'").select(
            F.lit("device_not_used").alias("warning"), F.col("model").alias("subject"),
            F.concat(F.lit("training used "), F.coalesce("training_device", F.lit("none")))
             .alias("detail")))
    noted = reduce(DataFrame.unionByName, warnings).select(
        F.lit("warning").alias("section"), "subject", F.col("warning").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.col("detail").alias("text"))
    return reduce(DataFrame.unionByName, [*parts, noted])
