"""The prediction log (JSON lines) and request payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import presets
from cohortry.functions.scoring import prediction_to_int
from cohortry.functions.tokens import finite, is_numeric, optional_text, quoted

_RUNTIME = "map<string,struct<device:string,used_fallback:boolean>>"
_MODEL = "struct<model_family:string,training_timestamp_utc:string,feature_count:int>"


def log_schema(inputs: dict[str, str] | None = None) -> T.StructType:
    """Schema of a log record; ``inputs`` gives name -> type of the model inputs."""
    named = inputs or {c: "double" for c in presets.MONITORED_COLUMNS}
    selected = ",".join(f"`{n}`:{t}" for n, t in named.items())
    return T.StructType.fromDDL(
        f"timestamp_utc timestamp, prediction_source string, selected_inputs struct<{selected}>, "
        "binary_prediction int, binary_probability double, multiclass_prediction string, "
        f"multiclass_probabilities map<string,double>, inference_runtime {_RUNTIME}, "
        f"model_version struct<binary_model:{_MODEL},multiclass_model:{_MODEL}>, "
        "true_label string, true_label_30d int")


def json_value(df: DataFrame, name: str) -> Column:
    """The column fit for JSON: numbers as finite doubles, all else as text."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return finite(quoted(name).cast("double"))
    return quoted(name).cast("double") if is_numeric(data_type) else quoted(name).cast("string")


def prediction_records(scored: DataFrame, selected_inputs=presets.MONITORED_COLUMNS,
                       source: str = "monitoring_batch", true_label: str | None = None,
                       true_binary_label: str | None = None,
                       versions: dict[str, dict] | None = None) -> DataFrame:
    """Log records of a table scored by both models.

    Expects ``binary_raw`` (the predicted class), ``binary_probability``,
    ``multiclass_prediction`` and ``multiclass_probabilities``. Scores stay on
    their row, so nothing has to be aligned.
    """
    present = [c for c in selected_inputs if c in scored.columns]
    versions = versions or {}

    def version(name: str) -> Column:
        v = versions.get(name, {})
        return F.struct(
            F.lit(v.get("model_family")).cast("string").alias("model_family"),
            F.lit(v.get("training_timestamp_utc")).cast("string").alias("training_timestamp_utc"),
            F.lit(v.get("feature_count")).cast("int").alias("feature_count")).alias(name)

    def runtime(name: str) -> Column:
        v = versions.get(name, {})
        return F.struct(F.lit(v.get("device")).cast("string").alias("device"),
                        F.lit(v.get("used_fallback")).cast("boolean").alias("used_fallback"))

    label = (quoted(true_label).cast("string") if true_label in scored.columns
             else F.lit(None).cast("string"))
    binary = (quoted(true_binary_label).cast("int") if true_binary_label in scored.columns
              else F.lit(None).cast("int"))
    return scored.select(
        F.current_timestamp().alias("timestamp_utc"), F.lit(source).alias("prediction_source"),
        F.struct(*[json_value(scored, c).alias(c) for c in present]).alias("selected_inputs"),
        prediction_to_int(F.col("binary_raw")).alias("binary_prediction"),
        finite(F.col("binary_probability")).alias("binary_probability"),
        F.col("multiclass_prediction").cast("string").alias("multiclass_prediction"),
        F.transform_values("multiclass_probabilities", lambda _, p: finite(p))
         .alias("multiclass_probabilities"),
        F.create_map(F.lit("binary_model"), runtime("binary_model"),
                     F.lit("multiclass_model"), runtime("multiclass_model"))
         .alias("inference_runtime"),
        F.struct(version("binary_model"), version("multiclass_model")).alias("model_version"),
        label.alias("true_label"), binary.alias("true_label_30d"))


def write_log(records: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines in gzip files, a file per task: every record repeats all field names.
    Logs with plain files, or both kinds, are read alike."""
    records.write.mode("append" if append else "overwrite").json(path, compression="gzip")


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Log records; blank lines are skipped, an absent log has no rows."""
    schema = schema or log_schema()
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def selected_inputs(records: DataFrame) -> DataFrame:
    """The logged model inputs as columns; records without inputs left out."""
    return records.where("selected_inputs IS NOT NULL").select("selected_inputs.*")


# --------------------------------------------------------------------- payloads

def payload_rows(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Rows of request payloads: ``{"features": {...}}`` or ``{"rows": [...]}``.

    A payload that holds neither yields no row.
    """
    row = "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">"
    parsed = F.from_json(quoted(column), f"features {row}, rows array<{row}>")
    single = F.when(F.col("_p.features").isNotNull(), F.array("_p.features"))
    return (df.withColumn("_p", parsed)
            .withColumn("_row", F.explode(F.coalesce("_p.rows", single)))
            .where("_row IS NOT NULL")
            .select(*[c for c in map(quoted, df.columns)], "_row.*"))


def typed_inputs(df: DataFrame, integers=presets.INTEGER_INPUTS,
                 floats=presets.FLOAT_INPUTS) -> DataFrame:
    """Raw inputs in their declared types; blank text and "(missing)" become null."""
    def typed(field: T.StructField) -> Column:
        column = quoted(field.name)
        if field.name in integers:
            return column.try_cast("long")
        if field.name in floats:
            return column.try_cast("double")
        if isinstance(field.dataType, T.StringType):
            return optional_text(column)
        return column

    return df.select(*[typed(f).alias(f.name) for f in df.schema.fields])
