"""Quality and profiling queries with their SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import presets
from cohortry.functions.features import binary_target, class_index
from cohortry.functions.tokens import finite, label_text
from cohortry.operators import quality as q
from cohortry.operators import schema as sc
from cohortry.plans.visits import INTAKE_SQL, VISITS_SQL, intake, table, visits

INTAKE_COLUMNS = ("encounter_id", "patient_nbr", "readmitted", "race", "gender", "age",
                  "discharge_disposition_id", "charge")
VISIT_COLUMNS = INTAKE_COLUMNS + (
    "time_in_hospital", "num_medications", "number_diagnoses", "num_lab_procedures",
    "number_outpatient", "number_emergency", "number_inpatient",
    "metformin", "insulin", "glipizide", "glyburide")
_TEXT = {"readmitted", "race", "gender", "age", "discharge_disposition_id", "metformin",
         "insulin", "glipizide", "glyburide"}


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def _rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# ------------------------------------------------------------------ missingness

def _missing_sql(source: str, columns) -> str:
    parts = []
    for i, c in enumerate(columns):
        text = c in _TEXT
        has = lambda cond: f"count(*) FILTER (WHERE {cond})" if text else "0"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS column_index, count(*) AS rows, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS standard_null_count, "
            f"{has(f'trim({c}) = $$?$$')} AS question_mark_count, "
            f"{has(f'{c} = $$$$')} AS empty_string_count, "
            f"{has(f'trim({c}) = $$$$ AND {c} <> $$$$')} AS whitespace_only_count FROM {source}")
    return (f"missing AS (SELECT *, standard_null_count + question_mark_count + "
            f"empty_string_count + whitespace_only_count AS missing_count FROM ("
            + " UNION ALL ".join(parts) + "))")


def missingness_by_column(spark, sf):
    return _rounded(q.missingness(visits(spark, sf)), "missing_rate")


def null_token_totals(spark, sf):
    return q.null_token_totals(visits(spark, sf))


def highly_missing_columns(spark, sf):
    return q.highly_missing(visits(spark, sf)).select("column", r6("missing_rate"))


def top_missing_columns(spark, sf):
    return (q.missingness(visits(spark, sf)).limit(20)
            .select("column", "missing_count", r6("missing_rate")))


def replaced_tokens(spark, sf):
    return q.replace_null_tokens(intake(spark, sf)).select(
        "encounter_id", "race", "readmitted", "discharge_disposition_id")


_MISSING = f"WITH {VISITS_SQL}, {_missing_sql('visits', VISIT_COLUMNS)} "
_RATE = "round(missing_count / rows, 6) AS missing_rate"


# ------------------------------------------------------------------ identifiers

def duplicate_rows(spark, sf):
    return q.duplicate_row_count(table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", "o_orderdate"))


def identifier_summary(spark, sf):
    return q.identifier_summary(intake(spark, sf))


def top_repeated_entities(spark, sf):
    return q.top_repeated_entities(intake(spark, sf))


def categorical_summary(spark, sf):
    return q.categorical_summary(visits(spark, sf))


_CATEGORICAL = [c for c in VISIT_COLUMNS if c in _TEXT]


def numeric_summary(spark, sf):
    found = q.numeric_summary(table(spark, sf, "lineitem"),
                              ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return _rounded(found, "mean", "std", "min", "p25", "p50", "p75", "max")


def _describe_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, "
        f"round(max({c})::DOUBLE, 6) AS max FROM {source}" for c in columns)


def value_distribution(spark, sf):
    return q.value_distribution(q.replace_null_tokens(intake(spark, sf)), "race")


# ----------------------------------------------------------------------- labels

def label_issues(spark, sf):
    """Race checked against a list that leaves some values out."""
    return q.label_issues(q.replace_null_tokens(intake(spark, sf)), "race",
                          ("1-URGENT", "9-NONE"))


def negative_values(spark, sf):
    return q.negative_counts(table(spark, sf, "customer"), ("c_acctbal", "c_nationkey"))


def labels_encoded(spark, sf):
    return intake(spark, sf).select(
        "encounter_id", binary_target("readmitted").cast("int").alias("readmitted_30d"),
        class_index("readmitted").cast("int").alias("class_index"))


def listed_with_defaults(spark, sf):
    return sc.select_with_defaults(sc.drop_present(intake(spark, sf), ["charge", "absent"]),
                                   ["encounter_id", "race", "weight", "payer_code"])


def json_safe_values(spark, sf):
    events = table(spark, sf, "events")
    odd = (F.when(F.col("event_type") == "error", F.lit(float("nan")))
           .when(F.col("event_type") == "click", F.lit(float("inf"))).otherwise(F.col("value")))
    return events.select("event_id", finite(odd).alias("value"))


# ------------------------------------------------------------------ whole results

def validation_report(spark, sf):
    return _rounded(q.validation_report(visits(spark, sf)), "value")


def preprocessing_summary(spark, sf):
    raw = intake(spark, sf)
    cleaned = q.replace_null_tokens(raw).withColumn("readmitted_30d", binary_target("readmitted"))
    return q.preprocessing_summary(raw, cleaned, sc.feature_candidacy(cleaned))


def data_dictionary(spark, sf):
    found = q.data_dictionary(intake(spark, sf), order_by="encounter_id")
    return found.select(
        "column_index", "column_name", "role", "dtype", "description", r6("missing_token_rate"), "non_null_count",
        "unique_count", F.array_join("example_values", "|").alias("example_values"),
        "is_identifier", "is_target", "is_medication", "is_diagnosis", "is_utilization")


def label_texts(spark, sf):
    return (intake(spark, sf).groupBy(label_text("readmitted").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


_ROLES = {"encounter_id": "identifier", "patient_nbr": "identifier", "readmitted": "target",
          "charge": "numeric"}


def _dictionary_sql() -> str:
    parts = []
    for i, c in enumerate(INTAKE_COLUMNS):
        text = f"CAST({c} AS VARCHAR)"
        role = _ROLES.get(c, "categorical")
        told = presets.COLUMN_DESCRIPTIONS.get(c, presets.ROLE_DESCRIPTIONS[role]).replace("'", "''")
        # The type as DuckDB names it, told in the other engine's words.
        dtype = (f"(SELECT CASE min(typeof({c})) WHEN 'VARCHAR' THEN 'string' ELSE "
                 f"lower(min(typeof({c}))) END FROM intake)")
        gone = f"({c} IS NULL OR trim({text}) IN ('', '?'))"
        parts.append(
            f"SELECT {i} AS column_index, '{c}' AS column_name, "
            f"'{role}' AS role, {dtype} AS dtype, '{told}' AS description, "
            f"round(count(*) FILTER (WHERE {gone}) / count(*), 6) AS missing_token_rate, "
            f"count({c}) AS non_null_count, count(DISTINCT {c}) AS unique_count, "
            f"(SELECT coalesce(string_agg(v, '|' ORDER BY first_seen), '') FROM (SELECT {text} AS v, "
            f"min(encounter_id) AS first_seen FROM intake WHERE NOT {gone} GROUP BY 1 "
            f"ORDER BY first_seen LIMIT 3)) AS example_values, "
            f"{_ROLES.get(c) == 'identifier'} AS is_identifier, {c == 'readmitted'} AS is_target, "
            f"false AS is_medication, false AS is_diagnosis, false AS is_utilization FROM intake")
    return f"WITH {INTAKE_SQL} " + " UNION ALL ".join(parts)


QUERIES = {f.__name__: f for f in (
    missingness_by_column, null_token_totals, highly_missing_columns, top_missing_columns,
    replaced_tokens, duplicate_rows, identifier_summary, top_repeated_entities,
    categorical_summary, numeric_summary, value_distribution, label_issues, negative_values,
    labels_encoded, listed_with_defaults, json_safe_values, validation_report,
    preprocessing_summary, data_dictionary, label_texts)}

ORACLES = {
    "missingness_by_column": f"{_MISSING} SELECT *, {_RATE} FROM missing",
    "null_token_totals": f"""{_MISSING}
SELECT CAST(sum(standard_null_count) AS BIGINT) AS standard_null_total,
       CAST(sum(question_mark_count) AS BIGINT) AS question_mark_total,
       CAST(sum(empty_string_count) AS BIGINT) AS empty_string_total,
       CAST(sum(whitespace_only_count) AS BIGINT) AS whitespace_only_total FROM missing""",
    "highly_missing_columns": f"""{_MISSING} SELECT "column", {_RATE} FROM missing
WHERE missing_count / rows >= 0.3""",
    "top_missing_columns": f"""{_MISSING} SELECT "column", missing_count, {_RATE} FROM missing
ORDER BY missing_count / rows DESC, column_index LIMIT 20""",
    "replaced_tokens": f"""WITH {INTAKE_SQL} SELECT encounter_id,
CASE WHEN trim(race) NOT IN ('', '?') THEN race END AS race, readmitted,
CASE WHEN discharge_disposition_id <> '?' THEN discharge_disposition_id END
  AS discharge_disposition_id FROM intake""",
    "duplicate_rows": """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus,
o_orderpriority, o_orderdate FROM orders)) AS duplicate_rows FROM orders""",
    "identifier_summary": """WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(o_orderkey) AS id_non_null_count, count(DISTINCT o_orderkey) AS id_unique_count,
count(*) - count(DISTINCT o_orderkey) AS id_duplicate_count,
count(DISTINCT o_orderkey) = count(o_orderkey) AS id_unique,
(SELECT count(*) FROM e) AS entity_unique_count,
(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM e WHERE n > 1) AS entity_repeated_row_count
FROM orders""",
    "top_repeated_entities": """SELECT o_custkey AS entity, count(*) AS row_count FROM orders
GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "categorical_summary": f"""WITH {VISITS_SQL}, cells AS ({' UNION ALL '.join(
        f"SELECT '{c}' AS column_name, {c} AS raw FROM visits" for c in _CATEGORICAL)}),
shown AS (SELECT column_name, CASE WHEN trim(coalesce(raw, '<NA>')) = '' THEN '<EMPTY>'
          ELSE trim(coalesce(raw, '<NA>')) END AS value, count(*) AS n FROM cells GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)
           AS position FROM shown),
u AS (SELECT column_name, count(DISTINCT raw) AS unique_non_null_count FROM cells GROUP BY 1)
SELECT column_name AS "column", unique_non_null_count, CAST(position AS INTEGER) AS position,
value, n FROM ranked JOIN u USING (column_name) WHERE position <= 5""",
    "numeric_summary": _describe_sql("lineitem", ("l_quantity", "l_extendedprice", "l_discount",
                                                  "l_linenumber")),
    "value_distribution": f"""WITH {INTAKE_SQL} SELECT CASE WHEN trim(race) NOT IN ('', '?')
THEN trim(race) ELSE '<NA>' END AS value, count(*) AS n FROM intake GROUP BY 1""",
    "label_issues": f"""WITH {INTAKE_SQL}, seen AS (SELECT CASE WHEN trim(race) NOT IN ('', '?')
THEN trim(race) END AS label, count(*) AS n FROM intake GROUP BY 1)
SELECT CASE WHEN label IS NULL THEN 'missing' ELSE 'unexpected' END AS issue, label, n FROM seen
WHERE label IS NULL OR label NOT IN ('1-URGENT', '9-NONE')
UNION ALL SELECT 'absent', a, 0 FROM (VALUES ('1-URGENT'), ('9-NONE')) t(a)
WHERE a NOT IN (SELECT label FROM seen WHERE label IS NOT NULL)""",
    "negative_values": """SELECT 'c_acctbal' AS "column",
count(*) FILTER (WHERE c_acctbal < 0) AS negative_count FROM customer
UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey < 0) FROM customer""",
    "labels_encoded": """SELECT o_orderkey AS encounter_id,
CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS readmitted_30d,
CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS class_index FROM orders""",
    "listed_with_defaults": f"""WITH {INTAKE_SQL} SELECT encounter_id, race,
CAST(NULL AS VARCHAR) AS weight, CAST(NULL AS VARCHAR) AS payer_code FROM intake""",
    "json_safe_values": """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click')
THEN value END AS value FROM events""",
    "validation_report": f"""{_MISSING}, ids AS (SELECT encounter_id, count(*) AS n FROM visits
GROUP BY 1)
{' UNION ALL '.join(f"SELECT 'required_column' AS rule, '{c}' AS subject, 1.0::DOUBLE AS value, "
                    "false AS violated" for c in presets.REQUIRED_COLUMNS)}
UNION ALL SELECT 'duplicate_rows', '*', d, d > 0 FROM (SELECT (SELECT count(*) FROM visits) -
  (SELECT count(*) FROM (SELECT DISTINCT * FROM visits)) AS d)
UNION ALL SELECT 'question_mark_tokens', '*', t, t > 0
  FROM (SELECT sum(question_mark_count) AS t FROM missing)
UNION ALL SELECT 'high_missingness', "column", round(missing_count / rows, 6),
  missing_count / rows >= 0.3 FROM missing
{' '.join(f"UNION ALL SELECT 'negative_values', '{c}', count(*) FILTER (WHERE {c} < 0), "
          f"count(*) FILTER (WHERE {c} < 0) > 0 FROM visits" for c in presets.COUNT_COLUMNS)}
UNION ALL SELECT 'id_not_unique', 'encounter_id', r, r > 0 FROM (SELECT coalesce(sum(n - 1), 0)
  AS r FROM ids)""",
    "preprocessing_summary": f"""WITH {INTAKE_SQL}, {_missing_sql('intake', INTAKE_COLUMNS)},
n AS (SELECT count(*) AS n FROM intake)
SELECT 'shape_original' AS section, 'rows' AS subject, n AS value FROM n
UNION ALL SELECT 'shape_original', 'columns', 8
UNION ALL SELECT 'shape_preprocessed', 'rows', n FROM n
UNION ALL SELECT 'shape_preprocessed', 'columns', 9
UNION ALL SELECT 'missing_before', "column", missing_count FROM missing
UNION ALL SELECT 'missing_after', "column", missing_count FROM missing
UNION ALL SELECT 'missing_after', 'readmitted_30d', 0
UNION ALL SELECT 'distribution_readmitted', trim(readmitted), count(*) FROM intake GROUP BY ALL
UNION ALL SELECT 'distribution_readmitted_30d',
  CASE WHEN trim(readmitted) = '<30' THEN '1' ELSE '0' END, count(*) FROM intake GROUP BY ALL
UNION ALL SELECT * FROM (VALUES ('identifier_column', 'encounter_id', 0),
  ('identifier_column', 'patient_nbr', 1), ('target_column', 'readmitted', 0),
  ('target_column', 'readmitted_30d', 1), ('excluded_column', 'encounter_id', 0),
  ('excluded_column', 'patient_nbr', 1), ('candidate_column', 'race', 0),
  ('candidate_column', 'gender', 1), ('candidate_column', 'age', 2),
  ('candidate_column', 'discharge_disposition_id', 3), ('candidate_column', 'charge', 4)) t""",
    "data_dictionary": _dictionary_sql(),
    "label_texts": f"""WITH {INTAKE_SQL} SELECT trim(readmitted) AS label, count(*) AS n
FROM intake GROUP BY 1""",
}
