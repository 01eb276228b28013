"""Visit tables derived from the star-schema test tables.

``intake`` is the orders table seen as raw visit rows, null-like tokens
included: a priority of "4-NOT SPECIFIED" is written as ``?`` and so on.
``visits`` adds counts and statuses from the order's lines. The SQL texts say
the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_LINES = {"metformin": 1, "insulin": 2, "glipizide": 3, "glyburide": 4}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _label(status: Column) -> Column:
    return (F.when(status == "O", F.lit(" NO")).when(status == "P", F.lit(">30"))
            .otherwise(F.lit("<30 ")))


def intake(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    low = (F.floor(price / F.lit(50000.0)) * 10).cast("string")
    high = (F.floor(price / F.lit(50000.0)) * 10 + 10).cast("string")
    return orders.select(
        F.col("o_orderkey").alias("encounter_id"),
        F.col("o_custkey").alias("patient_nbr"),
        _label(F.col("o_orderstatus")).alias("readmitted"),
        F.when(priority == "4-NOT SPECIFIED", F.lit("?")).when(priority == "5-LOW", F.lit("  "))
         .when(priority == "3-MEDIUM", F.lit("")).otherwise(priority).alias("race"),
        F.when(price < 250000.0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        F.when((F.col("o_orderstatus") == "P") & (priority == "1-URGENT"), F.lit("unknown"))
         .otherwise(F.concat(F.lit("["), low, F.lit("-"), high, F.lit(")"))).alias("age"),
        F.when(priority == "4-NOT SPECIFIED", F.lit("?"))
         .otherwise(F.dayofmonth("o_orderdate").cast("string")).alias("discharge_disposition_id"),
        price.alias("charge"))


INTAKE_SQL = """
intake AS (
  SELECT o_orderkey AS encounter_id, o_custkey AS patient_nbr,
         CASE o_orderstatus WHEN 'O' THEN ' NO' WHEN 'P' THEN '>30' ELSE '<30 ' END AS readmitted,
         CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '?' WHEN '5-LOW' THEN '  '
              WHEN '3-MEDIUM' THEN '' ELSE o_orderpriority END AS race,
         CASE WHEN o_totalprice < 250000 THEN 'Female' ELSE 'Male' END AS gender,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'unknown'
              ELSE '[' || CAST(CAST(floor(o_totalprice / 50000) * 10 AS BIGINT) AS VARCHAR) || '-'
                   || CAST(CAST(floor(o_totalprice / 50000) * 10 + 10 AS BIGINT) AS VARCHAR) || ')'
              END AS age,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '?'
              ELSE CAST(day(o_orderdate) AS VARCHAR) END AS discharge_disposition_id,
         o_totalprice AS charge
  FROM orders)"""


# Statuses in the order of their text: the largest is kept as a number, which
# hashes, where the largest text would need a sort.
STATUSES = ("Down", "No", "Up", "steady ")


def _status(line: int) -> Column:
    place = (F.when(F.col("l_returnflag") == "A", F.lit(2))
             .when(F.col("l_returnflag") == "N", F.lit(4))
             .when(F.col("l_linestatus") == "F", F.lit(3)).otherwise(F.lit(1)))
    return F.max(F.when(F.col("l_linenumber") == line, place))


def line_facts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    facts = lines.groupBy(F.col("l_orderkey").alias("encounter_id")).agg(
        F.count(F.lit(1)).alias("time_in_hospital"),
        F.sum("l_quantity").cast("long").alias("num_medications"),
        F.max("l_linenumber").cast("long").alias("number_diagnoses"),
        F.count_if(F.col("l_tax") >= 0.04).alias("num_lab_procedures"),
        F.count_if(F.col("l_discount") > 0.05).alias("number_outpatient"),
        F.count_if(F.col("l_returnflag") == "R").alias("number_emergency"),
        F.count_if(F.col("l_linestatus") == "F").alias("number_inpatient"),
        *[_status(line).alias(name) for name, line in STATUS_LINES.items()])
    texts = F.array(*[F.lit(s) for s in STATUSES])
    return facts.withColumns({name: F.get(texts, F.col(name) - 1) for name in STATUS_LINES})


def visits(spark: SparkSession, sf: str) -> DataFrame:
    return intake(spark, sf).join(line_facts(spark, sf), "encounter_id", "left")


def _status_sql(name: str, line: int) -> str:
    return (f"max(CASE WHEN l_linenumber = {line} THEN CASE WHEN l_returnflag = 'A' THEN 'No' "
            "WHEN l_returnflag = 'N' THEN 'steady ' WHEN l_linestatus = 'F' THEN 'Up' "
            f"ELSE 'Down' END END) AS {name}")


VISITS_SQL = INTAKE_SQL + """,
line_facts AS (
  SELECT l_orderkey AS encounter_id, count(*) AS time_in_hospital,
         CAST(sum(l_quantity) AS BIGINT) AS num_medications,
         CAST(max(l_linenumber) AS BIGINT) AS number_diagnoses,
         count(*) FILTER (WHERE l_tax >= 0.04) AS num_lab_procedures,
         count(*) FILTER (WHERE l_discount > 0.05) AS number_outpatient,
         count(*) FILTER (WHERE l_returnflag = 'R') AS number_emergency,
         count(*) FILTER (WHERE l_linestatus = 'F') AS number_inpatient,
         """ + ", ".join(_status_sql(n, i) for n, i in STATUS_LINES.items()) + """
  FROM lineitem GROUP BY l_orderkey),
visits AS (SELECT * FROM intake LEFT JOIN line_facts USING (encounter_id))"""


def split_sql(key: str) -> str:
    """The hash split of an entity key (seed 42, 70/15/15) as an expression."""
    share = f"CAST('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"
    return f"CASE WHEN {share} < 0.7 THEN 'train' WHEN {share} < 0.85 THEN 'val' ELSE 'test' END"


FEATURES_SQL = VISITS_SQL + f""",
split_visits AS (SELECT *, {split_sql('patient_nbr')} AS split FROM visits),
entity_sizes AS (SELECT split, patient_nbr, count(*) AS entity_rows FROM split_visits GROUP BY ALL),
statuses AS (
  SELECT encounter_id,
         count(*) FILTER (WHERE s IN ('NO', 'STEADY', 'UP', 'DOWN')) AS seen,
         count(*) FILTER (WHERE s IN ('UP', 'DOWN')) AS changed
  FROM (SELECT encounter_id, upper(trim(unnest([metformin, insulin, glipizide, glyburide]))) AS s
        FROM visits) GROUP BY encounter_id),
features AS (
  SELECT v.*, CAST(entity_rows - 1 AS INTEGER) AS recurrency,
         CAST(0.30 * least(greatest(coalesce(time_in_hospital, 0) / 14.0, 0), 1)
            + 0.25 * least(greatest(coalesce(number_diagnoses, 0) / 16.0, 0), 1)
            + 0.20 * least(greatest(coalesce(number_inpatient, 0) / 10.0, 0), 1)
            + 0.15 * least(greatest(coalesce(number_outpatient, 0) / 10.0, 0), 1)
            + 0.10 * least(greatest(coalesce(number_emergency, 0) / 10.0, 0), 1) AS FLOAT)
           AS patient_severity,
         CAST(CASE WHEN seen = 0 THEN 0 ELSE changed::DOUBLE / seen END AS FLOAT)
           AS medication_change_ratio,
         CAST(coalesce(number_inpatient, 0) + coalesce(number_outpatient, 0)
            + coalesce(number_emergency, 0) AS FLOAT) AS utilization_intensity,
         CASE WHEN try_cast(discharge_disposition_id AS DOUBLE) IN (1, 6, 8) THEN 0 ELSE 1 END
           AS complex_discharge_flag,
         coalesce(try_cast(regexp_extract(age, '^\\[(\\d+)-(\\d+)\\)$', 1) AS BIGINT) // 10, -1)
           AS age_bucket_risk
  FROM split_visits v JOIN entity_sizes USING (split, patient_nbr)
  JOIN statuses USING (encounter_id))"""
