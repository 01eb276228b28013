"""Table profiling and validation.

Shape of the work: one aggregation over all columns gives one row, which is
then turned into one row per column. Per-value work unpivots the table once to
(column, value) and counts with map-side combine, so a value that fills a third
of the table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import presets
from cohortry.functions.tokens import (
    BLANK, EMPTY, NULL, ORDINARY, QUESTION_MARK, cell_kind, is_numeric, label_text, number_sql,
    quoted, sql_double, sql_name, sql_text, strip_sql, stripped, text_kind,
)
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.schema import (
    FeatureCandidacy, column_role, numeric_and_categorical, require_columns,
)
from cohortry.operators.skew import attach_group_size
from cohortry.sources.scratch import settle

_KINDS = {NULL: "standard_null", QUESTION_MARK: "question_mark", EMPTY: "empty_string",
          BLANK: "whitespace_only"}


def _one_row_to_many(one_row: DataFrame, structs: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct (SQL text)."""
    return one_row.selectExpr(f"inline(array({', '.join(structs)}))")


def _missing_parts(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str], list]:
    """Sums over cell kinds k0, k1, ..., the rows made of them, and the cell kinds."""
    kinds = [cell_kind(df, c).alias(f"k{i}") for i, c in enumerate(columns)]
    sums, rows = ["count(1) AS rows"], []
    for i, name in enumerate(columns):
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        counts = {}
        for code, kind in _KINDS.items():
            counts[kind] = "0L"
            if is_text or code == NULL:
                sums.append(f"count_if(k{i} = {code}) AS {kind}_{i}")
                counts[kind] = f"{kind}_{i}"
        total = " + ".join(counts.values())
        rows.append(
            f"struct({sql_text(name)} AS column, {i} AS column_index, rows, "
            f"{total} AS missing_count, "
            f"CASE WHEN rows > 0 THEN ({total}) / rows ELSE 0D END AS missing_rate, "
            + ", ".join(f"{v} AS {k}_count" for k, v in counts.items()) + ")")
    return sums, rows, kinds


def missingness(df: DataFrame, columns=None) -> DataFrame:
    """Missing counts per column by kind, highest rate first.

    A single pass: each cell is classed once, and one aggregation counts the
    classes of every column.
    """
    columns = list(df.columns if columns is None else columns)
    sums, rows, kinds = _missing_parts(df, columns)
    table = _one_row_to_many(df.select(*kinds).selectExpr(*sums), rows)
    return table.orderBy(F.desc("missing_rate"), "column_index")


def null_token_totals(df: DataFrame, columns=None) -> DataFrame:
    per_column = missingness(df, columns)
    return per_column.agg(*[F.sum(f"{k}_count").alias(f"{k}_total") for k in _KINDS.values()])


def highly_missing(df: DataFrame, threshold: float = 0.30) -> DataFrame:
    return missingness(df).where(F.col("missing_rate") >= threshold)


def replace_null_tokens(df: DataFrame) -> DataFrame:
    """``?``, blank and whitespace-only text become null; one projection."""
    def cleaned(field: T.StructField) -> Column:
        if not isinstance(field.dataType, T.StringType):
            return quoted(field.name)
        return F.when(text_kind(sql_name(field.name)) == ORDINARY,
                      quoted(field.name)).alias(field.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows.

    Rows are first counted by an 8-byte hash, so a table with few repeats never
    shuffles whole rows: the list of repeated hashes is broadcast while it is
    small, and only rows with such a hash are compared in full, the many copies
    of one row combined before that shuffle.
    Null positions go into the hash because ``xxhash64`` skips nulls.
    """
    columns = [quoted(c) for c in df.columns]
    flags = [f"{sql_name(c)} IS NULL" for c in df.columns]
    hashed = F.expr(f"xxhash64({', '.join([sql_name(c) for c in df.columns] + flags)})")
    keyed = attach_group_size(df.withColumn("_row_hash", hashed), ["_row_hash"], "_n", at_least=2)
    groups = (keyed.where("_n IS NOT NULL").groupBy("_row_hash", *columns)
              .agg(F.count(F.lit(1)).alias("copies")))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long")
                      .alias("duplicate_rows"))


def _key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(quoted(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def identifier_summary(df: DataFrame, id_column: str = presets.ID_COLUMN,
                       entity_column: str = presets.ENTITY_COLUMN) -> DataFrame:
    """One row on the id and the entity key. Null counts as a value when
    looking for duplicates, but not as a distinct id. Facts about a column that
    the table lacks are null."""
    known = F.col("key").isNotNull()
    facts = ("id_non_null_count", "id_unique_count", "id_duplicate_count",
             "entity_unique_count", "entity_repeated_row_count")
    found = []
    if id_column in df.columns:
        found.append(_key_counts(df, id_column).agg(
            F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("id_non_null_count"),
            F.count("key").alias("id_unique_count"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("id_duplicate_count")))
    if entity_column in df.columns:
        found.append(_key_counts(df, entity_column).agg(
            F.count("key").alias("entity_unique_count"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
             .alias("entity_repeated_row_count")))
    empty = df.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in facts))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found, empty)
    one_row = both.agg(*[F.max(c).alias(c) for c in facts])
    return one_row.withColumn("id_unique", (
        F.col("id_unique_count") == F.col("id_non_null_count"))
        & (F.col("id_duplicate_count") == 0))


def top_repeated_entities(df: DataFrame, entity_column: str = presets.ENTITY_COLUMN,
                          n: int = 5) -> DataFrame:
    return (_key_counts(df, entity_column).where((F.col("n") > 1) & F.col("key").isNotNull())
            .orderBy(F.desc("n"), "key").limit(n)
            .select(F.col("key").alias("entity"), F.col("n").alias("row_count")))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per stripped value; null is shown as ``<NA>``."""
    return (df.groupBy(label_text(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def _value_sql(df: DataFrame, name: str) -> str:
    column = sql_name(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        # One text for -0.0 and 0.0, and null for NaN.
        column = f"CASE WHEN NOT isnan({column}) THEN {column} + 0D END"
    return f"CAST({column} AS STRING)"


def _column_values(df: DataFrame, columns: list[str], *extra: str) -> DataFrame:
    """Long form (column_index, value): one row per cell, null kept."""
    cells = [f"struct({i} AS column_index, {_value_sql(df, c)} AS value)"
             for i, c in enumerate(columns)]
    return df.selectExpr(*extra, f"inline(array({', '.join(cells)}))")


def _column_names(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        list(enumerate(columns)), "column_index int, column string")


def categorical_summary(df: DataFrame, columns=None, top_n: int = 5) -> DataFrame:
    """Distinct count and most frequent values per categorical column.

    Both results read every column of ``counts`` (the always-true ``n > 0``
    included), so their plans stay equal below and the table is scanned and
    shuffled once. The rank filter becomes a per-task group limit below the
    shuffle, so one column with very many values never lands whole in one task.
    """
    columns = numeric_and_categorical(df)[1] if columns is None else list(columns)
    counts = (_column_values(df, columns).groupBy("column_index", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.groupBy("column_index").agg(
        F.count(F.expr("CASE WHEN n > 0 THEN value END")).alias("unique_non_null_count"))
    bare = strip_sql("coalesce(value, '<NA>')")
    shown = F.expr(f"coalesce(nullif({bare}, ''), '<EMPTY>')")
    by_shown = counts.groupBy("column_index", shown.alias("value")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("column_index").orderBy(F.desc("n"), "value")
    top = (by_shown.withColumn("position", F.row_number().over(order))
           .where(F.col("position") <= top_n))
    names = F.broadcast(_column_names(df, columns))
    return (top.join(distinct, "column_index").join(names, "column_index")
            .select("column", "unique_non_null_count", "position", "value", "n")
            .orderBy("column", "position"))


def numeric_summary(df: DataFrame, columns=None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column."""
    columns = numeric_and_categorical(df)[0] if columns is None else list(columns)
    quarters = (0.25, 0.5, 0.75)
    numbers = df.selectExpr(*[f"{number_sql(df, c)} AS x{i}" for i, c in enumerate(columns)])
    if exact:
        cuts = exact_quantiles(numbers, numbers.columns, quarters, infinite=True)
    else:
        found = numbers.approxQuantile(numbers.columns, list(quarters), 0.001)
        cuts = {c: (q or None) for c, q in zip(numbers.columns, found)}
    stats = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    sums = [f"{fn}({c}) AS {stat}_{c}" for c in numbers.columns for stat, fn in stats.items()]
    rows = []
    for name, c in zip(columns, numbers.columns):
        found = {stat: f"{stat}_{c}" for stat in stats}
        for label, value in zip(("p25", "p50", "p75"), cuts[c] or (None,) * 3):
            found[label] = "CAST(NULL AS DOUBLE)" if value is None else sql_double(value)
        listed = ", ".join(f"{found[k]} AS {k}" for k in
                           ("count", "mean", "std", "min", "p25", "p50", "p75", "max"))
        rows.append(f"struct({sql_text(name)} AS column, {listed})")
    return _one_row_to_many(numbers.selectExpr(*sums), rows)


def _countable(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns and is_numeric(df.schema[c].dataType)]


def _negative_rows(names: list[str]) -> list[str]:
    return [f"struct({sql_text(c)} AS column, n{i} AS negative_count)" for i, c in enumerate(names)]


def negative_counts(df: DataFrame, columns=presets.COUNT_COLUMNS) -> DataFrame:
    """Negative values in count-like numeric columns."""
    present = _countable(df, columns)
    if not present:
        return df.sparkSession.createDataFrame([], "column string, negative_count long")
    one_row = df.selectExpr(*[f"count_if({sql_name(c)} < 0) AS n{i}"
                              for i, c in enumerate(present)])
    return _one_row_to_many(one_row, _negative_rows(present))


def label_issues(df: DataFrame, column: str = presets.TARGET_COLUMN,
                 allowed=presets.CLASS_LABELS) -> DataFrame:
    """Rows (issue, label, n): missing labels, labels not allowed, labels absent."""
    seen = settle(df.groupBy(stripped(column).alias("label"))
                  .agg(F.count(F.lit(1)).alias("n")))
    issue = (F.when(F.col("label").isNull(), F.lit("missing"))
             .when(~F.col("label").isin(*allowed), F.lit("unexpected")))
    bad = seen.withColumn("issue", issue).where("issue IS NOT NULL").select("issue", "label", "n")
    wanted = df.sparkSession.createDataFrame([(x,) for x in allowed], "label string")
    absent = (wanted.join(seen, "label", "left_anti")
              .select(F.lit("absent").alias("issue"), "label", F.lit(0).cast("long").alias("n")))
    return bad.unionByName(absent)


def require_labels(df: DataFrame, column: str = presets.TARGET_COLUMN,
                   allowed=presets.CLASS_LABELS, shown: int = 20) -> None:
    """Raise when a label is missing or not allowed (one small aggregation)."""
    require_columns(df, [column], "label check")
    label = stripped(column)
    unexpected = label.isNotNull() & ~label.isin(*allowed)
    missing, bad = df.agg(F.count_if(label.isNull()), F.count_if(unexpected)).first()
    if missing:
        raise ValueError(f"column {column} has {missing} missing label(s)")
    if bad:
        names = df.where(unexpected).select(label.alias("label")).distinct().orderBy("label")
        found = [r["label"] for r in names.limit(shown).collect()]
        raise ValueError(f"Unexpected labels in {column}: {', '.join(found)}; "
                         f"allowed are {', '.join(allowed)}")


def validation_report(df: DataFrame, target: str = presets.TARGET_COLUMN,
                      id_column: str = presets.ID_COLUMN,
                      entity_column: str = presets.ENTITY_COLUMN,
                      required=presets.REQUIRED_COLUMNS, allowed=presets.CLASS_LABELS,
                      count_columns=presets.COUNT_COLUMNS,
                      missing_threshold: float = 0.30) -> DataFrame:
    """All validation rules as rows (rule, subject, value, violated)."""
    spark = df.sparkSession
    shape = "rule string, subject string, value double, violated boolean"
    columns_rule = spark.createDataFrame(
        [("required_column", c, float(c in df.columns), c not in df.columns) for c in required],
        shape)

    def rows(table: DataFrame, rule: str, subject: Column, value: Column, bad: Column) -> DataFrame:
        return table.select(F.lit(rule).alias("rule"), subject.alias("subject"),
                            value.cast("double").alias("value"), bad.alias("violated"))

    # Rates, the token total and negative values come from one pass over the table.
    sums, missing_rows, kinds = _missing_parts(df, df.columns)
    present = _countable(df, count_columns)
    below = [F.expr(f"{sql_name(c)} < 0").alias(f"b{i}") for i, c in enumerate(present)]
    one_row = settle(df.select(*kinds, *below).selectExpr(
        *sums, *[f"count_if(b{i}) AS n{i}" for i in range(len(present))]))
    negatives = (_one_row_to_many(one_row, _negative_rows(present)) if present
                 else spark.createDataFrame([], "column string, negative_count long"))
    cells = _one_row_to_many(one_row, missing_rows).selectExpr(
        "stack(2, 'high_missingness', column, missing_rate, 'question_mark_tokens', '*', "
        "CAST(question_mark_count AS DOUBLE)) AS (rule, subject, value)")
    summed = cells.groupBy("rule", "subject").agg(F.sum("value").alias("value"))
    is_bad = (F.when(F.col("rule") == "high_missingness", F.col("value") >= missing_threshold)
              .otherwise(F.col("value") > 0))
    parts = [
        columns_rule,
        rows(duplicate_row_count(df), "duplicate_rows", F.lit("*"),
             F.col("duplicate_rows"), F.col("duplicate_rows") > 0),
        summed.withColumn("violated", is_bad),
        rows(negatives, "negative_values", F.col("column"),
             F.col("negative_count"), F.col("negative_count") > 0),
    ]
    if id_column in df.columns:
        ids = _key_counts(df, id_column).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"),
            F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("rows"),
            F.count("key").alias("ids"))
        parts.append(rows(ids, "id_not_unique", F.lit(id_column), F.col("repeats"),
                          (F.col("repeats") > 0) | (F.col("ids") != F.col("rows"))))
    if target in df.columns:
        parts.append(rows(
            label_issues(df, target, allowed).where("issue <> 'missing'"), "target_labels",
            F.concat_ws(":", "issue", "label"), F.col("n"), F.lit(True)))
    else:
        parts.append(spark.createDataFrame([("target_column", target, 0.0, True)], shape))
    return reduce(DataFrame.unionByName, parts)


def preprocessing_summary(raw: DataFrame, cleaned: DataFrame, candidacy: FeatureCandidacy,
                          targets=(presets.TARGET_COLUMN, presets.BINARY_TARGET_COLUMN),
                          entity: str = presets.ENTITY_COLUMN) -> DataFrame:
    """Rows (section, subject, value): shapes, missing counts before and after,
    label counts, column lists, and a warning when there is no entity column."""
    def rows(table: DataFrame, section: str, subject: Column, value: Column) -> DataFrame:
        return table.select(F.lit(section).alias("section"), subject.alias("subject"),
                            value.cast("long").alias("value"))

    parts = []
    for name, table in (("before", raw), ("after", cleaned)):
        shape = "shape_original" if name == "before" else "shape_preprocessed"
        cells = missingness(table).selectExpr(
            f"stack(3, 'missing_{name}', column, missing_count, "
            f"'{shape}', 'rows', if(column_index = 0, rows, 0L), "
            f"'{shape}', 'columns', 1L) AS (section, subject, value)")
        parts.append(cells.groupBy("section", "subject").agg(F.sum("value").alias("value")))
    for target in targets:
        if target in cleaned.columns:
            parts.append(rows(value_distribution(cleaned, target), f"distribution_{target}",
                              F.col("value"), F.col("n")))
    lists = [(section, name, i) for section, names in (
        ("identifier_column", candidacy.identifiers), ("target_column", candidacy.targets),
        ("excluded_column", candidacy.excluded), ("candidate_column", candidacy.candidates))
        for i, name in enumerate(names)]
    if entity not in cleaned.columns:
        lists.append(("warning", f"{entity} is missing; splitting by entity will fail", 1))
    parts.append(raw.sparkSession.createDataFrame(lists, "section string, subject string, value long"))
    return reduce(DataFrame.unionByName, parts)


def data_dictionary(df: DataFrame, order_by: str, target: str = presets.TARGET_COLUMN,
                    examples: int = 3) -> DataFrame:
    """One row per column: role, type, counts, first examples, description.

    "First" examples need an order, which a distributed table lacks, so the
    row order is given by ``order_by``. As above, both results read all columns
    of ``values`` to share one scan and shuffle.
    """
    columns = df.columns
    cells = _column_values(df, columns, f"{sql_name(order_by)} AS _order")
    values = (cells.groupBy("column_index", "value")
              .agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("first_seen")))
    missing = text_kind("value") != ORDINARY
    counts = values.groupBy("column_index").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(missing, F.col("n")).otherwise(F.lit(0))).alias("missing"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(F.lit(0)))
         .alias("non_null_count"),
        F.count(F.expr("CASE WHEN first_seen IS NOT NULL THEN value END")).alias("unique_count"))
    order = Window.partitionBy("column_index").orderBy("first_seen", "value")
    shown = (values.where(~missing & (F.col("n") > 0)).withColumn("position", F.row_number().over(order))
             .where(F.col("position") <= examples)
             .groupBy("column_index")
             .agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("found"))
             .select("column_index", F.col("found.value").alias("example_values")))
    facts = []
    for i, field in enumerate(df.schema.fields):
        role = column_role(field.name, is_numeric(field.dataType))
        key = field.name.strip().lower()
        facts.append((i, field.name, role, field.dataType.simpleString(),
                      presets.COLUMN_DESCRIPTIONS.get(key, presets.ROLE_DESCRIPTIONS[role]),
                      role == "identifier", key == target.strip().lower(),
                      role == "medication-status", role == "diagnosis-like",
                      key in presets.UTILIZATION_COLUMNS))
    roles = df.sparkSession.createDataFrame(
        facts, "column_index int, column_name string, role string, dtype string, "
               "description string, is_identifier boolean, is_target boolean, "
               "is_medication boolean, is_diagnosis boolean, is_utilization boolean")
    rate = F.coalesce(F.col("missing") / F.col("rows"), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (roles.join(counts, "column_index", "left").join(shown, "column_index", "left")
            .select("column_index", "column_name", "role", "dtype",
                    rate.alias("missing_token_rate"), zero("non_null_count"), zero("unique_count"),
                    F.coalesce("example_values", F.array().cast("array<string>"))
                     .alias("example_values"),
                    "description", "is_identifier", "is_target", "is_medication",
                    "is_diagnosis", "is_utilization")
            .orderBy("column_index"))
