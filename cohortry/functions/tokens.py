"""Null-like tokens and safe parsing.

Three kinds of "missing" are kept apart: real nulls (NaN included), the ``?``
token, and empty or whitespace-only text.

Expressions that are repeated for every column of a wide table are written as
SQL text: one parse costs far less on the driver than dozens of column calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every Unicode white-space character; ``trim`` alone removes only U+0020.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SPACES_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "'"
_CODES_SQL = ", ".join(str(ord(c)) for c in WHITESPACE)

# Text that the raw CSV reader treats as null.
READER_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
MISSING_CHOICE = "(missing)"

# A plain decimal number or infinity. Java's parser alone would also take "1d".
_NUMBER = r"^\s*[+-]?((?i:inf|infinity)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$"

# What a cell holds, as told by ``cell_kind``.
ORDINARY, NULL, QUESTION_MARK, EMPTY, BLANK = range(5)


def sql_name(name: str) -> str:
    """An exact column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def sql_double(value: float) -> str:
    return f"DOUBLE('{float(value)!r}')"


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name has."""
    return F.col(sql_name(name))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def strip_sql(text: str) -> str:
    """SQL for the text without white space at its ends.

    Trimming against a character list costs several times a comparison, so only
    text whose first or last character is white space is trimmed.
    """
    return (f"CASE WHEN ascii({text}) IN ({_CODES_SQL}) "
            f"OR ascii(substring({text}, -1, 1)) IN ({_CODES_SQL}) "
            f"THEN trim(BOTH {_SPACES_SQL} FROM {text}) ELSE {text} END")


def stripped_sql(name: str) -> str:
    return strip_sql(f"CAST({sql_name(name)} AS STRING)")


def stripped(name: str) -> Column:
    """A column's text without white space at its ends."""
    return F.expr(stripped_sql(name))


def text_kind(text: str) -> Column:
    """Kind of a text cell, given as SQL; most are settled by their first
    character."""
    bare = f"trim(BOTH {_SPACES_SQL} FROM {text})"
    return F.expr(
        f"CASE WHEN {text} IS NULL THEN {NULL} WHEN {text} = '' THEN {EMPTY} "
        f"WHEN ascii({text}) IN ({_CODES_SQL}, {ord('?')}) THEN CASE {bare} "
        f"WHEN '?' THEN {QUESTION_MARK} WHEN '' THEN {BLANK} ELSE {ORDINARY} END "
        f"ELSE {ORDINARY} END")


def is_numeric(data_type: T.DataType) -> bool:
    """Booleans count as numeric, as they do in the raw profile."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_null(df: DataFrame, name: str) -> Column:
    null = f"{sql_name(name)} IS NULL"
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        null += f" OR isnan({sql_name(name)})"
    return F.expr(null)


def cell_kind(df: DataFrame, name: str) -> Column:
    """Kind of a cell of any type. Only text can hold a token, so other types
    cost a null check."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return text_kind(sql_name(name))
    return F.when(is_null(df, name), F.lit(NULL)).otherwise(F.lit(ORDINARY))


def number_sql(df: DataFrame, name: str) -> str:
    """SQL for the column as double; text that is no number, and NaN, are null."""
    column, data_type = sql_name(name), df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        return (f"CASE WHEN {column} RLIKE r'{_NUMBER}' "
                f"THEN try_cast(trim({column}) AS DOUBLE) END")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({column}) THEN CAST({column} AS DOUBLE) END"
    if is_numeric(data_type):
        return f"CAST({column} AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def parse_number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def number_or_sql(df: DataFrame, name: str, fill: float = 0.0) -> str:
    return f"coalesce({number_sql(df, name)}, {sql_double(fill)})"


def finite_sql(value: str) -> str:
    """SQL that is null for NaN and the infinities, so it can go into JSON."""
    return f"CASE WHEN NOT isnan({value}) AND abs({value}) <> DOUBLE('Infinity') THEN {value} END"


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def optional_text(text: Column) -> Column:
    """Stripped text; blank and the "(missing)" choice become null."""
    bare = strip(text)
    return F.when(~bare.isin("", MISSING_CHOICE), bare)


def label_text(name: str, missing: str = "<NA>") -> Column:
    """A column as stripped text, null shown as a label of its own."""
    return F.expr(f"coalesce({stripped_sql(name)}, {sql_text(missing)})")
