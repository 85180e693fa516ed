"""Semantic types: of Spark types, of SQL type names, and of text columns by vote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, DATE, TEXT = "sc:Integer", "sc:Float", "sc:Date", "sc:Text"

# What a reader of CSV takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

INT_PATTERN, FLOAT_PATTERN, DATE_PATTERN = r"^[+-]?\d+$", r"^[+-]?\d+\.\d+$", r"^\d{4}-\d{2}-\d{2}$"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def semantic_type(kind: T.DataType) -> str:
    """Total: every Spark type has one. Booleans are numbers with the values 0 and 1."""
    if isinstance(kind, T.IntegralType):
        return INTEGER
    if is_numeric(kind):
        return FLOAT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return TEXT


def sql_semantic_type(name: Column) -> Column:
    """Semantic type of an SQL type name; precision, case and time zones don't matter."""
    n = F.upper(F.trim(name))
    return (
        F.when(n.rlike(r"^(SMALL|BIG|TINY|MEDIUM|HUGE)?INT(EGER)?\d*\b|^(SMALL|BIG)?SERIAL|^LONG$|^SHORT$|^BYTE$"), INTEGER)
        .when(n.rlike(r"^(FLOAT|DOUBLE|REAL|NUMERIC|DECIMAL|MONEY|BOOL)"), FLOAT)
        .when(n.rlike(r"^(DATE|TIMESTAMP)"), DATE)
        .otherwise(TEXT)
    )


def missing_to_null(c: Column) -> Column:
    """Null for each of the missing-value tokens."""
    return F.when(~c.isin(*NA_TOKENS), c)


def votes(c: Column) -> list[Column]:
    """How many values look like a float, an integer, a date; ties go to the earlier."""
    return [F.count_if(c.rlike(p)).alias(n) for n, p in (("floats", FLOAT_PATTERN), ("ints", INT_PATTERN), ("dates", DATE_PATTERN))]


def winner(floats: Column, ints: Column, dates: Column) -> Column:
    best = F.greatest(floats, ints, dates)
    return F.when(best == 0, TEXT).when(floats == best, FLOAT).when(ints == best, INTEGER).otherwise(DATE)
