"""Type affinity of declared column types, and of Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Affinities whose columns have a minimum, maximum and mean.
NUMERIC = ("INTEGER", "REAL", "NUMERIC")


def declared_affinity(declared: Column) -> Column:
    """Affinity of a declared type's text; INT is looked for first, so POINT and CHARINT are integers."""
    t = F.upper(F.btrim(F.coalesce(declared, F.lit(""))))
    return (
        F.when(t == "", "BLOB")
        .when(t.contains("INT"), "INTEGER")
        .when(t.rlike("CHAR|CLOB|TEXT"), "TEXT")
        .when(t.isin("BLOB", "NONE"), "BLOB")
        .when(t.rlike("REAL|FLOA|DOUB"), "REAL")
        .otherwise("NUMERIC")
    )


def spark_affinity(kind: T.DataType) -> str:
    """Affinity of a Spark type; dates, times, decimals and booleans are NUMERIC, nested types BLOB."""
    if isinstance(kind, T.IntegralType):
        return "INTEGER"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "REAL"
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return "TEXT"
    if isinstance(kind, T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType):
        return "NUMERIC"
    return "BLOB"
