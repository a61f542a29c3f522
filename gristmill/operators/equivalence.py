"""Five ways to call two results equal. All compare multisets of rows; they differ in how cells read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import fixed

#: Seeds of the hashes that a row gets where whole results are compared, 64 bits each.
SEEDS = (1, 2, 3)
RELATIONS = ("strict", "driver", "trace", "checkpoint", "cluster")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))


def cell(column: Column, kind: T.DataType, relation: str) -> Column:
    """A cell as text under a relation.

    strict: floats at six places, booleans as 0 or 1, so that 1 and 1.0 differ. driver: whole floats as integers, others at two
    places. trace: the same at six places. checkpoint: as they print. cluster: floats at six places.
    """
    is_float = isinstance(kind, T.FloatType | T.DoubleType)
    null = F.lit("\u0000null") if relation == "strict" else F.lit("None") if relation == "checkpoint" else F.lit("NULL")
    text = column.cast("string")
    if isinstance(kind, T.BooleanType):
        text = F.when(column, "1").otherwise("0") if relation == "strict" else F.when(column, "True").otherwise("False")
    elif is_float and relation in ("strict", "cluster"):
        text = F.when(_finite(column), fixed(column, 6)).otherwise(text)
    elif is_float and relation in ("driver", "trace"):
        whole = _finite(column) & (column == F.floor(column)) & (F.abs(column) < 9e15)
        text = F.when(whole, column.cast("long").cast("string")).when(_finite(column), fixed(column, 2 if relation == "driver" else 6)).otherwise(text)
    return F.when(column.isNull(), null).otherwise(text)


def canonical_rows(df: DataFrame, relation: str) -> DataFrame:
    """``row``: each row as a list of cells; only strict ignores their order."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    cells = F.array(*[cell(df[i], f.dataType, relation) for i, f in enumerate(df.schema.fields)])
    return df.select((F.array_sort(cells) if relation == "strict" else cells).alias("row"))


def row_counts(df: DataFrame, relation: str) -> DataFrame:
    return canonical_rows(df, relation).groupBy("row").agg(F.count(F.lit(1)).alias("n"))


def differences(a: DataFrame, b: DataFrame, relation: str = "strict") -> DataFrame:
    """Rows whose numbers differ: ``row, n_a, n_b``. Counts combine before the shuffle, so results of any size compare."""
    left = row_counts(a, relation).select("row", F.col("n").alias("n_a"), F.lit(0).cast("long").alias("n_b"))
    right = row_counts(b, relation).select("row", F.lit(0).cast("long").alias("n_a"), F.col("n").alias("n_b"))
    return left.union(right).groupBy("row").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).where("n_a <> n_b")


def _sums(df: DataFrame, relation: str, sign: int) -> DataFrame:
    """One row: how many rows there are, and of each half of each hash of the rows the sum, all times ``sign``."""
    hashes = [F.xxhash64(F.lit(s), "row") for s in SEEDS]  # the seed goes first, so that each hash reads the whole row anew
    halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND((1 << 32) - 1))]
    rows = canonical_rows(df, relation).select(F.lit(1).cast("long").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(halves)])
    return rows.agg(*[(F.coalesce(F.sum(c), F.lit(0)) * sign).alias(c) for c in rows.columns])


def equivalent(a: DataFrame, b: DataFrame, relation: str = "strict") -> DataFrame:
    """One row, ``equal``. Results of different widths are equal only if both are empty.

    Equal multisets of rows have equal counts and equal sums of their rows' hashes, in any order; others agree in all three sums of
    64 bits with a chance of about 2^-192, as for a key of a result. So no task holds any rows, and one row of sums is exchanged for
    each. ``differences`` names the rows that differ, by their cells.
    """
    if len(a.columns) != len(b.columns):
        return a.limit(1).select(F.lit(1)).union(b.limit(1).select(F.lit(1))).agg((F.count(F.lit(1)) == 0).alias("equal"))
    both = _sums(a, relation, 1).union(_sums(b, relation, -1))
    equal = [F.sum(c) == 0 for c in both.columns]
    return both.agg(reduce(Column.__and__, equal).alias("equal"))


def result_key(rows: Column) -> Column:
    """A key of a small result, ``array<array<string>>`` of canonical cells: the same for the same multiset of rows."""
    return F.sha2(F.to_json(F.array_sort(rows)), 256)
