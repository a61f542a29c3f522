"""Column profiles: one aggregation without a wide shuffle per table, and one count of values for distincts and top values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.affinity import NUMERIC, spark_affinity
from gristmill.sources.catalog import Catalog

TOP_VALUES = 10
PERMUTATIONS = 128


def as_text(name: str, kind: T.DataType) -> Column:
    """A column's values as text: the same value always gives the same text, -0.0 that of 0.0."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return (c + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(F.struct(c))
    return c.cast("string")


MEASURES = ("null_count", "min_value", "max_value", "avg_value", "min_time", "max_time", "avg_length")


def _measures(name: str, kind: T.DataType, wanted: Sequence[str]) -> Column:
    c, affinity = F.col(f"`{name}`"), spark_affinity(kind)
    is_time = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)
    number = affinity in NUMERIC and not is_time
    x = c.cast("double") if number else F.lit(None).cast("double")
    moment = lambda f: F.date_format(f(c), "yyyy-MM-dd HH:mm:ss") if is_time else F.lit(None).cast("string")
    all_of = {
        "null_count": lambda: F.sum(c.isNull().cast("long")),
        "min_value": lambda: F.min(x),
        "max_value": lambda: F.max(x),
        "avg_value": lambda: F.avg(x),
        "min_time": lambda: moment(F.min),
        "max_time": lambda: moment(F.max),
        "avg_length": lambda: F.avg(F.length(c)) if affinity == "TEXT" else F.lit(None).cast("double"),
    }
    return F.struct(F.lit(name).alias("column"), F.lit(affinity).alias("affinity"), F.count(F.lit(1)).alias("total_rows"), *[all_of[m]().alias(m) for m in wanted])


def column_statistics(df: DataFrame, table: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per column: rows and the named measures, from a single aggregation that computes no others.

    Times have a range but no mean. An empty table has null rate 0.
    """
    measured = df.agg(F.array(*[_measures(f.name, f.dataType, measures) for f in df.schema.fields]).alias("all"))
    rows = measured.select(F.posexplode("all").alias("ordinal", "m")).select(F.lit(table).alias("table"), "ordinal", "m.*")
    if "null_count" not in measures:
        return rows
    rows = rows.withColumn("null_count", F.coalesce("null_count", F.lit(0)))
    return rows.withColumn("null_rate", F.coalesce(F.try_divide(F.col("null_count"), F.col("total_rows")), F.lit(0.0)))


def value_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """``table, column, value, freq`` of every non-null value of every column: counted once, combined before the shuffle."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not fields:
        return df.sparkSession.createDataFrame([], "table string, column string, value string, freq long")
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), as_text(f.name, f.dataType).alias("value")) for f in fields])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")).select(F.lit(table).alias("table"), "column", "value", "freq")


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of each column; of equal frequencies the first in order of the values.

    Spark limits each group before the shuffle, so no column's values meet in one task.
    """
    order = Window.partitionBy("table", "column").orderBy(F.desc("freq"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def profile_table(df: DataFrame, table: str, exact: bool = True, k: int = TOP_VALUES) -> DataFrame:
    """Statistics, distinct counts and top values of every column of a table.

    ``exact=False`` estimates distinct counts by HyperLogLog and skips the count of values, for tables where even
    one shuffle of all distinct values is too much; top values are then null.
    """
    stats = column_statistics(df, table)
    if not exact:
        sketches = df.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), F.approx_count_distinct(as_text(f.name, f.dataType)).alias("distinct_count")) for f in df.schema.fields]).alias("all"))
        found = sketches.select(F.inline("all")).withColumn("top_values", F.lit(None).cast("array<struct<value: string, freq: bigint>>"))
        return stats.join(found, "column")
    counts = value_counts(df, table)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    tops = top_values(counts, k).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "freq"))).alias("r"))
    tops = tops.select("column", F.transform("r", lambda x: F.struct(x["value"].alias("value"), x["freq"].alias("freq"))).alias("top_values"))
    joined = stats.join(distinct, "column", "left").join(tops, "column", "left")
    return joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))).withColumn("top_values", F.coalesce("top_values", F.array().cast("array<struct<value: string, freq: bigint>>")))


def profile_catalog(catalog: Catalog, exact: bool = True, k: int = TOP_VALUES) -> DataFrame:
    """Profiles of all columns with their keys, one row per column."""
    parts = [profile_table(df, t, exact, k) for t, df in catalog.tables.items()]
    keys = catalog.column_frame().select("table", "column", "is_primary_key", "foreign_key")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(keys), ["table", "column"])


def totals(profile: DataFrame) -> DataFrame:
    return profile.agg(F.count_distinct("table").alias("total_tables"), F.count(F.lit(1)).alias("total_columns"))


def shingles(text: Column, n: int = 3) -> Column:
    """The set of character n-grams of a text; a text shorter than n is its own."""
    spread = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) < n, F.array(text)).otherwise(spread))


def signature(hashes: Column, permutations: int = PERMUTATIONS) -> Column:
    """MinHash: for each seed the least of the rehashed values."""
    return F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda s: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, s))))


def column_signatures(catalog: Catalog, permutations: int = PERMUTATIONS) -> DataFrame:
    """``table, column, minhash`` over the 3-grams of each column's values: all of them, by minima that combine before the shuffle.

    A signature depends on the set of grams only, so a gram is hashed once for each column and task, not for each row.
    """
    parts = []
    for t, df in catalog.tables.items():
        # A file of few bytes is one task, however many rows it has; grams are much work a byte, so rows are dealt out first.
        groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(groups, *[as_text(f.name, f.dataType) for f in df.schema.fields])
        cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), as_text(f.name, f.dataType).alias("value")) for f in df.schema.fields])).alias("c")
        parts.append(df.select(F.lit(t).alias("table"), cells).select("table", "c.column", "c.value").where("value IS NOT NULL"))
    rows = reduce(DataFrame.unionByName, parts)
    # Places are spread and the text cut at each, as shingles() would be evaluated element by element; a text of fewer than 3 is its own gram.
    spread = rows.select("table", "column", "value", F.explode(F.sequence(F.lit(1), F.greatest(F.length("value") - 2, F.lit(1)))).alias("i"))
    grams = spread.select("table", "column", F.expr("substring(value, i, 3)").alias("gram")).distinct().select("table", "column", F.xxhash64("gram").alias("h"))
    minima = [F.min(F.xxhash64("h", F.lit(s))).alias(f"m{s}") for s in range(1, permutations + 1)]
    return grams.groupBy("table", "column").agg(*minima).select("table", "column", F.array(*[f"m{s}" for s in range(1, permutations + 1)]).alias("minhash"))


def encode_signature(minhash: Column) -> Column:
    """A signature as base 64 of its 64-bit values, highest byte first."""
    return F.base64(F.unhex(F.array_join(F.transform(minhash, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def decode_signature(text: Column, permutations: int = PERMUTATIONS) -> Column:
    digits = F.hex(F.unbase64(text))

    def value(i):
        part = F.substring(digits, i * 16 + 1, F.lit(16))
        high, low = F.conv(F.substring(part, 1, 8), 16, 10).cast("long"), F.conv(F.substring(part, 9, 8), 16, 10).cast("long")
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), value)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def key_containment(catalog: Catalog) -> DataFrame:
    """For each foreign key how many of its non-null values have no partner: ``from_table, from_column, to_table, to_column, n_rows, n_orphans``."""
    parts = []
    for t, c, rt, rc in catalog.foreign_keys:
        if t in catalog.tables and rt in catalog.tables:
            values = catalog.tables[t].where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            keys = catalog.tables[rt].select(F.col(rc).alias("k")).distinct()
            found = values.join(keys, values.v == keys.k, "left")
            sums = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
            parts.append(sums.select(F.lit(t).alias("from_table"), F.lit(c).alias("from_column"), F.lit(rt).alias("to_table"), F.lit(rc).alias("to_column"), "n_rows", "n_orphans"))
    return reduce(DataFrame.union, parts)
