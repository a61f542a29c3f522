"""Cell values by fuzzy similarity: shingles, MinHash bands for candidates, and exact Jaccard to rank them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.affinity import spark_affinity
from gristmill.operators.profile import shingles, signature, value_counts
from gristmill.sources.catalog import Catalog

#: Affinities whose values nobody searches by text.
SKIPPED = ("INTEGER", "REAL")
TOP_K = 5
#: Bands and rows of a band that give most pairs of similarity 0.3 or more, of 128 permutations.
BANDS, ROWS = 37, 3


def cell_values(catalog: Catalog, most_distinct: int | None = None) -> DataFrame:
    """``table, column, value``: distinct, trimmed, non-empty values of the columns that are searched by text.

    All of them, unless ``most_distinct`` leaves out whole columns of more distinct values. No such column gives no rows.
    """
    parts = []
    for table, df in catalog.tables.items():
        names = [f.name for f in df.schema.fields if spark_affinity(f.dataType) not in SKIPPED]
        if names:
            counts = value_counts(df, table, names)
            if most_distinct is not None:
                wide = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_distinct).select("column")
                counts = counts.join(wide, "column", "left_anti")
            trimmed = counts.select("table", "column", F.btrim("value").alias("value"))
            parts.append(trimmed.where("value <> ''").distinct())
    return reduce(DataFrame.unionByName, parts) if parts else catalog.spark.createDataFrame([], "table string, column string, value string")


def index_values(values: DataFrame) -> DataFrame:
    """``values`` with ``grams``, the set of lower-case 3-grams of each."""
    return values.withColumn("grams", shingles(F.lower("value")))


def with_bands(df: DataFrame, grams: str = "grams", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per band of each row's MinHash signature: ``band`` is the band's number and hash."""
    hashes = F.transform(grams, lambda g: F.xxhash64(g))
    signed = df.withColumn("_sig", signature(hashes, bands * rows))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("_sig", b * rows + 1, F.lit(rows))))
    return signed.withColumn("band", F.explode(keys)).drop("_sig")


VALUE = ["table", "column", "value"]


def _keywords(queries: DataFrame) -> DataFrame:
    """Each keyword once, with its 3-grams: equal keywords of different queries are searched together."""
    return queries.select("keyword").distinct().withColumn("q_grams", shingles(F.lower("keyword")))


def lsh_candidates(queries: DataFrame, values: DataFrame) -> DataFrame:
    """``keyword, table, column, value, shared, n_q, n_v`` of pairs that share a band; ``queries`` has ``query_id, keyword``."""
    left, right = with_bands(_keywords(queries), "q_grams"), with_bands(values)
    pairs = left.join(right, "band").select("keyword", *VALUE, "q_grams", "grams").dropDuplicates(["keyword", *VALUE])
    return pairs.select("keyword", *VALUE, F.size(F.array_intersect("q_grams", "grams")).cast("long").alias("shared"), F.size("q_grams").alias("n_q"), F.size("grams").alias("n_v"))


def gram_candidates(queries: DataFrame, values: DataFrame) -> DataFrame:
    """All pairs that share a 3-gram, with how many they share; what shares none has similarity 0.

    Pairs meet by an equi-join on the gram, and are counted where they meet before they are exchanged.
    """
    left = _keywords(queries).select("keyword", F.size("q_grams").alias("n_q"), F.explode("q_grams").alias("gram"))
    right = values.select(*VALUE, F.size("grams").alias("n_v"), F.explode("grams").alias("gram"))
    return left.join(right, "gram").groupBy("keyword", *VALUE, "n_q", "n_v").agg(F.count(F.lit(1)).alias("shared"))


def _jaccard():
    return F.col("shared") / (F.col("n_q") + F.col("n_v") - F.col("shared"))


def search_values(queries: DataFrame, values: DataFrame, top_k: int = TOP_K, exact: bool = True) -> DataFrame:
    """The best ``top_k`` values of each query: those equal but for case first, then by Jaccard similarity, then by name.

    Columns: ``query_id, keyword, table, column, matched_value, similarity_score, exact_match, rank``. ``exact=False`` takes
    candidates from bands, which misses some of low similarity.
    """
    pairs = (gram_candidates if exact else lsh_candidates)(queries, values)
    scored = pairs.select("keyword", "table", "column", F.col("value").alias("matched_value"), _jaccard().alias("similarity_score"), (F.lower("keyword") == F.lower("value")).alias("exact_match"))
    order = Window.partitionBy("keyword").orderBy(F.desc("exact_match"), F.desc("similarity_score"), "table", "column", "matched_value")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return queries.select("query_id", "keyword").distinct().join(best, "keyword").select("query_id", "keyword", "table", "column", "matched_value", "similarity_score", "exact_match", "rank")


def band_recall(queries: DataFrame, values: DataFrame, least: float = 0.5) -> DataFrame:
    """``n_pairs, n_found, recall``: of pairs of similarity ``least`` or more, how many the bands propose."""
    near = gram_candidates(queries, values).where(_jaccard() >= least).select("keyword", *VALUE)
    found = lsh_candidates(queries, values).select("keyword", *VALUE, F.lit(1).alias("hit"))
    sums = near.join(found, ["keyword", *VALUE], "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("hit").alias("n_found"))
    return sums.select("*", F.coalesce(F.try_divide(F.col("n_found"), F.col("n_pairs")), F.lit(1.0)).alias("recall"))


def joinable_columns(catalog: Catalog, least: float = 0.5) -> DataFrame:
    """Pairs of columns of different tables whose sets of values overlap, with their exact Jaccard similarity.

    Values meet by an equi-join on the value, and only counts leave it.
    """
    counts = reduce(DataFrame.unionByName, [value_counts(df, t) for t, df in catalog.tables.items()]).select("table", "column", "value")
    sizes = counts.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"))
    left = counts.select(F.col("table").alias("table_a"), F.col("column").alias("column_a"), "value")
    right = counts.select(F.col("table").alias("table_b"), F.col("column").alias("column_b"), "value")
    shared = left.join(right, "value").where("table_a < table_b").groupBy("table_a", "column_a", "table_b", "column_b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = (sizes.select(F.col("table").alias(f"table_{x}"), F.col("column").alias(f"column_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    scored = shared.join(a, ["table_a", "column_a"]).join(b, ["table_b", "column_b"])
    return scored.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).where(F.col("jaccard") >= least)


def index_sizes(values: DataFrame) -> DataFrame:
    """Entries of the index by table and column."""
    return values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n_entries"))
