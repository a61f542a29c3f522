"""Databases as namespaces of tables, their declared keys, and the loader of question sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.affinity import spark_affinity

#: Keys of the TPC-H tables; Parquet states none.
PRIMARY_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
]
RELATIONAL = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")

SPLITS = {"dev": "dev.json", "train": "train.json", "mini_dev": "mini_dev.json"}
DIFFICULTIES = ("simple", "moderate", "challenging")


@dataclass
class Catalog:
    """One database: tables in order of their names, with primary keys and foreign keys ``(table, column, table, column)``."""

    db_id: str
    tables: dict[str, DataFrame]
    primary_keys: dict[str, list[str]] = field(default_factory=dict)
    foreign_keys: list[tuple[str, str, str, str]] = field(default_factory=list)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.tables.values())).sparkSession

    def columns(self) -> list[tuple[str, str, int, str, str]]:
        """(table, column, ordinal, Spark type, affinity) in order."""
        return [(t, f.name, i, f.dataType.simpleString(), spark_affinity(f.dataType)) for t, df in self.tables.items() for i, f in enumerate(df.schema.fields)]

    def column_frame(self) -> DataFrame:
        """Structural schema as a table: one row per column with its keys; of several foreign keys the last counts."""
        refs = {(t, c): f"{rt}.{rc}" for t, c, rt, rc in self.foreign_keys if t in self.tables}
        rows = [(*c, c[1] in self.primary_keys.get(c[0], ()), refs.get(c[:2])) for c in self.columns()]
        return self.spark.createDataFrame(rows, "table string, column string, ordinal int, data_type string, affinity string, is_primary_key boolean, foreign_key string")

    def key_frame(self) -> DataFrame:
        rows = [(t, c) for t, cs in self.primary_keys.items() if t in self.tables for c in cs]
        return self.spark.createDataFrame(rows, "table string, column string")

    def foreign_key_frame(self) -> DataFrame:
        rows = [fk for fk in self.foreign_keys if fk[0] in self.tables]
        return self.spark.createDataFrame(rows, "from_table string, from_column string, to_table string, to_column string")

    def register(self) -> Catalog:
        """Make the tables temporary views, so that SQL finds them."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self


def load_catalog(spark: SparkSession, folder: str, tables: Iterable[str] = RELATIONAL, db_id: str = "main", primary_keys=None, foreign_keys=None) -> Catalog:
    """The Parquet tables of a folder; a table that is missing raises, as a missing database does."""
    frames = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in sorted(tables)}
    return Catalog(db_id, frames, PRIMARY_KEYS if primary_keys is None else primary_keys, FOREIGN_KEYS if foreign_keys is None else foreign_keys)


def discover_tables(spark: SparkSession, folder: str, only: Iterable[str] | None = None) -> list[str]:
    """Names of the Parquet tables of a folder, in order, through Hadoop's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    found = sorted(n.removesuffix(".parquet") for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.endswith(".parquet"))
    return [n for n in found if only is None or n in set(only)]


QUESTION = "question_id int, db_id string, question string, evidence string, SQL string, difficulty string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def load_questions(spark: SparkSession, split: str, folder: str) -> DataFrame:
    """Questions of a split: ``<folder>/<split>/<file>``, else ``<folder>/<file>``; no file gives no rows.

    Records are normalised: SQL may be called query or sql, a missing id is the place in the file, evidence null is empty,
    difficulty is lower-cased and simple where missing. Records without question, database or known difficulty are skipped.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; one of {', '.join(SPLITS)}")
    for path in (f"{folder}/{split}/{SPLITS[split]}", f"{folder}/{SPLITS[split]}"):
        if _exists(spark, path):
            return _normalised(spark, path)
    return spark.createDataFrame([], QUESTION)


def _normalised(spark: SparkSession, path: str) -> DataFrame:
    # A JSON array is one record of the file; VARIANT keeps keys that differ in case only apart.
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    items = whole.select(F.expr("posexplode(try_variant_get(v, '$', 'array<variant>'))").alias("place", "r"))

    def text(name: str):
        return F.try_variant_get("r", f"$.{name}", "string")

    sql = F.coalesce(*[F.when(text(n) != "", text(n)) for n in ("SQL", "query", "sql")], F.lit(""))
    rows = items.select(
        F.coalesce(F.try_variant_get("r", "$.question_id", "int"), F.col("place")).alias("question_id"),
        text("db_id").alias("db_id"),
        text("question").alias("question"),
        F.coalesce(text("evidence"), F.lit("")).alias("evidence"),
        sql.alias("SQL"),
        F.lower(F.btrim(F.coalesce(text("difficulty"), F.lit("simple")))).alias("difficulty"),
    )
    return rows.where(F.col("db_id").isNotNull() & F.col("question").isNotNull() & F.col("difficulty").isin(*DIFFICULTIES))
