"""Queries on profiles and rendered schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.affinity import declared_affinity
from gristmill.operators import profile, render
from gristmill.sources.catalog import FOREIGN_KEYS, PRIMARY_KEYS, RELATIONAL, load_catalog

_TEXT = [("customer", "c_name"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("region", "r_name"), ("supplier", "s_name"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"), ("events", "props")]
_NUMBER = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("supplier", "s_suppkey"), ("part", "p_size"), ("part", "p_retailprice"), ("orders", "o_custkey"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("lineitem", "l_linenumber"), ("events", "value"), ("events", "user_id")]
_TIME = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
_ALL = sorted(_TEXT + _NUMBER + _TIME)

#: Declared types whose affinity is asked, each by a rule of its own.
_DECLARED = ("INTEGER", "bigint", "POINT", "CHARINT", "VARCHAR(20)", "text", "CLOB", "", "  ", "BLOB", "none", "REAL", "float", "DOUBLE PRECISION", "DATE", "DATETIME", "BOOLEAN", "DECIMAL(10,2)", "STRING")


def _stats(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]], *measures: str) -> DataFrame:
    """Statistics of the named columns: one aggregation of each table, which reads those columns only."""
    names: dict[str, list[str]] = {}
    for t, c in columns:
        names.setdefault(t, []).append(c)
    tables = load_catalog(spark, sf_dir, names).tables
    return reduce(DataFrame.unionByName, [profile.column_statistics(tables[t].select(*cs), t, measures) for t, cs in names.items()])


def _counts(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]]) -> DataFrame:
    names: dict[str, list[str]] = {}
    for t, c in columns:
        names.setdefault(t, []).append(c)
    tables = load_catalog(spark, sf_dir, names).tables
    return reduce(DataFrame.unionByName, [profile.value_counts(tables[t], t, cs) for t, cs in names.items()])


def profile_nulls(spark, sf_dir):
    return _stats(spark, sf_dir, _ALL, "null_count").select("table", "column", "total_rows", "null_count", "null_rate")


def profile_distinct(spark, sf_dir):
    return _counts(spark, sf_dir, _ALL).groupBy("table", "column").agg(F.count(F.lit(1)).alias("distinct_count"))


def profile_distinct_estimate(spark, sf_dir):
    tables = load_catalog(spark, sf_dir).tables
    return reduce(DataFrame.unionByName, [profile.profile_table(df, t, exact=False).select("table", "column", "distinct_count") for t, df in tables.items()])


def profile_topk_values(spark, sf_dir):
    return profile.top_values(_counts(spark, sf_dir, _TEXT)).select("table", "column", "value", "freq", "rank")


def profile_numeric_stats(spark, sf_dir):
    return _stats(spark, sf_dir, _NUMBER, "min_value", "max_value", "avg_value").select("table", "column", "min_value", "max_value", F.round("avg_value", 4).alias("avg_value"))


def profile_time_range(spark, sf_dir):
    return _stats(spark, sf_dir, _TIME, "min_time", "max_time").select("table", "column", "min_time", "max_time")


def profile_text_length(spark, sf_dir):
    return _stats(spark, sf_dir, _TEXT, "avg_length").select("table", "column", F.round("avg_length", 6).alias("avg_length"))


def profile_type_affinity(spark, sf_dir):
    frame = spark.createDataFrame([(d,) for d in _DECLARED], "declared string")
    return frame.select("declared", declared_affinity(F.col("declared")).alias("affinity"))


def profile_totals(spark, sf_dir):
    return profile.totals(load_catalog(spark, sf_dir).column_frame())


def profile_keys(spark, sf_dir):
    return load_catalog(spark, sf_dir).column_frame().where("is_primary_key OR foreign_key IS NOT NULL").select("table", "column", "ordinal", "affinity", "is_primary_key", "foreign_key")


def fk_containment(spark, sf_dir):
    return profile.key_containment(load_catalog(spark, sf_dir))


def column_signatures(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir, ["nation", "part", "region", "supplier"])
    return profile.column_signatures(catalog).withColumn("minhash", profile.decode_signature(profile.encode_signature(F.col("minhash"))))


def column_summaries(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir)
    rows = catalog.column_frame().select("table", "column", render.default_summary().alias("text"))
    return rows.select("table", "column", F.substring("text", 1, render.SHORT).alias("short_summary"), F.substring("text", 1, render.LONG).alias("long_summary"))


def _rendered(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir, ["nation", "part", "region", "supplier"])
    found = profile.profile_catalog(catalog)
    return catalog, found, render.summarize(found)


def schema_ddl(spark, sf_dir):
    catalog, found, summaries = _rendered(spark, sf_dir)
    return render.whole_schema(render.ddl(found, summaries, catalog.foreign_key_frame()))


def schema_markdown(spark, sf_dir):
    _, found, summaries = _rendered(spark, sf_dir)
    return render.whole_schema(render.markdown(found, summaries))


def schema_markdown_regions(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir, ["region"])
    found = profile.profile_catalog(catalog)
    return render.markdown(found, render.summarize(found))


def schema_parsed(spark, sf_dir):
    """Both renderings read back: their columns with types and keys."""
    catalog, found, summaries = _rendered(spark, sf_dir)
    from_ddl = render.parse_ddl(render.whole_schema(render.ddl(found, summaries, catalog.foreign_key_frame()))).withColumn("form", F.lit("ddl"))
    from_markdown = render.parse_markdown(render.whole_schema(render.markdown(found, summaries))).withColumn("form", F.lit("markdown"))
    return from_ddl.unionByName(from_markdown)


QUERIES = {
    f.__name__: f
    for f in (profile_nulls, profile_distinct, profile_distinct_estimate, profile_topk_values, profile_numeric_stats, profile_time_range, profile_text_length, profile_type_affinity, profile_totals, profile_keys, fk_containment, column_signatures, column_summaries, schema_ddl, schema_markdown, schema_markdown_regions, schema_parsed)
}


def _each(columns: list[tuple[str, str]], body: str) -> str:
    return "\nUNION ALL\n".join(body.format(t=t, c=c) for t, c in columns)


def _column_values() -> str:
    keys = ", ".join(f"('{t}', '{c}')" for t, cs in PRIMARY_KEYS.items() for c in cs)
    refs = ", ".join(f"('{t}', '{c}', '{rt}.{rc}')" for t, c, rt, rc in FOREIGN_KEYS)
    tables = ", ".join(f"'{t}'" for t in RELATIONAL)
    return f"""WITH k(t, c) AS (VALUES {keys}), r(t, c, ref) AS (VALUES {refs}),
cols AS (SELECT table_name AS t, column_name AS c, column_index - 1 AS ordinal, data_type FROM duckdb_columns() WHERE table_name IN ({tables}))"""


_AFFINITY = "CASE WHEN data_type IN ('INTEGER', 'BIGINT', 'SMALLINT', 'TINYINT') THEN 'INTEGER' WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'REAL' WHEN data_type = 'VARCHAR' THEN 'TEXT' ELSE 'NUMERIC' END"

ORACLES = {
    "profile_nulls": _each(_ALL, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS total_rows, count(*) - count({c}) AS null_count, CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c}))::DOUBLE / count(*) END AS null_rate FROM {t}"),
    "profile_distinct": _each(_ALL, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {t}"),
    "profile_topk_values": _each(
        _TEXT,
        "SELECT '{t}' AS \"table\", '{c}' AS \"column\", value, freq, rank::INTEGER AS rank FROM (SELECT {c} AS value, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10",
    ),
    "profile_numeric_stats": _each(_NUMBER, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}::DOUBLE), 4) AS avg_value FROM {t}"),
    "profile_time_range": _each(_TIME, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max_time FROM {t}"),
    "profile_text_length": _each(_TEXT, "SELECT '{t}' AS \"table\", '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length FROM {t}"),
    "profile_type_affinity": "SELECT declared, CASE WHEN trim(declared) = '' THEN 'BLOB' WHEN contains(upper(declared), 'INT') THEN 'INTEGER' WHEN regexp_matches(upper(declared), 'CHAR|CLOB|TEXT') THEN 'TEXT' "
    "WHEN upper(trim(declared)) IN ('BLOB', 'NONE') THEN 'BLOB' WHEN regexp_matches(upper(declared), 'REAL|FLOA|DOUB') THEN 'REAL' ELSE 'NUMERIC' END AS affinity "
    f"FROM (VALUES {', '.join(f'({d!r})' for d in _DECLARED)}) AS v(declared)",
    "profile_totals": _column_values() + " SELECT count(DISTINCT t) AS total_tables, count(*) AS total_columns FROM cols",
    "profile_keys": _column_values() + f' SELECT t AS "table", c AS "column", ordinal::INTEGER AS ordinal, {_AFFINITY} AS affinity, k.c IS NOT NULL AS is_primary_key, ref AS foreign_key FROM cols LEFT JOIN k USING (t, c) LEFT JOIN r USING (t, c) WHERE k.c IS NOT NULL OR ref IS NOT NULL',
    "schema_parsed": _column_values() + f' SELECT t AS "table", ordinal::INTEGER AS ordinal, c AS "column", {_AFFINITY} AS affinity, k.c IS NOT NULL AS is_primary_key, CASE WHEN t = \'nation\' OR t = \'supplier\' THEN ref END AS foreign_key, form FROM cols LEFT JOIN k USING (t, c) LEFT JOIN r USING (t, c), (VALUES (\'ddl\'), (\'markdown\')) AS v(form) WHERE t IN (\'nation\', \'part\', \'region\', \'supplier\')',
    "column_summaries": _column_values() + " SELECT t AS \"table\", c AS \"column\", 'The ' || c || ' field in the ' || t || ' table.' AS short_summary, 'The ' || c || ' field in the ' || t || ' table.' AS long_summary FROM cols",
    "schema_markdown_regions": """SELECT 'region' AS "table", '## Table: region' || chr(10) || '*The r_regionkey field in the region table.*' || chr(10) || chr(10) || '| Column | Type | Description | Sample Values |' || chr(10) || '|--------|------|-------------|---------------|' || chr(10)
|| '| r_regionkey | INTEGER (PK) | The r_regionkey field in the region table. | ' || (SELECT string_agg(v, ', ') FROM (SELECT r_regionkey::VARCHAR AS v FROM region ORDER BY v LIMIT 3)) || ' |' || chr(10)
|| '| r_name | TEXT | The r_name field in the region table. | ' || (SELECT string_agg(v, ', ') FROM (SELECT r_name AS v FROM region GROUP BY r_name ORDER BY count(*) DESC, v LIMIT 3)) || ' |' AS block""",
}


def _containment() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS from_table, '{c}' AS from_column, '{rt}' AS to_table, '{rc}' AS to_column, count(*) FILTER (WHERE {c} IS NOT NULL) AS n_rows, count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt})) AS n_orphans FROM {t}"
        for t, c, rt, rc in sorted(FOREIGN_KEYS)
    )


ORACLES["fk_containment"] = _containment()
