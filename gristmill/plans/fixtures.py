"""Small derived tables for queries on candidates, evaluations and traces: rules over the TPC-H tables, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each table is one SQL text over whole tables that Spark and DuckDB both read, so that a query and its oracle start from the same rows.

CANDIDATES = """
SELECT CAST(floor(c_custkey / 11) AS INT) AS question_id, CAST(c_custkey AS INT) AS pos,
       CASE c_custkey % 5 WHEN 0 THEN 'reasoning_A1' WHEN 1 THEN 'complex_B2_s1' WHEN 2 THEN 'icl_C1' WHEN 3 THEN 'standard_B1_s1' ELSE 'reasoning_A3' END AS generator_id,
       CASE WHEN c_custkey % 3 = 0 THEN concat('SELECT COUNT(*) FROM ', c_mktsegment) ELSE concat('SELECT ', c_name, ' FROM ', c_mktsegment) END AS sql,
       c_custkey % 7 <> 3 AS success, c_custkey % 11 = 5 AS is_empty,
       CAST(CASE WHEN c_custkey % 11 = 5 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 130 END AS BIGINT) AS n_rows,
       CAST(c_custkey % 4 AS INT) AS n_fixes, CAST(CASE c_custkey % 6 WHEN 0 THEN 0.25 WHEN 1 THEN -0.5 ELSE 0.0 END AS DOUBLE) AS adjustment,
       concat('r', c_mktsegment) AS result_key,
       c_custkey % 9 < 4 AS match_pre, c_custkey % 9 < 5 AS match_post, c_custkey % 13 = 0 AS selected
FROM customer
"""

EVALUATIONS = """
SELECT CAST(o_orderkey AS INT) AS question_id, concat('db', CAST(o_custkey % 11 AS STRING)) AS db_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty,
       CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'SELECT 1' END AS predicted_sql, o_orderstatus = 'O' AS correct,
       CASE o_orderkey % 4 WHEN 0 THEN 'fast_path' WHEN 1 THEN 'tournament' WHEN 2 THEN 'fallback' ELSE 'error' END AS selection_method,
       concat('g', CAST(o_custkey % 6 AS STRING)) AS winner_generator, CAST(o_orderkey % 5 AS INT) AS cluster_count,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS fix_count,
       CAST(o_orderkey % 16 AS DOUBLE) / 4 AS latency_seconds, CAST(o_orderkey % 8 AS DOUBLE) / 8 AS cost_estimate,
       o_orderkey % 5 = 0 AS oracle_pre, o_orderkey % 5 < 3 AS oracle_post, o_orderkey % 7 > 2 AS s2_complete, o_orderkey % 6 > 2 AS selector_matched,
       CASE WHEN o_orderkey % 29 = 0 THEN 'op7' END AS error_stage
FROM orders
"""

ITERATIONS = """
SELECT CAST(l_orderkey AS INT) AS question_id, concat('g', CAST(l_suppkey % 3 AS STRING)) AS generator_id,
       CAST(l_partkey AS INT) AS iteration, min(l_quantity) > 20 AS oracle, max(l_quantity) > 15 AS fix_triggered,
       concat('q', CAST(min(l_partkey) % 4 AS STRING)) AS sql, CASE WHEN min(l_linenumber) % 2 = 0 THEN 'fail' ELSE 'pass' END AS grain_status,
       CASE WHEN max(l_linenumber) % 3 = 0 THEN 'fail' WHEN max(l_linenumber) % 3 = 1 THEN 'pass' ELSE 'skip' END AS null_status
FROM lineitem GROUP BY l_orderkey, l_suppkey % 3, l_partkey
"""

QUESTIONS = """
SELECT CAST(c_custkey AS INT) AS question_id, concat('db', CAST(c_nationkey % 5 AS STRING)) AS db_id,
       concat(CASE c_custkey % 6 WHEN 0 THEN 'List the top 5 customers of ' WHEN 1 THEN 'What is the lowest 3 balance in ' WHEN 2 THEN 'Who was "best" in 1998 with 12.5 in '
                                 WHEN 3 THEN 'How many names, like ''Al 7'', are in ' WHEN 4 THEN 'Give the 12 highest in ' ELSE 'Is the least among the most of ' END, c_mktsegment, ' for ', c_name, '?') AS question,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('balance > ', CAST(c_custkey AS STRING)) END AS evidence,
       concat(CASE c_custkey % 5 WHEN 0 THEN '```sql' WHEN 1 THEN '`' ELSE '' END, 'SELECT c_name,  count(*) FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = ''', c_mktsegment, ''' GROUP BY c_name;  ',
              CASE c_custkey % 5 WHEN 0 THEN '```' WHEN 1 THEN '`' ELSE '' END) AS SQL,
       CASE c_custkey % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'moderate' ELSE 'challenging' END AS difficulty
FROM customer
"""

EVENTS = """
SELECT CASE user_id % 4 WHEN 0 THEN 'linker' WHEN 1 THEN 'fixer' WHEN 2 THEN 'generator' ELSE 'selector' END AS component, event_type AS trigger, 'default' AS action,
       CASE WHEN value > 50 THEN 'error' ELSE 'warning' END AS severity FROM events
"""

ERRORS = """
SELECT CAST(p_partkey AS INT) AS id, CASE p_partkey % 8 WHEN 0 THEN concat('no such column: ', p_name) WHEN 1 THEN concat('near "', p_brand, '": syntax error') WHEN 2 THEN 'ambiguous column name: x'
       WHEN 3 THEN 'datatype mismatch' WHEN 4 THEN NULL WHEN 5 THEN concat('no such table: ', p_type) WHEN 6 THEN 'Cannot compare a and b' ELSE 'disk I/O error' END AS message,
       p_partkey % 9 = 0 AS is_empty FROM part
"""

ALL = {"candidates": CANDIDATES, "evaluations": EVALUATIONS, "iterations": ITERATIONS, "questions": QUESTIONS, "fallbacks": EVENTS, "errors": ERRORS}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in ("customer", "orders", "lineitem", "events", "part"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(ALL[name])


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt words of text columns as search terms: one for every twentieth customer's segment, and some fixed ones."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    typos = customer.where(F.col("c_custkey") % 20 == 0).select(F.col("c_custkey").cast("int").alias("query_id"), F.concat(F.substring("c_mktsegment", 1, 4), F.lit("x"), F.substring("c_mktsegment", 6, 20)).alias("keyword"))
    fixed = spark.createDataFrame([(-1, "BUILDING"), (-2, "nation_1"), (-3, "urgent"), (-4, "ab"), (-5, "NATION_")], "query_id int, keyword string")
    return typos.union(fixed)


KEYWORD_SQL = """SELECT CAST(c_custkey AS INT) AS query_id, substr(c_mktsegment, 1, 4) || 'x' || substr(c_mktsegment, 6, 20) AS keyword FROM customer WHERE c_custkey % 20 = 0
UNION ALL SELECT * FROM (VALUES (-1, 'BUILDING'), (-2, 'nation_1'), (-3, 'urgent'), (-4, 'ab'), (-5, 'NATION_')) AS v(query_id, keyword)"""
