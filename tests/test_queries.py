"""Every query against its SQL in DuckDB, and those without SQL against what they must hold."""

import math

import duckdb
import pytest

from gristmill.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{x:.9g}" if abs(x) < 10**9 else str(x)
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, sf_dir, db, name):
    found = registry.QUERIES[name](spark, sf_dir)
    want = db.sql(registry.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.select(quoted).fetchall())


def test_every_query_without_sql_is_named_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"profile_distinct_estimate", "column_signatures", "schema_ddl", "schema_markdown", "lsh_candidate_pairs", "lsh_recall", "partitioned_index_recall", "ground_matches", "similar_questions"}


def test_estimates_are_near(spark, sf_dir):
    exact = {(r.table, r.column): r.distinct_count for r in registry.QUERIES["profile_distinct"](spark, sf_dir).collect()}
    near = {(r.table, r.column): r.distinct_count for r in registry.QUERIES["profile_distinct_estimate"](spark, sf_dir).collect()}
    assert all(abs(near[k] - n) <= max(2, 0.2 * n) for k, n in exact.items())


def test_bands_find_similar_values(spark, sf_dir):
    r = registry.QUERIES["lsh_recall"](spark, sf_dir).head()
    assert r.n_pairs > 0 and r.recall >= 0.95
    assert registry.QUERIES["lsh_candidate_pairs"](spark, sf_dir).count() > 0


def test_partitioned_index_recall(spark, sf_dir):
    r = registry.QUERIES["partitioned_index_recall"](spark, sf_dir).head()
    assert r.n_exact == 250 and r.recall >= 0.9


def test_flagship(spark, sf_dir):
    rows = {r.column: r for r in registry.flagship(spark, sf_dir).collect()}
    assert list(rows) == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    r = rows["o_orderpriority"]
    assert (r.affinity, r.total_rows, r.null_count, r.distinct_count, r.top_values[0].value, r.top_values[0].freq, round(r.avg_length, 4)) == ("TEXT", 1500, 0, 5, "3-MEDIUM", 320, 8.3767)
    r = rows["o_orderdate"]
    assert (r.affinity, r.distinct_count, r.top_values[0].value, r.top_values[0].freq, r.min_time, r.max_time) == ("NUMERIC", 1094, "1995-06-19 00:00:00", 5, "1995-01-01 00:00:00", "2001-08-01 00:00:00")
    r = rows["o_totalprice"]
    assert (r.affinity, r.distinct_count, r.top_values[0].value, r.min_value, r.max_value, round(r.avg_value, 4)) == ("REAL", 1500, "100279.4", 1320.51, 499705.05, 249631.1944)


def test_grounding_and_examples(spark, sf_dir):
    cells = registry.QUERIES["ground_matches"](spark, sf_dir).collect()
    assert cells and len({(r.query_id, r.table, r.column) for r in cells}) == len(cells)
    found = registry.QUERIES["similar_questions"](spark, sf_dir).collect()
    asked = {r.question_id: r.db_id for r in spark.sql("select cast(c_custkey as int) question_id, concat('db', cast(c_nationkey % 5 as string)) db_id from customer").collect()}
    assert found and all(r.db_id != asked[r.question_id] and r.rank <= 8 for r in found)


def test_rendered_schemas(spark, sf_dir):
    ddl = registry.QUERIES["schema_ddl"](spark, sf_dir).head()[0]
    assert ddl.startswith("-- Table: nation\nCREATE TABLE nation (\n  n_nationkey INTEGER PRIMARY KEY,  -- The n_nationkey field in the nation table.\n")
    assert "  n_regionkey INTEGER  -- The n_regionkey field in the nation table. | FK → region.r_regionkey\n);\n-- Foreign keys: n_regionkey REFERENCES region(r_regionkey)\n-- Example row: (0, 'NATION_0', 0)\n" in ddl
    markdown = registry.QUERIES["schema_markdown"](spark, sf_dir).head()[0]
    assert "| n_regionkey | INTEGER (FK→region.r_regionkey) | The n_regionkey field in the nation table. |" in markdown and markdown.endswith("|\n")
