import pytest
from pyspark.sql import functions as F

from gristmill.functions import dialect, text
from gristmill.operators import execute


def test_guards(spark):
    spark.range(200).createOrReplaceTempView("items")
    ok = execute.execute_sql(spark, "SELECT id FROM items WHERE id < 3")
    assert ok.success and sorted(ok.rows) == [(0,), (1,), (2,)] and ok.columns == ["id"] and not ok.is_empty
    empty = execute.execute_sql(spark, "SELECT id FROM items WHERE id < 0")
    assert empty.success and empty.is_empty
    product = execute.execute_sql(spark, "SELECT a.id FROM items a, items b")
    assert not product.success and product.rows == [] and not product.is_empty
    limited = execute.execute_sql(spark, "SELECT a.id FROM items a, items b LIMIT 20000")
    assert limited.success and len(limited.rows) == 10_000


@pytest.mark.parametrize("sql", ["DROP TABLE items", "CREATE TABLE t AS SELECT 1", "INSERT INTO items VALUES (1)", "SET a = 1", "SELECT nothing FROM items", "", "SELEC"])
def test_what_fails_is_a_value(spark, sql):
    spark.range(2).createOrReplaceTempView("items")
    r = execute.execute_sql(spark, sql)
    assert not r.success and r.error and not r.is_empty
    assert spark.table("items").count() == 2


def test_timeout_leaves_the_session_usable(spark):
    r = execute.execute_sql(spark, "SELECT count(*) FROM range(4000000) a JOIN range(400000) b ON a.id % 7 < b.id % 11", timeout=1.0)
    assert not r.success and "timed out after 1.0s" in r.error and r.execution_time < 30
    assert execute.execute_sql(spark, "SELECT 1").rows == [(1,)]


def test_error_categories(spark):
    cases = [("x", True, None, "empty_result"), (None, False, None, "other"), ('near "x": syntax error', False, None, "syntax"), ("no such column: a", False, None, "schema"), ("datatype mismatch", False, None, "type"), ("as per the syntax", False, "CAST_INVALID_INPUT", "type"), ("?", False, "PARSE_SYNTAX_ERROR", "syntax"), ("?", False, "UNRESOLVED_COLUMN.WITH_SUGGESTION", "schema")]
    df = spark.createDataFrame(cases, "m string, e boolean, c string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", execute.error_category(F.col("m"), F.col("e"), F.col("c"))).collect())


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 7 / 2, 7 / 2.0, 7 / 0, (1 + 6) / 2 * 3", (3.0, 3.5, None, 9.0)),
        ("SELECT -7 / 2, 2 * 7 / 4", (-3.0, 3.0)),
        ("SELECT '/' || 'LIKE' || 'IIF(1,2,3)' -- a / b\n", ("/LIKEIIF(1,2,3)",)),
        ("SELECT 'ABC' LIKE 'a%', 'abc' == 'abc'", (True, True)),
        ("SELECT CAST('12abc' AS INTEGER), CAST('abc' AS REAL), CAST(NULL AS INTEGER), CAST('-3.5e2x' AS REAL), CAST(5 AS TEXT)", (12, 0.0, None, -350.0, "5")),
        ("SELECT IIF(1 > 2, 'a', IIF(2 > 1, 'b', 'c')), MAX(1, 5, 3), MIN(4, NULL), INSTR('hello', 'l')", ("b", 5, None, 3)),
        ("SELECT STRFTIME('%Y-%m', '2014-03-05'), JULIANDAY('2014-01-01'), DATE('2014-03-05 10:00:00')", ("2014-03", 2456658.5, "2014-03-05")),
        ("SELECT \"a b\" FROM (SELECT 1 AS `a b`) t LIMIT 0, 1", (1,)),
        ("SELECT GROUP_CONCAT(x, '-') FROM (SELECT 'q' AS x) t", ("q",)),
    ],
)
def test_dialect(spark, sql, want):
    assert tuple(dialect.sql_sqlite(spark, sql).head()) == want


def test_text_functions(spark):
    df = spark.createDataFrame([("```sql\nSELECT  a\nFROM t;\n```", "Who are the top 5 of 'Al 7' in 12.5 Berlin City, or last 3?")], "s string, q string")
    r = df.select(text.clean_sql(df.s), text.mask_question(df.q), text.limit_from_question(df.q), text.keywords(df.q), text.quote_name(df.s)).head()
    assert tuple(r)[:4] == ("SELECT a FROM t", "Who are the top [NUM] of [STR] in [NUM] [ENTITY], or last [NUM]?", 5, ["top", "12.5", "Berlin", "City", "last"])
    answers = spark.createDataFrame([("`SELECT 1`",), ("```SELECT 2",), ("SELECT 3 ; ; ",), ("```\nSELECT 4\n``` and more",)], "s string")
    assert [r[0] for r in answers.select(text.clean_sql(answers.s)).collect()] == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT 4"]
    order = spark.createDataFrame([("the most of all",), ("least and most",), ("nothing",), ("worst",)], "q string")
    assert [r[0] for r in order.select(text.direction_from_question(order.q)).collect()] == ["DESC", None, None, "ASC"]


def test_results_beyond_the_preview_count_as_wholes(spark):
    spark.range(25_000).createOrReplaceTempView("many")
    a, b, c = (execute.execute_sql(spark, q) for q in ("SELECT id FROM many ORDER BY id LIMIT 20000", "SELECT id FROM many WHERE id < 20000 ORDER BY id DESC LIMIT 30000", "SELECT id + 1 AS id FROM many LIMIT 20000"))
    assert [(r.success, r.truncated, r.n_rows, len(r.rows)) for r in (a, b, c)] == [(True, True, 20_000, 10_000)] * 3
    assert a.key == b.key != c.key
    small = execute.execute_sql(spark, "SELECT id FROM many LIMIT 3")
    assert (small.n_rows, small.truncated, small.key) == (3, False, None)


def test_names_in_sql_are_read_as_tokens(spark):
    cases = {
        "SELECT t.a_b, `c d` FROM \"e \"\"f\" t WHERE x = 'it''s FROM gh' -- ij\n AND kl > 1e5 /* mn */": ["a_b", "c d", 'e "f', "kl"],
        "select [odd name], count(*) from tab where y2 like '%z%'": ["odd name", "tab", "y2"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.n for r in df.select("s", text.sql_identifiers(df.s).alias("n")).collect()} == cases
