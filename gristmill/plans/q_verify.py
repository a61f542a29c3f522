"""Queries on semantic checks and on errors."""

from __future__ import annotations


from pyspark.sql import functions as F

from gristmill.operators import execute, verify
from gristmill.plans import fixtures


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grain_check(spark, sf_dir):
    """Rows of customers' orders per segment, within bounds from the tables' sizes."""
    n = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_rows"))
    upper = _read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg((F.count(F.lit(1)) * 10).alias("upper"))
    return n.join(upper, n.c_mktsegment == upper.s).select("c_mktsegment", "n_rows", verify.grain_bounds(F.col("n_rows"), F.lit(1), F.col("upper")).alias("status"))


def null_cells_pct(spark, sf_dir):
    df = _read(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), F.nullif("c_nationkey", F.lit(3)).alias("n"), "c_name")
    return verify.null_cells(df).select("*", (F.col("n_nulls") > F.col("n_cells") * verify.NULL_SHARE).alias("fails"))


def duplicate_ratio(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("expected"))
    return rows.select("*", (F.col("n_rows") / F.col("expected") >= verify.DUPLICATE_RATIO).alias("fails"))


def exact_duplicates(spark, sf_dir):
    return verify.exact_duplicates(_read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


def scale_violations(spark, sf_dir):
    return verify.scale_violations(_read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag"), 0.01, 45)


def symmetry_check(spark, sf_dir):
    by_order = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("a"))
    by_part = _read(spark, sf_dir, "lineitem").where("l_quantity > 1").groupBy(F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("b"))
    return by_order.join(by_part, by_order.l_returnflag == by_part.f).select("l_returnflag", verify.symmetric(F.col("a"), F.col("b")).alias("agrees"))


_SQLS = [("SELECT a FROM t ORDER BY a LIMIT 5", "", 5), ("SELECT a FROM t ORDER BY a LIMIT 3", "", 5), ("SELECT a FROM t LIMIT 9", "", 5), ("SELECT a FROM t ORDER BY a", "", None), ("select max(a) from t", "MAX", None), ("SELECT a FROM t", "ORDER BY,DESC", None)]


def ordering_check(spark, sf_dir):
    rows = spark.createDataFrame([(i, s, k.split(",") if k else [], n) for i, (s, k, n) in enumerate(_SQLS)], "id int, sql string, keywords array<string>, order_limit int")
    return rows.select("id", verify.ordering_status(F.col("sql"), F.col("keywords"), F.col("order_limit")).alias("status"))


def boundary_check(spark, sf_dir):
    sql = F.concat(F.lit("SELECT 1 FROM t WHERE d "), F.element_at(F.array(F.lit(">= '1998-01-01'"), F.lit("= 5"), F.lit("LIKE '1998%'"), F.lit("between 3 and 4"), F.lit("IN (1998)")), (F.col("n_nationkey") % 5 + 1).cast("int")))
    return _read(spark, sf_dir, "nation").select("n_nationkey", verify.has_date_bound(sql).alias("bounded"))


def safe_sql_guard(spark, sf_dir):
    sql = F.element_at(F.array(F.lit(" select 1"), F.lit("SELECT created_at FROM t"), F.lit("WITH x AS (SELECT 1) SELECT * FROM x"), F.lit("SELECT 1; DROP TABLE t"), F.lit("SELECT a FROM b")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", execute.safe_verification_sql(sql).alias("safe"))


def verification_plan(spark, sf_dir):
    return verify.plan_from_question(fixtures.fixture(spark, sf_dir, "questions"))


def verification_rules(spark, sf_dir):
    return verify.planned_tests(fixtures.fixture(spark, sf_dir, "questions"))


def _tests(spark, sf_dir):
    status = F.element_at(F.array(F.lit("pass"), F.lit("fail"), F.lit("skip"), F.lit("error")), (F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(4)) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in verify.TESTS]), (F.col("l_linenumber") % 8 + 1).cast("int"))
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), kind.alias("test_type"), status.alias("status"))


def verification_adjustment(spark, sf_dir):
    return verify.adjustment(_tests(spark, sf_dir), ["question_id"]).select("question_id", F.round("adjustment", 6).alias("adjustment"), "all_pass")


def error_taxonomy(spark, sf_dir):
    rows = fixtures.fixture(spark, sf_dir, "errors")
    return rows.select("id", execute.error_category(F.col("message"), F.col("is_empty")).alias("category"))


def fix_instructions(spark, sf_dir):
    rows = fixtures.fixture(spark, sf_dir, "errors").withColumn("category", execute.error_category(F.col("message"), F.col("is_empty")))
    return rows.select("id", execute.fix_instruction(F.col("category"), F.col("message")).alias("instruction"))


def guarded_execution(spark, sf_dir):
    """What guarded execution says of queries that are right, wrong, empty, too large and not queries at all."""
    for t in ("nation", "lineitem"):
        _read(spark, sf_dir, t).createOrReplaceTempView(t)
    sqls = ["SELECT n_name FROM nation", "SELECT nme FROM nation", "SELEC 1", "SELECT * FROM nowhere", "SELECT n_name FROM nation WHERE n_nationkey < 0", "SELECT a.l_orderkey FROM lineitem a, nation b", "DROP TABLE nation", "SELECT CAST('x' AS INT)"]
    frame = execute.result_frame(spark, [(i, "x", execute.execute_sql(spark, s)) for i, s in enumerate(sqls)])
    category = F.when(~F.col("success"), execute.error_category(F.col("error"), F.col("is_empty"), F.col("condition")))
    return frame.select("question_id", "success", "is_empty", F.size("rows").alias("n_rows"), category.alias("category"))


def verifier_outcomes(spark, sf_dir):
    for t in ("nation", "orders"):
        _read(spark, sf_dir, t).createOrReplaceTempView(t)
    checker = verify.Verifier(spark)
    cases = {
        "SELECT n_regionkey FROM nation": [verify.Spec("grain", upper_sql="SELECT COUNT(*) FROM nation"), verify.Spec("duplicate"), verify.Spec("column_alignment", expected_columns=2), verify.Spec("null"), verify.Spec("scale", minimum=0, maximum=3)],
        "SELECT n_name FROM nation WHERE n_nationkey < 0": [verify.Spec("grain"), verify.Spec("null"), verify.Spec("boundary")],
        "SELECT COUNT(*) FROM orders": [verify.Spec("symmetry", other_sql="SELECT COUNT(o_orderkey) FROM orders"), verify.Spec("ordering", order_limit=3), verify.Spec("grain", confidence="none"), verify.Spec("duplicate", expected_sql="SELECT 1")],
    }
    rows = [(i, n, o.test_type, o.status) for i, (sql, specs) in enumerate(cases.items()) for n, o in enumerate(checker.evaluate(sql, specs))]
    return spark.createDataFrame(rows, "case_id int, place int, test_type string, status string")


QUERIES = {
    f.__name__: f
    for f in (grain_check, null_cells_pct, duplicate_ratio, exact_duplicates, scale_violations, symmetry_check, ordering_check, boundary_check, safe_sql_guard, verification_plan, verification_rules, verification_adjustment, error_taxonomy, fix_instructions, guarded_execution, verifier_outcomes)
}

_ERRORS = f"({fixtures.ERRORS})"
_CATEGORY = "CASE WHEN is_empty THEN 'empty_result' WHEN message IS NULL THEN 'other' WHEN contains(lower(message), 'syntax') THEN 'syntax' WHEN regexp_matches(lower(message), 'no such column|no such table|ambiguous column') THEN 'schema' WHEN regexp_matches(lower(message), 'datatype mismatch|type mismatch|cannot compare') THEN 'type' ELSE 'other' END"
_TYPES = ", ".join(f"'{t}'" for t in verify.TESTS)
_LIMITED = "CASE question_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 4 THEN 12 END::INTEGER"
_ONE = f"(regexp_matches(question, '{verify.ONE_NUMBER}') AND NOT regexp_matches(question, '{verify.BY_GROUP}') AND {_LIMITED} IS NULL)"
ORACLES = {
    "verification_rules": f"""SELECT question_id, {_ONE} AS one_row, coalesce({_LIMITED}, 1) AS least_rows, {_LIMITED} AS order_limit, question_id % 6 IN (0, 1, 2, 4) AS wants_ordering, question_id % 6 = 2 AS wants_boundary,
regexp_matches(question, '{verify.SPARSE}') AND NOT {_ONE} AS wants_null, regexp_matches(question, '{verify.LISTED}') AND NOT {_ONE} AS wants_duplicate, regexp_matches(question, '{verify.SHARE}') AS wants_scale FROM ({fixtures.QUESTIONS})""",
    "grain_check": "SELECT c_mktsegment, n AS n_rows, CASE WHEN n >= 1 AND n <= u THEN 'pass' ELSE 'fail' END AS status FROM (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) JOIN (SELECT c_mktsegment, count(*) * 10 AS u FROM customer GROUP BY 1) USING (c_mktsegment)",
    "null_cells_pct": "SELECT count(*) AS n_rows, count(*) * 3 AS n_cells, (2 * count(*) - count(nullif(c_mktsegment, 'BUILDING')) - count(nullif(c_nationkey, 3))) AS n_nulls, (2 * count(*) - count(nullif(c_mktsegment, 'BUILDING')) - count(nullif(c_nationkey, 3))) > count(*) * 3 * 0.1 AS fails FROM customer",
    "duplicate_ratio": "SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_orderkey) AS expected, count(*)::DOUBLE / count(DISTINCT o_orderkey) >= 2 AS fails FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "exact_duplicates": "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS n_distinct FROM lineitem",
    "scale_violations": "SELECT (count(*) FILTER (WHERE l_quantity < 0.01 OR l_quantity > 45) + count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 45))::BIGINT AS n_violations FROM lineitem",
    "symmetry_check": "SELECT l_returnflag, abs(sum(l_quantity) - sum(l_quantity) FILTER (WHERE l_quantity > 1)) <= greatest(abs(sum(l_quantity)) * 0.01, 0.01) AS agrees FROM lineitem GROUP BY 1",
    "ordering_check": "SELECT * FROM (VALUES (0, 'pass'), (1, 'fail'), (2, 'fail'), (3, 'pass'), (4, 'pass'), (5, 'fail')) AS v(id, status)",
    "boundary_check": "SELECT n_nationkey, n_nationkey % 5 IN (0, 2, 3) AS bounded FROM nation",
    "safe_sql_guard": "SELECT n_nationkey, n_nationkey % 5 IN (0, 4) AS safe FROM nation",
    "verification_plan": f"""WITH p AS (SELECT question_id, question, CASE c % 6 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 4 THEN 12 END::INTEGER AS order_limit, CASE c % 6 WHEN 0 THEN 'DESC' WHEN 1 THEN 'ASC' WHEN 2 THEN 'DESC' WHEN 4 THEN 'DESC' END AS direction, c % 6 = 2 AS wants_boundary FROM (SELECT *, question_id AS c FROM ({fixtures.QUESTIONS})))
SELECT question_id, order_limit, direction, order_limit IS NOT NULL OR direction IS NOT NULL AS wants_ordering, wants_boundary FROM p""",
    "verification_adjustment": f"""WITH t AS (SELECT l_orderkey AS question_id, [{_TYPES}][l_linenumber % 8 + 1] AS tt, ['pass', 'fail', 'skip', 'error'][(l_partkey + l_linenumber) % 4 + 1] AS st FROM lineitem)
SELECT question_id, round(sum(CASE WHEN st = 'fail' AND tt IN ('grain', 'duplicate', 'column_alignment') THEN -0.3::DOUBLE WHEN st = 'fail' THEN -0.1::DOUBLE ELSE 0 END) + CASE WHEN count(*) FILTER (WHERE st = 'fail') = 0 AND count(*) FILTER (WHERE st = 'pass') > 0 THEN 0.2::DOUBLE ELSE 0 END, 6) AS adjustment, count(*) FILTER (WHERE st = 'fail') = 0 AS all_pass FROM t GROUP BY 1""",
    "error_taxonomy": f"SELECT id, {_CATEGORY} AS category FROM {_ERRORS}",
    "fix_instructions": f"""SELECT id, CASE k WHEN 'syntax' THEN 'Mend the syntax: ' || message WHEN 'type' THEN 'Make the types agree: ' || message WHEN 'empty_result' THEN 'No row came back; the conditions or the join may be too strict.'
WHEN 'schema' THEN CASE WHEN starts_with(message, 'no such') THEN 'There is no ' || regexp_extract(message, 'no such (column|table)', 1) || ' ''' || regexp_extract(message, ': (\\S+)', 1) || '''; take a name that the schema has.' ELSE 'Take names that the schema has: ' || message END
ELSE 'Mend this error: ' || coalesce(message, 'unknown') END AS instruction FROM (SELECT *, {_CATEGORY} AS k FROM {_ERRORS})""",
    "guarded_execution": "SELECT * FROM (VALUES (0, true, false, 25, NULL), (1, false, false, 0, 'schema'), (2, false, false, 0, 'syntax'), (3, false, false, 0, 'schema'), (4, true, true, 0, NULL), (5, false, false, 0, 'other'), (6, false, false, 0, 'other'), (7, false, false, 0, 'type')) AS v(question_id, success, is_empty, n_rows, category)",
    "verifier_outcomes": "SELECT * FROM (VALUES (0, 0, 'grain', 'pass'), (0, 1, 'duplicate', 'fail'), (0, 2, 'column_alignment', 'fail'), (0, 3, 'null', 'pass'), (0, 4, 'scale', 'fail'), (1, 0, 'grain', 'fail'), (1, 1, 'null', 'skip'), (1, 2, 'boundary', 'skip'), (2, 0, 'symmetry', 'pass'), (2, 1, 'ordering', 'fail'), (2, 2, 'grain', 'skip'), (2, 3, 'duplicate', 'pass')) AS v(case_id, place, test_type, status)",
}
