"""Relational queries: written for SQLite and run through the rewriter where the dialects differ, each with the same in DuckDB."""

from __future__ import annotations

from gristmill.functions.dialect import sql_sqlite
from gristmill.sources.catalog import load_catalog

#: (name, query for SQLite, query for DuckDB or None where it is the same).
_PAIRS: list[tuple[str, str, str | None]] = [
    ("r_project_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 OR o_orderkey IS NULL", None),
    ("r_inner_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", None),
    ("r_join_four", "SELECT r_name, COUNT(*) AS n, SUM(o_totalprice) > 0 AS some FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    ("r_left_join_count", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    ("r_theta_join", "SELECT COUNT(*) AS n FROM region a, nation b WHERE a.r_regionkey < b.n_nationkey", None),
    ("r_semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)", None),
    ("r_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", None),
    ("r_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)", None),
    ("r_scalar_subquery", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    ("r_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    ("r_derived", "SELECT MAX(n) AS most FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) t", None),
    ("r_cte", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12) SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey", None),
    ("r_having", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600", None),
    ("r_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", None),
    ("r_distinct", "SELECT DISTINCT p_brand, p_size FROM part", None),
    ("r_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    ("r_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20, 5", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5 OFFSET 20"),
    ("r_case_ratio", "SELECT CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS REAL) * 100 / COUNT(*) AS pct FROM orders", "SELECT SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::DOUBLE * 100 / COUNT(*) AS pct FROM orders"),
    ("r_iif", "SELECT c_custkey, IIF(c_acctbal > 0, 'YES', 'NO') AS rich FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'YES' ELSE 'NO' END AS rich FROM customer"),
    ("r_cast_prefix", "SELECT n_nationkey, CAST(SUBSTR(n_name, 8) || 'x' AS INTEGER) AS n, CAST('4.5e1abc' AS REAL) AS r FROM nation", "SELECT n_nationkey, substr(n_name, 8)::BIGINT AS n, 45.0::DOUBLE AS r FROM nation"),
    ("r_integer_division", "SELECT o_orderkey, o_custkey / 7 AS q, o_custkey / 7.0 AS r, o_custkey / (o_orderkey - o_orderkey) AS z FROM orders", "SELECT o_orderkey, (o_custkey // 7)::DOUBLE AS q, o_custkey / 7.0::DOUBLE AS r, NULL::DOUBLE AS z FROM orders"),
    ("r_substr_like", "SELECT c_custkey, SUBSTR(c_name, -3) AS tail FROM customer WHERE c_mktsegment LIKE 'buil%'", "SELECT c_custkey, right(c_name, 3) AS tail FROM customer WHERE c_mktsegment ILIKE 'buil%'"),
    ("r_concat", "SELECT n_name || '-' || n_regionkey AS both FROM nation", "SELECT n_name || '-' || n_regionkey AS both FROM nation"),
    ("r_between", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20", None),
    ("r_round", "SELECT ROUND(AVG(l_extendedprice), 2) AS m FROM lineitem", None),
    ("r_scalar_min_max", "SELECT n_nationkey, MIN(n_nationkey, n_regionkey, 3) AS lo, MAX(n_nationkey, n_regionkey) AS hi, LENGTH(n_name) AS len FROM nation", "SELECT n_nationkey, least(n_nationkey, n_regionkey, 3) AS lo, greatest(n_nationkey, n_regionkey) AS hi, length(n_name)::INTEGER AS len FROM nation"),
    ("r_strftime_year", "SELECT STRFTIME('%Y', o_orderdate) AS y, STRFTIME('%m-%d', o_orderdate) AS md, COUNT(*) AS n FROM orders GROUP BY STRFTIME('%Y', o_orderdate), STRFTIME('%m-%d', o_orderdate)", "SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m-%d') AS md, count(*) AS n FROM orders GROUP BY 1, 2"),
    ("r_julianday_age", "SELECT o_orderkey, ROUND(JULIANDAY('2002-01-01') - JULIANDAY(o_orderdate), 3) AS days FROM orders", "SELECT o_orderkey, round((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 86400, 3) AS days FROM orders"),
    ("r_text_dates", "SELECT o_orderkey, STRFTIME('%Y', o_orderdate) - STRFTIME('%m', o_orderdate) AS d, '2002-06-01' - o_orderdate AS age, STRFTIME('%Y', o_orderdate) - 1990 AS since, DATETIME() - CURRENT_TIMESTAMP AS z FROM orders", "SELECT o_orderkey, (year(o_orderdate) - month(o_orderdate))::BIGINT AS d, 2002 - year(o_orderdate) AS age, year(o_orderdate) - 1990 AS since, 0::BIGINT AS z FROM orders"),
    ("r_group_concat", "SELECT c_nationkey, LENGTH(GROUP_CONCAT(c_name, ';')) AS n, GROUP_CONCAT(DISTINCT SUBSTR(c_name, 1, 3)) AS starts FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, length(string_agg(c_name, ';'))::INTEGER AS n, string_agg(DISTINCT substr(c_name, 1, 3), ',') AS starts FROM customer GROUP BY c_nationkey"),
    ("r_quoted_names", 'SELECT "n_name" AS `the name`, [n_regionkey] AS k FROM "nation" WHERE "n_name" <> \'x"y\'', 'SELECT n_name AS "the name", n_regionkey AS k FROM nation'),
    ("r_divide_by_zero", "SELECT n_nationkey, n_nationkey / n_regionkey AS q FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE (n_nationkey // n_regionkey)::DOUBLE END AS q FROM nation"),
    ("r_setops", "SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation EXCEPT SELECT 3 INTERSECT SELECT 3", None),
    ("r_union_all", "SELECT COUNT(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) t", None),
    ("r_window_rank", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders", "SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INTEGER AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders"),
    ("r_window_frame", "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q FROM orders", "SELECT o_orderkey, (sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS s, (ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS q FROM orders"),
    ("r_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    ("r_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    ("r_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t", None),
    ("r_pricing_summary", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    ("r_top_customers", "SELECT c_custkey, ROUND(SUM(l_extendedprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey ORDER BY spent DESC, c_custkey LIMIT 20", None),
]


def _query(sql: str):
    def query(spark, sf_dir):
        load_catalog(spark, sf_dir).register()
        return sql_sqlite(spark, sql)

    return query


QUERIES = {name: _query(sql) for name, sql, _ in _PAIRS}
ORACLES = {name: duck or sql for name, sql, duck in _PAIRS}
