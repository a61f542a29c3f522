"""Queries on schema linking: the fields of the TPC-H tables, ranked by a rule, closed and capped."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import link, metrics
from gristmill.plans import fixtures
from gristmill.sources.catalog import FOREIGN_KEYS, PRIMARY_KEYS, RELATIONAL, load_catalog

# Every question ranks the fields by a number made of its id and the field's place; SQL does the same below.


def _available(spark, sf_dir):
    order = Window.orderBy("table", "ordinal")  # the columns of a schema
    return load_catalog(spark, sf_dir).column_frame().select("table", "column", "ordinal", F.row_number().over(order).alias("place"))


def _ranked(spark, sf_dir, n_questions: int = 25):
    """``question_id, table, column, rank``: every field for each of the first nations as questions."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where(F.col("n_nationkey") < n_questions).select(F.col("n_nationkey").alias("question_id"))
    rows = nations.join(F.broadcast(_available(spark, sf_dir)))
    by = Window.partitionBy("question_id").orderBy((F.col("place") * 7 + F.col("question_id") * 5) % 41, "place")
    return rows.select("question_id", "table", "column", F.row_number().over(by).alias("rank"))


def _hints(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("question_id"), F.when(F.col("n_nationkey") % 2 == 0, "C_NAME").otherwise("value").alias("hint"))


def _top(spark, sf_dir, n: int = 12):
    return _ranked(spark, sf_dir).where(F.col("rank") <= n)


def candidate_fields_ranked(spark, sf_dir):
    return link.candidate_fields(_top(spark, sf_dir), _available(spark, sf_dir), _hints(spark, sf_dir))


def hallucination_filter(spark, sf_dir):
    made_up = _top(spark, sf_dir, 6).select("question_id", "table", F.when(F.col("rank") % 2 == 0, F.upper("column")).otherwise(F.col("column")).alias("column"))
    known = link.known_fields(made_up, _available(spark, sf_dir)).withColumn("known", F.lit(True))
    return known.union(link.unknown_fields(made_up, _available(spark, sf_dir)).withColumn("known", F.lit(False)))


def pk_closure(spark, sf_dir):
    return link.with_primary_keys(_top(spark, sf_dir, 5), load_catalog(spark, sf_dir).key_frame())


def fk_closure(spark, sf_dir):
    return link.with_foreign_keys(_top(spark, sf_dir, 5), load_catalog(spark, sf_dir).foreign_key_frame())


def s1_cap(spark, sf_dir):
    return link.cap_s1(_ranked(spark, sf_dir).select(*link.FIELD), _top(spark, sf_dir, 15))


def s2_skip_rule(spark, sf_dir):
    s1 = _ranked(spark, sf_dir).where(F.col("rank") <= F.col("question_id"))
    return link.expansion_rule(s1.select(*link.FIELD), _top(spark, sf_dir, 15))


def s2_cap(spark, sf_dir):
    return link.cap_s2(_ranked(spark, sf_dir), _top(spark, sf_dir, 9).select(*link.FIELD), _top(spark, sf_dir, 30))


def linked_schemas(spark, sf_dir):
    """The whole of linking without a model."""
    catalog = load_catalog(spark, sf_dir)
    s1, _ = link.link(_ranked(spark, sf_dir), _available(spark, sf_dir), catalog.key_frame(), catalog.foreign_key_frame(), _hints(spark, sf_dir))
    fields = link.sorted_fields(s1)
    return fields.select("question_id", F.array_join(F.transform("fields", lambda f: F.concat_ws(".", f["table"], f["column"])), " ").alias("fields"))


def schema_recall(spark, sf_dir):
    asked = fixtures.fixture(spark, sf_dir, "questions")
    required = metrics.required_columns(asked, _available(spark, sf_dir))
    return metrics.schema_recall(required, _top(spark, sf_dir, 20))


def table_recall(spark, sf_dir):
    asked = fixtures.fixture(spark, sf_dir, "questions")
    return metrics.table_recall(metrics.required_tables(asked), _top(spark, sf_dir, 8))


def required_columns(spark, sf_dir):
    asked = fixtures.fixture(spark, sf_dir, "questions")
    return metrics.required_columns(asked, _available(spark, sf_dir))


QUERIES = {f.__name__: f for f in (candidate_fields_ranked, hallucination_filter, pk_closure, fk_closure, s1_cap, s2_skip_rule, s2_cap, linked_schemas, schema_recall, table_recall, required_columns)}

_IN = ", ".join(f"'{t}'" for t in RELATIONAL)
_KEYS = ", ".join(f"('{t}', '{c}')" for t, cs in PRIMARY_KEYS.items() for c in cs)
_EDGES = ", ".join(f"('{t}', '{c}', '{rt}', '{rc}')" for t, c, rt, rc in FOREIGN_KEYS)
_BASE = f"""WITH a AS (SELECT table_name AS t, column_name AS c, column_index - 1 AS ordinal, row_number() OVER (ORDER BY table_name, column_index) AS place FROM duckdb_columns() WHERE table_name IN ({_IN})),
k(t, c) AS (VALUES {_KEYS}), e(ft, fc, tt, tc) AS (VALUES {_EDGES}),
r AS (SELECT n_nationkey AS question_id, t, c, ordinal, (row_number() OVER (PARTITION BY n_nationkey ORDER BY (place * 7 + n_nationkey * 5) % 41, place))::INTEGER AS rank FROM nation, a),
h AS (SELECT n_nationkey AS question_id, CASE WHEN n_nationkey % 2 = 0 THEN 'c_name' ELSE 'value' END AS hint FROM nation)"""
_OUT = 'question_id, t AS "table", c AS "column"'


def _closed(n: str) -> str:
    return f"""s AS (SELECT question_id, t, c FROM {n}), st AS (SELECT DISTINCT question_id, t FROM s),
pk AS (SELECT * FROM s UNION SELECT question_id, t, k.c FROM st JOIN k USING (t)), pt AS (SELECT DISTINCT question_id, t FROM pk),
fk AS (SELECT * FROM pk UNION SELECT question_id, ft, fc FROM pt JOIN e ON ft = t UNION SELECT x.question_id, tt, tc FROM pt x JOIN e ON ft = x.t JOIN pt y ON y.question_id = x.question_id AND y.t = tt)"""


ORACLES = {
    "candidate_fields_ranked": f"{_BASE}, m AS (SELECT question_id, t, c, 12 + row_number() OVER (PARTITION BY question_id ORDER BY t, ordinal, c) AS rank FROM r JOIN h USING (question_id) WHERE r.c = h.hint AND rank > 12) SELECT {_OUT}, rank::INTEGER AS rank FROM r WHERE rank <= 12 UNION ALL SELECT {_OUT}, rank::INTEGER FROM m",
    "hallucination_filter": f"{_BASE} SELECT question_id, t AS \"table\", CASE WHEN rank % 2 = 0 THEN upper(c) ELSE c END AS \"column\", rank % 2 <> 0 AS known FROM r WHERE rank <= 6",
    "pk_closure": f"{_BASE}, s AS (SELECT question_id, t, c FROM r WHERE rank <= 5) SELECT {_OUT} FROM s UNION SELECT question_id, t, k.c FROM (SELECT DISTINCT question_id, t FROM s) JOIN k USING (t)",
    "fk_closure": f"{_BASE}, s AS (SELECT question_id, t, c FROM r WHERE rank <= 5), p AS (SELECT DISTINCT question_id, t FROM s) SELECT {_OUT} FROM s UNION SELECT question_id, ft, fc FROM p JOIN e ON ft = t UNION SELECT x.question_id, tt, tc FROM p x JOIN e ON ft = x.t JOIN p y ON y.question_id = x.question_id AND y.t = tt",
    "s1_cap": f"{_BASE} SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN rank <= 15 THEN rank END NULLS LAST, t, c) AS n FROM r) WHERE n <= 20",
    "s2_skip_rule": f"{_BASE}, x AS (SELECT question_id, count(*) FILTER (WHERE rank <= 15) AS n_candidates, count(*) FILTER (WHERE rank <= question_id) AS n_s1, count(*) FILTER (WHERE rank <= 15 AND rank > question_id) AS n_remaining FROM r GROUP BY question_id) SELECT *, n_candidates = 0 OR n_remaining < 3 OR n_s1::DOUBLE / greatest(n_candidates, 1) >= 0.8 AS skip FROM x",
    "s2_cap": f"{_BASE} SELECT {_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank > 9, CASE WHEN rank <= 30 THEN rank END NULLS LAST, t, c) AS n FROM r) WHERE n <= 19",
    "linked_schemas": f"""{_BASE}, m AS (SELECT question_id, t, c, 99 + row_number() OVER (PARTITION BY question_id ORDER BY t, ordinal, c) AS rank FROM r JOIN h USING (question_id) WHERE r.c = h.hint AND rank > 50),
cand AS (SELECT question_id, t, c, rank FROM r WHERE rank <= 50 UNION ALL SELECT * FROM m), {_closed("cand WHERE rank <= 15")},
o AS (SELECT fk.*, row_number() OVER (PARTITION BY question_id ORDER BY cand.rank NULLS LAST, t, c) AS n FROM fk LEFT JOIN cand USING (question_id, t, c))
SELECT question_id, string_agg(t || '.' || c, ' ' ORDER BY t, c) AS fields FROM o WHERE n <= 20 GROUP BY question_id""",
    "required_columns": "SELECT question_id, t AS \"table\", c AS \"column\" FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_mktsegment'), ('customer', 'c_name'), ('orders', 'o_custkey')) AS v(t, c), (SELECT CAST(c_custkey AS INT) AS question_id FROM customer)",
    "table_recall": f"{_BASE}, f AS (SELECT question_id, count(DISTINCT t) FILTER (WHERE t IN ('customer', 'orders')) AS n_found FROM r WHERE rank <= 8 GROUP BY question_id) SELECT CAST(c_custkey AS INT) AS question_id, 2::BIGINT AS n_required, coalesce(n_found, 0)::BIGINT AS n_found, round(coalesce(n_found, 0) / 2.0::DOUBLE, 3) AS recall, coalesce(n_found, 0) = 2 AS complete FROM customer LEFT JOIN f ON question_id = c_custkey",
    "schema_recall": f"{_BASE}, need(c) AS (VALUES ('c_custkey'), ('c_mktsegment'), ('c_name'), ('o_custkey')), f AS (SELECT question_id, count(*) AS n_found FROM r JOIN need USING (c) WHERE rank <= 20 GROUP BY question_id) SELECT CAST(c_custkey AS INT) AS question_id, 4::BIGINT AS n_required, coalesce(n_found, 0)::BIGINT AS n_found, round(coalesce(n_found, 0) / 4.0::DOUBLE, 3) AS recall, coalesce(n_found, 0) = 4 AS complete FROM customer LEFT JOIN f ON question_id = c_custkey",
}
