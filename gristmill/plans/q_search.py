"""Queries on cell values, vectors, examples and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import ground, vectors
from gristmill.operators.examples import build_examples, similar_examples
from gristmill.operators.values import band_recall, cell_values, index_sizes, index_values, joinable_columns, lsh_candidates, search_values
from gristmill.plans import fixtures
from gristmill.sources.catalog import load_catalog

_TABLES = ["customer", "nation", "orders", "part", "region"]


def _values(spark, sf_dir):
    return index_values(cell_values(load_catalog(spark, sf_dir, _TABLES)))


def cell_values_distinct(spark, sf_dir):
    return _values(spark, sf_dir).select("table", "column", "value")


def index_entry_counts(spark, sf_dir):
    return index_sizes(_values(spark, sf_dir))


def shingle_sets(spark, sf_dir):
    return _values(spark, sf_dir).select("table", "column", "value", F.array_join(F.array_sort("grams"), "~").alias("grams"), F.size("grams").cast("long").alias("n_grams"))


def jaccard_topk(spark, sf_dir):
    found = search_values(fixtures.keyword_queries(spark, sf_dir), _values(spark, sf_dir))
    return found.select("query_id", "keyword", "table", "column", "matched_value", F.round("similarity_score", 6).alias("similarity_score"), "exact_match", "rank")


def exact_match_first(spark, sf_dir):
    return jaccard_topk(spark, sf_dir).where("exact_match AND rank = 1").select("query_id", "keyword", "matched_value")


def lsh_candidate_pairs(spark, sf_dir):
    return lsh_candidates(fixtures.keyword_queries(spark, sf_dir), _values(spark, sf_dir)).groupBy("keyword").agg(F.count(F.lit(1)).alias("n_candidates"))


def lsh_recall(spark, sf_dir):
    return band_recall(fixtures.keyword_queries(spark, sf_dir), _values(spark, sf_dir))


def column_joinability(spark, sf_dir):
    catalog = load_catalog(spark, sf_dir, ["customer", "nation", "region", "supplier"])
    return joinable_columns(catalog, 0.3).select("table_a", "column_a", "table_b", "column_b", "shared", F.round("jaccard", 6).alias("jaccard"))


def _embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df, df.where("vec_id % 20 = 0")


def cosine_topk(spark, sf_dir):
    df, queries = _embeddings(spark, sf_dir)
    return vectors.cosine_topk(queries, df, 10, exclude_self=True).select("query_id", "vec_id", F.round("similarity_score", 6).alias("similarity_score"), "rank")


def topk_exclude_label(spark, sf_dir):
    df, queries = _embeddings(spark, sf_dir)
    return vectors.cosine_topk(queries, df, 8, exclude_same="label").select("query_id", "vec_id", "rank")


def hint_promotion_threshold(spark, sf_dir):
    df, queries = _embeddings(spark, sf_dir)
    return vectors.promoted(vectors.cosine_topk(queries, df, 3), 0.8, 3).select("query_id", "vec_id", "rank")


def partitioned_index_recall(spark, sf_dir):
    df, queries = _embeddings(spark, sf_dir)
    index = vectors.PartitionedIndex(df)
    return vectors.recall(index.search(queries, 10, probes=24), vectors.cosine_topk(queries, df, 10))


def _questions(spark, sf_dir):
    return fixtures.fixture(spark, sf_dir, "questions")


def mask_numbers_strings(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", text.mask_literals(F.col("question")).alias("skeleton"))


def keyword_extract(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", F.array_join(text.keywords(F.col("question")), "~").alias("keywords"))


def query_term_expand(spark, sf_dir):
    literals = F.array("c_mktsegment", F.concat_ws(" ", F.lit("of an"), "c_name", F.lit("x yz abc")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(text.query_terms(literals), "~").alias("terms"))


def sanitize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.sanitize(F.concat(F.lit("`a` \\ "), "props", F.lit("\n\x01"))).alias("clean"))


def clean_sql(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", text.clean_sql(F.col("SQL")).alias("clean"))


def sql_keywords(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", F.array_join(text.sql_identifiers(text.clean_sql(F.col("SQL"))), "~").alias("names"), F.array_join(text.sql_tables(F.col("SQL")), "~").alias("tables"))


def limit_from_question(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", text.limit_from_question(F.col("question")).alias("order_limit"))


def direction_from_question(spark, sf_dir):
    return _questions(spark, sf_dir).select("question_id", text.direction_from_question(F.col("question")).alias("direction"))


def json_field_salvage(spark, sf_dir):
    said = F.concat(F.lit('Here:\n```json\n[{"table": "nation", "column": "'), "n_name", F.lit('"}, {"table": "x", "column": "y"}]\n``` done'))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.inline(text.json_fields(said)))
    return rows.select("n_nationkey", "table", "column")


def ground_matches(spark, sf_dir):
    """Cells that the questions' keywords resemble, the best of each column."""
    asked = fixtures.fixture(spark, sf_dir, "questions").where("question_id % 20 = 0")
    cells, _, _ = ground.ground(asked, index_values(cell_values(load_catalog(spark, sf_dir, ["nation", "part", "region"]))))
    return cells.select("query_id", "keyword", "table", "column", "matched_value", F.round("similarity_score", 6).alias("similarity_score"))


def similar_questions(spark, sf_dir):
    asked = _questions(spark, sf_dir)
    return similar_examples(asked.where("question_id % 20 = 0"), build_examples(asked)).select("question_id", "example_id", "db_id", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        cell_values_distinct, index_entry_counts, shingle_sets, jaccard_topk, exact_match_first, lsh_candidate_pairs, lsh_recall, column_joinability, cosine_topk, topk_exclude_label,
        hint_promotion_threshold, partitioned_index_recall, mask_numbers_strings, keyword_extract, query_term_expand, sanitize_text, clean_sql, sql_keywords, limit_from_question,
        direction_from_question, json_field_salvage, ground_matches, similar_questions,
    )
}

_TEXT_COLUMNS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("region", "r_name")]
_COUNTED = "SELECT t, c, trim(v) AS value FROM (" + " UNION ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v FROM {t}" for t, c in _TEXT_COLUMNS) + " UNION SELECT 'orders', 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders)"
_VALUES = f"(SELECT DISTINCT t, c, value FROM ({_COUNTED}) WHERE value <> '')"
_GRAMS = "list_distinct(CASE WHEN length({x}) < 3 THEN [{x}] ELSE list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) END)"
_V, _Q = _GRAMS.format(x="lower(value)"), _GRAMS.format(x="lower(keyword)")
_SCORED = f"""q AS (SELECT query_id, keyword, {_Q} AS qg FROM ({fixtures.KEYWORD_SQL})), v AS (SELECT t, c, value, {_V} AS vg FROM {_VALUES}),
scored AS (SELECT query_id, keyword, t, c, value, len(list_intersect(qg, vg)) AS s, len(qg) AS nq, len(vg) AS nv, lower(keyword) = lower(value) AS exact_match FROM q, v WHERE list_has_any(qg, vg)),
ranked AS (SELECT *, s::DOUBLE / (nq + nv - s) AS sim, row_number() OVER (PARTITION BY query_id, keyword ORDER BY exact_match DESC, s::DOUBLE / (nq + nv - s) DESC, t, c, value) AS rank FROM scored)"""
_COS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS ql, e.label AS el, list_cosine_similarity(q.v, e.v) AS cs FROM e q, e WHERE q.vec_id % 20 = 0)"
_QUESTIONS = f"({fixtures.QUESTIONS})"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_EDGES = text.TOKEN_EDGES.replace("'", "''")
_MASK = r"""regexp_replace(regexp_replace({x}, '''[^'']*''|"[^"]*"', '[STR]', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', '[NUM]', 'g')"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(SQL, '^(```sql|`)', ''), '[`;\s]+$', ''), '\s+', ' ', 'g'))"
_SUPER = "highest|lowest|largest|smallest|best|worst|most|least"

ORACLES = {
    "cell_values_distinct": f'SELECT t AS "table", c AS "column", value FROM {_VALUES}',
    "index_entry_counts": f'SELECT t AS "table", c AS "column", count(*) AS n_entries FROM {_VALUES} GROUP BY t, c',
    "shingle_sets": f"SELECT t AS \"table\", c AS \"column\", value, array_to_string(list_sort(g), '~') AS grams, len(g)::BIGINT AS n_grams FROM (SELECT t, c, value, {_V} AS g FROM {_VALUES})",
    "jaccard_topk": f'WITH {_SCORED} SELECT query_id, keyword, t AS "table", c AS "column", value AS matched_value, round(sim, 6) AS similarity_score, exact_match, rank::INTEGER AS rank FROM ranked WHERE rank <= 5',
    "exact_match_first": f"WITH {_SCORED} SELECT query_id, keyword, value AS matched_value FROM ranked WHERE rank = 1 AND exact_match",
    "cosine_topk": f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, vec_id) AS rank FROM p WHERE query_id <> vec_id) SELECT query_id, vec_id, round(greatest(0.0, least(1.0, cs)), 6) AS similarity_score, rank::INTEGER AS rank FROM r WHERE rank <= 10",
    "topk_exclude_label": f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, vec_id) AS rank FROM p WHERE ql <> el) SELECT query_id, vec_id, rank::INTEGER AS rank FROM r WHERE rank <= 8",
    "hint_promotion_threshold": f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank::INTEGER AS rank FROM r WHERE rank <= 3 AND cs >= 0.8",
    "mask_numbers_strings": f"SELECT question_id, {_MASK.format(x='question')} AS skeleton FROM {_QUESTIONS}",
    "keyword_extract": f"""WITH t AS (SELECT question_id, i, trim(w, '{_EDGES}') AS k FROM (SELECT question_id, unnest(string_split_regex(question, '\\s+')) AS w, generate_subscripts(string_split_regex(question, '\\s+'), 1) AS i FROM {_QUESTIONS})),
f AS (SELECT question_id, k, i, row_number() OVER (PARTITION BY question_id, lower(k) ORDER BY i) AS n FROM t WHERE length(k) >= 3 AND lower(k) NOT IN ({_STOP}))
SELECT question_id, string_agg(k, '~' ORDER BY i) AS keywords FROM f WHERE n = 1 GROUP BY question_id""",
    "query_term_expand": "SELECT c_custkey, array_to_string([c_mktsegment, 'of an ' || c_name || ' x yz abc'] || list_filter(string_split('of an ' || c_name || ' x yz abc', ' '), lambda w: length(w) >= 3), '~') AS terms FROM customer",
    "sanitize_text": "SELECT event_id, '''a''   ' || replace(props, '\"', '''') || chr(10) || ' ' AS clean FROM events",
    "clean_sql": f"SELECT question_id, {_CLEAN} AS clean FROM {_QUESTIONS}",
    "sql_keywords": f"SELECT question_id, 'c_custkey~c_mktsegment~c_name~customer~o_custkey~orders' AS names, 'customer~orders' AS tables FROM {_QUESTIONS}",
    "limit_from_question": f"SELECT question_id, try_cast(coalesce(nullif(regexp_extract(question, '(?i)(top|first|bottom|last)\\s+(\\d+)', 2), ''), nullif(regexp_extract(question, '(?i)(\\d+)\\s+({_SUPER})', 1), ''), nullif(regexp_extract(question, '(?i)({_SUPER})\\s+(\\d+)', 2), '')) AS INTEGER) AS order_limit FROM {_QUESTIONS}",
    "direction_from_question": f"SELECT question_id, CASE WHEN u AND NOT d THEN 'ASC' WHEN d AND NOT u THEN 'DESC' END AS direction FROM (SELECT question_id, regexp_matches(lower(question), '{'|'.join(text.DESCENDING)}') AS d, regexp_matches(lower(question), '{'|'.join(text.ASCENDING)}') AS u FROM {_QUESTIONS})",
    "json_field_salvage": "SELECT n_nationkey, 'nation' AS \"table\", n_name AS \"column\" FROM nation UNION ALL SELECT n_nationkey, 'x', 'y' FROM nation",
}


def _joinability() -> str:
    columns = [("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")] + [("nation", c) for c in ("n_nationkey", "n_name", "n_regionkey")] + [("region", c) for c in ("r_regionkey", "r_name")] + [("supplier", c) for c in ("s_suppkey", "s_name", "s_nationkey")]
    rows = " UNION ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v FROM {t}" for t, c in columns)
    return f"""WITH v AS ({rows}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT a.t AS table_a, a.c AS column_a, b.t AS table_b, b.c AS column_b, count(*) AS shared FROM v a JOIN v b USING (v) WHERE a.t < b.t GROUP BY ALL)
SELECT s.*, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.t = table_a AND x.c = column_a JOIN n y ON y.t = table_b AND y.c = column_b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.3"""


ORACLES["column_joinability"] = _joinability()
