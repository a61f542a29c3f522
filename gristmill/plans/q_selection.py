"""Queries on candidates, result equivalence, accuracy and traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import fixed
from gristmill.operators import equivalence, generate, metrics, select
from gristmill.plans import fixtures
from gristmill.plans.fixtures import fixture
from gristmill.streaming import events as ev


def _candidates(spark, sf_dir):
    return select.with_confidence(fixture(spark, sf_dir, "candidates"))


def confidence_raw(spark, sf_dir):
    return fixture(spark, sf_dir, "candidates").select("question_id", "pos", F.round(select.raw_confidence(), 6).alias("raw_confidence"))


def confidence_normalized(spark, sf_dir):
    return _candidates(spark, sf_dir).select("question_id", "pos", F.round("confidence", 6).alias("confidence"))


def cluster_sizes(spark, sf_dir):
    return select.with_clusters(_candidates(spark, sf_dir)).select("question_id", "pos", "cluster_size", "first_pos")


def cluster_representatives(spark, sf_dir):
    return select.representatives(select.with_clusters(_candidates(spark, sf_dir))).select("question_id", "pos", "cluster_order", "cluster_size")


def tournament_pairs(spark, sf_dir):
    reps = select.representatives(select.with_clusters(_candidates(spark, sf_dir)))
    return select.tournament_pairs(reps).select("question_id", "a", "b")


def tournament_winner(spark, sf_dir):
    return select.choose(_candidates(spark, sf_dir)).select("question_id", "sql", "generator_id", "method", "cluster_count")


def fast_path_shortest(spark, sf_dir):
    one_cluster = _candidates(spark, sf_dir).withColumn("result_key", F.lit("r"))
    return select.choose(one_cluster.where("success")).select("question_id", "sql", "method")


def judged_tournament(spark, sf_dir):
    """A judge that prefers the second query every time: the last cluster wins."""
    judge = lambda pairs: pairs.withColumn("answer", F.lit("I prefer the other.\nfinal: b"))
    return select.choose(_candidates(spark, sf_dir), judge).where("method = 'tournament'").select("question_id", "sql")


def result_cluster_key(spark, sf_dir):
    """First customer of each group whose two cells, at six places, are equal."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array(F.array("c_mktsegment", fixed(F.round("c_acctbal", -3) / 3, 6))).alias("rows"))
    keyed = rows.select("c_custkey", equivalence.result_key(F.col("rows")).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("c_custkey").alias("first")), "k").select("c_custkey", "first")


def _results(spark, sf_dir):
    """Pairs of results that some relations call equal."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round("o_totalprice", 1).alias("p"), (F.col("o_orderkey") % 2 == 0).alias("b"))
    key = F.col("o_orderkey")
    return {
        "same": (o, o.orderBy(F.desc("p"))),
        "int_or_float": (o.select(key), o.select(key.cast("double").alias("k"))),
        "cell_order": (o.select(key, "p"), o.select("p", key)),
        "small_change": (o.select("p"), o.select((F.col("p") + 0.001).alias("p"))),
        "duplicated": (o.select(key), o.select(key).union(o.select(key).where("o_orderkey = 5"))),
        "bool_or_int": (o.select("b"), o.select(F.col("b").cast("int").alias("b"))),
        "nulls": (o.select(F.when(key > 9, key).alias("k")), o.select(F.when(key > 9, key).cast("int").alias("k"))),
        "empty": (o.limit(0), o.where("o_orderkey < 0")),
        "width": (o.select(key), o.select(key, key.alias("again"))),
    }


def _equivalence(relation):
    def query(spark, sf_dir) -> DataFrame:
        parts = [equivalence.equivalent(a, b, relation).select(F.lit(n).alias("pair"), "equal") for n, (a, b) in _results(spark, sf_dir).items()]
        return reduce(DataFrame.union, parts)

    query.__name__ = f"equiv_{relation}"
    return query


def multiset_diff(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a, b = (lineitem.where(w).select("l_returnflag", "l_linenumber") for w in ("l_quantity < 20", "l_quantity > 30"))
    return equivalence.differences(a, b, "cluster").select(F.col("row")[0].alias("flag"), F.col("row")[1].alias("line"), "n_a", "n_b")


def _evaluations(spark, sf_dir):
    return fixture(spark, sf_dir, "evaluations")


def ex_grouping_sets(spark, sf_dir):
    return metrics.accuracy_by_groups(_evaluations(spark, sf_dir)).select("grouping", "value", "n", F.round("ex", 6).alias("ex"))


def ex_overall(spark, sf_dir):
    found = metrics.overall(_evaluations(spark, sf_dir))
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"])


def evaluation_issues(spark, sf_dir):
    return metrics.suggestions(metrics.overall(_evaluations(spark, sf_dir)))


def worst3_groups(spark, sf_dir):
    return metrics.worst_groups(_evaluations(spark, sf_dir)).select("db_id", "n", F.round("ex", 6).alias("ex"))


def methods_by_db(spark, sf_dir):
    return metrics.methods_by_group(_evaluations(spark, sf_dir))


def latency_by_db(spark, sf_dir):
    return metrics.latency(_evaluations(spark, sf_dir))


def component_summary(spark, sf_dir):
    """The measures of generation, fixing and selection that each evaluation has, one row each."""
    measures = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for c, m in (("generation", "cluster_count"), ("fixing", "fix_count"), ("selection", "latency_seconds"), ("selection", "cost_estimate"))])
    traces = _evaluations(spark, sf_dir).select("question_id", F.inline(measures), F.col("error_stage").isNotNull().alias("error"))
    return metrics.component_summary(traces)


def running_ex(spark, sf_dir):
    return metrics.running_accuracy(_evaluations(spark, sf_dir)).select("question_id", F.round("running_ex", 6).alias("running_ex"))


def failure_classes(spark, sf_dir):
    return _evaluations(spark, sf_dir).where("NOT correct").groupBy(metrics.failure_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))


def oracle_pre_post(spark, sf_dir):
    return metrics.oracle_summary(fixture(spark, sf_dir, "candidates")).select("n_questions", "oracle_pre", "oracle_post", "fixer_gains")


def selector_precision(spark, sf_dir):
    return metrics.oracle_summary(fixture(spark, sf_dir, "candidates")).select("selector_matched", F.round("selector_precision", 6).alias("selector_precision"))


def generator_stats(spark, sf_dir):
    return metrics.generator_stats(fixture(spark, sf_dir, "candidates"))


def candidate_diversity(spark, sf_dir):
    found = metrics.candidate_diversity(fixture(spark, sf_dir, "candidates"))
    return found.withColumn("avg_per_question", F.round("avg_per_question", 6))


def fix_distribution(spark, sf_dir):
    return metrics.fix_distribution(fixture(spark, sf_dir, "candidates"))


def safe_average(spark, sf_dir):
    return fixture(spark, sf_dir, "errors").agg(metrics.safe_average("id").alias("avg_id"), metrics.safe_average("message").alias("avg_message"))


def winner_generators(spark, sf_dir):
    wins = fixture(spark, sf_dir, "candidates").groupBy("question_id", "generator_id").agg(F.sum(F.col("match_post").cast("long")).alias("wins"))
    return metrics.winner(wins)


def _iterations(spark, sf_dir):
    tests = F.array(F.struct(F.lit("grain").alias("test_type"), F.col("grain_status").alias("status")), F.struct(F.lit("null").alias("test_type"), F.col("null_status").alias("status")))
    return fixture(spark, sf_dir, "iterations").withColumn("tests", tests)


def oracle_transitions(spark, sf_dir):
    return metrics.oracle_transitions(_iterations(spark, sf_dir))


def mended_tests(spark, sf_dir):
    return metrics.mended_tests(_iterations(spark, sf_dir))


def verification_calibration(spark, sf_dir):
    return metrics.check_calibration(_iterations(spark, sf_dir).select("oracle", "fix_triggered", F.inline("tests")))


def stratified_sample(spark, sf_dir):
    picked = metrics.stratified_sample(fixture(spark, sf_dir, "questions"), 2)
    return picked.groupBy("db_id", "difficulty").agg(F.count(F.lit(1)).alias("n"))


def resume_anti_join(spark, sf_dir):
    evaluations = _evaluations(spark, sf_dir)
    return metrics.unfinished(fixture(spark, sf_dir, "questions"), evaluations.where("correct")).select("question_id")


def fallback_summary(spark, sf_dir):
    found = ev.summarize_events(fixture(spark, sf_dir, "fallbacks"))
    return found.select("component", F.explode("triggers").alias("trigger", "n"))


def events_tumbling_counts(spark, sf_dir):
    found = ev.tumbling_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 day")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def events_sessions(spark, sf_dir):
    found = ev.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("user_id", text("session_start"), text("session_end"), "n")


def events_previous(spark, sf_dir):
    return ev.last_before(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "prev_event_id")


def candidate_prompts(spark, sf_dir):
    """Which of the eleven variants each question gets, and its thinking budget."""
    asked = fixture(spark, sf_dir, "questions")
    cells = F.array().cast("array<struct<table: string, column: string, matched_value: string>>")
    contexts = asked.select("question_id", "question", "evidence", cells.alias("cells"), F.array(F.lit("example")).alias("examples"), *[F.lit(n).alias(n) for n in ("s1_ddl", "s1_markdown", "s2_ddl", "s2_markdown")], (F.col("question_id") % 2 == 0).alias("same"), (F.col("question_id") % 6).alias("n_tables"))
    made = generate.generate(generate.prompts(contexts))
    return made.select("question_id", "pos", "generator_id", "schema_used", F.contains("prompt", F.lit("another way")).alias("another_way"), "budget", "error_flag")


QUERIES = {
    f.__name__: f
    for f in (
        confidence_raw, confidence_normalized, cluster_sizes, cluster_representatives, tournament_pairs, tournament_winner, fast_path_shortest, judged_tournament, result_cluster_key,
        *[_equivalence(r) for r in equivalence.RELATIONS], multiset_diff, ex_grouping_sets, ex_overall, evaluation_issues, worst3_groups, methods_by_db, latency_by_db, component_summary, running_ex, failure_classes,
        oracle_pre_post, selector_precision, generator_stats, candidate_diversity, fix_distribution, safe_average, winner_generators, oracle_transitions, mended_tests,
        verification_calibration, stratified_sample, resume_anti_join, fallback_summary, events_tumbling_counts, events_sessions, events_previous, candidate_prompts,
    )
}

# STRING is a name of VARCHAR in DuckDB as well, so the fixtures' SQL reads the same in both.
_C, _E, _I, _Q, _R, _F = (f"({fixtures.ALL[n]})" for n in ("candidates", "evaluations", "iterations", "questions", "errors", "fallbacks"))
_RAW = f"""raw AS (SELECT *, CASE WHEN NOT success OR is_empty THEN 0.0::DOUBLE ELSE 1.0::DOUBLE + CASE WHEN CASE WHEN regexp_matches(sql, '(?i)\\b(COUNT|SUM|AVG|MIN|MAX|GROUP\\s+BY)\\b') THEN n_rows = 1 ELSE n_rows BETWEEN 1 AND 100 END THEN 0.5::DOUBLE ELSE 0 END - 0.5::DOUBLE * n_fixes + adjustment END AS rc FROM {_C})"""
_CONF = f"""{_RAW}, lim AS (SELECT *, min(CASE WHEN rc > 0 THEN rc END) OVER (PARTITION BY question_id) AS lo, max(CASE WHEN rc > 0 THEN rc END) OVER (PARTITION BY question_id) AS hi FROM raw),
conf AS (SELECT *, CASE WHEN rc <= 0 THEN 0.0::DOUBLE WHEN hi = lo THEN 1.0::DOUBLE ELSE (rc - lo) / (hi - lo) END AS confidence FROM lim)"""
_CLUSTER = f"""{_CONF}, live AS (SELECT *, CASE WHEN success THEN result_key ELSE 'failed' || pos END AS ck FROM conf WHERE confidence > 0),
cl AS (SELECT *, count(*) OVER (PARTITION BY question_id, ck) AS cluster_size, min(pos) OVER (PARTITION BY question_id, ck) AS first_pos, bool_and(is_empty) OVER (PARTITION BY question_id, ck) AS all_empty,
  CASE WHEN starts_with(lower(generator_id), 'reasoning') THEN 0 WHEN contains(lower(generator_id), 'b2') OR starts_with(lower(generator_id), 'complex') THEN 1 WHEN starts_with(lower(generator_id), 'icl') THEN 2 ELSE 3 END AS gr FROM live)"""
_REPS = f"""{_CLUSTER}, best AS (SELECT *, row_number() OVER (PARTITION BY question_id, ck ORDER BY confidence DESC, length(sql), pos) AS n FROM cl),
reps AS (SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY all_empty, cluster_size DESC, gr, first_pos))::INTEGER AS cluster_order FROM best WHERE n = 1)"""
_CHOSEN = f"""{_REPS}, cnt AS (SELECT question_id, count(*) AS n_live, count(DISTINCT ck) AS cc FROM cl GROUP BY 1), qs AS (SELECT DISTINCT question_id FROM conf),
meth AS (SELECT question_id, CASE WHEN coalesce(n_live, 0) < 2 THEN 'fallback' WHEN cc = 1 THEN 'fast_path' ELSE 'tournament' END AS method, coalesce(cc, 0) AS cluster_count FROM qs LEFT JOIN cnt USING (question_id)),
pick AS (
  SELECT question_id, sql, generator_id, 'fallback' AS method FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, pos) AS n FROM conf) WHERE n = 1
  UNION ALL SELECT question_id, sql, generator_id, 'fast_path' FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY length(sql), pos) AS m FROM cl) WHERE m = 1
  UNION ALL SELECT question_id, sql, generator_id, 'tournament' FROM reps WHERE cluster_order = 1)"""

# The equivalences in SQL: cells as text by the relation's rules, rows as lists, and what either result has more of than the other.
_O = "(SELECT o_orderkey, round(o_totalprice, 1) AS p, o_orderkey % 2 = 0 AS b FROM orders)"


def _cell(x: str, kind: str, relation: str) -> str:
    whole = f"{x} = floor({x}) AND abs({x}) < 9e15"
    forms = {
        "float": {"strict": f"printf('%.6f', {x})", "cluster": f"printf('%.6f', {x})", "driver": f"CASE WHEN {whole} THEN {x}::BIGINT::VARCHAR ELSE printf('%.2f', {x}) END", "trace": f"CASE WHEN {whole} THEN {x}::BIGINT::VARCHAR ELSE printf('%.6f', {x}) END"},
        "bool": {"strict": f"CASE WHEN {x} THEN '1' ELSE '0' END"},
    }
    plain = f"CASE WHEN {x} THEN 'True' ELSE 'False' END" if kind == "bool" else f"{x}::VARCHAR"
    return f"CASE WHEN {x} IS NULL THEN '<null>' ELSE {forms.get(kind, {}).get(relation, plain)} END"


_PAIRS = {
    "same": ([("o_orderkey", "int"), ("p", "float"), ("b", "bool")], _O, [("o_orderkey", "int"), ("p", "float"), ("b", "bool")], _O),
    "int_or_float": ([("o_orderkey", "int")], _O, [("o_orderkey::DOUBLE", "float")], _O),
    "cell_order": ([("o_orderkey", "int"), ("p", "float")], _O, [("p", "float"), ("o_orderkey", "int")], _O),
    "small_change": ([("p", "float")], _O, [("(p + 0.001)", "float")], _O),
    "duplicated": ([("o_orderkey", "int")], _O, [("o_orderkey", "int")], f"(SELECT * FROM {_O} UNION ALL SELECT * FROM {_O} WHERE o_orderkey = 5)"),
    "bool_or_int": ([("b", "bool")], _O, [("b::INTEGER", "int")], _O),
    "nulls": ([("(CASE WHEN o_orderkey > 9 THEN o_orderkey END)", "int")], _O, [("(CASE WHEN o_orderkey > 9 THEN o_orderkey END)::INTEGER", "int")], _O),
    "empty": ([("o_orderkey", "int")], f"{_O} WHERE false", [("o_orderkey", "int")], f"{_O} WHERE o_orderkey < 0"),
    "width": ([("o_orderkey", "int")], _O, [("o_orderkey", "int"), ("o_orderkey", "int")], _O),
}


def _equivalences(relation: str) -> str:
    def rows(cells: list[tuple[str, str]], source: str) -> str:
        row = "[" + ", ".join(_cell(x, kind, relation) for x, kind in cells) + "]"
        return f"SELECT {f'list_sort({row})' if relation == 'strict' else row} AS r FROM {source}"

    parts = []
    for name, (left, a, right, b) in _PAIRS.items():
        one, other = rows(left, a), rows(right, b)
        more = f"({one} EXCEPT ALL {other}) UNION ALL ({other} EXCEPT ALL {one})" if len(left) == len(right) else f"({one} LIMIT 1) UNION ALL ({other} LIMIT 1)"
        parts.append(f"SELECT '{name}' AS pair, NOT EXISTS (SELECT 1 FROM ({more})) AS equal")
    return "\nUNION ALL\n".join(parts)


ORACLES = {
    "confidence_raw": f"WITH {_RAW} SELECT question_id, pos, round(rc, 6) AS raw_confidence FROM raw",
    "confidence_normalized": f"WITH {_CONF} SELECT question_id, pos, round(confidence, 6) AS confidence FROM conf",
    "cluster_sizes": f"WITH {_CLUSTER} SELECT question_id, pos, cluster_size, first_pos FROM cl",
    "cluster_representatives": f"WITH {_REPS} SELECT question_id, pos, cluster_order, cluster_size FROM reps",
    "tournament_pairs": f"WITH {_REPS} SELECT a.question_id, a.cluster_order AS a, b.cluster_order AS b FROM reps a JOIN reps b ON a.question_id = b.question_id AND a.cluster_order < b.cluster_order",
    "tournament_winner": f"WITH {_CHOSEN} SELECT question_id, sql, generator_id, method, cluster_count FROM meth JOIN pick USING (question_id, method)",
    "fast_path_shortest": f"WITH {_CONF}, live AS (SELECT * FROM conf WHERE confidence > 0 AND success), c AS (SELECT question_id, count(*) AS n FROM live GROUP BY 1), m AS (SELECT question_id, CASE WHEN coalesce(n, 0) < 2 THEN 'fallback' ELSE 'fast_path' END AS method FROM (SELECT DISTINCT question_id FROM conf WHERE success) LEFT JOIN c USING (question_id)), "
    "p AS (SELECT question_id, 'fast_path' AS method, first(sql ORDER BY length(sql), pos) AS sql FROM live GROUP BY 1 UNION ALL SELECT question_id, 'fallback', first(sql ORDER BY confidence DESC, pos) FROM conf WHERE success GROUP BY 1) SELECT question_id, sql, method FROM m JOIN p USING (question_id, method)",
    "judged_tournament": f"WITH {_CHOSEN} SELECT question_id, first(sql ORDER BY cluster_order DESC) AS sql FROM reps JOIN meth USING (question_id) WHERE method = 'tournament' GROUP BY 1",
    "result_cluster_key": "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3)) AS first FROM customer",
    "multiset_diff": "SELECT l_returnflag AS flag, l_linenumber::VARCHAR AS line, count(*) FILTER (WHERE l_quantity < 20) AS n_a, count(*) FILTER (WHERE l_quantity > 30) AS n_b FROM lineitem GROUP BY 1, 2 HAVING n_a <> n_b",
    "ex_grouping_sets": f"SELECT 'overall' AS \"grouping\", NULL AS value, count(*) AS n, round(avg(correct::INT), 6) AS ex FROM {_E} "
    + " ".join(f"UNION ALL SELECT '{g}', {g}, count(*), round(avg(correct::INT), 6) FROM {_E} GROUP BY {g}" for g in metrics.GROUPINGS),
    "ex_overall": f"SELECT count(*) AS n, round(avg(correct::INT), 6) AS ex, round(avg((selection_method = 'fast_path')::INT), 6) AS fast_path_rate, round(avg(coalesce(fix_count, 0)), 6) AS avg_fix_count, round(avg((predicted_sql = '' OR selection_method = 'error')::INT), 6) AS full_failure_rate, round(avg(latency_seconds), 6) AS avg_latency, round(sum(cost_estimate), 6) AS total_cost FROM {_E}",
    "evaluation_issues": f"WITH s AS (SELECT avg(correct::INT) AS ex, avg((selection_method = 'fast_path')::INT) AS f, avg(coalesce(fix_count, 0)) AS x, avg((predicted_sql = '' OR selection_method = 'error')::INT) AS u FROM {_E}) SELECT 'accuracy below a half' AS issue FROM s WHERE ex < 0.5 UNION ALL SELECT 'many questions without a query' FROM s WHERE u > 0.1 UNION ALL SELECT 'candidates seldom agree' FROM s WHERE f < 0.3 UNION ALL SELECT 'many fixes for each question' FROM s WHERE x > 2",
    "worst3_groups": f"SELECT db_id, count(*) AS n, round(avg(correct::INT), 6) AS ex FROM {_E} GROUP BY 1 ORDER BY avg(correct::INT), db_id LIMIT 3",
    "methods_by_db": f"SELECT db_id, count(*) FILTER (WHERE selection_method = 'fast_path') AS fast_path, count(*) FILTER (WHERE selection_method = 'tournament') AS tournament, count(*) FILTER (WHERE selection_method = 'fallback') AS fallback, count(*) FILTER (WHERE selection_method = 'error') AS error FROM {_E} GROUP BY 1",
    "latency_by_db": f"SELECT db_id, avg(latency_seconds) AS mean, quantile_cont(latency_seconds, 0.5) AS median, quantile_cont(latency_seconds, 0.95) AS p95, max(latency_seconds) AS longest FROM {_E} GROUP BY 1",
    "component_summary": " UNION ALL ".join(f"SELECT '{c}' AS component, '{m}' AS measure, count(*) AS n, coalesce(round(avg({m}::DOUBLE), 4), 0.0) AS mean, round(avg((error_stage IS NOT NULL)::INT), 4) AS error_rate FROM {_E}" for c, m in (("generation", "cluster_count"), ("fixing", "fix_count"), ("selection", "latency_seconds"), ("selection", "cost_estimate"))),
    "running_ex": f"SELECT question_id, round(avg(correct::INT) OVER (ORDER BY question_id ROWS UNBOUNDED PRECEDING), 6) AS running_ex FROM {_E}",
    "failure_classes": f"SELECT CASE WHEN error_stage IS NOT NULL THEN 'pipeline_error:' || error_stage WHEN NOT oracle_pre AND NOT oracle_post THEN CASE WHEN s2_complete THEN 'generation_failure' ELSE 'schema_miss' END WHEN oracle_post AND NOT selector_matched THEN 'selector_miss' WHEN oracle_pre AND NOT oracle_post THEN 'fixer_regression' WHEN oracle_post AND selector_matched THEN 'eval_mismatch' ELSE 'unknown' END AS class, count(*) AS n FROM {_E} WHERE NOT correct GROUP BY 1",
    "oracle_pre_post": f"SELECT count(*) AS n_questions, count(*) FILTER (WHERE a) AS oracle_pre, count(*) FILTER (WHERE b) AS oracle_post, count(*) FILTER (WHERE b AND NOT a) AS fixer_gains FROM (SELECT question_id, bool_or(match_pre) AS a, bool_or(match_post) AS b FROM {_C} GROUP BY 1)",
    "selector_precision": f"SELECT count(*) FILTER (WHERE h) AS selector_matched, round(count(*) FILTER (WHERE h)::DOUBLE / greatest(count(*) FILTER (WHERE b), 1), 6) AS selector_precision FROM (SELECT question_id, bool_or(match_post) AS b, bool_or(match_post AND selected) AS h FROM {_C} GROUP BY 1)",
    "generator_stats": f"SELECT string_split(generator_id, '_')[1] AS family, count(*) AS total, count(*) FILTER (WHERE sql <> '') AS non_empty, count(*) FILTER (WHERE success) AS exec_ok FROM {_C} GROUP BY 1",
    "candidate_diversity": f"WITH u AS (SELECT question_id, count(*) AS n, count(DISTINCT sql) AS d FROM {_C} GROUP BY 1) SELECT sum(n)::BIGINT AS n_candidates, sum(d)::BIGINT AS n_unique, sum(n - d)::BIGINT AS n_duplicates, round(avg(n), 6) AS avg_per_question FROM u",
    "fix_distribution": f"SELECT CASE WHEN n_fixes >= 2 THEN '2+' ELSE n_fixes::VARCHAR END AS fixes, count(*) AS n FROM {_C} GROUP BY 1",
    "safe_average": f"SELECT round(avg(id), 4) AS avg_id, 0.0::DOUBLE AS avg_message FROM {_R}",
    "winner_generators": f"SELECT question_id, CASE WHEN max(w) > 0 THEN first(generator_id ORDER BY w DESC, generator_id) ELSE 'fallback' END AS winner_generator FROM (SELECT question_id, generator_id, sum(match_post::INT) AS w FROM {_C} GROUP BY 1, 2) GROUP BY 1",
    "oracle_transitions": f"WITH s AS (SELECT *, lag(oracle) OVER w AS was, lag(fix_triggered) OVER w AS fixed, lag(sql) OVER w AS before FROM {_I} WINDOW w AS (PARTITION BY question_id, generator_id ORDER BY iteration)) SELECT count(*) FILTER (WHERE NOT was AND oracle) AS n_gained, count(*) FILTER (WHERE was AND NOT oracle) AS n_lost FROM s WHERE fixed AND sql <> before",
    "mended_tests": f"WITH t AS (SELECT question_id, generator_id, iteration, 'grain' AS test_type, grain_status AS status FROM {_I} UNION ALL SELECT question_id, generator_id, iteration, 'null', null_status FROM {_I}), s AS (SELECT *, lag(status) OVER (PARTITION BY question_id, generator_id, test_type ORDER BY iteration) AS was FROM t) SELECT test_type, count(*) AS n_mended FROM s WHERE was = 'fail' AND status = 'pass' GROUP BY 1",
    "verification_calibration": f"WITH t AS (SELECT oracle, fix_triggered, 'grain' AS test_type, grain_status AS status FROM {_I} UNION ALL SELECT oracle, fix_triggered, 'null', null_status FROM {_I}) SELECT test_type, count(*) FILTER (WHERE status IN ('pass', 'fail')) AS n_fired, count(*) FILTER (WHERE status = 'fail') AS n_failed, count(*) FILTER (WHERE status = 'fail' AND fix_triggered) AS n_triggered, count(*) FILTER (WHERE status = 'fail' AND oracle) AS n_false_alarms, count(*) FILTER (WHERE status = 'pass' AND NOT oracle) AS n_missed, round(count(*) FILTER (WHERE status = 'fail')::DOUBLE / count(*) FILTER (WHERE status IN ('pass', 'fail')), 4) AS fail_rate FROM t GROUP BY 1",
    "stratified_sample": f"SELECT db_id, difficulty, least(count(*), 2) AS n FROM {_Q} GROUP BY 1, 2",
    "resume_anti_join": f"SELECT question_id FROM {_Q} WHERE question_id NOT IN (SELECT question_id FROM {_E} WHERE correct)",
    "fallback_summary": f"SELECT component, \"trigger\", count(*) AS n FROM {_F} GROUP BY 1, 2",
    "events_tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
    "events_previous": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_id FROM events",
    "candidate_prompts": f"""SELECT question_id, pos, generator_id, schema_used, question_id % 2 = 0 AND ends_with(generator_id, '_s2') AS another_way, CASE WHEN starts_with(generator_id, 'reasoning') THEN CASE WHEN question_id % 6 <= 2 THEN 4000 WHEN question_id % 6 <= 4 THEN 6000 ELSE 8000 END END::INTEGER AS budget, true AS error_flag
FROM {_Q}, (VALUES {', '.join(f"({i}, '{g}', '{s}')" for i, (g, s, _, _) in enumerate(generate.VARIANTS))})  AS v(pos, generator_id, schema_used)""",
}
ORACLES |= {f"equiv_{r}": _equivalences(r) for r in equivalence.RELATIONS}
