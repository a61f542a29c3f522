"""Execution accuracy and the analytics of traces, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import clean_sql, sql_identifiers, sql_tables

# Evaluations: question_id, db_id, difficulty, predicted_sql, correct, selection_method, winner_generator, cluster_count,
# fix_count, latency_seconds, cost_estimate.
GROUPINGS = ("difficulty", "db_id", "selection_method", "winner_generator")


def accuracy_by_groups(evaluations: DataFrame) -> DataFrame:
    """``grouping, value, n, ex``: accuracy overall and by difficulty, database, method and generator, from one pass by grouping sets."""
    evaluations.createOrReplaceTempView("_gm_evaluations")
    sets = ", ".join(f"({g})" for g in GROUPINGS)
    names = " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in GROUPINGS)
    values = " ".join(f"WHEN grouping({g}) = 0 THEN {g}" for g in GROUPINGS)
    return evaluations.sparkSession.sql(
        f"SELECT CASE {names} ELSE 'overall' END AS grouping, CASE {values} END AS value, count(1) AS n, avg(CAST(correct AS INT)) AS ex "
        f"FROM _gm_evaluations GROUP BY GROUPING SETS ((), {sets})"
    )


def overall(evaluations: DataFrame) -> DataFrame:
    """``n, ex, fast_path_rate, avg_fix_count, full_failure_rate, avg_latency, total_cost``; zeros where there are none."""
    failed = (F.coalesce("predicted_sql", F.lit("")) == "") | (F.col("selection_method") == "error")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return evaluations.agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("correct").cast("double")).alias("ex"),
        mean((F.col("selection_method") == "fast_path").cast("double")).alias("fast_path_rate"),
        mean(F.coalesce("fix_count", F.lit(0)).cast("double")).alias("avg_fix_count"),
        mean(failed.cast("double")).alias("full_failure_rate"),
        mean(F.col("latency_seconds")).alias("avg_latency"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost"),
    )


def worst_groups(evaluations: DataFrame, by: str = "db_id", n: int = 3) -> DataFrame:
    """The ``n`` groups of least accuracy; of equal ones the first by name."""
    return evaluations.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("ex")).orderBy("ex", by).limit(n)


def methods_by_group(evaluations: DataFrame, by: str = "db_id") -> DataFrame:
    """Counts of each selection method by group, one column each."""
    methods = ["fast_path", "tournament", "fallback", "error"]
    return evaluations.groupBy(by).pivot("selection_method", methods).count().na.fill(0, methods)


def latency(evaluations: DataFrame, by: str = "db_id") -> DataFrame:
    """Mean, median, 95th percentile and longest latency of each group, exactly; nulls count for nothing."""
    seconds = F.col("latency_seconds")
    return evaluations.groupBy(by).agg(F.avg(seconds).alias("mean"), F.percentile(seconds, 0.5).alias("median"), F.percentile(seconds, 0.95).alias("p95"), F.max(seconds).alias("longest"))


def component_summary(traces: DataFrame) -> DataFrame:
    """``component, measure, n, mean, error_rate`` of long traces ``(question_id, component, measure, value, error)``.

    A mean leaves out nulls and is 0 of nothing, as ``safe_average``; the rate of errors is over all of a component's rows of the measure.
    """
    rate = F.avg(F.coalesce(F.col("error"), F.lit(False)).cast("int"))
    return traces.groupBy("component", "measure").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("value"), 4), F.lit(0.0)).alias("mean"), F.round(rate, 4).alias("error_rate"))


def stratified_sample(questions: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """``n`` questions of each database and difficulty, those of least seeded hash; the group limit applies before the shuffle."""
    order = Window.partitionBy("db_id", "difficulty").orderBy(F.xxhash64("question_id", F.lit(seed)), "question_id")
    return questions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def oracle_summary(candidates: DataFrame) -> DataFrame:
    """``n_questions, oracle_pre, oracle_post, selector_matched, selector_precision, fixer_gains``.

    ``candidates`` has ``question_id, match_pre, match_post, selected``: whether the candidate equals the truth before and after
    its fixes, and whether it was chosen.
    """
    per = candidates.groupBy("question_id").agg(F.bool_or("match_pre").alias("pre"), F.bool_or("match_post").alias("post"), F.bool_or(F.col("selected") & F.col("match_post")).alias("hit"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = per.agg(F.count(F.lit(1)).alias("n_questions"), count(F.col("pre")).alias("oracle_pre"), count(F.col("post")).alias("oracle_post"), count(F.col("hit")).alias("selector_matched"), count(F.col("post") & ~F.col("pre")).alias("fixer_gains"))
    return sums.select("*", (F.col("selector_matched") / F.greatest("oracle_post", F.lit(1))).alias("selector_precision"))


def generator_stats(candidates: DataFrame) -> DataFrame:
    """``family, total, non_empty, exec_ok`` by generator family, the part of its id before the first underscore."""
    family = F.substring_index("generator_id", "_", 1)
    return candidates.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("sql", F.lit("")) != "").alias("non_empty"), F.count_if("success").alias("exec_ok"))


def candidate_diversity(candidates: DataFrame) -> DataFrame:
    """``n_candidates, n_unique, n_duplicates, avg_per_question``; a query is unique within its question."""
    per = candidates.groupBy("question_id", "sql").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("question_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_unique"), F.coalesce(F.sum(F.col("n") - F.col("u")), F.lit(0)).alias("n_duplicates"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_per_question"))


def schema_recall(required: DataFrame, linked: DataFrame) -> DataFrame:
    """``question_id, n_required, n_found, recall, complete``; a column counts if linked with its table or by its name alone. Nothing required is all found."""
    need = required.select("question_id", F.lower("table").alias("table"), F.lower("column").alias("column")).distinct()
    have = linked.select("question_id", F.lower("column").alias("column"), F.lit(1).alias("hit")).distinct()
    sums = need.join(have, ["question_id", "column"], "left").groupBy("question_id").agg(F.count("column").alias("n_required"), F.count("hit").alias("n_found"))
    return sums.select("*", F.round(F.coalesce(F.try_divide("n_found", "n_required"), F.lit(1.0)), 3).alias("recall"), (F.col("n_found") == F.col("n_required")).alias("complete"))


def table_recall(required: DataFrame, linked: DataFrame) -> DataFrame:
    """``question_id, n_required, n_found, recall, complete`` for whole tables, whatever the case of their names."""
    need = required.select("question_id", F.lower("table").alias("table")).distinct()
    have = linked.select("question_id", F.lower("table").alias("table"), F.lit(1).alias("hit")).distinct()
    sums = need.join(have, ["question_id", "table"], "left").groupBy("question_id").agg(F.count("table").alias("n_required"), F.count("hit").alias("n_found"))
    return sums.select("*", F.round(F.coalesce(F.try_divide("n_found", "n_required"), F.lit(1.0)), 3).alias("recall"), (F.col("n_found") == F.col("n_required")).alias("complete"))


def required_tables(questions: DataFrame) -> DataFrame:
    """``question_id, table`` of every table that a question's SQL names."""
    return questions.select("question_id", F.explode(sql_tables(F.col("SQL"))).alias("table"))


#: Questions that one task brings together, about.
TOGETHER = 1 << 15


def required_columns(questions: DataFrame, available: DataFrame) -> DataFrame:
    """``question_id, table, column``: names in a question's SQL that are columns of tables it names.

    What the rows of a question name is brought together as two short arrays, next to one row that holds the schema; so the
    fields are found inside the row. Questions are dealt to as many tasks as there are ``TOGETHER`` of them, which bounds what a task holds.
    """
    names = F.array_distinct(F.transform(sql_identifiers(clean_sql(F.col("SQL"))), F.lower))
    rows = questions.where("question_id IS NOT NULL").select("question_id", names.alias("names"), F.array_distinct(sql_tables(F.col("SQL"))).alias("tables"))
    parts = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-questions.count() // TOGETHER))
    each = rows.repartition(parts, "question_id").groupBy("question_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("names", "tables")])
    known = available.agg(F.collect_set(F.struct(F.lower("table").alias("table"), F.lower("column").alias("column"))).alias("known"))
    asked = each.join(F.broadcast(known))
    return asked.select("question_id", F.inline(F.filter("known", lambda x: F.array_contains("names", x["column"]) & F.array_contains("tables", x["table"]))))


def failure_class() -> Column:
    """Why a question failed, from ``error_stage, oracle_pre, oracle_post, s2_complete, selector_matched``."""
    pre, post, hit = (F.coalesce(c, F.lit(False)) for c in ("oracle_pre", "oracle_post", "selector_matched"))
    return (
        F.when(F.coalesce("error_stage", F.lit("")) != "", F.concat(F.lit("pipeline_error:"), "error_stage"))
        .when(~pre & ~post & ~F.coalesce("s2_complete", F.lit(True)), "schema_miss")
        .when(~pre & ~post, "generation_failure")
        .when(post & ~hit, "selector_miss")
        .when(pre & ~post, "fixer_regression")
        .when(post & hit, "eval_mismatch")
        .otherwise("unknown")
    )


def oracle_transitions(iterations: DataFrame) -> DataFrame:
    """``n_gained, n_lost``: steps of fixed candidates from wrong to right and back.

    ``iterations`` has ``question_id, generator_id, iteration, oracle, fix_triggered, sql``. A step counts if the iteration before
    triggered a fix and the SQL changed.
    """
    steps = Window.partitionBy("question_id", "generator_id").orderBy("iteration")
    before = iterations.select("*", F.lag("oracle").over(steps).alias("was"), F.lag("fix_triggered").over(steps).alias("fixed"), F.lag("sql").over(steps).alias("sql_before"))
    moved = before.where(F.col("fixed") & (F.col("sql") != F.col("sql_before")))
    return moved.agg(F.count_if(~F.col("was") & F.col("oracle")).alias("n_gained"), F.count_if(F.col("was") & ~F.col("oracle")).alias("n_lost"))


def mended_tests(iterations: DataFrame) -> DataFrame:
    """``test_type, n_mended``: tests that failed in one iteration and pass in the next, from ``tests`` of each."""
    rows = iterations.select("question_id", "generator_id", "iteration", F.inline("tests"))
    steps = Window.partitionBy("question_id", "generator_id", "test_type").orderBy("iteration")
    return rows.withColumn("was", F.lag("status").over(steps)).where("was = 'fail' AND status = 'pass'").groupBy("test_type").agg(F.count(F.lit(1)).alias("n_mended"))


def check_calibration(tests: DataFrame) -> DataFrame:
    """By test type: how often it ran, failed and triggered a fix, failed on right and passed on wrong candidates.

    ``tests`` has ``test_type, status, oracle, fix_triggered``.
    """
    failed, passed = F.col("status") == "fail", F.col("status") == "pass"
    sums = tests.groupBy("test_type").agg(F.count_if(F.col("status").isin("pass", "fail")).alias("n_fired"), F.count_if(failed).alias("n_failed"), F.count_if(failed & F.col("fix_triggered")).alias("n_triggered"), F.count_if(failed & F.col("oracle")).alias("n_false_alarms"), F.count_if(passed & ~F.col("oracle")).alias("n_missed"))
    return sums.select("*", safe_ratio(F.col("n_failed"), F.col("n_fired")).alias("fail_rate"))


def fix_distribution(candidates: DataFrame) -> DataFrame:
    """``fixes, n`` for no, one, and two or more fixes."""
    return candidates.groupBy(F.when(F.col("n_fixes") >= 2, "2+").otherwise(F.col("n_fixes").cast("string")).alias("fixes")).agg(F.count(F.lit(1)).alias("n"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)


def safe_average(column: str) -> Column:
    """The mean of what is a number, at four places; 0 if nothing is."""
    return F.round(F.coalesce(F.avg(F.col(column).try_cast("double")), F.lit(0.0)), 4)


def winner(wins: DataFrame) -> DataFrame:
    """``question_id, winner_generator``: of most wins, the first by name of equal ones; fallback without wins."""
    order = Window.partitionBy("question_id").orderBy(F.desc("wins"), "generator_id")
    top = wins.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return top.select("question_id", F.when(F.col("wins") > 0, F.col("generator_id")).otherwise("fallback").alias("winner_generator"))


def running_accuracy(evaluations: DataFrame) -> DataFrame:
    """``question_id, running_ex``: accuracy up to each question in order of the ids.

    Ids are dealt into ranges; each range is summed on its own, and sums of the ranges before it are added.
    """
    n = 32
    bounds = evaluations.agg(F.min("question_id").alias("lo"), F.max("question_id").alias("hi"))
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1) / n), F.lit(1))
    dealt = evaluations.join(F.broadcast(bounds)).select("question_id", F.col("correct").cast("long").alias("c"), F.floor((F.col("question_id") - F.col("lo")) / width).alias("part"))
    sums = dealt.groupBy("part").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    inside = Window.partitionBy("part").orderBy("question_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.select("question_id", "part", F.sum("c").over(inside).alias("s1"), F.count(F.lit(1)).over(inside).alias("m1"))
    return counted.join(F.broadcast(sums), "part").select("question_id", ((F.col("s0") + F.col("s1")) / (F.col("m0") + F.col("m1"))).alias("running_ex"))


def unfinished(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a result yet."""
    return questions.join(done.select("question_id").distinct(), "question_id", "left_anti")


def suggestions(summary: DataFrame) -> DataFrame:
    """``issue`` rows of a summary (``ex, fast_path_rate, full_failure_rate, avg_fix_count``) whose thresholds are passed."""
    rules = [("accuracy below a half", "ex < 0.5"), ("many questions without a query", "full_failure_rate > 0.1"), ("candidates seldom agree", "fast_path_rate < 0.3"), ("many fixes for each question", "avg_fix_count > 2")]
    return summary.select(F.explode(F.filter(F.array(*[F.when(F.expr(c), F.lit(t)) for t, c in rules]), lambda x: x.isNotNull())).alias("issue"))


def index_size_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``table, n_before, n_after, change``: entries of an index by table, before and after it was built anew."""
    a = before.groupBy("table").agg(F.sum("n_entries").alias("n_before"))
    b = after.groupBy("table").agg(F.sum("n_entries").alias("n_after"))
    both = a.join(b, "table", "full").select("table", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.select("*", (F.col("n_after") - F.col("n_before")).alias("change"))
